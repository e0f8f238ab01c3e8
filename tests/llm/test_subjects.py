import random

import numpy as np
import pytest

from graphloom.llm.subjects import classify, decode, describe, sentences, subject_areas, train

SUBJECTS = {"law": "court plaintiff verdict statute contract appeal".split(), "food": "garlic oven butter recipe dough skillet".split(), "music": "chord cello tempo melody score court".split()}
FRAMES = ["It is hard to explain the {} without the {}.", "A good {} saves time, a bad one costs you the {}.", "Nobody had seen the {} next to the {} that week.", "Der Bericht nennt {} und auch {} am Rand."]
IDLE = ["The ball is in their court now.", "There is no recipe for that.", "See the earlier note by Duzo."]


def document(r, mix, n):
    out = []
    for _ in range(n):
        s = r.choice(mix)
        out.append(r.choice(FRAMES).format(r.choice(SUBJECTS[s]), r.choice(SUBJECTS[s])))
        if r.random() < 0.3:
            out.append(r.choice(IDLE))
    return "# Heading about court\n\n" + " ".join(out) + "\n\n```py\ncourt = recipe\n```\n"


def corpus(seed, n):
    r, docs, truth = random.Random(seed), [], {}
    for i in range(n):
        mix = [r.choice(list(SUBJECTS))] if r.random() < 0.8 else r.sample(list(SUBJECTS), 2)
        docs.append((i, document(r, mix, 8 if len(mix) > 1 else r.randrange(2, 8)), f"repo{i % 3}" if i % 4 else None))
        truth[i] = set(mix)
    for i in range(n, n + n // 8):
        docs.append((i, " ".join(r.choice(IDLE) for _ in range(4)), None))
        truth[i] = set()
    return docs, truth


def test_held_out_accuracy(spark):
    docs, truth = corpus(1, 700)
    labels = [(i, s.upper() if i % 5 == 0 else s + " ") for i in truth for s in sorted(truth[i]) if i % 2 == 0] + [(i, "none") for i in truth if not truth[i] and i % 2 == 0]
    labels += [(4, "law"), (None, "law"), (2, None), (3, "unheard of")]
    documents = spark.createDataFrame(docs + [(9000, None, None), (9001, "", "x")], "doc_id bigint, text string, source string")
    got = {}
    for x in subject_areas(documents, spark.createDataFrame(labels, "doc_id bigint, subject string"), spark.createDataFrame([(s, "") for s in SUBJECTS], "subject string, description string")).collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
    held = [i for i in truth if i % 2]
    assert np.mean([got.get(i, set()) == truth[i] for i in held]) > 0.9
    assert not {9000, 9001} & set(got)


def test_headings_code_and_front_matter_are_no_sentences():
    text = "---\nkey: value here too\n---\n\n# A heading of words\n\nOne real sentence stands here.\n\n```\nsome code of words\n```\n\n- item of several words\n"
    got, features = sentences(text)
    assert got == [["one", "real", "sentence", "stand", "here"], ["item", "of", "several", "word"]] and features[0] == 1


@pytest.mark.parametrize(
    "text, fences",
    [
        ("Abstract comes here first. ```js\nsome code of words\n```\n\nThe tail stays here.", 1),
        ("Abstract comes here first. ```some code of words``` The tail stays here.", 1),
        ("```\nsome code of words\n```\nAbstract comes here first. ```js\nmore code of words\n```\nThe tail stays here.", 2),
        ("Abstract comes here first.\n```\n\nThe tail stays here.", 0),
        ("~~~\nsome ``` code of words\n~~~\nAbstract comes here first.\n\nThe tail stays here.", 1),
        ("````\nsome code\n```\nof words\n````\nAbstract comes here first.\n\n~~~\n\nThe tail stays here.", 1),
    ],
)
def test_text_after_code_blocks_stays(text, fences):
    got, features = sentences(text)
    assert got == [["abstract", "come", "here", "first"], ["the", "tail", "stay", "here"]] and features[0] == fences


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "Some text is here.", "r")], "doc_id bigint, text string, source string")
    none = spark.createDataFrame([], "doc_id bigint, subject string")
    assert classify(d, train(d, none, ["law"])).count() == 0


def test_model_handles_texts_without_terms(spark):
    docs, truth = corpus(2, 200)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    m = train(d, spark.createDataFrame([(i, s) for i in truth for s in truth[i]], "doc_id bigint, subject string"), sorted(SUBJECTS))
    share, total = describe(m, [[], [["unknown", "words", "only"]]])
    assert total.tolist() == [0, 0]
    assert not decode(m, share, total, np.zeros((2, 5)), [None, "repo1"]).any()
