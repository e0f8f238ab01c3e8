"""Subject areas of documents, by calibrated classifier chains over sentence evidence.

A sentence mixture model is fitted on labelled documents: every sentence treats one subject or none, a document's labels
say which subjects its sentences may treat (leaving room for wrong and missing labels), and expectation maximisation
finds which words speak for which subject. Only words enter whose documents' labels differ from all documents' labels
beyond chance, so that no subject can claim a language or a turn of phrase; sentences that recur, names and numbers
aside, under all labels alike are set phrases and treat nothing. Sentences of given background texts (test items) are held to no subject.

For any document the fitted model yields, per subject, the share of its topical sentences. On these shares, the counts of
the terms that speak most for each subject, the document's source and its structure a chain of logistic classifiers is trained, one per subject from the most frequent
to the rarest, each seeing the decisions before it and so the co-occurrence of subjects. Scores are calibrated on
held-out documents, and a beam search decodes the likeliest combination of labels.

Fitting takes a bounded sample of labelled documents, at most ``SAMPLE_DOCS`` and about ``SAMPLE_CHARS`` characters,
chosen by hash of doc_id; every document of the corpus is then classified over its whole text with the same model.

Defined results: a null or empty text treats nothing and yields no row; a document without topical sentence neither.
Repeated rows give repeated results. Labels are matched to the subject list without regard to case and white space,
``none`` means no subject, others and nulls are ignored. Without any labelled document nothing is found.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.scratch import cut
from graphloom.plans.spread import spread

SAMPLE_DOCS = 12_000
SAMPLE_CHARS = 16_000_000
BACKGROUND_CHARS = 2_000_000
#: A term speaks for subjects if the divergence of its labels is this large, in nats and as likelihood-ratio statistic.
DIVERGENCE, SIGNIFICANCE = 0.25, 18.0
#: A sentence that recurs in so many labelled documents with less divergence is a set phrase.
PHRASE_DOCS = 20
#: Words of so large a share of the documents stay in the key of a set phrase, other words are blanks in it.
FRAME_SHARE = 0.02
ROUNDS = 12
BEAM = 4
#: Chance left to subjects a document was not labelled with.
STRAY = 0.02
#: Weight of no subject for the telling sentences of a document that has labels.
NO_SUBJECT = 0.001
TOKEN_BLOCK = 200_000

_FRONT = re.compile(r"\A﻿?\s*---\r?\n.*?\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
#: Code blocks in the order they stand: backticks from anywhere in a line to the next run as long, tildes from line to line
#: (a longer row of tildes under a text is a heading). A fence without partner opens nothing.
_FENCE = re.compile(
    r"(?<!`)(`{3,}+).*?\1`*+|^[ \t]*~~~(?!~).*?^[ \t]*~~~[ \t]*$|(?:(?<=\n\n)|\A)[ \t]*(~{4,}+)[^~\n]*\n.*?^[ \t]*\2~*[ \t]*$",
    re.S | re.M,
)
_HEADING = re.compile(r"^[ \t]*(?:#{1,6}[ \t].*|[=\-~]{3,}[ \t]*)$", re.M)
_MARK = re.compile(r"^[ \t]*(?:(?:[-*+>|]|\d+[.)]|[A-Z]:|\[\d+:\d+(?::\d+)?\])[ \t]+)+", re.M)
_SPLIT = re.compile(r"(?<=[.!?])[\"'”)\]]*\s+|\n\s*\n")
_WORD = re.compile(r"[^\W\d_]+")


def stem(word: str) -> str:
    """Plural endings off; crude, but the same for every text."""
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 4 and word.endswith(("sses", "ches", "shes", "xes", "ises")):
        return word[:-2]
    if len(word) > 3 and word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def sentences(text: str) -> tuple[list[list[str]], list[float]]:
    """Terms of every prose sentence, and structure features of the document."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    body = _FRONT.sub("", text)
    body, fences = _FENCE.subn(" ", body)
    headings = len(_HEADING.findall(body))
    body = _HEADING.sub("\n\n", body)
    marks = len(_MARK.findall(body))
    body = _MARK.sub("", body)
    out = []
    for s in _SPLIT.split(body):
        words = [stem(w.casefold()) for w in _WORD.findall(s)]
        if len(words) >= 3:
            out.append(words)
    return out, [min(fences, 3.0), np.log1p(headings), np.log1p(marks), np.log1p(len(out)), float(body is not text and text[:3] == "---")]


STRUCTURE = 5


@dataclass
class Model:
    """Everything inference needs; its size follows from the sample bound."""

    subjects: list[str]
    terms: dict[str, int]
    logp: np.ndarray
    prior: np.ndarray
    sources: dict[str, int]
    phrases: frozenset[str] = frozenset()
    frame: frozenset[str] = frozenset()
    leading: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    order: list[int] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    scale: list[tuple[float, float]] = field(default_factory=list)


def phrase_key(words: list[str], terms: dict[str, int], frame: frozenset[str]) -> str:
    """The sentence with its telling and its everyday words, others blanked."""
    return " ".join(w if w in terms or w in frame else "*" for w in words)


def _encode(docs: list[list[list[str]]], terms: dict[str, int], phrases: frozenset[str], frame: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term per token, tokens per sentence, document per sentence; set phrases have no tokens."""
    tokens, lengths, owner = [], [], []
    get = terms.get
    for d, sents in enumerate(docs):
        for words in sents:
            ids = [t for t in map(get, words) if t is not None]
            if ids and phrase_key(words, terms, frame) in phrases:
                ids = []
            tokens.extend(ids)
            lengths.append(len(ids))
            owner.append(d)
    return np.array(tokens, np.int64), np.array(lengths, np.int64), np.array(owner, np.int64)


def _evidence(tokens: np.ndarray, lengths: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Log likelihood of every sentence under every class."""
    out = np.zeros((len(lengths), logp.shape[1]))
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + TOKEN_BLOCK, "right")))
        rows = np.repeat(np.arange(hi - lo), lengths[lo:hi])
        part = logp[tokens[base : ends[hi - 1]]]
        for k in range(logp.shape[1]):
            out[lo:hi, k] = np.bincount(rows, part[:, k], hi - lo)
        lo = hi
    return out


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _by_doc(values: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    return np.stack([np.bincount(owner, values[:, k], docs) for k in range(values.shape[1])], axis=1) if len(owner) else np.zeros((docs, values.shape[1]))


def telling(units: list[set[str]], labels: np.ndarray) -> tuple[set[str], set[str]]:
    """Units (words or sentences) whose documents are labelled unlike all documents, beyond chance; and those that recur
    under all labels alike.

    ``labels`` (docs x classes) has rows of sum one.
    """
    seen = Counter(u for doc in units for u in doc)
    usual = labels.mean(axis=0) + 1e-6
    usual /= usual.sum()
    sums: dict[str, np.ndarray] = {}
    for doc, row in zip(units, labels):
        for u in doc:
            if seen[u] >= 2:
                sums[u] = sums[u] + row if u in sums else row
    telling_, common = set(), set()
    for u, c in sums.items():
        n = seen[u]
        p = (c + 3 * usual) / (n + 3)
        divergence = float((p * np.log(p / usual)).sum())
        if divergence >= DIVERGENCE and 2 * n * divergence >= SIGNIFICANCE:
            telling_.add(u)
        elif divergence < DIVERGENCE and n >= PHRASE_DOCS:
            common.add(u)
    return telling_, common


def fit_terms(docs: list[list[list[str]]], truth: np.ndarray, subjects: list[str], sources: dict[str, int], plain: list[list[list[str]]] = ()) -> Model:
    """Expectation maximisation of the sentence mixture; class 0 is no subject. ``truth`` is docs x subjects, 0 or 1."""
    none = ~truth.any(axis=1, keepdims=True)
    labels = np.column_stack([none, truth])
    labels = labels / labels.sum(axis=1, keepdims=True)
    words, _ = telling([{w for s in sents for w in s} for sents in docs], labels)
    everyday = Counter(w for sents in docs for w in {w for s in sents for w in s})
    frame = frozenset(w for w, n in everyday.items() if n >= FRAME_SHARE * len(docs) and w not in words)
    _, phrases = telling([{phrase_key(s, words, frame) for s in sents} for sents in docs], labels)
    terms = {t: i for i, t in enumerate(sorted(words))}
    allowed = np.full((len(docs) + len(plain), 1 + len(subjects)), 1e-6)
    allowed[: len(docs)] = STRAY
    allowed[: len(docs), 1:][truth > 0] = 1.0
    allowed[: len(docs), :1] = np.where(none, 1.0, NO_SUBJECT)
    allowed[len(docs) :, 0] = 1.0
    docs = [*docs, *plain]
    tokens, lengths, owner = _encode(docs, terms, frozenset(phrases), frame)
    classes = allowed.shape[1]
    background = (np.bincount(tokens, minlength=len(terms)) + 1.0) / (len(tokens) + len(terms) + 1.0) if terms else np.ones(0)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    resp, rows = share[owner], np.repeat(np.arange(len(lengths)), lengths)
    logp = np.zeros((len(terms), classes))
    for _ in range(ROUNDS):
        for k in range(classes):
            counts = np.bincount(tokens, resp[rows, k], len(terms)) if len(tokens) else np.zeros(len(terms))
            smooth = 20.0
            logp[:, k] = np.log((counts + smooth * background) / (counts.sum() + smooth))
        mix = (_by_doc(resp, owner, len(docs)) + 0.5) * allowed
        mix /= mix.sum(axis=1, keepdims=True)
        resp = _soft(_evidence(tokens, lengths, logp) + np.log(mix + 1e-9)[owner]) if len(owner) else resp
    told = resp[lengths > 0]
    prior = (told.sum(axis=0) + 1.0) / (told.sum() + classes)
    model = Model(subjects, terms, logp, prior, sources, frozenset(phrases), frame)
    model.leading = top_terms(model)
    return model


def encode(model: Model, docs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _encode(docs, model.terms, model.phrases, model.frame)


def describe(model: Model, docs: list[list[list[str]]], encoded: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per document: share of each subject among its topical sentences, and the number of those."""
    tokens, lengths, owner = encode(model, docs) if encoded is None else encoded
    n, classes = len(docs), model.logp.shape[1]
    if not len(owner):
        return np.zeros((n, classes - 1)), np.zeros(n)
    seen = _evidence(tokens, lengths, model.logp)
    mix = np.tile(model.prior, (n, 1))
    for _ in range(4):
        resp = _soft(seen + np.log(mix)[owner])
        mix = _by_doc(resp, owner, n) + 2.0 * model.prior
        mix /= mix.sum(axis=1, keepdims=True)
    pick = (seen + np.log(mix)[owner]).argmax(axis=1)
    hard = np.zeros((len(owner), classes))
    hard[np.arange(len(owner)), pick] = lengths > 0
    counts = _by_doc(hard, owner, n)[:, 1:]
    total = counts.sum(axis=1)
    return counts / np.maximum(total, 1)[:, None], total


#: A label less likely than this under a first fit is held for wrong.
UNLIKELY = 0.3
#: A document treats a subject from this share of its topical sentences on. That is how the task defines it; a labelled sample
#: holds too few documents near the line to learn it, so the side of the line is an input beside the share itself.
TREATED = 0.2
#: Terms that speak for or against each subject most enter the chain themselves.
TOP_TERMS = 6


def top_terms(model: Model) -> np.ndarray:
    """Terms whose likelihood under some subject differs most from that under all others; ``TOP_TERMS`` a subject."""
    if not len(model.logp):
        return np.zeros(0, np.int64)
    lift = model.logp - np.log(np.exp(model.logp).mean(axis=1, keepdims=True))
    weight = np.exp(model.logp) * lift
    return np.unique(np.argsort(-weight[:, 1:], axis=0, kind="stable")[:TOP_TERMS])


def term_features(model: Model, n: int, encoded: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """How often each of the model's leading terms stands in each of ``n`` encoded documents, damped."""
    tokens, lengths, owner = encoded
    out = np.zeros((n, len(model.leading)))
    if len(tokens) and len(model.leading):
        at = np.full(len(model.terms), -1)
        at[model.leading] = np.arange(len(model.leading))
        rows, cols = np.repeat(owner, lengths), at[tokens]
        np.add.at(out, (rows[cols >= 0], cols[cols >= 0]), 1.0)
    return 0.1 * np.log1p(out)


def _features(model: Model, share: np.ndarray, total: np.ndarray, structure: np.ndarray, source: list, j: int, terms: np.ndarray) -> np.ndarray:
    """Inputs of the classifier of subject ``j`` but for the decisions before it: terms, structure and source."""
    s = share[:, j]
    where = np.zeros((len(s), len(model.sources)))
    for i, x in enumerate(source):
        if x in model.sources:
            where[i, model.sources[x]] = 1.0
    rival = np.delete(share, j, axis=1).max(axis=1, initial=0.0)
    treated = s >= TREATED - 1e-9
    both = treated & (rival >= TREATED - 1e-9)
    near = np.tanh((s - TREATED) / 0.05)
    return np.column_stack([np.ones(len(s)), s, near, treated, both, both * s, total > 0, np.log1p(total), structure, 0.3 * where, terms])


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_chain(model: Model, share: np.ndarray, total: np.ndarray, structure: np.ndarray, source: list, truth: np.ndarray, terms: np.ndarray) -> None:
    """Train the chain on four fifths of the documents and calibrate each link on the rest.

    Labels are noisy: a first fit of every subject alone tells how likely each label is, and documents with a label of less
    than ``UNLIKELY`` are left out of the chain's own training.
    """
    sure = np.ones(len(truth), bool)
    for j in range(truth.shape[1]):
        x = _features(model, share, total, structure, source, j, terms)
        z = np.clip(x @ _logistic(x, truth[:, j]), -30, 30)
        sure &= 1 / (1 + np.exp(np.where(truth[:, j] > 0, -z, z))) >= UNLIKELY
    if sure.sum() >= 50:
        share, total, structure, truth, terms = share[sure], total[sure], structure[sure], truth[sure], terms[sure]
        source = [x for x, keep in zip(source, sure) if keep]
    held = np.arange(len(truth)) % 5 == 4
    model.order = list(np.argsort(-truth.sum(axis=0), kind="stable"))
    for n, j in enumerate(model.order):
        x = np.column_stack([_features(model, share, total, structure, source, j, terms), truth[:, model.order[:n]]])
        w = _logistic(x[~held], truth[~held, j])
        score = x[held] @ w
        a, b = 1.0, 0.0
        if 5 <= truth[held, j].sum() <= held.sum() - 5:
            b, a = _logistic(np.column_stack([np.ones(len(score)), score]), truth[held, j], 0.1)
        model.weights.append(w)
        model.scale.append((float(a), float(b)) if a > 0 else (1.0, 0.0))


def decode(model: Model, share: np.ndarray, total: np.ndarray, structure: np.ndarray, source: list, terms: np.ndarray | None = None) -> np.ndarray:
    """Likeliest label combination of every document, by beam search along the chain."""
    n, k = share.shape
    terms = np.zeros((n, len(model.leading))) if terms is None else terms
    beams = [(np.zeros(n), np.zeros((n, 0)))]
    for step, j in enumerate(model.order):
        base, w, (a, b) = _features(model, share, total, structure, source, j, terms), model.weights[step], model.scale[step]
        fixed, tail = base @ w[: base.shape[1]], w[base.shape[1] :]
        grown = []
        for score, labels in beams:
            z = np.clip(a * (fixed + labels @ tail) + b, -30, 30)
            for y, gain in ((0.0, -np.logaddexp(0, z)), (1.0, -np.logaddexp(0, -z))):
                grown.append((score + gain, np.column_stack([labels, np.full(n, y)])))
        scores = np.stack([s for s, _ in grown])
        best = np.argsort(-scores, axis=0, kind="stable")[:BEAM]
        stacked, cols = np.stack([x for _, x in grown]), np.arange(n)
        beams = [(scores[r, cols], stacked[r, cols]) for r in best]
    out = np.zeros((n, k), bool)
    out[:, model.order] = beams[0][1] > 0.5
    return out & (total > 0)[:, None]


def labelled_sample(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> pd.DataFrame:
    """``doc_id, text, source, labels`` of the bounded sample; labels are normalised names, possibly empty (none)."""
    name = F.lower(F.trim(F.regexp_replace("subject", r"[\s ]+", " ")))
    known = labels.select("doc_id", name.alias("s")).where(F.col("s").isin([*map(str.lower, subjects), "none"]) & F.col("doc_id").isNotNull())
    per_doc = known.groupBy("doc_id").agg(F.collect_set("s").alias("labels")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    joined = cut(documents.select("doc_id", "text", "source").where("text is not null").join(F.broadcast(per_doc), "doc_id"), "sample")
    return _bounded(joined, "doc_id", SAMPLE_CHARS).toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)


def _bounded(texts: DataFrame, key: str, chars: int) -> DataFrame:
    """About ``chars`` characters of the texts, chosen by hash of their key; all of them if they are fewer."""
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return texts if size <= chars else texts.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 20)) < F.lit(int((1 << 20) * chars / size)))


def train(documents: DataFrame, labels: DataFrame, subjects: list[str], background: list[str] = ()) -> Model | None:
    """Fit term model and chain on the bounded labelled sample; None if no document is labelled."""
    sample = labelled_sample(documents, labels, subjects)
    if not len(sample):
        return None
    lower = {s.lower(): i for i, s in enumerate(subjects)}
    split = [sentences(t) for t in sample["text"]]
    docs, structure = [s for s, _ in split], np.array([f for _, f in split]).reshape(-1, STRUCTURE)
    truth = np.zeros((len(docs), len(subjects)))
    for i, names in enumerate(sample["labels"]):
        for x in names:
            if x in lower:
                truth[i, lower[x]] = 1.0
    plain = [sentences(t)[0] for t in background]
    common = Counter(x for x in sample["source"] if x)
    sources = {x: i for i, (x, n) in enumerate(sorted(common.items(), key=lambda e: (-e[1], e[0]))[:32]) if n >= 20}
    model = fit_terms(docs, truth, subjects, sources, plain)
    encoded = encode(model, docs)
    share, total = describe(model, docs, encoded)
    fit_chain(model, share, total, structure, list(sample["source"]), truth, term_features(model, len(docs), encoded))
    return model


def classify(documents: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, subject``: one row for every subject of every document."""
    schema = "doc_id bigint, subject string"
    spark = documents.sparkSession
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            split = [sentences(t) for t in pdf["text"]]
            docs = [s for s, _ in split]
            encoded = encode(m, docs)
            share, total = describe(m, docs, encoded)
            found = decode(m, share, total, np.array([f for _, f in split]).reshape(-1, STRUCTURE), list(pdf["source"]), term_features(m, len(docs), encoded))
            d, s = np.nonzero(found)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[d], "subject": np.array(m.subjects, object)[s]})

    texts = documents.select("doc_id", "text", "source").where("doc_id is not null and text is not null and text <> ''")
    return spread(texts).mapInPandas(run, schema)


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """Train on the labels and classify all documents. ``subjects`` is a small fixed table; of ``background`` at most about
    ``BACKGROUND_CHARS`` characters take part in the training."""
    names = [r.subject for r in subjects.select("subject").where("subject is not null").distinct().orderBy("subject").collect()]
    plain = []
    if background is not None:
        plain = [r.text for r in _bounded(background.select("text").where("text is not null").distinct(), "text", BACKGROUND_CHARS).orderBy("text").collect()]
    return classify(documents, train(documents, labels, names, plain))
