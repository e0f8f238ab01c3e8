import random

import pytest

from graphloom.llm.handwritten import foreign_files, profile
from graphloom.llm.nearcopies import Hasher, band_keys, near_links, shingles

SCHEMA = "path string, repo string, text string, extra int"
NOUNS = "token route shard cursor ledger bucket widget anchor palette queue digest margin voucher record".split()


def function(r):
    a, b, c = (r.choice(NOUNS) for _ in range(3))
    return r.choice(
        [
            f"export function {a}{b.title()}({c}) {{\n  if (!{c}) throw new Error('no {a}');\n  return {b}({c}, {r.randrange(99)});\n}}\n",
            f"export function {b}{c.title()}({a}) {{\n  return {a}.filter(x => x.{b}).map(x => {c}(x, {r.randrange(99)}));\n}}\n",
            f"export function {c}Of({a}) {{\n  const {b} = walk({a});\n  return {b} > {r.randrange(99)} ? {c}({b}) : {b};\n}}\n",
        ]
    )


def by_hand(seed, n=8):
    r = random.Random(seed)
    return "import { x } from './x';\n\n" + "\n".join(function(r) for _ in range(n))


def generated(seed):
    r = random.Random(seed)
    return "class T(object):\n" + "".join(f"  def _get_{(w := r.choice(NOUNS))}{i}(self):\n    return self._fields[{i}]\n  def _set_{w}{i}(self, v):\n    self._fields[{i}] = v\n" for i in range(30))


def test_kinds(spark):
    r = random.Random(1)
    blob = "DATA = [\n" + "".join("  " + ", ".join(f"0x{r.randrange(256):02x}" for _ in range(12)) + ",\n" for _ in range(30)) + "]\n"
    packed = "".join(f"function {r.choice('abcdef')}(a,b){{return a?b.x{r.randrange(9)}(a):void 0}}" for _ in range(60))
    shared = by_hand(77, 12)
    data = [(f"/r/app/hand{i}.js", f"r{i % 3}", by_hand(i), 0) for i in range(12)]
    data += [(f"/r/app/gen{i}.py", "r1", generated(i), 0) for i in range(3)]
    data += [("/r/app/blob.py", "r1", blob, 0), ("/r/app/packed.js", "r2", packed, 0)]
    data += [("/a/lib/one.js", "r1", shared, 0), ("/b/lib/two.js", "r2", "// a note\n" + shared, 0), ("/c/lib/origin.js", "r0", "// tape - version 4.1\n" + by_hand(500), 0)]
    data += [("/c/vendor/tape/x.js", "r0", by_hand(501), 0), ("/c/vendors/x.js", "r0", by_hand(502), 0), ("/c/third_party_test.js", "r0", "// Do not edit generated files by hand.\n" + by_hand(503), 0)]
    data += [("/n/null.js", "r0", None, 0), ("/n/empty.js", None, "", 0), (None, "r0", "x = 1", 0), ("/r/app/gen0.py", "r1", generated(0), 1)]
    got = {}
    for x in foreign_files(spark.createDataFrame(data, SCHEMA)).collect():
        got.setdefault(x.path, set()).add(x.reason)
    assert got == {
        **{f"/r/app/gen{i}.py": {"generated"} for i in range(3)}, "/r/app/blob.py": {"data"}, "/r/app/packed.js": {"minified"},
        "/a/lib/one.js": {"vendored"}, "/b/lib/two.js": {"vendored"}, "/c/lib/origin.js": {"vendored"}, "/c/vendor/tape/x.js": {"vendored"},
    }


def test_empty(spark):
    assert foreign_files(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text():
    p = profile("x = [" + "1, " * 200_000 + "]\n", Hasher())
    assert p["literal"] > 0.4 and len(band_keys(p["written"], 4, 4)) == 4


def test_long_literals_are_compared_whole(spark):
    def messages(seed, mark, digit):
        r = random.Random(seed)
        text = mark + "the same beginning " * 4 + digit + " and the same end" * 2 + mark
        return "".join(f"export function {r.choice(NOUNS)}{i}({r.choice(NOUNS)}) {{ {r.choice(NOUNS)}.{r.choice(NOUNS)}({text}); }}\n" for i in range(12))

    data = [("/a/equal.js", "r1", messages(9, "`", "4"), 0), ("/b/equal.js", "r2", messages(9, "`", "4"), 0)]
    for i, mark in enumerate(('"', "'", "`", '"""', "'''")):
        data += [(f"/a/other{i}.js", "r1", messages(i, mark, "4"), 0), (f"/b/other{i}.js", "r2", messages(i, mark, "7"), 0)]
    found = foreign_files(spark.createDataFrame(data, SCHEMA)).where("reason = 'vendored'")
    assert sorted(x.path for x in found.collect()) == ["/a/equal.js", "/b/equal.js"]


def test_long_numbers_are_compared_whole():
    a, b = ("x = " + "1" * 60 + d + "1" * 60 + "\n" for d in "27")
    assert profile(a, Hasher())["written"].tolist() != profile(b, Hasher())["written"].tolist()


def test_members_of_different_centres_are_compared(spark):
    sets = {"1": range(0, 100), "2": range(30, 130), "3": range(10, 110), "4": range(20, 120), "5": range(500, 600)}
    rows = [(k, list(s), [7]) for k, s in sets.items()]
    got = near_links(spark.createDataFrame(rows, "id string, shingles array<bigint>, bands array<bigint>"))
    assert sorted(map(tuple, got.distinct().collect())) == [("1", "3"), ("2", "4"), ("3", "4")]


@pytest.mark.parametrize("seed", range(2))
def test_links_against_brute_force(spark, seed):
    r = random.Random(seed)
    h = Hasher()
    sets = {}
    for i in range(30):
        base = [r.choice(NOUNS) + str(r.randrange(40)) for _ in range(80)]
        for j in range(r.randrange(1, 4)):
            t = list(base)
            for _ in range(r.randrange(0, 5)):
                t[r.randrange(80)] = "changed" + str(r.randrange(9))
            sets[f"s{i:02d}-{j}"] = shingles(h(t))
    keys = {tuple(v): k for k, v in sorted(sets.items(), reverse=True)}
    rows = [(k, list(map(int, s)), list(map(int, band_keys(sets[k], 64, 4)))) for s, k in keys.items()]
    got = {(x.u, x.v) for x in near_links(spark.createDataFrame(rows, "id string, shingles array<bigint>, bands array<bigint>")).collect()}
    jac = lambda a, b: len(a & b) / len(a | b)
    all_ = {k: set(s) for s, k in keys.items()}
    near = {(a, b) for a in all_ for b in all_ if a < b and jac(all_[a], all_[b]) >= 0.8}
    assert got <= near
    def groups(pairs):
        root = {k: k for k in all_}
        for _ in all_:
            for a, b in pairs:
                m = min(root[a], root[b])
                root[a] = root[b] = m
        return root
    assert groups(got) == groups(near)
