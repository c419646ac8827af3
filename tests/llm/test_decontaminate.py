import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm import decontaminate as D


def brute(pattern, text):
    """(least distance of an occurrence, the first end that has it)."""
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for end, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, (row[-1], end))
    return best


@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=120), st.integers(0, 20))
@settings(max_examples=300, deadline=None)
def test_myers(pattern, text, most):
    want = brute(pattern, text)
    got = D.myers(pattern, text, most)
    if want[1] == 0:  # an empty occurrence is no occurrence
        assert got is None or got[0] >= want[0]
    else:
        assert got == (want if want[0] <= most else None)


def test_matches_equal_brute_force():
    rng = random.Random(1)
    say = lambda n: " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(n))
    items = [(i, say(rng.randint(4, 30))) for i in range(12)] + [(99, None), (98, " ?! "), (97, "")]
    tests = D.Tests(items, 0.1)
    for _ in range(60):
        part = list(D.normalised(rng.choice(items[:12])[1]))
        for _ in range(rng.randint(0, len(part) // 6)):
            part[rng.randrange(len(part))] = rng.choice(["", "x", "a ", "q"])
        text = D.normalised(say(10) + " " + "".join(part) + " " + say(10))
        want = {}
        for i, t in items[:12]:
            p = D.normalised(t)
            d, _ = brute(p, text)
            if d <= int(0.1 * len(p)):
                want[i] = d
        assert {m["item_id"]: m["distance"] for m in tests.matches(text)} == want


def test_query(spark, sf):
    got = {(r.doc_id, r.item_id) for r in D.op7_decontaminate(spark, sf).collect()}
    docs = {r.doc_id: D.normalised(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: D.normalised(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert got >= {(d, i) for d, t in docs.items() for i, p in items.items() if p in t}
    assert got


def test_edge_cases(spark):
    tests = spark.createDataFrame([(1, "What is the capital city of this far country?", 5), (2, None, 5), (3, "", 5), (3, "Whát else", 5), (3, "whát ELSE", 5)], "item_id bigint, text string, doc_id int")
    rows = [(1, "so: what is the capitol city, of this far country"), (1, "so: what is the capitol city, of this far country"), (2, None), (3, ""), (None, "x " * 60_000 + "whát   else"), (5, "What is the point of this country?")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, item_id int")
    left = D.decontaminate(docs, tests)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 5]
    assert D.decontaminate(docs, tests.limit(0)).count() == len(rows) and D.decontaminate(docs.limit(0), tests).count() == 0
    from pyspark.sql import functions as F

    small = docs.select("doc_id", F.size(D.occurrences(F.col("text"), tests, part_bytes=1)).alias("n")).collect()
    assert sorted(((r.doc_id or 0), r.n) for r in small) == [(0, 2), (1, 1), (1, 1), (2, 0), (3, 0), (5, 0)]


def test_parts(spark):
    """Six items in six parts: the same rows as in one part."""
    words = "one two three four five six".split()
    tests = spark.createDataFrame([(i, f"the sentence number {w} of this small test of six sentences") for i, w in enumerate(words)], "item_id int, text string").coalesce(1)
    rows = [(i, f"so: the sentense, number {w}, of this small test of six sentences!" if i % 2 else f"{w} is a number") for i, w in enumerate(words * 3)] + [(98, None), (99, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, match string")
    one, six = (sorted((r.doc_id, r.match.item_id, r.match.distance) for r in D.found(docs, tests, part_bytes=n).collect()) for n in (1 << 20, 1))
    assert one == six and {(d, i) for d, i, _ in one} == {(d, d % 6) for d in range(1, 18, 2)}
    for n in (1 << 20, 1):
        left = D.decontaminate(docs, tests, part_bytes=n)
        assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [*range(0, 18, 2), 98, 99]


def test_an_automaton_is_made_once(monkeypatch):
    made = []
    monkeypatch.setattr(D, "Tests", lambda items, rate: made.append(items) or len(made))
    for _ in range(10):
        for part in range(6):
            D._tests("run", part, lambda part=part: part, 0.05)
    assert made == list(range(6))
    D._tests("other", 0, lambda: 9, 0.05)
    assert list(D._made) == ["other"]


def test_short_items_stand_as_whole_words():
    tests = D.Tests([(1, "no"), (2, "new york")], 0.05)
    ids = lambda t: [m["item_id"] for m in tests.matches(t)]
    assert ids("I know another one") == [] and ids("No!") == [1] and ids("yes, no") == [1] and ids("anew york. no") == [1] and ids("New-York, new yorker") == [2]


def test_query_equals_brute_force(spark, sf):
    """Every document against every item by the full table of distances, all items at a time."""
    import numpy as np

    rows = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    items = [(r.item_id, D.normalised(r.text)) for r in rows if D.normalised(r.text)]
    rng = random.Random(3)
    texts = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()[:60]:
        words = (r.text or "").split()[:80]
        part = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 3)):
            part[rng.randrange(len(part))] = rng.choice(["", "x", "ab"])
        texts.append((r.doc_id, " ".join([*words[:40], "".join(part), *words[40:]]) if r.doc_id % 2 else " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    tests = spark.createDataFrame([(r.item_id, r.text) for r in rows], "item_id bigint, text string")
    got = {(r.doc_id, r.match.item_id): r.match.distance for r in D.found(docs, tests).collect()}
    size = np.array([len(t) for _, t in items])
    letters = np.full((len(items), size.max()), -1)
    for i, (_, t) in enumerate(items):
        letters[i, : len(t)] = [ord(c) for c in t]
    up, want = np.arange(size.max() + 1), {}
    for key, text in texts:
        row, best = np.tile(up, (len(items), 1)), size.copy()
        for c in D.normalised(text):
            new = np.zeros_like(row)
            new[:, 1:] = np.minimum(row[:, :-1] + (letters != ord(c)), row[:, 1:] + 1)
            row = np.minimum.accumulate(new - up, axis=1) + up
            best = np.minimum(best, row[np.arange(len(items)), size])
        want |= {(key, items[i][0]): int(d) for i, d in enumerate(best) if d <= int(0.05 * size[i]) and size[i] >= 20}
    assert {k: v for k, v in got.items() if len(dict(items)[k[1]]) >= 20} == want and len(want) > 20
