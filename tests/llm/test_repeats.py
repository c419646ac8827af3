import hashlib
import random
from collections import Counter

import duckdb
import pytest

from loam.llm import repeats as R


def words_of(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [x for x in text.split(" ") if x]


def brute(texts, window):
    docs = [words_of(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window,chunk", [(35, 1 << 20), (6, 300), (5, 50), (1, 200)])
def test_brute_force(spark, monkeypatch, window, chunk):
    monkeypatch.setattr(R, "CHUNK_BYTES", chunk)
    rng = random.Random(window)
    say = lambda n: " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(n))
    shared = [say(window + d) for d in (-1, 0, 1, 40)]
    texts = [None, "", " \t\n", "one", shared[1], shared[1], f"{shared[3]}\n{shared[3]}", "x " * 3000, "x y \x1cz"]
    texts += [f"{say(rng.randint(0, 30))} {rng.choice(shared)}\t{say(rng.randint(0, 30))}" for _ in range(40)]
    rows = [(None if i == 5 else i, t, "clash", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, chunk string, n_words int").repartition(3)
    got = {r.doc_id: r for r in R.remove_repeats(docs, window).collect()}
    assert len(got) == len(texts)
    for (key, *_), want in zip(rows, brute(texts, window)):
        r = got[key]
        assert (r.n_words, sum(s.end - s.start for s in r.spans), r.kept_text) == want
    assert R.remove_repeats(docs.limit(0), window).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = [(d.doc_id, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, (n, g, k) in zip(docs, brute([d.text for d in docs], 35))]
    assert sorted(map(tuple, R.op10_repeats(spark, sf).collect())) == sorted(want)
    assert sorted(db.execute(R.ORACLE_SQL["op10_repeats"]).fetchall()) == sorted(want)


@pytest.mark.parametrize("window", [5, 35])
def test_sequences_that_collide_under_powers_of_a_base(spark, window):
    """A Thue-Morse word and its complement, as letters of one word and as words."""
    letters = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    other = letters.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(window - 1))
    texts = [f"{rest} {letters}", f"{rest} {other}", " ".join(letters), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for seed in (None, 0, 1):
        got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r.kept_text) for r in R.remove_repeats(docs, window, seed=seed).collect()}
        assert got == dict(enumerate(brute(texts, window)))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 18, 35])
def test_hashes_of_sequences(size):
    rng = random.Random(size)
    words = [rng.choice("ab") for _ in range(400)]
    h = R._sequences(R.np.array([1 << 63 if w == "a" else 2 for w in words], R.np.uint64), size, 0x9E3779B97F4A7C15)
    of = {}
    for i in range(len(words) - size + 1):
        of.setdefault(tuple(words[i : i + size]), set()).add(int(h[i]))
    assert len(h) == len(words) - size + 1 and all(len(x) == 1 for x in of.values()) and len(set.union(*of.values())) == len(of)
