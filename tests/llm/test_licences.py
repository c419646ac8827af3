import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm import licences as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for p, label in L.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=8), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_statistics(sequences, words):
    a = L.Automaton(sequences)
    subs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for end, (n, s) in enumerate(a.statistics(words), 1):
        assert n == max((k for k in range(end + 1) if k == 0 or tuple(words[end - k : end]) in subs))
        if n:
            own = words[end - n : end]
            assert a.ends[s] == {(i, j) for i, x in enumerate(sequences) for j in range(n, len(x) + 1) if x[j - n : j] == own}


def test_base_places_equal_brute_force():
    scanner = L.Scanner(L.PHRASES, L.TEMPLATES, 3, 4, 0.8)
    for text in (None, "", "Under the MIT License", "cc-by-nc cc by cc by nc nc", "Apache License, Version 2.0 apache license version 20", "under the mit license " * 3000, "x\x00under the\nmit licensé under_the-mit license", "É " * 10):
        got = scanner.scan(text.encode() if text is not None else None)
        starts = [x["start"] for x in got["base"]]
        assert (got["n_words"], len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x["label"] for x in got["base"]}))) == brute(text)


def test_spans():
    scanner = L.Scanner(L.PHRASES, L.TEMPLATES, 3, 4, 0.8)
    labels = lambda t: [x["label"] for x in scanner.scan(t.encode())["spans"]]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3"]
    assert labels("This work is licensed under the terms of the GNU General Public License version 2 only") == ["gpl-2"]
    assert labels("word " * 50 + "this work is, of course, licensed under the gnu general public license version 3 " + "word " * 9) == ["gpl-3"]
    assert labels("the general public license of this work is") == []
    assert labels("Released under the MIT License. Licensed under CC BY-NC 4.0.") == ["mit", "cc-by-nc"]
    assert L.Scanner([], [], 3, 4, 0.8).scan(b"under the mit license")["spans"] == []


def test_query(spark, sf):
    got = L.op9_licences(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert ("GNU General Public License" in docs[r.doc_id]) == ("gpl-3" in r.labels)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "c"), (1, "", "c"), (None, "cc by nc", "c"), (None, "cc by nc", "c")], "doc_id bigint, text string, s string")
    assert sorted((r.doc_id or 0, r.f.n_words, len(r.f.base)) for r in docs.select("doc_id", L.scan(L.F.col("text")).alias("f")).collect()) == [(0, 3, 1), (0, 3, 1), (1, 0, 0), (1, 0, 0)]
    assert docs.limit(0).select(L.scan(L.F.col("text"))).count() == 0


def test_whole_texts_headers_and_altered_copies():
    scanner = L.Scanner(L.PHRASES, L.TEMPLATES, 3, 4, 0.8)
    spans = lambda t: [(x["label"], x["start"], x["end"]) for x in scanner.scan(t.encode())["spans"]]
    rng = random.Random(1)
    for text, label in L.HEADERS + L.BODIES:
        words = [w.decode() for w in L.words_of(text.encode())]
        n = len(words)
        assert spans("before it " + text + " behind it") == [(label, 2, n + 2)]
        altered = [w if rng.random() > 0.03 else "changed" for w in words]
        (found,) = spans(" ".join(altered))
        assert found[0] == label and found[2] - found[1] > 0.8 * n
        assert label not in [x[0] for x in spans(" ".join(rng.sample(words, n)))]
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details."""
    assert [x[0] for x in spans(gpl)] == ["gpl-3"] and [x[0] for x in spans(gpl.replace("version 3", "version 2"))] == ["gpl-2"]


def brute_spans(words, templates, least, gap, covered):
    """Of every chain of matches the one with the most words that ends at each place: a plain programme over all pairs of equal stretches."""
    good = []
    for i, (t, _) in enumerate(templates):
        hits = []  # maximal to the left and right as the longest of any template
        for end in range(1, len(words) + 1):
            longest = max((k for k in range(end + 1) if any(words[end - k : end] == x[j : j + k] for x, _ in templates for j in range(len(x) - k + 1))), default=0)
            after = max((k for k in range(end + 2) if end < len(words) and any(words[end + 1 - k : end + 1] == x[j : j + k] for x, _ in templates for j in range(len(x) - k + 1))), default=0)
            if longest >= least and (end == len(words) or after <= longest):
                hits += [(end - longest, end, j + longest, longest) for j in range(len(t) - longest + 1) if words[end - longest : end] == t[j : j + longest]]
        chains = []
        for start, end, at, n in hits:
            best = n
            for (s2, e2, a2, _), f in zip(hits, chains):
                if e2 < end and a2 < at and start <= e2 + gap:
                    best = max(best, f + min(n, at - a2, end - e2))
            chains.append(best)
        good += [f for f in chains if f >= covered * len(t)]
    return max(good, default=0)


@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=3, max_size=12), min_size=1, max_size=3), st.lists(st.sampled_from("abcdx"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_chains_equal_brute_force(templates, words):
    given_ = [(t, f"l{i}") for i, t in enumerate(templates)]
    scanner = L.Scanner([], [(" ".join(t), label) for t, label in given_], 2, 3, 0.6)
    got = scanner.scan(" ".join(words).encode())["spans"]
    want = brute_spans(words, given_, 2, 3, 0.6)
    most = max((round(x["covered"] * len(templates[int(x["label"][1:])])) for x in got), default=0)
    assert most == min(want, max((len(t) for t in templates), default=0)) or most == want
    assert all(a["end"] <= b["start"] for a, b in zip(got, got[1:]))


def test_a_better_start_that_comes_later():
    """The chain of the whole template, though its first words stand earlier too, with others of its words behind them."""
    words = "a b c d e f g h i j k l".split()
    scanner = L.Scanner([], [(" ".join(words), "x")], 3, 4, 0.8)
    text = "a b c x g h i " + " ".join(words)
    assert [(x["start"], x["end"], x["covered"]) for x in scanner.scan(text.encode())["spans"]] == [(7, 19, 1.0)]


def test_long_texts_of_licence_words():
    import time

    scanner = L.Scanner(L.PHRASES, L.TEMPLATES, 3, 4, 0.8)
    began = time.perf_counter()
    assert scanner.scan(b"of this license " * 30_000 + b"to the extent permitted by applicable law " * 10_000)["spans"] == []
    assert len(scanner.scan(b"released under the mit license " * 5_000)["spans"]) == 5_000
    assert time.perf_counter() - began < 60
