import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loam.llm import simhash as S


def brute_fingerprint(text, k=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, codes, radius=2):
    root = list(range(len(ids)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(ids)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


@given(st.one_of(st.none(), st.text(max_size=80), st.text("aA éB\t\n\x1c\xa0", max_size=60)))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert S.text_fingerprint(None if text is None else text.encode(), 3, 42) % (1 << 64) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_forest_finds_every_link(radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    codes = {int(c) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for c in centres for _ in range(120)}
    codes = np.array(sorted(codes), np.uint64)
    runs = (codes % 3).astype(np.int64)
    order = np.lexsort((S.gray_rank(codes), runs))
    codes, runs = codes[order], runs[order]
    got = set(zip(*[x.tolist() for x in S.GrayForest(codes[:, None], runs).pairs(np.arange(len(codes)), runs, radius)]))
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if runs[i] == runs[j] and int(codes[i] ^ codes[j]).bit_count() <= radius}
    assert got == want


def test_masks_share_a_pattern():
    for m in (S.masks(2, 6), S.masks(2, 4), S.masks(3, 5)):
        rng = np.random.default_rng(0)
        for _ in range(500):
            flips = [1 << int(b) for b in rng.integers(0, 64, 2)]
            assert any(all(not f & x for f in flips) for x in m)


def test_components_match_brute_force(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, base + f" {i % 40} tail {'word ' * (i % 7)}") for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t"), (203, "a"), (204, "a"), (205, "A b"), (207, "x" * 50_000), (207, "x" * 50_000), (300, base * 400), (301, base * 400 + " more")]
    docs = spark.createDataFrame([(i, t, "clash", -i) for i, t in rows], "doc_id bigint, text string, code string, component_id bigint")
    got = sorted((r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in S.near_duplicates(docs).collect())
    codes = [brute_fingerprint(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], codes, brute_components([i for i, _ in rows], codes)))
    assert got == want
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    codes = [brute_fingerprint(t) for _, t in docs]
    want = sorted(zip([i for i, _ in docs], [f"{c:016x}" for c in codes], brute_components([i for i, _ in docs], codes)))
    assert sorted(map(tuple, S.op4_simhash(spark, sf).collect())) == want


def near_copies(n, rng):
    """Texts with copies in which some words differ, and the word sets' similarities."""
    say = lambda k: [f"w{rng.integers(5000)}" for _ in range(k)]
    rows, similar = [], []
    for i in range(n):
        own = say(200)
        rows.append((3 * i, " ".join(own)))
        for j, edits in ((1, 2), (2, int(rng.integers(40, 60)))):
            other = list(own)
            for at in rng.choice(200, edits, replace=False):
                other[at] = "new"
            rows.append((3 * i + j, " ".join(other)))
            a, b = ({tuple(x[k : k + 5]) for k in range(196)} for x in (own, other))
            similar.append((3 * i + j, len(a & b) / len(a | b)))
    return rows, similar


@pytest.mark.parametrize("crowd", [4096, 3])
def test_near_copies_go(spark, monkeypatch, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)
    rows, similar = near_copies(60, np.random.default_rng(3))
    left = {r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(3 * i in left for i in range(60))
    near, far = [i for i, x in similar if x >= 0.8], [i for i, x in similar if x < 0.4]
    assert len(near) >= 50 and sum(i in left for i in near) <= 1
    assert len(far) >= 50 and all(i in left for i in far)


def test_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a b c", "y"), (3, "other words here", "z"), (None, "a b c", "n")], "doc_id bigint, text string, root string")
    assert sorted((r.doc_id or 0, r.root) for r in S.keep_one(docs).collect()) == [(0, "n"), (1, "x"), (3, "z")]


def jaccard(a, b, k=5):
    a, b = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_a_shared_repeated_line_makes_no_copies(spark):
    rng = np.random.default_rng(5)
    line = " ".join(f"line{i}" for i in range(10))
    texts = [" ".join([line] * int(rng.integers(10, 40)) + [f"w{rng.integers(10**6)}" for _ in range(100)]) for _ in range(30)]
    copies = [" ".join([line] * 40 + x.split(line + " ")[-1].split()) for x in texts]  # the same sets, with the line more often
    assert max(jaccard(texts[0], x) for x in texts[1:]) < 0.2 and min(map(jaccard, texts, copies)) == 1
    rows = list(enumerate(texts + copies))
    left = {r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert left == set(range(30))


@pytest.mark.parametrize("group", [2048, 3])
def test_confirmed_edges_connect_as_all_pairs(spark, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)
    rng = np.random.default_rng(6)
    rows = []
    for c in range(4):  # copies of one another, and chains in which each step is near the threshold
        words = [f"c{c}w{i}" for i in range(200)]
        for _ in range(12):
            words = list(words)
            for at in rng.choice(200, int(rng.integers(1, 9)), replace=False):
                words[at] = f"x{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(words)))
    nodes = spark.createDataFrame([(i, i // 12 * 12) for i, _ in rows if i % 12], "node bigint, root bigint")
    docs = spark.createDataFrame(rows + rows[:3], "id bigint, text string")
    root = {r.node: r.root for r in S.components(S.confirmed_links(docs, nodes, 5, 256, 0.8)).collect()}
    want = list(range(len(rows)))
    for i, a in rows:
        for j, b in rows[:i]:
            if jaccard(a, b) >= 0.8 and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if x == high else x for x in want]
    assert [root.get(i, i) for i in range(len(rows))] == want and 4 < len(set(want)) < len(rows)


def test_pairs_near_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows, pairs = [], []
    for i in range(200):  # words other from some place on: a similarity of (200 - n) / (200 + n)
        own = [f"w{rng.integers(10**6)}" for _ in range(204)]
        n = int(rng.choice([21, 22, 23, 24, 28]))
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:-n] + [f"w{rng.integers(10**6)}" for _ in range(n)]))]
        pairs.append((2 * i + 1, jaccard(rows[-2][1], rows[-1][1])))
    left = {r.doc_id for r in S.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    near, far = [i for i, x in pairs if x >= 0.8], [i for i, x in pairs if x < 0.8]
    assert min(len(near), len(far)) >= 40
    assert sum(i in left for i in near) <= 1 and all(i in left for i in far)


def test_main_class():
    assert S.main_class([0b1, 0b10, 0b11, 0b100, 0], [5, 2, 1, 7, 50]) == 0b11
    assert S.main_class([0b1, 0b100], [3, 4]) == 0b100 and S.main_class([0b1, 0b10], [4, 4]) == 0b1 and S.main_class([0], [9]) == 0


@pytest.mark.parametrize("similarity", [0.8, None])
def test_star_links_connect_as_all_pairs(spark, monkeypatch, similarity):
    """Two large groups, of copies and of chains, against all pairs: of sets, and of codes alone."""
    monkeypatch.setattr(S, "GROUP", 7)
    rng = np.random.default_rng(20)
    rows = []
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(150)]
        for i in range(60):
            words = list(base)
            if i % 5 == 4:  # a step further than the last of its kind
                base2 = words = list(rows[-5][2] if i > 4 and g else base)
                for at in rng.choice(150, 5, replace=False):
                    base2[at] = f"x{rng.integers(10**6)}"
            else:
                words[int(rng.integers(150))] = f"y{rng.integers(10**6)}"
            rows.append((g, len(rows), words))
    rows += [(0, 1000 + i, [f"alone{i}w{k}" for k in range(150)]) for i in range(20)]
    sets = {i: S.shingle_set(" ".join(w).encode(), 5, 42) for _, i, w in rows}
    codes = {i: S.wide_fingerprint(x) for i, x in sets.items()}
    schema = "root bigint, node bigint, code binary" + ", shingles binary" * (similarity is not None)
    data = [(g, i, bytearray(codes[i]), bytearray(sets[i].tobytes()))[: 4 if similarity else 3] for g, i, _ in rows]
    df = spark.createDataFrame(data, schema)
    large = spark.createDataFrame([(0, 5), (1, 3)], "root bigint, m int")
    radius = 56 if similarity else 30
    got = {r.node: r.root for r in S.components(S.star_links(df, large, ["root"], radius, similarity)).collect()}
    far = lambda a, b: (int.from_bytes(codes[a], "big") ^ int.from_bytes(codes[b], "big")).bit_count()
    near = lambda a, b: far(a, b) <= radius and (similarity is None or len(np.intersect1d(sets[a], sets[b])) >= similarity * len(np.union1d(sets[a], sets[b])))
    want = {i: i for _, i, _ in rows}
    for g, i, _ in rows:
        for h, j, _ in rows:
            if j < i and g == h and want[i] != want[j] and near(i, j):
                low, high = sorted((want[i], want[j]))
                want = {k: low if x == high else x for k, x in want.items()}
    assert {i: got.get(i, i) for i in want} == want and len(set(want.values())) >= 22
