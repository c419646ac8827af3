from collections import Counter

import corpus_pipeline as P
from loam.llm.decontaminate import normalised
from loam.llm.langid import letters


def test_whole_pipeline(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [normalised(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = P.run(spark, sf).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "shard"}
    times = Counter(r.doc_id for r in rows)
    assert set(times.values()) <= {1, 2} and all(r.text == docs[r.doc_id].text and 0 <= r.shard < 16 for r in rows)
    leaked = {i for i, d in docs.items() if any(x in normalised(d.text) for x in items)}
    assert leaked and not leaked & set(times)
    texts = Counter(docs[i].text.lower().split().__str__() for i in times)
    assert max(texts.values()) == 1
    assert all(letters(r.text).strip() for r in rows)
    # what isn't an exact copy, a leak or similar to anything stays
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, d in docs.items() if (w := d.text.lower().split())}
    similar = lambda a, b: len(a & b) / len(a | b) > 0.3
    alone = [i for i in shingles if i not in leaked and not any(j != i and similar(shingles[i], shingles[j]) for j in shingles)]
    assert sum(i not in times for i in alone) <= 2 and len(alone) > 100


def test_stages_keep_columns(spark, sf):
    docs = spark.createDataFrame([(1, "some text of words here", None, None, 1, "clash", 2), (None, None, "en", "s", 0, "x", 3), (1, "some text of words here", None, None, 1, "clash", 2)], "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, epoch int")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert sorted(P.shards(spark, docs, sf).columns) == sorted(docs.columns)


def least_distances(items, text):
    """The least edit distance of each item to any stretch of the text, by the full table, all items at a time."""
    import numpy as np

    size = np.array([len(t) for t in items])
    letters = np.full((len(items), size.max()), -1)
    for i, t in enumerate(items):
        letters[i, : len(t)] = [ord(c) for c in t]
    up = np.arange(size.max() + 1)
    row, best = np.tile(up, (len(items), 1)), size.copy()
    for c in text:
        new = np.zeros_like(row)
        new[:, 1:] = np.minimum(row[:, :-1] + (letters != ord(c)), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - up, axis=1) + up
        best = np.minimum(best, row[np.arange(len(items)), size])
    return best


def draw(*parts):
    import hashlib

    return int(hashlib.md5("|".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def mixed_by_hand(docs, most):
    """How often each id is in the mix that passes over every source once at least, with none repeated over `most` times."""
    import math

    blocks = {}
    for d in docs:
        blocks.setdefault(d["source"], {}).setdefault(draw(0, d["doc_id"]) % 1024, []).append(d)
    words = lambda rows: sum(len(d["text"].split()) for d in rows)
    tokens = {s: sum(map(words, b.values())) for s, b in blocks.items()}
    total, large, small = sum(tokens.values()), max(tokens.values()), min(tokens.values())
    alpha = 0.0 if large <= most * small else 1 - math.log(most) / math.log(large / small)
    z = sum((n / total) ** alpha for n in tokens.values())
    budget = (large / total) ** (1 - alpha) * total * z
    times = Counter()
    for s, n in tokens.items():
        target = (n / total) ** alpha / z * budget
        passes = math.floor(target / n + 1e-9)
        rest = max(0.0, target - passes * n)
        for d in (d for b in blocks[s].values() for d in b):
            times[d["doc_id"]] += passes
        used = 0
        for block in sorted(blocks[s], key=lambda b: (draw(0, "block", passes, s, b), b)):
            size = words(blocks[s][block])
            if not size:
                continue
            if used + size > rest:
                for d in sorted(blocks[s][block], key=lambda d: draw(0, "document", passes, d["doc_id"])):
                    used += words([d])
                    if used > rest:
                        break
                    times[d["doc_id"]] += 1
                break
            used += size
            for d in blocks[s][block]:
                times[d["doc_id"]] += 1
    return times


def jump(key, shards):
    """As published."""
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_pipeline_equals_brute_force(spark, sf, tmp_path):
    """Short documents of the table with planted copies, near copies, leaks, ties and letterless texts, each stage by hand."""
    import random

    from loam.llm.langid import Encoders, held_out, learn

    rng = random.Random(8)
    source = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect() if r.text and 0 < r.n_chars < 900][:70]
    bench = [r.asDict() for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()][:40]
    plant = lambda text, like: source.append({**like, "doc_id": 100_000 + len(source), "text": text, "n_chars": len(text)})
    for d in [d for d in source if len(d["text"].split()) > 60][:10]:
        words = d["text"].split()
        plant(d["text"].encode().upper().decode(), d)  # A-Z only
        plant(" ".join(words[:-2] + ["other", "end"]), d)  # near
        plant(" ".join(words[: len(words) // 2] + [rng.choice(words) for _ in words]), d)  # not near
        item = list(rng.choice(bench)["text"])
        item[len(item) // 2] = "%"
        plant(" ".join(words[::-1][:30]) + " " + "".join(item) + " behind it", d)
    for text in ("", "12 + 3 = 15", "..."):
        plant(text, source[0])
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    spark.createDataFrame([tuple(d[c] for c in schema.names) for d in source], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(b["item_id"], b["text"]) for b in bench], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    encoders = Encoders(learn(spark.read.parquet(f"{tmp_path}/documents.parquet").where(~held_out())))
    left = [d for d in source if not encoders.predict(d["text"], 0.01)[2]]
    sets = {}
    for d in left:
        w = d["text"].encode().lower().split()
        sets[d["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if x == high else x for k, x in root.items()}
    left = [d for d in left if root[d["doc_id"]] == d["doc_id"]]
    items = [t for b in bench if (t := normalised(b["text"]))]
    assert min(map(len, items)) >= 20
    left = [d for d in left if not any(x <= int(0.05 * len(t)) for x, t in zip(least_distances(items, normalised(d["text"])), items))]
    times = mixed_by_hand(left, 2.0)
    want = Counter({(i, jump(i, 16)): n for i, n in times.items() if n})
    got = Counter((r.doc_id, r.shard) for r in P.run(spark, str(tmp_path)).collect())
    assert got == want and 40 < len(want) < len(source) - 25
