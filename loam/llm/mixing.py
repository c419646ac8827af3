"""Mixing sources to target weights by temperature, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.common import table

#: Halvings of the exponent's interval; 60 leave less than a double tells apart.
HALVINGS = 60


def n_tokens(text: Column) -> Column:
    """Words of a text: runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _draw(*parts: Column) -> Column:
    """A pseudo-random number below 2^60, from the parts' text alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 15), 16, 10).cast("long")


def _mean(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + f(x))


def _exponent(sizes: Column, budget: Column | None, entropy: float | None, repeats: float | None, most: float) -> Column:
    """The smallest exponent in 0..most whose entropy or largest repetition isn't above the target; both fall as it grows."""

    def measure(alpha: Column) -> Column:
        if entropy is not None:
            z = _mean(sizes, lambda x: F.pow(x, alpha))
            return F.log(z) - alpha * _mean(sizes, lambda x: F.pow(x, alpha) * F.log(x)) / z
        if budget is None:
            return F.pow(F.array_max(sizes) / F.array_min(sizes), 1 - alpha)
        return F.array_max(F.transform(sizes, lambda x: F.pow(x, alpha - 1))) * budget / _mean(sizes, lambda x: F.pow(x, alpha))

    target = F.lit(float(entropy if entropy is not None else repeats))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        above = measure(mid) > target
        return F.struct(F.when(above, mid).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(most).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve)["hi"]
    return F.when(measure(F.lit(0.0)) <= target, F.lit(0.0)).otherwise(found)


def plan_mix(docs: DataFrame, budget_tokens: int | None = None, budget_passes: float | None = None, entropy: float | None = None, max_repeats: float | None = None, seed: int = 0, blocks: int = 1024, max_sources: int = 10_000, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row for each source: source, tokens, exponent, weight, target (tokens), passes, and of the last, partial pass: taken, edge, cut.

    A source's weight is its token share to the power of the exponent, normalised. The exponent, found by bisection, is the smallest (the mix the most
    even) with an entropy (nats) of at most `entropy`, or with no source repeated over `max_repeats` times; one of the two must be given. The budget is
    budget_tokens, or budget_passes times the corpus; if neither, the least budget that passes over every source once (needs max_repeats, at least 1).
    A limit that even the shares themselves break leaves them unchanged (exponent 1); entropies out of reach give exponent 0 or 8.

    A source's documents fall into `blocks` by hash. Each pass permutes them anew; the partial pass takes whole blocks in its order while they fit
    (`taken`), and of the next one (`edge`) the documents, in hash order, that fit (hash at most `cut`). So a source's tokens are its target, less what
    the next document would exceed. Null is a source of its own; sources without tokens are left out. Over `max_sources` sources raise: what is
    broadcast is a row for each source, with `blocks` numbers at most. No rows: no rows.
    """
    if (entropy is None) == (max_repeats is None):
        raise ValueError("give either entropy or max_repeats")
    cover = budget_tokens is None and budget_passes is None
    if cover and (max_repeats is None or max_repeats < 1):
        raise ValueError("without a budget, max_repeats of at least 1 is needed")
    source = F.col(source_col).alias("source")
    block = F.pmod(_draw(F.lit(seed), F.col(id_col)), F.lit(blocks)).cast("int")
    rows = docs.select(source, block.alias("block"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sums = rows.groupBy("source", "block").agg(F.sum(n_tokens(F.col("text"))).alias("n")).where("n > 0")
    totals = sums.groupBy("source").agg(F.sum("n").alias("tokens"))
    all_ = totals.agg(F.array_sort(F.collect_list(F.col("tokens").cast("double"))).alias("sizes"), F.sum("tokens").cast("double").alias("total"), F.count("*").alias("sources"))
    all_ = all_.where((F.col("sources") > 0) & F.when(F.col("sources") <= max_sources, True).otherwise(F.raise_error(F.lit(f"over {max_sources} sources")).cast("boolean")))
    shares = F.transform("sizes", lambda x: x / F.col("total")) if entropy is not None else F.col("sizes")
    budget = None if cover else F.lit(float(budget_tokens)) if budget_tokens is not None else F.col("total") * float(budget_passes)
    all_ = all_.withColumn("exponent", _exponent(shares, budget, entropy, max_repeats, 8.0 if entropy is not None else 1.0))
    z = F.aggregate("sizes", F.lit(0.0), lambda a, x: a + F.pow(x / F.col("total"), F.col("exponent")))
    all_ = all_.withColumn("z", z).withColumn("least", F.pow(F.array_max("sizes") / F.col("total"), 1 - F.col("exponent")) * F.col("total") * F.col("z"))
    all_ = all_.select("total", "exponent", "z", (F.col("least") if cover else budget).alias("budget"))
    own = totals.join(F.broadcast(all_))
    own = own.withColumn("weight", F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("z")).withColumn("target", F.col("weight") * F.col("budget"))
    own = own.withColumn("passes", F.floor(F.col("target") / F.col("tokens") + 1e-9))
    own = own.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("tokens"))).select("source", "tokens", "exponent", "weight", "target", "passes", "rest")
    turn = Window.partitionBy("source").orderBy("turn", "block")  # `blocks` rows at most
    ordered = sums.withColumnRenamed("source", "of").join(F.broadcast(own), F.col("of").eqNullSafe(F.col("source"))).drop("of")
    ordered = ordered.withColumn("turn", block_turn(F.col("source"), F.col("block"), F.col("passes"), seed)).withColumn("sum", F.sum("n").over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = ordered.withColumn("fits", F.col("sum") <= F.col("rest")).withColumn("edge", (F.col("sum") > F.col("rest")) & (F.col("sum") - F.col("n") <= F.col("rest")))
    same = [F.first(c).alias(c) for c in ("tokens", "exponent", "weight", "target", "passes", "rest")]
    taken = [F.collect_list(F.when(F.col("fits"), F.col("block"))).alias("taken"), F.max(F.when(F.col("edge"), F.col("block"))).alias("edge"), F.max(F.when(F.col("edge"), F.col("rest") - F.col("sum") + F.col("n"))).alias("left")]
    plan = ordered.groupBy("source").agg(*same, *taken)
    edge = plan.where("edge is not null").select(F.col("source").alias("of"), "edge", "left", "passes")
    at = rows.join(F.broadcast(edge), F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("edge")))
    at = at.select("of", "left", document_turn(F.col("id"), F.col("passes"), seed).alias("h"), n_tokens(F.col("text")).alias("n"))
    # rows of one hash (repeated ids) are taken together
    at = at.groupBy("of", "left", "h").agg(F.sum("n").alias("n")).withColumn("sum", F.sum("n").over(Window.partitionBy("of").orderBy("h")))
    cuts = at.where(F.col("sum") <= F.col("left")).groupBy("of").agg(F.max("h").alias("cut"))
    return plan.join(F.broadcast(cuts), F.col("source").eqNullSafe(F.col("of")), "left").select("source", "tokens", "exponent", "weight", "target", "passes", "taken", "edge", "cut")


def block_turn(source: Column, block: Column, epoch: Column, seed: int) -> Column:
    """By which number a pass orders the blocks of a source."""
    return _draw(F.lit(seed), F.lit("block"), epoch, source, block)


def document_turn(key: Column, epoch: Column, seed: int) -> Column:
    """By which number a pass orders the documents of a block."""
    return _draw(F.lit(seed), F.lit("document"), epoch, key)


def repeats(docs: DataFrame, plan: DataFrame, seed: int = 0, blocks: int = 1024, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """`docs` with mix (struct<block, repeats, weight, exponent>): how often the mix of `plan` (plan_mix, same seed and blocks) has each row.

    No shuffle: the plan is broadcast. Rows of sources without tokens have 0 repeats and a null weight. A column `mix` in `docs` is replaced.
    """
    own = plan.select(F.struct("*").alias("_plan"))
    block = F.pmod(_draw(F.lit(seed), F.col(id_col)), F.lit(blocks)).cast("int")
    p = F.col("_plan")
    joined = docs.drop("mix").join(F.broadcast(own), F.col(source_col).eqNullSafe(p["source"]), "left")
    last = F.array_contains(p["taken"], block) | ((block == p["edge"]) & (document_turn(F.col(id_col), p["passes"], seed) <= p["cut"]))
    times = F.coalesce(p["passes"] + F.coalesce(last, F.lit(False)).cast("long"), F.lit(0)).cast("long")
    return joined.withColumn("mix", F.struct(block.alias("block"), times.alias("repeats"), p["weight"].alias("weight"), p["exponent"].alias("exponent"))).drop("_plan")


def mixed(docs: DataFrame, plan: DataFrame, seed: int = 0, blocks: int = 1024, id_col: str = "doc_id", source_col: str = "source", keep_mix: bool = False) -> DataFrame:
    """Every row of `docs` as often as the mix has it, with its place in the permutation: order by epoch, block_turn, document_turn. No shuffle.

    keep_mix: with the column `mix` of repeats, too.
    """
    found = repeats(docs, plan, seed, blocks, id_col, source_col).where(F.col("mix.repeats") > 0)
    each = found.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix.repeats") - 1)))
    places = {"block_turn": block_turn(F.col(source_col), F.col("mix.block"), F.col("epoch"), seed), "document_turn": document_turn(F.col(id_col), F.col("epoch"), seed)}
    return each.withColumns(places).drop(*([] if keep_mix else ["mix"]))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of the corpus' size, with no source repeated more than twice: each document as often as the mix has it, with its place; see mixed, plan_mix.

    Of a source, the rows in the order of epoch, block_turn and document_turn are its passes as block permutations.
    """
    docs = table(spark, sf_dir, "documents")
    found = mixed(docs, plan_mix(docs, budget_passes=1.0, max_repeats=2.0), keep_mix=True)
    return found.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), F.col("mix.block").alias("block"), "epoch", "block_turn", "document_turn", F.round("mix.weight", 9).alias("weight"), F.round("mix.exponent", 9).alias("exponent"))


_SQL_DRAW = "('0x' || substr(md5({}), 1, 15))::BIGINT"
QUERIES = {"op1_mixing": op1_mixing}
ORACLE_SQL = {
    "op1_mixing": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n, ({_SQL_DRAW.format("'0|' || doc_id")} % 1024)::INTEGER AS block FROM documents),
t AS (SELECT source, sum(n)::DOUBLE AS s FROM d GROUP BY source HAVING sum(n) > 0),
l AS (SELECT list(s ORDER BY s) AS z, sum(s) AS total FROM t),
b AS (SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
      UNION ALL
      SELECT k + 1, CASE WHEN up THEN (lo + hi) / 2 ELSE lo END, CASE WHEN up THEN hi ELSE (lo + hi) / 2 END
      FROM (SELECT *, list_max(list_transform(z, lambda x: pow(x, (lo + hi) / 2 - 1))) * total / list_sum(list_transform(z, lambda x: pow(x, (lo + hi) / 2))) > 2.0 AS up FROM b, l WHERE k < {HALVINGS})),
e AS (SELECT CASE WHEN list_max(list_transform(z, lambda x: 1 / x)) * total / len(z) <= 2.0 THEN 0.0 ELSE hi END AS a, total FROM b, l WHERE k = {HALVINGS}),
w AS (SELECT source, s, a, pow(s / total, a) / (SELECT sum(pow(s / total, a)) FROM t, e) AS weight, total FROM t, e),
p AS (SELECT *, floor(weight * total / s + 1e-9)::BIGINT AS passes, greatest(0.0, weight * total - floor(weight * total / s + 1e-9) * s) AS rest FROM w),
k AS (SELECT source, block, sum(n) AS n FROM d GROUP BY ALL HAVING sum(n) > 0),
o AS (SELECT k.*, passes, rest, sum(n) OVER (PARTITION BY k.source ORDER BY {_SQL_DRAW.format("'0|block|' || passes || '|' || coalesce(k.source, 'null') || '|' || block")}, block) AS c FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source),
g AS (SELECT d.doc_id, d.source, d.n, d.block, passes, c, rest, rest - c + o.n AS room, {_SQL_DRAW.format("'0|document|' || passes || '|' || doc_id")} AS h FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source AND d.block = o.block),
f AS (SELECT *, c > rest AND room >= 0 AS edge, sum(n) OVER (PARTITION BY source, block ORDER BY h) AS m FROM g)
SELECT doc_id, source, n_tokens, block, epoch, {_SQL_DRAW.format("'0|block|' || epoch || '|' || coalesce(source, 'null') || '|' || block")} AS block_turn,
       {_SQL_DRAW.format("'0|document|' || epoch || '|' || doc_id")} AS document_turn, weight, exponent
FROM (SELECT f.doc_id, f.source, f.n AS n_tokens, f.block, unnest(range(0, (f.passes + CASE WHEN c <= f.rest OR (edge AND m <= room) THEN 1 ELSE 0 END)::BIGINT)) AS epoch, round(weight, 9) AS weight, round(a, 9) AS exponent
FROM f JOIN p ON f.source IS NOT DISTINCT FROM p.source)"""
}
