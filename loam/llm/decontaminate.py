"""Benchmark decontamination: test items that occur in a text within an edit budget, by exact pieces and Myers' bit-parallel distance."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import kept, table

_FOLD = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def normalised(text: str | None) -> str:
    """Lower case, with one space for each run of ASCII characters other than letters and digits; none at the ends."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_FOLD).split()).decode()


def myers(pattern: str, text: str, most: int, anchored: bool = False) -> tuple[int, int] | None:
    """(edit distance, end) of the nearest occurrence of `pattern` in `text` within `most` edits, the first such; None if there is none.

    anchored: the occurrence starts where the text does.
    """
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last, score = (1 << len(pattern)) - 1, 1 << len(pattern) - 1, len(pattern)
    up, down, best = full, 0, None  # vertical differences of +1 and -1
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0) | down
        zero = (((eq & up) + up) ^ up) | eq
        right, left = down | ~(zero | up) & full, up & zero
        score += bool(right & last) - bool(left & last)
        right = right << 1 | anchored
        up, down = (left << 1 | ~(zero | right)) & full, right & zero & full
        if score <= most and (best is None or score < best[0]):
            best = score, end
            if not score:
                break
    return best


class Tests:
    """Test items, cut into pieces."""

    def __init__(self, items: list[tuple], rate: float) -> None:
        """items: (id, text). An item of n normalised characters may have int(rate * n) edits, and so has one piece more."""
        self.items, pieces = [], {}
        for key, text in items:
            if folded := normalised(text):
                most = int(rate * len(folded))
                cuts = [len(folded) * i // (most + 1) for i in range(most + 2)]
                for a, b in zip(cuts, cuts[1:]):
                    pieces.setdefault(folded[a:b], []).append((len(self.items), a))
                self.items.append((key, folded, most))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[dict]:
        """The nearest occurrence of each item that occurs within its budget."""
        folded, starts = normalised(text), {}
        if self.items and folded:
            for end, (n, where) in self.automaton.iter(folded):
                whole = (end + 1 == n or folded[end - n] == " ") and folded[end + 1 : end + 2] in ("", " ")
                for item, offset in where:
                    if whole or self.items[item][2]:
                        starts.setdefault(item, []).append(end + 1 - n - offset)
        return [m for item in sorted(starts) if (m := self._nearest(folded, item, sorted(set(starts[item]))))]

    def _nearest(self, text: str, item: int, starts: list[int]) -> dict | None:
        key, pattern, most = self.items[item]
        best = None
        for a, b in self._regions(starts, len(pattern), most):
            if (found := myers(pattern, text[max(a, 0) : b], most if best is None else best[0] - 1)) is not None:
                best = found[0], max(a, 0) + found[1]
                if not best[0]:
                    break
        if best is None:
            return None
        distance, end = best
        back = myers(pattern[::-1], text[max(0, end - len(pattern) - most) : end][::-1], distance, anchored=True)
        return {"item_id": key, "distance": distance, "n_chars": len(pattern), "start": end - back[1], "end": end}

    @staticmethod
    def _regions(starts: list[int], length: int, most: int) -> Iterator[tuple[int, int]]:
        """Where an occurrence may lie of which a piece was hit; overlapping places are searched once."""
        a, b = starts[0] - most, starts[0] + length + most
        for s in starts[1:]:
            if s - most > b:
                yield a, b
                a = s - most
            b = s + length + most
        yield a, b


_FOUND = "array<struct<item_id: {}, distance: int, n_chars: int, start: int, end: int>>"


#: The automata of one set of tests: a worker runs many tasks, and making that of a large part takes time.
_made: dict[str, dict[int, Tests]] = {}


def _tests(run: str, part: int, items: Callable[[], list[tuple]], rate: float) -> Tests:
    """Made once in a process; another set of tests takes the place of the last."""
    if run not in _made:
        _made.clear()
        _made[run] = {}
    if part not in _made[run]:
        _made[run][part] = Tests(items(), rate)
    return _made[run][part]


def _matchers(tests: DataFrame, rate: float, part_bytes: int) -> list[Callable[[Column], Column]]:
    """A function for each part of the tests, from a text to its matches. The driver reads and holds a part at a time; the tasks get it as a broadcast."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type, run = tests.schema["item_id"].dataType, uuid.uuid4().hex
    kind = pa.list_(pa.struct([("item_id", to_arrow_type(id_type)), *((c, pa.int32()) for c in ("distance", "n_chars", "start", "end"))]))

    def matcher(part: int, items: list[tuple]):
        shared = tests.sparkSession.sparkContext.broadcast(items)

        @F.arrow_udf(_FOUND.format(id_type.simpleString()))
        def match(texts: pa.Array) -> pa.Array:
            made = _tests(run, part, lambda: shared.value, rate)
            return pa.array([made.matches(t) for t in texts.to_pylist()], kind)

        return match

    found, items, held = [], [], 0
    for row in tests.select("item_id", "text").where("text is not null").toLocalIterator():
        if held > part_bytes:
            found.append(matcher(len(found), items))
            items, held = [], 0
        items.append((row[0], row[1]))
        held += len(row[1])
    return [*found, matcher(len(found), items)]


def occurrences(text: Column, tests: DataFrame, rate: float = 0.05, part_bytes: int = 16 << 20) -> Column:
    """array<struct<item_id, distance, n_chars, start, end>>: the items of `tests` (item_id, text) that occur in a text, each at its nearest place.

    Item and text are compared in lower case without punctuation (see normalised; start and end refer to that form). An item of n characters matches
    within int(rate * n) edits; one so short that this is none has to stand as whole words. By the pigeonhole principle one of its int(rate * n) + 1
    pieces then occurs exactly; an automaton over all pieces finds those, and Myers' distance settles each place. Null, empty and letterless items match
    nothing, and such texts match nothing. Items with equal texts, repeated ones included, all match; of places as near the first counts. Texts of any
    length are searched whole, each by one task; equal texts have equal results, and no other column is read.

    As a column, it is one pass with all parts of the tests in each worker; for tests over `part_bytes` see found and decontaminate.
    """
    return F.flatten(F.array(*[match(text) for match in _matchers(tests, rate, part_bytes)]))


def found(docs: DataFrame, tests: DataFrame, rate: float = 0.05, part_bytes: int = 16 << 20, text_col: str = "text") -> DataFrame:
    """A row for each row of `docs` and each item of `tests` that occurs in it: the columns of `docs`, and `match` (see occurrences).

    The tests are cut into parts of `part_bytes`, and a larger set makes more passes over the texts, one part each: neither the driver nor a worker
    holds more than a part. The rows of each pass are then written to the shared folder. A column `match` in `docs` is replaced.
    """
    docs = docs.drop("match")
    each = [docs.withColumn("match", F.explode(match(F.col(text_col)))) for match in _matchers(tests, rate, part_bytes)]
    return each[0] if len(each) == 1 else reduce(DataFrame.union, [kept(x, "matches") for x in each])


def decontaminate(docs: DataFrame, tests: DataFrame, rate: float = 0.05, part_bytes: int = 16 << 20, text_col: str = "text") -> DataFrame:
    """The rows of `docs` in whose text no item of `tests` occurs; all columns. Rows with a null or empty text stay, repeated rows share their fate.

    No shuffle, if the tests are within `part_bytes`. Else a pass for each part writes the SHA-256 of the texts with a match, and these are taken out.
    """
    text, each = F.col(text_col), _matchers(tests, rate, part_bytes)
    if len(each) == 1:
        return docs.where(F.size(each[0](text)) == 0)
    some = docs.where(text.isNotNull()).select(text.alias("text"))
    hits = reduce(DataFrame.union, [kept(some.where(F.size(match(F.col("text"))) > 0).select(F.sha2("text", 256).alias("_sha256")).distinct(), "hits") for match in each])
    clean = docs.where(text.isNotNull()).withColumn("_sha256", F.sha2(text, 256)).join(hits.distinct(), "_sha256", "left_anti")
    return clean.select(*docs.columns).union(docs.where(text.isNull()))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that occurs in it; see found and occurrences."""
    docs, tests = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return found(docs.select("doc_id", "text"), tests).select("doc_id", "match.*")


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLE_SQL: dict[str, str] = {}
