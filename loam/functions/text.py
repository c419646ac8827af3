"""Names, addresses and figures as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(name: Column) -> Column:
    """A name with a slash in front; names that are empty or hold `./` or `../` at the start raise, null stays null."""
    bad = (name == "") | name.startswith("./") | name.startswith("../")
    return F.when(bad, F.raise_error(F.concat(F.lit("not a file name: "), name)).cast("string")).when(name.startswith("/"), name).otherwise(F.concat(F.lit("/"), name))


def is_file_name(name: Column) -> Column:
    return ~((name == "") | name.startswith("./") | name.startswith("../"))


def dir_name(name: Column) -> Column:
    """A name with a slash behind."""
    return F.when(name.endswith("/"), name).otherwise(F.concat(name, F.lit("/")))


def size_text(size: Column) -> Column:
    """Bytes as whole `G M K`, each what is left of the larger."""
    return F.format_string("%dG %dM %dK", F.shiftright(size, 30), F.shiftright(size, 20) % 1024, F.shiftright(size, 10) % 1024)


def duration_text(ms: Column) -> Column:
    """Milliseconds as minutes, seconds and milliseconds."""
    return F.format_string("%dm %ds %dms", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)


def percent(part: Column, whole: Column) -> Column:
    """A percentage without its fraction; 0 of nothing."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(part * 100 / whole)).cast("long")


def container_name(ordinal: Column) -> Column:
    """16 letters that count in base 26, the first letter fastest."""
    letters = [F.chr((F.lit(97) + F.pmod(F.floor(ordinal / F.lit(26**i)), F.lit(26))).cast("int")) if i < 13 else F.lit("a") for i in range(16)]
    return F.concat(*letters)


def address(text: Column) -> Column:
    """struct<host, port> of `host:port`."""
    parts = F.split(text, ":")
    return F.struct(parts[0].alias("host"), F.try_element_at(parts, F.lit(2)).cast("int").alias("port"))
