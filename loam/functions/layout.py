"""Byte layouts of index and recipe entries, for exchange with stores that keep them packed: little-endian, numbers at multiples of their size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.hashing import little_endian

#: A recipe entry: the fingerprint, then secret number, secret size and share size of 4 bytes each.
ENTRY_BYTES = 32 + 3 * 4
#: Bytes, and at which multiples it begins, of each kind of field: numbers, a fingerprint (hex as a column), a container's name.
KINDS = {"byte": (1, 1), "int": (4, 4), "long": (8, 8), "fp": (32, 1), "name16": (16, 1)}


def little_endian_long(number: Column) -> Column:
    """The 8 bytes of a BIGINT, the lowest first."""
    h = F.lpad(F.hex(number.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]))


def read_int(data: Column, at: int) -> Column:
    """The 4-byte number that starts at a byte, counted from 0."""
    h = F.hex(F.substring(data, at + 1, 4))
    turned = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    n = F.conv(turned, 16, 10).cast("long")
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n).cast("int")


def read_long(data: Column, at: int) -> Column:
    """The 8-byte number that starts at a byte, counted from 0."""
    h = F.hex(F.substring(data, at + 1, 8))
    return F.conv(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]), 16, -10).cast("long")


@dataclass(frozen=True)
class Head:
    """A record of fixed fields (name, kind), each at the next multiple it may begin at, and filled up to a multiple of the largest."""

    fields: tuple[tuple[str, str], ...]

    @property
    def starts(self) -> list[int]:
        at, found = 0, []
        for _, kind in self.fields:
            size, step = KINDS[kind]
            found.append(-(-at // step) * step)
            at = found[-1] + size
        return found

    @property
    def size(self) -> int:
        step = max(KINDS[kind][1] for _, kind in self.fields)
        return -(-(self.starts[-1] + KINDS[self.fields[-1][1]][0]) // step) * step

    def pack(self, **values: Column) -> Column:
        """The bytes of the record; null if a field is null."""
        parts, at = [], 0
        for (name, kind), start in zip(self.fields, self.starts):
            v = values[name]
            gap = [F.unhex(F.lit("00" * (start - at)))] if start > at else []
            packed = {
                "byte": lambda: F.unhex(F.lpad(F.hex(v.cast("long")), 2, "0")),
                "int": lambda: little_endian(v),
                "long": lambda: little_endian_long(v),
                "fp": lambda: F.unhex(v),
                "name16": lambda: F.encode(v, "UTF-8"),
            }[kind]()
            parts += [*gap, packed]
            at = start + KINDS[kind][0]
        return F.concat(*parts, *([F.unhex(F.lit("00" * (self.size - at)))] if at < self.size else []))

    def unpack(self, data: Column) -> Column:
        """struct of the fields of the record that `data` begins with."""

        def read(kind: str, at: int) -> Column:
            part = F.substring(data, at + 1, KINDS[kind][0])
            return {"byte": lambda: F.conv(F.hex(part), 16, 10).cast("int"), "int": lambda: read_int(data, at), "long": lambda: read_long(data, at), "fp": lambda: F.lower(F.hex(part)), "name16": lambda: F.decode(part, "UTF-8")}[kind]()

        return F.struct(*[read(kind, at).alias(name) for (name, kind), at in zip(self.fields, self.starts)])


#: The head of a file's recipe, of what a client sends of a file, of a share's entry in the index, and of a file sent back. Fixed values.
RECIPE_HEAD = Head((("user_id", "int"), ("file_size", "long"), ("num_shares", "int")))
FILE_SHARE_HEAD = Head((("name_size", "int"), ("file_size", "long"), ("past", "int"), ("past_bytes", "long"), ("coming", "int"), ("coming_bytes", "long")))
SHARE_INDEX_HEAD = Head((("share_size", "int"), ("num_users", "int"), ("delta_depth", "byte"), ("delta_size", "long"), ("base_fp", "fp"), ("container", "name16"), ("offset", "long")))
SHARE_FILE_HEAD = Head((("file_size", "long"), ("num_shares", "int")))


def pack_entry(share_fp: Column, secret_id: Column, secret_size: Column, share_size: Column) -> Column:
    """44 bytes; null if a part is null."""
    return F.concat(F.unhex(share_fp), *[little_endian(c) for c in (secret_id, secret_size, share_size)])


def unpack_entry(data: Column) -> Column:
    """struct<share_fp, secret_id, secret_size, share_size> of 44 bytes."""
    numbers = {name: read_int(data, 32 + 4 * i) for i, name in enumerate(("secret_id", "secret_size", "share_size"))}
    return F.struct(F.lower(F.hex(F.substring(data, 1, 32))).alias("share_fp"), *[c.alias(n) for n, c in numbers.items()])


def unpack_entries(data: Column) -> Column:
    """array of unpack_entry structs of packed entries, one after the other."""
    starts = F.sequence(F.lit(0), (F.octet_length(data) / ENTRY_BYTES).cast("int") - 1)
    return F.when(F.octet_length(data) >= ENTRY_BYTES, F.transform(starts, lambda i: unpack_entry(F.substring(data, i * ENTRY_BYTES + 1, F.lit(ENTRY_BYTES)))))


def _rest(data: Column, start: Column | int) -> Column:
    """What follows the first bytes."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.substring(data, (start + 1).cast("int"), F.greatest(F.octet_length(data) - start, F.lit(0)).cast("int"))


def _sized(data: Column, wanted: Column, what: str) -> Column:
    """`data`, if it has the size that its head says; raises, when it is run, if not."""
    return F.when(F.octet_length(data) == wanted, data).otherwise(F.raise_error(F.lit(f"{what} is not as long as its head says")).cast("binary"))


def pack_recipe(user_id: Column, file_size: Column, num_shares: Column, entries: Column) -> Column:
    """A recipe: its head, then `entries`, the packed ones joined in order."""
    return F.concat(RECIPE_HEAD.pack(user_id=user_id, file_size=file_size, num_shares=num_shares), entries)


def unpack_recipe(data: Column) -> Column:
    """struct<user_id, file_size, num_shares, entries> of a recipe; raises if its length isn't that of so many entries."""
    wanted = RECIPE_HEAD.size + read_int(data, RECIPE_HEAD.starts[2]) * ENTRY_BYTES
    data = _sized(data, wanted, "a recipe")
    head = RECIPE_HEAD.unpack(data)
    return F.struct(*[head[n].alias(n) for n, _ in RECIPE_HEAD.fields], F.coalesce(unpack_entries(_rest(data, RECIPE_HEAD.size)), F.array().cast("array<struct<share_fp:string,secret_id:int,secret_size:int,share_size:int>>")).alias("entries"))


def pack_file_share(file_name: Column, file_size: Column, past: Column, past_bytes: Column, coming: Column, coming_bytes: Column, entries: Column) -> Column:
    """What a client sends of a file: the head, the whole name, then the packed entries of the coming shares."""
    name = F.encode(file_name, "UTF-8")
    return F.concat(FILE_SHARE_HEAD.pack(name_size=F.octet_length(name), file_size=file_size, past=past, past_bytes=past_bytes, coming=coming, coming_bytes=coming_bytes), name, entries)


def unpack_file_share(data: Column) -> Column:
    """struct<file_name, file_size, past, past_bytes, coming, coming_bytes, entries>; raises if the length isn't what the head says."""
    at = FILE_SHARE_HEAD.starts
    size, coming = read_int(data, at[0]), read_int(data, at[4])
    data = _sized(data, FILE_SHARE_HEAD.size + size + coming * ENTRY_BYTES, "a file's shares")
    head = FILE_SHARE_HEAD.unpack(data)
    name = F.decode(F.substring(data, F.lit(FILE_SHARE_HEAD.size + 1), size), "UTF-8")
    return F.struct(name.alias("file_name"), *[head[n].alias(n) for n, _ in FILE_SHARE_HEAD.fields[1:]], unpack_entries(_rest(data, size + FILE_SHARE_HEAD.size)).alias("entries"))


def pack_share_index(share_size: Column, delta_depth: Column, delta_size: Column, base_fp: Column, container: Column, offset: Column, users: Column) -> Column:
    """A share's index entry: the head, then its users, 4 bytes each. Without a delta, size and base are zero."""
    zero = F.lit("00" * 32)
    head = SHARE_INDEX_HEAD.pack(share_size=share_size, num_users=F.size(users), delta_depth=delta_depth, delta_size=F.coalesce(delta_size, F.lit(0)), base_fp=F.coalesce(base_fp, zero), container=container, offset=offset)
    return F.concat(head, F.unhex(F.array_join(F.transform(users, lambda u: F.hex(little_endian(u))), "")))


def unpack_share_index(data: Column) -> Column:
    """struct of the head's fields, and users; raises if the length isn't that of so many users."""
    n = read_int(data, SHARE_INDEX_HEAD.starts[1])
    data = _sized(data, n * 4 + SHARE_INDEX_HEAD.size, "a share's index entry")
    head, rest = SHARE_INDEX_HEAD.unpack(data), _rest(data, SHARE_INDEX_HEAD.size)
    users = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: read_int(F.substring(rest, i * 4 + 1, F.lit(4)), 0))).otherwise(F.array().cast("array<int>"))
    return F.struct(*[head[name].alias(name) for name, _ in SHARE_INDEX_HEAD.fields], users.alias("users"))
