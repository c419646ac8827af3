"""Deltas of RFC 3284: round trips, a delta written by hand, damage."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.functions import vcdiff as V

RNG = random.Random(4)
BASE = RNG.randbytes(9000)


def test_code_table():
    t = V.code_table()
    assert len(t) == 256 == len(set(t))
    # some entries as RFC 3284, section 5.6, lists them
    assert t[0] == (("RUN", 0, 0),) and t[1] == (("ADD", 0, 0),) and t[18] == (("ADD", 17, 0),) and t[19] == (("COPY", 0, 0),) and t[34] == (("COPY", 18, 0),)
    assert t[147] == (("COPY", 0, 8),) and t[162] == (("COPY", 18, 8),) and t[163] == (("ADD", 1, 0), ("COPY", 4, 0)) and t[174] == (("ADD", 4, 0), ("COPY", 6, 0))
    assert t[235] == (("ADD", 1, 0), ("COPY", 4, 6)) and t[246] == (("ADD", 4, 0), ("COPY", 4, 8)) and t[247] == (("COPY", 4, 0), ("ADD", 1, 0)) and t[255] == (("COPY", 4, 8), ("ADD", 1, 0))


@pytest.mark.parametrize("n,want", [(0, "00"), (127, "7f"), (128, "8100"), (123456789, "baef9a15")])  # the last is the example of section 2
def test_numbers(n, want):
    assert V.number(n).hex() == want and V._Reader(bytes.fromhex(want)).number() == n


def test_the_example_of_section_3():
    """S = abcdefghijklmnop, T = abcdwxyzefghefghefghefghzzzz: COPY 4 0, ADD 4 wxyz, COPY 4 4, COPY 12 24, RUN 4 z."""
    s, t = b"abcdefghijklmnop", b"abcdwxyzefghefghefghefghzzzz"
    steps = [V.Step("COPY", 4, b"", 0), V.Step("ADD", 4, b"wxyz"), V.Step("COPY", 4, b"", 4), V.Step("COPY", 12, b"", 24), V.Step("RUN", 4, b"z")]
    made = V.pack(V.Delta([V.Window(steps, (16, 0), False, zlib.adler32(t))]))
    assert V.decode(s, made) == t and V.unpack(made).windows[0].steps == steps
    # by hand: no checksum; sizes 28, data "wxyzz", codes COPY 4 mode 0; ADD 4 with COPY 4 mode 0; COPY 12 mode 0; RUN 4; addresses 0, 4, 24
    body = bytes([28, 0, 5, 5, 3]) + b"wxyzz" + bytes([20, 172, 28, 0, 4]) + bytes([0, 4, 24])
    assert V.decode(s, V.MAGIC + bytes([0, 1, 16, 0, len(body)]) + body) == t


@given(st.binary(max_size=300), st.lists(st.one_of(st.tuples(st.integers(0, 299), st.integers(0, 200)), st.binary(max_size=40)), max_size=8), st.integers(20, 400))
@settings(max_examples=300, deadline=None)
def test_round_trips(base, parts, window):
    source = b"".join(p if isinstance(p, bytes) else base[p[0] : p[0] + p[1]] * 2 for p in parts)
    delta = V.encode(base, source, window=window)
    assert V.decode(base, delta) == source and V.pack(V.unpack(delta)) == delta
    cuts = range(0, len(delta) + 7, 7)
    assert b"".join(V.decode_stream(base, (delta[i : i + 7] for i in cuts))) == source


def test_small_deltas_and_copies_of_the_source_itself():
    source = BASE[:4000] + b"new words " + BASE[3000:] + b"ab" * 400
    assert len(V.encode(BASE, source)) < 80
    fresh = RNG.randbytes(3000)
    assert len(V.encode(b"", fresh * 4)) < 3100 and V.decode(b"", V.encode(b"", fresh * 4)) == fresh * 4
    assert V.decode(BASE, V.encode(BASE, b"")) == b"" and V.decode(b"", V.encode(b"", b"x")) == b"x"


def test_windows_of_the_target():
    steps = [V.Step("COPY", 6, b"", 1)]
    d = V.Delta([V.Window([V.Step("ADD", 4, b"abcd")]), V.Window(steps, (4, 0), True)])
    assert V.decode(b"", V.pack(d)) == b"abcd" + b"bcdbcd"
    with pytest.raises(ValueError, match="before it"):
        list(V.decode_stream(b"", [V.pack(d)]))


def test_application_headers_and_recoding():
    delta = V.encode(BASE, BASE[:5000] + BASE[4000:], b"file.bin", window=2000)
    assert V.unpack(delta).app == b"file.bin" and len(V.unpack(delta).windows) == 5
    again = V.recode(delta, b"other", checksum=False)
    assert V.unpack(again).app == b"other" and {w.adler for w in V.unpack(again).windows} == {None}
    assert V.decode(BASE, again) == V.decode(BASE, delta) == BASE[:5000] + BASE[4000:] and V.recode(delta) == delta


def test_damage():
    delta = V.encode(BASE, BASE[:5000] + b"x" * 50 + BASE[4000:])
    for wrong in (b"", b"VCD\0\0", delta[:-1], delta + b"\1", V.MAGIC + b"\1", V.MAGIC + b"\0\3\0\0", delta.replace(V.MAGIC, b"\xd6\xc3\xc4\1")):
        with pytest.raises(ValueError):
            V.decode(BASE, wrong)
        with pytest.raises(ValueError):
            list(V.decode_stream(BASE, [wrong]))
    with pytest.raises(ValueError, match="checksum"):
        V.decode(bytes(len(BASE)), delta)
    with pytest.raises(ValueError, match="isn't there"):
        V.decode(BASE[:10], delta)
    for at in range(5, len(delta)):
        flipped = delta[:at] + bytes([delta[at] ^ 16]) + delta[at + 1 :]
        try:
            assert len(V.decode(BASE, flipped)) >= 0
        except ValueError:
            pass


def test_columns(spark):
    rows = [(1, bytearray(BASE), bytearray(BASE[10:] + b"end"), bytearray(b"one")), (2, None, bytearray(b"x"), None), (3, bytearray(b""), bytearray(b"y" * 100), None)]
    df = spark.createDataFrame(rows, "i int, b binary, s binary, a binary").withColumn("d", V.vcdiff_encode(F.col("b"), F.col("s"), F.col("a")))
    got = {r.i: r for r in df.select("i", "s", V.vcdiff_decode(F.col("b"), F.col("d")).alias("t"), V.vcdiff_header(F.col("d")).alias("h")).collect()}
    assert got[1].t == got[1].s and got[3].t == got[3].s and got[2].t is None and got[2].h is None
    assert bytes(got[1].h.app) == b"one" and got[3].h.app is None and got[1].h.windows[0].n_copy == 1 and [w.size for w in got[3].h.windows] == [100]
