import math
import random
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrivane.functions.local import _shortest, local_json
from scrivane.functions.scalars import escape_controls, json_number, json_shortest, json_string
from scrivane.functions.unbox import unbox
from tests import model


def test_numbers(spark):
    r = random.Random(7)
    values = [0.0, -0.0, 1.0, -1.5, 1e-3, 9.99e-4, 1e7, 1e16, 9999999999999998.0, 1e15, 1e-5, 9.9e-6, 1.5e300, -2147483648.0, 2147483648.0, 123456789012.5]
    values += [r.uniform(-180, 180) for _ in range(2000)] + [math.copysign(10 ** r.uniform(low, high), r.random() - 0.5) for low, high in ((-5, 16), (16, 308), (-307, -5)) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for v, a, b in df.select("x", json_number(F.col("x")), json_shortest(F.col("x"))).collect():
        assert float(a) == v and float(b) == v
        assert (a, b) == (model.number(v), model.shortest(v))


def test_strings(spark):
    texts = ["".join(map(chr, range(256))), "", "plain", 'q"b\\', "\x00\x1f\x7f", "é☃😀\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = df.select(json_string(F.col("s")).alias("t")).select(escape_controls(F.col("t"))).collect()
    assert [r[0] for r in got] == [model.escape(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1))
def test_local_numbers(bits):
    x = struct.unpack("d", struct.pack("Q", bits))[0]
    if math.isfinite(x):
        assert float(_shortest(x)) == x
        assert local_json(x) == f"[{model.number(x)}]"


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text('a"[]{},\\\n', max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text('k"[', max_size=2), x, max_size=3), max_leaves=8)


def test_unboxing(spark):
    texts: list[str] = ['[[5]]', '["x]"]', "[]", '"[1]"', '{"a":[1],"b":["NA"],"c":[1,2],"d":[{}]}']

    @settings(max_examples=200, deadline=None)
    @given(VALUES)
    def gather(v):
        texts.append(local_json(v))

    gather()
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, u in df.select("t", unbox(F.col("t"))).collect():
        assert u == model.unbox(t)
