import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivane import as_json, feature_json, row_json, to_geojson, to_json_array
from scrivane.functions.values import matrix
from scrivane.operators import documents
from scrivane.operators.documents import write_lines
from scrivane.sources import geometry as G

NAN, INF = float("nan"), float("inf")
D = dt.datetime

# Documents that must come out byte for byte, as they are agreed with readers of this format.
FIXTURES = {
    "simple_numeric": ("x double", [(1.0,), (2.5,), (-3.0,)], '[{"x":1},{"x":2.5},{"x":-3}]'),
    "int_na": ("x int", [(1,), (None,), (3,)], '[{"x":1},{},{"x":3}]'),
    "dbl_special": ("x double", [(1.0,), (None,), (NAN,), (INF,), (-INF,)], '[{"x":1},{},{},{},{}]'),
    "logical_na": ("x boolean", [(True,), (False,), (None,)], '[{"x":true},{"x":false},{}]'),
    "char_na": ("ch string", [("foo",), (None,), ("bar",), ("NA",), ("",)], '[{"ch":"foo"},{},{"ch":"bar"},{"ch":"NA"},{"ch":""}]'),
    "factor_na": ("x string", [("a",), ("b",), (None,), ("NA",), ("a",)], '[{"x":"a"},{"x":"b"},{},{"x":"NA"},{"x":"a"}]'),
    "mixed": ("i int, d double, l boolean, ch string", [(1, 1.0, True, "a"), (None, None, None, ""), (3, 3.5, False, None)], '[{"i":1,"d":1,"l":true,"ch":"a"},{"ch":""},{"i":3,"d":3.5,"l":false}]'),
    "dates": ("d date", [(dt.date(2020, 1, 1),), (None,), (dt.date(2020, 1, 3),)], '[{"d":"2020-01-01"},{},{"d":"2020-01-03"}]'),
    "timestamps": ("dt timestamp_ntz", [(D(2020, 1, 1),), (None,), (D(2020, 1, 3, 12, 34, 56),)], '[{"dt":"2020-01-01 00:00:00"},{},{"dt":"2020-01-03 12:34:56"}]'),
    "midnights": ("dt timestamp_ntz", [(D(2020, 1, 1),)], '[{"dt":"2020-01-01"}]'),
    "minutes": ("dt timestamp_ntz", [(D(2020, 1, 1, 5, 6),)], '[{"dt":"2020-01-01 05:06"}]'),
    "empty_rows": ("x int, y string", [], "[]"),
    "weird_names": ('`sp ace` double, `quote"here` string, `uniçode` boolean, `a.b` int, `t``k` int', [(1.0, "a", True, 1, 2)], '[{"sp ace":1,"quote\\"here":"a","uniçode":true,"a.b":1,"t`k":2}]'),
    "list_column": ("id int, nested array<struct<a:double,b:string>>", [(1, [(1.0, "x")]), (2, [(None, None)]), (3, None)], '[{"id":1,"nested":[{"a":1,"b":"x"}]},{"id":2,"nested":[{"a":null,"b":null}]},{"id":3,"nested":{}}]'),
    "list_atomic": ("id int, vals array<double>", [(1, [1.0, 2.0, 3.0]), (2, [None]), (3, []), (4, [NAN, INF, -INF])], '[{"id":1,"vals":[1,2,3]},{"id":2,"vals":["NA"]},{"id":3,"vals":[]},{"id":4,"vals":["NaN","Inf","-Inf"]}]'),
    "bounds": ("x double", [(2147483647.0,), (2147483648.0,), (-0.0,), (1e16,), (9.9e-6,), (1e-5,)], '[{"x":2147483647},{"x":2147483648.0},{"x":0},{"x":1e16},{"x":9.9e-6},{"x":0.00001}]'),
    "controls": ("s string", [("a\nb\t\x01\\\"",)], '[{"s":"a\\u000Ab\\u0009\\u0001\\\\\\""}]'),
    "others": ("l bigint, f float, n decimal(5,2), b binary, i interval day to second", [(2**40, 0.1, None, b"x", dt.timedelta(seconds=90))], '[{"l":1099511627776,"f":0.1,"i":90}]'),
    "deep": ("s struct<a:int,b:array<string>>, m map<string,int>, z array<array<int>>", [((1, None), {"q": 2, "p": None}, [[1], [], None])], '[{"s":{"a":[1],"b":{}},"m":{"p":["NA"],"q":[2]},"z":[[1],[],{}]}]'),
}


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    json.loads(rows[0]["json"])
    return rows[0]["json"]


@pytest.mark.parametrize("name", FIXTURES)
@pytest.mark.parametrize("parts", [1, 3])
def test_fixtures(spark, name, parts):
    schema, rows, want = FIXTURES[name]
    base = T.StructType.fromDDL(schema)
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], T.StructType([T.StructField("_n", T.IntegerType()), *base.fields]))
    got = one(to_json_array(df.repartition(parts), "_n", leave_out=["_n"], ranges=parts))
    assert got == want


def test_no_columns_row_names_and_groups(spark):
    df = spark.createDataFrame([(1, "a", "r1"), (2, "b", "r2")], "x int, y string, rn string")
    assert one(to_json_array(df.select())) == "[{},{}]"
    assert one(to_json_array(df, "x", row_name_col="rn")) == '[{"x":1,"y":"a","_row":"r1"},{"x":2,"y":"b","_row":"r2"}]'
    assert {r["y"]: r["json"] for r in to_json_array(df, "x", by=["y"]).collect()} == {"a": '[{"x":1,"rn":"r1"}]', "b": '[{"x":2,"rn":"r2"}]'}


def test_matrix_column_fast_mode_and_errors(spark):
    df = spark.createDataFrame([([1.0, NAN, None],)], "m array<double>")
    assert one(row_json(df, matrix_cols=["m"])) == '{"m":[1,"NA","NA"]}'
    fast = spark.createDataFrame([(1, NAN, "x")], "a int, b double, c string")
    assert json.loads(one(row_json(fast, mode="fast"))) == {"a": 1, "c": "x"}
    with pytest.raises(ValueError, match="unique"):
        row_json(fast.select("a", "a"))
    with pytest.raises(TypeError):
        to_json_array([1])
    with pytest.raises(ValueError):
        to_geojson(fast, "geometry")
    with pytest.raises(TypeError):
        to_geojson(fast, "a")


def test_fast_mode_refuses_what_it_lacks(spark):
    df = spark.createDataFrame([(1, "x")], "a int, c string")
    for option in ({"auto_unbox": True}, {"row_name_col": "c"}, {"matrix_cols": ["a"]}, {"timestamp_format": "yyyy"}):
        with pytest.raises(ValueError, match=next(iter(option))):
            row_json(df, mode="fast", **option)
    with pytest.raises(ValueError, match="slow"):
        row_json(df, mode="slow")
    assert one(row_json(df, mode="fast", leave_out=["a"])) == '{"c":"x"}'


def test_mixed_lists_and_null_rows(spark):
    df = spark.sql("""SELECT parse_json('{"b":"x\\\\ny","a":1,"c":null,"d":[1,"q",[]],"e":[true,null]}') AS v, array(parse_json('1'), parse_json('"z"'), NULL) AS l,
                             map('k', parse_json('2.5'), 'a', parse_json('[1,2]')) AS m, named_struct('s', parse_json('[3]')) AS s, array(named_struct('t', parse_json('4'))) AS t, array(array(1), NULL, array(2, NULL)) AS x""")
    assert one(row_json(df)) == (
        '{"v":{"a":[1],"b":["x\\u000Ay"],"c":["NA"],"d":[[1],["q"],[]],"e":[true,"NA"]},"l":[[1],["z"],["NA"]],'
        '"m":{"a":[1,2],"k":[2.5]},"s":{"s":[3]},"t":[{"t":[4]}],"x":[[1],{},[2,"NA"]]}'
    )
    assert df.select(matrix(F.col("x"), T.IntegerType()).alias("json")).first()[0] == '[[1],{},[2,"NA"]]'


def test_documents_that_are_too_long(spark, monkeypatch):
    monkeypatch.setattr(documents, "MOST_BYTES", 100)
    df = spark.range(10)
    assert len(one(to_json_array(df, "id"))) == 91 - 0
    for options in ({}, {"ranges": 2}, {"by": ["k"]}):
        with pytest.raises(Exception, match="write_lines"):
            to_json_array(spark.range(40).withColumn("k", F.lit(1)), "id", **options).collect()


def test_order_ties_and_partitions(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"), (F.col("id") / 8).alias("w"))
    texts = {one(to_json_array(df.repartition(p), "k", ranges=r)) for p, r in ((1, 1), (4, 3), (13, 5))}
    assert len(texts) == 1 and len(json.loads(texts.pop())) == 3000


def rows_of_aggregates(df):
    """Of a collected df, the rows that each aggregation with lists has put out."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        inner = {"AdaptiveSparkPlan": "executedPlan", "ShuffleQueryStage": "plan", "ResultQueryStage": "plan"}.get(node.nodeName().split()[0])
        found += [node.metrics().apply("numOutputRows").value()] if node.nodeName() == "ObjectHashAggregate" else []
        todo += [getattr(node, inner)()] if inner else [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_no_task_has_its_whole_range_as_one_buffer(spark):
    """a range of over a million rows was one aggregation buffer, and executors ran out of memory long before the document was gathered."""
    df = spark.range(20_000).select("id", (F.col("id") % 3).alias("k"))
    for made in (to_json_array(df, "id", ranges=2), to_geojson(df.withColumn("geometry", G.point(F.col("id"), F.lit(0))), "geometry", "id", ranges=2)):
        assert len(json.loads(made.collect()[0]["json"])) in (20_000, 2)
        assert max(rows_of_aggregates(made)) >= 20_000 / 2**10


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_many_pieces_are_in_order(spark, monkeypatch, bits):
    """More pieces in a task than are aggregated in memory, so that rows and pieces come out of order; empty ranges and ties among them."""
    monkeypatch.setattr(documents, "PIECE_BITS", bits, raising=False)
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("v"), F.lit(1).alias("k"))
    assert one(to_json_array(df, ["v"], ranges=2)) == "[" + ",".join(f'{{"v":{v},"k":1}}' for v in range(3000)) + "]"
    assert one(to_json_array(df, "k", ranges=3)) == "[" + ",".join(sorted(f'{{"v":{v},"k":1}}' for v in range(3000))) + "]"
    assert one(to_json_array(df.where("v = 5"), "v", ranges=4)) == '[{"v":5,"k":1}]'
    assert one(to_json_array(df.where("v < 0"), "v", ranges=4)) == "[]"


def unsound(bad):
    line = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), bad))
    return [G.point(F.lit(1.0), bad), G.multipoint(line), G.linestring(line), G.multilinestring(F.array(line)), G.polygon(F.array(line)), G.multipolygon(F.array(F.array(line)))]


def test_geojson(spark):
    df = spark.createDataFrame([(1.0,)], "id double").withColumn("geometry", G.point(F.lit(0), F.lit(0)))
    assert one(to_geojson(df, "geometry")) == '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":1},"geometry":{"type":"Point","coordinates":[0.0,0.0]}}]}'
    assert one(to_geojson(df.where("false"), "geometry")) == "[]"
    assert one(to_geojson(df.where("false"), "geometry", empty_as_collection=True)) == '{"type":"FeatureCollection","features":[]}'
    assert to_geojson(df, "geometry").schema["json"].metadata == {"format": "geojson"}
    line = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0), F.lit(9.0)))
    rings = F.array(line, line)
    none = F.array().cast("array<array<double>>")
    want = [
        (G.linestring(line), '{"type":"LineString","coordinates":[[0.0,0.0],[1.0,2.0]]}'),
        (G.multipoint(line), '{"type":"MultiPoint","coordinates":[[0.0,0.0],[1.0,2.0]]}'),
        (G.multipoint(none), '{"type":"MultiPoint","coordinates":[]}'),
        (G.polygon(rings), '{"type":"Polygon","coordinates":[[[0.0,0.0],[1.0,2.0]],[[0.0,0.0],[1.0,2.0]]]}'),
        (G.multilinestring(rings), '{"type":"MultiLineString","coordinates":[[[0.0,0.0],[1.0,2.0]],[[0.0,0.0],[1.0,2.0]]]}'),
        (G.multipolygon(F.array(rings)), '{"type":"MultiPolygon","coordinates":[[[[0.0,0.0],[1.0,2.0]],[[0.0,0.0],[1.0,2.0]]]]}'),
        (G.point(F.lit(NAN), F.lit(1)), "null"),
        (F.struct(F.lit("Point").alias("kind"), G.multipoint(none)["parts"].alias("parts")), "null"),
        (F.struct(F.lit("GeometryCollection").alias("kind"), G.multipoint(none)["parts"].alias("parts")), "null"),
        *((g, "null") for bad in (NAN, INF, None) for g in unsound(F.lit(bad).cast("double"))),
        (G.linestring(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.lit(None).cast("array<double>"))), "null"),
        (G.polygon(F.array(line, F.lit(None).cast("array<array<double>>"))), "null"),
        (F.lit(None).cast("struct<kind:string,parts:array<array<array<array<double>>>>>"), "null"),
    ]
    for g, text in want:
        got = one(feature_json(df.select(g.alias("g")), "g"))
        assert got == f'{{"type":"Feature","properties":{{}},"geometry":{text}}}'


def test_as_json_of_values(spark):
    assert as_json(None) == "{}"
    assert as_json({"a": 1, "b": "foo", "c": None}) == '{"a":[1],"b":["foo"],"c":["NA"]}'
    assert as_json({"val": 5}) == '{"val":[5]}' and as_json({"val": 5}, auto_unbox=True) == '{"val":5}'
    assert as_json({"meta": {"version": "1.0"}, "payload": [10, 20]}, auto_unbox=True) == '{"meta":{"version":"1.0"},"payload":[10,20]}'
    assert as_json([[1, 2], [3, 4]]) == "[[1,2],[3,4]]" and as_json([1, "a", None]) == '[[1],["a"],["NA"]]' and as_json([]) == "[]" and as_json({}) == "{}"
    df = spark.range(1).select(F.array(F.array(F.lit(5))).alias("x"))
    assert df.select(as_json(F.col("x"), data_type=df.schema["x"].dataType, auto_unbox=True)).first()[0] == "[5]"
    spatial = df.select(F.lit(1).alias("v"), G.point(F.lit(1), F.lit(2)).alias("g"))
    assert one(as_json(spatial, geom_col="g")).startswith('{"type":"FeatureCollection"')


def test_lines_sink(spark, tmp_path):
    write_lines(row_json(spark.range(3)), str(tmp_path / "out"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"id":0}', '{"id":1}', '{"id":2}']
