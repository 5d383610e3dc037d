"""Registered queries over the test tables, each with its SQL twin: QUERIES and ORACLE_SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivane.functions.scalars import FULL_TIMESTAMP, factor_level
from scrivane.functions.unbox import unbox
from scrivane.functions.values import matrix, value_json
from scrivane.operators.documents import as_json, to_geojson, to_json_array
from scrivane.operators.rows import feature_json, row_json
from scrivane.plans import sql as S
from scrivane.sources import geometry as G
from scrivane.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, twin: str):
    def add(f: Callable[[SparkSession, Callable[[str], DataFrame]], DataFrame]):
        def load(spark: SparkSession, sf_dir: str) -> Callable[..., DataFrame]:
            """By a table's name; with keys its rows are dealt out by them if one task would have to encode them all."""
            return lambda table, *keys: read_table(spark, f"{sf_dir}/{table}.parquet", *keys) if keys else spark.read.parquet(f"{sf_dir}/{table}.parquet")

        QUERIES[name] = lambda spark, sf_dir: f(spark, load(spark, sf_dir))
        ORACLE_SQL[name] = twin
        return f

    return add


def _pairs(**texts: str) -> list[tuple[str, str]]:
    return list(texts.items())


_ORDERS = _pairs(
    o_orderkey=S.whole("o_orderkey"), o_custkey=S.whole("o_custkey"), o_orderstatus=S.quoted("o_orderstatus"), o_totalprice=S.number("o_totalprice"), o_orderdate=S.stamp("o_orderdate"), o_orderpriority=S.quoted("o_orderpriority")
)
_LINES = _pairs(
    l_orderkey=S.whole("l_orderkey"), l_partkey=S.whole("l_partkey"), l_suppkey=S.whole("l_suppkey"), l_linenumber=S.whole("l_linenumber"), l_quantity=S.number("l_quantity"), l_extendedprice=S.number("l_extendedprice"),
    l_discount=S.number("l_discount"), l_tax=S.number("l_tax"), l_returnflag=S.quoted("l_returnflag"), l_linestatus=S.quoted("l_linestatus"), l_shipdate=S.stamp("l_shipdate"),
)


# Rows


@_query("row_json_orders", f"SELECT o_orderkey, {S.row(*_ORDERS)} AS json FROM orders")
def _(spark, t):
    return row_json(t("orders", "o_orderkey"), keep=["o_orderkey"], timestamp_format=FULL_TIMESTAMP)


@_query("row_json_lineitem", f"SELECT l_orderkey, l_linenumber, {S.row(*_LINES)} AS json FROM lineitem")
def _(spark, t):
    return row_json(t("lineitem", "l_orderkey"), keep=["l_orderkey", "l_linenumber"], timestamp_format=FULL_TIMESTAMP)


_SPARSE = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN CAST('nan' AS DOUBLE) WHEN event_id % 7 = 2 THEN CAST('inf' AS DOUBLE) WHEN event_id % 7 = 3 THEN CAST('-inf' AS DOUBLE) ELSE value END"


@_query(
    "row_json_sparse",
    "SELECT event_id, " + S.row(("event_id", S.whole("event_id")), ("v", S.finite("v")), ("kind", S.quoted("kind")), ("flag", S.boolean("flag"))) + f" AS json FROM (SELECT event_id, {_SPARSE} AS v, CASE WHEN event_id % 5 > 0 THEN event_type END AS kind, CASE WHEN event_id % 3 > 0 THEN event_id % 2 = 0 END AS flag FROM events)",
)
def _(spark, t):
    k = F.col("event_id")
    df = t("events", "event_id").select(k, F.expr(_SPARSE).alias("v"), F.when(k % 5 > 0, F.col("event_type")).alias("kind"), F.when(k % 3 > 0, k % 2 == 0).alias("flag"))
    return row_json(df, keep=["event_id"])


for _table, _id, _texts in (("documents", "doc_id", ("text", "lang", "source")), ("pages", "page_id", ("url", "html")), ("conversations", "conv_id", ("role", "text"))):

    def _escapes(spark, t, table=_table, id=_id, texts=_texts):
        return row_json(t(table, id).select(id, *texts), keep=[id])

    _query(f"string_escape_{_table}", f"SELECT {_id}, " + S.row((_id, S.whole(_id)), *((x, S.quoted(x)) for x in _texts)) + f" AS json FROM {_table}")(_escapes)


@_query("timestamp_auto", f"SELECT o_orderkey, {S.row(('o_orderkey', S.whole('o_orderkey')), ('o_orderdate', S.stamp('o_orderdate', '%Y-%m-%d')))} AS json FROM orders")
def _(spark, t):
    """All order dates are midnights, so the shortest pattern is the date's."""
    return row_json(t("orders").select("o_orderkey", "o_orderdate"), keep=["o_orderkey"])


@_query("timestamp_full", f"SELECT event_id, {S.row(('event_id', S.whole('event_id')), ('ts', S.stamp('ts')))} AS json FROM events")
def _(spark, t):
    return row_json(t("events").select("event_id", "ts"), keep=["event_id"])


@_query("date_cell", f"SELECT event_id, {S.row(('event_id', S.whole('event_id')), ('day', S.stamp('CAST(ts AS DATE)', '%Y-%m-%d')))} AS json FROM events")
def _(spark, t):
    return row_json(t("events").select("event_id", F.to_date("ts").alias("day")), keep=["event_id"])


@_query(
    "factor_decode",
    "SELECT o_orderkey, " + S.row(("o_orderkey", S.whole("o_orderkey")), ("status", S.quoted("CASE o_orderkey % 5 WHEN 1 THEN 'low' WHEN 2 THEN 'mid' WHEN 3 THEN 'NA' END"))) + " AS json FROM orders",
)
def _(spark, t):
    df = t("orders").select("o_orderkey", factor_level(F.col("o_orderkey") % 5, ["low", "mid", None]).alias("status"))
    return row_json(df, keep=["o_orderkey"])


_RARE = "CAST((CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '' END) || (o_custkey % 997 + 1) || 'e' || (o_orderkey % 61 - 30) AS DOUBLE)"


@_query("number_rare", f"SELECT o_orderkey, {S.row(('x', S.shortest_number('x')), ('y', S.shortest_number('y')))} AS json FROM (SELECT o_orderkey, {_RARE} AS x, {_RARE.replace('% 61 - 30', '% 600 - 300')} AS y FROM orders)")
def _(spark, t):
    """Numbers of all sizes, from 1e-300 to 1e302, most of them outside of the usual range."""
    sign = F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise("")
    of = lambda n: F.concat(sign, F.col("o_custkey") % 997 + 1, F.lit("e"), F.col("o_orderkey") % n - n // 2).cast("double")
    return row_json(t("orders").select("o_orderkey", of(61).alias("x"), of(600).alias("y")), keep=["o_orderkey"], leave_out=["o_orderkey"])


_ODD_KEYS = {'sp ace': "n_nationkey", 'quote"d': "n_regionkey", "back\\slash": "n_nationkey + 1", "uni\u00e7ode.x": "n_nationkey + 2", "line\nbreak\t": "n_nationkey + 3", "`tick`": "n_nationkey + 4"}
_ODD_TEXT = ['"sp ace":', '"quote\\"d":', '"back\\\\slash":', '"uni\u00e7ode.x":', '"line\\u000Abreak\\u0009":', '"`tick`":']


@_query("odd_keys", "SELECT n_nationkey, '{' || " + " || ',' || ".join(f"'{k}' || ({x})" for k, x in zip(_ODD_TEXT, _ODD_KEYS.values(), strict=True)) + " || '}' AS json FROM nation")
def _(spark, t):
    return row_json(t("nation").select("n_nationkey", *(F.expr(x).alias(k) for k, x in _ODD_KEYS.items())), keep=["n_nationkey"], leave_out=["n_nationkey"])


@_query("unsupported_column", f"SELECT n_nationkey, {S.row(('n_nationkey', S.whole('n_nationkey')), ('n_name', S.quoted('n_name')))} AS json, '{{}}' AS alone, '[{{}},{{}}]' AS listed FROM nation")
def _(spark, t):
    """Bytes have no text: such a column is left out, and such a value by itself or in a list is an empty object."""
    df = t("nation").select("n_nationkey", "n_name", F.col("n_name").cast("binary").alias("raw"))
    two = F.array(F.col("raw"), F.col("raw"))
    kinds = df.select(two.alias("two")).schema["two"].dataType
    return row_json(df, keep=["n_nationkey", value_json(F.col("raw"), kinds.elementType).alias("alone"), value_json(two, kinds).alias("listed")])


@_query("timestamp_minutes", f"SELECT event_id, {S.row(('event_id', S.whole('event_id')), ('ts', S.stamp("date_trunc('minute', ts)", '%Y-%m-%d %H:%M')))} AS json FROM events")
def _(spark, t):
    return row_json(t("events").select("event_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts")), keep=["event_id"])


@_query("row_names", f"SELECT n_nationkey, {S.row(('n_nationkey', S.whole('n_nationkey')), ('n_regionkey', S.whole('n_regionkey')), ('_row', S.quoted('n_name')))} AS json FROM nation")
def _(spark, t):
    return row_json(t("nation"), keep=["n_nationkey"], row_name_col="n_name")


# Documents

_REGION = S.row(("r_regionkey", S.whole("r_regionkey")), ("r_name", S.quoted("r_name")))


@_query("json_array_region", f"SELECT '[' || string_agg({_REGION}, ',' ORDER BY r_regionkey) || ']' AS json FROM region")
def _(spark, t):
    return to_json_array(t("region"), "r_regionkey")


@_query("json_array_orders", f"SELECT '[' || string_agg({S.row(*_ORDERS)}, ',' ORDER BY o_orderkey) || ']' AS json FROM orders")
def _(spark, t):
    return to_json_array(t("orders"), "o_orderkey", timestamp_format=FULL_TIMESTAMP, ranges=8)


@_query("json_array_by_customer", f"SELECT o_custkey, '[' || string_agg({S.row(*[p for p in _ORDERS if p[0] != 'o_custkey'])}, ',' ORDER BY o_orderkey) || ']' AS json FROM orders GROUP BY o_custkey")
def _(spark, t):
    return to_json_array(t("orders"), "o_orderkey", by=["o_custkey"], timestamp_format=FULL_TIMESTAMP)


@_query("empty_table", "SELECT '[]' AS json")
def _(spark, t):
    return to_json_array(t("region").where("false"), "r_regionkey")


@_query("empty_columns", "SELECT '[' || string_agg('{}', ',') || ']' AS json FROM region")
def _(spark, t):
    return to_json_array(t("region").select())


# Vectors and matrices

_PRICES = "list(CASE WHEN l_linenumber % 5 = 0 THEN NULL WHEN l_linenumber % 5 = 4 THEN CAST('nan' AS DOUBLE) WHEN l_linenumber % 5 = 3 THEN CAST('-inf' AS DOUBLE) WHEN l_linenumber % 5 = 2 THEN CAST('inf' AS DOUBLE) ELSE l_extendedprice END ORDER BY l_linenumber, l_partkey, l_extendedprice)"


def _grouped(df: DataFrame, value, name: str = "v") -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", value.alias(name))))
    return df.groupBy("l_orderkey").agg(F.transform(items, lambda x: x[name]).alias(name))


def _vector_twin(items: str, text: str) -> str:
    return f"SELECT l_orderkey, {S.row(('v', S.vector('v', text)))} AS json FROM (SELECT l_orderkey, {items} AS v FROM lineitem GROUP BY l_orderkey)"


@_query("vector_double", _vector_twin(_PRICES, S.vector_number()))
def _(spark, t):
    k = F.col("l_linenumber") % 5
    value = F.when(k == 0, None).when(k == 4, float("nan")).when(k == 3, float("-inf")).when(k == 2, float("inf")).otherwise(F.col("l_extendedprice"))
    return row_json(_grouped(t("lineitem"), value), keep=["l_orderkey"], leave_out=["l_orderkey"])


_ORDER = "ORDER BY l_linenumber, l_partkey, l_extendedprice"


@_query("vector_int", _vector_twin(f"list(CASE WHEN l_linenumber <> 2 THEN l_linenumber END {_ORDER})", S.whole("x")))
def _(spark, t):
    return row_json(_grouped(t("lineitem"), F.when(F.col("l_linenumber") != 2, F.col("l_linenumber"))), keep=["l_orderkey"], leave_out=["l_orderkey"])


@_query("vector_lgl", _vector_twin(f"list(CASE WHEN l_linenumber <> 2 THEN l_quantity > 25 END {_ORDER})", S.boolean("x")))
def _(spark, t):
    return row_json(_grouped(t("lineitem"), F.when(F.col("l_linenumber") != 2, F.col("l_quantity") > 25)), keep=["l_orderkey"], leave_out=["l_orderkey"])


@_query("vector_chr", _vector_twin(f"list(CASE WHEN l_linenumber <> 2 THEN l_returnflag || '\"' END {_ORDER})", S.quoted("x")))
def _(spark, t):
    return row_json(_grouped(t("lineitem"), F.when(F.col("l_linenumber") != 2, F.concat("l_returnflag", F.lit('"')))), keep=["l_orderkey"], leave_out=["l_orderkey"])


@_query("vector_date", _vector_twin(f"list(CASE WHEN l_linenumber <> 2 THEN CAST(l_shipdate AS DATE) END {_ORDER})", S.stamp("x", "%Y-%m-%d")))
def _(spark, t):
    return row_json(_grouped(t("lineitem"), F.when(F.col("l_linenumber") != 2, F.to_date("l_shipdate"))), keep=["l_orderkey"], leave_out=["l_orderkey"])


@_query("vector_timestamp", _vector_twin(f"list(CASE WHEN l_linenumber <> 2 THEN l_shipdate END {_ORDER})", S.stamp("x")))
def _(spark, t):
    return row_json(_grouped(t("lineitem"), F.when(F.col("l_linenumber") != 2, F.col("l_shipdate"))), keep=["l_orderkey"], leave_out=["l_orderkey"])


@_query("vector_factor", _vector_twin(f"list(CASE l_linenumber % 4 WHEN 1 THEN 'low' WHEN 2 THEN 'NA' WHEN 3 THEN 'a\"b' END {_ORDER})", S.quoted("x")))
def _(spark, t):
    return row_json(_grouped(t("lineitem"), factor_level(F.col("l_linenumber") % 4, ["low", None, 'a"b'])), keep=["l_orderkey"], leave_out=["l_orderkey"])


_EMBEDDED = "list_transform(embedding, lambda y: round(CAST(y AS DOUBLE) * 4096) / 64)"
_EIGHTS = f"list_transform(range(8), lambda r: ({_EMBEDDED})[r * 8 + 1 : r * 8 + 8])"


def _rounded(c):
    """Multiples of 1/64: both engines print them alike. Halves are rounded away from zero."""
    return F.transform(c, lambda y: F.round(y.cast("double") * 4096) / 64)


@_query("vector_float", f"SELECT vec_id, {S.row(('v', S.vector(_EMBEDDED, S.vector_number())))} AS json FROM embeddings")
def _(spark, t):
    return row_json(t("embeddings").select("vec_id", _rounded("embedding").alias("v")), keep=["vec_id"], leave_out=["vec_id"])


_MATRIX = "'[' || array_to_string(list_transform(" + _EIGHTS + ", lambda r: '[' || array_to_string(list_transform(r, lambda x: " + S.vector_number() + "), ',') || ']'), ',') || ']'"


@_query("matrix_standalone", f"SELECT vec_id, {_MATRIX} AS json FROM embeddings")
def _(spark, t):
    rows = t("embeddings").select("vec_id", _rounded("embedding").alias("v"))
    rows = rows.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("v", r * 8 + 1, F.lit(8))).alias("m"))
    return rows.select("vec_id", value_json(F.col("m"), rows.schema["m"].dataType).alias("json"))


@_query("matrix_by_column", "SELECT vec_id, " + _MATRIX.replace(_EIGHTS, f"list_transform(range(8), lambda r: list_transform(range(8), lambda k: ({_EMBEDDED})[k * 8 + r + 1]))") + " AS json FROM embeddings")
def _(spark, t):
    rows = t("embeddings").select("vec_id", _rounded("embedding").alias("v"))
    item = rows.schema["v"].dataType.elementType
    return rows.select("vec_id", matrix(F.col("v"), item, F.lit(8), F.lit(8)).alias("json"))


@_query("matrix_column", f"SELECT vec_id, {S.row(('m', S.vector(_EMBEDDED, '(CASE WHEN x > 0 THEN ' + S.number('x') + ' END)')))} AS json FROM embeddings")
def _(spark, t):
    df = t("embeddings").select("vec_id", F.transform(_rounded("embedding"), lambda x: F.when(x > 0, x).otherwise(float("nan"))).alias("m"))
    return row_json(df, keep=["vec_id"], leave_out=["vec_id"], matrix_cols=["m"])


# Lists

_NESTED = "'[' || string_agg('{\"n\":' || l_linenumber || ',\"q\":' || coalesce(" + S.number("CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END") + ", 'null') || ',\"f\":' || coalesce(" + S.quoted("CASE WHEN l_linenumber % 3 > 0 THEN l_returnflag END") + ", 'null') || '}', ',' ORDER BY l_linenumber, l_partkey, l_extendedprice) || ']'"


@_query("nested_table", f"SELECT l_orderkey, '{{\"lines\":' || {_NESTED} || '}}' AS json FROM lineitem GROUP BY l_orderkey")
def _(spark, t):
    k = F.col("l_linenumber")
    item = F.struct(k.alias("n"), F.when(k % 2 == 0, F.col("l_quantity")).alias("q"), F.when(k % 3 > 0, F.col("l_returnflag")).alias("f"))
    return row_json(_grouped(t("lineitem"), item, "lines"), keep=["l_orderkey"], leave_out=["l_orderkey"])


_NAMED = S.row(("k", S.box(S.whole("c_custkey"))), ("v", S.box(f"coalesce({S.finite('v')}, '\"NA\"')")), ("s", S.box(S.quoted("c_mktsegment"))))


@_query("named_list", f"SELECT c_custkey, {S.row(('o', _NAMED))} AS json FROM (SELECT *, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS v FROM customer)")
def _(spark, t):
    o = F.struct(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("v"), F.col("c_mktsegment").alias("s"))
    return row_json(t("customer").select("c_custkey", o.alias("o")), keep=["c_custkey"], leave_out=["c_custkey"])


@_query("unnamed_list", f"SELECT c_custkey, '[[' || c_custkey || '],[' || c_custkey || ',' || c_nationkey || '],[]]' AS json FROM customer")
def _(spark, t):
    k = F.col("c_custkey")
    rows = t("customer").select(k, F.array(F.array(k), F.array(k, F.col("c_nationkey").cast("long")), F.array().cast("array<bigint>")).alias("x"))
    return rows.select("c_custkey", value_json(F.col("x"), rows.schema["x"].dataType).alias("json"))


@_query("mixed_list", "SELECT c_custkey, '[[' || c_custkey || '],[\"a\\u000Ab\"],[\"NA\"],[1,2],{\"k\":[true],\"l\":[\"NA\"]}]' AS json FROM customer")
def _(spark, t):
    """A list of several kinds, as a variant."""
    text = F.concat(F.lit("["), F.col("c_custkey"), F.lit(',"a\\nb",null,[1,2],{"l":null,"k":true}]'))
    rows = t("customer").select("c_custkey", F.parse_json(text).alias("v"))
    return rows.select("c_custkey", value_json(F.col("v"), rows.schema["v"].dataType).alias("json"))


@_query("map_object", "SELECT c_custkey, '{\"a\":[' || c_nationkey || '],\"b\":[\"NA\"]}' AS json FROM customer")
def _(spark, t):
    rows = t("customer").select("c_custkey", F.create_map(F.lit("b"), F.lit(None).cast("int"), F.lit("a"), F.col("c_nationkey")).alias("m"))
    return rows.select("c_custkey", value_json(F.col("m"), rows.schema["m"].dataType).alias("json"))


@_query("obj_scalar_null", "SELECT '{}' AS json, '[]' AS empty, '{}' AS nothing")
def _(spark, t):
    x, y = F.lit(None).cast("array<int>"), F.array().cast("array<int>")
    kind = spark.range(1).select(y.alias("y")).schema["y"].dataType
    return spark.range(1).select(value_json(x, kind).alias("json"), value_json(y, kind).alias("empty"), F.lit(as_json(None)).alias("nothing"))


# Unboxing

_SIZED = "list_transform(range(l_linenumber % 3), lambda i: l_partkey + i)"


@_query("unbox_vectors", "SELECT l_orderkey, l_linenumber, " + S.unbox(S.row(("p", S.vector(_SIZED, S.whole("x"))), ("s", S.vector("[l_returnflag || ']']", S.quoted("x"))))) + " AS json FROM lineitem")
def _(spark, t):
    n = (F.col("l_linenumber") % 3).cast("int")
    p = F.transform(F.slice(F.array(F.lit(0), F.lit(1)), 1, n), lambda i: F.col("l_partkey") + i)
    df = t("lineitem", "l_orderkey").select("l_orderkey", "l_linenumber", p.alias("p"), F.array(F.concat("l_returnflag", F.lit("]"))).alias("s"))
    return row_json(df, keep=["l_orderkey", "l_linenumber"], leave_out=["l_orderkey", "l_linenumber"], auto_unbox=True)


@_query("unbox_nested", "SELECT c_custkey, '[' || c_custkey || ']' AS json, '{\"a\":' || c_custkey || ',\"b\":{\"c\":\"x[1]\"}}' AS object FROM customer")
def _(spark, t):
    k = F.col("c_custkey")
    rows = t("customer").select(k, F.array(F.array(k)).alias("x"), F.struct(k.alias("a"), F.struct(F.lit("x[1]").alias("c")).alias("b")).alias("o"))
    return rows.select("c_custkey", *(unbox(value_json(F.col(c), rows.schema[c].dataType)).alias(n) for c, n in (("x", "json"), ("o", "object"))))


# Geometries of suppliers and customers: multiples of an eighth of their keys

_X, _Y = "(s_suppkey % 360 - 180 + 0.125)", "(s_nationkey * 2.5 - 30)"


def _p(dx: float, dy: float) -> str:
    return f"'[' || {S.coordinate(f'{_X} + {dx}')} || ',' || {S.coordinate(f'{_Y} + {dy}')} || ']'"


_P = {(dx, dy): _p(dx, dy) for dx in (0, 1, 2) for dy in (0, 1, 2)}
_LINE = f"'[' || {_P[0, 0]} || ',' || {_P[1, 1]} || ']'"
_RING = f"'[' || {_P[0, 0]} || ',' || {_P[1, 0]} || ',' || {_P[1, 1]} || ',' || {_P[0, 0]} || ']'"
_HOLED = f"'[' || {_RING} || ',' || {_RING} || ']'"
_SHAPES = {
    "Point": _P[0, 0], "MultiPoint": _LINE, "LineString": _LINE, "MultiLineString": f"'[' || {_LINE} || ',' || {_RING} || ']'", "Polygon": _HOLED, "MultiPolygon": f"'[' || {_HOLED} || ',[' || {_RING} || ']]'",
}


def _shape(kind: str) -> str:
    return f"""('{{"type":"{kind}","coordinates":' || {_SHAPES[kind]} || '}}')"""


def _geometries() -> dict:
    x = (F.col("s_suppkey") % 360 - 180 + F.lit(0.125)).cast("double")
    y = F.col("s_nationkey") * F.lit(2.5) - 30
    p = lambda dx, dy: F.array(x + dx, y + dy)
    line = F.array(p(0, 0), p(1, 1))
    ring = F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 0))
    holed = F.array(ring, ring)
    return {
        "Point": G.point(x, y), "MultiPoint": G.multipoint(line), "LineString": G.linestring(line), "MultiLineString": G.multilinestring(F.array(line, ring)), "Polygon": G.polygon(holed), "MultiPolygon": G.multipolygon(F.array(holed, F.array(ring))),
    }


def _feature(shape: str) -> str:
    body = S.row(("s_suppkey", S.whole("s_suppkey")), ("s_acctbal", S.number("s_acctbal")))
    return f"""('{{"type":"Feature","properties":' || {body} || ',"geometry":' || {shape} || '}}')"""


def _features(spark, t, geometry) -> DataFrame:
    return t("supplier").select("s_suppkey", "s_acctbal", geometry.alias("geometry"))


for _kind in _SHAPES:

    def _one(spark, t, kind=_kind):
        return feature_json(_features(spark, t, _geometries()[kind]), "geometry", keep=["s_suppkey"], kinds=[kind])

    _query(f"geo_{_kind.lower()}", f"SELECT s_suppkey, {_feature(_shape(_kind))} AS json FROM supplier")(_one)

_MIXED = "CASE s_suppkey % 8 " + " ".join(f"WHEN {k} THEN {_shape(kind)}" for k, kind in enumerate(_SHAPES)) + " ELSE 'null' END"


def _mixed_geometry():
    of = F.lit(None)
    for k, g in enumerate(_geometries().values()):
        of = F.when(F.col("s_suppkey") % 8 == k, g).otherwise(of)
    other = F.struct(F.lit("GeometryCollection").alias("kind"), _geometries()["Point"]["parts"].alias("parts"))
    return F.when(F.col("s_suppkey") % 8 == 6, other).otherwise(of)


@_query("geo_mixed", f"SELECT s_suppkey, {_feature(_MIXED)} AS json FROM supplier")
def _(spark, t):
    """All six kinds, a kind that isn't supported, and null."""
    return feature_json(_features(spark, t, _mixed_geometry()), "geometry", keep=["s_suppkey"])


@_query("geo_null", "SELECT s_suppkey, " + _feature("'null'") + " AS json FROM supplier")
def _(spark, t):
    nan = F.lit(float("nan"))
    return feature_json(_features(spark, t, F.when(F.col("s_suppkey") % 2 == 0, G.point(nan, nan))), "geometry", keep=["s_suppkey"])


@_query("geo_unsound", "SELECT s_suppkey, " + _feature(f"CASE WHEN s_suppkey % 4 = 0 THEN {_shape('MultiPolygon')} WHEN s_suppkey % 4 = 3 THEN {_shape('LineString')} ELSE 'null' END") + " AS json FROM supplier")
def _(spark, t):
    """Geometries with a coordinate that is missing or not finite are null, whatever their kind."""
    k = F.col("s_suppkey") % 4
    bad = F.when(k == 1, F.lit(None).cast("double")).when(k == 2, float("inf"))
    x, y = (F.col("s_suppkey") % 360 - 180 + F.lit(0.125)).cast("double"), (F.col("s_nationkey") * F.lit(2.5) - 30).cast("double")
    p = lambda dx, dy: F.array(x + dx, y + dy)
    last = F.array(x + 1, F.when(k.isin(0, 3), y + 1).otherwise(bad))
    line, ring = F.array(p(0, 0), last), F.array(p(0, 0), p(1, 0), last, p(0, 0))
    shape = F.when(k == 3, G.linestring(line)).otherwise(G.multipolygon(F.array(F.array(ring, ring), F.array(ring))))
    return feature_json(_features(spark, t, shape), "geometry", keep=["s_suppkey"])


_PLACES = S.row(("s_suppkey", S.whole("s_suppkey")), ("s_name", S.quoted("s_name")), ("n_name", S.quoted("n_name")))


def _places(spark, t) -> DataFrame:
    joined = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select("s_suppkey", "s_name", "n_name", _geometries()["Point"].alias("geometry"))


_PLACE = f"""'{{"type":"Feature","properties":' || {_PLACES} || ',"geometry":' || {_shape('Point')} || '}}'"""
_FROM = "FROM supplier JOIN nation ON s_nationkey = n_nationkey"


@_query("feature_rows", f"SELECT s_suppkey, {_PLACE} AS json {_FROM}")
def _(spark, t):
    return feature_json(_places(spark, t), "geometry", keep=["s_suppkey"], kinds=["Point"])


@_query("feature_collection", f"""SELECT '{{"type":"FeatureCollection","features":[' || string_agg({_PLACE}, ',' ORDER BY s_suppkey) || ']}}' AS json {_FROM}""")
def _(spark, t):
    return to_geojson(_places(spark, t), "geometry", "s_suppkey", kinds=["Point"])


@_query("feature_collection_by_nation", f"""SELECT n_name, '{{"type":"FeatureCollection","features":[' || string_agg({_PLACE.replace(_PLACES, S.row(('s_suppkey', S.whole('s_suppkey')), ('s_name', S.quoted('s_name'))))}, ',' ORDER BY s_suppkey) || ']}}' AS json {_FROM} GROUP BY n_name""")
def _(spark, t):
    return to_geojson(_places(spark, t), "geometry", "s_suppkey", by=["n_name"], kinds=["Point"])


@_query("empty_spatial_table", "SELECT '[]' AS json")
def _(spark, t):
    return to_geojson(_places(spark, t).where("false"), "geometry", "s_suppkey")


@_query("as_json_table", f"SELECT '[' || string_agg({S.row(('n_nationkey', S.whole('n_nationkey')), ('n_name', S.quoted('n_name')), ('n_regionkey', S.whole('n_regionkey')))}, ',' ORDER BY n_nationkey) || ']' AS json FROM nation")
def _(spark, t):
    return as_json(t("nation"), order_by="n_nationkey")


@_query("document_format", "SELECT 'json' AS rows, 'geojson' AS features")
def _(spark, t):
    """What a document is, in its column's metadata."""
    of = lambda df: F.lit(df.schema["json"].metadata["format"])
    return spark.range(1).select(of(to_json_array(t("region"), "r_regionkey")).alias("rows"), of(to_geojson(_places(spark, t), "geometry", "s_suppkey")).alias("features"))


@_query(
    "input_errors",
    "SELECT * FROM (VALUES (1, 'Not a DataFrame'), (2, 'Not a spatial table (no column geometry)'), (3, 'Not a spatial table (r_name is no geometry)'), (4, 'column names must be unique: r_name')) AS e(k, error)",
)
def _(spark, t):
    region = t("region")
    wrong = [lambda: to_json_array([1]), lambda: to_geojson(region, "geometry"), lambda: feature_json(region, "r_name"), lambda: row_json(region.select("r_name", "r_name"))]
    found = []
    for k, call in enumerate(wrong, 1):
        try:
            call()
        except (TypeError, ValueError) as e:
            found.append((k, str(e)))
    return spark.createDataFrame(found, "k int, error string")
