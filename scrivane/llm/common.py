"""What several operators share: shared folders, size-checked joins, grouped streams of Arrow batches."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has been measured and has no more rows and bytes than this.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20

_own: dict[str, str] = {}
_made: list[list[str]] = []


def by_value(module: str) -> None:
    """Functions of the module travel with the tasks, so executors need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


#: Rows of a batch that goes to Python; texts may be long, and both sides of the pipe hold a batch or two outside of the heap.
BATCH_ROWS = 1000
_BATCH, _PARTS = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.minPartitionNum"


def settle(spark: SparkSession) -> None:
    """Sets what operators rely on for the session, where neither the session nor the application has set it: the size of
    batches for Python, and the number of partitions of a scan, which Spark else takes from the cores alive when a job is planned."""
    if not spark.sparkContext.getConf().contains(_BATCH) and spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if spark.conf.get(_PARTS, None) is None:
        spark.conf.set(_PARTS, str(spark.sparkContext.defaultParallelism))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Only a local session may do without: it gets a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    named = named or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = tempfile.mkdtemp(prefix="scrivane-")
        sc.setCheckpointDir(_own[sc.applicationId])
    return _own[sc.applicationId]


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/scrivane-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def clean(spark: SparkSession, path: str | None = None) -> None:
    """Deletes a folder that this session has written, by default all of them: results not yet written elsewhere go too."""
    root = f"{shared_dir(spark)}/scrivane-{spark.sparkContext.applicationId}"
    if path and not path.startswith(root):
        raise ValueError(f"not written by this session: {path}")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path or root)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, tag: str, path: str | None = None, lasting: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and a lost executor costs nothing that was written.

    Such tables stay until the tidy() around goes, but lasting ones, which the one around that one keeps; without any
    until clean() or until the folder goes, as results read them when they are used.
    """
    settle(df.sparkSession)
    path = path or scratch(df.sparkSession, tag)
    if len(_made) > lasting:
        _made[-1 - lasting].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that have been materialised within, but for lasting ones. What leaves it must read those only."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            clean(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def small(df: DataFrame, rows: int | None = None, most: int | None = None) -> DataFrame:
    """df, a written table, marked for broadcast if it has been measured to have few rows and bytes; else unchanged, for a shuffled join.

    Executors keep broadcasts until the driver happens to collect its garbage, so rounds that repeat (components) shuffle.
    """
    size = F.lit(8 * len(df.columns))
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("string", "binary"):
            size += F.coalesce(F.octet_length(c), F.lit(0))
        elif f.dataType.typeName() in ("array", "map"):
            size += (4 if f.dataType.simpleString() == "array<int>" else 32) * F.greatest(F.size(c), F.lit(0))
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= (BROADCAST_ROWS if rows is None else rows) and held <= (BROADCAST_BYTES if most is None else most) else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(df: DataFrame, name: str) -> DataFrame:
    """Adds a key that tells apart even equal rows. The same reread table gives the same keys; other plans raise ValueError.

    Keys follow the scan's partitions, whose number settle() fixes, so that a lost executor between two jobs changes no key.
    """
    settle(df.sparkSession)
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        kind, children = node.nodeName(), node.children()
        if not re.match("Project|Filter|SubqueryAlias|Relation|LogicalRelation|LocalRelation|DataSourceV2|View", kind):
            raise ValueError(f"rows of a plan with {kind} have no lasting keys; write it and read it again")
        todo += [children.apply(k) for k in range(children.size())]
    return df.withColumn(name, F.monotonically_increasing_id())


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by their first columns (longs without nulls), tables that hold whole groups, with the groups' bounds."""
    pending: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if pending is None else pa.concat_tables([pending, now])
        change = np.zeros(now.num_rows - 1, bool)
        for k in range(keys):
            x = now.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        cuts = np.flatnonzero(change) + 1
        if len(cuts):
            yield now.slice(0, int(cuts[-1])), np.concatenate([[0], cuts])
            now = now.slice(int(cuts[-1]))
        pending = now
    if pending is not None:
        yield pending, np.array([0, pending.num_rows])


def roots(n: int, links: Iterable[tuple[int, int]]) -> list[int]:
    """Of n nodes, the smallest that each can reach."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As roots, for links given as arrays; dense groups have very many."""
    label = np.arange(n)
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


by_value(__name__)
