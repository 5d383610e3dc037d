"""Near-duplicate documents: 64-bit SimHash fingerprints, linked by BK-trees within pigeonhole shards."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivane.llm.cells import bucket_cells, dealt_cells
from scrivane.llm.common import by_value, fresh, materialise, min_labels, row_key, small, text_of, tidy, whole_groups
from scrivane.llm.components import connected_components

WORDS, RADIUS, LEAF = 3, 3, 16
#: Members of a tree at most; a larger shard is cut into several trees, and every other one is searched from each.
TREE = 512
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bit k is set if it is set in over half the XXH64 hashes of the word shingles, repeats included."""
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return 0
    joined, at = b" ".join(parts), [0]
    for p in parts:
        at.append(at[-1] + len(p) + 1)
    n, digest = max(1, len(parts) - words + 1), xxhash.xxh64_intdigest
    last = min(words, len(parts))
    ones, total = np.zeros(64, np.int64), n
    for start in range(0, n, 65536):  # bounded memory for very long texts
        hashes = np.array([digest(joined[at[i] : at[i + last] - 1], 42) for i in range(start, min(n, start + 65536))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
            prints = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], ["id", "fp"])


class BKTree:
    """Over distinct 64-bit values; a node's children are keyed by their Hamming distance to it."""

    def __init__(self, values: np.ndarray, which: np.ndarray | None = None):
        which = np.arange(len(values)) if which is None else which
        self.values, self.pivot, rest = values, int(which[0]), which[1:]
        self.leaf, self.children = rest, {}
        if len(rest) > LEAF:
            far = np.bitwise_count(values[rest] ^ values[self.pivot])
            self.leaf = rest[:0]
            self.children = {int(d): BKTree(values, rest[far == d]) for d in np.unique(far)}

    def within(self, queries: np.ndarray, radius: int = RADIUS, which: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query positions, value positions) at up to radius, following only edges that can hold such values."""
        stack = [(self, np.arange(len(queries)) if which is None else which)]
        while stack:
            node, q = stack.pop()
            far = np.bitwise_count(queries[q] ^ self.values[node.pivot]).astype(np.int64)
            if (hit := q[far <= radius]).size:
                yield hit, np.full(hit.size, node.pivot)
            if node.leaf.size:
                a, b = np.nonzero(np.bitwise_count(queries[q][:, None] ^ self.values[node.leaf][None, :]) <= radius)
                if a.size:
                    yield q[a], node.leaf[b]
            for d, child in node.children.items():
                if (keep := q[np.abs(far - d) <= radius]).size:
                    stack.append((child, keep))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each cell, its members with the smallest member of the cell that they are linked to, over links inside it."""
    for cells, cuts in whole_groups(batches, 3):
        lo, hi, side = (cells.column(i).to_numpy() for i in (1, 2, 3))
        values = cells.column(4).to_numpy().view(np.uint64)
        a, b = [], []
        sizes = np.diff(np.append(cuts, cells.num_rows)) if cuts[-1] != cells.num_rows else np.diff(cuts)
        starts = cuts[: len(sizes)]
        two = starts[(sizes == 2) & (lo[starts] == hi[starts])]
        two = two[np.bitwise_count(values[two] ^ values[two + 1]) <= RADIUS]
        a.append(values[two]), b.append(values[two + 1])
        for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            across = lo[s] != hi[s]
            if n < 2 or n == 2 and not across:
                continue
            own = values[s : s + n]
            tree, ask = (np.flatnonzero(side[s : s + n] == k) for k in (0, 1)) if across else (np.arange(n),) * 2
            if not tree.size or not ask.size:
                continue
            found = [(ask[q], tree[v]) for q, v in BKTree(own[tree]).within(own[ask])]
            root = min_labels(n, *(np.concatenate([p[k] for p in found] or [ask[:0]]) for k in (0, 1)))
            moved = np.flatnonzero(root != np.arange(n))
            a.append(own[moved]), b.append(own[root[moved]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])


def shards(fp: Column) -> Column:
    """The ten keys of a fingerprint: the places and values of two of its five blocks."""
    block = [F.shiftrightunsigned(fp, 13 * k).bitwiseAND(F.lit(8191)) for k in range(5)]
    pairs = list(combinations(range(5), 2))
    return F.array(*(F.shiftleft(block[i], 13) + block[j] + F.lit(n << 26) for n, (i, j) in enumerate(pairs)))


def near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, fp, component): component is the smallest id that links of at most RADIUS differing bits reach.

    Two values that differ in at most three bits agree in two of five blocks; the values of two blocks, 25 or 26 bits, form
    the shards, each shard a BK-tree, searched by its own members. Trees are built where their rows have been dealt, not
    broadcast, as their size follows the corpus. Equal fingerprints are one node, so copies cost nothing. Very long texts
    are hashed a block of shingles at a time.

    Null texts are empty; texts without words get fingerprint zero and are linked like any other. Rows are kept as
    they are, repeated ones too; a null id takes part, and a component of null ids only is null. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    with tidy(df.sparkSession):
        prints = materialise(df.select(F.col(id).cast("long").alias("id"), text_of(text).alias("text")).mapInArrow(_fingerprints, "id long, fp long"), "prints")
        nodes = prints.groupBy("fp").agg(F.min("id").alias("first"))
        cells = bucket_cells(nodes.select("fp", F.explode(shards(F.col("fp"))).alias("shard")), "shard", "fp", TREE)
        labels = connected_components(dealt_cells(cells, "shard", "fp").mapInArrow(_links, "a long, b long"))
        grouped = materialise(nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("root")), "grouped")
        component = materialise(grouped.groupBy("root").agg(F.min("first").alias("component")), "component")
        of_print = materialise(grouped.select("fp", "root").join(component, "root").select("fp", "component"), "components")
        return materialise(prints.join(of_print, "fp").select("id", "fp", "component"), "near", lasting=True)


def hex64(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """df with one row of each component: that of the smallest id (nulls last, then the first row). df must be a reread table."""
    row = fresh(df, "_llm_row")
    keyed = row_key(df, row)
    with tidy(df.sparkSession):
        return _without(keyed, text, row, id)


def _without(keyed: DataFrame, text: str, row: str, id: str) -> DataFrame:
    found = near_duplicates(keyed, text, row)
    ids = materialise(found.select("id", "component").join(keyed.select(F.col(row).alias("id"), F.col(id).alias("doc")), "id"), "ids")
    order = F.struct(F.col("doc").isNull().alias("z"), F.col("doc").alias("doc"), F.col("id").alias("id"))
    groups = ids.groupBy("component").agg(F.min(order).alias("stays"), F.count("*").alias("n")).where("n > 1")
    groups = materialise(groups, "groups")
    gone = materialise(ids.join(groups, "component").where("id <> stays.id").select(F.col("id").alias(row)), "gone", lasting=True)
    return keyed.join(small(gone), row, "left_anti").drop(row)


by_value(__name__)
