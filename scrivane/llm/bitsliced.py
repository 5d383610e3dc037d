"""Exact top-k search by inner product over a bit-sliced index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivane.llm.common import by_value, materialise

SCALE, TOP = 256, 5
#: Rows of a block of the index at most; queries of a group on average at most; groups that small query sets are cut into.
BLOCK, GROUP, GROUPS = 65536, 16384, 16
#: Components of this size or more have many slices; rows with such ones stand in blocks of their own, of up to WIDE_BLOCK rows.
WIDE, WIDE_BLOCK = 2.0**40, 512
#: Blocks that one cell of the grid holds at most, so that queries are copied less often, and cells that there are before they do.
SPAN, CELLS = 8, 512
_WORD = np.uint64


def sound_rows(df: DataFrame, vector: str, id: str) -> DataFrame:
    """(id, x): the vectors as doubles, without rows that take no part."""
    own = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    return own.where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), in Python's integers where 64 bits might not hold it."""
    if not x.size or np.abs(x).max() < WIDE:
        return np.floor(x * SCALE).astype(np.int64)
    return np.array([math.floor(Fraction(v) * SCALE) for v in x.ravel().tolist()], object).reshape(x.shape)


def build(ids: np.ndarray, values: np.ndarray) -> dict:
    """A block: rows sorted by id; for each attribute its least value and the bit slices of what exceeds it."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    base = values.min(axis=0) if len(values) else np.zeros(values.shape[1], np.int64)
    above = values - base
    widths = np.array([int(m).bit_length() for m in above.max(axis=0)], np.int32)
    words = -(-len(ids) // 64)
    slices = np.zeros((int(widths.sum()), words * 8), np.uint8)
    k = 0
    for d, w in enumerate(widths.tolist()):
        for bit in range(w):
            packed = np.packbits((above[:, d] >> bit & 1).astype(np.uint8), bitorder="little")
            slices[k, : len(packed)] = packed
            k += 1
    return {"ids": ids, "base": [int(b) for b in base], "widths": widths, "slices": slices.view(_WORD)}


def digits(q: int) -> list[tuple[int, int]]:
    """q as a sum of few signed powers of two: (exponent, sign)."""
    out, k = [], 0
    while q:
        if q & 1:
            sign = 2 - (q & 3)
            out.append((k, sign))
            q -= sign
        q >>= 1
        k += 1
    return out


def weighted_sum(block: dict, query: np.ndarray) -> tuple[list[np.ndarray | None], int]:
    """The slices of each row's score less a constant, and the constant.

    Each digit of a query's component adds the attribute's slices, shifted; a negative one adds their complements, as
    -u = (2^w - 1 - u) - (2^w - 1). Slices of one weight go through carry-save adders, three to one and a carry.
    """
    n = min(len(query), len(block["widths"]))
    constant = sum(int(q) * b for q, b in zip(query[:n], block["base"][:n], strict=True))
    first = np.concatenate([[0], np.cumsum(block["widths"])])
    rows: dict[int, list[int]] = {}
    flips: dict[int, list[bool]] = {}
    for d in range(n):
        w = int(block["widths"][d])
        if not w:
            continue
        for k, sign in digits(int(query[d])):
            if sign < 0:
                constant -= ((1 << w) - 1) << k
            for bit in range(w):
                rows.setdefault(k + bit, []).append(int(first[d]) + bit)
                flips.setdefault(k + bit, []).append(sign < 0)
    out: list[np.ndarray | None] = []
    carried: list[np.ndarray] = []
    weight = 0
    while carried or any(k >= weight for k in rows):
        parts = carried
        carried = []
        if weight in rows:
            own = block["slices"][rows[weight]]
            own[np.array(flips[weight])] ^= ~_WORD(0)
            parts = [*parts, own]
        own = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else None
        while own is not None and len(own) > 1:
            m = len(own) // 3 * 3
            if m:
                a, b, c = own[0:m:3], own[1:m:3], own[2:m:3]
                half = a ^ b
                carried.append((a & b) | (half & c))
                own = np.concatenate([half ^ c, own[m:]]) if m < len(own) else half ^ c
            else:
                carried.append((own[:1] & own[1:]))
                own = own[:1] ^ own[1:]
        out.append(None if own is None else own[0])
        weight += 1
    return out, constant


def top(block: dict, query: np.ndarray, own_id: int, k: int = TOP) -> tuple[np.ndarray, list[int]]:
    """(ids, scores) of the k best rows whose id isn't own_id, from the highest slice down; ties to smaller ids."""
    n = len(block["ids"])
    slices, constant = weighted_sum(block, query)
    valid = np.packbits(block["ids"] != own_id, bitorder="little")
    tied = np.zeros(block["slices"].shape[1] * 8, np.uint8)
    tied[: len(valid)] = valid
    tied, sure = tied.view(_WORD), np.zeros(block["slices"].shape[1], _WORD)
    count = lambda x: int(np.bitwise_count(x).sum())
    have = 0
    for s in reversed(slices):
        if s is None:
            continue
        with_bit = tied & s
        more = count(with_bit)
        if have + more >= k:
            tied = with_bit
        else:
            sure, have, tied = sure | with_bit, have + more, tied & ~s
    unpack = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), count=n, bitorder="little"))
    found = np.concatenate([unpack(sure), unpack(tied)[: k - have]])  # ids are sorted, so the first tied rows have the smallest
    at, bit = found >> 6, (found & 63).astype(_WORD)
    scores = [constant] * len(found)
    for weight, s in enumerate(slices):
        if s is not None:
            for r in np.flatnonzero(s[at] >> bit & _WORD(1)):
                scores[r] += 1 << weight
    return block["ids"][found], scores


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def built(rows: tuple[list, list]) -> pa.RecordBatch:
        ids, held = rows
        x = np.zeros((len(held), max(map(len, held))))
        for r, v in enumerate(held):
            x[r, : len(v)] = v
        b = build(np.array(ids, np.int64), quantised(x))
        cells = [b["ids"].tobytes(), ",".join(map(str, b["base"])).encode(), b["widths"].tobytes(), b["slices"].tobytes()]
        found = pa.RecordBatch.from_arrays([pa.array([ids[0]]), *(pa.array([c], pa.binary()) for c in cells)], ["block", "ids", "base", "widths", "slices"])
        ids.clear(), held.clear()
        return found

    usual, wide = ([], []), ([], [])
    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = v.values.to_numpy()
            rows, most = (wide, WIDE_BLOCK) if x.size and np.abs(x).max() >= WIDE else (usual, BLOCK)
            rows[0].append(i), rows[1].append(x)
            if len(rows[0]) == most:
                yield built(rows)
    for rows in (usual, wide):
        if rows[0]:
            yield built(rows)


def _search(k: int):
    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        asked = [(i, quantised(np.array(v, np.float64))) for i, v in zip(queries.column("query_id").to_pylist(), queries.column("q").to_pylist(), strict=True)]
        for at in range(blocks.num_rows):
            r = blocks.slice(at, 1).to_pylist()[0]
            ids = np.frombuffer(r["ids"], np.int64)
            b = {"ids": ids, "base": [int(x) for x in r["base"].split(b",") if x], "widths": np.frombuffer(r["widths"], np.int32)}
            b["slices"] = np.frombuffer(r["slices"], _WORD).reshape(-1, -(-len(ids) // 64))
            for i, q in asked:
                found, scores = top(b, q, i, k)
                out[0].extend([i] * len(scores)), out[1].extend(found.tolist()), out[2].extend(scores)
        if max(out[2], default=0) >= 2**63:
            raise ValueError("a score among the highest doesn't fit a long")
        # Too low ones go on as nulls: they matter only if a query has too few others.
        scores = [s if s >= -(2**63) else None for s in out[2]]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), (out[0], out[1], scores), strict=True)})

    return run


def top_k(df: DataFrame, vector: str = "embedding", id: str = "vec_id", every: int = 50, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product for each row whose id is divisible by every.

    The index is built where the rows are read, in blocks of up to BLOCK rows. Blocks (SPAN together, if there are very
    many) and groups of queries are dealt onto a grid, whose cells are searched each on its own; only k rows a query and
    block are shuffled for the last ranking.

    Rows with a null id, a null vector, or a null or non-finite component take no part; all others do, however large. A
    score that is returned and doesn't fit a long is an error. A query's own are all rows of its id; of several query
    rows of one id the smallest vector asks. Repeated rows are candidates each. Shorter vectors count as filled up with
    zeros. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    own = sound_rows(df, vector, id)
    index = materialise(own.mapInArrow(_blocks, "block long, ids binary, base binary, widths binary, slices binary"), "index")
    asked = own.where(F.col("id") % every == 0).groupBy("id").agg(F.min("x").alias("q")).withColumnRenamed("id", "query_id")
    asked = materialise(asked, "asked")
    n_blocks, n_asked = max(1, index.count()), asked.count()
    groups = max(-(-n_asked // GROUP), min(GROUPS, -(-n_asked // 16)), 1)
    rows = -(-n_blocks // max(1, min(SPAN, n_blocks * groups // CELLS)))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = index.withColumn("row", F.pmod(F.xxhash64("block"), F.lit(rows))).withColumn("col", each(groups))
    right = asked.withColumn("col", F.pmod(F.xxhash64("query_id"), F.lit(groups))).withColumn("row", each(rows))
    found = left.groupBy("row", "col").cogroup(right.groupBy("row", "col")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "vec_id"))
    score = F.coalesce("score", F.raise_error(F.lit("a score among the highest doesn't fit a long")).cast("long"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


by_value(__name__)
