"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivane.llm.common import by_value, row_key, text_of

#: Permitted sequence lengths, in tokens of a byte-level vocabulary (one a byte, and one that ends a document).
CAPACITIES = (4096, 8192, 16384, 32768)
#: Documents that are packed together on average.
SHARD = 2048
#: A sequence costs its length, a fixed part and a part that grows with its square, as attention does.
FIXED, SQUARE = 64.0, 1 / 131072


def cost(capacity: int) -> float:
    return capacity + FIXED + SQUARE * capacity * capacity


def best_fit(lengths: list[int], capacities: tuple[int, ...], opening: int | None) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, content of each bin, capacity of each bin) by decreasing best fit.

    An item goes into the open bin that it leaves the least room in. If none has room, a bin is opened: of size opening
    (or the next that holds the item); or, with opening None, of the size that costs least for each token it can yet be
    filled with from what is left. Last, each bin is downsized to the smallest capacity that holds its content.
    """
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    left = sum(lengths)
    room: list[tuple[int, int]] = []  # (room, bin), sorted
    where, content = [0] * len(lengths), []
    for k in order:
        n = lengths[k]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            fits = [c for c in sizes if c >= n]
            free, b = next((c for c in fits if c >= opening), fits[-1]) if opening else min(fits, key=lambda c: (cost(c) / min(c, left), c)), len(content)
            content.append(0)
        where[k] = b
        content[b] += n
        left -= n
        if free > n:
            insort(room, (free - n, b))
    return where, content, [next(c for c in sizes if c >= n) for n in content]


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """The cheapest of best_fit's results over every way to open bins; of equal ones the first."""
    tries = [best_fit(lengths, capacities, c) for c in (None, *sorted(capacities))]
    return min(tries, key=lambda t: sum(map(cost, t[2])))


def _packed(capacities: tuple[int, ...]):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_pylist()
        where, _, sizes = pack(lengths, capacities)
        offset, used = [], [0] * len(sizes)
        for b, n in zip(where, lengths, strict=True):
            offset.append(used[b])
            used[b] += n
        shard = table.column("shard")[0].as_py()
        bins = {"bin_id": [(shard << 24) + b for b in where], "capacity": [sizes[b] for b in where], "filled": [used[b] for b in where], "offset": offset}
        out = table.drop_columns(["shard"])
        for name, values in bins.items():
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return run


def pack_documents(df: DataFrame, text: str = "text", id: str = "doc_id", length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, shard: int = SHARD) -> DataFrame:
    """One row for each piece of a document: (doc_id, row, piece, start, length, bin_id, capacity, filled, offset).

    length: tokens of a document with its end mark, as operator 8 counts them for one; by default its UTF-8 bytes and one, the
    tokens of a byte vocabulary. A length that is null or below 1 counts as 1, the end mark. A document longer than the
    largest capacity is cut into pieces of that capacity and the rest; start is where a piece begins in it. Nothing is
    dropped. bin_id, offset and capacity say where a piece lies, filled how much of the bin is used.

    Pieces are dealt at random into shards of shard documents on average, each packed on its own; a shard's loss is at most
    a few bins not full, which are downsized. Of equal lengths the first row and piece is packed first, of bins with equal
    room it goes into the one opened first, and of ways to open bins that cost the same the first counts. Null texts are empty documents (their end mark only), repeated rows are
    packed each, an empty table gives an empty result, other columns are ignored, whatever their names. df must be a reread table.
    """
    most = max(capacities)
    size = F.greatest(F.coalesce((F.octet_length(text_of(text)) + 1 if length is None else length).cast("long"), F.lit(1)), F.lit(1))
    keyed = row_key(df.select(F.col(f"`{id}`").alias("doc_id"), size.alias("total")), "row")
    pieces = keyed.select("doc_id", "row", "total", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / most) - 1, F.lit(0)).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * most
    shards = max(1, -(-df.count() // shard))
    items = pieces.select("doc_id", "row", "piece", start.alias("start"), F.least(F.lit(most), F.col("total") - start).alias("length"), F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"))
    kind = next(f.dataType.simpleString() for f in items.schema if f.name == "doc_id")
    return items.groupBy("shard").applyInArrow(_packed(tuple(capacities)), f"doc_id {kind}, row long, piece int, start long, length long, bin_id long, capacity long, filled long, offset long")


by_value(__name__)
