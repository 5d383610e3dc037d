"""Byte-level BPE over overlapping chunks: pre-tokenise chunks in parallel, stitch them where their boundaries meet, encode the pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm import vocabulary
from scrivane.llm.common import by_value, row_key, text_of

#: Code points of a chunk, and of what it shares with the next. Longer texts are cut into chunks.
CHUNK, OVERLAP = 32768, 1024
#: A match that ends less far from the end of a chunk may end elsewhere in the whole text ('re, 've, 'll look that far ahead).
AHEAD = 4
#: Pieces whose ids a task keeps at a time.
KEPT_PIECES = 200_000


class Codec:
    """Encodes pre-tokens one by one, keeping those that recur; decodes ids to bytes."""

    def __init__(self, file: str, pattern: str):
        table = vocabulary.ranks(file)
        self.matches = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes_of = {i: b for b, i in table.items()}
        self.kept: dict[str, tuple[int, ...]] = {}

    def ends(self, text: str) -> list[int]:
        return [m.end() for m in self.matches.finditer(text)]

    def encode(self, pieces: list[str]) -> list[int]:
        kept, out = self.kept, []
        for p in pieces:
            ids = kept.get(p)
            if ids is None:
                if len(kept) >= KEPT_PIECES:
                    kept.clear()
                ids = tuple(self.encoding._core_bpe.encode_single_piece(p.encode("utf-8", "replace")))
                if len(p) <= 64:
                    kept[p] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Digests:
    """What a document's result needs of its ids, fed piece by piece: their count, and the hashes of ids and of decoded bytes."""

    def __init__(self):
        self.n, self.ids, self.decoded = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, codec: Codec, ids: list[int]) -> None:
        if ids:
            self.ids.update((("," if self.n else "") + ",".join(map(str, ids))).encode())
            self.decoded.update(codec.decode(ids))
            self.n += len(ids)

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.decoded.hexdigest()


class IdLists:
    """The ids themselves and the decoded bytes."""

    def __init__(self):
        self.ids, self.decoded = [], []

    def add(self, codec: Codec, ids: list[int]) -> None:
        self.ids += ids
        self.decoded.append(codec.decode(ids))

    def row(self) -> tuple[list[int], bytes]:
        return self.ids, b"".join(self.decoded)


SCHEMAS = {Digests: "n_tokens long, ids_sha256 string, decoded_sha256 string", IdLists: "ids array<int>, decoded binary"}
_ARROW = {Digests: (pa.int64(), pa.string(), pa.string()), IdLists: (pa.list_(pa.int32()), pa.binary())}
#: Results are passed on after so many rows.
ROWS = 128


def _batch(kind: type, keys: list, rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    columns = [pa.array(keys, key_type), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(_ARROW[kind]))]
    return pa.RecordBatch.from_arrays(columns, ["key", *(f"c{k}" for k in range(len(columns) - 1))])


def _whole(file: str, pattern: str, kind: type):
    """Encodes texts of one chunk: (key, text) to (key, result)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(file, pattern)
        for batch in batches:
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                rows = []
                for text in part.column(1).to_pylist():
                    out = kind()
                    out.add(codec, codec.encode(codec.matches.findall(text)))
                    rows.append(out.row())
                yield _batch(kind, part.column(0).to_pylist(), rows, part.schema.field(0).type)

    return run


def _boundaries(file: str, pattern: str):
    """(row, chunk, last, key, text) to the same and the ends of the chunk's pre-tokens, as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = regex.compile(pattern)
        for batch in batches:
            for part in (batch.slice(i, 16) for i in range(0, batch.num_rows, 16)):
                ends = [np.array([m.end() for m in matches.finditer(t)], np.int32).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ends, pa.binary())], [*part.schema.names, "ends"])

    return run


def stitch(held: str, ends: list[int], base: int, text: str, new_ends: list[int], at: int) -> int | None:
    """The first place in the whole text where a chunk and the next both have a pre-token boundary that the chunk's end can't move.

    held begins at base and has boundaries ends (places in the whole text); text begins at at, with boundaries new_ends in it.
    """
    trusted = base + len(held) - AHEAD
    new = {at, *(at + e for e in new_ends)}
    last = ends[-1] if ends else base
    return next((e for e in ends if e >= at and e <= trusted and e != last and e in new), None)


def _stitched(file: str, pattern: str, kind: type):
    """Chunks sorted by row and number to (key, result), holding a chunk or two at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(file, pattern)
        held, ends, base, start, out = "", [], 0, 0, kind()
        for batch in batches:
            keys, rows = [], []
            for r in batch.to_pylist():
                new = np.frombuffer(r["ends"], np.int32).tolist()
                at = r["chunk"] * CHUNK
                if r["chunk"] == 0:
                    held, ends, base, start, out = r["text"], new, 0, 0, kind()
                else:
                    meet = stitch(held, ends, base, r["text"], new, at)
                    if meet is None:  # no boundary in common: both are one chunk, pre-tokenised again from the last sure place
                        held, base = held[start - base :] + r["text"][base + len(held) - at :], start
                        ends = [base + e for e in codec.ends(held)]
                    else:
                        places = [start, *(e for e in ends if start < e <= meet)]
                        out.add(codec, codec.encode([held[a - base : b - base] for a, b in zip(places, places[1:], strict=False)]))
                        held, base, start = r["text"], at, meet
                        ends = [e for e in (at + x for x in new) if e > meet]
                if r["chunk"] == r["last"]:
                    places = [start, *(e for e in ends if e > start)]
                    out.add(codec, codec.encode([held[a - base : b - base] for a, b in zip(places, places[1:], strict=False)]))
                    keys.append(r["key"]), rows.append(out.row())
                    held, ends, out = "", [], kind()
            if keys:
                yield _batch(kind, keys, rows, batch.schema.field("key").type)

    return run


def encode(df: DataFrame, text: str = "text", id: str = "doc_id", file: str | None = None, pattern: str = vocabulary.PATTERN, kind: type = Digests) -> DataFrame:
    """One row for each row of df: its id and kind's result, by the ranks in file, without special tokens.

    kind IdLists gives the ids and the bytes they decode to, Digests their count and hashes. Texts of up to CHUNK code
    points are encoded where they are read. Longer ones are cut into chunks that share OVERLAP code points, dealt out
    and pre-tokenised in parallel; then each is put together again in order, chunk by chunk, at places where two
    chunks' boundaries meet, so that its pieces are those of the whole text. Where none meet, the chunks are joined.

    Null texts are empty (no ids); repeated rows are encoded each; an empty table gives an empty result; other columns
    are ignored, whatever their names. Decoded bytes are the text's UTF-8. df must be a reread table.
    """
    file = file or vocabulary.path("byte_bpe_multi_50k.tiktoken")
    own = df.select(F.col(f"`{id}`").alias("key"), text_of(text).alias("text"))
    key = own.schema["key"].dataType.simpleString()
    out = f"`{id}` {key}, {SCHEMAS[kind]}"
    long = F.length("text") > CHUNK
    short = own.where(~long).mapInArrow(_whole(file, pattern, kind), out)
    chunks = row_key(own, "row").where(long).withColumn("last", F.ceil((F.length("text") - OVERLAP) / CHUNK).cast("int") - 1)
    chunks = chunks.select("row", "key", "text", "last", F.explode(F.sequence(F.lit(0), "last")).alias("chunk"))
    chunks = chunks.select("row", "chunk", "last", "key", F.substring("text", F.col("chunk") * CHUNK + 1, F.when(F.col("chunk") == F.col("last"), F.lit(2**31 - 1)).otherwise(F.lit(CHUNK + OVERLAP))).alias("text"))
    found = chunks.repartition("row", "chunk").mapInArrow(_boundaries(file, pattern), f"row long, chunk int, last int, key {key}, text string, ends binary")
    whole = found.repartition("row").sortWithinPartitions("row", "chunk").mapInArrow(_stitched(file, pattern, kind), out)
    return short.unionByName(whole)


by_value(__name__)
by_value(vocabulary.__name__)
