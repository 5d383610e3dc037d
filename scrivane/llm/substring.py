"""Repeated passages: paragraph MinHash, banded for recall, verified by exact Jaccard, clustered by components; then runs inside paragraphs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm.cells import bucket_cells, dealt_cells
from scrivane.llm.common import by_value, fresh, materialise, row_key, small, text_of, tidy, whole_groups
from scrivane.llm.components import connected_components
from scrivane.llm.runs import PROBE, repeated_runs, without
from scrivane.llm.words import Words, in_a_row, mixed, powers, rows_of, slices

#: Shingle words, least Jaccard similarity, least words of a paragraph, hashes of a signature, least recall at the threshold.
WORDS, SIMILAR, LEAST_WORDS, HASHES, RECALL = 5, 0.8, 50, 64, 0.999
#: Paragraphs of a shard of a bucket; larger buckets are cut into cells.
SHARD = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tune_bands(hashes: int = HASHES, similar: float = SIMILAR, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, that still reach the recall at the threshold; and no more bands than that takes."""
    least = lambda r: math.ceil(math.log(1 - recall) / math.log(1 - similar**r))
    rows = max((r for r in range(1, hashes + 1) if least(r) * r <= hashes), default=1)
    return min(least(rows), hashes), rows


BANDS, ROWS = tune_bands()
_RANDOM = np.random.Generator(np.random.PCG64(20240501))
_A, _B = _RANDOM.integers(0, 2**31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1), _RANDOM.integers(0, 2**32, HASHES, np.uint32)


def band_keys(shingles: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The band keys of paragraphs, whose shingles are those from first to last: a row of BANDS for each."""
    if not len(first):
        return np.empty((0, BANDS), np.int64)
    x = np.append((shingles >> np.uint64(32)).astype(np.uint32), np.uint32(0))
    cuts = np.stack([first, last], 1).ravel()
    least = np.empty((BANDS * ROWS, len(first)), np.uint64)
    for k in range(BANDS * ROWS):
        least[k] = np.minimum.reduceat(x * _A[k] + _B[k], cuts)[::2]
    key = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(first), 1)
    for r in range(ROWS):
        key = (key ^ least[r::ROWS]) * _ODD
        key ^= key >> np.uint64(32)
    return key.T.view(np.int64)


def digests(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """128 bits for each paragraph: two hashes of all its words in order."""
    size = last - first
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    own = codes[place + np.repeat(first, size)]
    by = powers(int(size.max(initial=0)))[place]
    halves = [np.add.reduceat(x * by, begin) if len(begin) else np.empty(0, np.uint64) for x in (own, mixed(own))]
    joined = np.stack([mixed(halves[0] + size.astype(np.uint64)), halves[1]], 1)
    return pa.Array.from_buffers(pa.binary(16), len(first), [None, pa.py_buffer(np.ascontiguousarray(joined))]).cast(pa.binary())


def _lists(count: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), values)


PARAGRAPH = "unit int, para int, start int, length int, words int, digest binary, bands array<long>"
PROBES = "hash long, place int, unit int, last int"


def _scanned(least: int):
    """(row, text) to (row, paragraphs, probes), in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                n, p = part.num_rows, w.paragraphs(least)
                shingles, size = in_a_row(w.codes, WORDS), p["last"] - p["first"]
                start = w.points(p["start"], p["text"])
                columns = [p["unit"], p["para"], start, w.points(p["end"], p["text"]) - start, size]
                bands = _lists(np.full(len(size), BANDS), pa.array(band_keys(shingles, p["first"], p["last"] - WORDS + 1).ravel()))
                names = [x.split()[0] for x in PARAGRAPH.split(", ")]
                paragraphs = pa.StructArray.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), digests(w.codes, p["first"], p["last"]), bands], names)

                unit = np.full(len(w.codes), -1, np.int32)
                at = np.repeat(p["first"] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                unit[at] = np.repeat(p["unit"], size)
                places = w.probes(least, PROBE, shingles)
                own = np.searchsorted(w.bounds, places, "right") - 1
                columns = [rows_of(w.codes, places, PROBE).view(np.int64), (places - w.bounds[own]).astype(np.int32), unit[places], unit[places + PROBE - 1]]
                probes = pa.StructArray.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in PROBES.split(", ")])
                yield pa.RecordBatch.from_arrays([part.column("row"), _lists(np.bincount(p["text"], minlength=n), paragraphs), _lists(np.bincount(own, minlength=n), probes)], ["row", "paragraphs", "probes"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, text) to (class, hashes): the distinct shingles of a paragraph."""
    for batch in batches:
        for part in slices(batch, "text"):
            w = Words(part.column("text"))
            shingles = in_a_row(w.codes, WORDS)
            sets = [np.unique(shingles[a : b - WORDS + 1]).tobytes() for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("class"), pa.array(sets, pa.binary())], ["class", "hashes"])


def _verified(similar: float):
    def alike(x: frozenset, y: frozenset) -> bool:
        if min(len(x), len(y)) < similar * max(len(x), len(y)) - 1e-9:
            return False
        both = len(x & y)
        return both >= similar * (len(x) + len(y) - both) - 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links that join a cell's members into its components. Pairs that a link already joins aren't compared again."""
        for cells, cuts in whole_groups(batches, 3):
            lo, hi, side = (cells.column(i).to_numpy() for i in (1, 2, 3))
            classes, hashes = cells.column(4).to_pylist(), cells.column(5).to_pylist()
            a, b = [], []
            bounds = cuts.tolist() if cuts[-1] == cells.num_rows else [*cuts.tolist(), cells.num_rows]
            for s, e in zip(bounds, bounds[1:], strict=False):
                if e - s < 2:
                    continue
                across = lo[s] != hi[s]
                sets = [frozenset(np.frombuffer(h, np.uint64).tolist()) for h in hashes[s:e]]
                groups: list[list[int]] = []  # components so far; across a cell's two shards only members of unlike sides are compared
                for k, own in enumerate(sets):
                    joined, apart = [k], []
                    for g in groups:
                        if any(alike(sets[m], own) for m in g if not across or side[s + m] != side[s + k]):
                            joined = g + joined
                        else:
                            apart.append(g)
                    groups = [*apart, joined]
                for g in groups:
                    first = min(classes[s + k] for k in g)
                    for k in g:
                        if classes[s + k] != first:
                            a.append(classes[s + k]), b.append(first)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def repeated_passages(df: DataFrame, text: str = "text", id: str = "doc_id", least_words: int = LEAST_WORDS, similar: float = SIMILAR) -> DataFrame:
    """One row for each passage that is repeated, exactly or nearly: (row, id, kind, para, start, length, words,
    keeper, keeper_para, removed). kind is paragraph or run.

    A paragraph is a line of at least least_words (WORDS or more) words, or a stretch of shorter lines without a blank
    one between that have as many together; start and length are in code points, para counts lines from 0 and is that of
    the first line. Paragraphs that hold the same words are one class, joined by a 128-bit digest. Classes that share a
    MinHash band are candidates; links hold at Jaccard similar or more over five-word shingles, computed exactly;
    clusters are the components of links. In each cluster the first paragraph (by smallest id, nulls last, then row, then
    position) stays, whose id and number are keeper and keeper_para; the others are marked as removed. Paragraphs that
    one document repeats count too.

    A passage set into paragraphs of otherwise unlike text makes these no more similar, so what the removed paragraphs
    leave is searched for runs of least_words words or more that occur in two rows (runs.py). They stay in the first row;
    para is the line that a run begins in, and it may go on over several; keeper_para is null.

    df must be a reread table. Null texts are empty and have no paragraphs; repeated rows repeat their paragraphs; very
    long texts are read whole, a block at a time; an empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    if not WORDS <= PROBE <= least_words:
        raise ValueError(f"least_words must be {PROBE} or more")
    with tidy(df.sparkSession):
        return _passages(df, text, id, least_words, similar)


def _passages(df: DataFrame, text: str, id: str, least_words: int, similar: float) -> DataFrame:
    keyed = row_key(df.select(F.col(id).cast("long").alias("id"), text_of(text).alias("text")), "row")
    order = keyed.select("row", "id").orderBy(F.col("id").isNull(), "id", "row").withColumn("nth", F.monotonically_increasing_id())
    order = materialise(order, "order")
    scan = materialise(keyed.select("row", "text").mapInArrow(_scanned(least_words), f"row long, paragraphs array<struct<{PARAGRAPH}>>, probes array<struct<{PROBES}>>"), "scan")
    paras = scan.select("row", F.inline("paragraphs"))
    classes = paras.groupBy("digest").agg(F.min("bands").alias("bands"), F.min(F.struct("row", "para", "start", "length")).alias("at"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("class"), "*"), "classes")
    cells = materialise(bucket_cells(classes.select("class", F.explode("bands").alias("band")), "band", "class", SHARD), "cells")
    asked = materialise(cells.select("class").distinct(), "asked")
    where = materialise(classes.select("class", "at.row", "at.start", "at.length").join(small(asked), "class"), "places")
    texts = keyed.select("row", "text").join(small(where), "row").select("class", F.expr("substring(text, start + 1, length)").alias("text"))
    sets = materialise(texts.mapInArrow(_sets, "class long, hashes binary"), "sets")
    full = dealt_cells(cells.join(sets, "class").select("band", "lo", "hi", "side", "class", "hashes"), "band", "class")
    labels = materialise(connected_components(full.mapInArrow(_verified(similar), "a long, b long")), "labels")
    of = classes.select("class", "digest")
    labels = of.withColumnRenamed("class", "node").join(small(labels), "node").join(of.select(F.col("class").alias("label"), F.col("digest").alias("root")), "label")
    labels = materialise(labels.select("digest", "root"), "roots")

    found = paras.drop("bands").join(small(labels), "digest", "left").join(small(order), "row")
    found = found.select("nth", "row", "id", "unit", "para", "start", "length", "words", F.coalesce("root", "digest").alias("root"))
    found = materialise(found, "found")
    firsts = found.groupBy("root").agg(F.min(F.struct("nth", "unit", "id", "para")).alias("stays"), F.count("*").alias("n")).where("n > 1").drop("n")
    both = found.join(small(materialise(firsts, "firsts")), "root")
    removed = ~((F.col("nth") == F.col("stays.nth")) & (F.col("unit") == F.col("stays.unit")))
    both = both.withColumns({"kind": F.lit("paragraph"), "keeper": F.col("stays.id"), "keeper_para": F.col("stays.para"), "removed": removed})
    columns = ("row", "id", "kind", "para", "start", "length", "words", "keeper", "keeper_para", "removed")
    both = materialise(both.select(*columns, "unit"), "similar")
    runs = repeated_runs(keyed, order, scan.select("row", F.inline("probes")), both.where("removed").select("row", "unit"), least_words)
    return materialise(both.select(*columns).unionByName(runs.select(*columns)), "passages", lasting=True)


def _cut():
    @F.arrow_udf("string")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        return pa.array([None if t is None else without(t, [(r["start"], r["length"]) for r in k]) for t, k in zip(texts.to_pylist(), ranges.to_pylist(), strict=True)], pa.string())

    return cut


def drop_repeated_passages(df: DataFrame, text: str = "text", id: str = "doc_id", chars: str | None = None) -> DataFrame:
    """df without the passages marked as removed; rows of which no text is left go. chars: a column that holds the text's length."""
    row, gone_, text_ = (fresh(df, n) for n in ("_llm_row", "_llm_gone", "_llm_text"))
    with tidy(df.sparkSession):
        gone = repeated_passages(df, text, id).where("removed").groupBy("row").agg(F.collect_list(F.struct("start", "length")).alias(gone_))
        gone = materialise(gone.withColumnRenamed("row", row), "removals", lasting=True)
    both = row_key(df, row).join(small(gone), row, "left")
    whole = F.col(gone_).isNull()
    # Only texts that lose something go to Python.
    left = _cut()(F.when(~whole, F.col(f"`{text}`").cast("string")), F.col(gone_))
    both = both.withColumn(text_, left).withColumn(text_, F.when(whole, F.col(f"`{text}`")).otherwise(F.col(text_)))
    both = both.where(whole | F.col(text_).rlike(r"[^\x20\x09-\x0D]"))
    out = both.withColumn(text, F.col(text_))
    if chars:
        out = out.withColumn(chars, F.when(whole, F.col(chars)).otherwise(F.length(text).cast(df.schema[chars].dataType)))
    return out.select(*(F.col(f"`{c}`") for c in df.columns))


by_value(__name__)
