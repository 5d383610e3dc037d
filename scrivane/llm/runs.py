"""Runs of words that recur inside paragraphs of otherwise unlike text, where the paragraphs' similarity can't show them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivane.llm.common import by_value, materialise, small
from scrivane.llm.words import Words, rows_of, slices

#: Words of a probe.
PROBE = 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_WINDOWS = "nth long, place int, para int, start int, end int, hash long"


def _windows(least: int):
    """(nth, text, gone, hits) to each window of least words that holds a hit and no word of a paragraph that is gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                total, starts = len(w.codes), w.bounds[:-1]
                ends = np.repeat(w.bounds[1:], np.diff(w.bounds))
                hits = part.column("hits")
                own = np.repeat(np.arange(part.num_rows), hits.value_lengths().to_numpy(zero_copy_only=False))
                at = hits.flatten().to_numpy() + starts[own]
                marks = np.zeros(total + 1, np.int64)
                np.add.at(marks, np.maximum(starts[own], at + PROBE - least), 1)
                np.add.at(marks, at + 1, -1)
                wanted = np.cumsum(marks[:-1]) > 0
                wanted &= np.arange(total) + least <= ends
                gone = part.column("gone").to_pylist()
                if any(gone):
                    p = w.paragraphs(least)
                    out = np.array([bool(gone[t]) and u in gone[t] for t, u in zip(p["text"].tolist(), p["unit"].tolist(), strict=True)], bool)
                    np.add.at(bad := np.zeros(total + 1, np.int64), np.maximum(p["first"][out] - least + 1, 0), 1)
                    np.add.at(bad, p["last"][out], -1)
                    wanted &= np.cumsum(bad[:-1]) == 0
                at = np.flatnonzero(wanted)
                own = np.searchsorted(w.bounds, at, "right") - 1
                text, number, begin, _ = w.lines()
                line = np.searchsorted(begin, w.starts[at], "right") - 1
                columns = [part.column("nth").to_numpy()[own], (at - starts[own]).astype(np.int32), number[line].astype(np.int32), w.points(w.starts[at], own), w.points(w.ends[at + least - 1], own), rows_of(w.codes, at, least).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in _WINDOWS.split(", ")])

    return run


def repeated_runs(keyed: DataFrame, order: DataFrame, probes: DataFrame, gone: DataFrame, least: int) -> DataFrame:
    """(row, id, kind, para, start, length, words, keeper, keeper_para, removed) for each longest run of windows of least
    words that occur in two rows or more. What a row repeats for itself is left to the quality rules.

    keyed: (row, id, text); order: (row, id, nth), nth ascending by id; probes: (row, hash, place, unit, last), chosen by
    content so that any least words that recur hold one; gone: (row, unit), paragraphs that are no part of the search.
    Probes found in one row only are out; around the others all windows of least words are aggregated by 64-bit hashes.
    Those in the first row stay. Counts and minima are aggregated before they are shuffled; no pairs are made, so the
    work grows with the text.
    """
    shared = lambda df: df.groupBy("hash").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("hash")
    twice = materialise(shared(probes), "twice")
    hits = probes.join(small(twice), "hash")
    gone = materialise(gone, "gone")
    for unit in ("unit", "last"):
        hits = hits.join(small(gone.withColumnRenamed("unit", unit)), ["row", unit], "left_anti")
    hits = materialise(hits.select("row", "hash", "place"), "left")
    places = hits.join(small(materialise(shared(hits), "again")), "hash").groupBy("row").agg(F.collect_list("place").alias("hits"))
    units = gone.groupBy("row").agg(F.collect_list("unit").alias("gone"))
    places = materialise(places.join(units, "row", "left").join(small(order.drop("id")), "row"), "places")
    windows = keyed.select("row", "text").join(small(places), "row").select("nth", "text", "gone", "hits").mapInArrow(_windows(least), _WINDOWS)
    windows = materialise(windows, "windows")
    firsts = windows.groupBy("hash").agg(F.min("nth").alias("first"), F.max("nth").alias("high")).where("first < high").select("hash", "first")
    many = windows.join(materialise(firsts, "first-windows"), "hash").withColumn("removed", F.col("nth") > F.col("first"))
    own = Window.partitionBy("nth", "removed").orderBy("place")
    islands = many.withColumn("island", F.col("place") - F.row_number().over(own)).groupBy("nth", "removed", "island")
    runs = islands.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("para").alias("para"), F.count("*").alias("n"), F.min_by("first", "place").alias("first"))
    runs = materialise(runs, "runs")
    runs = runs.join(small(order), "nth").join(small(order.select(F.col("nth").alias("first"), F.col("id").alias("keeper"))), "first")
    words = (F.col("n") + least - 1).cast("int").alias("words")
    return runs.select("row", "id", F.lit("run").alias("kind"), "para", "start", (F.col("end") - F.col("start")).alias("length"), words, "keeper", F.lit(None).cast("int").alias("keeper_para"), "removed")


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """A text less ranges of (start, length); lines that hold no words after a cut go too."""
    ranges, out, at = sorted(ranges), [], 0
    for line in text.split("\n"):
        end, pieces, place, cut = at + len(line), [], at, False
        for s, n in ranges:
            if s < end and s + n > at:
                pieces.append(text[place : max(place, s)])
                place, cut = max(place, min(end, s + n)), True
        if not cut:
            out.append(line)
        else:
            left = " ".join(p for p in (x.strip(" ") for x in [*pieces, text[place:end]]) if p)
            if _WORD.search(left):
                out.append(left)
        at = end + 1
    return "\n".join(out)


by_value(__name__)
