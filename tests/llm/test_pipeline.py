import re
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from scrivane.llm import queries, simhash, substring
from scrivane.llm.common import shared_dir, table

from .conftest import CLASHES, DOCS
from .test_documents import brute_components, brute_kept, brute_passages, brute_print, brute_units, odd_rows

SMALL = "/root/testdata/sf0.001"


def brute_left(texts, gone, least=50):
    """Texts less lines by number, then less each run of least words that an earlier text holds (in one stretch between such lines)."""
    places, masks = {}, {d: bytearray(len(t)) for d, t in texts.items()}
    for d, t in texts.items():
        stretches, at = [[]], 0
        for k, line in enumerate(t.split("\n")):
            if k in gone[d]:
                stretches.append([])
            else:
                stretches[-1] += [(at + m.start(), at + m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
            at += len(line) + 1
        for spans in stretches:
            words = [t[a:b] for a, b in spans]
            for k in range(len(spans) - least + 1):
                places.setdefault(tuple(words[k : k + least]), []).append((d, spans[k][0], spans[k + least - 1][1]))
    for p in places.values():
        for d, a, b in p:
            if d > min(p)[0]:
                masks[d][a:b] = b"\1" * (b - a)
    out = {}
    for d, t in texts.items():
        lines, at = [], 0
        for k, line in enumerate(t.split("\n")):
            mask = masks[d][at : at + len(line)]
            if k not in gone[d]:
                if any(mask):
                    pieces = "".join("\0" if m else c for c, m in zip(line, mask, strict=True)).split("\0")
                    line_left = " ".join(x for x in (y.strip(" ") for y in pieces) if x)
                    lines += [line_left] if line_left.strip() else []
                else:
                    lines.append(line)
            at += len(line) + 1
        out[d] = "\n".join(lines)
    return out


def test_stages_equal_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    columns = docs.columns
    one = corpus_pipeline.STAGES[0][1](spark, docs, SMALL)
    rows = docs.orderBy("doc_id").collect()
    left = [r for r in rows if brute_kept(r.text, r.lang)]
    kept = sorted(r.doc_id for r in one.collect())
    assert one.columns == columns and kept == [r.doc_id for r in left]
    label = brute_components([brute_print(r.text) for r in left])
    stays = [r for k, r in enumerate(left) if label[k] == k]
    end = corpus_pipeline.run(spark, SMALL).collect()
    passages = brute_passages([(r.doc_id, r.text) for r in stays])
    texts = {r.doc_id: r.text for r in stays}
    gone = {d: {k for a, b, _ in brute_units(t) if passages.get((d, a), (d, a)) != (d, a) for k in range(a, b + 1)} for d, t in texts.items()}
    want = {d: len(t.encode()) + 1 for d, t in brute_left(texts, gone).items() if t.strip() or t == texts[d]}
    got = {}
    for x in end:
        got[x.doc_id] = got.get(x.doc_id, 0) + x.length
    assert got == want


def test_odd_rows_go_through(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, and columns with the operators' own names."""
    extra = (7, 7, 7, 7, 7, "k", True, 7, 7, "d", 7, 7, "t")
    spark.createDataFrame([(*r, *extra) for r in odd_rows()], f"{DOCS}, {CLASHES}").write.parquet(str(tmp_path / "documents.parquet"))
    end = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = {r[0]: len(r[1].encode()) + 1 for r in odd_rows() if brute_kept(r[1], r[2])}  # none of these repeats another
    got = {}
    for x in end:
        got[x.doc_id] = got.get(x.doc_id, 0) + x.length
    assert got == want and set(want) == {6, 9, None}


def test_a_run_leaves_its_result_only(spark):
    root = Path(shared_dir(spark).removeprefix("file://")) / f"scrivane-{spark.sparkContext.applicationId}"
    before = {p.name for p in root.iterdir()}
    end = corpus_pipeline.run(spark, SMALL)
    assert end.count() and {p.name.split("-")[0] for p in {p for p in root.iterdir() if p.name not in before}} == {"stage3"}


def test_empty_corpus(spark, tmp_path):
    table(spark, SMALL, "documents").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_equals_its_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SMALL)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_other_queries_run(spark):
    columns = {
        "op2_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op3_html_extraction": {"page_id", "url", "text", "n_chars"}, "op4_best_fit_packing": {"doc_id", "bin_id", "capacity"},
        "op5_simhash_near_dedup": {"doc_id", "fingerprint", "component_id"}, "op7_url_filters": {"page_id", "host", "path", "rule", "verdict"}, "op8_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    }
    for name, own in columns.items():
        df = queries.QUERIES[name](spark, SMALL)
        assert own <= set(df.columns) and df.count() >= (50 if "page_id" in own else 200)
    assert set(queries.QUERIES) == {*columns, *queries.ORACLE_SQL}
    assert simhash.RADIUS == 3 and substring.SIMILAR >= 0.8
