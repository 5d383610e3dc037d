"""Operators on documents: brute force on fixtures, and the cases that every one of them must bear."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scrivane.llm import bpe, packing, quality, runs, simhash, substring, token_cache, vocabulary, words
from scrivane.llm.common import materialise, roots, row_key, scratch, table

from .conftest import CLASHES, DOCS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(words))


def odd_rows() -> list[tuple]:
    a, b = prose(1, 120), prose(2, 120)
    near = a.split()
    near[60] = "changed"
    texts = [None, "", "   \n\t ", "one", a, a, b, " ".join(near), a + "\n" + b, prose(3, 30_000), "x" * 100_000, "\n".join([prose(4, 60)] * 3), "é☃😀 " * 80, "A B C\nA B C"]
    rows = [(k, t, "en" if k % 3 else None, None if k % 4 == 0 else "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, rows[4], (None, a, None, None, None), (None, None, None, None, None)]


@pytest.fixture
def odd(reread):
    extra = (7, 7, 7, 7, 7, "k", True, 7, 7, "d", 7, 7, "t")
    return reread([(*r, *extra) for r in odd_rows()], f"{DOCS}, {CLASHES}")


@pytest.fixture
def none(reread):
    return reread([], f"{DOCS}, {CLASHES}")


def brute_print(text) -> int:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints: list[int]) -> list[int]:
    v = np.array(prints, np.uint64)
    links = np.argwhere(np.bitwise_count(v[:, None] ^ v[None, :]) <= 3)
    return roots(len(v), map(tuple, links.tolist()))


def test_simhash_equals_brute_force(spark, odd, none):
    df = table(spark, SMALL, "documents")
    rows = df.orderBy("doc_id").collect()
    prints = [brute_print(r.text) for r in rows]
    label = brute_components(prints)
    got = {r.id: (r.fp % 2**64, r.component) for r in simhash.near_duplicates(df).collect()}
    assert got == {r.doc_id: (p, rows[k].doc_id) for r, p, k in zip(rows, prints, label, strict=True)}
    assert simhash.near_duplicates(none).count() == 0
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(odd_rows())
    for r in found:
        if r.id == 0 or r.id == 2:
            assert r.component == 0 and r.fp == 0
        if r.id in (5, None) and r.fp:
            assert r.component == 4
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert {0, 3, 4, 6, 8} <= set(ids) and not {1, 2, 5} & set(ids) and len(ids) == len(set(ids))


def test_bk_trees_find_all_and_cells_join(spark, reread, monkeypatch):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 40, np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << r.integers(0, 64, 40, np.uint64)) for _ in range(30)] + [base]))
    tree = simhash.BKTree(values)
    found = {(a, b) for q, v in tree.within(values) for a, b in zip(q.tolist(), v.tolist(), strict=True)}
    assert found == {tuple(x) for x in np.argwhere(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3).tolist()}
    monkeypatch.setattr(simhash, "TREE", 8)  # so that shards are cut into many cells
    rows = [(k, f"w{k % 7} common words of a hot group that differ a little here {k % 5}") for k in range(300)]
    df = reread(rows, "doc_id long, text string")
    label = brute_components([brute_print(t) for _, t in rows])
    assert {x.id: x.component for x in simhash.near_duplicates(df).collect()} == {k: label[k] for k in range(300)}


def brute_units(text, least=50) -> list[tuple]:
    """(first line, last line, words) of each line of least words or more, or of a stretch of shorter ones that has as many."""
    groups, held = [], []
    for k, line in enumerate(text.split("\n")):
        w = WORD.findall(line)
        if 0 < len(w) < least:
            held.append((k, w))
            continue
        groups += [held, [(k, w)]]
        held = []
    found = [(g[0][0], g[-1][0], [x for _, w in g for x in w]) for g in [*groups, held] if g]
    return [g for g in found if len(g[2]) >= least]


def brute_passages(rows: list[tuple]) -> dict:
    paras = [(d, first, w) for d, t in rows for first, _, w in brute_units(t or "")]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for _, _, w in paras]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = roots(len(paras), links)
    many = {k for k, n in Counter(label).items() if n > 1}
    groups = {k: [(paras[i][0], paras[i][1]) for i in range(len(paras)) if label[i] == k] for k in many}
    return {m: min(g) for g in groups.values() for m in g}


def test_substring_equals_brute_force(spark, odd, none, reread, monkeypatch):
    monkeypatch.setattr(substring, "SHARD", 3)
    r = random.Random(3)
    shared = [prose(100 + k, 70) for k in range(4)]
    rows = []
    for d in range(60):
        lines = [prose(1000 + d, 60), prose(2000 + d, 10)]
        w = shared[d % 4].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(70)] = "swap"
        lines.insert(r.randint(0, 2), " ".join(w) if d % 3 else "\n".join(" ".join(w[k : k + 20]) for k in range(0, 70, 20)))
        if d % 5 == 0:
            lines.insert(1, " \t" * (d % 2))
        rows.append((d, "\n".join(lines)))
    df = reread(rows, "doc_id long, text string", 3)
    found = [x for x in substring.repeated_passages(df).collect() if x.kind == "paragraph"]
    assert {(x.id, x.para): (x.keeper, x.keeper_para) for x in found} == brute_passages(rows)
    texts = dict(rows)
    for x in found:
        first, last, words = next(u for u in brute_units(texts[x.id]) if u[0] == x.para)
        assert texts[x.id][x.start : x.start + x.length] == "\n".join(texts[x.id].split("\n")[first : last + 1]) and x.words == len(words)
        assert x.removed == ((x.id, x.para) != (x.keeper, x.keeper_para))
    assert substring.repeated_passages(none).count() == 0
    kept = substring.drop_repeated_passages(odd, chars="n_chars")
    assert kept.columns == odd.columns
    by_id = {}
    for x in kept.collect():
        by_id.setdefault(x.doc_id, []).append(x)
    assert 5 not in by_id and 7 not in by_id and 8 not in by_id and len(by_id[4]) == 1 and by_id[0][0].text is None  # a near copy goes, too
    assert by_id[11][0].text == prose(4, 60) and by_id[11][0].n_chars == len(prose(4, 60))
    assert by_id[2][0].text == "   \n\t "


def brute_runs(texts, least=50):
    """Windows of least words found twice, as (doc, start, end), of texts of one segment each."""
    places = {}
    for d, text in texts.items():
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        for k in range(len(spans) - least + 1):
            places.setdefault(tuple(text[a:b] for a, b in spans[k : k + least]), []).append((d, spans[k][0], spans[k + least - 1][1]))
    return [sorted(p) for p in places.values() if len({d for d, _, _ in p}) > 1]


def test_runs_inside_unlike_paragraphs(spark, reread):
    passages = [prose(500 + k, n) for k, n in enumerate((50, 51, 68, 120, 49))]
    rows = []
    for d in range(40):
        host = prose(3000 + d, 200).split()
        at = 7 + 4 * d
        rows.append((d, " ".join([*host[:at], passages[d % 5], *host[at:]]).replace(" ", "\n", d % 3)))
    texts = dict(rows)
    found = [x for x in substring.repeated_passages(reread(rows, "doc_id long, text string", 3)).collect() if x.kind == "run"]
    windows = brute_runs(texts)
    assert {x.id for x in found} == {d for p in windows for d, _, _ in p} == {d for d in texts if d % 5 < 4}
    for removed in (True, False):
        mine = {(x.id, k) for x in found if x.removed == removed for k in range(x.start, x.start + x.length)}
        assert mine == {(d, k) for p in windows for d, a, e in (p[1:] if removed else p[:1]) for k in range(a, e)}
    kept = {x.doc_id: x.text for x in substring.drop_repeated_passages(reread(rows, "doc_id long, text string", 3)).collect()}
    assert not brute_runs(kept) and all(kept[d] == texts[d] for d in (0, 1, 2, 3, *range(4, 40, 5)))
    for d, text in texts.items():
        words = [w for w in text.split() if w]
        at = 7 + 4 * d
        n = len(passages[d % 5].split()) if d > 3 and d % 5 < 4 else 0
        assert kept[d].split() == words[:at] + words[at + n :]


def test_runs_of_periodic_and_odd_texts(spark, reread):
    rows = [(1, "a b c " * 40), (1, "a b c " * 40), (None, "x\u2003y " * 60), (2, ""), (3, None), (4, "\n \n")]
    found = substring.repeated_passages(reread(rows, "doc_id long, text string", 1))
    assert {x.id for x in found.collect()} == {1}  # what one text repeats within a paragraph isn't shared


def test_a_cut_leaves_the_rest():
    text = "one two three\nfour five\nsix"
    assert runs.without(text, [(14, 9)]) == "one two three\nsix"
    assert runs.without(text, [(4, 3)]) == "one three\nfour five\nsix"
    assert runs.without(text, [(8, 10)]) == "one two\nfive\nsix"
    assert runs.without(text, [(14, 9), (0, 13), (24, 3)]) == ""
    assert runs.without(text, [(0, 7), (4, 9)]) == "four five\nsix"
    assert runs.without("a\n\nb\nc", [(0, 4)]) == "c"


def test_keys_need_lasting_rows(spark, odd):
    assert row_key(odd.where("doc_id > 3").select("text"), "key").count() > 3
    for df in (odd.repartition(3), odd.distinct(), odd.join(odd.select("doc_id"), "doc_id"), odd.orderBy("doc_id")):
        with pytest.raises(ValueError, match="lasting"):
            row_key(df, "key")


def test_words_of_blocks(monkeypatch):
    monkeypatch.setattr(words, "BLOCK", 16)
    r = random.Random(7)
    texts = ["", " ", "a", "ab", "x" * 100, "é☃ 😀\n\nq\x0br\n", *("".join(r.choice(["a", "b", "é", "☃", " ", "\n", "\t"]) for _ in range(r.randrange(80))) for _ in range(200)), "\n", ""]
    own = words.Words(pa.array(texts))
    spans = [(t, m.group(), m.start(), m.end()) for t, x in enumerate(texts) for m in WORD.finditer(x)]
    of = np.repeat(np.arange(len(texts)), np.diff(own.bounds))
    assert of.tolist() == [t for t, *_ in spans]
    assert own.points(own.starts, of).tolist() == [a for _, _, a, _ in spans] and own.points(own.ends, of).tolist() == [e for *_, e in spans]
    codes = dict(zip([w for _, w, _, _ in spans], own.codes.tolist(), strict=True))
    assert [codes[w] for _, w, _, _ in spans] == own.codes.tolist() and len(set(codes.values())) == len(codes)
    text, number, start, end = own.lines()
    lines = [(t, k, x) for t, whole in enumerate(texts) for k, x in enumerate(whole.split("\n"))]
    assert [(t, k, own.data[a:b].tobytes().decode()) for t, k, a, b in zip(text.tolist(), number.tolist(), start.tolist(), end.tolist(), strict=True)] == lines
    p = own.paragraphs(5)
    assert list(zip(p["text"].tolist(), p["para"].tolist(), (p["last"] - p["first"]).tolist(), strict=True)) == [(t, a, len(w)) for t, x in enumerate(texts) for a, _, w in brute_units(x, 5)]


def test_probes_are_the_same_wherever_words_stand():
    r = random.Random(8)
    shared = " ".join(prose(9, 50).split())
    for seed in range(20):
        own = words.Words(pa.array([prose(seed, r.randrange(60)) + " " + shared + " " + prose(seed + 100, 40), " ".join(["again"] * seed) + " " + shared]))
        at = own.probes(50, 20, words.in_a_row(own.codes, 5))
        found = [set(words.rows_of(own.codes, at[(at >= a) & (at < b)], 20).tolist()) for a, b in zip(own.bounds[:-1], own.bounds[1:], strict=True)]
        assert found[0] & found[1]


def test_bands_reach_their_recall():
    bands, rows = substring.tune_bands()
    assert 1 - (1 - substring.SIMILAR**rows) ** bands >= substring.RECALL
    assert substring.tune_bands(8, 0.5, 0.9) == (4, 1)


def brute_quality(t) -> tuple:
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
    n = Counter(grams)
    again = len({j + k for j, g in enumerate(grams) if n[g] > 1 for k in range(3)})
    failed = len(w) < 50 or 100 * again > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), again, failed


def brute_kept(text, lang) -> bool:
    """The whole verdict: base rules, then Jensen-Shannon distances of character classes and of common words."""
    text, words = text or "", WORD.findall(text or "")

    def distance(p: list[float], q: list[float]) -> float:
        each = [(a, b, (a + b) / 2) for a, b in zip(p, q, strict=True)]
        return math.sqrt(max(0.0, sum((a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0) for a, b, m in each) / 2))

    if brute_quality(text)[-1]:
        return False
    if len(text) >= 200:
        classes = dict.fromkeys(quality.CLASSES, 0)
        for c in text:
            kind = unicodedata.category(c)
            upper = "upper" if kind == "Lu" else "lower"
            classes[upper if kind[0] == "L" else "space" if c in " \t\n\v\f\r" else "digit" if kind == "Nd" else "punctuation" if c in ".,;:!?'\"()-" else "other"] += 1
        if distance([n / len(text) for n in classes.values()], list(quality.CLASSES.values())) > quality.MOST_CLASSES:
            return False
    if len(words) >= 100 and (lang or "").lower() in quality.COMMON:
        common = quality.COMMON[lang.lower()].split()
        counted = [sum(w in (c, c.capitalize()) for w in words) / len(words) for c in common]
        like = [quality.FIRST * k**-quality.SLOPE for k in range(1, 17)]
        return distance([*counted, 1 - sum(counted)], [*like, 1 - sum(like)]) <= quality.MOST_COMMON
    return True


def test_verdicts_equal_brute_force(spark, odd):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert got == {r.doc_id: brute_kept(r.text, r.lang) for r in docs.collect()}
    assert 0.5 < sum(got.values()) / len(got) < 1
    want = sorted(str((r[0], brute_kept(r[1], r[2]))) for r in odd_rows())
    assert sorted(str((x.doc_id, x.kept)) for x in quality.quality(odd).collect()) == want


def test_repeated_windows_of_long_texts(spark, reread):
    r = random.Random(12)
    texts = ["".join(r.choice("ab ") for _ in range(n)) for n in (300, 3000, 60_000)] + [" ".join(str(r.randrange(300)) for _ in range(20_000)), " ".join(str(k) for k in range(200_000)) + " 1 2 3 4"]
    got = {x.doc_id: x.n_repeat_words for x in quality.quality(reread(list(enumerate(texts)), "doc_id long, text string"), lang=None).collect()}
    assert got == {k: brute_quality(t)[4] for k, t in enumerate(texts)}


def test_quality(spark, odd, none, reread):
    rows = odd_rows()
    judged = quality.quality(odd).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(str((x.doc_id, *(x[n] for n in names))) for x in judged) == sorted(str((r[0], *brute_quality(r[1]))) for r in rows)
    assert quality.quality(none).count() == 0 and quality.keep_good(odd).columns == odd.columns
    common = "the of and to in that it is was for with as".split()
    r = random.Random(1)
    good = ". ".join(" ".join(r.choice(common) if r.random() < 0.2 else prose(r.randrange(10**6), 1) for _ in range(12)).capitalize() for _ in range(30)) + "."
    junk = " ".join(f"{w}###$$" for w in good.split())
    df = reread([(1, good, "en"), (2, junk, "en"), (3, good, None), (4, good.upper(), "xx")], "doc_id long, text string, lang string")
    assert {x.doc_id: x.kept for x in quality.quality(df).collect()} == {1: True, 2: False, 3: True, 4: False}
    assert [x.doc_id for x in quality.keep_good(df).orderBy("doc_id").collect()] == [1, 3]
    plan = quality.quality(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_quality_of_other_languages(spark, reread):
    r = random.Random(3)
    shares = quality.common_shares()

    def text(lang: str, words: int) -> str:
        common = r.choices([*quality.COMMON[lang].split(), None], [*shares, 1 - sum(shares)], k=words)
        return ". ".join(" ".join(w or prose(r.randrange(10**6), 1) for w in common[k : k + 12]).capitalize() for k in range(0, words, 12)) + "."

    long = {lang: text(lang, 1200) for lang in quality.COMMON}
    rows = [(f"{a} as {b}", t, b) for a, t in long.items() for b in quality.COMMON] + [("none", text("en", 1200).translate({ord("e"): "oe", ord("o"): "ae", ord("a"): "ue", ord("i"): "ou"}), "en")]
    rows += [(f"short {k}", text("en", 110), "en") for k in range(40)]
    got = {x.doc_id: x for x in quality.quality(reread(rows, "doc_id string, text string, lang string")).collect()}
    assert not any(x.base_failed for x in got.values()) and all(x.class_distance <= quality.MOST_CLASSES for x in got.values())
    close = {"fr as es", "es as fr"}  # they share four of their commonest words
    assert {k for k, x in got.items() if not x.kept} - close == {f"{a} as {b}" for a in long for b in long if a != b} - close | {"none"}


def test_packing(spark, odd, none):
    def sound(lengths, where, content, capacities):
        used = Counter()
        for b, n in zip(where, lengths, strict=True):
            used[b] += n
        assert all(used[b] == content[b] <= capacities[b] for b in range(len(content)))

    r = random.Random(2)
    lengths = [min(32768, int(r.paretovariate(1.1) * 500)) for _ in range(2000)]
    result = packing.pack(lengths)
    sound(lengths, *result)
    assert sum(lengths) / sum(result[2]) > 0.97
    costs = [sum(map(packing.cost, packing.best_fit(lengths, packing.CAPACITIES, c)[2])) for c in (None, *packing.CAPACITIES)]
    assert sum(map(packing.cost, result[2])) == min(costs)
    assert packing.pack(lengths) == brute_pack(lengths, packing.CAPACITIES)
    for seed in range(40):
        q = random.Random(seed)
        some, sizes = [q.randint(1, 16) for _ in range(q.randint(0, 40))], tuple(sorted(q.sample(range(1, 16), 2))) + (16,)
        assert packing.pack(some, sizes) == brute_pack(some, sizes)
    # Small cases against all ways to divide them.
    for seed in range(30):
        few = [random.Random(seed * 10 + k).randint(1, 16) for k in range(6)]
        best = min(sum(packing.cost(next(c for c in (4, 8, 16) if c >= sum(g))) for g in ways) for ways in divisions(few) if all(sum(g) <= 16 for g in ways))
        assert sum(map(packing.cost, packing.pack(few, (4, 8, 16))[2])) <= 1.5 * best
    rows = packing.pack_documents(odd, shard=4).collect()
    assert packing.pack_documents(none).count() == 0
    total = Counter()
    for x in rows:
        total[x.row] += x.length
    assert sorted(total.values()) == sorted(len((t[1] or "").encode()) + 1 for t in odd_rows())
    bins = {}
    for x in rows:
        bins.setdefault(x.bin_id, []).append(x)
    for b in bins.values():
        b.sort(key=lambda x: x.offset)
        assert [x.offset for x in b] == [sum(y.length for y in b[:k]) for k in range(len(b))]
        assert b[0].filled == sum(x.length for x in b) <= b[0].capacity and b[0].capacity in packing.CAPACITIES


def brute_pack(lengths, capacities):
    """Best fit by looking at every bin for every item, for every way to open bins."""
    found = []
    for opening in (None, *sorted(capacities)):
        bins, where = [], {}
        order = sorted(enumerate(lengths), key=lambda x: -x[1])
        for n, (k, size) in enumerate(order):
            room = [(b["free"], i) for i, b in enumerate(bins) if b["free"] >= size]
            if not room:
                fits = [c for c in sorted(capacities) if c >= size]
                left = sum(x for _, x in order[n:])
                free = min(fits, key=lambda c: packing.cost(c) / min(c, left)) if opening is None else next((c for c in fits if c >= opening), fits[-1])
                bins.append({"free": free, "used": 0})
                room = [(free, len(bins) - 1)]
            where[k] = min(room)[1]
            bins[where[k]]["free"] -= size
            bins[where[k]]["used"] += size
        used = [b["used"] for b in bins]
        found.append(([where[k] for k in range(len(lengths))], used, [min(c for c in capacities if c >= u) for u in used]))
    return min(found, key=lambda f: sum(packing.cost(c) for c in f[2]))


def test_lengths_that_are_given(spark, reread):
    df = reread([(1, "a", 5000), (2, "b", None), (3, "c", 0), (4, None, -3), (5, "", 70_000), (5, "", 70_000)], "doc_id long, text string, n int")
    got = packing.pack_documents(df, length=F.col("n")).collect()
    total = Counter()
    for x in got:
        total[x.doc_id] += x.length
    assert total == {1: 5000, 2: 1, 3: 1, 4: 1, 5: 140_000} and max(x.length for x in got) == 32768
    counts = materialise(token_cache.count_tokens(df), "counted")  # as operator 8 counts them
    assert Counter(x.length for x in packing.pack_documents(counts, length=F.col("n_tokens") + 1).collect()) == {1: 3, 2: 3}


def divisions(items):
    if not items:
        yield []
        return
    for rest in divisions(items[1:]):
        yield [[items[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]


def test_bpe_equals_the_library(spark, odd, none, reread, monkeypatch):
    ranks = vocabulary.ranks(vocabulary.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=vocabulary.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for x in bpe.encode(odd).collect():
        text = next(r[1] for r in odd_rows() if r[0] == x.doc_id and (x.doc_id is not None or (len(r[1] or "") > 0) == (x.n_tokens > 0))) or ""
        ids = library.encode_ordinary(text)
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(none).count() == 0 and bpe.encode(odd).count() == len(odd_rows())
    monkeypatch.setattr(bpe, "CHUNK", 100)
    monkeypatch.setattr(bpe, "OVERLAP", 20)
    r = random.Random(1)
    rows = [(k, "".join(r.choice(["a", "b", " ", "  ", "\n", "\t", "'", "'re", "'l", "l", "1", "22", "é", "!", "\r", "☃", "😀"]) for _ in range(r.randint(0, 1500)))) for k in range(80)]
    rows += [(100, "x" * 999), (101, " " * 999), (102, "'" * 500), (103, "a" + " " * 250 + "b" + "\n" * 300 + "c"), (104, None), (105, "z" * 100), (106, "z" * 121)]
    got = {x.doc_id: (x.ids, bytes(x.decoded)) for x in bpe.encode(reread(rows, "doc_id long, text string"), kind=bpe.IdLists).collect()}
    assert got == {k: (library.encode_ordinary(t or ""), (t or "").encode()) for k, t in rows}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_cache(spark, odd, none, reread, name):
    file, cache = vocabulary.path(name), scratch(spark, "cache")
    if name.endswith(".json"):
        library = Tokenizer.from_file(file)
        count = lambda texts: [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    else:
        library = sentencepiece.SentencePieceProcessor(model_file=file)
        count = lambda texts: [len(library.encode(t)) for t in texts]
    extra = reread([(90, "<|endoftext|> a <|endoftext|>"), (91, "<s> b"), (92, "word " * 3000)], "doc_id long, text string")
    want = sorted(str((r[0], len((r[1] or "").encode()), n, n > 1024)) for r, n in zip(odd_rows(), count([r[1] or "" for r in odd_rows()]), strict=True))
    assert sorted(str(tuple(x)) for x in token_cache.count_tokens(odd, file=file, cache=cache).collect()) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({r[1] or "" for r in odd_rows()})
    assert sorted(str(tuple(x)) for x in token_cache.count_tokens(odd, file=file, cache=cache).collect()) == want
    assert spark.read.parquet(cache).count() == stored  # nothing was missing
    got = {x.doc_id: (x.n_tokens, x.over_limit) for x in token_cache.count_tokens(extra, file=file, cache=cache).collect()}
    assert got[90][0] == count(["<|endoftext|> a <|endoftext|>"])[0] and got[92][1]
    assert spark.read.parquet(cache).count() == stored + 3
    assert token_cache.count_tokens(none, file=file).count() == 0
