"""Operators on vectors, pages, URLs and conversations, and what they share."""

import json
import math
import random
import re

import numpy as np
import pytest

from scrivane.llm import bitsliced, chat, html_extract, url_filter
from scrivane.llm.common import clean, materialise, min_labels, roots, shared_dir
from scrivane.llm.components import connected_components


def test_top_k(spark, reread):
    r = np.random.default_rng(1)
    v = r.normal(0, 0.3, (300, 16)).astype(np.float32)
    v[40] = v[41] = v[42]  # ties
    v[7] = 0
    rows = [(k, v[k].tolist(), 1, 2) for k in range(300)] + [(41, v[41].tolist(), 1, 2)]
    bad = [(300, None, 1, 2), (301, [float("nan")] * 16, 1, 2), (302, [0.5, None], 1, 2), (None, [0.1] * 16, 1, 2), (303, [float("inf")] * 16, 1, 2)]
    large = [(306, [600_000.0] + [0.0] * 15, 1, 2), (307, [-(2.0**45)] + [0.0] * 15, 1, 2), (308, [0.0] * 15 + [2.0**41 + 2.0**20], 1, 2)]
    df = reread(rows + bad + large + [(304, [0.5], 1, 2), (305, [], 1, 2)], "vec_id long, embedding array<float>, id long, score long", 3)
    whole = [(k, np.floor(256 * np.array(x, float)).astype(int)) for k, x, *_ in rows + large] + [(304, np.array([128] + [0] * 15)), (305, np.zeros(16, int))]
    got = {}
    for x in bitsliced.top_k(df).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.score, x.vec_id))
    assert set(got) == {0, 50, 100, 150, 200, 250}
    for q, found in got.items():
        own = whole[q][1]
        best = sorted((-int(own @ x), k) for k, x in whole if k != q)[:5]
        assert sorted(found) == [(n + 1, -s, k) for n, (s, k) in enumerate(best)]
    few = reread([(0, [0.5, -0.25], 1, 1), (50, [0.5, 1.0], 1, 1)], "vec_id long, embedding array<float>, id long, score long")
    assert sorted(tuple(x) for x in bitsliced.top_k(few).collect()) == [(0, 1, 50, 128 * 128 - 64 * 256), (50, 1, 0, 128 * 128 - 64 * 256)]
    assert bitsliced.top_k(few.where("false")).count() == 0
    huge = reread([(0, [1.0, 0.0]), (50, [0.5, 1e300]), (1, [-1e307, 0.0]), *((k, [1.0, 2.0]) for k in range(2, 8))], "vec_id long, embedding array<double>")
    assert [(x.vec_id, x.score) for x in bitsliced.top_k(huge.where("vec_id <> 50")).orderBy("rank").collect()] == [(k, 65536) for k in range(2, 7)]
    for wrong in (huge, huge.where("vec_id < 2")):  # too high for a long; too low, but the only one
        with pytest.raises(Exception, match="doesn't fit a long"):
            bitsliced.top_k(wrong).collect()
    assert sum(s << 0 if k == 0 else s * 2**k for k, s in bitsliced.digits(-1234567)) == -1234567


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(200)], [(0, k) for k in range(1, 100)], None])
def test_components(spark, edges):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] if edges is None else edges
    df = spark.createDataFrame([*edges, (None, 3)], "x long, y long")
    label = roots(300, edges)
    assert min_labels(300, *(np.array([e[k] for e in edges], int) for k in (0, 1))).tolist() == label
    want = {n: label[n] for e in edges if e[0] != e[1] for n in e}
    got = connected_components(df).collect()
    assert {x.node: x.label for x in got} == want and len(got) == len(want)


def test_shared_folder_is_cleaned(spark):
    df = materialise(spark.range(5), "kept")
    assert df.count() == 5 and shared_dir(spark)
    with pytest.raises(ValueError):
        clean(spark, "/elsewhere")
    clean(spark, df.inputFiles()[0].removeprefix("file://").rpartition("/")[0])
    assert spark.range(1).count() == 1


NAV = '<nav><ul><li><a href="/{0}">{0}</a></li></ul></nav>'
PAGE = '<!DOCTYPE html><html><head><title>{0}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>' + NAV + '<!-- ad --><div class="ad">buy {0}</div><article><h1>{0} &amp; co</h1><p><b>{0}</b> one\n two.<br>three<p>Second {0}.</article><footer>&copy; {0}</footer>'


def test_pages_with_articles(spark, reread):
    rows = [(k, f"https://h{k % 3}.example.org/{k}", PAGE.format(f"w{k}"), "x", 1) for k in range(30)]
    odd = [(100, None, None, "x", 1), (101, "https://h0.example.org/x", "", "x", 1), (102, "no host", "plain &lt;text", "x", 1), (103, "https://h0.example.org/y", "<p>a" + "<div>" * 3000 + "deep", "x", 1), (None, "https://h1.example.org/", PAGE.format("n"), "x", 1), rows[4], (104, "https://h1.example.org/z", "<p>" + "word " * 50_000, "x", 1)]
    df = reread(rows + odd, "page_id long, url string, html string, template string, n_chars int", 3)
    got = html_extract.main_text(df).collect()
    assert len(got) == len(rows) + len(odd)
    for x in got:
        assert x.n_chars == len(x.text)
        if x.page_id is not None and x.page_id < 100:
            w = f"w{x.page_id}"
            assert x.text == f"{w} & co\n\n{w} one two. three\n\nSecond {w}."
    by_id = {x.page_id: x.text for x in got}
    assert by_id[100] == by_id[101] == "" and by_id[102] == "plain <text" and by_id[103] == "a\n\ndeep" and by_id[104].count("word") == 50_000
    assert html_extract.main_text(df.where("false")).count() == 0


@pytest.mark.parametrize("most", [html_extract.BROADCAST_BYTES, -1])
def test_constant_nodes_are_template(spark, reread, monkeypatch, most):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", most)
    page = '<body><div><a href="/">Home</a></div><div class="top"><p>All rights are ours, whoever reads this.</p></div><div class="body"><h2>{0}</h2><p>Text of {0}.</p></div><div class="x"><p>Contact us any day.</p></div></body>'
    rows = [(k, f"http://same.example.com/{k}", page.format(f"page {k}")) for k in range(12)]
    got = html_extract.main_text(reread(rows, "page_id long, url string, html string", 4)).collect()
    assert {x.text for x in got} == {f"page {k}\n\nText of page {k}." for k in range(12)}


def test_copies_of_a_page_are_no_template(spark, reread):
    page = '<body><div class="top"><p>All rights are ours.</p></div><div class="body{1}"><h2>{0}</h2><p>Text of {0}.</p></div></body>'
    rows = [(k, f"http://copies.example.com/{k}", page.format("the only page", "")) for k in range(6)]
    rows += [(10 + k, f"http://both.example.com/{k}", page.format(f"page {k}", "")) for k in range(8)] + [(20 + k, f"http://both.example.com/c{k}", page.format("copied page", " tail")) for k in range(6)]
    got = {x.page_id: x.text for x in html_extract.main_text(reread(rows, "page_id long, url string, html string", 4)).collect()}
    assert {got[k] for k in range(6)} == {"All rights are ours.\n\nthe only page\n\nText of the only page."}
    assert {got[20 + k] for k in range(6)} == {"copied page\n\nText of copied page."}
    assert [got[10 + k] for k in range(8)] == [f"page {k}\n\nText of page {k}." for k in range(8)]


def test_left_out_parts():
    page = """<body><header>Site</header><div class="cookie-notice">C</div><main><h1>T</h1><p>a &eacute;&#233; <i>b</i>c</p><aside>no</aside><form><p>f</p></form><table><tr><td>1<td>2</table>
    <ul><li>x<li>y</ul><section id="comments"><p>no</p></section><p hidden>no</p><p style="display: none">no</p><!-- <p>no</p> --></main><div class="sidebar"><p>no</p></div><script>if (a<b) x="</p>"</script><footer>z"""
    assert html_extract.extract(page).split("\n\n") == ["T", "a éé bc", "1", "2", "x", "y"]
    assert html_extract.extract('<div><a>Home</a> <a>News</a></div><p>text <a>link</a> and more') == "text link and more"
    assert html_extract.extract("a < b and <unclosed") == "a < b and" and html_extract.extract('<p title="a>b">c</p><p title="never closed>d') in ("c", "c\n\nd")


def leaf(label, *children):
    return [label, list(children), "div", False, 1, 0, {}, 0]


def brute_match(a, b) -> int:
    """The most nodes that an order of pairs by label reaches, trying all."""
    if not a or not b:
        return 0
    best = max(brute_match(a[1:], b), brute_match(a, b[1:]))
    return max(best, 1 + brute_match(a[0][1], b[0][1]) + brute_match(a[1:], b[1:])) if a[0][0] == b[0][0] else best


def test_tree_matching(monkeypatch):
    a, b = [leaf("x", leaf("p"), leaf("q")), leaf("y")], [leaf("z"), leaf("x", leaf("q")), leaf("y")]
    assert html_extract.match(a, b) == (3, [(0, 1, [(1, 0, [])]), (1, 2, [])])
    one = html_extract.merged(leaf("r", *a), leaf("r", *b))
    assert [c[0] for c in one[1]] == ["z", "x", "y"] and [c[4] for c in one[1]] == [1, 2, 2]
    assert html_extract.unflat(html_extract.flat(one, html_extract.OF)) == one
    r = random.Random(5)

    def forest(depth):
        return [leaf(r.choice("abc"), *(forest(depth - 1) if depth else [])) for _ in range(r.randint(0, 3))]

    for k in range(200):
        a, b = forest(2), forest(2)
        monkeypatch.setattr(html_extract, "PAIRS", 4096)
        assert html_extract.match(a, b)[0] == brute_match(a, b)
        monkeypatch.setattr(html_extract, "PAIRS", 0)  # in order, as for long lists: sound, if not always best
        total, pairs = html_extract.match(a, b)
        assert total <= brute_match(a, b) and all(a[i][0] == b[j][0] for i, j, _ in pairs) and [j for _, j, _ in pairs] == sorted({j for _, j, _ in pairs})


def hosted(reread, pages, parts=4):
    return reread([(k, f"http://one.example.com/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string", parts)


def test_templates_of_many_children_and_levels(spark, reread):
    many = "<body>" + "".join(f'<div class="c"><h3>Head {k}</h3></div><section><p>Constant {k}.</p></section>' for k in range(200)) + '<div class="text"><p>{0}</p></div></body>'
    got = html_extract.main_text(hosted(reread, [many.format(f"Own text {k}.") for k in range(12)])).collect()
    assert {x.page_id: x.text for x in got} == {k: f"Own text {k}." for k in range(12)}
    deep = "<body>" + '<div><b title="x">{1}</b>' * 40 + "<p>Constant, far below.</p><p>{0}</p>" + "</div>" * 40 + "<div>" * 1500 + "<p>Constant at the bottom.</p>"
    got = html_extract.main_text(hosted(reread, [deep.format(f"Own text {k}.", "") for k in range(8)])).collect()
    assert {x.page_id: x.text for x in got} == {k: f"Own text {k}." for k in range(8)}


def test_long_lists_are_matched_as_short_ones(spark, reread, monkeypatch):
    r = random.Random(11)

    def forest(most, depth):
        return [leaf(r.choice("abcd"), *(forest(3, depth - 1) if depth else [])) for _ in range(r.randint(0, 3) if most == 3 else most)]

    def edited(trees):
        return [leaf(t[0], *edited(t[1])) for t in trees if r.random() > 0.1 for t in ([t] if r.random() > 0.1 else [*forest(1, 1), t])]

    for k in range(30):
        a = forest(r.randint(70, 100), 2)
        b = edited(a) if k % 2 else forest(90, 2)
        b = b[40:] + b[:40] if k % 4 == 3 else b
        monkeypatch.setattr(html_extract, "PAIRS", 1 << 40)
        want = html_extract.match(a, b)
        monkeypatch.setattr(html_extract, "PAIRS", 4096)
        assert html_extract.match(a, b) == want
        with monkeypatch.context() as other:  # rows made again, a narrow band, long lists within long ones
            for name, value in (("PAIRS", 4), ("BAND", 1), ("CELLS", 100)):
                other.setattr(html_extract, name, value)
            assert html_extract.match(a, b) == want
    for blocks in (20, 100):  # a block that stands first on some pages and last on others
        many = "".join(f'<div class="c"><h3>Head {k}</h3></div><section><p>Constant {k}.</p></section>' for k in range(blocks))
        late = '<div class="late"><p>Own text {0}.</p></div>'
        got = html_extract.main_text(hosted(reread, ["<body>" + (late + many if k % 2 else many + late).format(k) for k in range(12)])).collect()
        assert {x.page_id: x.text for x in got} == {k: f"Own text {k}." for k in range(12)}


def test_the_template_decides_within_articles_and_without_names(spark, reread, monkeypatch):
    page = '<body><div class="q{1}x"><ul><li><a href="/{0}">{0}</a></ul><p>Offer {0}</p></div><div class="y"><h1>Head {0}</h1><p>First of {0}, long enough to stand out.</p><p>Become a member today.</p><p>Second of {0}, long enough as well.</p><figure><figcaption>Caption {0}</figcaption></figure></div><div class="z"><p>Line {0}</p></div></body>'
    want = {k: f"Head w{k}\n\nFirst of w{k}, long enough to stand out.\n\nSecond of w{k}, long enough as well.\n\nCaption w{k}" for k in range(10)}
    for html in (page, page.replace('<div class="y">', "<article>").replace("</figure></div>", "</figure></article>")):
        df = hosted(reread, [html.format(f"w{k}", k) for k in range(10)])
        assert {x.page_id: x.text for x in html_extract.main_text(df).collect()} == want
    assert html_extract.extract(page.format("w1", 1)) != want[1]  # the template alone makes the difference
    # On the test pages, templates alone choose what names and the article element do.
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    usual = {x.page_id: x.text for x in html_extract.main_text(pages).collect()}
    monkeypatch.setattr(html_extract, "BOILERPLATE", re.compile("(?!)"))
    monkeypatch.setattr(html_extract, "MAIN", set())
    monkeypatch.setattr(html_extract, "NEVER", {"script", "style", "head", "title"})
    parsed = {r.page_id: (r.url.split("/")[2], r.html) for r in pages.collect()}
    hosts = {}
    for host, html in parsed.values():
        own = html_extract.as_template(html_extract.parse(html)[0])
        hosts[host] = html_extract.merged(hosts[host], own) if host in hosts else own
    known = {k: t for k, t in hosts.items() if t[html_extract.COUNT] >= html_extract.PAGES}
    alone = {k: html_extract.extract(html, html_extract.finished(known[host])) for k, (host, html) in parsed.items() if host in known}
    right = sum(alone[k] == usual[k] for k in alone)
    assert len(alone) > 50 and right >= 0.9 * len(alone) and not any(html_extract.extract(parsed[k][1]) == usual[k] for k in alone)


def test_near_copies_and_rare_kinds_of_pages_keep_their_texts(spark, reread):
    page = "<body><header>Site</header><article><h1>{0}</h1><p>{1}</p><p>{2}</p></article></body>"
    pages = [page.format(f"own {k}", f"text of {k}", f"more of {k}") for k in range(9)] + [page.format("copied", f"changed {k}", "the same everywhere") for k in range(4)]
    pages.append("<body><div class='other'>Of another kind.</div></body>")
    got = {x.page_id: x.text for x in html_extract.main_text(hosted(reread, pages)).collect()}
    assert got == {**{k: f"own {k}\n\ntext of {k}\n\nmore of {k}" for k in range(9)}, **{9 + k: f"copied\n\nchanged {k}\n\nthe same everywhere" for k in range(4)}, 13: "Of another kind."}


def test_counts_of_texts_are_bounded_summaries(monkeypatch):
    monkeypatch.setattr(html_extract, "TEXTS", 4)
    r, true = random.Random(3), {}
    one = leaf("p")
    for k in range(300):
        own = {h: [1, 5] for h in {0} | ({1} if k % 2 else set()) | {r.randrange(10, 10_000) for _ in range(3)}}
        for h in own:
            true[h] = true.get(h, 0) + 1
        other = leaf("p")
        other[html_extract.KEPT] = own
        one = html_extract.merged(one, other)
    kept, lack = one[html_extract.KEPT], one[html_extract.LACK]
    assert len(kept) <= 4 and all(n <= true[h] <= n + lack for h, (n, _) in kept.items()) and kept[0][0] + lack >= 300


def test_urls(spark, reread):
    urls = {
        "http://A.net/x": ("a.net", "/x", "net/", "block"), "https://www.Example.net/en/5?q=/de/": ("www.example.net", "/en/5", "example.net/en/", "allow"), "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"), "http://x.org/fr/a#b": ("x.org", "/fr/a", "org/fr/", "allow"), "http://a.net": ("a.net", "", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "": ("", "", None, "allow"), "x://H?p://q": ("h", "", None, "allow"), "http://cheappills.example.com/buy": ("cheappills.example.com", "/buy", None, "block"), "http://www.free-bets.example.org/": ("www.free-bets.example.org", "/", None, "block"),
        "http://city-news.example.org/today": ("city-news.example.org", "/today", None, "allow"), "http://" + "a" * 20_000 + ".com/": ("a" * 20_000 + ".com", "/", None, "allow"),
    }
    df = reread([(k, u, "h", "v") for k, u in enumerate(urls)] + [(0, "http://A.net/x", "h", "v"), (None, None, None, None)], "page_id long, url string, host string, verdict string")
    got = url_filter.judge(df).collect()
    assert len(got) == len(urls) + 2
    assert {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in got if x.page_id is not None} == dict(enumerate(urls.values()))
    assert url_filter.judge(df.where("false")).count() == 0


def test_viterbi_and_held_out_urls(monkeypatch):
    s = url_filter.Scorer({})
    assert s.split("freesoftwarehelp") == ["free", "software", "help"] and s.split("qqqq") == ["qqqq"] and s.split("") == []
    # Each example is judged by a model that hasn't seen it.
    sides = {True: url_filter.BLOCK.split(), False: url_filter.ALLOW.split()}
    right = 0
    for blocked, xs in sides.items():
        for k, x in enumerate(xs):
            rest = " ".join(xs[:k] + xs[k + 1 :])
            monkeypatch.setattr(url_filter, "BLOCK" if blocked else "ALLOW", rest)
            host, _, path = x.partition("/")
            right += (url_filter.Scorer({}).score(f"{host}.example.org", f"/{path}") > 0) == blocked
            monkeypatch.undo()
    assert right / sum(map(len, sides.values())) > 0.7


def test_splits_and_odds_equal_brute_force():
    r = random.Random(11)
    counts = {"".join(r.choice("ab") for _ in range(r.randint(1, 4))): r.randint(1, 50) for _ in range(12)}
    s = url_filter.Scorer(counts)

    def ways(name):
        return [[]] if not name else [[name[:k], *rest] for k in range(1, len(name) + 1) for rest in ways(name[k:])]

    def share(word, name):
        n = counts.get(word, 0) - (word == name and word in counts) + sum(x.count(word) for _, x in url_filter.examples())
        return math.log(n / s.total) if n > 0 else math.log(url_filter.UNKNOWN) + len(word) * math.log(url_filter.LETTER)

    for _ in range(200):
        name = "".join(r.choice("aab") for _ in range(r.randint(1, 9)))
        best = max(sum(share(w, name) for w in way) for way in ways(name))
        got = s.split(name)
        assert "".join(got) == name and sum(share(w, name) for w in got) == pytest.approx(best)
    # Multinomial naive Bayes, counted anew.
    seen = {True: [], False: []}
    for blocked, x in url_filter.examples():
        seen[blocked] += x
    words = {w for x in seen.values() for w in x}
    for w, odds in url_filter.odds().items():
        p = {b: (seen[b].count(w) + url_filter.SMOOTHING) / (len(seen[b]) + url_filter.SMOOTHING * len(words)) for b in seen}
        assert odds == pytest.approx(math.log(p[True] / p[False]))
    assert set(url_filter.odds()) == words


def test_labelled_urls_are_not_those_of_the_tables():
    planted = "cheap-pills free-bets casino-win spam-farm ads-track adult-x".split()
    examples = {x.partition("/")[0] for x in (url_filter.BLOCK + " " + url_filter.ALLOW).split()}
    assert not examples & set(planted)
    s = url_filter.Scorer({})
    assert all(s.score(f"www.{x}.example.org", "/en/5") > 0 for x in planted)  # by their words, from other names


@pytest.mark.parametrize("most", [url_filter.BROADCAST_ROWS, -1])
def test_url_words_grow_with_the_input(spark, reread, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", most)
    # No labelled word: zorblat, quimsy and artisan (not art and isan) are words only as other hosts have them.
    urls = ["http://zorblatcasino.example.com/a", "http://zorblat.example.com/quimsy", "http://zorblat.b.example.com/", "http://quimsy.c.example.com/", "http://adultquimsypills.example.com/", "http://artisanzorblat.example.com/", "no scheme", None]
    urls += ["http://" + "ab" * 5000 + ".com/casinozorblat", "http://zorblat.example.com/quimsy", "http://artisan.d.example.com/", "http://мир.e.example.com/casino", "http://новыймир.e.example.com/", "http://новый.f.example.com/1"]
    df = reread([(k, u) for k, u in enumerate(urls)], "page_id long, url string", 3)
    got = {x.page_id: x for x in url_filter.judge(df).collect()}
    assert len(got) == len(urls)
    s = url_filter.Scorer({"zorblat": 2, "quimsy": 2, "zorblatcasino": 1, "adultquimsypills": 1, "a": 1, "b": 1, "c": 1, "d": 1, "artisan": 1, "example": 9, "мир": 1, "новыймир": 1, "новый": 1, "e": 1, "f": 1, "casino": 1, "artisanzorblat": 1, "casinozorblat": 1, "ab" * 5000: 1})
    assert s.split("zorblatcasino") == ["zorblat", "casino"] and s.split("quimsyzorblat") == ["quimsy", "zorblat"] and url_filter.Scorer({}).split("quimsyzorblat") == ["quimsyzorblat"]
    assert s.split("artisanzorblat") == ["artisan", "zorblat"] and url_filter.Scorer({}).split("artisanzorblat") != ["artisan", "zorblat"]
    for k, u in enumerate(urls):
        host, path = (u or "").partition("://")[2].partition("/")[::2]
        assert got[k].score == pytest.approx(s.score(host, "/" + path if host else ""))
    assert [got[k].verdict for k in (0, 4, 5)] == ["block", "block", "allow"]


def test_chat(spark, reread):
    calls = [
        (1, "a", "reply", '{"turn":1,"prompt":"x"}', None, 0), (1, "b", "reply", '{"turn":"z","prompt":"x","q":1}', "a", 0), (1, "c", "nope", "{}", "b", 0), (1, "d", "reply", "[1", "c", 0), (1, "d", "reply", "[1", "c", 0), (2, "p", "reply", '{"prompt":"é\\n","turn":3}', "q", 0),
        (2, "q", "reply", '{"prompt":null,"turn":3}', "p", 0), (3, None, "reply", None, None, 0), (None, None, None, None, None, 0), (4, "z", "reply", '{"turn":2.5,"prompt":"' + "w" * 100_000 + '"}', "missing", 0),
    ]
    calls += [(5, f"{k:03}", "reply", '{"prompt":"","turn":1}', f"{k - 1:03}", 0) for k in range(100)]
    results = [(1, "a", "res"), (1, "a", "res0"), (1, "zz", "orph"), (2, "p", None), (2, None, "n"), (5, "099", "end")]
    c = reread(calls, "conv_id long, call_id string, name string, arguments string, after string, status int")
    r = reread(results, "conv_id long, call_id string, content string")
    rows = chat.link_calls(c, r).collect()
    got = {(x.conv_id, x.call_id): x for x in sorted(rows, key=lambda x: x.json)}
    assert len(rows) == len(calls) - 1 + 3  # equal calls are one, a has two results, and two results have no call
    assert sorted(json.loads(x.json)["content"] for x in rows if (x.conv_id, x.call_id) == (1, "a")) == ["res", "res0"]
    position = {k: x.position for k, x in got.items()}
    assert [position[1, k] for k in "abcd"] == [0, 1, 2, 3] and position[2, "p"] is None and position[2, "q"] is None and position[4, "z"] == 0
    assert all(position[5, f"{k:03}"] == k for k in range(100))
    assert {k: x.status for k, x in got.items() if k[0] in (1, 4)} == {(1, "a"): "ok", (1, "b"): "invalid", (1, "c"): "invalid", (1, "d"): "invalid", (1, "zz"): "orphan", (4, "z"): "invalid"}
    assert got[1, "b"].faults == ["q: unknown", "turn: not integer"] and got[2, "q"].faults == ["prompt: missing"] and got[1, "c"].faults == ["name: unknown"] and got[4, "z"].faults == ["turn: not integer"]
    assert min(x.json for x in rows if (x.conv_id, x.call_id) == (1, "a")) == '{"arguments":{"prompt":"x","turn":1},"call_id":"a","content":"res","faults":[],"n_calls":1,"n_results":2,"name":"reply","position":0,"status":"ok"}'
    assert chat.link_calls(c.where("false"), r.where("false")).count() == 0
    turns = reread([(1, 0, "system", "s"), (1, 1, "User", "u"), (1, 2, "assistant", "a"), (1, 3, "user", None), (2, 9, "assistant", "lone"), (3, None, None, None)], "conv_id long, turn long, role string, text string")
    linked = chat.link_calls(*chat.turns_as_calls(turns))
    assert sorted((x.conv_id, x.call_id, x.status) for x in linked.collect()) == [(1, "1", "ok"), (1, "3", "invalid"), (2, "8", "orphan")]
    assert sorted(str(x.conv_id) for x in chat.messages(turns).collect()) == ["1", "3"]
    plan = linked._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_calls_are_all_kept(spark, reread):
    calls = [(1, "a", "reply", '{"prompt":"x","turn":1}', None), (1, "a", "reply", '{"prompt":"y","turn":1}', None), (1, "a", "reply", '{"prompt":"y","turn":1}', None), (1, "a", None, None, None)]
    results = [(1, "a", f"r{k % 50}") for k in range(100)]
    got = chat.link_calls(reread(calls, "conv_id long, call_id string, name string, arguments string, after string"), reread(results, "conv_id long, call_id string, content string")).collect()
    assert sorted(x.status for x in got) == ["invalid"] * 50 + ["repeated"] * 2 and {json.loads(x.json).get("content") for x in got if x.status == "invalid"} == {f"r{k}" for k in range(50)}
    assert {json.loads(x.json).get("n_calls") for x in got} == {4} and {json.loads(x.json).get("n_results") for x in got if x.status == "invalid"} == {100}
    assert {json.loads(x.json)["arguments"]["prompt"] for x in got if x.status == "repeated"} == {"x", "y"}


def test_depths_of_many_predecessors(spark):
    r = random.Random(6)
    for seed in range(4):
        edges = [(c, f"{k:02}", f"{r.randrange(k):02}" if seed < 3 or r.random() < 0.9 else f"{r.randrange(30):02}") for c in range(3) for k in range(1, 30) for _ in range(r.choice((0, 1, 1, 2, 3)))]
        calls = [(c, f"{k:02}", None) for c in range(3) for k in range(30)] + edges + [(0, "05", "gone"), (1, "07", None)]
        depth: dict = {}
        after = {}
        for c, k, a in edges:
            after.setdefault((c, k), set()).add((c, a))
        while new := {n: max([depth[p] + 1 for p in after.get(n, ())], default=0) for n in {(c, k) for c, k, _ in calls} - set(depth) if all(p in depth for p in after.get(n, ()))}:
            depth |= new
        got = {(x.conv, x.call): x.depth for x in chat.depths(spark.createDataFrame(calls, "conv long, call string, after string")).collect()}
        assert got == {(c, f"{k:02}"): depth.get((c, f"{k:02}")) for c in range(3) for k in range(30)}
