"""URL filters: rules by host and path, else naive Bayes over the words that unigram Viterbi splits host and path into."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivane.llm.common import BROADCAST_ROWS, by_value, materialise, row_key, small

#: (verdict, host, path). A rule fits its host and all subdomains, if the path starts with its path; the longest wins. Few rules: they are part of the plan.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Labelled hosts and paths that the classifier is fitted on, all of them. Written by hand; none is a host of the tables,
# though words recur there (casino, pills, farm), as a vocabulary of spam is a small one.
BLOCK = (
    "casino-online/bonus-spins online-poker/free-chips best-casino-slots/jackpot sports-bets/odds-win cheap-viagra/buy-pills discount-pills/no-prescription buy-meds-cheap "
    "adult-video/xxx free-porn/xxx-tube nude-cams/live-sex sex-dating/adult hot-girls-xxx escort-girls replica-watches/cheap fast-loans/payday-cash payday-loans-cheap win-prize/free-gift lottery-win/claim click-farm/ads "
    "ad-tracker/pixel popup-ads/click track-click/banner spam-links/seo malware-download/crack warez-crack/keygen torrent-crack/free hack-cheats/free-coins get-rich-quick/earn-money"
)
ALLOW = (
    "city-news/world daily-news/sports science-blog/physics history-museum/visit garden-club/plants school-library/books university-press/research health-clinic/doctors travel-guide/maps recipe-kitchen/cooking music-school/lessons "
    "film-review/cinema open-source/docs code-forum/questions weather-report/today local-market/food book-shop/catalog photo-gallery/art family-blog/stories home-garden/tools national-park/trails football-club/team car-repair/service "
    "bank-account/help tax-office/forms job-center/work data-portal/statistics space-agency/mission language-course/learn free-software/download free-encyclopedia/article child-care/parents village-church/events online-course/lesson"
)
#: Share of blocked URLs before any is seen, and what is added to each word's count.
PRIOR, SMOOTHING = 0.2, 0.5
#: A word that isn't known has this share, and less by a factor for each letter.
UNKNOWN, LETTER = 1e-4, 0.1
LONGEST = 24
#: A dictionary goes to every task if its words, of which BROADCAST_ROWS are allowed, have no more letters than this in all.
WORD_BYTES = 4 << 20
_WORD = regex.compile(r"\p{L}+")


def examples() -> list[tuple[bool, list[str]]]:
    return [(blocked, _WORD.findall(x)) for blocked, text in ((True, BLOCK), (False, ALLOW)) for x in text.split()]


def odds() -> dict[str, float]:
    """Log odds of the labelled words, the only ones that the classifier knows."""
    words = {b: Counter(w for blocked, x in examples() if blocked == b for w in x) for b in (True, False)}
    seen = words[True] | words[False]
    size = {b: sum(words[b].values()) + SMOOTHING * len(seen) for b in words}
    return {w: math.log((words[True][w] + SMOOTHING) / size[True]) - math.log((words[False][w] + SMOOTHING) / size[False]) for w in seen}


def best_split(name: str, own: Callable[[int, int], float]) -> list[str]:
    """The most likely words of a run of letters: Viterbi over unigrams. own(start, end): a part's log share."""
    best = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        best.append(max((best[start][0] + own(start, end), start) for start in range(max(0, end - LONGEST), end)))
    words, end = [], len(name)
    while end:
        words.append(name[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


class Scorer:
    """Splits names by the unigram counts of words, those of URLs and of the labelled examples, and scores the labelled ones.

    counts: the hosts that a run of letters stands in; total: the sum over all runs, where counts holds only some. A name's
    own host is no sign that it is one word, so it counts one host less for itself.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.seen = Counter(w for _, words in examples() for w in words)
        self.total = sum(self.seen.values()) + (sum(counts.values()) if total is None else total)
        self.counts, self.odds = counts, odds()
        self.split_names: dict[str, list[str]] = {}

    def share(self, word: str, name: str, counts: dict[str, int]) -> float:
        n = self.seen.get(word, 0) + max(0, counts.get(word, 0) - (word == name))
        return math.log(n / self.total) if n else math.log(UNKNOWN) + len(word) * math.log(LETTER)

    def split(self, name: str, counts: dict[str, int] | None = None) -> list[str]:
        """The most likely words of a run of letters. counts: those of its parts, by default all."""
        if counts is not None:
            return best_split(name, lambda a, b: self.share(name[a:b], name, counts))
        if name in self.split_names:
            return self.split_names[name]
        words = self.split(name, self.counts)
        if len(self.split_names) > 100_000:
            self.split_names.clear()
        if len(name) <= 64:
            self.split_names[name] = words
        return words

    def words(self, host: str, path: str) -> list[str]:
        """The words of a host without its last label (a country or a kind of owner, no word of a name), and of a path. Letters of all scripts count."""
        return [w for run in _WORD.findall(host.rpartition(".")[0].lower() + " " + path.lower()) for w in self.split(run)]

    def score(self, host: str, path: str) -> float:
        """Log odds that a URL is to be blocked; words outside the model don't count."""
        return math.log(PRIOR / (1 - PRIOR)) + sum(self.odds.get(w, 0.0) for w in self.words(host, path))


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(url, parts, 2)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _scored(counts: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(counts)
        for batch in batches:
            scores = [scorer.score(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return run


def _runs(host: Column, path: Column) -> Column:
    """The runs of letters that Scorer.words splits, as an array."""
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", F.regexp_replace(host, r"(?s)\.?[^.]*$", ""), path)), F.lit(r"(\p{L}+)"), F.lit(1))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names to (word, name), all distinct parts of up to LONGEST letters."""
    for batch in batches:
        for name in batch.column(0).to_pylist():
            for k in range(0, len(name), 4096):  # long names come in pieces
                words = sorted({name[a:b] for a in range(k, min(len(name), k + 4096)) for b in range(a + 1, min(len(name), a + LONGEST) + 1)})
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([name] * len(words), pa.string())], ["word", "name"])


def _name_odds(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer({}, total)
        for batch in batches:
            found = [(name, sum(scorer.odds.get(w, 0.0) for w in scorer.split(name, dict(parts or [])))) for name, parts in zip(batch.column("name").to_pylist(), batch.column("parts").to_pylist(), strict=True)]
            found = [x for x in found if x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["name", "odds"])

    return run


def _joined(own: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """own with scores, for a dictionary of any size: names meet the counts of their parts in a shuffled join, and then the URLs."""
    names = counts.select(F.col("word").alias("name"))
    # Parts that are no run of any URL have no count; a name is at least a part of itself, so none is lost.
    hits = names.mapInArrow(_parts, "word string, name string").distinct().join(counts, "word")
    parts = hits.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("word", "count"))).alias("parts"))
    odds_of = materialise(parts.mapInArrow(_name_odds(total), "name string, odds double"), "names")
    keyed = row_key(own, "_key")
    each = keyed.select("*", F.explode_outer(_runs(F.col("host"), F.col("path"))).alias("name")).join(small(odds_of), "name", "left")
    score = F.lit(math.log(PRIOR / (1 - PRIOR))) + F.coalesce(F.sum("odds"), F.lit(0.0))
    return each.groupBy("_key").agg(*(F.first(c).alias(c) for c in own.columns), score.alias("score")).drop("_key")


def judge(df: DataFrame, url: str = "url", id: str = "page_id", rules: tuple = RULES) -> DataFrame:
    """One row for each row of df: (page_id, host, path, rule, verdict, score).

    verdict is the rule's, else block where the classifier's log odds, score, are above zero. Names are split by a
    dictionary of all runs of letters in all URLs of df (for each the number of hosts, case aside, that it occurs with)
    and of the labelled words. Up to BROADCAST_ROWS runs of WORD_BYTES letters at most in all go to every task; more
    than that stay in tables and are joined with the parts of names, with the same results.
    Null urls and urls without :// have empty host and path; no rule fits them and the prior allows them. Repeated
    rows are judged each; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    host, path = host_and_path(F.col("url"))
    own = df.select(F.col(f"`{id}`").alias("page_id"), F.col(f"`{url}`").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    runs = own.select("host", F.explode(_runs(F.col("host"), F.col("path"))).alias("word")).distinct()
    counts = materialise(runs.groupBy("word").count(), "words")
    n, size, total = counts.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
    if n <= BROADCAST_ROWS and size <= WORD_BYTES:
        key = own.schema["page_id"].dataType.simpleString()
        scored = own.mapInArrow(_scored({r["word"]: r["count"] for r in counts.collect()}), f"page_id {key}, host string, path string, score double")
    else:
        scored = _joined(own, counts, total)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "score")


by_value(__name__)
