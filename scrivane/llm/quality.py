"""Quality rules with DataFrame functions only: word, symbol and repetition counts, and divergence from language references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; percent of them
#: Histograms of shorter texts say too little; such texts pass the test concerned.
LEAST_CHARS, LEAST_COUNTED = 200, 100
#: Jensen-Shannon distances (base 2, 0 to 1) beyond which a text is not prose of its language. A text without any of the
#: common words is at 0.331 from them; LEAST_COUNTED words keep the noise of a sample of the language below MOST_COMMON.
MOST_CLASSES, MOST_COMMON = 0.2, 0.26

# Shares of character classes in prose, and common words of each language by rank.
CLASSES = {"lower": 0.8, "upper": 0.02, "space": 0.15, "digit": 0.003, "punctuation": 0.025, "other": 0.002}
COMMON = {
    "en": "the of and to a in is that it for was on with as be by",
    "de": "der die und in den von zu das sich mit auf des für ist nicht im",
    "fr": "de la le et les des en un du une que est pour qui dans par",
    "es": "de la que el en y los las se del un por con no una su",
}
#: The share of a language's k-th word by Zipf's law: FIRST * k ** -SLOPE.
FIRST, SLOPE = 0.05, 0.85


def common_shares() -> list[float]:
    return [FIRST * k**-SLOPE for k in range(1, 17)]


def _term(p: Column, q: Column) -> Column:
    """What one class with shares p and q adds to twice the divergence."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)


def _distance(twice: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), twice / 2))


def quality(df: DataFrame, text: str = "text", id: str = "doc_id", lang: str | None = "lang", whole: bool = False) -> DataFrame:
    """One row for each row of df: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, common_distance, kept; whole adds df's row as a struct, whole_row.

    kept: the base rules hold, the character-class histogram is within MOST_CLASSES of prose (texts of LEAST_CHARS
    or more), and the common words' histogram is within MOST_COMMON of the language's (texts of LEAST_COUNTED words
    or more in a language that has a reference; lang None, null or unknown: no such test). A distance that isn't
    tested is null. Null texts have no words and fail; repeated rows are judged each; an empty table gives an empty result.
    Other columns are ignored, whatever their names. Equal windows are told by 64-bit hashes.
    """
    language = F.col(f"`{lang}`").cast("string") if lang and lang in df.columns else F.lit(None).cast("string")
    own = df.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"), F.col(f"`{id}`").alias("_id"), F.lower(language).alias("_lang"), *([F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("whole_row")] if whole else []))
    carried = ["whole_row"] if whole else []
    rest = ["_id", "_lang", *carried]
    known = list(dict.fromkeys(w for words in COMMON.values() for w in words.split()))
    known += [w.capitalize() for w in known]

    one = own.select(
        *rest,
        F.array_remove(F.split("_text", f"[{SPACE}]+"), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("_lines"),
        F.length("_text").alias("_chars"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).alias("_upper"),
        F.regexp_replace("_text", r"\p{L}+", "").alias("_rest"),
    )
    two = one.select(
        *rest, "_chars", "_upper",
        F.size("_words").alias("_n"),
        F.length(F.array_join("_words", "")).alias("_word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("_dup_lines"),
        F.regexp_count("_rest", F.lit(f"[{SYMBOLS}]")).alias("_symbols"),
        F.length("_rest").alias("_not_letters"),
        F.regexp_count("_rest", F.lit(f"[{SPACE}]")).alias("_space"),
        F.regexp_count("_rest", F.lit(r"\p{Nd}")).alias("_digits"),
        F.regexp_count("_rest", F.lit(r"""[.,;:!?'"()\-]""")).alias("_points"),
        F.expr("CASE WHEN size(_words) >= 3 THEN transform(sequence(0, size(_words) - 3), i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))) ELSE cast(array() as array<bigint>) END").alias("_grams"),
        F.transform(F.filter("_words", lambda w: w.isin(known)), F.lower).alias("_common"),
    )
    # The windows of a text by hash and place, where any occur twice; then the places of those next to an equal one.
    three = two.withColumn("_sorted", F.expr("CASE WHEN size(array_distinct(_grams)) < size(_grams) THEN sort_array(transform(_grams, (h, i) -> named_struct('h', h, 'i', i))) ELSE cast(array() as array<struct<h:bigint,i:int>>) END"))
    three = three.withColumn("_starts", F.expr("filter(transform(_sorted, (x, k) -> CASE WHEN get(_sorted, k - 1).h = x.h OR get(_sorted, k + 1).h = x.h THEN cast(x.i as bigint) END), x -> x IS NOT NULL)"))
    three = three.withColumn("_starts", F.sort_array("_starts"))
    repeated = F.expr("aggregate(_starts, named_struct('sum', 0L, 'last', -3L), (a, p) -> named_struct('sum', a.sum + least(3L, p - a.last), 'last', p), a -> a.sum)")
    words = F.element_at(F.create_map(*(x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v.split()))))), F.col("_lang"))
    words = F.when(F.col("_lang").isin(*COMMON), words)
    counted = F.transform(words, lambda w: F.size(F.filter("_common", lambda x: x == w)))
    four = three.select(*rest, "_chars", "_upper", "_n", "_word_chars", "_dup_lines", "_symbols", "_not_letters", "_space", "_digits", "_points", repeated.alias("_repeat"), counted.alias("_counted"))

    base = (F.col("_n") < LEAST_WORDS) | (100 * F.col("_repeat") > MOST_REPEATED * F.col("_n"))
    total = F.col("_chars").cast("double")
    shares = {
        "lower": F.col("_chars") - F.col("_not_letters") - F.col("_upper"), "upper": F.col("_upper"), "space": F.col("_space"), "digit": F.col("_digits"),
        "punctuation": F.col("_points"), "other": F.col("_not_letters") - F.col("_space") - F.col("_digits") - F.col("_points"),
    }
    of_classes = _distance(sum((_term(shares[k] / total, F.lit(v)) for k, v in CLASSES.items()), F.lit(0.0)))
    n, like = F.col("_n").cast("double"), common_shares()
    each = [F.get("_counted", F.lit(k)) / n for k in range(len(like))]
    others = F.lit(1.0) - F.aggregate("_counted", F.lit(0), lambda a, x: a + x) / n
    of_common = _distance(sum((_term(p, F.lit(q)) for p, q in zip(each, like, strict=True)), _term(others, F.lit(1 - sum(like)))))
    last = four.select(
        F.col("_id").alias("doc_id"), F.col("_n").cast("long").alias("n_words"), F.col("_word_chars").cast("long").alias("word_chars"), F.col("_symbols").cast("long").alias("n_symbols"),
        F.col("_dup_lines").cast("long").alias("n_dup_lines"), F.col("_repeat").alias("n_repeat_words"), base.alias("base_failed"),
        F.when(F.col("_chars") >= LEAST_CHARS, of_classes).alias("class_distance"), F.when((F.col("_n") >= LEAST_COUNTED) & F.col("_counted").isNotNull(), of_common).alias("common_distance"),
        *carried,
    )
    fits = (F.coalesce("class_distance", F.lit(0.0)) <= MOST_CLASSES) & (F.coalesce("common_distance", F.lit(0.0)) <= MOST_COMMON)
    # Spark doesn't move filters below a projection that depends on the partition; moved, they would repeat all of the above.
    return last.withColumn("kept", ~F.col("base_failed") & fits & (F.spark_partition_id() >= 0))


def keep_good(df: DataFrame, text: str = "text", id: str = "doc_id", lang: str | None = "lang") -> DataFrame:
    """The rows of df that the rules keep, with all their columns; no shuffle and no join."""
    return quality(df, text, id, lang, whole=True).where("kept").select("whole_row.*")
