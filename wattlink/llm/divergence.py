"""Quality rules by distribution divergence, in DataFrame functions only.

A document's character-class histogram and its histogram over a language's most common words are
compared with the references of every language, learned from the whole table, by Jensen-Shannon
distance (base 2, 0 to 1). The nearest language decides. Guards: under `min_words` words the base
rules reject anyway, and the word histogram is judged only from `min_words_for_words` words on.

Cases: a null text has no words and is rejected; a null language teaches nothing but is judged; where
no language has `min_reference_words` words there is no reference and the base rules decide alone.
Repeated rows are judged alike, each on its own. Extra columns pass through `keep_good` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wattlink.llm.common import words, written
from wattlink.operators.ranking import computed_once, top_per_key

WINDOW = 8
# character classes of the histogram; bytes beyond one per character stand for letters outside ASCII,
# and what no class names is the rest
CLASSES = {"_upper": "[A-Z]", "_digit": "[0-9]", "n_symbols": "[#*$%&|<>]"}
N_CLASSES = len(CLASSES) + 2


@dataclass(frozen=True)
class Limits:
    min_words: int = 20
    most_repeated_percent: int = 30
    common_words: int = 16
    common_letters: int = 5  # longer words do not count as common
    min_reference_words: int = 1000
    char_distance: float = 0.33
    word_distance: float = 0.31
    min_words_for_words: int = 60


def _with_words(docs: DataFrame, *keep: str) -> DataFrame:
    """_row: the columns to keep; _text, _words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return computed_once(docs.select(F.struct(*keep).alias("_row"), text.alias("_text")), _words=words(F.col("_text")))


def _with_chars(df: DataFrame) -> DataFrame:
    """_chars: histogram of the classes, in order; _length: its sum."""
    t = F.col("_text")
    df = computed_once(df, **{n: F.regexp_count(t, F.lit(p)).cast("long") for n, p in CLASSES.items()})
    beyond = F.octet_length(t) - F.length(t)
    rest = F.length(t) - sum((F.col(n) for n in CLASSES), F.lit(0))
    chars = F.array(*[c.cast("double") for c in [*map(F.col, CLASSES), beyond, rest]])
    return df.withColumn("_length", F.octet_length(t).cast("long")).withColumn("_chars", chars)


def _with_counts(df: DataFrame) -> DataFrame:
    joined = F.length(F.array_join("_words", "")).cast("long")
    return _with_chars(df).withColumn("n_words", F.size("_words").cast("long")).withColumn("word_chars", joined)


def _repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words: words inside windows of eight words that occur twice or more; n_dup_lines.

    Windows are compared by a 64-bit hash of their eight words. Only texts with a repeated window
    sort theirs: windows by (hash, position), then the repeated positions, and each of those covers
    the words up to the next one, eight at most.
    """
    def paired(column: str, apart: int) -> Column:
        a = F.col(column)
        later = F.slice(a, apart + 1, F.greatest(F.size(a) - apart, F.lit(0)))
        both = F.slice(a, 1, F.size(later))
        return F.zip_with(both, later, lambda x, y: F.xxhash64(x, y))

    def repeated(column: str) -> Column:
        return F.size(F.array_distinct(column)) < F.size(column)

    longs = F.array().cast("array<bigint>")
    df = computed_once(df, _h1=F.transform("_words", lambda w: F.xxhash64(w)))
    df = computed_once(df, _h2=paired("_h1", 1)).drop("_h1")
    df = computed_once(df, _h4=paired("_h2", 2)).drop("_h2")
    # a repeated window begins with a repeated half
    df = computed_once(df, _h8=F.when(repeated("_h4"), paired("_h4", 4)).otherwise(longs)).drop("_h4")
    ordered = F.when(
        repeated("_h8"), F.sort_array(F.transform("_h8", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    ).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))
    df = computed_once(df, _ordered=ordered).drop("_h8")
    s = F.col("_ordered")

    def again(x: Column, i: Column) -> Column:
        before, after = F.get(s, i - 1)["h"], F.get(s, i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    df = computed_once(df, _at=F.sort_array(F.transform(F.filter(s, again), lambda x: x["at"]))).drop("_ordered")
    at = F.col("_at")
    covered = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return computed_once(
        df,
        n_repeat_words=F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x),
        _lines=lines,
    ).drop("_at").withColumn(
        "n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
    ).drop("_lines")


def references(docs: DataFrame, limits: Limits = Limits()) -> list[dict]:
    """One entry per language: its share of every character class, its most common words and their
    shares, the remaining share last. Both statistics cover all texts; what comes back has a row per
    language and common word, whatever the corpus holds."""
    known = docs.where("lang IS NOT NULL")
    text = F.coalesce("text", F.lit("")).alias("_text")
    df = _with_chars(known.select(text, F.col("lang").alias("_lang")))
    shares = df.groupBy("_lang").agg(*[F.sum(F.col("_chars")[k]).alias(f"c{k}") for k in range(N_CLASSES)])
    # words too long to count as common become one marker each, so that all words are still counted
    long_word = r"[^\x20\x09-\x0D]{%d,}" % (limits.common_letters + 1)
    marker = "\x01" * (limits.common_letters + 1)
    short = words(F.regexp_replace("text", long_word, marker))
    counted = known.select(F.col("lang").alias("_lang"), F.explode(short).alias("word")).groupBy("_lang", "word").count()
    # the vocabulary of short words is read twice: for the totals and for the first places
    counted = written(counted, "common-words")
    totals = {r["_lang"]: r["n"] for r in counted.groupBy("_lang").agg(F.sum("count").alias("n")).collect()}
    counted = counted.where(F.col("word") != marker)
    # the window's partial group limit sends k rows per task and language, not the vocabulary
    top = top_per_key(counted, ["_lang"], [F.desc("count"), F.asc("word")], limits.common_words, "place")
    common: dict[str, list] = {}
    for row in top.orderBy("_lang", "place").collect():
        common.setdefault(row["_lang"], []).append((row["word"], row["count"]))
    out = []
    for row in shares.orderBy("_lang").collect():
        total, chars = totals.get(row["_lang"], 0), [row[f"c{k}"] for k in range(N_CLASSES)]
        if total < limits.min_reference_words:
            continue
        listed = common.get(row["_lang"], [])
        out.append({
            "lang": row["_lang"], "words": [w for w, _ in listed], "chars": [c / sum(chars) for c in chars],
            "shares": [c / total for _, c in listed] + [1 - sum(c for _, c in listed) / total],
        })
    return out


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms that sum to one."""
    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: half(a, b) + half(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def _doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def judged(docs: DataFrame, refs: list[dict], limits: Limits = Limits(), keep: tuple = ("*",)) -> DataFrame:
    """_row (struct of the columns to keep), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    nearest (struct: sum, lang, char_distance, word_distance; null where nothing can be compared), kept."""
    df = _repeats(_with_counts(_with_words(docs, *keep)))
    n = F.col("n_words")
    df = df.withColumn(
        "base_failed",
        (n < limits.min_words) | (100 * F.col("n_repeat_words") > limits.most_repeated_percent * n),
    )
    union = sorted({w for r in refs for w in r["words"]})
    if not union:
        nothing = F.lit(None).cast("struct<sum:double,lang:string,char_distance:double,word_distance:double>")
        return df.select("_row", *COUNTS, "base_failed", nothing.alias("nearest"), (~F.col("base_failed")).alias("kept"))
    # common words of the text, each between its own pair of blanks, which no word can hold
    hits = F.concat(F.lit(" "), F.array_join(F.filter("_words", lambda w: w.isin(union)), "  "), F.lit(" "))
    df = computed_once(df.drop("_text"), _hits=hits).drop("_words")
    counts = [
        (F.octet_length("_hits") - F.octet_length(F.replace("_hits", F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)
        for w in union
    ]
    df = computed_once(df, _counts=F.array(*counts)).drop("_hits")
    place = {w: k for k, w in enumerate(union)}
    refs_column = F.array(*[
        F.struct(F.lit(r["lang"]).alias("lang"), _doubles(r["chars"]).alias("chars"), _doubles(r["shares"]).alias("shares"),
                 F.array(*[F.lit(place[w]) for w in r["words"]]).alias("at"))
        for r in refs
    ])
    df = computed_once(df, _p=F.transform("_chars", lambda c: c / F.greatest(F.col("_length"), F.lit(1))))

    def compare(r: Column) -> Column:
        listed = F.transform(r["at"], lambda k: F.col("_counts")[k] / F.greatest(n, F.lit(1)))
        rest = F.greatest(F.lit(0.0), 1 - F.aggregate(listed, F.lit(0.0), lambda s, x: s + x))
        chars, common = _distance(F.col("_p"), r["chars"]), _distance(F.concat(listed, F.array(rest)), r["shares"])
        return F.struct((chars + common).alias("sum"), r["lang"].alias("lang"), chars.alias("char_distance"),
                        common.alias("word_distance"))

    df = computed_once(df, nearest=F.array_min(F.transform(refs_column, compare)))
    near = F.col("nearest")
    fits = (near["char_distance"] <= limits.char_distance) & (
        (n < limits.min_words_for_words) | (near["word_distance"] <= limits.word_distance)
    )
    return df.select("_row", *COUNTS, "base_failed", "nearest", (~F.col("base_failed") & fits).alias("kept"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, nearest language with distances, kept."""
    out = judged(docs, references(docs, limits), limits, ("doc_id",))
    return out.select("_row.doc_id", *COUNTS, "base_failed", "nearest", "kept")


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of `docs` that pass, with their own columns."""
    return judged(docs, references(docs, limits), limits).where("kept").select("_row.*")
