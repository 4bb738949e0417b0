"""Quality rules combined by weak supervision, in DataFrame functions only.

Each rule looks at a few counts of a text and votes good (1), bad (-1) or abstains (0). The class of a document
is latent; expectation-maximisation estimates the share of good documents and, for each rule and class, the
chances of its three votes. A document's votes form a pattern of at most ``3 ** rules`` values, so one
aggregation counts patterns over all documents, and the iteration runs over that bounded table. The posterior
probability that a document is good then decides, instead of all rules having to pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT, ITERATIONS, KEEP_AT = 50, 50, 60, 0.5


def _without(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, ""))


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_odd")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_bangs, n_odd.

    n_repeat_words: windows of three words are hashed and packed with their place into one long and sorted, and those
    that agree with a neighbour are candidates: the place takes bits of the hash, fewer are left in long texts. The
    candidates are sorted again by their full hash, and only those whose three words equal a neighbour's count;
    they cover up to three words each. A null text counts as empty; a very long text is one row, counted whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    out = docs.withColumns({"__w": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "__lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": _without(text, r"[^#*$%&|<>]+").cast("long"),
            "n_upper": _without(text, r"[^\p{Lu}]+").cast("long"),
            "n_bangs": _without(text, r"[^!]+").cast("long"),
            "n_odd": _without(text, r"[\p{L}\p{M}\s.,;:?'-]+").cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__bits": F.length(F.bin(F.size("__w"))),
        }
    )
    w = F.col("__w")
    window = lambda i: _shift("shiftleft", F.xxhash64(w[i], w[i + 1], w[i + 2]), F.col("__bits")) + i
    places = F.when(F.size("__w") >= 3, F.transform(F.sequence(F.lit(0).cast("long"), (F.size("__w") - 3).cast("long")), window)).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("__sorted", F.sort_array(places))
    s = F.col("__sorted")
    key = lambda x: _shift("shiftright", x, F.col("__bits"))
    twin = lambda x, i: F.coalesce(key(F.get(s, i - 1)) == key(x), F.lit(False)) | F.coalesce(key(F.get(s, i + 1)) == key(x), F.lit(False))
    place = lambda x: x.bitwiseAND(_shift("shiftleft", F.lit(1).cast("long"), F.col("__bits")) - 1)
    full = lambda p: F.struct(F.xxhash64(w[p.cast("int")], w[(p + 1).cast("int")], w[(p + 2).cast("int")]).alias("h"), p.alias("p"))
    out = out.withColumn("__same", F.sort_array(F.transform(F.filter(s, twin), lambda x: full(place(x)))))
    same = F.col("__same")
    word = lambda x, k: w[(x["p"] + k).cast("int")]
    equal = lambda x, y: F.coalesce((x["h"] == y["h"]) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2)), F.lit(False))
    sure = F.filter(same, lambda x, i: equal(x, F.get(same, i - 1)) | equal(x, F.get(same, i + 1)))
    out = out.withColumn("__at", F.sort_array(F.transform(sure, lambda x: x["p"])))
    at = F.col("__at")
    cover = F.transform(at, lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - p, F.lit(3).cast("long"))))
    out = out.withColumn("n_repeat_words", F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x))
    return out.drop("__w", "__lines", "__bits", "__sorted", "__same", "__at")


def _shift(name: str, value: Column, bits: Column) -> Column:
    return F.call_function(name, value, bits)


def _three(bad: Column, good: Column) -> Column:
    """-1, 1 or 0; unknown values abstain."""
    return F.when(F.coalesce(bad, F.lit(False)), -1).when(F.coalesce(good, F.lit(False)), 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Name to vote over the columns of features()."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / n
    repeat, symbol, bang, odd = (F.col(c) / n for c in ("n_repeat_words", "n_symbols", "n_bangs", "n_odd"))
    upper = F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "length": _three(F.col("n_words") < 50, F.col("n_words") >= 100),
        "repetition": _three(repeat > 0.3, repeat < 0.15),
        "symbols": _three(symbol > 0.1, symbol < 0.02),
        "word_length": _three((mean < 2.5) | (mean > 12), (mean >= 3.5) & (mean <= 9)),
        "upper_case": _three(upper > 0.3, upper < 0.15),
        "lines": _three(dup > 0.3, (F.col("n_dup_lines") == 0) & (F.col("n_lines") >= 3)),
        "exclamation": _three(bang > 0.2, bang < 0.02),
        "odd_characters": _three(odd > 0.3, odd < 0.1),
    }


def fit(patterns: dict[tuple, int], iterations: int = ITERATIONS) -> dict[tuple, float]:
    """Posterior of good for each pattern of votes, from the patterns' counts; starts from documents without a bad vote as good."""
    post = {p: 0.05 if -1 in p else 0.95 for p in patterns}
    width = len(next(iter(patterns), ()))
    for _ in range(iterations):
        votes = [{v: [1.0, 1.0] for v in (-1, 1)} for _ in range(width)]
        size = [1.0, 1.0]
        for p, n in patterns.items():
            for c, share in ((0, 1 - post[p]), (1, post[p])):
                size[c] += n * share
                for r, v in enumerate(p):
                    if v:
                        votes[r][v][c] += n * share
        for p in patterns:
            odds = math.log(size[1]) - math.log(size[0])
            for r, v in enumerate(p):
                if v:  # an abstention says nothing
                    of = [votes[r][-1][c] + votes[r][1][c] for c in (0, 1)]
                    odds += math.log(votes[r][v][1] / of[1]) - math.log(votes[r][v][0] / of[0])
            post[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return post


def voted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with features(), base_failed, and the pattern of votes as one number in __code."""
    f = features(docs, text_col)
    f = f.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return f.withColumn("__code", sum(((v + 1) * 3**i for i, v in enumerate(rules().values())), F.lit(0)).cast("int"))


def posteriors(f: DataFrame) -> DataFrame:
    """(__code, quality) fitted on the documents of voted() that pass the base; at most 3 ** rules rows and as many failed."""
    counted = f.groupBy("base_failed", "__code").count().collect()
    counted = [r for r in counted if not r["base_failed"]]
    pattern = lambda c: tuple(c // 3**i % 3 - 1 for i in range(len(rules())))
    post = fit({pattern(r["__code"]): r["count"] for r in counted})
    return f.sparkSession.createDataFrame([(r["__code"], post[pattern(r["__code"])]) for r in counted], "__code int, quality double")


def _judged(f: DataFrame, table: DataFrame, keep_at: float) -> DataFrame:
    out = f.join(F.broadcast(table), "__code", "left").drop("__code")
    out = out.withColumn("quality", F.when(F.col("base_failed"), 0.0).otherwise(F.col("quality")))
    return out.withColumn("kept", F.col("quality") >= keep_at)


@C.plain_names((*FEATURES, "base_failed", "quality", "kept"))
def weak_supervision(docs: DataFrame, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """docs without their text, with features(), base_failed, quality (the posterior) and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows; it settles kept. The
    model is fitted on the other documents. A null text has no words and fails. An empty table gives an empty
    result, repeated rows equal ones. Input columns named like an added one are replaced. Features are written to the shared folder once,
    so that the fit and the verdicts read each text a single time.
    """
    f = C.saved(voted(docs, text_col).drop(text_col))
    return _judged(f, posteriors(f), keep_at)


def kept_documents(docs: DataFrame, text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that weak_supervision() keeps, with their columns as they are; null and blank texts go.

    Counts are computed twice, for the fit and for the verdicts, so that texts are neither shuffled nor stored.
    """
    packed = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text_col).alias("__text"))
    f = voted(packed, "__text")
    # A filter would be pushed below the counts and repeat their expressions; a join on a code that fails does not.
    f = f.select("__row", "base_failed", F.when(F.col("base_failed"), -1).otherwise(F.col("__code")).alias("__code"))
    good = posteriors(f).where(F.col("quality") >= keep_at).select("__code")
    return f.join(F.broadcast(good), "__code").select("__row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weak_supervision() of all documents; see there for nulls, blanks, repeats and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = weak_supervision(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 9).alias("quality"))
