"""Quality rules: counts over whole texts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and word pairs are hashed into BUCKETS buckets. Their counts over all documents give the raw multinomial, those
over all trusted documents the target; a document's verdict is the mean log ratio over its n-grams against a fixed
threshold. All of it is built-in expressions: one pass counts (a shuffle of at most BUCKETS rows a task), one scores.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import let, sized, words

#: Both priors are shares of the target's own counts, so ratios and the threshold mean the same however large the corpus
#: is: SMOOTHING of them spread as in the raw text, RARE of them spread evenly, for which scarce buckets have ratios near 0.
BUCKETS, SMOOTHING, RARE, THRESHOLD = 1 << 16, 0.1, 1.0, -0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def grams(hashes: Column, n: int) -> Column:
    """Hashes of the n-grams of an array of word hashes."""
    count = F.greatest(F.size(hashes) - (n - 1), F.lit(0))
    return F.transform(F.slice(hashes, F.lit(1), count), lambda x, i: F.xxhash64(x, *(F.get(hashes, i + k) for k in range(1, n))))


def covered(hashes: Column, n: int = 3) -> Column:
    """Words in n-word windows, given their hashes in order, that occur twice or more."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.sort_array(
        F.transform(F.filter(s, lambda x, j: x["h"].eqNullSafe(F.get(s, j - 1)["h"]) | x["h"].eqNullSafe(F.get(s, j + 1)["h"])), lambda x: x["i"])
    )
    steps = lambda p: F.aggregate(F.transform(p, lambda x, j: F.coalesce(F.least(F.get(p, j + 1) - x, F.lit(n)), F.lit(n))), F.lit(0), lambda a, b: a + b)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(ordered, lambda s: let(twice(s), steps)))


def measures(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, and the word hashes `_w`. Null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    df = df.select(F.col(doc_id).alias("doc_id"), body.alias("_t"), words(body).alias("_words")).withColumn("_w", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_g", grams(F.col("_w"), 3))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "doc_id",
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        covered(F.col("_g")).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def buckets(hashes: Column) -> Column:
    """Buckets of the words and word pairs of a text."""
    return F.transform(F.concat(hashes, grams(hashes, 2)), lambda h: F.shiftrightunsigned(h, 48).cast("int"))


def log_ratios(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[float]:
    """log p(bucket | trusted) - log p(bucket | raw) for each bucket, both smoothed. `trusted`
    lists ids in `doc_id`. A corpus and its multiples have the same ratios.

    Without trusted documents all ratios are 0."""
    ids = trusted.select(F.col(doc_id).alias("_i")).where("_i IS NOT NULL").distinct()
    flagged = docs.select(F.col(doc_id).alias("_i"), F.col(text).alias("_t")).join(sized(ids.withColumn("_y", F.lit(1))), "_i", "left")
    hashes = F.transform(words(F.col("_t")), lambda w: F.xxhash64(w))
    seen = flagged.select("_y", hashes.alias("_w")).select("_y", F.explode(buckets(F.col("_w"))).alias("b"))
    counts = {r["b"]: (r["n"], r["t"]) for r in seen.groupBy("b").agg(F.count("*").alias("n"), F.count("_y").alias("t")).collect()}
    raw, target = (sum(c[k] for c in counts.values()) for k in (0, 1))
    if not target:
        return [0.0] * BUCKETS
    # Of a bucket: its counts if trusted text were like the raw text, and the prior of either side.
    even, prior = (lambda n: target * n / raw), RARE * target / BUCKETS
    ratio = lambda n, t: math.log((t + SMOOTHING * even(n) + prior) / ((1 + SMOOTHING) * even(n) + prior)) if n else 0.0
    return [ratio(*counts.get(b, (0, 0))) for b in range(BUCKETS)]


def assess(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    `kept` is false if a base rule fails, else whether `llr`, the mean log ratio of the text's n-grams, is at least
    `threshold`. Null and empty texts have llr 0 and fail the base rule. Repeated rows stay, each with its own verdict;
    null ids are never trusted; other columns are ignored; an empty table gives no rows.
    """
    # A constant of BUCKETS numbers; the optimizer turns it into one array literal.
    table = F.from_json(F.lit(json.dumps(log_ratios(docs, trusted, doc_id, text))), "array<double>")
    found = measures(docs, doc_id, text).withColumn("_b", buckets(F.col("_w")))
    total = F.aggregate("_b", F.lit(0.0), lambda a, b: a + F.get(table, b))
    found = found.withColumn("llr", F.when(F.size("_b") > 0, total / F.size("_b")).otherwise(0.0))
    kept = ~F.col("base_failed") & (F.col("llr") >= threshold)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "llr")
