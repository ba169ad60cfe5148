"""Benchmark decontamination by SimHash windows and exact shingle similarity.

A window of a document is as long as the item it is compared with, and items and windows are fingerprinted by the
SimHash of their word shingles. Fingerprints meet by a multi-index over BLOCKS blocks: if two differ in at most RADIUS
bits, some block differs in at most RADIUS // BLOCKS bits, so every block value that near to an item's is listed for
the item, and a window is looked up by its own block values. No pair within the radius is lost. Pairs that meet within
the radius are compared by the exact similarity of their weighted shingles (a shingle weighs its number of occurrences:
sum of minima over sum of maxima).

Which windows are fingerprinted: those that hold enough positions, in any order, whose shingle occurs in some item of
the window's size. A window that is similar enough to an item of that size always does. Equal windows are fingerprinted
and compared once, however many documents hold them. All of it is built-in expressions. What is shuffled are shingles
that occur in an item and windows around them, not texts; only documents with such a window are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import let, saved, sized, words
from skein.llm.quality_rules import grams

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of 64 bits are compared up to RADIUS differing bits: BLOCKS * (4 + 1) - 1, so that blocks differ in 4 at most.
BLOCKS, RADIUS = 4, 19


def shingles(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of the word shingles of a text, in order, letters in lower case, all but letters, marks and digits left
    out. A text of fewer than `width` words has none."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")
    return let(F.transform(words(plain), lambda w: F.xxhash64(w)), lambda hashes: grams(hashes, width))


def simhash(hashes: Column) -> Column:
    """The 64-bit fingerprint of an array of hashes: a bit is set if set in over half of them."""
    ones = lambda h, b: F.size(F.filter(h, lambda x: F.getbit(x, b) == 1))
    bit = lambda h, b: F.when(2 * ones(h, b) > F.size(h), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return let(hashes, lambda h: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(bit(h, b))))


def keys(fingerprint: Column, blocks: int = BLOCKS) -> Column:
    """The block values of a fingerprint, each with its block's number: array of (block, value)."""
    bits = 64 // blocks
    return F.array(*(F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fingerprint, bits * b).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int").alias("value")) for b in range(blocks)))


def near_keys(fingerprint: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """The block values that differ from a fingerprint's in at most radius // blocks bits. A fingerprint within `radius`
    of it has one of them: if each of its blocks differed in more, the sum would be over `radius`."""
    each = radius // blocks
    flips = F.filter(F.sequence(F.lit(0), F.lit((1 << 64 // blocks) - 1)), lambda m: F.bit_count(m) <= each)
    return F.flatten(F.transform(keys(fingerprint, blocks), lambda k: F.transform(flips, lambda m: F.struct(k["block"].alias("block"), k["value"].bitwiseXOR(m).alias("value")))))


def similarity(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of the occurrences of each shingle in two arrays."""
    count = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, h: s + F.least(count(a, h), count(b, h)))
    return shared / (F.size(a) + F.size(b) - shared)


def windows(docs: DataFrame, items: DataFrame, min_similarity: float = SIMILARITY) -> DataFrame:
    """`(doc_id, x, m, starts)` of `docs` (doc_id, text): per document and text (x tells a document's texts apart) and
    item size m, the starts of the windows of m shingles that may be similar to an item `(item, m)` of that size.

    Of a window of w and an item of m shingles, similarity s takes s / (1 + s) * (w + m) shared shingles; so many
    positions of the window have a shingle of an item of size m, whichever item that is."""
    known = saved(items.select("m", F.explode("item").alias("h")).distinct())
    found = docs.select("doc_id", shingles(F.col("text")).alias("_s")).where(F.size("_s") > 0)
    # An array's hash and length stand for the text from here on; rows that repeat a document and text are one.
    found = found.select("doc_id", F.xxhash64("_s").alias("x"), F.size("_s").alias("n"), F.posexplode("_s").alias("p", "h"))
    hits = found.join(sized(known), "h").groupBy("doc_id", "x", "n", "m").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    size = F.least("n", "m")
    hits = hits.withColumn("need", F.greatest(F.ceil(min_similarity / (1 + min_similarity) * (size + F.col("m")) - 1e-6).cast("int"), F.lit(1))).where(F.size("ps") >= F.col("need"))
    # The windows that hold the i-th and the need - 1 next hits.
    first = lambda i: F.greatest(F.get("ps", i + F.col("need") - 1) - size + 1, F.lit(0))
    last = lambda p: F.least(p, F.col("n") - size)
    starts = F.flatten(F.transform("ps", lambda p, i: F.when((i + F.col("need") <= F.size("ps")) & (first(i) <= last(p)), F.sequence(first(i), last(p))).otherwise(F.array().cast("array<int>"))))
    return hits.select("doc_id", "x", "m", F.array_distinct(starts).alias("starts")).where(F.size("starts") > 0)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", min_similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Per leaked (doc_id, item_id): similarity (of the best window), hamming and start_word (of the first such
    window) and n_windows that reach `min_similarity` and differ from the item in at most `radius` fingerprint bits.

    Items and documents of fewer than SHINGLE words have no shingles and so no leaks; null texts count as empty; rows
    with a null id take part like any other, rows that repeat an id are taken together. A document shorter than an item
    is compared whole. Items with the same text leak alike. Other columns are ignored; empty tables give no rows.
    Windows that tie go to the smaller start. A text is one value, so it must fit in a task; its length is not limited.
    """
    own = items.select(F.col(item_id).alias("item_id"), shingles(F.col(text)).alias("item")).where(F.size("item") > 0).distinct()
    own = saved(own.withColumn("item_print", simhash(F.col("item"))).withColumn("m", F.size("item")))
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hits = saved(windows(plain, own, min_similarity))
    ids = sized(saved(hits.select(F.col("doc_id").alias("_l")).distinct()))
    again = plain.join(ids, plain["doc_id"].eqNullSafe(ids["_l"]), "left_semi").select("doc_id", shingles(F.col("text")).alias("_s"))
    again = saved(again.withColumn("x", F.xxhash64("_s")).dropDuplicates(["doc_id", "x"])).select(F.col("doc_id").alias("_l"), F.col("x").alias("_x"), "_s")
    found = hits.join(again, F.col("doc_id").eqNullSafe(F.col("_l")) & (F.col("x") == F.col("_x"))).select("doc_id", "m", "_s", F.explode("starts").alias("start"))
    found = found.select("doc_id", "m", "start", F.slice("_s", F.col("start") + 1, F.col("m")).alias("window"))
    # Equal windows are one from here on, known by two hashes and their size; they are written down, else what follows
    # would be moved under the grouping and done for every copy.
    name = [F.xxhash64("window").alias("w1"), F.xxhash64(F.lit(1), F.reverse("window")).alias("w2")]
    found = saved(found.select("doc_id", "m", "start", *name, "window"))
    each = saved(found.groupBy("m", "w1", "w2").agg(F.first("window").alias("window")).withColumn("print", simhash(F.col("window"))))
    prints = each.select("m", "print").distinct()
    # The join of the multi-index: block values of windows and those near to an item's. Both grow, so it is shuffled.
    looked = prints.select("m", "print", F.explode(keys(F.col("print"), blocks)).alias("k")).select("m", "print", "k.*")
    listed = own.select("m", "item_print").distinct().select("m", "item_print", F.explode(near_keys(F.col("item_print"), radius, blocks)).alias("k")).select("m", "item_print", "k.*")
    met = looked.join(listed.hint("merge"), ["m", "block", "value"]).select("m", "print", "item_print", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))).alias("hamming"))
    met = saved(met.where(F.col("hamming") <= radius).distinct())
    # Exact: the distinct windows of a fingerprint against the items of the fingerprints it met.
    pairs = each.join(met, ["m", "print"]).join(own.select("item_id", "item", "m", "item_print"), ["m", "item_print"])
    pairs = pairs.withColumn("similarity", similarity(F.col("item"), F.col("window"))).where(F.col("similarity") >= min_similarity)
    pairs = saved(pairs.select("m", "w1", "w2", "item_id", "hamming", "similarity"))
    best = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("start").alias("start"), F.col("hamming").alias("hamming"))).alias("b")
    found = found.select("doc_id", "m", "start", "w1", "w2").distinct().join(sized(pairs), ["m", "w1", "w2"])
    return found.groupBy("doc_id", "item_id").agg(best, F.count("*").alias("n_windows")).select(
        "doc_id", "item_id", (-F.col("b.s")).alias("similarity"), F.col("b.hamming").cast("long").alias("hamming"), F.col("b.start").cast("long").alias("start_word"), "n_windows"
    )


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` without a leak; rows with a null id stay."""
    found = sized(saved(leaks(docs, items, doc_id, **options).select(F.col("doc_id").alias("_l")).distinct()))
    return docs.join(found, docs[doc_id] == found["_l"], "left_anti")
