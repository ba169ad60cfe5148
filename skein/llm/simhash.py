"""SimHash fingerprints and the documents they link.

Candidates come from a grid: a fingerprint maps to the bit counts of its 32 segments, and two fingerprints at Hamming
distance d are at most d apart in the Manhattan distance of these counts. Each fingerprint is put in the grid cells
within half the radius of its own counts, so two within the radius always meet in a cell. What meets is verified by the
exact Hamming distance. Crowded cells are cut finer, so a dense group costs its size, not its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import components, forget, give_back, saved, short_batches, sized, spread

SEED = 42
SEGMENTS, WIDTH = 32, 2
#: Fingerprints link at so many differing bits; cells of up to so many fingerprints are compared pair by pair.
RADIUS, CROWD = 2, 32
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 15


def simhash(text: bytes, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a UTF-8 text: a bit is set if set in over half the hashes of its word shingles."""
    w = text.translate(_LOWER).split()
    if not w:
        return 0
    if len(w) <= shingle:
        grams, n = [b" ".join(w)], 1
    else:
        n = len(w) - shingle + 1
        grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        ones += np.unpackbits(h[i : i + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text column as a signed long; null counts as empty, whose fingerprint is zero."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t, shingle) for t in texts.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64))

    return of(F.coalesce(text, F.lit("")))


def cells(fp: Column) -> Column:
    """The grid cells within Manhattan distance 1 of a fingerprint's segment counts, two bits a segment."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))).cast("long") for i in range(SEGMENTS)]
    own = F.lit(0).cast("long")
    for i, c in enumerate(counts):
        own = own.bitwiseOR(F.shiftleft(c, 2 * i))
    near = [F.lit(0).cast("long")]  # of neighbours, what differs
    for i, c in enumerate(counts):
        up = F.when(c == 0, 1).when(c == 1, 3).cast("long")  # 0 to 1, 1 to 2
        down = F.when(c == 1, 1).when(c == 2, 3).cast("long")
        near += [F.shiftleft(up, 2 * i), F.shiftleft(down, 2 * i)]
    return F.transform(F.filter(F.array(*near), lambda d: d.isNotNull()), lambda d: own.bitwiseXOR(d))


def midpoints(fp: Column) -> Column:
    """The points of the Hamming cube within distance 1 of a fingerprint."""
    flips = [0] + [1 << b if b < 63 else -(1 << 63) for b in range(64)]
    return F.array(*(fp.bitwiseXOR(F.lit(x).cast("long")) for x in flips))


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges `(a, b)` between fingerprints `fp` (each once) at Hamming distance 1 or 2: enough of them to connect all
    that are linked.

    A grid range join: fingerprints that share a grid cell are the candidates, and their Hamming distance is computed.
    A cell with two fingerprints names the pair itself; those of up to `crowd` are joined. Fuller cells are cut finer,
    to points of the Hamming cube within half the radius: two fingerprints are within the radius if and only if they
    share such a point, at most 65 fingerprints are around one, and all around one link to the smallest of them. So
    no pair is lost and no cell's pairs are all emitted."""
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS
    placed = prints.select("fp", F.explode(cells(F.col("fp"))).alias("cell"))
    shared = saved(placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    edges = shared.where("n = 2").where(near("a", "b")).select("a", "b").distinct()
    more = saved(placed.join(sized(shared.where("n > 2").select("cell", "n")), "cell"))
    some = more.where(F.col("n") <= crowd)
    pairs = some.select("cell", F.col("fp").alias("a")).join(some.select("cell", F.col("fp").alias("b")), "cell")
    edges = edges.unionByName(pairs.where("a < b").where(near("a", "b")).select("a", "b").distinct())
    dense = more.where(F.col("n") > crowd).select("fp").distinct().select("fp", F.explode(midpoints(F.col("fp"))).alias("mid"))
    balls = dense.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = balls.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").where(near("a", "b"))
    return edges.unionByName(star.distinct())


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """Per row of `df`: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints at 2 or fewer differing bits link; component_id is the smallest doc_id that links reach, the row's own
    included (null if no reachable row has a doc_id). Null text counts as empty; texts without words share fingerprint
    zero. Rows that repeat a doc_id stay, each under its own text's component. Other columns are ignored; an empty
    table gives no rows.
    """
    short_batches(df.sparkSession)
    docs = saved(df.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), shingle).alias("fp")))
    prints = saved(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(spread(prints.select("fp"), "fp")))
    linked = prints.join(roots.withColumnRenamed("node", "fp"), "fp")
    lows = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = linked.join(lows, "root").select("fp", "component_id").where("component_id <> first OR first IS NULL")
    named = saved(prints.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return docs.join(named, "fp").select(F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def print_links(contents: DataFrame) -> DataFrame:
    """Edges `(a, b)` between keys of `contents(key, fp)`: enough of them to connect all whose fingerprints are equal or
    linked (see `links`)."""
    prints = saved(contents.groupBy("fp").agg(F.min("key").alias("first")))
    same = contents.join(prints, "fp").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    ends = links(spread(prints.select("fp"), "fp"))
    for c in ("a", "b"):
        ends = ends.join(prints.select(F.col("fp").alias(c), F.col("first").alias(f"key_{c}")), c)
    edges = saved(same.unionByName(ends.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))))
    forget(prints)
    return edges


#: Min-hash bands and rows of one: two texts at the least similarity share a band with probability 0.99999.
BANDS, BAND_ROWS = 64, 8
#: The pairs of a band's bucket are made in blocks of so many of its contents.
BLOCK = 512
#: Longs of a set's parity bits.
PARITY = 16
#: Near-dedup compares all pairs that are left at once if there are at most so many for each content.
PAIRS_EACH = 4
_MULTIPLIERS = (np.random.default_rng(11).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) << np.uint64(1)) | np.uint64(1)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; of the whole sequence if it is shorter."""
    w = text.translate(_LOWER).split()
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) > shingle else [b" ".join(w)] if w else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def band_hashes(hashes: np.ndarray) -> np.ndarray:
    """One hash per band of the min-hashes of a set; an empty set has the same ones everywhere."""
    low = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    mixed = hashes ^ (hashes >> np.uint64(32))
    for i in range(0, len(mixed), 256):
        np.minimum(low, (mixed[i : i + 256, None] * _MULTIPLIERS).min(axis=0), out=low)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        out = (out ^ low[k::BAND_ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def parity(hashes: np.ndarray) -> np.ndarray:
    """PARITY * 64 bits: whether the number of a set's hashes that fall on one is odd. A hash that two sets share changes
    both alike, so their bits differ in at most as many places as there are hashes in one of the sets only."""
    odd = np.bincount((hashes % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def may_reach(na: Column, nb: Column, xa: Column, xb: Column, least: float) -> Column:
    """False only if the Jaccard similarity of two sets is below `least` for certain, by their sizes and parity bits."""
    apart = F.lit(0)
    for i in range(PARITY):
        apart = apart + F.bit_count(xa[i].bitwiseXOR(xb[i]))
    # At similarity J, (1 - J) / (1 + J) of both sizes' sum is in one set only.
    return (F.least(na, nb) >= least * F.greatest(na, nb)) & ((1 + least) * apart <= (1 - least) * (na + nb) + 1e-6)


def similar_contents(df: DataFrame, text: str = "text", shingle: int = 5, min_similarity: float = 0.8, print_shingle: int | None = None) -> DataFrame:
    """`(key, root)` for every distinct content that is similar to another: the 16-byte MD5 of the text, and the smallest key
    that links reach. Two contents link if the Jaccard similarity of their sets of word shingles is at least
    `min_similarity`, and with `print_shingle` also if their fingerprints of so many words a shingle link, as in
    `near_duplicates`: by grid cells, then the Hamming distance.

    SimHash distances at that similarity reach far beyond what a radius search can index (about 10 of 64 bits), so for it
    candidates come from min-hash bands, of so many rows that a passage which texts share but are not similar for seldom
    fills one; pairs whose sizes or parity bits rule the similarity out for certain are
    dropped, and the rest is verified exactly. In a band's bucket each content is first compared with two heads only,
    the most central one (whose buckets are the fullest) and the one with the smallest key, so a large group costs its
    size. Then all pairs of a bucket that links don't connect yet are compared, in salted blocks: those that don't belong
    to the bucket's largest group with all others, so a group that is linked already isn't paired with itself. While these
    are many, one more head a bucket, another each turn, goes first: what it links need not be paired. No pair of a
    bucket is left out.
    """
    short_batches(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))

    @F.arrow_udf("struct<bands:array<long>,bits:array<long>,n:long,fp:long>")
    def sketch(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.cast(pa.binary()).to_pylist():
            s = shingle_set(t, shingle)
            fp = int(np.uint64(simhash(t, print_shingle)).view(np.int64)) if print_shingle else None
            rows.append({"bands": band_hashes(s).view(np.int64).tolist(), "bits": parity(s).tolist(), "n": len(s), "fp": fp})
        give_back()
        return pa.array(rows, pa.struct([("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("n", pa.int64()), ("fp", pa.int64())]))

    @F.arrow_udf("array<long>")
    def hashes(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t, shingle).view(np.int64) for t in texts.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))

    rows = df.select(F.unhex(F.md5(body)).alias("key"), sketch(body).alias("s")).select("key", "s.*")
    each = saved(rows.groupBy("key").agg(*(F.first(c).alias(c) for c in ("bands", "bits", "n", "fp"))))
    placed = each.select("key", F.explode("bands").alias("band"))
    # Tables that are joined by band are written down, so that the joins have plain exchanges and can split a hot band.
    full = saved(placed.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"))
    placed = saved(placed.join(full, "band"))
    central = placed.groupBy("key").agg(F.sum("size").alias("weight"))
    heads = placed.join(central, "key").groupBy("band").agg(F.max(F.struct("weight", "key")).alias("hub"), F.min("key").alias("low"))
    heads = saved(heads.select("band", F.array("hub.key", "low").alias("heads")))
    pairs = placed.join(heads, "band").select("key", F.explode("heads").alias("head"))
    pairs = pairs.where("key <> head").select(F.least("key", "head").alias("a"), F.greatest("key", "head").alias("b")).distinct()
    near = may_reach(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"), min_similarity)

    def verified(pairs: DataFrame) -> DataFrame:
        """The edges among pairs `(a, b, total)`; total is the sum of both sets' sizes."""
        pairs = saved(pairs)
        # Shingles of one text per content that is in a pair.
        wanted = saved(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
        texts = df.select(F.unhex(F.md5(body)).alias("key"), body.alias("_t")).join(sized(wanted), "key")
        sets = saved(texts.select("key", hashes(F.col("_t")).alias("h")).groupBy("key").agg(F.first("h").alias("h")))
        both = pairs.join(sets.select(F.col("key").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("key").alias("b"), F.col("h").alias("hb")), "b")
        both = both.select("a", "b", "total", F.size(F.array_intersect("ha", "hb")).alias("shared"))
        linked = saved(both.where(F.when(F.col("total") == 0, True).otherwise(F.col("shared") >= min_similarity * (F.col("total") - F.col("shared")))).select("a", "b"))
        forget(pairs), forget(wanted), forget(sets)
        return linked

    a = each.select(F.col("key").alias("a"), F.col("bits").alias("pa"), F.col("n").alias("na"))
    b = each.select(F.col("key").alias("b"), F.col("bits").alias("pb"), F.col("n").alias("nb"))
    named = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("na") + F.col("nb")).alias("total"))
    edges = verified(pairs.join(a, "a").join(b, "b").where(near).select(*named))
    if print_shingle:
        edges = edges.union(print_links(each.select("key", "fp")))
    turn, found = 0, True
    while True:
        roots = saved(components(edges).select(F.col("node").alias("key"), "root"))
        # The buckets that links don't connect yet, their largest groups, and what the bounds need.
        rooted = placed.select("key", "band").join(roots, "key", "left").select("key", "band", F.coalesce("root", "key").alias("root"))
        groups = rooted.groupBy("band", "root").agg(F.count("*").alias("n"))
        mixed = groups.groupBy("band").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
        mixed = mixed.select("band", F.col("most.root").alias("main"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).alias("blocks"))
        apart = saved(rooted.join(mixed, "band").join(each.select("key", "bits", "n"), "key"))
        if apart.isEmpty():
            return roots
        forget(roots)
        left = apart.select("band", "main", "blocks", F.col("key").alias("a"), F.col("root").alias("ra"), F.col("bits").alias("pa"), F.col("n").alias("na"))
        right = apart.select("band", "blocks", F.col("key").alias("b"), F.col("root").alias("rb"), F.col("bits").alias("pb"), F.col("n").alias("nb"))
        minor = left.where("ra <> main").withColumn("block", F.pmod(F.xxhash64("a"), "blocks")).drop("blocks")
        each_block = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        rest = minor.join(each_block, ["band", "block"]).where("ra <> rb AND (rb = main OR a < b)").where(near).select(*named)
        few = PAIRS_EACH * each.count()
        if not found or rest.limit(few + 1).count() <= few:
            return components(edges.union(verified(rest.distinct()))).select(F.col("node").alias("key"), "root")
        head = F.min_by(F.struct("b", "rb", "pb", "nb"), F.xxhash64(F.lit(turn), "band", "b")).alias("h")
        heads = right.groupBy("band").agg(head).select("band", "h.*")
        more = verified(left.join(heads, "band").where("ra <> rb").where(near).select(*named).distinct())
        # Turns end when they find little: the rest is then compared, however much it is.
        turn, found = turn + 1, 20 * more.count() > apart.select("key").distinct().count()
        edges = saved(edges.union(more))


def distinct_documents(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, min_similarity: float = 0.8, print_shingle: int | None = None
) -> DataFrame:
    """The rows of `df` without near-copies: of each group of similar contents (see `similar_contents`), copies
    included, the document with the smallest doc_id stays (null last), ties by content.

    Null text counts as empty; texts without words form one group. Rows that repeat the document that stays, id and
    text, stay with it. Other columns are kept; an empty table gives no rows.
    """
    key = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    roots = saved(similar_contents(df, text, shingle, min_similarity, print_shingle))
    ids = saved(df.select(F.col(doc_id).alias("_d"), key.alias("key")).groupBy("_d", "key").agg(F.count("*").alias("_n")))
    ids = ids.join(roots, "key", "left").select("_d", "key", F.coalesce("root", "key").alias("root"))
    stays = F.min(F.struct(F.col("_d").isNull().alias("null"), F.col("_d").alias("d"), F.col("key").alias("key"))).alias("s")
    ids = saved(ids)
    first = saved(ids.groupBy("root").agg(stays, F.count("*").alias("n")).where("n > 1").select("root", "s.d", F.col("s.key").alias("k")))
    gone = ids.join(first, "root").where(~(F.col("_d").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))).select("_d", "key")
    gone = sized(saved(gone))
    return df.join(gone, key.eqNullSafe(gone["key"]) & df[doc_id].eqNullSafe(gone["_d"]), "left_anti")
