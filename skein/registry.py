"""Queries of the retrieval operators over the driver tables, each with its DuckDB equivalent.

Shared derivations: the corpus is documents with their embedding and, where there are any, labels; query vectors are
the embeddings whose id is divisible by 100; query texts are all benchmark items; the change feed is events, where
user_id names a document, event_id + 1 is the sequence number and an event of type error deletes.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.collection import Database
from skein.config import IvfConfig, PqConfig
from skein.functions import text as X
from skein.functions import vectors as V
from skein.functions.filters import StructFields, VariantFields, compile_filter
from skein.operators import bm25 as B
from skein.operators import fusion, ivf, metrics, pq, replicated, versions
from skein.operators.knn import exact_knn, nearest, pairwise
from skein.plans.planner import Planner
from skein.sources import jsonl
from skein.streaming import ingest

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Rows of a few numbers that may be broadcast, so that the texts they are joined with are not shuffled.
_SMALL_ROWS = 2_000_000


def corpus(spark: SparkSession, d: str, vectors: bool = True) -> DataFrame:
    """`vectors` False: without them, joined where the texts are read, and dealt out: texts with an embedding may lie in
    few files."""
    docs, emb, labels = (table(spark, d, n) for n in ("documents", "embeddings", "labels"))
    if not vectors:
        emb, labels = B.sized(emb.drop("embedding"), _SMALL_ROWS), B.sized(labels, _SMALL_ROWS)
        return docs.join(emb.withColumnRenamed("vec_id", "doc_id"), "doc_id").join(labels, "doc_id", "left").withColumnRenamed("doc_id", "id").repartition(4 * spark.sparkContext.defaultParallelism, "id")
    return docs.join(emb.withColumnRenamed("vec_id", "doc_id"), "doc_id").join(labels, "doc_id", "left").withColumnRenamed("doc_id", "id").withColumnRenamed("embedding", "vector")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))


def query_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def feed(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return table(spark, d, "events").select(F.col("user_id").alias("id"), (F.col("event_id") + 1).alias("seq"), op.alias("op"), "props", "value")


def shown(found: DataFrame, decimals: int = 6) -> DataFrame:
    """A result with its numbers rounded to what two engines agree on."""
    return found.select("qid", "id", *((F.round(c, decimals) + 0.0).alias(c) for c in ("distance", "score") if c in found.columns), "rank")


# ---- dense search

_CORPUS = """corpus AS (SELECT d.doc_id AS id, d.text, d.lang, d.source, d.n_chars, e.embedding::DOUBLE[] AS vector, e.label, l.quality, l.toxic
  FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_ROWS = "rows AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector FROM embeddings)"
_QUERIES = "asked AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS vector FROM embeddings WHERE vec_id % 100 = 0)"


def _distance_sql(metric: str, q: str, v: str) -> str:
    dot = f"list_inner_product({q}, {v})"
    if metric == "cosine":
        return f"1 - {dot} / (greatest(sqrt(list_inner_product({q}, {q})), 1e-12) * greatest(sqrt(list_inner_product({v}, {v})), 1e-12))"
    return f"-{dot}" if metric == "dot" else f"list_sum(list_transform(list_zip({q}, {v}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _score_sql(metric: str) -> str:
    return "1 - distance" if metric == "cosine" else "-distance"


def _knn_sql(metric: str, k: int, rows: str = "rows", ctes: str = "", more: str = "") -> str:
    return f"""WITH {ctes or _ROWS}, {_QUERIES},
d AS (SELECT qid, id, {_distance_sql(metric, "a.vector", "r.vector")} AS distance FROM asked a, {rows} r),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank FROM d)
SELECT qid, id, round(distance, 6) + 0.0 AS distance, round({_score_sql(metric)}, 6) + 0.0 AS score, rank{more} FROM o WHERE rank <= {k}"""


@query(_knn_sql("cosine", 10))
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return shown(exact_knn(rows(spark, d), query_vectors(spark, d), 10, "cosine"))


@query(_knn_sql("l2", 10))
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return shown(exact_knn(rows(spark, d), query_vectors(spark, d), 10, "l2"))


@query(_knn_sql("dot", 10))
def knn_dot(spark: SparkSession, d: str) -> DataFrame:
    return shown(exact_knn(rows(spark, d), query_vectors(spark, d), 10, "dot"))


@query(_knn_sql("cosine", 50))
def knn_batch_topk(spark: SparkSession, d: str) -> DataFrame:
    return shown(exact_knn(rows(spark, d), query_vectors(spark, d), 50, "cosine", block=3))


@query(_knn_sql("cosine", 10, "(SELECT * FROM corpus WHERE lang = 'en' AND n_chars > 300)", _CORPUS))
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    allowed = docs.where(compile_filter({"lang": "en", "n_chars": {"$gt": 300}}, StructFields(docs.schema)).predicate)
    return shown(exact_knn(allowed, query_vectors(spark, d), 10, "cosine"))


@query(f"""WITH {_ROWS}, q AS (SELECT vector AS q FROM rows WHERE id = 0), d AS (SELECT id, vector, {_distance_sql("l2", "q.q", "r.vector")} AS distance FROM rows r, q)
SELECT id, round(distance, 6) + 0.0 AS distance, round(-distance, 6) + 0.0 AS score, len(vector) AS dims, round(list_sum(vector), 6) AS vector_sum FROM d ORDER BY round(distance, 9), id LIMIT 10""")
def knn_include_vector(spark: SparkSession, d: str) -> DataFrame:
    base = rows(spark, d)
    found = nearest(base, base.where("id = 0").first()["vector"], 10, "l2")
    return found.select("id", (F.round("distance", 6) + 0.0).alias("distance"), (F.round("score", 6) + 0.0).alias("score"), F.size("vector").cast("long").alias("dims"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("vector_sum"))


@query(f"""WITH {_ROWS}, n AS (SELECT id, list_transform(vector, lambda x: x * 3 / greatest(sqrt(list_inner_product(vector, vector)) * 3, 1e-12)) AS u FROM rows
  UNION ALL SELECT -1, [0.0::DOUBLE, 0.0::DOUBLE])
SELECT id, round(u[1], 6) AS first, round(list_sum(u), 6) AS total, round(sqrt(list_inner_product(u, u)), 6) AS norm FROM n""")
def vector_normalize(spark: SparkSession, d: str) -> DataFrame:
    """All embeddings, three times as long, and a zero vector, brought to length 1."""
    some = rows(spark, d).select("id", F.transform("vector", lambda x: x.cast("double") * 3).alias("vector"))
    some = some.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.array(F.lit(0.0), F.lit(0.0)).alias("vector")))
    u = some.select("id", V.normalize(F.col("vector")).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda a, x: a + x)
    return u.select("id", F.round(F.get("u", 0), 6).alias("first"), F.round(total, 6).alias("total"), F.round(V.norm(F.col("u")), 6).alias("norm"))


_ODD_VECTORS = "(-1, ARRAY(CAST('NaN' AS DOUBLE))), (-2, ARRAY(CAST('Infinity' AS DOUBLE))), (-3, CAST(NULL AS ARRAY<DOUBLE>)), (-4, CAST(ARRAY() AS ARRAY<DOUBLE>)), (-5, ARRAY(CAST(NULL AS DOUBLE)))"


@query("""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, 64 AS dim FROM embeddings UNION ALL
  SELECT * FROM (VALUES (-1, ['nan'::DOUBLE], 1), (-2, ['inf'::DOUBLE], 1), (-3, NULL, 1), (-4, [], 1), (-5, [NULL::DOUBLE], 1)) t(id, vector, dim))
SELECT id, coalesce(len(vector) = dim AND len(list_filter(vector, lambda x: coalesce(isfinite(x), false))) = dim, false) AS valid FROM v""")
def vector_validate(spark: SparkSession, d: str) -> DataFrame:
    odd = spark.sql(f"SELECT CAST(id AS BIGINT) AS id, v AS vector FROM VALUES {_ODD_VECTORS} AS t(id, v)")
    good = rows(spark, d).select("id", V.is_valid(F.col("vector"), 64).alias("valid"))
    return good.unionByName(odd.select("id", V.is_valid(F.col("vector"), 1).alias("valid")))


@query(f"""WITH {_ROWS}, p AS (SELECT a.id AS id, a.vector AS a, b.vector AS b FROM rows a JOIN rows b ON b.id = a.id + 1)
SELECT id, round({_distance_sql("cosine", "a", "b")}, 6) AS cosine, round({_distance_sql("l2", "a", "b")}, 6) AS l2, round({_distance_sql("dot", "a", "b")}, 6) AS dot FROM p""")
def pairwise_distance(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding and the one with the next id."""
    a = rows(spark, d)
    pairs = a.withColumnRenamed("vector", "a").join(a.select((F.col("id") - 1).alias("id"), F.col("vector").alias("b")), "id")
    for m in ("cosine", "l2", "dot"):
        pairs = pairwise(pairs, "a", "b", m, m)
    return pairs.select("id", *(F.round(m, 6).alias(m) for m in ("cosine", "l2", "dot")))


# ---- metadata filters


def _struct_filter(name: str, spec: dict, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
        docs = docs.withColumn("author", F.struct("lang", F.struct("n_chars").alias("size"))).withColumn("tags", F.array("lang", "source")).withColumn("big", (F.lit(1 << 53) + F.col("doc_id") % 4))
        return docs.where(compile_filter(spec, StructFields(docs.schema)).predicate).select("doc_id")

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = f"SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE {where}"


_struct_filter("filter_eq", {"lang": "en", "toxic": 0}, "lang = 'en' AND coalesce(toxic = 0, false)")
_struct_filter("filter_ne_missing", {"quality": {"$ne": 1}}, "coalesce(quality <> 1, true)")
_struct_filter("filter_range", {"n_chars": {"$gte": 200, "$lt": 900}}, "n_chars >= 200 AND n_chars < 900")
_struct_filter("filter_whole_numbers", {"big": {"$in": [9007199254740993, 9007199254740994]}, "$not": {"big": 9007199254740992.0}}, "9007199254740992 + d.doc_id % 4 IN (9007199254740993, 9007199254740994)")
_struct_filter("filter_string_order", {"source": {"$gt": "n"}}, "source > 'n'")
_struct_filter("filter_between", {"n_chars": {"$between": [500, 1500]}}, "n_chars BETWEEN 500 AND 1500")
_struct_filter("filter_in", {"lang": {"$in": ["de", "fr"]}}, "lang IN ('de', 'fr')")
_struct_filter("filter_in_substring", {"lang": {"$in": "en-de"}}, "contains('en-de', lang)")
_struct_filter("filter_nin", {"quality": {"$nin": [0, 7]}}, "coalesce(quality NOT IN (0, 7), true)")
_struct_filter("filter_contains_str", {"text": {"$contains": "the"}}, "coalesce(contains(text, 'the'), false)")
_struct_filter("filter_contains_list", {"tags": {"$contains": "es"}}, "lang = 'es' OR source = 'es'")
_struct_filter("filter_regex", {"text": {"$regex": "[0-9]{3,}"}}, "coalesce(regexp_matches(text, '[0-9]{3,}'), false)")
_struct_filter("filter_exists", {"toxic": {"$exists": True}, "nothing": {"$exists": False}}, "toxic IS NOT NULL")
_struct_filter("filter_and_or_not", {"$and": [{"$or": [{"lang": "en"}, {"lang": "fr"}]}, {"$not": {"toxic": 1}}], "n_chars": {"$gt": 100}}, "(lang = 'en' OR lang = 'fr') AND NOT coalesce(toxic = 1, false) AND n_chars > 100")
_struct_filter("filter_empty_logic", {"$and": [], "$not": {"$or": []}}, "true")
_struct_filter("filter_nested_path", {"author.lang": "de", "author.size.n_chars": {"$gt": 400}}, "lang = 'de' AND n_chars > 400")
_struct_filter("filter_type_mismatch", {"$not": {"lang": {"$gt": 5}}, "n_chars": {"$ne": "many"}}, "true")


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) BETWEEN 20 AND 60 AND CAST(json_extract(props, '$.k') AS INTEGER) NOT IN (25, 50)")
def filter_json_variant(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", F.parse_json("props").alias("m"))
    spec = {"k": {"$between": [20, 60], "$nin": [25, 50]}, "missing": {"$ne": 1}, "k.deeper": {"$exists": False}}
    return events.where(compile_filter(spec, VariantFields("m")).predicate).select("event_id")


# ---- text

_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_CUT = "|".join(s for s in X.SUFFIXES if s not in ("ies", "ied"))


def _stem_sql(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '^.{{3,}}(ies|ied)$') THEN left({t}, length({t}) - 3) || 'y' ELSE regexp_replace({t}, '^(.{{3,}}?)({_CUT})$', '\\1') END"


def _terms_sql(text: str) -> str:
    words = f"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_'']+')"
    return f"list_transform(list_filter({words}, lambda w: w NOT IN ({_STOP})), lambda t: {_stem_sql('t')})"


_TOKENS = f"tokens AS (SELECT doc_id AS id, {_terms_sql('text')} AS terms FROM documents WHERE length(text) > 0)"


@query(f"WITH {_TOKENS} SELECT id, len(terms) AS n_terms, len(list_distinct(terms)) AS n_distinct FROM tokens")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "documents").where(F.length("text") > 0).select(F.col("doc_id").alias("id"), X.terms(F.col("text")).alias("terms"))
    return found.select("id", F.size("terms").cast("long").alias("n_terms"), F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"))


@query(f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_'']+')) AS t FROM documents)
SELECT t AS token, {_stem_sql('t')} AS stem FROM w""")
def stem_vocab(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(X.terms(F.col("text"), stopwords=None, stemmer=False)).alias("token")).distinct()
    return words.select("token", X.stem(F.col("token")).alias("stem"))


_POSTINGS = f"{_TOKENS}, posted AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM tokens) GROUP BY ALL)"


@query(f"WITH {_POSTINGS} SELECT term, id, tf FROM posted")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return B.postings(B.analyzed(table(spark, d, "documents"), "doc_id"))


@query(f"WITH {_TOKENS} SELECT id, len(terms) AS length FROM tokens")
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return B.analyzed(table(spark, d, "documents"), "doc_id").select("id", "length")


@query(f"WITH {_POSTINGS}, f AS (SELECT term, count(*) AS df FROM posted GROUP BY term), n AS (SELECT count(*) AS n FROM tokens) SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM f, n")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    return B.idf_table(B.analyzed(table(spark, d, "documents"), "doc_id")).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_POSTINGS} SELECT (SELECT count(*) FROM tokens) AS docs, count(DISTINCT term) AS terms, count(*) AS postings, (SELECT round(avg(len(terms)), 2) FROM tokens) AS avg_doc_len FROM posted")
def text_stats(spark: SparkSession, d: str) -> DataFrame:
    return B.text_stats(B.analyzed(table(spark, d, "documents"), "doc_id"))


def _bm25_ctes(query_text: str = "text", allow: str = "true", k: int = 10, base: str = "documents", id: str = "doc_id", items: str = "(SELECT item_id AS qid, text FROM benchmark)") -> str:
    return f"""tokens AS (SELECT {id} AS id, {allow} AS ok, {_terms_sql('text')} AS terms FROM {base} WHERE length(text) > 0),
posted AS (SELECT term, id, ok, count(*) AS tf FROM (SELECT id, ok, unnest(terms) AS term FROM tokens) GROUP BY ALL),
freq AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
totals AS (SELECT count(*) AS n, CASE WHEN avg(len(terms)) > 0 THEN avg(len(terms)) ELSE 1 END AS avgdl FROM tokens),
lens AS (SELECT id, len(terms) AS dl FROM tokens),
wanted AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_terms_sql(query_text)}) AS term FROM {items}) GROUP BY ALL),
bm AS (SELECT qid, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM wanted JOIN posted USING (term) JOIN freq USING (term) JOIN lens USING (id), totals WHERE ok GROUP BY qid, id),
lexical AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM bm QUALIFY rank <= {k})"""


_LEXICAL = "SELECT qid, id, round(score, 6) AS score, rank FROM lexical"


@query(f"WITH {_bm25_ctes()} {_LEXICAL}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return shown(B.bm25(table(spark, d, "documents"), query_texts(spark, d), 10, id="doc_id"))


@query(f"WITH {_bm25_ctes(query_text=chr(40) + 'text || chr(32) || text' + chr(41))} {_LEXICAL}")
def bm25_repeated_terms(spark: SparkSession, d: str) -> DataFrame:
    twice = query_texts(spark, d).withColumn("text", F.concat("text", F.lit(" "), "text"))
    return shown(B.bm25(table(spark, d, "documents"), twice, 10, id="doc_id"))


@query(f"WITH {_bm25_ctes(allow=chr(40) + 'lang = ' + repr('en') + chr(41))} {_LEXICAL}")
def bm25_filtered_global_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return shown(B.bm25(docs, query_texts(spark, d), 10, id="doc_id", allow=compile_filter({"lang": "en"}, StructFields(docs.schema)).predicate))


# ---- fusion: a query is a benchmark item with the embedding of the same number


def _hybrid_queries(spark: SparkSession, d: str) -> DataFrame:
    return query_texts(spark, d).join(rows(spark, d).withColumnRenamed("id", "qid"), "qid")


def _hybrid_ctes(k: int, dense_where: str = "true", items: str = "(SELECT item_id AS qid, text FROM benchmark)") -> str:
    return f"""{_CORPUS}, {_bm25_ctes(base="corpus", id="id", allow=dense_where, k=k, items=items)},
q AS (SELECT b.item_id AS qid, e.embedding::DOUBLE[] AS vector FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
dd AS (SELECT qid, id, {_distance_sql("cosine", "q.vector", "c.vector")} AS distance FROM q, corpus c WHERE {dense_where}),
dense AS (SELECT qid, id, 1 - distance AS score, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank FROM dd QUALIFY rank <= {k}),
both_lists AS (SELECT qid, id, score, rank, 0 AS list FROM dense UNION ALL SELECT qid, id, score, rank, 1 FROM lexical WHERE qid IN (SELECT qid FROM q))"""


def _rrf_sql(k: int | None, w0: float = 1.0, w1: float = 1.0, rrf_k: float = 60.0) -> str:
    cut = f" QUALIFY rank <= {k}" if k else ""
    return f"""fused AS (SELECT qid, id, sum(CASE list WHEN 0 THEN {w0} ELSE {w1} END / ({rrf_k} + rank)) AS score, min(rank) FILTER (list = 0) AS r0, min(rank) FILTER (list = 1) AS r1 FROM both_lists GROUP BY qid, id),
ranked AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, r0 NULLS LAST, r1 NULLS LAST, id) AS rank FROM fused{cut})"""


#: A query whose text matches nothing keeps its dense scores.
_MERGED = "SELECT r.qid, r.id, round(CASE WHEN r.qid IN (SELECT qid FROM lexical) THEN r.score ELSE d.score END, 6) AS score, r.rank FROM ranked r LEFT JOIN dense d ON d.qid = r.qid AND d.id = r.id"


def _lists(spark: SparkSession, d: str, k: int, spec: dict | None = None, texts: DataFrame | None = None) -> list[DataFrame]:
    docs, asked = corpus(spark, d), _hybrid_queries(spark, d)
    allow = compile_filter(spec, StructFields(docs.schema)).predicate
    asked = asked if texts is None else asked.drop("text").join(texts, "qid")
    return [exact_knn(docs.where(allow), asked, k, "cosine"), B.bm25(corpus(spark, d, vectors=False), asked, k, allow=allow)]


@query(f"WITH {_hybrid_ctes(20)}, {_rrf_sql(None)} SELECT qid, id, round(score, 6) AS score, rank FROM ranked")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return shown(fusion.reciprocal_rank_fusion(_lists(spark, d, 20)))


@query(f"WITH {_hybrid_ctes(20)}, {_rrf_sql(15, 0.3, 1.7, 10.0)} SELECT qid, id, round(score, 6) AS score, rank FROM ranked")
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return shown(fusion.reciprocal_rank_fusion(_lists(spark, d, 20), [0.3, 1.7], rrf_k=10.0, k=15))


@query(f"""WITH {_hybrid_ctes(20)}, s AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM both_lists WINDOW w AS (PARTITION BY qid, list)),
f AS (SELECT qid, id, sum(CASE list WHEN 0 THEN 0.4 ELSE 0.6 END * CASE WHEN hi - lo < 1e-12 THEN 1 ELSE (score - lo) / (hi - lo) END) AS score, min(rank) FILTER (list = 0) AS r0, min(rank) FILTER (list = 1) AS r1 FROM s GROUP BY qid, id)
SELECT qid, id, round(score, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, r0 NULLS LAST, r1 NULLS LAST, id) AS rank FROM f""")
def weighted_minmax_fuse(spark: SparkSession, d: str) -> DataFrame:
    return shown(fusion.weighted_fusion(_lists(spark, d, 20), [0.4, 0.6]), 9)


@query(f"WITH {_hybrid_ctes(10, dense_where=chr(40) + 'lang = ' + repr('en') + chr(41))}, {_rrf_sql(10)} {_MERGED.replace("r.rank", "r.rank, c.lang, c.n_chars")} JOIN corpus c ON c.id = r.id")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: vector and text, English documents only, ten hits with their metadata."""
    docs = corpus(spark, d)
    hits = fusion.merge(*_lists(spark, d, 10, {"lang": "en"}), 10)
    # To count the hits first would search twice.
    return docs.select("id", "lang", "n_chars").join(shown(hits), "id").select("qid", "id", "score", "rank", "lang", "n_chars")


@query(f"WITH {_hybrid_ctes(40)}, {_rrf_sql(10)} {_MERGED}")
def hybrid_oversample(spark: SparkSession, d: str) -> DataFrame:
    plan = Planner().plan(k=10, live=0, filt=compile_filter(None, StructFields(corpus(spark, d).schema)), has_vector=True, has_text=True, oversample=4.0)
    return shown(fusion.merge(*_lists(spark, d, plan.fetch_k), plan.k))


_HALF = "(SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN text ELSE 'xqzzyk' END AS text FROM benchmark)"


@query(f"WITH {_hybrid_ctes(10, items=_HALF)}, {_rrf_sql(10)} {_MERGED}")
def hybrid_fallback_dense(spark: SparkSession, d: str) -> DataFrame:
    """Texts that match nothing leave the dense scores; queries with both lists are fused."""
    texts = query_texts(spark, d).withColumn("text", F.when(F.col("qid") % 2 == 0, F.col("text")).otherwise("xqzzyk"))
    return shown(fusion.merge(*_lists(spark, d, 10, texts=texts), 10))


# ---- versions

_FEED = "feed AS (SELECT user_id AS id, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, props, value FROM events)"
_BORN = f"{_FEED}, born AS (SELECT *, seq AS born, coalesce(lead(seq) OVER (PARTITION BY id ORDER BY seq), 4611686018427387904) AS dead FROM feed)"


@query(f"WITH {_BORN} SELECT id, seq, props FROM born WHERE op = 'put' AND dead = 4611686018427387904")
def mvcc_current(spark: SparkSession, d: str) -> DataFrame:
    return versions.visible_at(feed(spark, d)).select("id", "seq", "props")


@query(f"WITH {_BORN} SELECT id, seq, props FROM born WHERE op = 'put' AND born <= 5000 AND 5000 < dead")
def mvcc_as_of(spark: SparkSession, d: str) -> DataFrame:
    return versions.visible_at(feed(spark, d), 5000).select("id", "seq", "props")


@query(f"WITH {_BORN} SELECT id, op, born, dead FROM born")
def mvcc_intervals(spark: SparkSession, d: str) -> DataFrame:
    return versions.intervals(feed(spark, d)).select("id", "op", "born", "dead")


@query(f"WITH {_BORN} SELECT id, born, dead FROM born WHERE op = 'put' AND dead <= 7000")
def vacuum_candidates(spark: SparkSession, d: str) -> DataFrame:
    upto = versions.horizon([7000, 9000], 10_000)
    return versions.vacuum_candidates(feed(spark, d), upto).select("id", "born", "dead")


@query(f"WITH {_BORN} SELECT id, seq, op FROM born WHERE NOT (dead <= 7000 OR (op = 'delete' AND born <= 7000))")
def vacuum_retained(spark: SparkSession, d: str) -> DataFrame:
    return versions.retained(feed(spark, d), 7000).select("id", "seq", "op")


@query(f"WITH {_FEED}, l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM feed) SELECT id, seq, round(value, 6) AS value FROM l WHERE r = 1 AND op = 'put'")
def compact_latest(spark: SparkSession, d: str) -> DataFrame:
    return versions.latest(feed(spark, d)).select("id", "seq", F.round("value", 6).alias("value"))


@query(f"""WITH {_FEED}, l AS (SELECT id, arg_max(op, seq) AS op, count(*) FILTER (op = 'put') AS puts, count(*) AS n, min(seq) AS lo, max(seq) AS hi FROM feed GROUP BY id)
SELECT count(*) FILTER (op = 'put') AS live, count(*) FILTER (op = 'delete') AS tombstones, sum(puts)::BIGINT AS versions, sum(n)::BIGINT AS log_rows, min(lo) AS min_seq, max(hi) AS max_seq FROM l""")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return versions.store_stats(feed(spark, d))


@query(f"WITH {_FEED} SELECT id, max(seq) AS seq FROM feed WHERE seq > 9000 AND id IN (SELECT c_custkey FROM customer) GROUP BY id")
def txn_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """A transaction that began at 9000 and writes every customer's document."""
    return versions.conflicts(feed(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("id")), 9000)


@query(f"""WITH {_ROWS}, {_QUERIES}, f AS (SELECT user_id AS id, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, event_id % (SELECT count(*) FROM embeddings) AS vec FROM events),
b AS (SELECT *, coalesce(lead(seq) OVER (PARTITION BY id ORDER BY seq), 4611686018427387904) AS dead FROM f),
v AS (SELECT b.id, r.vector FROM b JOIN rows r ON r.id = b.vec WHERE op = 'put' AND seq <= 5000 AND 5000 < dead),
o AS (SELECT qid, v.id, {_distance_sql("cosine", "a.vector", "v.vector")} AS distance FROM asked a, v),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank FROM o)
SELECT qid, id, round(distance, 6) + 0.0 AS distance, round(1 - distance, 6) + 0.0 AS score, rank FROM k WHERE rank <= 10""")
def knn_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Nearest documents among those visible at 5000; a version's vector is the embedding its event's number points to."""
    emb = rows(spark, d).withColumnRenamed("id", "vec")
    log = feed(spark, d).withColumn("vec", (F.col("seq") - 1) % emb.count())
    return shown(exact_knn(versions.visible_at(log, 5000).join(emb, "vec"), query_vectors(spark, d), 10, "cosine"))


# ---- approximate search with fixed centroids and codes (the vectors with an id below 16), so SQL gives the same


def _fixed(spark: SparkSession, d: str) -> np.ndarray:
    return np.array([r["vector"] for r in rows(spark, d).where("id < 16").orderBy("id").collect()], np.float64)


def _book(spark: SparkSession, d: str) -> np.ndarray:
    return np.stack(np.split(_fixed(spark, d), 8, axis=1))


_CODES = f"""{_ROWS}, centers AS (SELECT id AS code, vector FROM rows WHERE id < 16), subs AS (SELECT unnest(range(0, 8)) AS s),
parts AS (SELECT id, s, vector[s * 8 + 1 : s * 8 + 8] AS part FROM rows, subs), book AS (SELECT code, s, vector[s * 8 + 1 : s * 8 + 8] AS part FROM centers, subs),
near AS (SELECT p.id, p.s, b.code, {_distance_sql("l2", "p.part", "b.part")} AS e FROM parts p JOIN book b USING (s)),
codes AS (SELECT id, s, code, e FROM near QUALIFY row_number() OVER (PARTITION BY id, s ORDER BY round(e, 9), code) = 1)"""


@query(f"WITH {_CODES} SELECT id, s::INTEGER AS s, code::INTEGER AS code FROM codes")
def pq_encode_fixed_codebook(spark: SparkSession, d: str) -> DataFrame:
    coded = rows(spark, d).select("id", pq.encode(F.col("vector"), _book(spark, d), "l2").alias("codes"))
    return coded.select("id", F.posexplode("codes").alias("s", "code")).select("id", "s", F.col("code").cast("int").alias("code"))


@query(f"WITH {_CODES} SELECT id, round(sum(e), 6) AS error FROM codes GROUP BY id")
def pq_decode_error(spark: SparkSession, d: str) -> DataFrame:
    book = _book(spark, d)
    coded = rows(spark, d).withColumn("back", pq.decode(pq.encode(F.col("vector"), book, "l2"), book))
    return coded.select("id", F.round(V.squared_l2(F.col("vector"), F.col("back")), 6).alias("error"))


_ADC = f"""{_CODES}, {_QUERIES}, qparts AS (SELECT qid, s, vector[s * 8 + 1 : s * 8 + 8] AS part FROM asked, subs),
tab AS (SELECT qid, s, code, {_distance_sql("l2", "q.part", "b.part")} AS v FROM qparts q JOIN book b USING (s)),
adc AS (SELECT t.qid, c.id, sum(t.v) AS distance FROM codes c JOIN tab t ON t.s = c.s AND t.code = c.code GROUP BY t.qid, c.id)"""


@query(f"""WITH {_ADC}, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank FROM adc)
SELECT qid, id, round(distance, 6) + 0.0 AS distance, round(-distance, 6) + 0.0 AS score, rank FROM o WHERE rank <= 10""")
def pq_adc(spark: SparkSession, d: str) -> DataFrame:
    book = _book(spark, d)
    coded = rows(spark, d).select("id", pq.encode(F.col("vector"), book, "l2").alias("codes"))
    return shown(pq.adc_knn(coded, query_vectors(spark, d), book, 10, "l2"))


@query(f"""WITH {_ADC}, c AS (SELECT qid, id FROM adc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) <= 80),
x AS (SELECT c.qid, c.id, {_distance_sql("l2", "a.vector", "r.vector")} AS distance FROM c JOIN asked a USING (qid) JOIN rows r ON r.id = c.id),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank FROM x)
SELECT qid, id, round(distance, 6) + 0.0 AS distance, round(-distance, 6) + 0.0 AS score, rank FROM o WHERE rank <= 10""")
def pq_two_stage_rerank(spark: SparkSession, d: str) -> DataFrame:
    book = _book(spark, d)
    coded = rows(spark, d).withColumn("codes", pq.encode(F.col("vector"), book, "l2"))
    return shown(pq.two_stage(coded, query_vectors(spark, d), book, 10, "l2", 8))


@query(f"""WITH {_ROWS}, subs AS (SELECT unnest(range(0, 8)) AS s), c AS (SELECT id AS code, vector FROM rows WHERE id < 16), book AS (SELECT code, s, vector[s * 8 + 1 : s * 8 + 8] AS part FROM c, subs)
SELECT a.s::INTEGER AS s, a.code::INTEGER AS a, b.code::INTEGER AS b, round({_distance_sql("l2", "a.part", "b.part")}, 9) AS distance FROM book a JOIN book b USING (s)""")
def pq_centroid_distances(spark: SparkSession, d: str) -> DataFrame:
    """The table of distances between codes, per subspace. Embeddings have few decimals, so exact sums may end in a 5 at
    the seventh; nine decimals are the same in every engine."""
    tables = pq.centroid_tables(_book(spark, d), "l2")
    return spark.createDataFrame([(s, a, b, round(float(tables[s, a, b]), 9)) for s, a, b in np.ndindex(*tables.shape)], "s int, a int, b int, distance double")


_CELLS = f"""{_ROWS}, centers AS (SELECT id AS cell, vector FROM rows WHERE id < 16),
cells AS (SELECT r.id, r.vector, c.cell FROM rows r, centers c QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY round({_distance_sql("l2", "r.vector", "c.vector")}, 9), c.cell) = 1)"""


def _indexed(spark: SparkSession, d: str, centroids: np.ndarray) -> DataFrame:
    return rows(spark, d).withColumn("cell", ivf.assign(F.col("vector"), centroids, "l2"))


@query(f"WITH {_CELLS} SELECT id, cell::INTEGER AS cell FROM cells")
def ivf_assign_fixed_centroids(spark: SparkSession, d: str) -> DataFrame:
    return _indexed(spark, d, _fixed(spark, d)).select("id", "cell")


_PROBE = f"""{_CELLS}, {_QUERIES}, looked AS (SELECT qid, cell, a.vector FROM asked a, centers c QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round({_distance_sql("l2", "a.vector", "c.vector")}, 9), cell) <= 4),
pd AS (SELECT l.qid, c.id, {_distance_sql("l2", "l.vector", "c.vector")} AS distance FROM looked l JOIN cells c USING (cell)),
probed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) AS rank FROM pd QUALIFY rank <= 10)"""


@query(f"WITH {_PROBE} SELECT qid, id, round(distance, 6) + 0.0 AS distance, round(-distance, 6) + 0.0 AS score, rank FROM probed")
def ivf_probe(spark: SparkSession, d: str) -> DataFrame:
    centroids = _fixed(spark, d)
    return shown(ivf.probe(_indexed(spark, d, centroids), query_vectors(spark, d), centroids, 10, 4, "l2"))


@query(f"WITH {_CELLS}, n AS (SELECT cell, count(*) AS n FROM cells GROUP BY cell) SELECT cell::INTEGER AS cell, n, round(n / (SELECT avg(n) FROM n), 6) AS skew FROM n")
def ivf_cell_stats(spark: SparkSession, d: str) -> DataFrame:
    return ivf.cell_stats(_indexed(spark, d, _fixed(spark, d))).withColumn("skew", F.round("skew", 6))


@query(f"""WITH {_PROBE}, ed AS (SELECT qid, r.id, {_distance_sql("l2", "a.vector", "r.vector")} AS distance FROM asked a, rows r),
truth AS (SELECT qid, id FROM ed QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), id) <= 10),
n AS (SELECT t.qid, count(p.id) AS n FROM truth t LEFT JOIN probed p ON p.qid = t.qid AND p.id = t.id GROUP BY t.qid) SELECT round(avg(n / 10), 6) AS recall FROM n""")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    centroids, asked = _fixed(spark, d), query_vectors(spark, d)
    found = ivf.probe(_indexed(spark, d, centroids), asked, centroids, 10, 4, "l2")
    return metrics.recall_at_k(found, exact_knn(rows(spark, d), asked, 10, "l2"), 10).withColumn("recall", F.round("recall", 6))


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, round(median(value), 6) AS p50, round(max(value) FILTER (i = least(n - 1, floor(n * 0.95::DOUBLE))), 6) AS p95, round(max(value) FILTER (i = least(n - 1, floor(n * 0.99::DOUBLE))), 6) AS p99, round(count(*) / sum(value), 6) AS qps FROM o GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.latency(table(spark, d, "events"), "event_type", "value")
    return found.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "qps")))


# ---- trained indexes, ingest: rows only


@query()
def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of a trained index, two cells a row, at growing effort."""
    base, asked, config = rows(spark, d), query_vectors(spark, d), IvfConfig(cells=16)
    centroids = ivf.train_cells(base, config)
    indexed, truth = base.withColumn("cell", F.explode(ivf.assign_all(F.col("vector"), centroids, copies=config.copies))), exact_knn(base, asked, 10)
    out = None
    for nprobe in (2, 4, 8, 16):
        one = metrics.recall_at_k(ivf.probe(indexed, asked, centroids, 10, nprobe, copies=config.copies), truth, 10).withColumn("nprobe", F.lit(nprobe))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def kmeans_train(spark: SparkSession, d: str) -> DataFrame:
    """Rows per cell of trained centroids."""
    centroids = ivf.train_cells(rows(spark, d), IvfConfig(cells=10))
    return ivf.cell_stats(rows(spark, d).withColumn("cell", ivf.assign(F.col("vector"), centroids)))


@query()
def pq_train(spark: SparkSession, d: str) -> DataFrame:
    """Squared error of trained codes, per row."""
    base = rows(spark, d)
    book = pq.train_codebook(base, PqConfig(subvectors=16, bits=4))
    back = pq.decode(pq.encode(F.col("vector"), book), book)
    return base.select("id", F.round(V.squared_l2(V.normalize(F.col("vector")), back), 6).alias("error"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can read it; a local one only if the session is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.gettempdir()
    return f"{shared}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id::VARCHAR AS id, 1::BIGINT AS seq, lang FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang = 'de'")
def collection_filter(spark: SparkSession, d: str) -> DataFrame:
    """The corpus written to a collection and read back through a metadata filter."""
    db = Database(spark, _scratch(spark, "collection"))
    col = db.create_collection("docs", 64)
    docs = corpus(spark, d)
    col.upsert_many(docs.select(F.col("id").cast("string").alias("id"), "vector", F.struct("lang", "source", "n_chars", "label", "quality", "toxic").alias("metadata"), "text"))
    return col.documents(filter={"lang": "de"}).select("id", "seq", F.variant_get("metadata", "$.lang", "string").alias("lang"))


def _small_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d).where("id < 400")
    return docs.select(F.col("id").cast("string").alias("id"), "vector", F.struct("lang", "n_chars").alias("metadata"), "text")


_SMALL_DOCS = "docs AS (SELECT doc_id::VARCHAR AS id, lang, n_chars, text FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id < 400)"


@query(f"""WITH {_SMALL_DOCS} SELECT id, CASE WHEN id::INT % 7 = 3 THEN 3 ELSE 1 END::BIGINT AS seq, CASE WHEN id::INT % 7 = 3 THEN 'xx' ELSE lang END AS lang FROM docs WHERE id::INT % 5 <> 0
  UNION ALL SELECT 'new', 4, 'yy'""")
def collection_upsert_delete(spark: SparkSession, d: str) -> DataFrame:
    """Documents written, some deleted (5), others replaced (7) as one commit each, one written by itself; the collection
    is then opened anew and compacted, and gives what is left."""
    db = Database(spark, _scratch(spark, "collection"))
    col = db.create_collection("docs", 64)
    docs = _small_docs(spark, d)
    col.upsert_many(docs)
    gone = docs.where("id % 5 = 0").select(F.lit("delete").alias("op"), "id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("variant").alias("metadata"), F.lit(None).cast("string").alias("text"))
    col.apply(gone)
    col.upsert_many(docs.where("id % 7 = 3 AND id % 5 <> 0").withColumn("metadata", F.struct(F.lit("xx").alias("lang"))))
    col.upsert("new", [1.0] * 64, {"lang": "yy"})
    again = db.open_collection("docs")
    again.compact()
    return again.documents().select("id", "seq", F.variant_get("metadata", "$.lang", "string").alias("lang"))


@query(f"""WITH {_SMALL_DOCS}, t AS (SELECT count(*) AS n FROM docs), g AS (SELECT count(*) AS n FROM docs WHERE id::INT < 10)
SELECT 'len' AS what, t.n - g.n + 1 AS value FROM t, g UNION ALL SELECT 'versions', t.n + 1 FROM t UNION ALL SELECT 'tombstones', g.n FROM g UNION ALL SELECT 'seq', 3 UNION ALL SELECT 'commits', 3
UNION ALL SELECT 'as of 1', t.n FROM t UNION ALL SELECT 'contains 3', 0 UNION ALL SELECT 'contains 11', 1 UNION ALL SELECT 'deleted absent', 0 UNION ALL SELECT 'rolled back', 0
UNION ALL SELECT 'get chars', n_chars FROM docs WHERE id = '11' UNION ALL SELECT 'cells', 8 UNION ALL SELECT 'indexed', t.n - g.n + 1 FROM t, g
UNION ALL SELECT 'text docs', (SELECT count(*) FROM docs WHERE length(text) > 0 AND id::INT >= 10) + 1 UNION ALL SELECT 'vacuumed', g.n FROM g UNION ALL SELECT 'k 0', 0 UNION ALL SELECT 'k over', t.n - g.n + 1 FROM t, g""")
def collection_facts(spark: SparkSession, d: str) -> DataFrame:
    """What a collection says of itself: sizes, lookups, statistics, transactions, index, vacuum, k rules."""
    col = Database(spark, _scratch(spark, "collection")).create_collection("docs", 64, ivf=IvfConfig(cells=8))
    docs = _small_docs(spark, d)
    col.upsert_many(docs)
    with col.transaction() as t:
        for i in range(10):
            t.delete(str(i))
    facts = [("deleted absent", int(col.delete("nobody")))]
    col.upsert("one", [0.5] * 64, {}, "a single text")
    t = col.transaction()
    t.upsert("never", [1.0] * 64)
    t.rollback()
    found = col.stats()
    facts += [("len", len(col)), ("versions", found["versions"]), ("tombstones", found["storage"]["tombstones"]), ("seq", col.seq), ("commits", found["storage"]["commits"]), ("text docs", found["text"]["docs"])]
    facts += [("as of 1", col.documents(1).count()), ("contains 3", int("3" in col)), ("contains 11", int("11" in col)), ("rolled back", int("never" in col)), ("get chars", col.get("11")["metadata"]["n_chars"])]
    facts += [("indexed", col.build_index()), ("cells", col.stats()["index"]["cells"]), ("k 0", col.search([1.0] * 64, k=0).hits.count()), ("k over", col.search([1.0] * 64, k=100_000).hits.count()), ("vacuumed", col.vacuum())]
    return spark.createDataFrame([(n, int(v)) for n, v in facts], "what string, value long")


@query(f"WITH {_SMALL_DOCS} SELECT id, n_chars, text FROM docs")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines, read, put into a collection and read from there."""
    path = _scratch(spark, "jsonl")
    jsonl.write_jsonl(_small_docs(spark, d), path)
    col = Database(spark, _scratch(spark, "collection")).create_collection("docs", 64, metric="dot")
    col.upsert_many(jsonl.read_jsonl(spark, path))
    return col.documents().select("id", F.variant_get("metadata", "$.n_chars", "long").alias("n_chars"), "text")


@query("""WITH f AS (SELECT user_id::VARCHAR AS id, event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, props FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id DESC) AS r FROM f) SELECT id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM l WHERE r = 1 AND op = 'put'""")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The change feed streamed into a collection; then what is visible."""
    root = _scratch(spark, "stream")
    col = Database(spark, f"{root}/db").create_collection("docs", 2, metric="l2")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # A stream's source is a folder; the table is one file, or a folder of files.
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/event[s].parquet")
    feed = events.select(
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        F.col("user_id").cast("string").alias("id"),
        F.array(F.col("value").cast("float"), F.lit(1.0).cast("float")).alias("vector"),
        F.parse_json("props").alias("metadata"),
        F.lit(None).cast("string").alias("text"),
        F.col("event_id").alias("position"),
    )
    ingest.ingest(col, feed, f"{root}/checkpoint").awaitTermination()
    return col.documents().select("id", F.variant_get("metadata", "$.k", "long").alias("k"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """An extension: tumbling windows over the event stream."""
    found = ingest.windowed_counts(table(spark, d, "events"))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


# ---- planner and replicated log

_PLANS = ((500, 10, 0, 0, 64), (14906, 10, 0, 0, 64), (14907, 10, 0, 0, 64), (100_000, 10, 0, 0, 64), (100_000, 128, 0, 0, 8), (100_000, 10, 1, 0, 64), (200_000, 10, 0, 1, 64), (100_000, 10, 3, 0, 64), (100_000, 10, 1, 1, 64), (0, 10, 0, 0, 64))


@query(f"""WITH p AS (SELECT * FROM (VALUES {", ".join(map(str, _PLANS))}) t(live, k, eqs, ranges, asked)),
s AS (SELECT *, greatest(asked, k) AS effort, greatest(0.001, least(1.0, pow(0.1::DOUBLE, eqs) * pow(0.33::DOUBLE, ranges))) AS share FROM p),
c AS (SELECT *, greatest(1.0, live * share) AS n, 1.4::DOUBLE * effort * log2(greatest(live, 2)) / CASE WHEN eqs + ranges > 0 THEN greatest(share, 0.02) ELSE 1 END AS graph FROM s)
SELECT live::BIGINT AS live, k::BIGINT AS k, eqs::BIGINT AS eqs, ranges::BIGINT AS ranges, CASE WHEN live <= 2000 OR n / 12 <= graph THEN 'exact_scan' ELSE 'ann_graph' END AS strategy,
CASE WHEN live <= 2000 OR n / 12 <= graph THEN 0 ELSE effort END::BIGINT AS ef, floor(n)::BIGINT AS survivors, round_even(n / 12, 1) AS scan_cost, round_even(graph, 1) AS graph_cost FROM c""")
def plan_explain(spark: SparkSession, d: str) -> DataFrame:
    out, planner = [], Planner()
    nothing = StructFields(spark.range(0).schema)
    for live, k, eqs, ranges, ef in _PLANS:
        spec = {f"e{i}": i for i in range(eqs)} | {f"r{i}": {"$gt": i} for i in range(ranges)}
        p = planner.plan(k=k, live=live, filt=compile_filter(spec, nothing), has_vector=True, has_text=False, ef=ef).as_dict()
        out.append((live, k, eqs, ranges, p["strategy"], p["ef"], p["estimated_survivors"], p["scan_cost"], p["graph_cost"]))
    return spark.createDataFrame(out, "live long, k long, eqs long, ranges long, strategy string, ef long, survivors long, scan_cost double, graph_cost double")


_MATCH, _LOG = ((1, 9), (2, 7), (3, 5), (4, 7), (5, 2)), ((1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 3), (7, 3), (8, 3), (9, 3))


@query(f"""WITH m AS (SELECT * FROM (VALUES {", ".join(map(str, _MATCH))}) t(node, i)), l AS (SELECT * FROM (VALUES {", ".join(map(str, _LOG))}) t(index, term)),
q AS (SELECT i FROM m ORDER BY i DESC LIMIT 1 OFFSET 2) SELECT coalesce(max(l.index), 0)::BIGINT AS commit_index FROM l, q WHERE l.index <= q.i AND term = 3""")
def raft_commit_index(spark: SparkSession, d: str) -> DataFrame:
    return replicated.commit_index(spark.createDataFrame(_MATCH, "node long, match_index long"), spark.createDataFrame(_LOG, "index long, term long"), 3)


_VOTES = ((1, 5, "b", 4, 10, 4, None, 4, 9), (2, 5, "b", 4, 10, 5, "a", 4, 9), (3, 5, "b", 4, 10, 5, "b", 4, 10), (4, 5, "b", 3, 99, 4, None, 4, 9), (5, 5, "b", 4, 8, 4, None, 4, 9), (6, 3, "b", 4, 10, 4, None, 4, 9))
_VOTES_SQL = ", ".join("(" + ", ".join("NULL" if x is None else repr(x) for x in v) + ")" for v in _VOTES)


@query(f"""SELECT id::BIGINT AS id, term >= my_term AND (term > my_term OR voted_for IS NULL OR voted_for = candidate) AND (last_term > my_last_term OR (last_term = my_last_term AND last_index >= my_last_index)) AS granted
FROM (VALUES {_VOTES_SQL}) t(id, term, candidate, last_term, last_index, my_term, voted_for, my_last_term, my_last_index)""")
def raft_votes(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame(_VOTES, "id long, term long, candidate string, last_term long, last_index long, my_term long, voted_for string, my_last_term long, my_last_index long")
    return replicated.grants(asked).select("id", "granted")


@query("SELECT user_id AS id, max(event_id) AS seq FROM events WHERE event_type <> 'view' GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def replicated_fold(spark: SparkSession, d: str) -> DataFrame:
    """The state that the events leave as commands; views are no-ops."""
    op = F.when(F.col("event_type") == "view", "noop").when(F.col("event_type") == "error", "delete").otherwise("put")
    return replicated.fold(table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), op.alias("op"))).select("id", "seq")


def _replicas(spark: SparkSession, d: str) -> DataFrame:
    """Three nodes with the events as their log; the third has lost the last entry."""
    events = table(spark, d, "events").select(F.col("event_id").alias("index"), (F.col("event_id") % 7).alias("term"), F.col("event_type").alias("command"))
    last = events.agg(F.max("index").alias("last"))
    nodes = events.withColumn("node", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).join(F.broadcast(last))
    return nodes.where("node < 3 OR index < last").drop("last")


@query("WITH n AS (SELECT unnest([1, 2, 3]) AS node), l AS (SELECT node, count(*) AS c, md5(string_agg(event_id || event_type, ',' ORDER BY event_id)) AS h FROM events, n WHERE node < 3 OR event_id < (SELECT max(event_id) FROM events) GROUP BY node) SELECT count(*) AS nodes, count(DISTINCT h) AS logs, count(DISTINCT h) <= 1 AS converged FROM l")
def log_convergence(spark: SparkSession, d: str) -> DataFrame:
    return replicated.convergence(_replicas(spark, d))


@query("SELECT event_id AS index, CASE WHEN event_id = (SELECT max(event_id) FROM events) THEN 2 ELSE 3 END::BIGINT AS nodes, 1::BIGINT AS terms FROM events")
def log_agreement(spark: SparkSession, d: str) -> DataFrame:
    return replicated.agreement(_replicas(spark, d))
