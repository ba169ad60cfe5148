"""The queries of this subpackage and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, chat, cotrain, decontam, html_extract, quality_rules, secrets, simhash, toxicity, warc
from skein.llm.common import checkpoint_dir, saved, short_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    return chat.read_back(chat.format_chats(rows.unionByName(odd)))


_OP1 = r"""
WITH r AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(text) + len(regexp_extract_all(text, '###|</turn>')) + 9) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.encode(docs, tokenizer_path(), decoded="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    read = warc.read_archives(spark, path).where(F.col("warc_type").isin("response", "revisit"))
    again = F.col("warc_type") == "revisit"
    found = read.select(
        page("record_id").alias("page_id"),
        F.when(again, F.col("http_length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(again, F.regexp_replace("payload_digest", "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )
    found = saved(found)
    warc.delete_archives(spark, path)
    return found


_OP6 = """
WITH r AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
w AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM r)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM w
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.assess(table(spark, sf_dir, "documents"), trusted)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model sees."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Network:
    texts, y, share = toxicity.training_rows(docs, labels.where(~held_out(F.col("doc_id"))))
    return toxicity.train(texts, y, share)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), toxicity.score(F.col("text"), net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    aside = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    seen = saved(docs.select("doc_id", aside.alias("held_out"), cotrain.features(F.col("text"), F.col("source"), F.col("lang"), F.col("n_chars")).alias("features")))
    # Held-out documents are neither labelled nor pseudo-labelled.
    model = cotrain.fit(seen.where("NOT held_out"), labels.where(~held_out(F.col("doc_id"))))
    found = seen.select("doc_id", "held_out", cotrain.score(model, F.col("features")).alias("s"))
    return found.select("doc_id", "held_out", "s.text_score", "s.meta_score", "s.score", (F.col("s.score") >= 0.5).alias("kept"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    found = table(spark, sf_dir, "documents").select("doc_id", secrets.find_secrets(F.col("text")).alias("s"))
    digest = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("s", lambda x: x["kind"] != "random")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("s")).alias("spans"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier, "op3_html_extraction": op3_html_extraction, "op10_decontamination": op10_decontamination, "op2_quality_rules": op2_quality_rules, "op6_warc": op6_warc, "op7_toxicity": op7_toxicity, "op9_secret_scan": op9_secret_scan} | {"op1_chat_formatting": op1_chat_formatting, "op4_bpe": op4_bpe, "op5_simhash_near_dedup": op5_simhash_near_dedup}
ORACLES = {"op1_chat_formatting": _OP1, "op6_warc": _OP6}
