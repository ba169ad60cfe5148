"""Collections of documents: a versioned log on shared storage, and searches over what is visible in it.

The only module that knows all the others.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.config import CollectionConfig
from skein.errors import ConflictError, CorruptionError, NotFoundError, SchemaError, TransactionError
from skein.functions import vectors as V
from skein.functions.filters import Filter, VariantFields, compile_filter
from skein.operators import ivf, pq, versions
from skein.operators.bm25 import analyzed, bm25, sized, text_stats
from skein.operators.fusion import merge
from skein.operators.knn import exact_knn
from skein.operators.topk import best, check_k
from skein.plans.planner import Plan, Planner
from skein.sources.storage import CommitLog, Files

DOCUMENT = "id string, vector array<float>, metadata variant, text string"
LOG = "id string, seq long, op string, vector array<float>, metadata variant, text string"
QUERY = "qid long, vector array<double>, text string"
RETRIES = 5


class Database:
    """The collections in a folder of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.files = spark, Files(spark, path)

    def list_collections(self) -> list[str]:
        return [n for n in self.files.list("") if self.files.exists(f"{n}/collection.json")]

    def create_collection(self, name: str, dim: int, *, exist_ok: bool = False, **options: Any) -> Collection:
        """A new collection. With `exist_ok` an existing one is opened as it is; the options are then not looked at."""
        if self.files.exists(f"{name}/collection.json"):
            if exist_ok:
                return self.open_collection(name)
            raise SchemaError(f"collection {name!r} exists")
        config = CollectionConfig(name, dim, **options)
        if not self.files.create(f"{name}/collection.json", json.dumps(config.as_dict())):
            raise SchemaError(f"collection {name!r} exists")
        return Collection(self.spark, self.files.at(name), config)

    def open_collection(self, name: str) -> Collection:
        if not self.files.exists(f"{name}/collection.json"):
            raise NotFoundError(name)
        return Collection(self.spark, self.files.at(name), CollectionConfig.from_dict(json.loads(self.files.read(f"{name}/collection.json"))))

    def drop_collection(self, name: str) -> None:
        if not self.files.exists(f"{name}/collection.json"):
            raise NotFoundError(name)
        self.files.delete(name)

    def stats(self) -> dict:
        return {n: self.open_collection(n).stats() for n in self.list_collections()}


@dataclass
class SearchResult:
    """Hits `(qid, id, score, rank, metadata, text[, vector])` as a DataFrame, not computed yet, and the plan."""

    hits: DataFrame
    plan: dict
    batch: bool = False

    def ids(self) -> list[str]:
        """The ids of a single query's hits in order."""
        return [r["id"] for r in self.hits.orderBy("qid", "rank").select("id").collect()]

    def rows(self) -> list[dict]:
        return [r.asDict() for r in self.hits.withColumn("metadata", F.to_json("metadata")).orderBy("qid", "rank").collect()]


class Snapshot:
    """A sequence number that reads stay at, and that a vacuum of the same process leaves readable."""

    def __init__(self, collection: Collection, seq: int) -> None:
        self.collection, self.seq, self.open = collection, seq, True
        collection._snapshots.append(self)

    def close(self) -> None:
        if self.open:
            self.open = False
            self.collection._snapshots.remove(self)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


@dataclass
class Transaction:
    """Writes that are applied together, under one sequence number, or not at all."""

    collection: Collection
    start: int
    writes: dict[str, tuple] = field(default_factory=dict)
    done: bool = False

    def _stage(self, id: str, row: tuple) -> None:
        if self.done:
            raise TransactionError("the transaction has ended")
        self.writes[id] = row

    def upsert(self, id: str, vector: Iterable[float], metadata: dict | None = None, text: str | None = None) -> None:
        self._stage(id, ("put", *self.collection._checked(id, vector, metadata, text)))

    def delete(self, id: str) -> None:
        self._stage(id, ("delete", id, None, None, None))

    def rollback(self) -> None:
        self.done = True

    def commit(self) -> int:
        """How many writes were applied; deleting what isn't there counts for nothing. A conflict if another commit
        has written or deleted one of the documents since the transaction began."""
        if self.done:
            raise TransactionError("the transaction has ended")
        self.done = True
        if not self.writes:
            return 0
        rows = self.collection._frame(self.writes.values())
        return self.collection._commit(rows, start=self.start)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if kind is not None:
            self.rollback()
        elif not self.done:
            self.commit()


class Collection:
    """Documents `(id, vector, metadata, text)` under one configuration."""

    def __init__(self, spark: SparkSession, path: str, config: CollectionConfig, planner: Planner | None = None) -> None:
        self.spark, self.config, self.planner = spark, config, planner or Planner()
        self.files = Files(spark, path)
        self.commits = CommitLog(self.files)
        self._snapshots: list[Snapshot] = []
        self._live: tuple[int, int] = (-1, 0)

    # ---- reading

    @property
    def seq(self) -> int:
        return self.commits.head()["seq"]

    def log(self) -> DataFrame:
        """All rows of all commits in force."""
        folders = [self.files.at(r["folder"]) for r in self.commits.records() if r["folder"]]
        if not folders:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*folders)

    def _at(self, snapshot: Snapshot | int | None) -> int | None:
        return snapshot.seq if isinstance(snapshot, Snapshot) else snapshot

    def documents(self, snapshot: Snapshot | int | None = None, filter: dict | None = None) -> DataFrame:
        """The visible documents `(id, seq, vector, metadata, text)` that the filter accepts."""
        rows = versions.visible_at(self.log(), self._at(snapshot)).drop("op")
        return rows.where(self._filter(filter).predicate) if filter else rows

    def _filter(self, spec: dict | None) -> Filter:
        return compile_filter(spec, VariantFields("metadata"))

    def get(self, id: str, include_vector: bool = False) -> dict | None:
        """The current document, or None; its score is 1."""
        found = versions.visible_at(self.log().where(F.col("id") == id)).withColumn("metadata", F.to_json("metadata")).first()
        if found is None:
            return None
        hit = {"id": found["id"], "score": 1.0, "metadata": json.loads(found["metadata"] or "{}"), "text": found["text"]}
        return hit | ({"vector": list(found["vector"])} if include_vector else {})

    def __contains__(self, id: str) -> bool:
        return not versions.visible_at(self.log().where(F.col("id") == id)).isEmpty()

    def __len__(self) -> int:
        """Current documents, counted once per state of the collection."""
        seq = self.seq
        if self._live[0] != seq:
            last = self.log().groupBy("id").agg(F.max_by("op", "seq").alias("op"))
            self._live = (seq, last.where("op = 'put'").count())
        return self._live[1]

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.seq)

    # ---- writing

    def _checked(self, id: str, vector: Iterable[float], metadata: dict | None, text: str | None) -> tuple:
        if not isinstance(id, str) or not id:
            raise SchemaError("an id is a string that isn't empty")
        try:
            v = np.asarray(list(vector), np.float64).reshape(-1)
        except (TypeError, ValueError) as e:
            raise SchemaError("a vector is a list of numbers") from e
        if len(v) != self.config.dim or not np.isfinite(v).all():
            raise SchemaError(f"a vector has {self.config.dim} finite numbers")
        return id, [float(x) for x in v], json.dumps(metadata or {}), text

    def _frame(self, rows: Iterable[tuple]) -> DataFrame:
        df = self.spark.createDataFrame(list(rows), "op string, id string, vector array<double>, metadata string, text string")
        return df.select("op", "id", F.col("vector").cast("array<float>").alias("vector"), F.parse_json("metadata").alias("metadata"), "text")

    def upsert(self, id: str, vector: Iterable[float], metadata: dict | None = None, text: str | None = None) -> int:
        """The sequence number of the write."""
        self._commit(self._frame([("put", *self._checked(id, vector, metadata, text))]))
        return self.seq

    def upsert_many(self, docs: DataFrame | Iterable[dict]) -> int:
        """Writes all rows `(id, vector, metadata?, text?)` or, if one of them is invalid or repeats an id, none."""
        if not isinstance(docs, DataFrame):
            rows = {}
            for d in docs:
                rows[d["id"]] = ("put", *self._checked(d["id"], d["vector"], d.get("metadata"), d.get("text")))
            return self._commit(self._frame(rows.values())) if rows else 0
        kinds = dict(docs.dtypes)
        meta = F.lit(None).cast("variant") if "metadata" not in kinds else F.col("metadata") if kinds["metadata"] == "variant" else F.to_variant_object("metadata") if kinds["metadata"].startswith(("struct", "map")) else F.parse_json("metadata")
        text = F.col("text") if "text" in kinds else F.lit(None).cast("string")
        return self._commit(docs.select(F.lit("put").alias("op"), F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.coalesce(meta, F.parse_json(F.lit("{}"))).alias("metadata"), text.alias("text")))

    def delete(self, id: str) -> bool:
        """Whether there was such a document."""
        if id not in self:
            return False
        return self._commit(self._frame([("delete", id, None, None, None)])) > 0

    def transaction(self) -> Transaction:
        return Transaction(self, self.seq)

    def apply(self, changes: DataFrame, **tags: Any) -> int:
        """One commit of rows `(op, id, vector, metadata, text)`, at most one per id; `tags` go into its record."""
        return self._commit(changes.select("op", "id", F.col("vector").cast("array<float>").alias("vector"), "metadata", "text"), **tags)

    def _commit(self, rows: DataFrame, start: int | None = None, **tags: Any) -> int:
        """Stages rows, checks them as they are stored, and adds the record. Deletes of absent documents are left out."""
        for turn in range(RETRIES):
            head = self.commits.head()
            seq = head["seq"] + 1
            prepared = F.when(F.col("vector").isNotNull(), V.normalize(F.col("vector")).cast("array<float>")) if self.config.metric == "cosine" else F.col("vector")
            valid = (F.col("op") == "delete") | V.is_valid(F.col("vector"), self.config.dim)
            checked = rows.withColumn("_ok", F.coalesce((F.length("id") > 0) & valid, F.lit(False)))
            if head["folder"]:
                gone = sized(rows.where("op = 'delete'").select("id").distinct())
                there = versions.visible_at(self.log().select("id", "seq", "op").join(gone, "id", "left_semi")).select("id")
                checked = checked.join(there.withColumn("_there", F.lit(True)), "id", "left").where("op = 'put' OR _there").drop("_there")
            else:
                checked = checked.where("op = 'put'")
            folder = self.commits.stage(checked.select("id", F.lit(seq).cast("long").alias("seq"), "op", prepared.alias("vector"), "metadata", "text", "_ok"))
            staged = self.spark.read.parquet(self.files.at(folder))
            count, bad, ids = staged.agg(F.count("*"), F.count_if(~F.col("_ok")), F.count_distinct("id")).first()
            if bad or ids < count:
                self.files.delete(folder)
                raise SchemaError(f"{bad} rows have an empty id or no vector of {self.config.dim} finite numbers" if bad else "a batch names an id more than once")
            if not count and not tags:
                self.files.delete(folder)
                return 0
            try:
                if start is not None and head["seq"] > start:
                    clash = versions.conflicts(self.log(), rows.select("id"), start).first()
                    if clash is not None:
                        raise ConflictError(f"document {clash['id']!r} was written since the transaction began")
                self.commits.append(head["number"], seq=seq, folder=folder, rows=count, **tags)
                if self.config.storage.auto_compact:
                    self.maybe_compact()
                return count
            except ConflictError:
                self.files.delete(folder)
                if turn == RETRIES - 1 or self.commits.head()["number"] == head["number"]:
                    raise
        raise AssertionError("unreachable")

    # ---- upkeep

    def _rewrite(self, keep: DataFrame) -> None:
        head = self.commits.head()
        folder = self.commits.stage(keep)
        try:
            self.commits.append(head["number"], seq=head["seq"], folder=folder, replaces=True, streams=self.commits.batches())
        except ConflictError:
            self.files.delete(folder)
            raise

    def compact(self) -> bool:
        """Merges the folders of all commits into one, history included; False if there was but one."""
        if len(self.commits.records()) < 2:
            return False
        self._rewrite(self.log())
        return True

    def maybe_compact(self) -> bool:
        """Merges once there are as many commits as the trigger says; another writer's commit in between lets it be."""
        try:
            return len(self.commits.records()) >= self.config.storage.compaction_trigger and self.compact()
        except ConflictError:
            return False

    def vacuum(self) -> int:
        """Removes the versions that no open snapshot and no current read can see; how many."""
        upto = versions.horizon([s.seq for s in self._snapshots], self.seq)
        count = versions.vacuum_candidates(self.log(), upto).count()
        self._rewrite(versions.retained(self.log(), upto))
        for folder in self.commits.orphans():
            self.files.delete(folder)
        return count

    def build_index(self) -> int:
        """Assigns every current document to a cell (and codes, for ivf_pq); the number of documents indexed."""
        seq, c = self.seq, self.config
        docs = versions.visible_at(self.log()).select("id", "seq", "vector")
        centroids = ivf.train_cells(docs, c.ivf, c.metric)
        if not len(centroids):
            return 0
        rows = docs.withColumn("cell", F.explode(ivf.assign_all(F.col("vector"), centroids, c.metric, c.ivf.copies)))
        book = None
        if c.index == "ivf_pq":
            book = pq.train_codebook(docs, c.pq, c.metric)
            rows = rows.withColumn("codes", pq.encode(F.col("vector"), book, c.metric))
            rows = rows if c.pq.keep_originals else rows.drop("vector")
        folder = f"index/{seq:020d}"
        self.files.delete(folder)
        # A cell may hold a large share of the rows, so it is spread over several files.
        rows.repartition(F.col("cell"), F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("cell").parquet(self.files.at(folder))
        count = self.spark.read.parquet(self.files.at(folder)).select("id").distinct().count()
        record = {"seq": seq, "folder": folder, "rows": count, "copies": c.ivf.copies, "centroids": centroids.tolist(), "codebook": None if book is None else book.tolist()}
        self.files.delete(f"_index/{seq:020d}.json")
        self.files.create(f"_index/{seq:020d}.json", json.dumps(record))
        return count

    rebuild_index = build_index

    def _index(self) -> dict | None:
        names = [n for n in self.files.list("_index") if n.endswith(".json")]
        if not names:
            return None
        try:
            return json.loads(self.files.read(f"_index/{names[-1]}"))
        except ValueError as e:
            raise CorruptionError(f"an index record is unreadable: {names[-1]}") from e

    def stats(self) -> dict:
        found = versions.store_stats(self.log()).first().asDict()
        index = self._index()
        out = {"documents": found["live"], "versions": found["versions"], "open_snapshots": len(self._snapshots), "config": self.config.as_dict(), "storage": found | {"commits": len(self.commits.records()), "seq": self.seq}}
        if index:
            out["index"] = {"rows": index["rows"], "seq": index["seq"], "cells": len(index["centroids"])} | (pq.memory(index["rows"], self.config.dim, self.config.pq) if index["codebook"] else {"memory_bytes": index["rows"] * self.config.dim * 4})
        if self.config.text_index:
            out["text"] = text_stats(analyzed(self.documents())).first().asDict()
        return out

    # ---- searching

    def search(self, vector: Iterable[float] | None = None, text: str | None = None, k: int = 10, *, filter: dict | None = None, ef: int | None = None, snapshot: Snapshot | int | None = None, oversample: float = 1.0, rrf_k: float = 60.0, weights: list[float] | None = None, include_vectors: bool = False) -> SearchResult:
        """The `k` best documents for a vector, a text or both."""
        v = None if vector is None else self._checked("q", vector, None, None)[1]
        one = self.spark.createDataFrame([(0, v, text)], QUERY)
        return self.search_batch(one, k, has_vector=v is not None, has_text=bool(text), filter=filter, ef=ef, snapshot=snapshot, oversample=oversample, rrf_k=rrf_k, weights=weights, include_vectors=include_vectors)

    def search_batch(self, queries: DataFrame, k: int = 10, *, has_vector: bool = True, has_text: bool = False, filter: dict | None = None, ef: int | None = None, snapshot: Snapshot | int | None = None, oversample: float = 1.0, rrf_k: float = 60.0, weights: list[float] | None = None, include_vectors: bool = False, stats: str = "visible") -> SearchResult:
        """The same for every row of `queries` (qid, vector, text): one plan, one job. `stats` says whether replaced
        versions that no vacuum has removed still count in the text statistics: visible (no) or retained."""
        check_k(k)
        filt = self._filter(filter)
        has_text = has_text and self.config.text_index
        plan = self.planner.plan(k=k, live=len(self), filt=filt, has_vector=has_vector, has_text=has_text, ef=ef, default_ef=self.config.ivf.ef_search, index=self.config.index, oversample=oversample)
        docs = self.documents(snapshot)
        allowed = docs.where(filt.predicate)
        dense = self._dense(allowed, queries, plan, filt, snapshot) if has_vector else None
        lexical = self._lexical(docs, queries, plan, filt.predicate, snapshot, stats) if has_text else None
        if dense is not None and lexical is not None:
            found = merge(dense, lexical, k, weights, rrf_k)
        elif dense is not None or lexical is not None:
            found = best((dense if dense is not None else lexical).drop("rank"), k, [F.col("score").desc(), F.col("id")])
        else:
            found = self.spark.createDataFrame([], "qid long, id string, score double, rank long")
        # k rows a query, so the hits are as bounded as the batch.
        hits = docs.join(sized(found), "id").select("qid", "id", "score", "rank", "metadata", "text", *(["vector"] if include_vectors else []))
        return SearchResult(hits, plan.as_dict())

    def _dense(self, allowed: DataFrame, queries: DataFrame, plan: Plan, filt: Filter, snapshot: Snapshot | int | None) -> DataFrame:
        metric, k = self.config.metric, plan.fetch_k
        index = None if plan.exact or self.config.index == "flat" else self._index()
        cut = ["qid", "id", "score", "rank"]
        if index is None:
            return exact_knn(allowed, queries, k, metric).select(*cut)
        centroids, seq = np.array(index["centroids"]), self._at(snapshot)
        keys = allowed.select("id", "seq")
        rows = self.spark.read.parquet(self.files.at(index["folder"]))
        fresh = allowed.where(F.col("seq") > index["seq"]) if seq is None or seq >= index["seq"] else allowed.join(rows.select("id", "seq"), ["id", "seq"], "left_anti")
        inside = rows.join(keys, ["id", "seq"], "left_semi")
        nprobe = ivf.probes(plan.ef, len(centroids))

        def look(asked: DataFrame, cells: int) -> DataFrame:
            if index["codebook"] is None:
                near = ivf.probe(inside, asked, centroids, k, cells, metric, copies=index.get("copies", 1))
            else:
                near = self._coded(inside, asked, centroids, np.array(index["codebook"]), k, cells, index.get("copies", 1))
            both = near.unionByName(exact_knn(fresh, asked, k, metric))
            return best(both.drop("rank"), k, [F.col("distance"), F.col("id")])

        found = look(queries, nprobe)
        if not filt.is_trivial and nprobe < len(centroids):  # few may survive a filter in the cells looked into
            found = found.cache()
            short = queries.join(found.groupBy(F.col("qid").alias("_q")).count(), F.col("qid") == F.col("_q"), "left").where(F.coalesce("count", F.lit(0)) < k).select(*queries.columns)
            if not short.isEmpty():
                again = short.select("qid").distinct()
                found = found.join(again, "qid", "left_anti").unionByName(look(short, len(centroids)).select(*found.columns))
        return found.select(*cut)

    def _coded(self, inside: DataFrame, asked: DataFrame, centroids: np.ndarray, book: np.ndarray, k: int, cells: int, copies: int) -> DataFrame:
        """Probed rows by their codes, then the best of them again by full (or decoded) vectors."""
        metric = self.config.metric
        # Candidates from the cells, by what the codes stand for; full vectors are read for these only.
        stood = inside.withColumn("_stood", pq.decode(F.col("codes"), book))
        near = ivf.probe(stood, asked, centroids, k * self.config.pq.rerank_factor, cells, metric, vector="_stood", copies=copies)
        # Candidates are few; of the copies of each, one is ranked again.
        full, vector = (inside, "vector") if "vector" in inside.columns else (stood, "_stood")
        wanted = full.join(sized(near.select("id").distinct()), "id", "left_semi").dropDuplicates(["id"])
        return pq.rerank(near, wanted, asked, k, metric, vector=vector)

    def _lexical(self, docs: DataFrame, queries: DataFrame, plan: Plan, allow: Column, snapshot: Snapshot | int | None, stats: str) -> DataFrame:
        if stats == "visible":
            return bm25(docs, queries, plan.fetch_k, allow=allow).select("qid", "id", "score", "rank")
        upto = self._at(snapshot)
        upto = self.seq if upto is None else upto
        every = versions.intervals(self.log()).where((F.col("op") == "put") & (F.col("born") <= upto)).withColumn("key", F.struct("id", "seq"))
        found = bm25(every, queries, plan.fetch_k, id="key", allow=allow & (F.col("dead") > upto))
        return found.select("qid", F.col("id.id").alias("id"), "score", "rank")
