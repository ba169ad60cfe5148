import json
import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein import registry
from skein.config import CollectionConfig, IvfConfig, PqConfig, StorageConfig
from skein.errors import ConfigError, QueryError
from skein.functions import text as X
from skein.functions.filters import StructFields, VariantFields, compile_filter
from skein.operators import fusion, ivf, metrics, pq, replicated, topk, versions
from skein.operators.bm25 import analyzed, bm25, documents, postings
from skein.operators.knn import distances, exact_knn, normalized
from skein.plans.planner import Planner
from skein.sources.synthetic import clustered_vectors, near_queries, random_vectors
from tests.oracle import DATA

META = {"year": 2021, "venue": "NeurIPS", "tags": ["ann", "graph"], "author": {"name": "kim"}, "none": None, "yes": True, "a.b": 1, "score": 1.5}

CASES = [
    ({}, True), (None, True), ({"year": 2021}, True), ({"year": 2021.0}, True), ({"year": "2021"}, False), ({"yes": 1}, True), ({"yes": True}, True),
    ({"year": {"$ne": 2020}}, True), ({"missing": {"$ne": 1}}, True), ({"missing": {"$eq": None}}, False), ({"none": None}, True),
    ({"year": {"$gt": 2020, "$lte": 2021}}, True), ({"year": {"$lt": "3"}}, False), ({"venue": {"$gte": "N"}}, True), ({"none": {"$lt": 5}}, False), ({"yes": {"$gt": 0}}, True),
    ({"year": {"$in": [2020, 2021]}}, True), ({"year": {"$in": []}}, False), ({"venue": {"$in": "xNeurIPSx"}}, True), ({"venue": {"$in": 5}}, False),
    ({"year": {"$nin": [2020]}}, True), ({"missing": {"$nin": [1]}}, True), ({"venue": {"$nin": 5}}, False), ({"venue": {"$nin": [1, 2]}}, True), ({"year": {"$nin": "2021"}}, False), ({"venue": {"$nin": "xyz"}}, True),
    ({"tags": {"$contains": "ann"}}, True), ({"tags": {"$contains": "an"}}, False), ({"venue": {"$contains": "eur"}}, True), ({"author": {"$contains": "name"}}, True), ({"year": {"$contains": 2}}, False),
    ({"venue": {"$regex": "^Neu"}}, True), ({"year": {"$regex": "02"}}, True), ({"yes": {"$regex": "True"}}, True), ({"none": {"$regex": "None"}}, True),
    ({"year": {"$between": [2021, 2022]}}, True), ({"year": {"$between": [2022, 2023]}}, False),
    ({"none": {"$exists": True}}, True), ({"missing": {"$exists": False}}, True), ({"missing": {"$exists": True}}, False),
    ({"$and": []}, True), ({"$or": []}, False), ({"$not": {}}, False), ({"$or": [{"year": 1}, {"venue": "NeurIPS"}]}, True), ({"$not": {"missing": 1}}, True),
    ({"author.name": "kim"}, True), ({"author.age": {"$exists": False}}, True), ({"a.b": 1}, False), ({"tags": ["ann", "graph"]}, True), ({"author": {"name": "kim"}}, True), ({"score": {"$gte": 1.5}}, True),
]


def test_filter_truth_table(spark):
    one = spark.createDataFrame([(json.dumps(META),)], "j string").select(F.parse_json("j").alias("m"))
    found = one.select(*(compile_filter(spec, VariantFields("m")).predicate.alias(f"c{i}") for i, (spec, _) in enumerate(CASES))).first()
    assert [(spec, found[i]) for i, (spec, _) in enumerate(CASES)] == [(spec, bool(want)) for spec, want in CASES]


@pytest.mark.parametrize("spec", [{"$what": 1}, {"x": {"$what": 1}}, {"$and": 3}, {"$not": 3}, {"x": {"$between": [1]}}, {"x": {"$regex": "("}}, 5])
def test_bad_filters(spec):
    with pytest.raises(QueryError):
        compile_filter(spec, VariantFields("m"))


def test_selectivity(spark):
    share = lambda spec: compile_filter(spec, VariantFields("m")).selectivity
    assert share({"a": 1}) == pytest.approx(0.1)
    assert share({"a": {"$gt": 1}}) == pytest.approx(0.33)
    assert share({"a": 1, "b": {"$gt": 1}}) == pytest.approx(0.033)
    assert share({c: 1 for c in "abcde"}) == 0.001
    assert compile_filter({"$or": []}, VariantFields("m")).is_trivial


def test_struct_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select("id", F.lit("en").alias("lang")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(compile_filter({"lang": "en"}, StructFields(df.schema)).predicate)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan


def test_stemming_and_terms(spark):
    words = {"studies": "study", "running": "runn", "cat": "cat", "dies": "die", "replies": "reply", "it's": "it'", "nationalization": "national"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["s"] for r in df.select("w", X.stem(F.col("w")).alias("s")).collect()} == words
    one = spark.createDataFrame([("The cats' 2nd Éléphant, and_the x",), (None,), ("",), ("the and",)], "t string")
    found = [r[0] for r in one.select(X.terms(F.col("t"))).collect()]
    assert found[0] == ["cats'", "2nd", "éléphant", "and_the", "x"] and found[1:] == [[], [], []]


def test_bm25_by_hand(spark):
    docs = [(0, "graph index search"), (1, "graph graph database"), (2, "cooking pasta"), (3, "the of and"), (4, None), (5, "")]
    df = spark.createDataFrame(docs, "id long, text string")
    asked = spark.createDataFrame([(0, "graph search"), (1, "graph graph"), (2, "nowhere"), (3, None)], "qid long, text string")
    terms = {0: ["graph", "index", "search"], 1: ["graph", "graph", "database"], 2: ["cook", "pasta"], 3: []}
    avgdl, n = 8 / 4, 4
    idf = lambda t: math.log(1 + (n - (d := sum(t in x for x in terms.values())) + 0.5) / (d + 0.5))
    part = lambda t, i: idf(t) * terms[i].count(t) * 2.2 / (terms[i].count(t) + 1.2 * (0.25 + 0.75 * len(terms[i]) / avgdl))
    found = {(r["qid"], r["id"]): r["score"] for r in bm25(df, asked, 10).collect()}
    want = {(0, 0): part("graph", 0) + part("search", 0), (0, 1): part("graph", 1), (1, 0): 2 * part("graph", 0), (1, 1): 2 * part("graph", 1)}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)
    some = bm25(df, asked, 10, allow=F.col("id") == 1)
    assert {(r["qid"], r["id"]): round(r["score"], 9) for r in some.collect()} == {k: round(v, 9) for k, v in want.items() if k[1] == 1}


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_knn_like_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    data, q = rng.normal(size=(300, 12)).astype(np.float32), rng.normal(size=(7, 12)).astype(np.float32)
    data[5] = data[9]  # a tie
    df = spark.createDataFrame([(f"d{i:03}", v.tolist()) for i, v in enumerate(data)] + [("nan", [float("nan")] * 12), ("short", [1.0]), ("null", None)], "id string, vector array<float>").repartition(4)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vector array<float>")
    a, b = (normalized(x.astype(float)) if metric == "cosine" else x.astype(float) for x in (q, data))
    d = distances(metric, a, b)
    found = exact_knn(df, asked, 9, metric, block=3).orderBy("qid", "rank").collect()
    for i in range(7):
        order = sorted(range(300), key=lambda j: (d[i, j], j))[:9]
        assert [r["id"] for r in found if r["qid"] == i] == [f"d{j:03}" for j in order]
    assert exact_knn(df, asked, 0).count() == 0 and exact_knn(df.limit(0), asked, 3).count() == 0
    assert exact_knn(df, asked.limit(0), 3).count() == 0
    with pytest.raises(QueryError):
        exact_knn(df, asked, -1)


def test_fusion(spark):
    rows = lambda *x: spark.createDataFrame([(0, i, float(s), n + 1) for n, (i, s) in enumerate(x)], "qid long, id string, score double, rank long")
    dense, lexical = rows(("a", 0.9), ("b", 0.5), ("c", 0.1)), rows(("c", 5), ("a", 2))
    found = [(r["id"], round(r["score"], 6)) for r in fusion.reciprocal_rank_fusion([dense, lexical]).orderBy("rank").collect()]
    assert found == [("a", 0.032522), ("c", 0.032266), ("b", 0.016129)]
    both = fusion.weighted_fusion([rows(("a", 0.9), ("b", 0.1)), rows(("b", 100), ("a", 1))]).collect()
    assert {r["id"]: r["score"] for r in both} == {"a": 1.0, "b": 1.0}
    same = fusion.weighted_fusion([rows(("a", 3), ("b", 3))]).collect()
    assert {r["score"] for r in same} == {1.0}
    with pytest.raises(ValueError):
        fusion.reciprocal_rank_fusion([dense], [1.0, 2.0])
    alone = fusion.merge(dense, lexical.limit(0), 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in alone] == [("a", 0.9), ("b", 0.5)]


@pytest.mark.parametrize(
    ("live", "spec", "k", "ef", "share", "effort", "rows", "scan", "probe", "way"),
    [
        (500, {}, 10, None, 1, 64, 500, 41.7, 803.3, "exact_scan"),
        (14906, {}, 10, None, 1, 64, 14906, 1242.2, 1242.2, "exact_scan"),
        (14907, {}, 10, None, 1, 64, 14907, 1242.2, 1242.2, "ann_graph"),
        (100000, {}, 128, 8, 1, 128, 100000, 8333.3, 2976.4, "ann_graph"),
        (100000, {"a": 1}, 10, None, 0.1, 64, 10000, 833.3, 14882.2, "exact_scan"),
        (200000, {"a": {"$gt": 1}}, 10, None, 0.33, 64, 66000, 5500.0, 4781.3, "ann_graph"),
        (100000, {"a": 1, "b": 1, "c": 1}, 10, None, 0.001, 64, 100, 8.3, 74411.2, "exact_scan"),
    ],
)
def test_planner(spark, live, spec, k, ef, share, effort, rows, scan, probe, way):
    plan = Planner().plan(k=k, live=live, filt=compile_filter(spec, VariantFields("m")), has_vector=True, has_text=False, ef=ef).as_dict()
    assert (plan["selectivity"], plan["estimated_survivors"], plan["scan_cost"], plan["graph_cost"], plan["strategy"]) == (share, rows, scan, probe, way)
    assert plan["ef"] == (0 if way == "exact_scan" else effort)


def test_planner_with_text(spark):
    nothing = compile_filter(None, VariantFields("m"))
    assert Planner().plan(k=5, live=9, filt=nothing, has_vector=False, has_text=True).as_dict() == {"strategy": "lexical_only", "k": 5, "ef": 0, "fetch_k": 5, "use_filter": False, "reason": "no query vector supplied", "live": 9}
    both = Planner().plan(k=5, live=9, filt=nothing, has_vector=True, has_text=True, oversample=2.1)
    assert (both.strategy, both.fetch_k, both.exact) == ("hybrid", 11, True)


def test_config_bounds():
    for bad in (lambda: IvfConfig(cells=0), lambda: PqConfig(bits=5), lambda: PqConfig(rerank_factor=0), lambda: StorageConfig(1), lambda: CollectionConfig("a b", 4), lambda: CollectionConfig("a", 0), lambda: CollectionConfig("a", 4, metric="x"), lambda: CollectionConfig("a", 9, index="ivf_pq")):
        with pytest.raises(ConfigError):
            bad()
    config = CollectionConfig("a-b_1", 16, "l2", "ivf_pq", pq=PqConfig(subvectors=4))
    assert CollectionConfig.from_dict(json.loads(json.dumps(config.as_dict()))) == config


def test_kmeans():
    rng = np.random.default_rng(1)
    data = np.concatenate([c + 0.01 * rng.normal(size=(40, 2)) for c in ((0, 0), (5, 5), (0, 9))])
    centers, label, inertia = ivf.kmeans(data, 3)
    assert inertia < 0.1 and len({tuple(sorted(set(label[i : i + 40]))) for i in (0, 40, 80)}) == 3
    few, _, zero = ivf.kmeans(data[:2], 4)
    assert zero == 0 and (few[2:] == data[1]).all()


def test_ivf_and_pq_recall(spark):
    data = clustered_vectors(spark, 3000, 32, clusters=24, seed=11).cache()
    asked = near_queries(data, 40, seed=5)
    truth = exact_knn(data, asked, 10).cache()
    centroids = ivf.train_cells(data, IvfConfig(cells=32))
    indexed = data.withColumn("cell", ivf.assign(F.col("vector"), centroids)).cache()
    recall = lambda found: metrics.recall_at_k(found, truth, 10).first()[0]
    at = [recall(ivf.probe(indexed, asked, centroids, 10, n)) for n in (1, 4, 32)]
    assert at == sorted(at) and at[1] > 0.9 and at[2] == 1.0
    assert recall(ivf.probe(indexed.where("id % 2 = 0"), asked, centroids, 10, 32)) < 1
    book = pq.train_codebook(data, PqConfig(subvectors=8, bits=4))
    coded = data.withColumn("codes", pq.encode(F.col("vector"), book)).cache()
    rough, sharp = recall(pq.adc_knn(coded, asked, book, 10)), recall(pq.two_stage(coded, asked, book, 10, factor=8))
    assert sharp > 0.9 and sharp >= rough
    m = np.array([r[0] for r in coded.select("codes").limit(50).collect()])
    back = np.array([r[0] for r in coded.select(pq.decode(F.col("codes"), book)).limit(50).collect()])
    assert np.allclose(back, pq.decode_matrix(m, book))
    assert np.allclose(pq.sdc(m[:5], m, pq.centroid_tables(book, "l2"), "l2"), distances("l2", back[:5], back), atol=1e-6)
    assert pq.memory(10, 32, PqConfig(subvectors=8))["compression_ratio"] == 16.0


def test_assign_passes_over_what_is_no_vector(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [float("nan"), 0.0]), (2, [1.0]), (3, None)], "id long, vector array<float>")
    found = df.select("id", ivf.assign(F.col("vector"), np.eye(2)).alias("c"), pq.encode(F.col("vector"), np.array([[[0.0], [1.0]]] * 2)).alias("p")).orderBy("id").collect()
    assert [(r["c"], r["p"]) for r in found] == [(0, [1, 0]), (None, None), (None, None), (None, None)]


def test_random_vectors_are_the_same_for_a_seed(spark):
    a, b = (random_vectors(spark, 50, 8, seed=4).repartition(n).orderBy("id").collect() for n in (1, 5))
    assert a == b and abs(np.linalg.norm(a[0]["vector"]) - 1) < 1e-6


def test_versions_like_a_dict(spark):
    rng = np.random.default_rng(99)
    state, history, log = {}, {}, []
    for seq in range(1, 400):
        key = f"d{rng.integers(40)}"
        if rng.random() < 0.3:
            state.pop(key, None)
            log.append((key, seq, "delete", None))
        else:
            state[key] = seq
            log.append((key, seq, "put", seq))
        history[seq] = dict(state)
    df = spark.createDataFrame(log, "id string, seq long, op string, v long").repartition(4).cache()
    for s in (1, 57, 200, 399):
        assert {r["id"]: r["v"] for r in versions.visible_at(df, s).collect()} == history[s]
    kept = versions.retained(df, 200)
    for s in (200, 300, 399):
        assert {r["id"]: r["v"] for r in versions.visible_at(kept, s).collect()} == history[s]
    assert versions.horizon([], 9) == 9 and versions.horizon([3, 7], 9) == 3
    assert versions.store_stats(df.limit(0)).first()["live"] == 0


def test_replicated_rules(spark):
    match = spark.createDataFrame([(1, 3), (2, 3), (3, 1)], "node long, match_index long")
    log = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "index long, term long")
    assert replicated.commit_index(match, log, 2).first()[0] == 3
    assert replicated.commit_index(match, log, 3).first()[0] == 0
    logs = spark.createDataFrame([(1, 1, 1, "a"), (2, 1, 1, "a")], "node long, index long, term long, command string")
    assert replicated.convergence(logs).first()["converged"]


def test_many_blocks_are_one_plan(spark):
    data = clustered_vectors(spark, 200, 8, clusters=4, seed=1).cache()
    asked = data.where("id < 60").select(F.col("id").alias("qid"), "vector")
    found = exact_knn(data, asked, 5, block=3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert found.orderBy("qid", "rank").collect() == exact_knn(data, asked, 5).orderBy("qid", "rank").collect()


def _traced(f) -> float:
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_smallest_is_bounded_and_exact():
    rng = np.random.default_rng(2)
    q, rows, ids = rng.normal(size=(3000, 8)), rng.normal(size=(6000, 8)), rng.permutation(6000)
    rows[:2000] = rows[0]  # more ties than k
    kept = topk.Smallest(len(q), 10)

    def run():
        for at in range(0, len(rows), 2000):
            for some in topk.tiles(len(q), 2000, 4096):
                kept.add(some, distances("l2", q[some], rows[at : at + 2000]), ids[at : at + 2000])

    assert _traced(run) < 150  # one matrix of 3000 x 2000 takes 48 MB, its square's parts as much again each
    schema = topk.found_schema(T.LongType(), T.LongType())[1]
    found = kept.table(schema, list(range(len(q)))).to_pydict()
    assert found["qid"] == found["_q"] == [n for n in range(len(q)) for _ in range(10)]
    for n in (0, 1, 2999):
        d = distances("l2", q[n : n + 1], rows)[0]
        assert found["id"][10 * n : 10 * n + 10] == ids[np.lexsort((ids, d))[:10]].tolist()


@pytest.mark.parametrize("search", ["exact_knn", "adc_knn", "probe"])
def test_a_task_works_in_tiles(spark, monkeypatch, search):
    data = random_vectors(spark, 3000, 8, seed=4).select("id", "vector").cache()
    asked = data.withColumnRenamed("id", "qid")
    caught, plain = [], type(data).mapInArrow
    monkeypatch.setattr(type(data), "mapInArrow", lambda self, f, shape: caught.append(f) or plain(self, f, shape))
    vectors = np.array([r[0] for r in data.select("vector").collect()])
    columns = [pa.array(range(3000)), pa.array(vectors.tolist())]
    if search == "exact_knn":
        exact_knn(data, asked, 10, "l2")
    elif search == "adc_knn":
        book = np.stack(np.split(vectors[:16], 4, axis=1))
        pq.adc_knn(data.withColumn("codes", pq.encode(F.col("vector"), book, "l2")), asked, book, 10, "l2")
        columns[1] = pa.array(pq.encode_matrix(vectors, book).tolist())
    else:
        ivf.probe(data.withColumn("cell", F.lit(0)), asked, vectors[:1], 10, 1, "l2")
        columns.append(pa.array([0] * 3000))
    assert len(caught) == 1
    batch = pa.record_batch(columns, names=[str(n) for n in range(len(columns))])
    # 3000 queries by 3000 rows: one matrix is 72 MB
    assert _traced(lambda: list(caught[0](iter([batch])))) < 100


def test_bm25_shuffles_no_occurrences(spark):
    docs = spark.range(40).select("id", F.concat_ws(" ", F.array_repeat(F.lit("apple"), 3), F.when(F.col("id") % 2 == 0, "pears"), F.col("id").cast("string")).alias("text")).repartition(4)
    asked = spark.createDataFrame([(0, "apples and pear"), (0, "apples"), (1, "7")], "qid long, text string")
    found = bm25(docs, asked, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("MapInArrow") == 1
    rows = found.orderBy("qid", "rank").collect()
    assert [(r["qid"], r["id"]) for r in rows] == [(0, 0), (0, 2), (0, 4), (0, 6), (0, 8), (1, 7)]


def test_documents_are_whole_over_batches():
    first = lambda length, ok=1: ((length + 1) * 2 + ok) << 32
    code = [first(4) + 1, 2, 1, first(0, 0), first(2) + 3, 3, first(1)]
    ids = [10, None, None, 11, 12, None, 13]
    for size in (1, 2, 3, 7):
        batches = [pa.record_batch([pa.array(ids[n : n + size], pa.int64()), pa.array(code[n : n + size], pa.int64())], names=["id", "code"]) for n in range(0, 7, size)]
        got = {}
        for names, ok, lengths, at, t, tf in documents(iter(batches)):
            for n, name in enumerate(names.to_pylist()):
                got[name] = bool(ok[n]), int(lengths[n]), dict(zip(t[at == n].tolist(), tf[at == n].tolist(), strict=True))
        assert got == {10: (True, 4, {0: 2, 1: 1}), 11: (False, 0, {}), 12: (True, 2, {2: 2}), 13: (True, 1, {})}


def test_merge_reads_each_list_once(spark):
    lists = [spark.range(9).select(F.lit(n).alias("qid"), "id", F.rand(n).alias("score"), (F.col("id") + 1).alias("rank")) for n in (0, 1)]
    plan = fusion.merge(*lists, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 9") == 2


def test_texts_are_joined_where_they_are_read(spark):
    docs = registry.corpus(spark, f"{DATA}/sf0.01", vectors=False)
    assert "embedding" not in docs.columns and docs.count() == registry.corpus(spark, f"{DATA}/sf0.01").count()
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2


def test_postings_shuffle_nothing_unless_ids_repeat(spark):
    docs = spark.createDataFrame([(1, "runs runs ran run"), (2, ""), (3, "the"), (4, "ran"), (5, None)], "id long, text string")
    found = postings(analyzed(docs))
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("run", 1, 3), ("ran", 1, 1), ("ran", 4, 1)}
    again = postings(analyzed(docs.unionByName(docs.where("id = 4")).unionByName(docs.where("id = 1").withColumn("id", F.lit(None).cast("long")))))
    assert {tuple(r) for r in again.where("id = 4 OR id IS NULL").collect()} == {("ran", 4, 2), ("run", None, 3), ("ran", None, 1)}
