import json

import pytest
from pyspark.sql import functions as F

from skein.collection import Database
from skein.config import IvfConfig, PqConfig
from skein.errors import ConflictError, CorruptionError, NotFoundError, QueryError, SchemaError, TransactionError
from skein.plans.planner import Planner
from skein.sources.jsonl import read_jsonl, write_jsonl
from skein.sources.synthetic import clustered_vectors
from skein.streaming.ingest import CHANGES, apply_batch, ingest, sessions, windowed_counts


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "db"))


@pytest.fixture
def col(db):
    c = db.create_collection("docs", 2, metric="l2")
    c.upsert_many([{"id": f"d{i}", "vector": [float(i), 0.0], "metadata": {"group": i % 5, "rank": i, "nested": {"flag": i % 2 == 0}}, "text": f"document number {i} about vectors"} for i in range(20)])
    return c


def test_catalog(db):
    db.create_collection("b", 3)
    a = db.create_collection("a", 4, metric="dot")
    assert db.list_collections() == ["a", "b"] and len(a) == 0 and a.search([0.0] * 4).ids() == []
    assert db.create_collection("a", 9, exist_ok=True).config.dim == 4
    with pytest.raises(SchemaError):
        db.create_collection("a", 4)
    db.drop_collection("b")
    for f in (db.drop_collection, db.open_collection):
        with pytest.raises(NotFoundError):
            f("b")


def test_search_filter_text_hybrid(col):
    assert col.search([3.0, 0.0], k=3).ids() == ["d3", "d2", "d4"]
    found = col.search([3.0, 0.0], k=3, filter={"group": 0, "nested.flag": True}, include_vectors=True)
    assert found.ids() == ["d0", "d10"] and "vector" in found.hits.columns and found.plan["use_filter"]
    assert col.search(text="number 7", k=1).ids() == ["d7"]
    both = col.search([7.0, 0.0], "number 7", k=2)
    assert both.ids()[0] == "d7" and both.plan["strategy"] == "hybrid" and both.plan["vector_stage"] == "exact_scan"
    assert col.search().ids() == [] and col.search([1.0, 0.0], k=0).ids() == []
    assert json.loads(both.rows()[0]["metadata"])["rank"] == 7
    for bad in (lambda: col.search([1.0]), lambda: col.search([float("nan"), 1.0])):
        with pytest.raises(SchemaError):
            bad()
    with pytest.raises(QueryError):
        col.search([1.0, 0.0], k=-1)


def test_versions_of_a_collection(db, col):
    assert len(col) == 20 and "d3" in col and "nope" not in col
    with col.snapshot() as old:
        col.upsert("d3", [100.0, 0.0], {"group": 9}, "moved")
        assert col.delete("d4") and not col.delete("d4") and len(col) == 19
        assert col.search([3.0, 0.0], k=2, snapshot=old).ids() == ["d3", "d2"]
        assert col.search([3.0, 0.0], k=1).ids() == ["d2"] and col.get("d3", True)["vector"] == [100.0, 0.0]
        assert col.vacuum() == 0 and col.search([4.0, 0.0], k=1, snapshot=old).ids() == ["d4"]
    assert col.vacuum() == 2 and len(col) == 19 and col.get("d4") is None
    again = db.open_collection("docs")
    assert len(again) == 19 and again.search([100.0, 0.0], k=1).ids() == ["d3"]
    assert again.stats()["storage"]["tombstones"] == 0 and again.stats()["text"]["docs"] == 19
    again.upsert("e", [0.0, 5.0])
    assert again.compact() and not again.compact() and len(db.open_collection("docs")) == 20


def test_bad_batches_change_nothing(spark, col):
    before = col.seq
    for rows in ([("x", [1.0, 2.0]), ("y", [1.0])], [("", [1.0, 2.0])], [("x", [1.0, 2.0]), ("x", [2.0, 2.0])], [("x", [float("inf"), 0.0])]):
        with pytest.raises(SchemaError):
            col.upsert_many(spark.createDataFrame(rows, "id string, vector array<float>"))
    assert col.seq == before and "x" not in col
    for bad in (("", [1.0, 2.0]), ("x", [1.0]), ("x", [1.0, None]), ("x", "ab")):
        with pytest.raises(SchemaError):
            col.upsert(*bad)


def test_transactions(col):
    with col.transaction() as t:
        t.upsert("new", [1.0, 1.0])
        t.delete("d0")
        t.delete("absent")
    assert "new" in col and "d0" not in col
    with pytest.raises(TransactionError):
        t.commit()
    a, b, c = col.transaction(), col.transaction(), col.transaction()
    a.upsert("d1", [0.0, 0.0])
    b.upsert("d1", [9.0, 9.0])
    c.upsert("d2", [5.0, 5.0])
    assert a.commit() == 1 and c.commit() == 1
    with pytest.raises(ConflictError):
        b.commit()
    d = col.transaction()
    d.upsert("d5", [1.0, 1.0])
    col.delete("d5")
    with pytest.raises(ConflictError):  # a delete is a conflict as well
        d.commit()
    with pytest.raises(RuntimeError), col.transaction() as e:
        e.upsert("never", [1.0, 1.0])
        raise RuntimeError
    assert "never" not in col


def test_commit_markers(col):
    assert not col.files.create("_commits/00000000000000000001.json", "{}")  # exists
    orphan = col.commits.stage(col.log())
    assert len(col) == 20 and col.commits.orphans() == [orphan]
    col.files.create("_commits/00000000000000000099.json", "{torn")
    with pytest.raises(CorruptionError):
        len(col)


@pytest.mark.parametrize("options", [{"index": "ivf"}, {"index": "ivf_pq", "pq": PqConfig(subvectors=8, bits=4)}, {"index": "ivf_pq", "pq": PqConfig(subvectors=8, bits=4, keep_originals=False)}])
def test_indexed_search(spark, db, options):
    col = db.create_collection("v", 16, ivf=IvfConfig(cells=16), **options)
    col.planner = Planner(small=0, scan_speedup=1e-9)  # always probes
    data = clustered_vectors(spark, 800, 16, clusters=8, seed=3).select(F.format_string("d%04d", "id").alias("id"), "vector", F.struct((F.col("id") % 10).alias("g")).alias("metadata")).cache()
    col.upsert_many(data)
    assert col.build_index() == 800
    q = data.where("id = 'd0042'").first()["vector"]
    found = col.search(q, k=10)
    near = exact = {r["id"] for r in __import__("skein.operators.knn", fromlist=["nearest"]).nearest(data, q, 10).collect()}
    assert found.plan["strategy"] == "ann_graph" and len(exact & set(found.ids())) >= (3 if options.get("pq") and not options["pq"].keep_originals else 8)
    some = col.search(q, k=10, filter={"g": 2})
    assert len(some.ids()) == 10 and all(json.loads(r["metadata"])["g"] == 2 for r in some.rows())
    with col.snapshot() as old:
        col.upsert("fresh", q)
        col.delete("d0042")
        assert "fresh" in col.search(q, k=3).ids() and "d0042" not in col.search(q, k=10).ids()
        assert "fresh" not in col.search(q, k=10, snapshot=old).ids() and "d0042" in col.search(q, k=10, snapshot=old).ids()
        col.build_index()
        assert "d0042" in col.search(q, k=10, snapshot=old).ids()
    assert near and col.stats()["index"]["rows"] == 800


def test_retained_statistics(spark, col):
    col.upsert("d0", [0.0, 0.0], {}, "number number number")
    asked = spark.createDataFrame([(0, None, "number")], "qid long, vector array<double>, text string")
    scores = [{r["id"]: r["score"] for r in col.search_batch(asked, 30, has_vector=False, has_text=True, stats=s).rows()} for s in ("visible", "retained")]
    assert scores[0].keys() == scores[1].keys() and len(scores[0]) == 20 and scores[0]["d1"] != scores[1]["d1"]


def test_jsonl(spark, db, tmp_path):
    lines = ['{"id": "a", "vector": [1, 2], "metadata": {"k": [1, null]}, "text": "hi"}', "", '{"id": "b", "vector": [0.5, 0]}', "  "]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    col = db.create_collection("j", 2, metric="l2")
    assert col.upsert_many(read_jsonl(spark, str(tmp_path / "in.jsonl"))) == 2
    assert col.get("a") == {"id": "a", "score": 1.0, "metadata": {"k": [1, None]}, "text": "hi"} and col.get("b")["text"] is None
    write_jsonl(col.documents(), str(tmp_path / "out"))
    assert sorted(r["id"] for r in read_jsonl(spark, str(tmp_path / "out")).collect()) == ["a", "b"]


def test_streaming(spark, db, tmp_path):
    col = db.create_collection("s", 1, metric="l2")
    rows = [("put", "a", [1.0], "{}", None, 1), ("put", "b", [2.0], "{}", None, 2), ("delete", "a", None, None, None, 3), ("put", "b", [7.0], "{}", None, 4)]
    plain = "op string, id string, vector array<float>, metadata string, text string, position long"
    changes = spark.createDataFrame(rows, plain).withColumn("metadata", F.parse_json("metadata"))
    assert apply_batch(col, changes, 0, "x") == 1 and apply_batch(col, changes, 0, "x") == 0
    assert col.get("b", True)["vector"] == [7.0] and "a" not in col
    col.upsert("c", [1.0])
    col.compact()
    assert apply_batch(col, changes, 0, "x") == 0  # a compaction passes the batch number on
    for n in range(2):
        spark.createDataFrame([("put", f"s{n}", [1.0], "{}", None, n)], plain).coalesce(1).write.json(str(tmp_path / "feed"), mode="append")
        stream = spark.readStream.schema(plain).json(str(tmp_path / "feed")).withColumn("metadata", F.parse_json("metadata"))
        ingest(col, stream, str(tmp_path / "ck")).awaitTermination()
    assert {r["id"] for r in col.documents().collect()} == {"b", "c", "s0", "s1"} and CHANGES.count(",") == 5


def test_windows(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-01-01 00:10:00' AS ts, 1L AS user_id, 'a' AS event_type, 2.0D AS value UNION ALL SELECT TIMESTAMP'2024-01-01 00:50:00', 1L, 'a', 3.0D UNION ALL SELECT TIMESTAMP'2024-01-01 01:00:00', 1L, 'a', 4.0D")
    assert sorted((r["n"], r["total"]) for r in windowed_counts(df).collect()) == [(1, 4.0), (2, 5.0)]
    assert sorted(r["n"] for r in sessions(df).collect()) == [1, 2]
