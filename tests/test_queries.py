import pytest

from skein.registry import ORACLES, QUERIES
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], f"{DATA}/sf0.001")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_recall_grows_with_effort(spark):
    found = {r["nprobe"]: r["recall"] for r in QUERIES["ivf_recall"](spark, f"{DATA}/sf0.01").collect()}
    assert [found[n] for n in sorted(found)] == sorted(found.values())
    assert found[8] >= 0.9 and found[16] == 1.0
