import pytest

from tests.oracle import agree
from tidemark.plans import catalogue, files, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, name):
    agree(registry.QUERIES[name](spark, SF), registry.SQL[name], SF)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_fixtures_exercise_what_they_name(spark):
    """Some reports lose citations, some have more pairs than are checked, and some claims fail."""
    rows = registry.QUERIES["strip_citations"](spark, SF).collect()
    assert any(r["unsupported"] for r in rows) and not all(r["unsupported"] for r in rows)
    paired, per = catalogue.judged(spark, SF)
    assert max(r["count"] for r in paired.groupBy("report_id").count().collect()) == 40
    assert {r["verdict"] for r in per.collect()} == {"YES", "PARTIAL", "NO"}
    assert registry.QUERIES["failed_claims"](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
