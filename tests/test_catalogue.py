import pytest

from mnemospark.plans import catalogue
from oracle import DATA, compare

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, catalogue.queries()[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.queries()[name](spark, f"{DATA}/sf0.001").count() > 0


@pytest.mark.parametrize("name, table, key", [("sf_json_compact", "events", None), ("sf_json_digest", "events", "user_id"), ("wg_render", "lineitem", "l_orderkey")])
def test_query_runs_over_its_whole_table(spark, name, table, key):
    whole = spark.read.parquet(f"{DATA}/sf0.01/{table}.parquet")
    assert catalogue.queries()[name](spark, f"{DATA}/sf0.01").count() == (whole.select(key).distinct() if key else whole).count()


def test_episodes_list_all_decisions(spark):
    rows = catalogue.queries()["ag_episode"](spark, f"{DATA}/sf0.01").collect()
    assert sum(r.n for r in rows) == spark.read.parquet(f"{DATA}/sf0.01/events.parquet").count()
    assert all(len(r.refs.split(",")) == r.decisions for r in rows if r.decisions)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
