"""Joins that Spark must not broadcast, whatever the size of their files."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.operators import column_types, uri
from tessera.plans import catalog
from tessera.sources import scratch

SF = "/root/testdata/sf0.001"
QUERIES = ["best_entity_per_column", "cta_targets_left_join", "type_votes", "leading_types", "parent_types", "relation_boost", "prefer_wikidata", "cta_final", "cta_report"]


@pytest.fixture
def candidates(spark, tmp_path):
    """Three rows of two columns, read from a file, as small tables with few distinct values are."""
    entity = "http://dbpedia.org/resource/"
    rows = [("t", c, r, 1, v, entity + u) for r in range(3) for c, v, u in ((0, "alpha", "alpha_beta"), (1, "beta", "beta"))]
    path = str(tmp_path / "candidates.parquet")
    spark.createDataFrame(rows, "table_id string, col_idx int, row_idx int, rank int, value string, uri string").write.parquet(path)
    return spark.read.parquet(path)


def test_uri_evidence_sends_no_cells_to_the_driver(candidates):
    x = uri.uri_evidence(candidates, Config())
    assert {(r["col_idx"], r["row_idx"], r["n"]) for r in x.collect()} == {(0, i, 1) for i in range(3)}
    assert "BroadcastExchange" not in x._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("searched") / "candidates.parquet")
    catalog.Steps(spark, SF).candidates.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", QUERIES)
def test_query_joins_rows_without_broadcast(spark, searched, monkeypatch, name):
    class Planned(Exception):
        pass

    def planned(df):
        raise Planned(df._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(catalog.Steps, "candidates", searched)
    monkeypatch.setattr(catalog, "stored", planned)
    with pytest.raises(Planned) as plan:
        catalog.queries()[name](spark, SF)
    assert re.search(r"SortMergeJoin \[table_id#\d+, row_idx#\d+\]", str(plan.value))


def test_best_entities_sends_one_row_per_entity(spark):
    """Cells of one entity are not ranked in one task: they are aggregated before they are sent."""
    rows = [("t", c, r, k, "u%d" % (r % 2), score, "v%d" % r) for c in range(2) for r, k, score in ((0, 1, 0.5), (1, 2, 0.7), (2, 2, 0.9), (2, 1, 0.9), (3, 1, 0.1), (4, 1, 0.9))]
    names = ["table_id", "col_idx", "row_idx", "rank", "uri", "score", "value"]
    x = column_types.best_entities(spark.createDataFrame(rows, names))
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.index("partial_max_by") > plan.index("Exchange")
    assert x.columns == [*names, "first"]
    want = []
    for c in range(2):
        for u in ("u0", "u1"):
            own = [r for r in rows if r[1] == c and r[4] == u]
            want.append((*min(own, key=lambda r: (-r[5], r[2], r[3])), min((r[2], r[3]) for r in own)))
    assert sorted((*r[:-1], tuple(r[-1])) for r in x.collect()) == sorted(want)


SEARCHES = ["cta_report", "relation_boost", "cta_targets_left_join", "prefer_wikidata", "type_votes", "cta_final", "leading_types", "parent_types"]


@pytest.mark.parametrize("name", SEARCHES)
def test_query_searches_stored_tables(spark, monkeypatch, name):
    """The plan of the candidates reads cells and knowledge base, and doesn't hold their making."""

    class Planned(Exception):
        pass

    def planned(df):
        if {"rank", "types"} <= set(df.columns):
            raise Planned(scratch._roots(df))
        return scratch.stored(df)

    monkeypatch.setattr(catalog, "stored", planned)
    with pytest.raises(Planned) as plan:
        catalog.queries()[name](spark, SF)
    roots = plan.value.args[0]
    assert roots and not [path for path in roots if path.endswith(("nation.parquet", "customer.parquet", "part.parquet"))]


def test_relation_boost_plan_holds_its_inputs_once(spark):
    """Types and relations are read, not made again for each direction and side."""
    types = spark.createDataFrame([("t", 0, 1, "a", 0.5), ("t", 1, 1, "b", 0.5)], "table_id string, col_idx int, place int, type_uri string, confidence double")
    related = spark.createDataFrame([("t", 0, 1, "r", 0.5)], "table_id string, source_column int, target_column int, relation string, confidence double")
    seeds = spark.createDataFrame([("a", "b", "r", True)], "source_type string, target_type string, relation string, direct boolean")
    types = types.withColumn("n", F.count("*").over(Window.partitionBy("table_id")))
    x = column_types.relation_boost(types, related, seeds, Config())
    assert "Window" not in x._jdf.queryExecution().executedPlan().toString()
    assert {(r["type_uri"], r["confidence"]) for r in x.collect()} == {("a", 0.6), ("b", 0.6)}
