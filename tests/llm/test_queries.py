"""The registered queries at the smallest scale: against their SQL, and without a trace in the session's settings."""

import duckdb
import pytest

from tessera.llm import queries

SF = "/root/testdata/sf0.001"
SETTINGS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    before = [spark.conf.get(x) for x in SETTINGS]
    df = queries.queries()[name](spark, SF)
    got = df.toPandas()
    assert [spark.conf.get(x) for x in SETTINGS] == before
    assert len(got)
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "pages"):
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        rows = lambda x: sorted(map(repr, x[sorted(x.columns)].astype(object).itertuples(index=False, name=None)))
        assert rows(got) == rows(want)
