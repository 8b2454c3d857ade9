"""Every query against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    assert len(got) and canonical(got) == canonical(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_clean_whole_texts(spark, tmp_path):
    long = "abc " * 60
    rows = [(0, long + " \u00e9\u00a0\t x^` "), (1, " " * 300 + "N/A"), (2, "\u00fc  " * 400_000), (3, None), (4, "n" * 250 + "\u0301")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["cleaned"] for r in catalog.queries()["clean_cells"](spark, str(tmp_path)).collect()}
    assert got == {0: long + "e x", 1: "", 2: " ".join("u" * 400_000), 3: "", 4: "n" * 250}


def test_uri_contains_every_page(spark, duck):
    got = catalog.queries()["uri_contains"](spark, SF).collect()
    ends = duck.sql("select page_id, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') from pages where url like '%/' or url like '%#'").fetchall()
    assert len(got) == duck.sql("select count(*) from pages").fetchall()[0][0]
    assert ends and set(ends) <= {(r["page_id"], r["part"]) for r in got}


def test_cea_targets_name_every_row(spark, tmp_path):
    for t in ("nation", "part"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    row = spark.read.parquet(f"{SF}/customer.parquet").limit(1)
    row.drop("c_custkey").crossJoin(spark.range(1, 2501).withColumnRenamed("id", "c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(25_000).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    got = catalog.queries()["cea_targets_left_join"](spark, str(tmp_path)).where("table_id = 'customers'").collect()
    assert {(r["row"], r["col_idx"]) for r in got} == {(i, c) for i in range(1, 2501) for c in range(3)}
    assert all(r["uri"] for r in got if r["col_idx"] < 2)
