"""Sources, sampling, and whole annotations of hand-made tables."""

import pytest
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions.seeds import DBPEDIA, WIKIDATA
from tessera.plans.annotate import run_batch, run_cea, run_cta
from tessera.sources import tables
from tessera.sources.kb import KnowledgeBase, build_search


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    (d / "lands.csv").write_text('country,city,empty\n\nFrance,Paris,\n"Spain","Madrid, capital",\nFrance,Lyon,,surplus\n')
    (d / "other.CSV").write_text("name\r\nParis\r\n0\r\n")
    (d / "skip.txt").write_text("a\nb\n")
    return str(d)


@pytest.fixture(scope="module")
def kb(spark):
    search = [(s, q, 0, 1, u, q) for q, s, u in [("France", "DBpedia", "http://dbpedia.org/resource/France"), ("France", "Wikidata", WIKIDATA + "Q142"), ("Spain", "Wikidata", WIKIDATA + "Q29"), ("Paris", "Wikidata", WIKIDATA + "Q90"), ("Lyon", "DBpedia", "http://dbpedia.org/resource/Lyon_in_France")]]
    types = [("DBpedia", "http://dbpedia.org/resource/France", 0, DBPEDIA + "Country", "Country"), ("DBpedia", "http://dbpedia.org/resource/France", 1, "http://other/Thing", "Thing"), ("Wikidata", WIKIDATA + "Q142", 0, WIKIDATA + "Q6256", "country"), ("Wikidata", WIKIDATA + "Q29", 0, WIKIDATA + "Q6256", "country"), ("Wikidata", WIKIDATA + "Q90", 0, WIKIDATA + "Q515", "city"), ("DBpedia", "http://dbpedia.org/resource/Lyon_in_France", 0, DBPEDIA + "City", "City")]
    parents = [("DBpedia", DBPEDIA + "City", 0, DBPEDIA + "Settlement")]
    return KnowledgeBase(
        spark.createDataFrame(search, "source string, query string, pos int, n_results int, uri string, label string"),
        spark.createDataFrame(types, "source string, entity_uri string, ord int, type_uri string, type_label string"),
        spark.createDataFrame(parents, "source string, type_uri string, ord int, parent_uri string"),
    )


def test_read_cells(spark, folder):
    cells = {(r["table_id"], r["row_idx"], r["col_idx"]): (r["header"], r["value"]) for r in tables.read_cells(spark, folder).collect()}
    assert cells == {
        ("lands", 0, 0): ("country", "France"),
        ("lands", 0, 1): ("city", "Paris"),
        ("lands", 1, 0): ("country", "Spain"),
        ("lands", 1, 1): ("city", "Madrid, capital"),
        ("lands", 2, 0): ("country", "France"),
        ("lands", 2, 1): ("city", "Lyon"),
        ("other", 0, 0): ("name", "Paris"),
        ("other", 1, 0): ("name", "0"),
    }
    with pytest.raises(Exception, match="longer than its header"):
        tables.read_cells(spark, folder, on_malformed="error").collect()


def test_odd_files(spark, tmp_path):
    (tmp_path / "a+b c%20d.csv").write_text("h,i\n\t \t\n1,2\n\u00a0\n3,4")
    (tmp_path / "long.csv").write_text("n\n" + "".join(f"{i}\r\n{' ' * (i % 3)}\n" for i in range(3_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = {(r["table_id"], r["row_idx"], r["col_idx"]): r["value"] for r in tables.read_cells(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {("a+b c%20d", 0, 0): "1", ("a+b c%20d", 0, 1): "2", ("a+b c%20d", 1, 0): "3", ("a+b c%20d", 1, 1): "4"}
    assert got == want | {("long", i, 0): str(i) for i in range(3_000)}


def test_no_header(spark, folder):
    got = tables.read_cells(spark, folder, has_header=False).where("table_id = 'other'").orderBy("row_idx").collect()
    assert [(r["header"], r["value"]) for r in got] == [("Column1", "name"), ("Column1", "Paris"), ("Column1", "0")]


def test_quotes(spark):
    lines = ['ab"c,d"e', 'a,"b ""q"" c",d', '"open,rest', "plain,x", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = [r["f"] for r in df.select("i", tables.split_line(F.col("line")).alias("f")).orderBy("i").collect()]
    assert got == [["abc,de"], ["a", 'b "q" c', "d"], ["open,rest"], ["plain", "x"], [""]]


@pytest.mark.parametrize("n, size", [(199, 100), (10, 1), (10, 2), (10, 3), (7, 7), (7, 9), (7, None), (100, 30)])
def test_sampling(spark, n, size):
    def indices():
        if not size or size >= n:
            return set(range(n))
        step = n // size
        return {n - 1, *(i * step for i in range(max(size - 2, 0) + 1) if i * step < n)}

    cells = spark.range(n).select(F.lit("t").alias("table_id"), F.col("id").cast("int").alias("row_idx"))
    assert {r["row_idx"] for r in tables.sample_rows(cells, size).collect()} == indices()


def test_cta_and_cea(spark, folder, kb):
    cells, config = tables.read_cells(spark, folder), Config(as_of_year=2024)
    got = run_cta(cells, kb, config)
    types = {(r["table_id"], r["col_idx"]): (r["type_uri"], r["header"]) for r in got.types.collect()}
    assert types == {("lands", 0): (WIKIDATA + "Q6256", "country"), ("lands", 1): (WIKIDATA + "Q515", "city"), ("other", 0): (WIKIDATA + "Q515", "name")}
    relations = {(r["source_column"], r["target_column"], r["relation"]) for r in got.relations.where("table_id = 'lands'").collect()}
    assert (0, 1, "hasCity") in relations
    lyon = got.candidates.where("value = 'Lyon'").first()
    assert lyon["score"] == 1.0 and WIKIDATA + "Q515" in [t["uri"] for t in lyon["types"]]
    best = {(r["table_id"], r["row_idx"], r["col_idx"]): r["uri"] for r in run_cea(cells, kb, config, "best").collect()}
    assert best == {("lands", 0, 0): WIKIDATA + "Q142", ("lands", 1, 0): WIKIDATA + "Q29", ("lands", 2, 0): WIKIDATA + "Q142", ("lands", 0, 1): WIKIDATA + "Q90", ("other", 0, 0): WIKIDATA + "Q90"}


def test_batch(spark, folder, kb, tmp_path):
    (tmp_path / "cta.csv").write_text("lands,0,\nlands,1,old\nlands,2,old\nnone,0,kept\nID,NaN,\n")
    got = {(r["table_id"], r["col_idx"]): r["result"] for r in run_batch(spark, folder, str(tmp_path / "cta.csv"), kb, "cta").collect()}
    assert got == {("lands", 0): WIKIDATA + "Q6256", ("lands", 1): WIKIDATA + "Q515", ("lands", 2): "old", ("none", 0): "kept"}
    (tmp_path / "cea.csv").write_text("lands,1,0,\nlands,9,0,old\nnone,1,0,kept\n")
    filled = run_batch(spark, folder, str(tmp_path / "cea.csv"), kb, "cea")
    got = {(r["table_id"], r["row"]): r["uri"] for r in filled.collect()}
    assert got == {("lands", 1): WIKIDATA + "Q142", ("lands", 9): "", ("none", 1): "kept"}
    tables.write_lines(filled, ["table_id", "row", "col_idx", "uri"], str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()][0] == f"lands,1,0,{WIKIDATA}Q142"


def test_command_line(spark, folder, kb, tmp_path, capsys, monkeypatch):
    from tessera import __main__ as command

    for name, t in (("kb_search", kb.search), ("kb_types", kb.types), ("kb_parents", kb.parents)):
        t.write.parquet(str(tmp_path / name))
    config = command.configured(command.parsed(["cta", "x", "y", "--preset", "low", "--sample", "7", "--threshold", "0.4", "--no-uris"]))
    assert (config.sample_size, config.confidence_threshold, config.use_column_relations, config.use_uri_analysis) == (7, 0.4, False, False)
    command.main(["cta", folder, str(tmp_path)])
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 3 and any(x.startswith("lands\t0\tcountry\t") and "% - " in x for x in lines)
    command.main(["cea", folder, str(tmp_path)])
    assert f"lands\t0\t0\t{WIKIDATA}Q142" in capsys.readouterr().out
    (tmp_path / "targets.csv").write_text("lands,0,\n")
    command.main(["cta", folder, str(tmp_path), "--targets", str(tmp_path / "targets.csv"), "--out", str(tmp_path / "filled")])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "filled")).collect()] == [f"lands,0,{WIKIDATA}Q6256"]


def test_streaming(spark, folder, kb, tmp_path):
    from tessera.streaming.folder import annotate_folder

    seen, batches = [], set()

    def sink(df, n):
        batches.add(n)
        seen.extend(df.select("table_id", "col_idx").collect())

    annotate_folder(spark, folder, kb, sink, str(tmp_path / "state"), Config(as_of_year=2024), files_a_batch=1).awaitTermination(120)
    assert len(batches) == 2
    assert {(r["table_id"], r["col_idx"]) for r in seen} == {("lands", 0), ("lands", 1), ("other", 0)}


def test_build_search(spark):
    entities = spark.createDataFrame([("Wikidata", "u1", "Paris"), ("Wikidata", "u2", "Paris Texas"), ("DBpedia", "u3", "Rome")], "source string, uri string, label string")
    values = spark.createDataFrame([("paris",), ("Berlin",)], "value string")
    got = [(r["query"], r["uri"], r["pos"], r["n_results"]) for r in build_search(entities, values).orderBy("pos").collect()]
    assert got == [("paris", "u1", 0, 2), ("paris", "u2", 1, 2)]


def test_annotations_as_files(spark, folder, kb, tmp_path):
    types = run_cta(tables.read_cells(spark, folder), kb, Config.preset("low")).types
    tables.save_annotations(types, str(tmp_path / "j"))
    tables.save_annotations(types, str(tmp_path / "c"), "csv")
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3


def test_scratch_tables_go(spark, folder, kb):
    from pathlib import Path
    from urllib.parse import urlparse

    from tessera.sources.scratch import new_folder, stored, tidy

    @tidy
    def inner(df):
        return stored(stored(df).where("id > 1")).withColumn("x", F.col("id") * 2)

    @tidy
    def outer(df):
        return stored(inner(df)).union(stored(inner(df)))

    base = Path(urlparse(new_folder(spark)).path).parent
    before = set(base.iterdir())

    def new():
        return len(set(base.iterdir()) - before)

    one = inner(spark.range(4))
    assert new() == 1 and sorted(r["x"] for r in one.collect()) == [4, 6]
    two = outer(spark.range(4))
    assert new() == 3 and two.count() == 4
    with pytest.raises(ZeroDivisionError):
        tidy(lambda df: stored(df).count() / 0)(spark.range(2))
    assert new() == 3
    run_cea(tables.read_cells(spark, folder), kb, Config(as_of_year=2024), "best").collect()
