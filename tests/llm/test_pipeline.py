"""The pipeline against a brute-force version, and its guard in the driver's entry."""

import hashlib
import sys

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_operators import SCHEMA, sentence, words_of


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    shared, base = sentence(51, 60), sentence(52, 150)
    near = base.split()
    near[70] = "changed"
    rows = [(0, None, "en", "a", 0), (1, "too short", "en", "a", 0), (2, base, "en", "a", 9), (3, " ".join(near), "en", "b", 9), (4, base, "en", "b", 9), (2, base, "en", "a", 9), (5, "## $$ " * 80, "en", "a", 0)]
    rows += [(10 + i, sentence(60 + i, 80) + (" é" + shared if i % 3 == 0 else ""), "en", ["a", "b", None][i % 3], 0) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("clash")).write.parquet(d + "/documents.parquet")
    return d


def staged(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in cp.STAGES:
        docs = cp.save(stage(spark, docs, sf_dir))
        out.append(docs)
    return out


def test_stages(spark, sf_dir):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    quality, unique, cut, mixed, coded = staged(spark, sf_dir)
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(x.columns == columns for x in (quality, unique, cut, mixed))
    assert sorted(r["doc_id"] for r in quality.collect()) == sorted([2, 2, 3, 4, *range(10, 40)])
    assert sorted(r["doc_id"] for r in unique.collect()) == [2, *range(10, 40)]

    first: dict = {}
    want = {}
    for i in [2, *range(10, 40)]:
        raw = rows[i].encode()
        gone = set()
        for k in range(len(raw) - 49):
            if first.setdefault(raw[k : k + 50], i) < i:
                gone.update(range(k, k + 50))
        want[i] = bytes(x for j, x in enumerate(raw) if j not in gone).decode(errors="ignore")
    got = {r["doc_id"]: r for r in cut.collect()}
    assert {i: r["text"] for i, r in got.items()} == want and want[13] != rows[13]
    assert all(r["n_chars"] == len(r["text"]) and r["ids"] == "clash" for r in got.values())

    size = {i: len(words_of(t)) for i, t in want.items()}
    taken = [r["doc_id"] for r in mixed.collect()]
    source = {r["doc_id"]: r["source"] for r in cut.collect()}
    by = {s: sum(size[i] for i in size if source[i] == s) for s in ("a", "b", None)}
    for s, w in (("a", 5), ("b", 2), (None, 1)):
        target = min(w / 8 * sum(by.values()), 3 * by[s])
        assert abs(sum(size[i] for i in taken if source[i] == s) - target) <= max(size.values())

    import public_tokenizers as P

    codec = cp.bpe_codec.Codec.from_path(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    plain: tiktoken.Encoding = codec.encoding()
    rows_want = []
    for i in taken:
        ids = plain.encode_ordinary(want[i])
        rows_want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(want[i].encode()).hexdigest()))
    assert sorted(map(tuple, coded.collect())) == sorted(rows_want)
    assert sorted(map(tuple, cp.run(spark, sf_dir).collect())) == sorted(rows_want)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_entry_without_llm(monkeypatch):
    import importlib

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = set(importlib.reload(__spark_entry__).queries())
    monkeypatch.undo()
    assert names and not any(n.startswith("op") for n in names) and "pipeline" not in names
    assert "pipeline" in importlib.reload(__spark_entry__).queries()
