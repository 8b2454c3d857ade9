"""Very long texts and words, nulls, repeats and columns with clashing names, for every operator."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe_codec, jaccard_join, ppm_language, quality_rules, source_mix, substring_dedup, suffix_dedup, token_store, topk_kdtree, url_filter
from tests.llm.test_operators import by_force_bytes, by_force_words, groups_by_force, sentence, words_of

#: Names that operators use inside.
CLASHES = ["key", "n", "row", "shard", "d", "v", "id", "uid", "tokens", "items", "block", "queries", "target", "hash", "size", "lang_pred", "score", "anchor", "seeds", "bucket", "start", "end", "ids", "copies", "label", "host", "path", "verdict", "component", "kept"]


@pytest.fixture(scope="module")
def rows():
    long, word = sentence(400, 16_000), "".join(sentence(401, 16_000).split())
    texts = [long, long + " and more", long[:40_000] + " é漢 " + sentence(402, 60), word, word + "x", word + " " + sentence(403, 60), "é" * 70_000, "ab" * 40_000, None, "", "\n \t", sentence(403, 60), sentence(403, 60)]
    assert min(len(long), len(word)) > 70_000
    return [(i, t, "en" if i % 2 else "fr", ["a", None][i % 2]) for i, t in enumerate(texts)] + [(3, word, "en", "a")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2).withColumns({c: F.lit("clash") for c in CLASHES})


def texts_of(rows):
    return [(r[0], r[1] or "") for r in rows]


def test_jaccard(docs, rows):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(docs, 4, 85).collect())
    sets, group = groups_by_force(rows, 4, 85)
    assert group[1] == 0 and group[12] == group[11] == 5
    assert got == sorted((r[0], len(sets[r[0]]), group[r[0]]) for r in rows)


def test_quality(docs, rows):
    got = quality_rules.quality_rules(docs).collect()
    assert sorted((r["doc_id"], r["n_words"], r["word_chars"]) for r in got) == sorted((i, len(words_of(t)), sum(map(len, words_of(t)))) for i, t in texts_of(rows))
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns and 0 in {r["doc_id"] for r in kept.collect()}


def test_mix(docs, rows):
    got = source_mix.source_mix(docs, [5, 2, 1]).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, len(words_of(t))) for i, t in texts_of(rows))
    mixed = source_mix.mixed_documents(docs, [5, 2, 1])
    assert mixed.columns == docs.columns
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r["doc_id"]] += len(words_of(r["text"]))
    assert sum(taken.values()) == sum(r["taken"] for r in got)


def test_bpe(docs, rows):
    import public_tokenizers as P

    codec = bpe_codec.Codec.from_path(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    plain = codec.encoding()
    got = bpe_codec.encode(docs.select("doc_id", "text", *[c for c in CLASHES if c != "ids"]), codec)
    assert sorted((r["doc_id"], r["ids"], r["key"]) for r in got.collect()) == sorted((i, plain.encode_ordinary(t), "clash") for i, t in texts_of(rows))
    decoded = {r["doc_id"]: r["decoded_sha256"] for r in bpe_codec.digests(docs, codec).collect()}
    assert decoded == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts_of(rows)}


def test_repeats(docs, rows):
    got = substring_dedup.digests(docs, 35).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, got)) == by_force_words(texts_of(rows), 35)
    got = suffix_dedup.digests(docs, 50).select("doc_id", "n_bytes", "n_removed").collect()
    assert sorted(map(tuple, got)) == by_force_bytes(texts_of(rows), 50)
    whole = suffix_dedup.remove_repeats(docs, 50).collect()
    assert all(r["row"]["kept"] == "clash" for r in whole)


def test_token_store(docs, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = sorted(map(tuple, token_store.digests(docs, token_store.Tokens.from_path(path), 2).collect()))
    ids = sorted((i, [*plain.encode(t, add_special_tokens=False).ids, 2]) for i, t in texts_of(rows))
    starts = np.cumsum([0, *(len(x) for _, x in ids)])
    assert got == sorted((i, int(s), len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for (i, x), s in zip(ids, starts))


def test_token_store_common_chunks(spark, monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(token_store, "OFTEN", 2)
    monkeypatch.setattr(token_store, "COMMON", 3)
    rows = [(i, "" if i % 3 else sentence(410 + i % 4, 900)) for i in range(40)]
    tokens = token_store.Tokens.from_path(P.path("byte_bpe_50k.json"))
    got = token_store.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), tokens, 2).collect()
    ids = [np.frombuffer(x, dtype="<u4").tolist() + [2] for x in tokens.encode([t for _, t in rows])]
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == [(i, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for (i, _), x in zip(rows, ids)]


def test_odd_tokenizer_files():
    import json

    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        file = json.load(f)
    token_store.checked(file)
    merges = file["model"]["merges"]
    for harmed in ({**file, "normalizer": {"type": "NFC"}}, {**file, "model": {**file["model"], "merges": merges[::-1]}}, {**file, "model": {**file["model"], "dropout": 0.1}}):
        with pytest.raises(ValueError, match="merged by rank"):
            token_store.checked(harmed)


def test_language(docs, rows):
    got = ppm_language.held_out_predictions(docs)
    found = {r["doc_id"]: r for r in got.collect()}
    assert set(found) == {r[0] for r in rows} and {found[i]["lang_pred"] for i in (8, 9, 10)} == {"und"}
    assert all(found[r[0]]["lang_pred"] in ("en", "fr") and 0 <= found[r[0]]["score"] <= 1 for r in rows if r[1] and r[1].strip())


def test_topk_and_urls_with_clashing_columns(spark):
    table = spark.createDataFrame([(i, [float(i % 7), 1.0], f"http://a.com/en/{i}?{'x' * 80_000 if i == 3 else ''}") for i in range(0, 300)], "vec_id long, embedding array<double>, url string")
    table = table.withColumns({c: F.lit("clash") for c in CLASHES})
    got = topk_kdtree.topk(table, table.where("vec_id % 100 = 0"), 10, shard_rows=70).collect()
    first = [6 + 7 * k for k in range(10)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got if r["query_id"] == 100) == [(100, k + 1, v) for k, v in enumerate(first)]
    urls = url_filter.url_filter(table.withColumnRenamed("vec_id", "page_id"), [("block", "com/en/")]).collect()
    assert len(urls) == 300 and all(r["verdict"] == "block" and r["path"].startswith("/en/") for r in urls)


def test_held_out_accuracy(spark):
    """Half of the words of four made-up languages are new in the held-out documents."""
    r, rows = np.random.default_rng(6), []
    letters = ["aeioubcdfg", "aeioulmnpr", "äöüsktnrae", "éèçaioustr"]
    for i in range(600):
        own = letters[i % 4]
        words = ["".join(r.choice(list(own), 2 + r.integers(6))) for _ in range(5 + r.integers(60))]
        rows.append((i, " ".join(words), f"l{i % 4}"))
    got = ppm_language.held_out_predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert len(got) > 100 and np.mean([x["lang_pred"] == f"l{x['doc_id'] % 4}" for x in got]) > 0.95
