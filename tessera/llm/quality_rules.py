"""Quality rules in a short-circuit cascade.

Each rule rejects documents.  On a bounded sample the cost of a rule (seconds to evaluate it, without those of a
job that evaluates nothing) and its selectivity (share it rejects) are measured, and rules run in order of
rejection per cost, each only on what those before it kept.  The order changes the work, never the verdict.

Null text counts as empty: no words, so the base rule rejects it.  Repeated rows are judged alike; an
empty table gives an empty result.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words

WINDOW = 8
#: Rows and applications of each rule that are timed; the least seconds a row that a rule is taken to cost.
SAMPLE_ROWS, REPEATS, LEAST_COST = 1_000, 10, 1e-7


def window_hashes(parts: Column, n_words: Column, window: int = WINDOW) -> Column:
    """Hashes of the windows of a word array."""
    at = F.sequence(F.lit(0), n_words - window)
    return F.when(n_words >= window, F.transform(at, lambda i: F.xxhash64(*[F.get(parts, i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>"))


def base(docs: DataFrame) -> DataFrame:
    """row (docs' columns), text and the base measures; ``text`` is never null."""
    x = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text")).withColumn("w", words(F.col("text")))
    x = x.select("row", "text", "w", F.size("w").alias("n"))
    x = x.withColumn("h", window_hashes(F.col("w"), F.col("n")))
    x = x.withColumn("twice", F.size(F.array_distinct("h")) < F.size("h"))
    pairs = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    x = x.withColumn("s", F.when(F.col("twice"), pairs))
    same = F.transform(
        "s",
        lambda p, k: F.when((F.get("s", k - 1)["h"] == p["h"]) | (F.get("s", k + 1)["h"] == p["h"]), p["i"]).otherwise(F.lit(-1)),
    )
    starts = F.sort_array(F.filter(same, lambda i: i >= 0))
    x = x.withColumn("starts", F.when(F.col("twice"), starts))
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["sum"] + i + WINDOW - F.greatest(acc["end"], i)).alias("sum")),
        lambda acc: acc["sum"],
    )
    x = x.withColumn("lines", lines(F.col("text")))
    measures = F.struct(
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("twice"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    # A filter on the measures must not be pushed below them: substituted into it, the word array would be
    # split again for each window.  Nothing is pushed through a generator.
    x = x.select("row", "text", F.explode(F.array(measures)).alias("m")).select("row", "text", "m.*")
    return x.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE.replace("[", "[^", 1)))


def rules() -> dict[str, Column]:
    """What each rule rejects, on the columns of base().  What base() does not return, a rule works out itself."""
    # regexp_count would build an array of all matches; lengths need no array.
    left = lambda other: F.length(F.regexp_replace("text", other, ""))
    letters = left(r"\P{L}+")
    stutters = F.aggregate(
        words(F.col("text")),
        F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.when(x == acc["last"], 1).otherwise(0)).alias("n")),
        lambda acc: acc["n"],
    )
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
        "repeated_lines": 2 * F.col("n_dup_lines") > F.size(lines(F.col("text"))),
        "few_letters": 10 * letters < 6 * F.col("word_chars"),
        "shouting": 2 * left(r"\P{Lu}+") > letters,
        "exclamations": 5 * left("[^!]+") > F.col("n_words"),
        "stutter": 10 * stutters > 3 * F.col("n_words"),
    }


def measured_rules(docs: DataFrame, checks: dict[str, Column]) -> dict[str, tuple[float, float]]:
    """Of each rule the share it rejects and its seconds a row, on about SAMPLE_ROWS rows of docs, drawn by a fixed seed.

    Each rule is applied REPEATS times to the sample in one job; what a job without a rule takes is subtracted.
    """
    share = min(1.0, SAMPLE_ROWS / max(docs.count(), 1))
    sample = base(docs.select("text").sample(share, seed=1)).where(~F.col("base_failed")).limit(2 * SAMPLE_ROWS).drop("row").persist()
    try:
        n = sample.count()
        if not n:
            return {name: (0.0, LEAST_COST) for name in checks}
        many = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

        def timed(check: Column) -> tuple[int, float]:
            began = time.perf_counter()
            rejected = many.agg(F.sum(check.cast("int"))).first()[0] or 0
            return rejected, time.perf_counter() - began

        nothing = F.length("text") < 0
        timed(nothing)  # loads what any job needs
        _, empty = timed(nothing)
        found = {name: timed(check) for name, check in checks.items()}
    finally:
        sample.unpersist()
    return {name: (rejected / REPEATS / n, max((seconds - empty) / REPEATS / n, LEAST_COST)) for name, (rejected, seconds) in found.items()}


def ordered(docs: DataFrame, checks: dict[str, Column]) -> list[str]:
    """Rule names by rejection per cost."""
    facts = measured_rules(docs, checks)
    return sorted(checks, key=lambda name: (-facts[name][0] / facts[name][1], facts[name][1], name))


def judged(docs: DataFrame, checks: dict[str, Column] | None) -> DataFrame:
    checks = rules() if checks is None else checks
    measured = base(docs)
    rejected = F.when(F.col("base_failed"), F.lit(True))
    for name in ordered(docs, checks):
        rejected = rejected.when(checks[name], F.lit(True))
    return measured.withColumn("kept", ~rejected.otherwise(F.lit(False)))


def quality_rules(docs: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, base measures, base_failed and kept for every document."""
    out = judged(docs.select("doc_id", "text"), checks)
    return out.select("row.doc_id", *[c for c in out.columns if c not in ("row", "text")])


def kept_documents(docs: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """The rows of docs that are kept."""
    return judged(docs, checks).where("kept").select("row.*")
