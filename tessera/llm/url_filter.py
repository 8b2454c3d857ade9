"""URL filters: a rule list first, then association rules mined from labelled URLs by FP-growth.

Mined rules are pruned by support, confidence and redundancy, and matched by an inverted index of their rarest
tokens.  Nulls and odd URLs: without ``://`` (or null) host and path are empty, no rule fits, and there are
no tokens, so the verdict is the default.  Repeated rows give repeated results; an empty table an empty one.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import tidy
from .common import save

#: (verdict, host and path prefix); the longest that fits decides.
Rule = tuple[str, str]
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LABEL = "label\x00"
#: A rule holds in so many labelled URLs at least, however few there are.
LEAST_ROWS = 5
#: Baskets with more tokens (after those that need no combinations) are mined in parts.
WIDTH = 12
#: Tables of up to this many tokens or rules are sent to all executors; larger ones are joined by shuffle.
BROADCAST_RULES = 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), upper, lower), F.regexp_extract(url, PARTS, 2)


def listed(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        own_host, slash, rest = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens: each label of the host by its distance from the end, path words by depth, scheme, query keys, file type."""
    labels = F.reverse(F.split(host, r"\."))
    host_tokens = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    path_tokens = F.transform(steps, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), F.regexp_replace(x, r"\d+", "0")))
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1))
    query_tokens = F.transform(keys, lambda x: F.concat(F.lit("q:"), x))
    scheme = F.array(F.concat(F.lit("s:"), F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z]+)://", 1)))
    every = F.array_distinct(F.concat(host_tokens, path_tokens, query_tokens, scheme))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def mine(items: DataFrame, min_support: float, min_confidence: float, longest: int = 3) -> DataFrame:
    """Rules (antecedent, key, verdict, confidence, support) from items(tokens, label).

    Only labelled URLs train.  A rule's support is how many of them hold its antecedent of up to ``longest``
    tokens and carry its verdict; its confidence is their share of those that hold the antecedent.  A rule is dropped
    if a part of its antecedent gives the same verdict as surely.  So a token that only goes with one label is
    a rule by itself and needs no combinations, and of tokens that occur in just the same URLs, but under several
    labels, the first stands for all.  key is the antecedent's rarest token.
    """
    labelled = save(items.where(F.col("label").isNotNull() & (F.size("tokens") > 0)).select("tokens", "label", F.monotonically_increasing_id().alias("id")))
    need = max(LEAST_ROWS, math.ceil(min_support * labelled.count()))
    alone = labelled.select(F.explode("tokens").alias("token"), "label", "id").groupBy("token", "label").agg(F.count("*").alias("support"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("where"))
    places = F.sort_array(F.collect_list(F.struct("label", "where")))  # one entry a label
    tokens_ = alone.groupBy("token").agg(F.sum("support").alias("rows"), F.max("support").alias("most"), places.alias("places"))
    tokens_ = save(tokens_.where(F.col("most") >= need))
    mixed = save(tokens_.where("most < rows").groupBy("places").agg(F.min("token").alias("token"), F.first("rows").alias("rows")).select("token", "rows"))
    small = F.broadcast(mixed) if mixed.count() <= BROADCAST_RULES else mixed

    slim = labelled.select("id", "label", F.explode("tokens").alias("token")).join(small.select("token"), "token").groupBy("id", "label").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    slim = save(slim.groupBy("tokens", "label").agg(F.count("*").alias("n")))
    baskets = slim.select(F.explode(F.array_repeat(F.concat(F.array(F.concat(F.lit(LABEL), "label")), "tokens"), F.col("n").cast("int"))).alias("items"))
    baskets = save(baskets.select(F.explode(narrow(F.col("items"))).alias("items")))
    n_baskets = max(baskets.count(), 1)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / n_baskets)).fit(baskets)
    sets = model.freqItemsets.where((F.size("items") >= 3) & (F.size("items") <= longest + 1) & F.exists("items", lambda x: x.startswith(LABEL)))
    sets = sets.select(F.array_sort(F.filter("items", lambda x: ~x.startswith(LABEL))).alias("antecedent")).distinct()

    # Exact counts, as a wide basket was counted in parts: sets meet baskets at their rarest token.
    sets = rarest(sets, small)
    several = slim.withColumn("key", F.explode("tokens")).join(F.broadcast(sets) if sets.count() <= BROADCAST_RULES else sets, "key").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    counted = several.groupBy("antecedent", "key", "label").agg(F.sum("n").alias("support"))
    counted = counted.unionByName(alone.join(F.broadcast(tokens_.select("token")) if tokens_.count() <= BROADCAST_RULES else tokens_.select("token"), "token").select(F.array("token").alias("antecedent"), F.col("token").alias("key"), "label", "support"))
    rows = counted.groupBy("antecedent").agg(F.sum("support").alias("rows"))
    found = counted.join(rows, "antecedent").withColumn("confidence", F.col("support") / F.col("rows"))
    found = save(found.where((F.col("support") >= need) & (F.col("confidence") >= min_confidence)).select("antecedent", "key", F.col("label").alias("verdict"), "confidence", "support"))

    parts = found.select(F.col("antecedent").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"), F.element_at("antecedent", 1).alias("first"))
    long = found.withColumn("first", F.explode("antecedent"))
    redundant = long.join(parts, "first").where((F.size("part") < F.size("antecedent")) & (F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0))
    return save(found.join(redundant.select("antecedent", "verdict").distinct(), ["antecedent", "verdict"], "left_anti"))


def narrow(items: Column) -> Column:
    """Baskets of at most WIDTH tokens beside the label, the first item: any three tokens of a wide basket are in one of them."""
    block = WIDTH // 3
    own, label = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(1))), F.slice(items, 1, 1)
    last = F.ceil(F.size(own) / block).cast("int") - 1
    part = lambda k: F.slice(own, k * block + 1, F.lit(block))
    threes = F.transform(
        F.sequence(F.lit(0), last - 2),
        lambda i: F.flatten(F.transform(F.sequence(i + 1, last - 1), lambda j: F.transform(F.sequence(j + 1, last), lambda k: F.concat(label, part(i), part(j), part(k))))),
    )
    return F.when(F.size(items) <= WIDTH + 1, F.array(items)).otherwise(F.flatten(threes))


def rarest(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """sets(antecedent) with key, the token that fewest rows hold."""
    each = sets.withColumn("token", F.explode("antecedent")).join(counts, "token")
    return save(each.groupBy("antecedent").agg(F.min_by("token", F.struct("rows", "token")).alias("key")))


@tidy
def url_filter(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", min_support: float = 0.005, min_confidence: float = 0.9, default: str = "allow") -> DataFrame:
    """Judge every URL: page id, host, path, rule, verdict, by_method (true if a mined rule decided).

    labels(page id, label) trains the mined rules; without it, the verdicts of the rule list are the labels.
    A URL that no listed rule fits gets the verdict of the surest mined rule (ties: more support, then the smaller
    verdict, so allow before block), else the default.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    judged = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens"))
    if labels is None:
        items = judged.where(F.col("listed").isNotNull()).select("tokens", F.col("listed").alias("label"))
    else:
        labels = labels.select(F.col(labels.columns[0]).alias("page_id"), F.col(labels.columns[1]).cast("string").alias("label"))
        items = judged.join(labels, "page_id").select("tokens", "label")
    mined = mine(items, min_support, min_confidence)
    mined = F.broadcast(mined) if mined.count() <= BROADCAST_RULES else mined
    # Distinct token sets are few beside the URLs; each is matched once through the index of rule keys.
    unlisted = judged.where(F.col("listed").isNull())
    sets = unlisted.select("tokens").distinct()
    hits = sets.withColumn("key", F.explode("tokens")).join(mined, "key").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = hits.groupBy("tokens").agg(F.min_by("verdict", F.struct(-F.col("confidence"), -F.col("support"), F.col("verdict"))).alias("learned"))
    result = ["page_id", "host", "path", "rule"]
    by_list = judged.where(F.col("listed").isNotNull()).select(*result, F.col("listed").alias("verdict"), F.lit(False).alias("by_method"))
    by_rule = unlisted.join(best, "tokens", "left").select(*result, F.coalesce("learned", F.lit(default)).alias("verdict"), F.col("learned").isNotNull().alias("by_method"))
    return by_list.unionByName(by_rule)
