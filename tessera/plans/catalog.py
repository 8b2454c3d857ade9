"""Queries of the annotation engine: each runs one operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import seeds, similarity, text
from ..operators import column_types, mapping, relations, search, selection, uri
from ..sources import service, tables
from ..sources.scratch import new_folder, stored, tidy
from . import fixtures, oracles

CONFIG = Config(as_of_year=2024, correct=False)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = tidy(f)
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Steps:
    """The stages of an annotation of the fixture tables, each built once, when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.kb = fixtures.knowledge_base(spark, sf_dir).for_config(CONFIG)
        self.cells = fixtures.cells(spark, sf_dir)
        self.mapping, self.relations = seeds.type_mapping(spark), seeds.type_relations(spark)

    @cached_property
    def hits(self):
        return search.lookup(search.searchable(self.cells, CONFIG), self.kb, CONFIG)

    @cached_property
    def top(self):
        return stored(search.ranked(search.dedupe(self.hits), CONFIG))

    @cached_property
    def candidates(self):
        # Read up to three times in one plan: unstored, the plan would hold the making of each as often, and the driver with it.
        kb = replace(self.kb, search=stored(self.kb.search), types=stored(self.kb.types))
        return stored(search.search_entities(stored(self.cells), kb, CONFIG))

    @cached_property
    def mapped(self):
        return mapping.enhance(self.candidates, self.mapping)

    @cached_property
    def scored(self):
        return stored(uri.boost_by_uri(self.mapped, CONFIG, self.candidates))

    @cached_property
    def votes(self):
        return column_types.type_votes(self.scored, self.kb.parents, CONFIG)

    @cached_property
    def leading(self):
        return stored(column_types.leading_types(self.votes, CONFIG))

    @cached_property
    def preferred(self):
        return column_types.prefer_wikidata(self.leading, self.mapping, CONFIG)

    @cached_property
    def related(self):
        return relations.column_relations(self.mapped, self.relations, CONFIG)


# Values

DIACRITICS = "replace(replace(replace(replace(strip_accents({0}), '^', ''), '`', ''), chr(183), ''), chr(180), '')"


@query(f"""select doc_id, case when lower(v) in ('null', 'n/a') then '' else v end as cleaned from (
  select doc_id, {DIACRITICS.format("trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g'))")} as v from documents)""")
def clean_cells(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


NULLS = "case when o_orderkey % 4 = 0 then ' N/A ' when o_orderkey % 4 = 1 then 'Null' when o_orderkey % 4 = 2 then '   ' else o_orderpriority end"


@query(f"select o_orderkey, case when lower(v) in ('null', 'n/a') then '' else v end as cleaned from (select o_orderkey, trim({NULLS}) as v from orders)")
def null_like_cells(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.clean(F.expr(NULLS)).alias("cleaned"))


TITLE = "list_aggregate(list_transform(string_split(v, ' '), lambda w, i: case when i > 1 and (length(w) <= 2 or lower(w) in ('the', 'of', 'and', 'for', 'with')) then lower(w) else upper(substr(w, 1, 1)) || lower(substr(w, 2)) end), 'string_agg', ' ')"


@query(f"select p_partkey, {TITLE} as capitalized from (select p_partkey, 'the ' || p_name || ' OF the world AND for p' as v from part)")
def capitalize_words(spark, sf_dir):
    v = F.concat(F.lit("the "), F.col("p_name"), F.lit(" OF the world AND for p"))
    return read(spark, sf_dir, "part").select("p_partkey", text.capitalization(v).alias("capitalized"))


@query("select c_custkey, upper(substr(v, 1, 1)) || lower(substr(v, 2)) as capitalized from (select c_custkey, lower(c_mktsegment) as v from customer)")
def capitalize_names(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", text.capitalization(F.lower("c_mktsegment")).alias("capitalized"))


@query("select o_orderkey, 'Priority of order: ' || o_orderpriority as capitalized from orders")
def capitalize_before_colon(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.capitalization(F.concat(F.lit("priority OF order: "), F.col("o_orderpriority"))).alias("capitalized"))


SENTENCES = r"list_aggregate(list_transform(string_split(regexp_replace(lower(text), '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda p: regexp_extract(p, '^\s*') || upper(substr(ltrim(p, chr(32) || chr(9) || chr(10) || chr(13)), 1, 1)) || substr(ltrim(p, chr(32) || chr(9) || chr(10) || chr(13)), 2)), 'string_agg', '')"


@query(f"select item_id, {SENTENCES} as capitalized from benchmark where length(text) > 10 and regexp_matches(text, '[.!?]')")
def sentence_case(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").where((F.length("text") > 10) & F.col("text").rlike("[.!?]"))
    return b.select("item_id", text.capitalization(F.lower("text")).alias("capitalized"))


MISSPELT = "case when p_partkey % 3 = 0 then p_name || ' DEFINATELY recieve' when p_partkey % 3 = 1 then 'Seperate ' || p_name || ' untill' else p_name end"


@query(f"select p_partkey, {oracles.spelling('v')} as corrected from (select p_partkey, {MISSPELT} as v from part)")
def spelling_fix(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.spelling(F.expr(MISSPELT)).alias("corrected"))


@query(f"select p_partkey, {oracles.spelling('v')} as corrected from (select p_partkey, {MISSPELT} as v from part)")
def spelling_chain(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.spelling_chain(F.expr(MISSPELT)).alias("corrected"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day_first, strftime(o_orderdate, '%Y-%m-%d') as year_first from orders")
def date_iso(spark, sf_dir):
    d = F.date_format("o_orderdate", "d.M.yyyy")
    y = F.date_format("o_orderdate", "yyyy/MM/dd")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.date(d, 2024).alias("day_first"), text.date(y, 2024).alias("year_first"))


@query("""select o_orderkey, case when try_strptime(v, '%d/%m/%Y') is null then v else strftime(try_strptime(v, '%d/%m/%Y'), '%Y-%m-%d') end as standardized
from (select o_orderkey, printf('%02d/%02d/%04d', 1 + o_orderkey % 31, 1 + o_orderkey % 14, 1995 + o_orderkey % 28) as v from orders)""")
def date_invalid_kept(spark, sf_dir):
    k = F.col("o_orderkey")
    v = F.format_string("%02d/%02d/%04d", 1 + k % 31, 1 + k % 14, 1995 + k % 28)
    return read(spark, sf_dir, "orders").select("o_orderkey", text.date(v, 2024).alias("standardized"))


@query("""select o_orderkey, printf('%.2f', o_totalprice) as grouped, printf('%.2f', o_totalprice) as comma,
  (1000000 + o_orderkey)::varchar as spaced from orders""")
def number_format(spark, sf_dir):
    plain = F.format_string("%.2f", "o_totalprice")
    grouped = F.regexp_replace(plain, r"(\d)(?=(\d{3})+\.)", "$1,")
    spaced = F.regexp_replace((1_000_000 + F.col("o_orderkey")).cast("string"), r"(\d)(?=(\d{3})+$)", "$1 ")
    few = F.when(F.length(plain) > 6, grouped).otherwise(plain)
    return read(spark, sf_dir, "orders").select("o_orderkey", text.number(few).alias("grouped"), text.number(F.regexp_replace(plain, r"\.", ",")).alias("comma"), text.number(spaced).alias("spaced"))


# A misspelt name, a date or a number, by key.
DAY, MONTH, YEAR = "lpad(cast(1 + p_partkey % 28 as string), 2, '0')", "'0' || cast(1 + p_partkey % 9 as string)", "cast(1990 + p_partkey % 30 as string)"
THOUSANDS, UNITS = "cast(1 + p_partkey % 999 as string)", "lpad(cast(p_partkey % 1000 as string), 3, '0')"
UNCORRECTED = f"case when p_partkey % 5 = 3 then {DAY} || '.' || {MONTH} || '.' || {YEAR} when p_partkey % 5 = 4 then '-' || {THOUSANDS} || ' ' || {UNITS} || ',50' else {MISSPELT} end"


@query(f"""select p_partkey, case when p_partkey % 5 = 3 then {YEAR} || '-' || {MONTH} || '-' || {DAY} when p_partkey % 5 = 4 then '-' || {THOUSANDS} || {UNITS} || '.50'
  else {oracles.spelling(TITLE)} end as corrected from (select p_partkey, {MISSPELT} as v from part)""")
def correct_values(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", text.correct(F.expr(UNCORRECTED), 2024).alias("corrected"))


# Tables


@query("""select table_id, row_idx, col_idx, header, value from (
  select 'part' as table_id, (row_number() over (order by p_partkey) - 1)::int as row_idx, unnest([0, 1, 2]) as col_idx, unnest(['p_name', 'p_brand', 'p_size']) as header, unnest([p_name, p_brand, p_size::varchar]) as value from part)""")
def melt_cells(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("n", F.expr("row_number() over (order by p_partkey) - 1"))
    return tables.melt(part, F.lit("part"), F.col("n"), ["p_name", "p_brand", "p_size"])


def written(lines: DataFrame, path: str | None = None) -> str:
    """A folder with a CSV file of lines(place, line), as they stand, in this order."""
    path = path or new_folder(lines.sparkSession)
    plain = {"quote": "", "sep": "\u0001", "escapeQuotes": False, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    lines.coalesce(1).sortWithinPartitions("place").select("line").write.options(**plain).csv(path)
    return path


# Quoted names with commas and quotes, cells with white space, and lines that are blank.
LINES = r'''select p_partkey * 2 as place, concat(p_partkey, ',"', p_name, ', ""', p_brand, '""",  ', p_size, ' \t') as line from {part}
union all select p_partkey * 2 + 1, case when p_partkey % 2 = 0 then ' \t ' else '\u00a0' end from {part} where p_partkey % 10 = 0'''
FIELDS = """unnest([0, 1, 2]) as col_idx, unnest([p_partkey::varchar, p_name || ', "' || p_brand || '"', p_size::varchar]) as value from (
  select *, (row_number() over (order by p_partkey) - 1)::int as row_idx from part)"""


@query(f"""select row_idx, col_idx, ['key', 'name, "brand"', 'size'][col_idx + 1] as header, value from (select row_idx, {FIELDS})""")
def load_csv(spark, sf_dir):
    """A CSV file with a header, written from 'part' and read back."""
    lines = spark.sql(LINES, part=read(spark, sf_dir, "part"))
    header = spark.sql('''select cast(-1 as bigint) as place, 'key,"name, ""brand""",size' as line''')
    return tables.read_cells(spark, written(lines.unionByName(header))).select("row_idx", "col_idx", "header", "value")


@query(f"select row_idx, col_idx, 'Column' || (col_idx + 1) as header, value from (select row_idx, {FIELDS})")
def load_csv_no_header(spark, sf_dir):
    lines = spark.sql(LINES, part=read(spark, sf_dir, "part"))
    return tables.read_cells(spark, written(lines), has_header=False).select("row_idx", "col_idx", "header", "value")


@query("""select 'part' || p_size as table_id, case when p_partkey % 3 = 1 then (p_partkey % 4)::int else (p_partkey % 10)::int end as col_idx, case when p_partkey % 2 = 0 then p_brand end as result
from part where p_partkey % 3 > 0 and p_partkey % 7 > 0""")
def cta_targets_file(spark, sf_dir):
    """Lines of column targets, some without an id or a number, written from 'part' and read back."""
    lines = spark.sql("""select p_partkey as place, concat(case when p_partkey % 7 > 0 then concat('part', p_size) else '' end, ',', case when p_partkey % 3 = 0 then 'none' when p_partkey % 3 = 1 then cast(p_partkey % 4 as string) else concat(' ', p_partkey % 10, 'th') end,
      ',', case when p_partkey % 2 = 0 then p_brand else '' end) as line from {part}""", part=read(spark, sf_dir, "part"))
    return tables.read_cta_targets(spark, written(lines)).select("table_id", "col_idx", "result")


@query("""select 'part' || p_size as table_id, p_partkey::int as row, case when p_partkey % 3 > 0 then (p_partkey % 4)::int else -1 end as col_idx, case when p_partkey % 2 = 0 then p_brand end as uri from part""")
def cea_targets_file(spark, sf_dir):
    """Lines of cell targets, some without a number (shown as -1), written from 'part' and read back."""
    lines = spark.sql("""select p_partkey as place, concat('part', p_size, ',', p_partkey, ',', case when p_partkey % 3 > 0 then cast(p_partkey % 4 as string) else 'none' end, case when p_partkey % 2 = 0 then concat(',', p_brand) else '' end) as line from {part}""", part=read(spark, sf_dir, "part"))
    return tables.read_cea_targets(spark, written(lines)).select("table_id", "row", F.coalesce("col_idx", F.lit(-1)).alias("col_idx"), "uri")


@query("""with c as (select *, max(row_idx) over (partition by table_id) + 1 as n from ("""
    + oracles.STEPS["cells"]
    + """)) select table_id, row_idx, col_idx, header, value from c where 70 >= n or row_idx = n - 1 or (row_idx % floor(n / 70) = 0 and floor(row_idx / floor(n / 70)) <= 68)""")
def sample_rows(spark, sf_dir):
    return tables.sample_rows(fixtures.cells(spark, sf_dir), 70)


# Search


@query(f"select a.n_name as a, b.p_name as b, round({oracles.similarity('a.n_name', 'b.p_name')}, 9) as similarity from nation a cross join (select distinct p_name from part) b")
def char_jaccard(spark, sf_dir):
    a, b = read(spark, sf_dir, "nation").select(F.col("n_name").alias("a")), read(spark, sf_dir, "part").select(F.col("p_name").alias("b")).distinct()
    return a.crossJoin(F.broadcast(b)).select("a", "b", F.round(similarity.characters(F.col("a"), F.col("b")), 9).alias("similarity"))


@query(oracles.chain("select value, source, uri, place, round(raw, 6) as confidence from found"))
def search_confidence(spark, sf_dir):
    return Steps(spark, sf_dir).hits.select("value", "source", "uri", F.col("place").cast("long").alias("place"), F.round("raw", 6).alias("confidence"))


@query(oracles.chain("select value, uri, label, round(raw, 6) as raw, place from deduped"))
def dedupe_uri(spark, sf_dir):
    return search.dedupe(Steps(spark, sf_dir).hits).select("value", "uri", "label", F.round("raw", 6).alias("raw"), F.col("place").cast("long").alias("place"))


@query(oracles.chain("select value, uri, round(confidence, 6) as confidence from boosted"))
def exact_boost(spark, sf_dir):
    x = search.ranked(search.dedupe(Steps(spark, sf_dir).hits), CONFIG, top=False)
    return x.select("value", "uri", F.round("confidence", 6).alias("confidence"))


@query(oracles.chain("select value, rank, source, uri, round(confidence, 6) as confidence from top"))
def candidates_topk(spark, sf_dir):
    return Steps(spark, sf_dir).top.select("value", F.col("rank").cast("long").alias("rank"), "source", "uri", F.round("confidence", 6).alias("confidence"))


@query(oracles.chain("select value, uri, type_source, ord, type_uri from crossed"))
def cross_source_types(spark, sf_dir):
    s = Steps(spark, sf_dir)
    return search.cross_types(s.top, s.kb, CONFIG).select("value", "uri", "type_source", "ord", "type_uri")


@query(oracles.chain("select c.table_id, c.col_idx, c.row_idx, c.rank, c.uri, (select string_agg(type_uri, ' ' order by ord) from hit_types h where h.value = c.value and h.uri = c.uri) as types from candidates c"))
def typed_candidates(spark, sf_dir):
    return Steps(spark, sf_dir).candidates.select("table_id", "col_idx", "row_idx", F.col("rank").cast("long").alias("rank"), "uri", F.array_join("types.uri", " ").alias("types"))


# Cells


@query(oracles.chain("select table_id, row_idx, col_idx, rank, uri, round(confidence, 6) as confidence from candidates where source <> 'DBpedia'"))
def cea_all(spark, sf_dir):
    return selection.cell_entities(Steps(spark, sf_dir).candidates).select("table_id", "row_idx", "col_idx", F.col("rank").cast("long").alias("rank"), "uri", F.round("confidence", 6).alias("confidence"))



@query(oracles.chain("select table_id, row_idx, col_idx, uri, round(confidence, 6) as confidence from (select table_id, row_idx, col_idx, arg_min(uri, rank) as uri, arg_min(confidence, rank) as confidence from candidates where source <> 'DBpedia' group by table_id, row_idx, col_idx)"))
def cea_best(spark, sf_dir):
    return selection.best_entity(Steps(spark, sf_dir).candidates).select("table_id", "row_idx", "col_idx", "uri", F.round("confidence", 6).alias("confidence"))


CEA_TARGETS = """select target_no, table_id, cast(1 + j % n as int) as row, cast(floor(j / n) % 3 as int) as col_idx, 'old' as uri from (
  select o_orderkey as target_no, case when o_orderkey % 5 = 0 then 'missing' else 'customers' end as table_id, o_orderkey - cast(floor(o_orderkey / 5) as bigint) as j, (select count(*) from {customer}) as n from {orders}) o"""


@query(oracles.chain(f"""select t.target_no, t.table_id, t.row, t.col_idx, case when t.table_id = 'missing' then t.uri else coalesce(b.uri, '') end as uri from ({CEA_TARGETS.format(orders="orders", customer="customer")}) t
left join (select table_id, row_idx, col_idx, arg_min(uri, rank) as uri from candidates where source <> 'DBpedia' group by table_id, row_idx, col_idx) b on b.table_id = t.table_id and b.row_idx + 1 = t.row and b.col_idx = t.col_idx"""))
def cea_targets_left_join(spark, sf_dir):
    """Targets for every row and column of 'customers', and for a table that is not there."""
    s = Steps(spark, sf_dir)
    targets = spark.sql(CEA_TARGETS, orders=read(spark, sf_dir, "orders"), customer=read(spark, sf_dir, "customer"))
    return selection.fill_cea_targets(targets, selection.best_entity(s.candidates), s.cells).select("target_no", "table_id", "row", "col_idx", "uri")


# Types


@query(oracles.chain("select t.type_uri, m.dbpedia_type, m.wikidata_type from (select distinct type_uri from kb_types) t join mapping m on m.dbpedia_type = t.type_uri or m.wikidata_type = t.type_uri"))
def equivalent_types(spark, sf_dir):
    s = Steps(spark, sf_dir)
    return mapping.equivalent_types(s.kb.types.select("type_uri").distinct(), s.mapping).select("type_uri", "dbpedia_type", "wikidata_type")


@query(oracles.chain("select t.type_uri, m.wikidata_type, m.confidence::double as mapping_confidence from (select distinct type_uri from kb_types where source = 'DBpedia') t join mapping m on m.dbpedia_type = t.type_uri"))
def map_types(spark, sf_dir):
    s = Steps(spark, sf_dir)
    return mapping.to_wikidata(s.kb.types.where("source = 'DBpedia'").select("type_uri").distinct(), s.mapping).select("type_uri", "wikidata_type", "mapping_confidence")


@query(oracles.chain("select c.table_id, c.col_idx, c.row_idx, c.rank, round(c.score, 6) as score, (select string_agg(type_uri, ' ' order by ord) from all_types h where h.value = c.value and h.uri = c.uri) as types from mapped c"))
def map_boost(spark, sf_dir):
    return Steps(spark, sf_dir).mapped.select("table_id", "col_idx", "row_idx", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.array_join("types.uri", " ").alias("types"))


@query(oracles.chain("select table_id, col_idx, row_idx, rank, round(score, 6) as score from scored"))
def uri_boost(spark, sf_dir):
    return Steps(spark, sf_dir).scored.select("table_id", "col_idx", "row_idx", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


LAST_PART = "coalesce(nullif(regexp_extract(lower(url), '[^/#]*$'), ''), lower(url))"


@query(f"select page_id, contains({oracles.NORM.format(LAST_PART)}, {oracles.NORM.format('page_id::varchar')}) as held, {oracles.NORM.format(LAST_PART)} as part from pages")
def uri_contains(spark, sf_dir):
    """A URL that ends in a slash or hash counts whole."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", uri.contains_value(F.col("url"), F.col("page_id").cast("string")).alias("held"), text.matching_form(text.last_part(F.lower("url"))).alias("part"))


@query(oracles.chain(f"select distinct type_uri, {oracles.label('type_uri')} as label from kb_types where source = 'DBpedia'"))
def uri_labels(spark, sf_dir):
    return Steps(spark, sf_dir).kb.types.where("source = 'DBpedia'").select("type_uri", text.uri_label(F.col("type_uri")).alias("label")).distinct()


@query(oracles.chain("select source_type, target_type, relation, confidence, ord, direct from relations"))
def inverse_relations(spark, sf_dir):
    return seeds.type_relations(spark)


@query(oracles.chain("select table_id, col_idx, type_uri, round(frequency, 6) as frequency, n, type_rank from freqs"))
def column_type_freq(spark, sf_dir):
    return relations.type_frequencies(Steps(spark, sf_dir).mapped).select("table_id", "col_idx", "type_uri", F.round("frequency", 6).alias("frequency"), "n", F.col("type_rank").cast("long").alias("type_rank"))


@query(oracles.chain("select table_id, source_column, target_column, relation, round(confidence, 6) as confidence from related"))
def column_relations(spark, sf_dir):
    return Steps(spark, sf_dir).related.select("table_id", "source_column", "target_column", "relation", F.round("confidence", 6).alias("confidence"))


@query(oracles.chain("select table_id, source_column, target_column, relation, place from top_related"))
def relation_topk(spark, sf_dir):
    return relations.top_relations(Steps(spark, sf_dir).related, CONFIG).select("table_id", "source_column", "target_column", "relation", F.col("place").cast("long").alias("place"))


@query(oracles.chain("""select a.table_id, a.col_idx as source_column, b.col_idx as target_column, round(count(*) / (any_value(n.n) + any_value(m.n) - count(*)), 6) as overlap
from (select distinct table_id, row_idx, col_idx from mapped) a join (select distinct table_id, row_idx, col_idx from mapped) b on a.table_id = b.table_id and a.row_idx = b.row_idx and a.col_idx <> b.col_idx
join (select table_id, col_idx, count(distinct row_idx) as n from mapped group by all) n on n.table_id = a.table_id and n.col_idx = a.col_idx
join (select table_id, col_idx, count(distinct row_idx) as n from mapped group by all) m on m.table_id = b.table_id and m.col_idx = b.col_idx group by 1, 2, 3"""))
def row_overlap(spark, sf_dir):
    return relations.row_overlap(Steps(spark, sf_dir).mapped).withColumn("overlap", F.round("overlap", 6))


@query(oracles.chain("select table_id, col_idx, uri, row_idx, rank, round(score, 6) as score from entities"))
def best_entity_per_column(spark, sf_dir):
    return column_types.best_entities(Steps(spark, sf_dir).scored).select("table_id", "col_idx", "uri", "row_idx", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(oracles.chain("select table_id, col_idx, type_uri, label, source, round(score, 6) as score, entity_matches, round(confidence, 6) as confidence from votes"))
def type_votes(spark, sf_dir):
    return Steps(spark, sf_dir).votes.select("table_id", "col_idx", "type_uri", "label", "source", F.round("score", 6).alias("score"), F.col("entity_matches").cast("long").alias("entity_matches"), F.round("confidence", 6).alias("confidence"))


@query(oracles.chain("select table_id, col_idx, type_uri, kind, count(*) as n, round(sum(score), 6) as score from events group by all"))
def parent_types(spark, sf_dir):
    s = Steps(spark, sf_dir)
    events = column_types.type_events(column_types.best_entities(s.scored), s.kb.parents, CONFIG)
    return events.groupBy("table_id", "col_idx", "type_uri", "kind").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


@query(oracles.chain("select table_id, col_idx, place, type_uri, round(confidence, 6) as confidence from led"))
def leading_types(spark, sf_dir):
    return Steps(spark, sf_dir).leading.select("table_id", "col_idx", F.col("place").cast("long").alias("place"), "type_uri", F.round("confidence", 6).alias("confidence"))


@query(oracles.chain("select table_id, col_idx, nth as place, type_uri, label, round(confidence, 6) as confidence from preferred"))
def prefer_wikidata(spark, sf_dir):
    return Steps(spark, sf_dir).preferred.select("table_id", "col_idx", F.col("place").cast("long").alias("place"), "type_uri", "label", F.round("confidence", 6).alias("confidence"))


@query(oracles.chain("""select table_id, col_idx, arg_min(type_uri, nth) as type_uri, arg_min(label, nth) as label, round(arg_min(confidence, nth), 6) as confidence,
coalesce(string_agg(case when nth > 1 then type_uri end, ' ' order by nth), '') as alternatives from preferred group by table_id, col_idx"""))
def cta_final(spark, sf_dir):
    return selection.assign_types(Steps(spark, sf_dir).preferred).select("table_id", "col_idx", "type_uri", "label", F.round("confidence", 6).alias("confidence"), F.array_join("alternatives.uri", " ").alias("alternatives"))


@query(oracles.chain("""select table_id, col_idx, arg_min(label, nth) || ' - ' || cast(floor(arg_min(confidence, nth) * 100 + 0.5) as int) || '% - ' || arg_min(type_uri, nth) as type,
coalesce(string_agg(case when nth between 2 and 4 then label || ' - ' || cast(floor(confidence * 100 + 0.5) as int) || '%' end, ', ' order by nth), '') as alternatives from preferred group by table_id, col_idx"""))
def cta_report(spark, sf_dir):
    """What single-table mode shows: label, percent and URI, and up to three alternatives."""
    return selection.report(selection.assign_types(Steps(spark, sf_dir).preferred)).select("table_id", "col_idx", "type", "alternatives")


@query("""select p_partkey, case when p_partkey % 4 = 0 then p_name when p_partkey % 4 = 1 then 'http://r/' || p_partkey when p_partkey % 4 = 2 then 'Q' || p_partkey else 'Unknown' end as label from part""")
def result_labels(spark, sf_dir):
    """A search result's label: its name, else its resource, else its id, else Unknown."""
    k = F.col("p_partkey") % 4
    name, resource = F.when(k == 0, F.col("p_name")).when(k == 1, F.lit("")), F.when(k < 2, F.concat(F.lit("http://r/"), "p_partkey"))
    entity = F.when(k == 2, F.concat(F.lit("Q"), "p_partkey"))
    return read(spark, sf_dir, "part").select("p_partkey", service.labelled(name, resource, entity).alias("label"))


CTA_TARGETS = """select p_partkey as target_no, case when p_partkey % 4 = 0 then 'missing' when p_partkey % 4 = 1 then 'nations' when p_partkey % 4 = 2 then 'segments' else 'parts' end as table_id, cast(p_partkey % 3 as int) as col_idx, 'old' as result from {part}"""


@query(oracles.chain(f"""select t.target_no, t.table_id, t.col_idx, coalesce(p.type_uri, t.result) as result from ({CTA_TARGETS.replace("{part}", "part")}) t
left join (select * from preferred where nth = 1) p on p.table_id = t.table_id and p.col_idx = t.col_idx"""))
def cta_targets_left_join(spark, sf_dir):
    targets = spark.sql(CTA_TARGETS, part=read(spark, sf_dir, "part"))
    return selection.fill_cta_targets(targets, selection.assign_types(Steps(spark, sf_dir).preferred)).select("target_no", "table_id", "col_idx", "result")


@query(oracles.chain("""select p.table_id, p.col_idx, p.type_uri, round(least(1.0::double, p.confidence + 0.2::double * coalesce((select sum(t.confidence) from top_related t
  join preferred o on o.table_id = t.table_id and o.nth = 1 and o.col_idx = case when t.source_column = p.col_idx then t.target_column else t.source_column end
  where t.table_id = p.table_id and p.col_idx in (t.source_column, t.target_column)
    and (not exists (select 1 from relations r where r.direct and r.relation = t.relation)
      or exists (select 1 from relations r where r.direct and r.relation = t.relation
        and ((t.source_column = p.col_idx and r.source_type = p.type_uri and r.target_type = o.type_uri)
          or (t.target_column = p.col_idx and r.target_type = p.type_uri and r.source_type = o.type_uri))))), 0)), 6) as confidence from preferred p"""))
def relation_boost(spark, sf_dir):
    s = Steps(spark, sf_dir)
    top = relations.top_relations(s.related, CONFIG)
    return column_types.relation_boost(s.preferred, top, s.relations, CONFIG).select("table_id", "col_idx", "type_uri", F.round("confidence", 6).alias("confidence"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
