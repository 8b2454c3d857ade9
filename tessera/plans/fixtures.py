"""A small knowledge base and tables derived from the driver's tables, in SQL that Spark and DuckDB share.

{name} stands for a table.  Nations, market segments and part names are values of two tables and
entities of both vocabularies; some entities lack types, so that every branch of the search is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.kb import KnowledgeBase

CELLS = """
select 'customers' as table_id, cast(row_number() over (order by c_custkey) - 1 as int) as row_idx, 0 as col_idx, 'nation' as header, n_name as value
from {customer} join {nation} on c_nationkey = n_nationkey
union all
select 'customers', cast(row_number() over (order by c_custkey) - 1 as int), 1, 'segment', c_mktsegment
from {customer}
union all
select 'parts', cast(row_number() over (order by p_partkey) - 1 as int), 0, 'name', p_name from {part}
union all
select 'nations', cast(n_nationkey as int), 0, 'nation', n_name from {nation}
union all
select 'segments', cast(row_number() over (order by c_mktsegment) - 1 as int), 0, 'city', c_mktsegment from (select distinct c_mktsegment from {customer}) s
union all
select 'segments', cast(row_number() over (order by c_mktsegment) - 1 as int), 1, 'country', 'NATION_' || row_number() over (order by c_mktsegment) from (select distinct c_mktsegment from {customer}) t
"""

SEARCH = """
select 'DBpedia' as source, a.n_name as query, p.pos, 2 as n_results, 'http://dbpedia.org/resource/' || b.n_name as uri, b.n_name as label
from {nation} a cross join (select 0 as pos union all select 1) p join {nation} b on b.n_nationkey = (a.n_nationkey + p.pos) % 25
union all
select 'Wikidata', a.n_name, p.pos, 2, 'http://www.wikidata.org/entity/Q' || (1000 + b.n_nationkey), b.n_name
from {nation} a cross join (select 0 as pos union all select 1) p join {nation} b on b.n_nationkey = (a.n_nationkey + 3 * p.pos) % 25
union all
select distinct 'DBpedia', c_mktsegment, 0, 1, 'http://dbpedia.org/resource/' || c_mktsegment || '_NATION_3', lower(c_mktsegment) from {customer}
union all
select distinct 'Wikidata', c_mktsegment, 0, 3, 'http://www.wikidata.org/entity/Q' || (2000 + length(c_mktsegment)), 'the ' || c_mktsegment from {customer}
union all
select distinct 'DBpedia', p_name, 0, 2, 'http://dbpedia.org/resource/' || replace(p_name, ' ', '_'), p_name from {part}
union all
select distinct 'Wikidata', p_name, 1, 2, 'http://www.wikidata.org/entity/Q' || (3000 + length(p_name)), 'item ' || substr(p_name, 1, 3) from {part}
union all
select distinct 'Wikidata', p_name, 0, 2, 'http://www.wikidata.org/entity/Q' || (4000 + length(p_name)), 'no ' || substr(p_name, 2, 2) from {part}
"""

TYPES = """
select distinct 'DBpedia' as source, 'http://dbpedia.org/resource/' || n_name as entity_uri, o.ord, 'http://dbpedia.org/ontology/' || o.t as type_uri, o.t as type_label
from {nation} cross join (select 0 as ord, 'Country' as t union all select 1, 'Place') o
union all
select 'Wikidata', 'http://www.wikidata.org/entity/Q' || (1000 + n_nationkey), 0, 'http://www.wikidata.org/entity/Q6256', 'country' from {nation} where n_nationkey % 2 = 0
union all
select distinct 'DBpedia', 'http://dbpedia.org/resource/' || c_mktsegment || '_NATION_3', 0, 'http://dbpedia.org/ontology/City', 'City' from {customer}
union all
select distinct 'Wikidata', 'http://www.wikidata.org/entity/Q' || (2000 + length(c_mktsegment)), 0, 'http://www.wikidata.org/entity/Q515', 'city' from {customer}
union all
select distinct 'DBpedia', 'http://dbpedia.org/resource/' || replace(p_name, ' ', '_'), 0, 'http://dbpedia.org/ontology/' || case when length(p_name) % 2 = 0 then 'Automobile' else 'Food' end, 'thing' from {part}
union all
select distinct 'Wikidata', 'http://www.wikidata.org/entity/Q' || (4000 + length(p_name)), 0, 'http://www.wikidata.org/entity/Q1420', 'car' from {part} where length(p_name) % 3 > 0
"""

PARENTS = """
select 'DBpedia' as source, 'http://dbpedia.org/ontology/Country' as type_uri, 0 as ord, 'http://dbpedia.org/ontology/PopulatedPlace' as parent_uri
union all select 'DBpedia', 'http://dbpedia.org/ontology/City', 0, 'http://dbpedia.org/ontology/Settlement'
union all select 'DBpedia', 'http://dbpedia.org/ontology/City', 1, 'http://dbpedia.org/ontology/Place'
union all select 'DBpedia', 'http://dbpedia.org/ontology/Automobile', 0, 'http://dbpedia.org/ontology/Vehicle'
union all select 'Wikidata', 'http://www.wikidata.org/entity/Q6256', 0, 'http://www.wikidata.org/entity/Q2221906'
union all select 'Wikidata', 'http://www.wikidata.org/entity/Q515', 0, 'http://www.wikidata.org/entity/Q486972'
"""

TABLES = ("nation", "customer", "part")


def _run(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return spark.sql(query, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in query})


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, CELLS)


def knowledge_base(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    return KnowledgeBase(_run(spark, sf_dir, SEARCH), _run(spark, sf_dir, TYPES), _run(spark, sf_dir, PARENTS))
