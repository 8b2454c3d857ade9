"""DuckDB SQL for the catalog's queries, built from shared steps."""

from __future__ import annotations

from ..functions import seeds
from ..functions.text import SPELLING
from . import fixtures


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _mapping() -> str:
    rows = [x.split() for x in seeds.TYPE_MAPPING.strip().splitlines()]
    return f"select * from (values {_values((seeds.DBPEDIA + a, seeds.WIKIDATA + b, float(c), i) for i, (a, b, c) in enumerate(rows))}) t(dbpedia_type, wikidata_type, confidence, ord)"


def _relations() -> str:
    rows = [x.split() for x in seeds.TYPE_RELATIONS.strip().splitlines()]
    direct = _values((seeds.uri(a), seeds.uri(b), c, float(d), i) for i, (a, b, c, d) in enumerate(rows))
    return f"""
select s as source_type, t as target_type, r as relation, c::double as confidence, o as ord, true as direct from (values {direct}) x(s, t, r, c, o)
union all
select t, s, case when r like 'has%' then 'is' || substr(r, 4) || 'Of' when r like 'is%Of' then 'has' || substr(r, 3, length(r) - 4) else r || 'Inverse' end,
  round(c::double * 0.8::double, 2), o + {len(rows)}, false from (values {direct}) x(s, t, r, c, o)"""


def similarity(a: str, b: str) -> str:
    x, y = f"list_distinct(string_split({a}, ''))", f"list_distinct(string_split({b}, ''))"
    return f"(case when {a} = {b} then 1.0::double when {a} = '' or {b} = '' then 0.0::double else len(list_intersect({x}, {y}))::double / len(list_distinct(list_concat({x}, {y}))) end)"


def label(u: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_extract({u}, '[^/#]*$'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')"


NORM = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
PART = NORM.format("regexp_extract(lower({0}), '[^/#]*$')")
FIRST = "case when source = 'DBpedia' then 0 else 1 end"

STEPS = {
    "cells": fixtures.CELLS.replace("{", "").replace("}", ""),
    "kb_search": fixtures.SEARCH.replace("{", "").replace("}", ""),
    "kb_types": fixtures.TYPES.replace("{", "").replace("}", ""),
    "kb_parents": fixtures.PARENTS.replace("{", "").replace("}", ""),
    "mapping": _mapping(),
    "relations": _relations(),
    "vals": "select distinct value from cells where trim(value) <> '' and value not in ('0', '-')",
    "found": f"""select value, source, uri, label,
  round(0.7::double * {similarity("lower(value)", "lower(label)")} + 0.3::double * (1 - pos::double / greatest(n_results, 1)), 12) as raw,
  row_number() over (partition by value order by {FIRST}, pos, uri) as place from vals join kb_search on value = query""",
    "deduped": "select value, uri, arg_max(source, (raw, -place)) as source, arg_max(label, (raw, -place)) as label, max(raw) as raw, min(place) as place from found group by value, uri",
    "boosted": "select *, round(least(1.0::double, raw + case when lower(label) = lower(value) then 0.2::double else 0.0::double end), 12) as confidence from deduped",
    "ranks": "select *, row_number() over (partition by value order by confidence desc, raw desc, place) as rank from boosted where confidence >= 0.3",
    "top": "select * from ranks where rank <= 3",
    "own_types": "select t.value, t.uri, k.source as type_source, 0 as way, k.ord, k.type_uri, k.type_label from top t join kb_types k on k.source = t.source and k.entity_uri = t.uri",
    "needy": """select value, uri, case when source = 'DBpedia' then replace(regexp_extract(uri, '[^/]*$'), '_', ' ') else label end as name,
  case when source = 'DBpedia' then 'Wikidata' else 'DBpedia' end as type_source from top t
  where confidence < 0.7 or not exists (select 1 from kb_types k where k.source = t.source and k.entity_uri = t.uri)""",
    "crossed": """select n.value, n.uri, n.type_source, 1 as way, k.ord, k.type_uri, k.type_label from needy n
  join kb_search s on s.pos = 0 and s.source = n.type_source and s.query = n.name join kb_types k on k.source = n.type_source and k.entity_uri = s.uri""",
    "hit_types": """select value, uri, type_source, type_uri, type_label,
  row_number() over (partition by value, uri order by case when type_source = 'DBpedia' then 0 else 1 end, way, ord, type_uri, type_label) - 1 as ord
  from (select * from own_types union all select * from crossed)""",
    "candidates": """select c.table_id, c.col_idx, c.row_idx, t.rank, c.header, c.value, t.source, t.uri, t.label, t.confidence, t.confidence as score
  from cells c join top t on t.value = c.value where exists (select 1 from hit_types h where h.value = t.value and h.uri = t.uri)""",
    "boosts": """select value, uri, least(0.3::double, round(sum(paid), 12)) as boost from (
  select h.value, h.uri, m.confidence::double * 0.1::double as paid from hit_types h join mapping m on m.dbpedia_type = h.type_uri where h.type_source = 'DBpedia'
  union all
  select h.value, h.uri, m.confidence::double * 0.1::double from hit_types h join mapping m on m.wikidata_type = h.type_uri where h.type_source = 'Wikidata'
    and exists (select 1 from hit_types g where g.value = h.value and g.uri = h.uri and g.type_uri = m.dbpedia_type)) group by value, uri""",
    "new_types": """select value, uri, 'Wikidata' as type_source, wikidata_type as type_uri, 'Wikidata Type ' || regexp_extract(wikidata_type, '[^/]*$') as type_label,
  1000 + row_number() over (partition by value, uri order by first) as ord from (
  select h.value, h.uri, m.wikidata_type, min((h.ord, m.ord)) as first from hit_types h join mapping m on m.dbpedia_type = h.type_uri
  where h.type_source = 'DBpedia' and not exists (select 1 from hit_types g where g.value = h.value and g.uri = h.uri and g.type_uri = m.wikidata_type)
  group by h.value, h.uri, m.wikidata_type)""",
    "all_types": "select * from hit_types union all select * from new_types",
    "mapped": "select c.* exclude (score), round(least(1.0::double, c.score + coalesce(b.boost, 0.0::double)), 12) as score from candidates c left join boosts b on b.value = c.value and b.uri = c.uri",
    "evidence": f"""select table_id, col_idx, row_idx, rank, count(*) as n from (
  select c.table_id, c.col_idx, c.row_idx, c.rank, row_number() over (partition by c.table_id, c.luri, c.row_idx, o.v order by c.col_idx, c.rank) as claim
  from (select *, lower(uri) as luri, {PART.format("uri")} as part from mapped) c
  join (select distinct table_id, row_idx, col_idx as other, {NORM.format("value")} as v from mapped where length(value) >= 3) o
    on o.table_id = c.table_id and o.row_idx = c.row_idx and o.other <> c.col_idx and o.v <> '' and contains(c.part, o.v)
  group by c.table_id, c.luri, c.col_idx, c.row_idx, c.rank, o.v) where claim = 1 group by all""",
    "scored": """select m.* exclude (score), round(least(1.0::double, m.score + 0.2::double * coalesce(e.n, 0)), 12) as score from mapped m
  left join evidence e on e.table_id = m.table_id and e.col_idx = m.col_idx and e.row_idx = m.row_idx and e.rank = m.rank""",
    "sizes": "select table_id, col_idx, count(*) as n from mapped group by all",
    "freqs": """select f.*, s.n, row_number() over (partition by f.table_id, f.col_idx order by frequency desc, first) as type_rank from (
  select m.table_id, m.col_idx, t.type_uri, round(sum(m.score), 9) as frequency, min((m.row_idx, m.rank, t.ord)) as first
  from mapped m join all_types t on t.value = m.value and t.uri = m.uri group by m.table_id, m.col_idx, t.type_uri) f join sizes s on s.table_id = f.table_id and s.col_idx = f.col_idx""",
    "related": """select * from (select a.table_id, a.col_idx as source_column, b.col_idx as target_column, r.relation,
  round(r.confidence * (a.frequency / a.n) * (b.frequency / b.n), 9) as confidence, a.type_rank as source_rank, b.type_rank as target_rank, r.ord
  from freqs a join relations r on r.source_type = a.type_uri join freqs b on b.table_id = a.table_id and b.type_uri = r.target_type and b.col_idx <> a.col_idx) where confidence >= 0.3""",
    "top_related": """select * from (select *, row_number() over (partition by table_id, source_column order by confidence desc, target_column, source_rank, target_rank, ord) as place from related) where place <= 3""",
    "entities": """select * from (select *, row_number() over (partition by table_id, col_idx, uri order by score desc, row_idx, rank) as nth,
  min((row_idx, rank)) over (partition by table_id, col_idx, uri) as first from scored) where nth = 1""",
    "events": f"""select e.table_id, e.col_idx, t.type_uri, t.type_label as label, t.type_source as source, 'direct' as kind, e.score, (e.first, t.ord, 0, 0) as seq
  from entities e join all_types t on t.value = e.value and t.uri = e.uri
  union all
  select e.table_id, e.col_idx, p.parent_uri, {label("p.parent_uri")}, p.source, 'parent', e.score * 0.7::double, (e.first, t.ord, 1, p.ord)
  from entities e join all_types t on t.value = e.value and t.uri = e.uri join kb_parents p on p.type_uri = t.type_uri and p.source = t.type_source""",
    "votes": """select v.table_id, v.col_idx, type_uri, label, source, round(direct + case when kind = 'parent' then first_score else 0.0::double end, 9) as score,
  matches + case when kind = 'parent' then 1 else 0 end as entity_matches, seq, round(round(direct + case when kind = 'parent' then first_score else 0.0::double end, 9) / s.n, 9) as confidence from (
  select table_id, col_idx, type_uri, arg_min(label, seq) as label, arg_min(source, seq) as source, arg_min(kind, seq) as kind, arg_min(score, seq) as first_score, min(seq) as seq,
    sum(case when kind = 'direct' then score else 0.0::double end) as direct, count(case when kind = 'direct' then 1 end) as matches from events group by table_id, col_idx, type_uri) v
  join sizes s on s.table_id = v.table_id and s.col_idx = v.col_idx""",
    "led": "select * from (select *, row_number() over (partition by table_id, col_idx order by score desc, seq) as place from votes where confidence >= 0.2) where place <= 5",
    "own_wikidata": "select table_id, col_idx, place, type_uri, label, source, score, entity_matches, round(least(1.0::double, confidence + least(0.3::double, 0.2::double * confidence + 0.1::double)), 9) as confidence, 0 as block, 0 as sub from led where source = 'Wikidata'",
    "made": """select table_id, col_idx, place, type_uri, label, source, score, entity_matches, confidence, 1 as block, sub from (
  select l.table_id, l.col_idx, l.place, m.wikidata_type as type_uri, 'Wikidata Type ' || regexp_extract(m.wikidata_type, '[^/]*$') as label, 'Wikidata' as source, l.score, l.entity_matches, l.confidence, m.ord as sub,
    row_number() over (partition by l.table_id, l.col_idx, m.wikidata_type order by l.place, m.ord) as nth
  from led l join mapping m on m.dbpedia_type = l.type_uri where l.source = 'DBpedia'
    and not exists (select 1 from own_wikidata o where o.table_id = l.table_id and o.col_idx = l.col_idx and o.type_uri = m.wikidata_type)) where nth = 1""",
    "chosen": "select * from own_wikidata union all select * from made",
    "preferred": """select * from (select *, row_number() over (partition by table_id, col_idx order by case when block = 2 then 0.0::double else -confidence end, block, place, sub) as nth from (
  select * from chosen union all
  select table_id, col_idx, place, type_uri, label, source, score, entity_matches, confidence, 2, 0 from led l
  where not exists (select 1 from chosen c where c.table_id = l.table_id and c.col_idx = l.col_idx))) where nth <= 5""",
}


def chain(final: str) -> str:
    return "with " + ",\n".join(f"{name} as materialized ({body})" for name, body in STEPS.items()) + "\n" + final


def spelling(v: str) -> str:
    for wrong, right in SPELLING.items():
        for a, b, flags in ((wrong.upper(), right.upper(), "g"), (wrong.capitalize(), right[0].upper() + right[1:], "g"), (wrong, right, "gi")):
            v = f"regexp_replace({v}, '{a}', '{b}', '{flags}')"
    return v
