"""DuckDB SQL of the queries that SQL can express.  Windows and sets are compared as strings or MD5 of them."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1(size: int, percent: int) -> str:
    return rf"""
with recursive w as materialized (select doc_id, {WORDS.format(LOWER.format("text"))} as w from documents),
s as materialized (
  select distinct doc_id, md5(array_to_string(w[i:i + {size - 1}], ' ')) as s
  from (select doc_id, w, unnest(case when len(w) = 0 then [] when len(w) < {size} then [1] else range(1, len(w) - {size - 2}) end) as i from w)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
link as materialized (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by all)
  join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= {percent} * (p.n + q.n - c)),
reach(a, b) as (select doc_id, doc_id from w union select r.a, l.b from reach r join link l on l.a = r.b)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id
from w left join n on n.doc_id = w.doc_id join (select a, min(b) as component_id from reach group by a) m on m.a = w.doc_id"""


OP2 = rf"""
with w as materialized (select doc_id, coalesce(text, '') as text, {WORDS.format("text")} as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i:i + 7], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from w)),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, h) as c from windows) where c > 1),
covered as (select doc_id, count(distinct i + k) as n from again cross join range(8) t(k) group by doc_id),
m as (
  select w.doc_id, len(w.w)::bigint as n_words, length(array_to_string(w.w, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    coalesce(c.n, 0)::bigint as n_repeat_words,
    length(regexp_replace(text, '\P{{L}}+', '', 'g')) as letters, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) as capitals,
    length(regexp_replace(text, '[^!]+', '', 'g')) as bangs,
    len(list_filter(range(2, len(w.w) + 1), lambda i: w.w[i] = w.w[i - 1])) as stutters
  from w left join covered c on c.doc_id = w.doc_id),
b as (select *, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > n_words or word_chars < 2 * n_words or word_chars > 15 * n_words or 2 * n_dup_lines > len(lines)
    or 10 * letters < 6 * word_chars or 2 * capitals > letters or 5 * bangs > n_words or 10 * stutters > 3 * n_words) as kept
from b"""

OP3 = """
with v as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select query_id, rank, vec_id, score from (
  select query_id, vec_id, score, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank
  from (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0))
where rank <= 10"""


def op6(window: int) -> str:
    return rf"""
with w as materialized (select doc_id, {WORDS.format("text")} as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - {window - 2})) as i from w)),
again as (select doc_id, i from (select *, count(*) over (partition by h) as c from windows) where c > 1),
gone as (select distinct doc_id, i + k as i from again cross join range({window}) t(k)),
kept as (
  select p.doc_id, count(*) as n, string_agg(p.x, ' ' order by p.i) as text
  from (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from w) p left join gone g on g.doc_id = p.doc_id and g.i = p.i where g.i is null group by p.doc_id)
select w.doc_id, len(w.w)::bigint as n_words, (len(w.w) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from w left join kept k on k.doc_id = w.doc_id"""


def op7(window: int) -> str:
    return rf"""
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
windows as (select doc_id, i, md5(substr(x, 2 * i + 1, {2 * window})) as h from (select doc_id, x, unnest(range(0, len(x) // 2 - {window - 1})) as i from d)),
later as (select doc_id, i from (select *, min(doc_id) over (partition by h) as first from windows) where first < doc_id),
starts as (select doc_id, i, lag(i) over (partition by doc_id order by i) as prev from later),
runs as (select doc_id, min(i) as a, max(i) + {window} as b from (select doc_id, i, sum(case when prev is null or i > prev + {window} then 1 else 0 end) over (partition by doc_id order by i) as run from starts) group by doc_id, run),
r as (select doc_id, count(*) as n, sum(b - a) as removed, list(a order by a) as a, list(b order by a) as b from runs group by doc_id)
select d.doc_id, (len(x) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans,
  sha256(unhex(case when n is null then x else array_to_string(list_transform(range(1, n + 2), lambda i:
    substr(x, 2 * (case when i = 1 then 0 else b[i - 1] end) + 1, 2 * ((case when i = n + 1 then len(x) // 2 else a[i] end) - (case when i = 1 then 0 else b[i - 1] end)))), '') end)) as kept_sha256
from d left join r on r.doc_id = d.doc_id"""
