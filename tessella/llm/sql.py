"""DuckDB SQL for the queries that SQL can express at the size of the SQL check.

Line dedup and suffix dedup are tested against brute-force versions instead, mixing against plain targets, LM
scoring against its own model, and licences, HTML extraction and sharding by examples and invariants: they train
a model, draw lots, parse, or compare all strings of 200 bytes.
"""

from __future__ import annotations

from . import quality

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

JACCARD = f"""
with recursive w as (select doc_id, regexp_extract_all({FOLD}, '{SPACED}') as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, len(s) as n from s),
t as (select doc_id, unnest(s) as t from s),
r as (select t from t group by t having count(*) > 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from (select * from t semi join r using (t)) a join (select * from t semi join r using (t)) b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
u as (select a as f, b as g from e union all select b, a from e),
c(doc_id, root) as (select doc_id, doc_id from n union select u.g, c.root from c join u on u.f = c.doc_id where c.root < u.g)
select n.doc_id as doc_id, n.n as n_shingles, min(c.root) as component_id from n join c using (doc_id) group by 1, 2"""

DECONTAMINATE = f"""
with d as (select doc_id, regexp_extract_all({FOLD}, '{ALNUM}') as w from documents),
i as (select cast(item_id as varchar) as item, regexp_extract_all({FOLD}, '{ALNUM}') as w from benchmark),
g as (select distinct item, least(13, len(w)) as size, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda k: array_to_string(w[k:k + least(13, len(w)) - 1], ' '))) as g from i where len(w) > 0),
z as (select distinct size from g),
x as (select doc_id, size, unnest(range(1, len(w) - size + 2)) as k, w from d, z where len(w) >= size),
h as (select x.doc_id, x.k, x.size, g.item from x join g on g.size = x.size and g.g = array_to_string(x.w[x.k:x.k + x.size - 1], ' ')),
m as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + size)) as p from h) group by doc_id),
l as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated from d left join m using (doc_id) left join l using (doc_id)"""


def quality_sql() -> str:
    """The measures, the sketches and the fences of ``quality``."""
    floor = -(1 << 20)
    step = f"ln({quality.GAMMA})"
    value = f"case when b > {floor} then 2.0 * pow({quality.GAMMA}, b) / (1 + {quality.GAMMA}) else 0.0 end"
    each = " union all ".join(f"select lang, source, '{f.measure}' as m, case when {f.measure} > 0 then cast(ceil(ln({f.measure}) / {step}) as bigint) else {floor} end as b from r" for f in quality.FENCES)
    each += f" union all select lang, source, '{quality.WORDS}' as m, case when n_words > 0 then cast(ceil(ln(n_words) / {step}) as bigint) else {floor} end as b from r"
    marks = quality.MARKS.replace("'", "''")

    def quartiles(by: str) -> str:
        group = f"partition by {by}m" if by else "partition by m"
        return f"select {by}m, max(rows) as rows, min(case when upto >= rows * 0.25 then {value} end) as q1, min(case when upto >= rows * 0.5 then {value} end) as q2, min(case when upto >= rows * 0.75 then {value} end) as q3 from (select *, sum(n) over ({group} order by b rows unbounded preceding) as upto, sum(n) over ({group}) as rows from (select {by}m, b, count(*) as n from k group by all)) group by {by}m"

    limits = [f"max(case when m = '{quality.WORDS}' then q2 end) as typical"]
    inside = []
    for f in quality.FENCES:
        m = f.measure
        limits += [f"max(case when m = '{m}' then {q} end) as {m}_{q}" for q in ("q1", "q3")]
        limits.append(f"max(case when m = '{m}' then {f.reach} * greatest(q3 - q1, {f.least}) end) as {m}_reach")
        wider = "sqrt(greatest(1.0, typical / cast(greatest(n_words, 1) as double)))"
        inside.append(f"r.{m} <= x.{m}_q3 + x.{m}_reach * {wider}" + (f" and r.{m} >= x.{m}_q1 - x.{m}_reach * {wider}" if f.low else ""))
    pick = lambda q: f"case when o.rows >= {quality.MIN_ROWS} then o.{q} when l.rows >= {quality.MIN_ROWS} then l.{q} else a.{q} end as {q}"
    return f"""
with w as (select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{SPACED}') as w from documents),
l0 as (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{SPACED}')) as ls from w),
v as (select doc_id, unnest(range(1, len(w) - 6)) as i, w from w where len(w) >= 8),
v8 as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as g from v),
d8 as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from v8) where c > 1),
p as (select doc_id, count(distinct q) as n from (select doc_id, unnest(range(i, i + 8)) as q from d8) group by doc_id),
m as (select l0.doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, length(t) - length(translate(t, '{marks}', '')) as n_marks, len(list_distinct(w)) as n_distinct, coalesce(p.n, 0) as n_repeat_words from l0 left join p on p.doc_id = l0.doc_id),
r as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed, cast(n_marks as double) / greatest(word_chars, 1) as mark_ratio, 1.0::double - ln(greatest(n_distinct, 1)::double) / ln(greatest(n_words, 2)::double) as repetition, cast(word_chars as double) / greatest(n_words, 1) as mean_word from m),
k as ({each}),
o as ({quartiles("lang, source, ")}),
l as ({quartiles("lang, ")}),
a as ({quartiles("")}),
x as (select lang, source, {", ".join(limits)} from (select o.lang, o.source, o.m, {pick("q1")}, {pick("q2")}, {pick("q3")} from o join l on o.lang is not distinct from l.lang and o.m = l.m join a on o.m = a.m) group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(inside)} as kept from r join x on r.lang is not distinct from x.lang and r.source is not distinct from x.source"""


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard_groups": JACCARD, "op7_decontaminate": DECONTAMINATE, "op9_quality_rules": quality_sql()}
