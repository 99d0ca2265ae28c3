"""DuckDB SQL for the queries that plain SQL can express, by brute force over the same whole tables."""

from __future__ import annotations

# Unicode white space and U+001C..1F, for RE2.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TRIM = f"'^{WS}+|{WS}+$', '', 'g'"

P1 = """
with v as (select id, model, embedding::double[] as e from naive_rag
  where model is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select id, model, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v),
s as (select a.id as a, b.id as b, least(1.0, round(list_dot_product(a.e, b.e), 6)) as s from u a join u b on a.model = b.model and a.id <> b.id),
r as (select a, b, s, row_number() over (partition by a order by s desc, b) as r from s)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from r where r <= 10 and s >= 0.85"""

P3 = f"""
with d as (select id, lower(regexp_replace(source, {TRIM})) as src, string_split(text, chr(10)) as ls from naive_rag where source is not null and text is not null),
l as (select id, src, unnest(range(1, len(ls) + 1)) as line_no, unnest(ls) as line from d),
n as (select id, src, cast(line_no as bigint) as line_no, regexp_replace(lower(trim(regexp_replace(line, '{WS}+', ' ', 'g'))), '[0-9]+', '0', 'g') as k from l),
f as (select src, k from n where k <> '' group by all having count(distinct id) >= 10)
select id, line_no from n join f using (src, k)"""

P4 = """
with w as (select id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from naive_rag where text is not null),
l as (select id, len(ws) as n, ws from w where len(ws) >= 20),
t as (select id, n, x, row_number() over (partition by id, x) as k from (select id, n, unnest(ws) as x from l)),
p as (select a.id as a, b.id as b, a.n as na, b.n as nb, count(*) as c from t a join t b on a.x = b.x and a.k = b.k and a.id < b.id and least(a.n, b.n) >= 0.75 * greatest(a.n, b.n) group by all)
select a as id_a, b as id_b from p where c >= 0.75 * (na + nb - c)"""

P5 = f"""
select c.id from chunk_lab c join strategy_limits s on lower(regexp_replace(c.strategy, {TRIM})) = s.strategy
where length(c.text) > s.max_chars or len(list_filter(string_split_regex(c.text, '{WS}+'), lambda w: w <> '')) > s.max_words"""

P6 = """
with q as (select item_id, unnest([question, answer]) as t from eval_pairs),
iw as (select item_id, regexp_extract_all(strip_accents(lower(t)), '[\\p{L}\\p{N}]+') as w from q where t is not null),
dw as (select doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
i12 as (select distinct item_id, array_to_string(w[i : i + 11], ' ') as s from (select item_id, w, unnest(range(1, len(w) - 10)) as i from iw where len(w) >= 12)),
d12 as (select distinct doc_id, array_to_string(w[i : i + 11], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from dw where len(w) >= 12))
select distinct doc_id, item_id from d12 join i12 using (s)"""

# Sizes in words: no source is near the border, so the tokenizer does not matter.
P7 = f"""
with z as (select source, coalesce(sum(len(list_filter(string_split_regex(text, '{WS}+'), lambda w: w <> ''))), 0) as n from documents group by source),
g as (select m.source, m.weight, m.max_repeats, coalesce(z.n, 0) as n from mix_targets m left join z using (source))
select source from g where weight * (select sum(n) from g) > max_repeats * n"""

P4_GROUPS = """
with recursive w as (select id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from naive_rag where text is not null),
l as (select id, len(ws) as n, ws, min(id) over (partition by array_to_string(list_sort(ws), ' ')) as class_id from w where len(ws) >= 20),
t as (select id, n, x, row_number() over (partition by id, x) as k from (select id, n, unnest(ws) as x from l where id = class_id)),
p as (select a.id as a, b.id as b, a.n as na, b.n as nb, count(*) as c from t a join t b on a.x = b.x and a.k = b.k and a.id < b.id and least(a.n, b.n) >= 0.75 * greatest(a.n, b.n) group by all),
e as (select a, b from p where c >= 0.75 * (na + nb - c)),
edges as (select a, b from e union all select b, a from e),
reach(a, b) as (select a, b from edges union select r.a, x.b from reach r join edges x on r.b = x.a),
g as (select a, least(a, min(b)) as group_id from reach group by a),
d as (select a, count(*) as links from edges group by a)
select l.id, l.class_id, coalesce(g.group_id, l.class_id) as group_id, coalesce(d.links, 0) as links from l left join g on g.a = l.class_id left join d on d.a = l.class_id"""

P6_ITEMS = """
with q as (select item_id, unnest(['question', 'answer']) as part, unnest([question, answer]) as t from eval_pairs),
iw as (select item_id, part, regexp_extract_all(strip_accents(lower(t)), '[\\p{L}\\p{N}]+') as w from q where t is not null),
dw as (select doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
i12 as (select item_id, part, i, array_to_string(w[i : i + 11], ' ') as s from (select *, unnest(range(1, len(w) - 10)) as i from iw where len(w) >= 12)),
d12 as (select doc_id, j, array_to_string(w[j : j + 11], ' ') as s from (select *, unnest(range(1, len(w) - 10)) as j from dw where len(w) >= 12)),
m as (select doc_id, item_id, part, j - i as shift, i - row_number() over (partition by doc_id, item_id, part, j - i order by i) as island from d12 join i12 using (s)),
r as (select doc_id, item_id, count(*) + 11 as n from m group by doc_id, item_id, part, shift, island)
select item_id, count(distinct doc_id) as documents, cast(max(n) as integer) as longest from r group by item_id"""

SQL: dict[str, str] = {"p4_groups": P4_GROUPS, "p6_by_item": P6_ITEMS, "p1_found": P1, "p3_found": P3, "p4_found": P4, "p5_found": P5, "p6_found": P6, "p7_found": P7}
