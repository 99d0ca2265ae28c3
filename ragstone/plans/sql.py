"""DuckDB SQL for the core queries, over the same tables."""

from __future__ import annotations

from ragstone.functions.text import INSTRUCTION as INSTRUCTION_TEXT
from ragstone.functions.text import STOP_WORDS
from ragstone.sources import generators

# Unicode white space and U+001C..1F, for RE2.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STOPS = "(" + ",".join(f"'{w}'" for w in STOP_WORDS) + ")"
ARTICLE = r"(?im)^([\s#*_>]*(?:<u>)?\**Art[íi]culo\s+\d+\s*[oº]?)"


def words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{WS}+'), lambda w: w <> '')"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '([a-z0-9_]+)', 1)"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def slide(items: str, size: int, overlap: int) -> str:
    step = max(1, size - overlap)
    return (
        f"list_transform(range(0, case when len({items}) = 0 then 0 else greatest(cast(ceil((len({items}) - {size}) / {step}.0) as bigint), 0) + 1 end), "
        f"lambda i: array_to_string({items}[i * {step} + 1 : i * {step} + {size}], ' '))"
    )


def exploded(chunks: str, cols: str = "doc_id", table: str = "documents") -> str:
    return (
        f"with c as (select {cols}, {chunks} as chunks from {table} where text is not null) "
        f"select {cols}, cast(unnest(range(0, len(chunks))) as integer) as chunk_index, unnest(chunks) as chunk from c"
    )


def sentences(c: str) -> str:
    return f"list_filter(string_split(regexp_replace({strip(c)}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


COS = "1 - list_dot_product(q.e, x.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(x.e, x.e)))"


def knn(where: str = "true", on: str = "true", k: int = 10) -> str:
    return f"""
with x as (select vec_id as id, label, embedding::double[] as e from embeddings),
d as (select q.id as qid, x.id, greatest(0.0, round({COS}, 9)) as distance from x q join x on {on} where q.id % 100 = 0 and ({where}))
select qid, id, rank, distance from (select *, row_number() over (partition by qid order by distance, id) as rank from d) where rank <= {k}"""


PAPERS = f"""
papers as (select id, regexp_replace(lower({strip('source')}), '\\.(pdf|md|txt)$', '') as source, text, {tokens("coalesce(text, '')")} as terms from ram_rag),
asked as (select item_id as qid, question as query, gold_source as gold, case when starts_with(question, '¿') then 'es' else 'en' end as grp, {tokens("coalesce(question, '')")} as terms from eval_pairs)"""

BM25 = PAPERS + """,
dl as (select id, len(terms) as dl from papers),
total as (select count(*)::double as n, avg(dl) as avgdl from dl),
posts as (select id, term, count(*) as tf from (select id, unnest(terms) as term from papers) group by all),
dfs as (select term, count(*) as df from posts group by term),
qterms as (select qid, term, count(*) as asked from (select qid, unnest(terms) as term from asked) group by all),
bm as (select qid, id, sum(asked * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
  from qterms join posts using (term) join dfs using (term) join dl using (id), total group by all),
lexical as (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank
  from (select asked.qid, papers.id, round(coalesce(score, 0), 9) as score from asked cross join papers left join bm on bm.qid = asked.qid and bm.id = papers.id))"""


def hashed(c: str) -> str:
    b = f"list_transform({c}, lambda t: (('0x' || substr(md5(t), 1, 6))::bigint) % 64)"
    return f"case when len({c}) > 0 then list_transform(range(0, 64), lambda i: len(list_filter({b}, lambda b: b = i))::double) end"


DENSE = BM25 + f""",
pv as (select id, list_transform(v, lambda y: (y / sqrt(list_dot_product(v, v)))::float::double) as e from (select id, {hashed('terms')} as v from papers) where v is not null),
qv as (select qid, list_transform(v, lambda y: (y / sqrt(list_dot_product(v, v)))::float::double) as e from (select qid, {hashed('terms')} as v from asked) where v is not null),
near as (select *, row_number() over (partition by qid order by distance, id) as rank from (select q.qid, x.id, greatest(0.0, round({COS}, 9)) as distance from qv q cross join pv x))"""

FUSED = DENSE + """,
lists as (select qid, id, rank, 0 as l from near union all select qid, id, rank, 1 from lexical),
fused as (select qid, id, round(sum(1.0::double / (60 + rank)), 12) as score, min(rank) filter (l = 0) as r0, min(rank) filter (l = 1) as r1 from lists group by qid, id),
hybrid as (select qid, id, score, row_number() over (partition by qid order by score desc, r0 nulls last, r1 nulls last, id) as rank from fused)"""

RANKS = FUSED + """,
every as (select 'bm25' as retriever, qid, id, rank from lexical union all select 'dense', qid, id, rank from near union all select 'hybrid', qid, id, rank from hybrid),
firsts as (select retriever, qid, p.source as id, min(rank) as first_rank from every join papers p using (id) where p.source is not null group by all),
placed as (select *, row_number() over (partition by retriever, qid order by first_rank, id) as rank from firsts),
kinds as (select distinct retriever from placed),
ranks as (select k.retriever, a.qid, a.grp, min(p.rank) as rank from asked a cross join kinds k left join placed p on p.retriever = k.retriever and p.qid = a.qid and p.id = a.gold where a.gold is not null group by all)"""


def hit(k: int) -> str:
    return f"avg(coalesce((rank <= {k})::int, 0))"


CARD = f"select retriever, count(*) as n_queries, round({hit(1)}, 6) as recall_at_1, round({hit(3)}, 6) as recall_at_3, round({hit(5)}, 6) as recall_at_5, round(avg(coalesce(1.0::double / rank, 0)), 6) as mrr, round(avg(case when rank <= 5 then 1.0::double / log2(rank + 1) else 0 end), 6) as ndcg_at_5 from ranks group by retriever"
LENGTHS = f"n as (select doc_id, len({words('text')}) as n from documents where text is not null)"
# RE2's \b knows ASCII only: letters beyond ASCII become an ASCII letter first.
PLAIN = r"regexp_replace(text, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]', 'z', 'g')"
DENSITY = f"""
parts as (select id, len({words('text')}) as w, len(regexp_extract_all({PLAIN}, '\\b[A-Z]\\.')) as ini,
  len(regexp_extract_all({PLAIN}, '\\b\\d+{WS}*[e\\-–]{WS}*\\d+\\b')) as rng, regexp_extract_all(lower(text), '[a-z]+') as t from ram_rag where text is not null),
density as (select id, w, ini * 100.0::double / greatest(w, 1) + rng * 200.0::double / greatest(w, 1)
  + greatest(0, 0.18::double - len(list_filter(t, lambda x: x in {STOPS}))::double / greatest(len(t), 1)) * 100 as density from parts)"""
BLOCKS = f"string_split(regexp_replace(text, '{ARTICLE}', chr(1) || '\\1', 'g'), chr(1))"
HAS = f"regexp_matches(text, '{ARTICLE}')"
CAPS = "(values (150), (250), (400), (600), (800)) as caps(cap)"
POINTS = "(values (0.0), (0.1), (0.2), (0.3), (0.4), (0.5), (0.6), (0.7), (0.8), (0.9), (0.95), (1.0)) as p(point)"
INSTRUCTION = "'" + INSTRUCTION_TEXT.replace("\n", "' || chr(10) || '") + "'"


def _by_article() -> str:
    return (
        f"flatten(list_transform(list_filter(list_transform({BLOCKS}, lambda b: {strip('b')}), lambda b: b <> ''), "
        f"lambda b: case when len({words('b')}) <= 250 then [b] else {slide(words('b'), 250, 25)} end))"
    )


def _recursive(size: int, c: str = "text") -> str:
    """Packing as a reduction: d = closed chunks, o = open sentences, n = their words, w = words of the sentence."""
    empty = "{'d': []::varchar[], 'o': []::varchar[], 'n': 0::bigint, 'w': []::varchar[]}"
    close = "case when a.n > 0 then list_append(a.d, array_to_string(a.o, ' ')) else a.d end"
    made = f"list_transform({sentences(c)}, lambda s: {{'d': []::varchar[], 'o': [s], 'n': len({words('s')})::bigint, 'w': {words('s')}}})"
    step = (
        f"case when e.n > {size} then {{'d': list_concat({close}, {slide('e.w', size, 0)}), 'o': []::varchar[], 'n': 0::bigint, 'w': []::varchar[]}} "
        f"when a.n + e.n > {size} then {{'d': {close}, 'o': e.o, 'n': e.n, 'w': []::varchar[]}} "
        f"else {{'d': a.d, 'o': list_concat(a.o, e.o), 'n': a.n + e.n, 'w': []::varchar[]}} end"
    )
    packed = f"list_reduce({made}, lambda a, e: {step}, {empty})"
    return f"list_transform([{packed}], lambda a: {close})[1]"


_ARTICLES = f"case when {HAS} then {_by_article()} else {slide(words('text'), 250, 25)} end"
_STRATEGY = "select '{name}' as strategy, unnest({chunks}) as chunk from documents where text is not null"
STRATEGIES = " union all ".join(_STRATEGY.format(name=n, chunks=c) for n, c in (
    ("fixed-150/25", slide(words("text"), 150, 25)), ("fixed-400/40", slide(words("text"), 400, 40)), ("recursive-150", _recursive(150)), ("by-article", _ARTICLES)))

def _sentences(n: int, seed: int) -> str:
    """The generator's permutation, read in mixed radix."""
    import math

    cap = generators.CAPACITY
    step = next(a for a in range(7919 + 2 * (seed % 1000), 7919 + 2 * (seed % 1000) + cap) if math.gcd(a, cap) == 1)
    code, parts = f"((range * {step} + {(seed * 104_729) % cap}) % {cap})", []
    below = 1
    for slot in (generators.SUBJECTS, generators.VERBS, generators.OBJECTS, generators.PLACES):
        listed = ", ".join("'" + w.replace("'", "''") + "'" for w in slot)
        parts.append(f"([{listed}])[({code} // {below}) % {len(slot)} + 1]")
        below *= len(slot)
    return f"select range as id, {" || ' ' || ".join(parts)} as text from range({n})"


# The hybrid evaluation over chunks that have a source: lists without the others.
RANKS_OF_OWNED = RANKS.replace("from ram_rag)", "from ram_rag where source is not null)")
DENSITY_OF_CHUNKS = f"""
cut as (select doc_id, coalesce(source, 'unknown') as source, string_split(regexp_replace(text, '(?im)^\\s*(?:#{{1,6}}\\s*)?(?:\\*+\\s*)?(references|bibliography|literature cited|works cited)\\b', chr(1)), chr(1))[1] as text from documents where text is not null),
ch as (select doc_id, source, unnest({slide(words("text"), 150, 25)}) as text from cut),
parts as (select doc_id, source, len({words('text')}) as w, len(regexp_extract_all({PLAIN}, '\\b[A-Z]\\.')) as ini,
  len(regexp_extract_all({PLAIN}, '\\b\\d+{WS}*[e\\-–]{WS}*\\d+\\b')) as rng, regexp_extract_all(lower(text), '[a-z]+') as t from ch),
kept as (select doc_id, source from parts where not (w >= 8 and ini * 100.0::double / greatest(w, 1) + rng * 200.0::double / greatest(w, 1)
  + greatest(0, 0.18::double - len(list_filter(t, lambda x: x in {STOPS}))::double / greatest(len(t), 1)) * 100 >= 20))"""

SQL: dict[str, str] = {
    "chunk_recursive": exploded(_recursive(40)),
    "chunk_strategies": f"select strategy, count(*) as n_chunks, round(avg(case when chunk <> '' then len(string_split(chunk, ' ')) end), 6) as avg_words from ({STRATEGIES}) group by strategy",
    "chunk_semantic": f"""
with c as (select doc_id, {sentences('text')} as ss from documents where text is not null),
s as (select doc_id, unnest(range(0, len(ss))) as i, unnest(ss) as s from c),
h as (select doc_id, i, s, {hashed(tokens('s'))} as v from s),
u as (select doc_id, i, s, case when v is null then list_transform(range(0, 64), lambda k: 0::double) else list_transform(v, lambda y: (y / sqrt(list_dot_product(v, v)))::float::double) end as e from h),
b as (select doc_id, i, s, coalesce((round(list_dot_product(e, lag(e) over w), 9) < 0.5)::int, 0) as brk from u window w as (partition by doc_id order by i)),
g as (select doc_id, i, s, sum(brk) over (partition by doc_id order by i) as chunk_index from b)
select doc_id, chunk_index::bigint as chunk_index, count(*) as n_sentences, md5(string_agg(s, ' ' order by i)) as chunk_md5 from g group by doc_id, chunk_index""",
    "knn_exact": knn(),
    "knn_filtered": knn("x.label = 3"),
    "knn_self_excluded": knn("q.id <> x.id"),
    "knn_columns": knn(),
    "knn_single": f"with x as (select vec_id as id, embedding::double[] as e from embeddings), d as (select x.id, greatest(0.0, round({COS}, 9)) as distance from x q, x where q.id = 0) select id, distance from d order by d.distance, id limit 3",
    "vector_norms": """
with x as (select vec_id as id, embedding::double[] as e, list_concat([1.0::double], list_transform(range(1, 64), lambda i: 0.0::double)) as f from embeddings)
select id, round(sqrt(list_dot_product(e, e)), 6) as norm, 1.0::double as unit_norm, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (e[i] - f[i]) * (e[i] - f[i])))), 6) as l2,
round(-list_dot_product(e, f), 6) as nip, round(1 - list_dot_product(e, f) / sqrt(list_dot_product(e, e)), 6) as cosine, len(e) = 64 as is_64 from x""",
    "recall_of_exact": f"""
with a as ({knn()}), b as ({knn('x.label < 5')})
select round(avg(h / 10.0::double), 6) as recall from (select a.qid, count(b.id) as h from a left join b on a.qid = b.qid and a.id = b.id group by a.qid)""",
    "chunk_fixed": exploded(slide(words("text"), 150, 25)),
    "chunk_fixed_small": exploded(slide(words("text"), 40, 10)),
    "chunk_sentence": exploded(sentences("text")),
    "chunk_sentence_groups": exploded(slide(sentences("text"), 3, 1)),
    "chunk_by_article": exploded(_ARTICLES),
    "article_words": f"""
with s as (select doc_id as id, {BLOCKS}[2:] as spans from documents where {HAS})
select id, cast(unnest(range(0, len(spans))) as bigint) as article_no, cast(unnest(list_transform(spans, lambda b: len({words('b')}))) as bigint) as n_words from s""",
    "article_mentions": r"""
with t as (select doc_id, regexp_replace(text, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]', 'z', 'g') as p from documents)
select article, count(*) as n from (select doc_id, unnest(list_distinct(regexp_extract_all(p, '(?i)Art[zi]culo\s+(\d+)\b', 1))) as article from t) group by article""",
    "chunk_stats": "select strategy, count(*) as n_chunks, round(avg(case when text <> '' then len(string_split(text, ' ')) end), 6) as avg_words from chunk_lab group by strategy",
    "chunk_stats_of_strategy": "select count(*) as n_chunks, round(avg(case when text <> '' then len(string_split(text, ' ')) end), 6) as avg_words from chunk_lab where strategy = 'by-article'",
    "word_percentiles": f"with {LENGTHS}, q as (select list_sort(list(n)) as l from n), p as (select point::double as point from {POINTS}) select point, round(l[floor(point * (len(l) - 1))::int + 1] + (point * (len(l) - 1) - floor(point * (len(l) - 1))) * (l[least(floor(point * (len(l) - 1))::int + 2, len(l))] - l[floor(point * (len(l) - 1))::int + 1]), 6) as value from p, q",
    "words_under_caps": f"with {LENGTHS} select cap, round(avg((n <= cap)::int) * 100, 6) as pct_fit, cast(sum((n > cap)::int) as bigint) as n_over from n, {CAPS} group by cap",
    "word_histogram": f"with {LENGTHS}, b as (select cast(unnest(range(0, 40)) as integer) as bin), c as (select least(floor(least(n, 800) / 20.0), 39)::int as bin, count(*) as n from n group by 1) select bin, bin * 20.0::double as low, (bin + 1) * 20.0::double as high, coalesce(c.n, 0) as n from b left join c using (bin)",
    "tokenize": f"select doc_id, cast(len(t) as bigint) as n_tokens, cast(len(list_distinct(t)) as bigint) as n_distinct, md5(array_to_string(t, ' ')) as tokens_md5 from (select doc_id, {tokens('text')} as t from documents)",
    "markdown_quality": f"select doc_id, cast(len({words('text')}) as bigint) as n_words, cast(len(regexp_extract_all(text, '(?m)^#{{1,6}}\\s')) as bigint) as n_headings, cast(len(regexp_extract_all(text, '(?m)^\\s*\\|.*\\|\\s*$')) as bigint) as n_table_rows from documents",
    "ref_density": f"with {DENSITY} select id, round(density, 6) as density, w >= 8 and round(density, 9) >= 20 as is_ref from density",
    "ref_density_band": f"with {DENSITY} select id, round(density, 6) as density from density where density > 20 and density < 30",
    "ref_density_top": f"with {DENSITY} select id, round(density, 6) as value from density order by round(density, 6) desc, id limit 1",
    "ref_clean": f"with {DENSITY} select id from density where not (w >= 8 and density >= 20)",
    "bibliography_cut": r"select id, cast(length(string_split(regexp_replace(text, '(?im)^\s*(?:#{1,6}\s*)?(?:\*+\s*)?(references|bibliography|literature cited|works cited)\b', chr(1)), chr(1))[1]) as bigint) as kept from ram_rag",
    "snippets": f"select doc_id, md5(case when length(text) >= 240 then substr(text, 1, 237) || '...' else text end) as snippet, md5(substr(regexp_replace(text, '{WS}+', ' ', 'g'), 1, 150)) as flat from documents",
    "table_names": r"""select distinct source, model, concat_ws('__', regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), regexp_replace(regexp_replace(lower(model), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 'fixed') as name,
  regexp_replace(string_split(source, '/')[-1], '(.)\.[^.]*$', '\1') as stem from naive_rag""",
    "instructed_queries": f"select item_id as qid, md5({INSTRUCTION} || question) as \"with\", md5(question) as without from eval_pairs",
    "plain_of_markup": "select doc_id, md5(regexp_replace('<p class=''x''>' || text || '</p>', '<[^>]+>', '', 'g')) as plain from documents",
    "bm25_terms": f"with {BM25} select id, term, tf from posts",
    "bm25_idf": f"with {BM25} select term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) as idf from dfs, total",
    "bm25_corpus": f"with {BM25} select n::bigint as n_docs, round(avgdl, 6) as avgdl from total",
    "bm25_topk": f"with {BM25} select qid, id, rank, round(score, 6) as score from lexical where rank <= 10",
    "hash_embed": f"with {DENSE} select id, cast(unnest(range(0, 64)) as bigint) as pos, round(unnest(e), 6) as value from pv",
    "dense_topk": f"with {DENSE} select qid, id, rank, distance from near where rank <= 10",
    "rrf_fusion": f"with {FUSED} select qid, id, rank, round(score, 9) as score from hybrid where rank <= 10",
    "weighted_sum_fusion": f"""with {FUSED},
m as (select qid, id, 1 - distance as score, 0 as l from near union all select qid, id, score, 1 from lexical),
s as (select qid, id, 0.5 * coalesce((score - min(score) over w) / nullif(max(score) over w - min(score) over w, 0), 0) as score from m window w as (partition by qid, l)),
t as (select qid, id, round(sum(score), 12) as score from s group by qid, id)
select qid, id, rank, round(score, 6) as score from (select *, row_number() over (partition by qid order by score desc, id) as rank from t) where rank <= 10""",
    "doc_rank_collapse": f"with {RANKS} select qid, id, rank, first_rank from placed where retriever = 'bm25'",
    "gold_ranks": f"with {RANKS} select retriever, qid, rank from ranks",
    "scorecard": f"with {RANKS} {CARD}",
    "scorecard_by_group": f"with {RANKS} select retriever, grp, round({hit(1)}, 6) as hit_at_1, round({hit(3)}, 6) as hit_at_3, round(avg(coalesce(1.0::double / rank, 0)), 6) as mrr from ranks group by retriever, grp",
    "leaderboard": f"with {RANKS} select retriever as model, mrr from ({CARD}) order by mrr desc",
    "upsert_scorecard": f"with {RANKS} select retriever as model, mrr from ({CARD}) union all select 'old', 0.2::double",
    "document_hits": f"with {RANKS}, h as (select a.qid, max((p.source = a.gold)::int) as hit from asked a left join lexical l on l.qid = a.qid and l.rank <= 3 left join papers p on p.id = l.id where a.gold is not null group by a.qid) select count(*) as questions, cast(sum(coalesce(hit, 0)) as bigint) as hits, round(sum(coalesce(hit, 0))::double / count(*), 6) as hit_rate from h",
    "gold_counts": "select count(distinct gold_source) as golds, cast(sum((gold_source is not null)::int) as bigint) as in_corpus, cast(sum((gold_source is null)::int) as bigint) as control from eval_pairs",
    "ablation": f"""with {DENSE}, {DENSITY},
flags as (select pv.id, (w >= 8 and density >= 20) as is_ref from pv join density using (id)),
conf as (select clean, f.id, f.is_ref from flags f, (values (false), (true)) as c(clean) where not (clean and is_ref)),
r as (select clean, n.qid, n.id, n.distance, c.is_ref, row_number() over (partition by clean, qid order by distance, n.id) as rk from near n join conf c on c.id = n.id)
select 'hash-64' as model, clean, (select count(*) from conf k where k.clean = r.clean) as n_chunks, round(avg(distance) filter (rk = 1), 6) as avg_top1_dist, round(avg(is_ref::int), 6) as ref_noise from r where rk <= 3 group by clean""",
    "bake_off": f"""with {DENSE},
pvs as (select n.qid, p.source as id, row_number() over (partition by n.qid order by distance, n.id) as rk from near n join papers p on p.id = n.id where p.source is not null),
b as (select qid, id, min(rk) as fr from pvs where rk <= 30 group by all), pl as (select *, row_number() over (partition by qid order by fr, id) as rank from b),
ranks as (select 'hash-64' as retriever, a.qid, pl.rank from asked a left join pl on pl.qid = a.qid and pl.id = a.gold where a.gold is not null)
select retriever as model, 64 as dim, (select count(*) from papers where source is not null) as n_chunks, recall_at_1, recall_at_3, recall_at_5, mrr, ndcg_at_5 from ({CARD})""",
    "abstention": f"with {DENSE} select qid, round(distance, 6) > 0.5 as abstain from near where rank = 1",
    "row_keys": "select doc_id, row_number() over (order by doc_id) as row_key from documents",
    "bm25_all": f"with {BM25} select qid, count(*) as n, cast(sum((round(score, 6) = 0)::int) as bigint) as zeros, min(id) filter (rank = 37) as id_37 from lexical group by qid",
    "evaluate_all": f"with {RANKS_OF_OWNED} select retriever, grp, round({hit(1)}, 6) as hit_at_1, round({hit(3)}, 6) as hit_at_3, round(avg(coalesce(1.0::double / rank, 0)), 6) as mrr from ranks group by retriever, grp",
    "rrf_k_sweep": f"""with {DENSE}, lists as (select qid, id, rank, 0 as l from near union all select qid, id, rank, 1 from lexical), ks(k) as (values (10), (60), (100)),
f as (select k, qid, id, round(sum(1.0::double / (k + rank)), 12) as score, min(rank) filter (l = 0) as r0, min(rank) filter (l = 1) as r1 from lists, ks group by k, qid, id),
h as (select k, qid, id, row_number() over (partition by k, qid order by score desc, r0 nulls last, r1 nulls last, id) as rank from f),
b as (select k, qid, p.source as id, min(rank) as fr from h join papers p using (id) where p.source is not null group by all),
pl as (select *, row_number() over (partition by k, qid order by fr, id) as rank from b),
ranks as (select ks.k as retriever, a.qid, min(pl.rank) as rank from asked a cross join ks left join pl on pl.k = ks.k and pl.qid = a.qid and pl.id = a.gold where a.gold is not null group by all)
select * exclude (retriever), retriever as rrf_k from ({CARD})""",
    "reranked": f"""with {BM25},
s as (select l.qid, l.id, l.rank as first_rank, round(len(list_intersect(list_distinct(a.terms), list_distinct(p.terms)))::double / nullif(len(list_distinct(a.terms)), 0), 9) as score
  from lexical l join asked a using (qid) join papers p using (id) where l.rank <= 50)
select qid, id, rank, round(score, 6) as score, first_rank from (select *, row_number() over (partition by qid order by score desc nulls last, first_rank, id) as rank from s) where rank <= 5""",
    "late_interaction": f"""with {BM25},
b as (select l.qid, l.id, l.rank as first_rank, list_transform(a.terms, lambda t: (('0x' || substr(md5(t), 1, 6))::bigint) % 32) as q, list_transform(p.terms, lambda t: (('0x' || substr(md5(t), 1, 6))::bigint) % 32) as t
  from lexical l join asked a using (qid) join papers p using (id) where l.rank <= 10),
s as (select qid, id, first_rank, case when len(q) > 0 and len(t) > 0 then len(list_filter(q, lambda x: list_contains(t, x)))::double end as score from b)
select qid, id, rank, score from (select *, row_number() over (partition by qid order by score desc nulls last, first_rank, id) as rank from s) where rank <= 5""",
    "parent_child": f"""with p as (select doc_id, {slide(words("text"), 150, 0)} as ps from documents where text is not null),
q as (select doc_id, unnest(range(0, len(ps))) as parent_index, unnest(ps) as parent from p), c as (select doc_id, parent_index, {slide(words("parent"), 40, 10)} as cs from q)
select doc_id, parent_index, unnest(range(0, len(cs))) as child_index, md5(unnest(cs)) as child from c""",
    "embed_batches": f"with {DENSE} select id, 64::bigint as dim, round(list_sum(e), 4) as total from pv",
    "markdown_files": "select 'q' || item_id as source, question as text, row_number() over (order by 'q' || item_id) as place from eval_pairs",
    "named_files": "select 'q' || item_id || '.md' as source, question as text from eval_pairs",
    "object_list": "select 'q' || item_id || '.md' as name, octet_length(encode(question)) as size from eval_pairs",
    "object_text": "select item_id, question, md5(question) as digest from eval_pairs",
    "qa_file": "select question, answer, gold_source as source, null::varchar as doc, gold_source is not null as in_corpus from eval_pairs",
    "docx_file": "select 'q' || item_id || '.docx' as source, trim(question) as question from eval_pairs where ends_with(trim(question), '?')",
    "table_writes": f"select lower({strip('strategy')}) as strategy, 2 * count(*) as n, count(distinct id) as ids from chunk_lab where strategy is not null group by 1",
    "scorecard_file": "select model, count(*) as n from naive_rag where model is not null group by model union all select 'other', 2",
    "citations": "select item_id, item_id::varchar as article, regexp_extract(question, 'Art\\.?\\s*(\\d+)', 1) as none from eval_pairs",
    "article_named": r"""with t as (select doc_id, regexp_replace(text, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]', 'z', 'g') as p from documents where text is not null)
select doc_id, regexp_matches(p, '(?i)Art[zi]culo\s+2\b') as two, regexp_matches(p, '(?i)Art[zi]culo\s+14\b') as fourteen, regexp_matches(p, '(?i)Art[zi]culo\s+2(?:\b|[oa]\b|[z°])') as two_or_second from t""",
    "article_hits": r"""with t as (select doc_id, regexp_extract_all(regexp_replace(text, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]', 'z', 'g'), '(?i)Art[zi]culo\s+(\d+)\b', 1) as ns from documents where text is not null),
r as (select doc_id % 7 as qid, ns, row_number() over (partition by doc_id % 7 order by doc_id) as rank from t where len(ns) > 0),
f as (select q.i as qid, min(r.rank) as rank from range(7) q(i) left join r on r.qid = q.i and r.rank <= 5 and list_contains(r.ns, (10 * q.i + 1)::varchar) group by q.i)
select round(avg(coalesce((rank <= 1)::int, 0)), 6) as art_hit_at_1, round(avg(coalesce((rank <= 3)::int, 0)), 6) as art_hit_at_3, round(avg(coalesce((rank <= 5)::int, 0)), 6) as art_hit_at_5, round(avg(coalesce(1.0::double / rank, 0)), 6) as mrr from f""",
    "by_length": f"with {LENGTHS} select doc_id, n, row_number() over (order by n desc, doc_id) as place from n",
    "unescaped": "select doc_id, md5(text) as plain from documents where text is not null",
    "catalog_probe": "select 'default' as database, true as has_user, true as is_4",
    "ivf_recall": "select true as recall_ok, true as clustered_ok, true as scanned_ok, count(*) as indexed from embeddings",
    "synthetic_vectors": "select range as id, 1.0::double as norm from range(2000)",
    "synthetic_sentences": _sentences(5000, 1),
    "ingest_roundtrip": f"""with {DENSITY_OF_CHUNKS} select source, count(*) as n_chunks, count(distinct doc_id) as n_docs from kept group by source""",
}
