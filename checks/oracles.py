"""DuckDB SQL giving the same rows as the registered queries, written from the definitions."""

from __future__ import annotations

COLUMNS = {
    "region": [("r_regionkey", "int"), ("r_name", "text")],
    "nation": [("n_nationkey", "int"), ("n_name", "text"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "int"), ("c_name", "text"), ("c_nationkey", "int"), ("c_acctbal", "float"), ("c_mktsegment", "text")],
    "supplier": [("s_suppkey", "int"), ("s_name", "text"), ("s_nationkey", "int"), ("s_acctbal", "float")],
    "part": [
        ("p_partkey", "int"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "int"), ("p_retailprice", "float"),
    ],
    "orders": [
        ("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "text"), ("o_totalprice", "float"), ("o_orderdate", "text"),
        ("o_orderpriority", "text"),
    ],
    "lineitem": [
        ("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"), ("l_quantity", "float"),
        ("l_extendedprice", "float"), ("l_discount", "float"), ("l_tax", "float"), ("l_returnflag", "text"), ("l_linestatus", "text"),
        ("l_shipdate", "text"),
    ],
    "pages": [("page_id", "int"), ("url", "text"), ("html", "text")],
}
STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
LINEITEM_ORDER = ", ".join(c for c, _ in COLUMNS["lineitem"])
WIDE = [c for t in ("lineitem", "orders", "customer", "part", "supplier") for c in COLUMNS[t]]
WIDE_FROM = """(select * from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)"""
KINDS = {"int": "int64", "float": "float64", "text": "object"}
PURPOSE = "Answer questions about orders and customers"


def text_of(column: str) -> str:
    return f"cast({column} as varchar)"


def cell(column: str, kind: str) -> str:
    text = text_of(column)
    return f"case when length({text}) > 200 then left({text}, 200) || '…' else {text} end" if kind == "text" else text


def line(columns: list[tuple[str, str]]) -> str:
    return " || ' | ' || ".join(f"'{c}: ' || {cell(c, k)}" for c, k in columns)


def tokens(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), "
        "lambda t: regexp_full_match(t, '[a-z0-9_]+'))"
    )


# --- search --------------------------------------------------------------------------------------------------

DOC_TOKENS = f"doc_tokens as materialized (select doc_id, {tokens('text')} as toks from documents)"
POSTINGS = """post as materialized (
  select doc_id, term, count(*) as tf, any_value(dl) as dl
  from (select doc_id, len(toks) as dl, unnest(toks) as term from doc_tokens) group by doc_id, term)"""
TERMS = """terms as materialized (
  select term, count(*) as df, ln(((select count(*) from documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) as idf
  from post group by term)"""


def questions(source: str) -> str:
    return f"q as materialized (select query_id, text, {tokens('text')} as toks from ({source}))"


BENCHMARK = "select item_id as query_id, text from benchmark"

BM25 = """qterms as (select query_id, term, count(*) as qtf from (select query_id, unnest(toks) as term from q) group by all),
avgdl as (select sum(len(toks)) / greatest(count(*), 1) as a from doc_tokens),
bm_scores as (
  select query_id, doc_id,
    sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (select a from avgdl)))) as score
  from qterms join terms using (term) join post using (term) group by query_id, doc_id),
bm as materialized (
  select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank
  from bm_scores qualify rank <= 20)"""


def hashed_vectors(name: str, ids: str, source: str) -> str:
    return f"""{name}_parts as (
  select id, bucket, cast(sum(sign) as double) as v from (
    select id, cast('0x' || substr(md5(term), 1, 8) as bigint) % 64 as bucket,
      case when cast('0x' || substr(md5(term), 9, 1) as int) < 8 then 1 else -1 end as sign
    from (select {ids} as id, unnest(toks) as term from {source})) group by id, bucket),
{name}_norm as (select id, sqrt(sum(v * v)) as norm from {name}_parts group by id),
{name}_grid as (select {ids} as id, b as bucket from {source}, range(64) r(b)),
{name} as materialized (
  select g.id, list(cast(case when coalesce(norm, 0) > 0 then coalesce(v, 0) / norm else 0 end as float) order by g.bucket) as vec
  from {name}_grid g left join {name}_norm n on n.id = g.id left join {name}_parts p on p.id = g.id and p.bucket = g.bucket
  group by g.id)"""


def dot(a: str, b: str) -> str:
    return f"list_dot_product(cast({a} as double[]), cast({b} as double[]))"


def nearest(docs: str, asked: str, k: int) -> str:
    return f"""sims as (select a.id as query_id, d.id as doc_id, {dot('a.vec', 'd.vec')} as score from {asked} a, {docs} d),
dn as materialized (
  select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank
  from sims qualify rank <= {k})"""


FUSED = """fused as materialized (
  select coalesce(bm.query_id, dn.query_id) as query_id, coalesce(bm.doc_id, dn.doc_id) as doc_id,
    coalesce(1.0 / cast(60 + bm.rank as double), 0) + coalesce(1.0 / cast(60 + dn.rank as double), 0) as score,
    bm.rank as r0, dn.rank as r1
  from bm full outer join dn on bm.query_id = dn.query_id and bm.doc_id = dn.doc_id)"""


def best_fused(limit: str, extra: str = "") -> str:
    return f"""cand as materialized (
  select query_id, doc_id, score, row_number() over (
    partition by query_id order by round(score, 9) desc, r0 nulls last, r1 nulls last, doc_id) as rank
  from fused {extra} qualify rank <= {limit})"""


def spread(rounds: int, share: float, docs: str, asked: str, picks: str) -> str:
    """Greedy diversified picks, one round after another. ``cand`` holds the candidates."""
    parts = [
        f"""cv as materialized (select c.query_id, c.doc_id, c.rank, d.vec, {dot('d.vec', 'a.vec')} as sim
  from cand c join {docs} d on d.id = c.doc_id join {asked} a on a.id = c.query_id)""",
        f"""pairs as materialized (select x.query_id, x.doc_id as a, y.doc_id as b, {dot('x.vec', 'y.vec')} as s
  from cv x join cv y using (query_id))""",
        """pick1 as materialized (select query_id, doc_id, 1 as rank from cv
  qualify row_number() over (partition by query_id order by round(sim, 9) desc, cv.rank) = 1)""",
        "chosen1 as materialized (select * from pick1)",
    ]
    for r in range(2, rounds + 1):
        parts.append(
            f"""pick{r} as materialized (select cv.query_id, cv.doc_id, {r} as rank
  from cv join (select p.query_id, p.a, max(p.s) as red from pairs p join chosen{r - 1} c
      on c.query_id = p.query_id and c.doc_id = p.b group by p.query_id, p.a) m on m.query_id = cv.query_id and m.a = cv.doc_id
  where {r} <= {picks} and not exists (select 1 from chosen{r - 1} c where c.query_id = cv.query_id and c.doc_id = cv.doc_id)
  qualify row_number() over (partition by cv.query_id order by round({share} * sim - (1 - {share}) * red, 9) desc, cv.rank) = 1)"""
        )
        parts.append(f"chosen{r} as materialized (select * from chosen{r - 1} union all select * from pick{r})")
    return ",\n".join(parts)


CENTROIDS = """cent as materialized (
  select label as id, list(cast(x as float) order by pos) as vec from (
    select label, pos, round(avg(cast(x as double)), 6) as x
    from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings) group by label, pos)
  group by label),
given as (select vec_id as id, embedding as vec from embeddings)"""

SHOWN = "select query_id, doc_id, round(score, 6) as score, rank"


def typed(text: str) -> str:
    words = (
        f"regexp_replace(regexp_replace(lower({text}), '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g')"
    )
    analytical = (
        r"\b(average|mean|median|sum|total|count|max|min|maximum|minimum|how many|percentage|ratio|trend)\b"
        r"|\b(compare|comparison|difference|versus|vs\.?|ranking|top \d+|bottom \d+)\b"
        r"|\b(distribution|correlation|group by|breakdown|analysis|statistics)\b"
    )
    lookup = (
        r"\b(what is|what are|who is|find|show|list|display|get|fetch|look up|search for)\b"
        r"|\b(value|record|entry|row|column|field)\b"
    )
    return (
        f"case when regexp_matches({words}, '{analytical}') then 'analytical' "
        f"when regexp_matches({words}, '{lookup}') then 'lookup' else 'conversational' end"
    )


def retrieval(source: str) -> str:
    """CTEs from a question source to ``chosen8``; ``kq`` holds type and size per question."""
    return ",\n".join(
        [
            DOC_TOKENS, POSTINGS, TERMS, questions(source),
            f"kq0 as (select query_id, text, {typed('text')} as qtype from q)",
            "kq as materialized (select *, case when qtype = 'analytical' then 8 else 6 end as k from kq0)",
            BM25, hashed_vectors("dv", "doc_id", "doc_tokens"), hashed_vectors("qv", "query_id", "q"),
            nearest("dv", "qv", 20), FUSED, best_fused("3 * any_k", "join (select query_id as qid, k as any_k from kq) on qid = query_id"),
            spread(8, 0.65, "dv", "qv", "(select k from kq where kq.query_id = cv.query_id)"),
        ]
    )


PROMPT_QUESTIONS = """select item_id * 3 + form as query_id, lead || text as text from benchmark,
  (values (0, ''), (1, 'Compare: '), (2, 'Show me: ')) f(form, lead)"""

# --- tables and chunks -----------------------------------------------------------------------------------------


def numbered(source: str, order: str, columns: list[tuple[str, str]], name: str = "num") -> str:
    return f"""{name} as materialized (select *, row_number() over (order by {order}) - 1 as rid from {source}),
{name}_n as (select count(*) as n from {name})"""


def starts(name: str, step: str) -> str:
    return f"(select unnest(range(0, n, {step})) as s, n from {name}_n)"


def window_rows(name: str, columns, window: str, overlap: str, table: str, chunk_type: str = "") -> str:
    step = f"greatest(1, {window} - {overlap})"
    return f"""select cast(null as int) as col_group, s as row_start, least(s + {window}, any_value(w.n)) as row_end,
  '{", ".join(c for c, _ in columns)}' as cols,
  '[Table: {table} | Rows ' || (s + 1) || '–' || least(s + {window}, any_value(w.n)) || ' of ' || any_value(w.n) || ']' || chr(10)
    || string_agg({line(columns)}, chr(10) order by rid) as text
from {starts(name, step)} w join {name} on rid >= s and rid < s + {window} group by s"""


def grouped(columns: list, size: int) -> list[list]:
    return [columns[i : i + size] for i in range(0, len(columns), size)]


def column_group_rows(name: str, columns, sample: int, size: int, table: str) -> str:
    groups = grouped(columns, size)
    k = f"least({sample}, (select n from {name}_n))"
    last = f"((select n from {name}_n) - 1)"
    picked = f"""(select * from {name} where rid in (
    select case when i = {k} - 1 then {last} else cast(floor(i * ({last} / cast({k} - 1 as double))) as bigint) end
    from range(0, {k}) r(i)))"""
    return "\nunion all\n".join(
        f"""select {g} as col_group, cast(null as bigint) as row_start, cast(null as bigint) as row_end,
  '{", ".join(c for c, _ in cols)}' as cols,
  '[Table: {table} | Column Group {g + 1}/{len(groups)}: {", ".join(c for c, _ in cols)}]' || chr(10)
    || string_agg({line(cols)}, chr(10) order by rid) as text from {picked}"""
        for g, cols in enumerate(groups)
    )


def hybrid_rows(name: str, columns, window: int, overlap: int, size: int, table: str) -> str:
    step = max(1, window - overlap)
    return "\nunion all\n".join(
        f"""select {g} as col_group, s as row_start, least(s + {window}, any_value(w.n)) as row_end,
  '{", ".join(c for c, _ in cols)}' as cols,
  '[Table: {table} | ColGroup {g + 1} × Rows ' || (s + 1) || '–' || least(s + {window}, any_value(w.n)) || ']' || chr(10)
    || string_agg({line(cols)}, chr(10) order by rid) as text
from {starts(name, str(step))} w join {name} on rid >= s and rid < s + {window} group by s"""
        for g, cols in enumerate(grouped(columns, size))
    )


def profile_rows(name: str, columns, table: str, separator: str = "; ", samples: int = 5) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns):
        number = kind != "text"
        parts.append(
            f"""select '{table}' as "table", {i} as col_ord, '{c}' as "column", '{KINDS[kind]}' as dtype,
  count(distinct {c}) as unique_count, {"0" if number else f"count(*) filter ({text_of(c)} = '')"} as null_count,
  (select string_agg({text_of(c)}, '{separator}' order by rid) from {name} where rid < {samples}) as sample_values,
  {f"cast(min({c}) as double)" if number else "cast(null as double)"} as min,
  {f"cast(max({c}) as double)" if number else "cast(null as double)"} as max,
  {f"round_even(avg({c}), 4)" if number else "cast(null as double)"} as mean from {name}"""
        )
    return "\nunion all\n".join(parts)


def schema_chunk(name: str, columns, table: str) -> str:
    return f"""select '[Schema: {table}]' || chr(10) || string_agg(
  '  ' || "column" || ' (' || dtype || ') | unique=' || unique_count || ' | nulls=' || null_count || ' | e.g. ' || sample_values
  || case when dtype <> 'object' then ' | mean=' || mean || ', min=' || min || ', max=' || max else '' end,
  chr(10) order by col_ord) as text from ({profile_rows(name, columns, table, ", ", 3)})"""


def describe_rows(name: str, columns) -> str:
    return "\nunion all\n".join(
        f"""select {i} as ord, '{c}' as "column", count({c}) as count, round_even(avg({c}), 3) as mean, round_even(stddev_samp({c}), 3) as std,
  round_even(cast(min({c}) as double), 3) as min, round_even(quantile_cont({c}, 0.25), 3) as p25,
  round_even(quantile_cont({c}, 0.5), 3) as p50, round_even(quantile_cont({c}, 0.75), 3) as p75,
  round_even(cast(max({c}) as double), 3) as max from {name}"""
        for i, (c, kind) in enumerate(columns)
        if kind != "text"
    )


def top_value_rows(name: str, columns, table: str) -> str:
    texts = [c for c, kind in columns if kind == "text"][:5]
    return "\nunion all\n".join(
        f"""select '{table}' as "table", {i} as ord, '{c}' as "column", {text_of(c)} as value, count(*) as n,
  row_number() over (order by count(*) desc, min(rid)) as rank from {name} group by {c} qualify rank <= 5"""
        for i, c in enumerate(texts)
    )


def stats_chunk(name: str, columns, table: str) -> str:
    texts = any(kind == "text" for _, kind in columns)
    tail = (
        f""" || chr(10) || chr(10) || 'Top categorical values:' || chr(10) || (
  select string_agg('  ' || "column" || ': ' || vals, chr(10) order by ord) from (
    select ord, "column", string_agg('''' || value || ''':' || n, ', ' order by rank) as vals
    from ({top_value_rows(name, columns, table)}) group by ord, "column"))"""
        if texts
        else ""
    )
    return f"""select '[Statistical Summary: {table} — ' || (select n from {name}_n) || ' rows × {len(columns)} columns]' || chr(10) || (
  select string_agg('  ' || "column" || ': count=' || count || ', mean=' || mean || ', std=' || coalesce(cast(std as varchar), 'nan') || ', min=' || min
    || ', 25%=' || p25 || ', 50%=' || p50 || ', 75%=' || p75 || ', max=' || max, chr(10) order by ord)
  from ({describe_rows(name, columns)})){tail} as text"""


def manifest_rows(tables: dict[str, tuple[str, list]]) -> str:
    return "\nunion all\n".join(
        f"""select {i} as table_ord, '{t}' as "table", count(*) as n_rows, {len(cols)} as n_cols,
  '{", ".join(c for c, _ in cols)}' as columns, '{", ".join(c for c, _ in cols[:20])}' as shown from {source}"""
        for i, (t, (source, cols)) in enumerate(tables.items())
    )


def overview(tables: dict[str, tuple[str, list]]) -> str:
    return f"""select '=== GLOBAL OVERVIEW ===' || chr(10) || 'Purpose: {PURPOSE}' || chr(10) || 'Number of tables: ' || count(*) || chr(10)
  || string_agg('  • ' || "table" || ': ' || format('{{:,}}', n_rows) || ' rows × ' || n_cols || ' columns' || chr(10)
    || '    Columns: ' || shown, chr(10) order by table_ord) as text
from ({manifest_rows(tables)})"""


def summary(tables: dict[str, list]) -> str:
    rows = "\nunion all\n".join(
        f"""select {i} as ord, 'Table ''{t}'' [' || count(*) || ' rows]: {", ".join(f"{c} ({KINDS[k]})" for c, k in cols)}' as l from {t}"""
        for i, (t, cols) in enumerate(tables.items())
    )
    return f"select string_agg(l, chr(10) order by ord) as summary from ({rows})"


SEGMENT_COLUMNS = [("c_mktsegment", "text")] + [
    (f"{m}_{f}{s}", "int" if m == "n" else "float") for f in "anr" for s in "fo" for m in ("n", "qty", "low", "high", "tax")
]


def segments() -> str:
    measures = []
    for f in "ANR":
        for s in "FO":
            hit, tag = f"l_returnflag = '{f}' and l_linestatus = '{s}'", f"{f}{s}".lower()
            measures.append(
                f"""count(*) filter ({hit}) as n_{tag}, coalesce(sum(l_quantity) filter ({hit}), 0) as qty_{tag},
  coalesce(min(l_extendedprice) filter ({hit}), 0) as low_{tag}, coalesce(max(l_extendedprice) filter ({hit}), 0) as high_{tag},
  coalesce(max(l_tax) filter ({hit}), 0) as tax_{tag}"""
            )
    return f"""(select c_mktsegment, {", ".join(measures)} from lineitem join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey group by c_mktsegment)"""


# --- auto chunks: every table's parameters follow from its row count --------------------------------------------


def auto_chunks(tables: list[tuple[str, str, str, list]], with_text: bool = True) -> str:
    ctes, parts = [], []
    for t, source, order, cols in tables:
        name = f"t_{t}"
        ctes.append(numbered(source, order, cols, name))
        n = f"(select n from {name}_n)"
        if len(cols) < 30:
            window = f"case when {n} > 500 then 12 when {n} > 100 then 10 else 8 end"
            overlap = f"case when {n} > 100 then 2 else 1 end"
            ctes.append(f"{name}_p as (select n, {window} as w, {overlap} as o from {name}_n)")
            body = window_rows(name, cols, f"(select w from {name}_p)", f"(select o from {name}_p)", t)
            body = f"select 'row_window' as chunk_type, * from ({body})"
        else:
            body = f"""select 'hybrid' as chunk_type, * from ({hybrid_rows(name, cols, 8, 1, 6, t)}) where {n} > 200
union all select 'column_group', * from ({column_group_rows(name, cols, 25, 8, t)}) where {n} <= 200"""
        ctes.append(f"{name}_c as materialized (select *, row_number() over (order by col_group nulls first, row_start nulls first) as pos from ({body}))")
        ctes.append(f"{name}_k as (select count(*) as c from {name}_c)")
    empty = "cast(null as int) as col_group, cast(null as bigint) as row_start, cast(null as bigint) as row_end, cast(null as varchar) as cols"
    shape = {t: (source, cols) for t, source, _, cols in tables}
    parts.append(f"""select 0 as chunk_id, '_global' as "table", 'overview' as chunk_type, {empty}, text from ({overview(shape)})""")
    first = "1"
    for t, source, order, cols in tables:
        name = f"t_{t}"
        parts.append(f"""select {first} as chunk_id, '{t}' as "table", 'schema' as chunk_type, {empty}, text from ({schema_chunk(name, cols, t)})""")
        parts.append(f"""select {first} + 1 as chunk_id, '{t}' as "table", 'stats' as chunk_type, {empty}, text from ({stats_chunk(name, cols, t)})""")
        parts.append(
            f"""select {first} + 1 + pos as chunk_id, '{t}' as "table", chunk_type, col_group, row_start, row_end, cols, text from {name}_c"""
        )
        first = f"{first} + 2 + (select c from {name}_k)"
    return "with " + ",\n".join(ctes) + "\n" + "\nunion all\n".join(parts)


def frames(size: int) -> str:
    return f"""with m as (select *, row_number() over (partition by conv_id order by turn) as rn from conversations)
select u.conv_id, u.turn, count(*) as n_messages, string_agg(p.role || ': ' || p.text, chr(10) order by p.rn) as frame
from m u join m p on p.conv_id = u.conv_id and p.rn <= u.rn and p.rn > u.rn - {size}
where u.role = 'user' group by u.conv_id, u.turn"""


def _per_table(names: list[str], body) -> str:
    """CTEs numbering each table by its first column, then the union of ``body(name, columns, table)``."""
    ctes = ",\n".join(numbered(t, COLUMNS[t][0][0], COLUMNS[t], f"t_{t}") for t in names)
    return f"with {ctes}\n" + "\nunion all\n".join(body(f"t_{t}", COLUMNS[t], t) for t in names)


def numeric_text(column: str) -> str:
    digits = f"trim(replace({column}, ',', ''))"
    parsed = rf"case when regexp_matches({digits}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') then try_cast({digits} as double) end"
    whole = rf"case when regexp_matches({digits}, '^[+-]?\d+$') then try_cast({digits} as bigint) end"
    return f"""case when (select avg(case when {parsed} is not null then 1 else 0 end) from dirty) <= 0.8 then {column}
  when (select avg(case when {whole} is not null then 1 else 0 end) from dirty) = 1 then cast({whole} as varchar)
  else cast(coalesce({parsed}, 0) as varchar) end as {column}"""


DIRTY = """dirty as materialized (select event_id, format('{:,}', user_id * 1000) as thousands,
  case when event_type = 'purchase' then 'n/a' else cast(value as varchar) end as gap_purchase,
  case when event_type = 'signup' then 'n/a' else cast(value as varchar) end as gap_signup,
  case when event_type in ('click', 'view') then 'n/a' else cast(value as varchar) end as gap_two from events)"""
DIRTY_COLUMNS = ["thousands", "gap_purchase", "gap_signup", "gap_two"]


def rate_row(column: str) -> str:
    digits = f"trim(replace({column}, ',', ''))"
    rate = rf"avg(case when regexp_matches({digits}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') then 1 else 0 end)"
    return f"""select '{column}' as "column", round({rate}, 6) as rate, {rate} > 0.8 as converts from dirty"""


COMPLETIONS = r"""comp as (select conv_id, turn, role, translate(text, '[]', '()') as whole,
  regexp_replace(translate(text, '[]', '()'), '[\r\n]+', ' ', 'g') as one_line from conversations),
found as (
  select conv_id, turn, case
    when role = 'user' then [whole || '?', 'Why?', 'And ' || turn || '?']
    when role = 'assistant' then [regexp_replace(trim(one_line || '?', ' '), '^[0-9.) -]+', ''), 'How many?', 'Last ' || turn || '?']
    else ['What are the main trends in this data?', 'Show me the top 5 entries.', 'What is the average value?',
      'How many unique categories are there?', 'What is the most common value?'] end as questions from comp)
select conv_id, turn, unnest(range(0, len(questions))) as at, unnest(questions) as question from found"""


JSON_KEYS = """with e as (select *, event_id % 7 = 6 as twice, event_id % 3 = 1 as upper, event_id % 5 = 4 as late from events),
first as (select min(event_id) filter (not upper) as v_low, min(event_id) filter (upper) as v_up, min(event_id) filter (late) as a_late,
  min(event_id) filter (twice) as name from e)
select event_id, case when twice then 'twice' else event_type end as kind_name,
  case when (select v_low < v_up from first) = upper then 0 else value end as value,
  case when (select v_low < v_up from first) = upper then value else 0 end as value_1,
  case when late then event_type else '' end as a_late, case when twice then event_type else '' end as kind_name_1,
  'event_id, kind_name, ' || (select string_agg(c, ', ' order by pos, nth) from (
    select 'value' as c, least(v_low, v_up) as pos, 1 as nth from first union all select 'value_1', greatest(v_low, v_up), 1 from first
    union all select 'a_late', a_late, 2 from first union all select 'kind_name_1', name, 0 from first)) as columns
from e"""

ENCODED = r"""with d as (select doc_id, text, lang, regexp_replace(text, '[^\x09\x0a\x20-\x7e\x{a0}-\x{ff}]', '?', 'g') as plain from documents)
select 'win' as "table", 'cp1252' as encoding, doc_id, plain as body, '“€” ' || lang as tag from d
union all select 'latin', 'latin-1', doc_id, plain, 'é ' || lang from d
union all select 'low', 'utf-16', doc_id, text, '日本 ' || lang from d
union all select 'high', 'utf-16', doc_id, text, '日本 ' || lang from d
union all select 'lines', 'latin-1', doc_id, plain, 'é ' || lang from d
union all select 'list', 'utf-16', doc_id, plain, 'é ' || lang from d"""

RAGGED = """select event_id, case event_id % 6 when 2 then '' when 3 then 'a, "' || event_type || '"' when 4 then event_type || ' 5" wide'
  else event_type end as kind,
  case when event_id % 6 in (0, 5) then '' else cast(value as varchar) end as amount from events where event_id % 6 <> 1"""


def threshold() -> str:
    gaps = ", ".join(f"case when event_id % {m} = 0 then 'n/a' else cast(value as varchar) end as one_in_{m}" for m in (10, 5, 4))
    return f"""with dirty as materialized (select event_id, {gaps} from events)
select event_id, {", ".join(numeric_text(f"one_in_{m}") for m in (10, 5, 4))} from dirty"""


def strategies() -> str:
    cols = COLUMNS["customer"]
    names = ", ".join(f"{k} as {k}" for k in ("chunk_id", '"table"', "chunk_type", "col_group", "row_start", "row_end", "cols", "text"))
    bodies = {
        "row_window": window_rows("c", cols, "10", "2", "customer"),
        "column_group": column_group_rows("c", cols, 20, 8, "customer"),
        "hybrid": hybrid_rows("c", cols, 8, 1, 6, "customer"),
    }
    parts = [
        f"""select 2 + row_number() over (order by col_group nulls first, row_start nulls first) as chunk_id, 'customer' as "table", '{k}' as chunk_type, *
from ({body})"""
        for k, body in bodies.items()
    ]
    return f"with {numbered('customer', 'c_custkey', cols, 'c')} select {names} from (" + "\nunion all\n".join(parts) + ")"


TABLE_QUESTIONS = """select n_nationkey * 3 + form as query_id, replace(f, '%s', n_name) as text from nation,
  (values (0, 'Compare the average balance of customers in nation %s'), (1, 'Show me the supplier and nation row %s'), (2, 'Anything on %s please')) t(form, f)"""


def prompts(source: str, kind: str, docs: str = "documents", table: str = "source") -> str:
    """CTEs and the prompts of a question source; ``documents`` may be a CTE that comes before."""
    return f"""{retrieval(source)},
ctx as (select query_id, string_agg('[Context ' || rank || ' | type=' || {kind} || ' table=' || {table} || ']' || chr(10) || text,
    chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context
  from chosen8 join {docs} using (doc_id) group by query_id),
full_ctx as (select kq.query_id, qtype, text, coalesce(context, 'No relevant data found in the database.') as context
  from kq left join ctx using (query_id))
select query_id, qtype, context, '[Query type: ' || qtype || ']' || chr(10) || chr(10) || 'RETRIEVED CONTEXT:' || chr(10) || context
  || chr(10) || chr(10) || 'USER QUESTION: ' || text as prompt from full_ctx"""


def all_sql() -> dict[str, str]:
    num = {t: numbered(t, COLUMNS[t][0][0], COLUMNS[t], f"t_{t}") for t in COLUMNS if t != "lineitem"}
    orders_customer = COLUMNS["orders"] + COLUMNS["customer"]
    search = ", ".join([DOC_TOKENS, POSTINGS, TERMS, questions(BENCHMARK), BM25])
    auto = [(t, t, COLUMNS[t][0][0], COLUMNS[t]) for t in ("nation", "pages", "customer")]
    auto += [("segments", segments(), "c_mktsegment", SEGMENT_COLUMNS), ("wide", WIDE_FROM, LINEITEM_ORDER, WIDE)]
    two = [(t, t, COLUMNS[t][0][0], COLUMNS[t]) for t in ("nation", "customer")]
    orders_csv = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as varchar) as o_orderdate, o_orderpriority"
    return {
        "tokenise_counts": f"with {DOC_TOKENS} select doc_id, len(toks) as n_tokens, len(list_distinct(toks)) as n_terms from doc_tokens",
        "bm25_terms": f"with {DOC_TOKENS}, {POSTINGS}, {TERMS} select term, df, round(idf, 6) as idf from terms",
        "bm25_topk": f"with {search} {SHOWN} from bm",
        "index_round_trip": f"with {search} {SHOWN} from bm",
        "hash_embed": f"""with {DOC_TOKENS}, {hashed_vectors("dv", "doc_id", "doc_tokens")}
select id as doc_id, pos - 1 as bucket, round(cast(w as double), 6) as weight
from (select id, unnest(vec) as w, generate_subscripts(vec, 1) as pos from dv) where w <> 0""",
        "dense_topk": f"with {CENTROIDS}, {nearest('given', 'cent', 20)} {SHOWN} from dn",
        "rrf_fuse": f"""with {search}, {hashed_vectors("dv", "doc_id", "doc_tokens")}, {hashed_vectors("qv", "query_id", "q")},
{nearest("dv", "qv", 20)}, {FUSED}, {best_fused("18")} {SHOWN} from cand""",
        "mmr_select": f"""with {CENTROIDS}, {nearest("given", "cent", 24)}, cand as (select query_id, doc_id, rank from dn),
{spread(8, 0.65, "given", "cent", "8")} select query_id, doc_id, rank from chosen8""",
        "hybrid_retrieve": f"""with {retrieval(BENCHMARK)} select query_id, rank, doc_id, length(text) as n_chars
from chosen8 join documents using (doc_id)""",
        "classify_questions": f"""with asked as (
  select 'balance' as kind, c_custkey as id, 'What is the AVERAGE balance of ' || c_name as text from customer
  union all select 'detail', p_partkey, 'Please show me ' || p_name from part
  union all select 'chat', c_custkey, 'Démaximum — hello ' || c_name from customer
  union all select 'message', conv_id * 1000 + turn, text from conversations),
t as (select kind, id, {typed("text")} as qtype from asked)
select kind, id, qtype, case when qtype = 'analytical' then 8 else 6 end as k from t""",
        "prompt_dataset": f"""with {retrieval(PROMPT_QUESTIONS)},
ctx as (select query_id, string_agg('[Context ' || rank || ' | type=document table=' || source || ']' || chr(10) || text,
    chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context
  from chosen8 join documents using (doc_id) group by query_id),
full_ctx as (select kq.query_id, qtype, text, coalesce(context, 'No relevant data found in the database.') as context
  from kq left join ctx using (query_id))
select query_id, qtype, context, '[Query type: ' || qtype || ']' || chr(10) || chr(10) || 'RETRIEVED CONTEXT:' || chr(10) || context
  || chr(10) || chr(10) || 'USER QUESTION: ' || text as prompt from full_ctx""",
        "system_prompt": f"""select 'You answer questions about the tables below.' || chr(10) || chr(10) || 'Purpose:' || chr(10) || '{PURPOSE}'
  || chr(10) || chr(10) || 'Tables:' || chr(10) || summary || chr(10) || chr(10) || 'Rules:' || chr(10)
  || '- Rely on the retrieved context alone, and say when it does not hold the answer.' || chr(10)
  || '- Compute and compare when asked to analyse; quote records when asked to look them up.' || chr(10)
  || '- Name the table and column an answer comes from, and lay out comparisons as tables.' || chr(10) as system
from ({summary({t: COLUMNS[t] for t in STAR})})""",
        "extract_questions": f"with {COMPLETIONS}",
        "conversation_memory": frames(16),
        "conversation_memory_short": frames(4),
        "memory_stream": frames(4),
        "memory_turns": "select conv_id, least(count(*), 16) // 2 as memory_turns from conversations group by conv_id",
        "clean_fill_dedup": """select row_number() over (order by first) - 1 as row_id, body_text, coalesce(lang, '') as lang from (
  select text as body_text, nullif(lang, 'es') as lang, min(doc_id) as first from documents group by all)""",
        "numeric_coercion": f"with {DIRTY} select event_id, {', '.join(numeric_text(c) for c in DIRTY_COLUMNS)} from dirty",
        "parse_rates": f"with {DIRTY} " + " union all ".join(rate_row(c) for c in DIRTY_COLUMNS),
        "column_profile": _per_table(["customer", "orders"], lambda n, c, t: profile_rows(n, c, t)),
        "describe_numeric": f"""select "column", count, mean, std, min, p25, p50, p75, max from ({describe_rows("lineitem", COLUMNS["lineitem"])})""",
        "top_values": _per_table(
            ["orders", "part"], lambda n, c, t: f'select "table", "column", value, n, rank from ({top_value_rows(n, c, t)})'
        ),
        "load_manifest": f'select table_ord, "table", n_rows, n_cols, columns from ({manifest_rows({t: (t, COLUMNS[t]) for t in STAR})})',
        "schema_summary": summary({t: COLUMNS[t] for t in STAR}),
        "session_totals": f"""select 'nation, customer' as tables, (select count(*) from nation) + (select count(*) from customer) as total_rows,
  (select count(*) from ({auto_chunks(two)})) as total_chunks""",
        "row_numbers": f"""select row_number() over (order by {LINEITEM_ORDER}) - 1 as row_id, l_orderkey, l_partkey, l_linenumber, l_extendedprice
from lineitem""",
        "even_sample": f"""with {num["orders"]} select rid as row_id, o_orderkey, o_totalprice from t_orders where rid in (
  select case when i = k - 1 then n - 1 else cast(floor(i * ((n - 1) / cast(k - 1 as double))) as bigint) end
  from (select n, least(20, n) as k from t_orders_n), range(0, 20) r(i) where i < k)""",
        "row_window_chunks": f"""with {num["customer"]}, {num["orders"]}
select 'customer' as "table", * from ({window_rows("t_customer", COLUMNS["customer"], "12", "2", "customer")})
union all select 'orders', * from ({window_rows("t_orders", COLUMNS["orders"], "10", "2", "orders")})""",
        "column_group_chunks": f"""with {numbered(WIDE_FROM, LINEITEM_ORDER, WIDE, "w")}
select 'wide' as "table", * from ({column_group_rows("w", WIDE, 20, 8, "wide")})""",
        "hybrid_chunks": f"""with {numbered("(select * from orders join customer on o_custkey = c_custkey)", "o_orderkey", orders_customer, "oc")}
select 'orders' as "table", * from ({hybrid_rows("oc", orders_customer, 8, 1, 6, "orders")})""",
        "schema_chunks": _per_table(
            ["nation", "customer", "part", "orders"], lambda n, c, t: f"""select '{t}' as "table", text from ({schema_chunk(n, c, t)})"""
        ),
        "stats_chunks": _per_table(
            ["nation", "customer", "part", "orders"], lambda n, c, t: f"""select '{t}' as "table", text from ({stats_chunk(n, c, t)})"""
        ),
        "overview_chunk": overview({t: (t, COLUMNS[t]) for t in STAR}),
        "build_chunks_auto": auto_chunks(auto),
        "json_flatten": """select event_id, event_type as event_event_type, value as event_detail_value,
  cast(props ->> '$.k' as bigint) as event_detail_props_k from events""",
        "separator_sniff": """select * from (values ('customer', ';'), ('orders', '|'), ('part', ','), ('supplier', chr(9)), ('lineitem', ' '))
  t("table", separator)""",
        "encoding_audit": """select 'utf' as "table", 'utf-8' as encoding union all select 'ascii', 'utf-8' union all
select 'latin', case when (select count(*) from conversations where regexp_matches(text || role, '[\\x{80}-\\x{FF}]')) > 0
  then 'latin-1' else 'utf-8' end""",
        "delimited_scan": " union all ".join(f"""select '{t}' as "table", {orders_csv} from orders""" for t in ("semicolons", "tabs", "bars")),
        "json_scan": "select event_id, event_type as detail_event_type, value as detail_value from events",
        "file_manifest": """select 'customer' as "table", 'CSV' as file_type, 'utf-8' as encoding, ';' as separator, count(*) as n_rows, 5 as n_cols,
  '' as errors from customer
union all select 'events', 'JSON', 'utf-8', null, count(*), 2, '' from events
union all select 'part', 'Parquet', 'binary', null, count(*), 6, '' from part
union all select 'other', '', null, null, null, null, 'Unsupported file type: .orc'""",
        "quoted_scan": """select doc_id, 'said "' || text || '"' as the_text, source from documents""",
        "json_document_scan": """select 'events' as "table", event_id as id, event_type || '|' || props as name, value as amount from events
union all select 'orders', o_orderkey, o_orderstatus || '|' || o_orderpriority, o_totalprice from orders
union all select 'customer', c_custkey, c_name || '|customer', c_acctbal from customer""",
        "json_keys_scan": JSON_KEYS,
        "encoded_scan": ENCODED,
        "parts_scan": """select o_orderkey, case when o_orderstatus = 'P' then '' else cast(o_totalprice as varchar) end as o_totalprice,
  case when o_orderstatus = 'P' then '' else o_orderpriority end as o_orderpriority, case when o_orderstatus = 'P' then cast(o_custkey as varchar) else '' end as o_custkey
from orders where o_orderstatus in ('F', 'O', 'P')""",
        "ragged_scan": RAGGED,
        "header_scan": "select p_partkey as part_key, p_name as name, p_brand as name_1, p_type as name_2, p_retailprice as groe from part",
        "numeric_threshold": threshold(),
        "named_strategies": strategies(),
        "custom_encoder": """with l as (select doc_id, i as letter, length(text) - length(replace(text, chr((97 + i)::int), '')) as n from documents, range(26) r(i)),
norms as (select doc_id, sqrt(sum(n * n)) as norm from l group by doc_id)
select doc_id, letter, round(cast(cast(n / norm as float) as double), 6) as weight from l join norms using (doc_id) where n > 0""",
        "dense_every": f"with {CENTROIDS}, {nearest('cent', 'given', 1000)} select query_id, doc_id, round(score, 4) as score, rank from dn",
        "bm25_odd_questions": f"""with {", ".join([DOC_TOKENS, POSTINGS, TERMS, questions(BENCHMARK + " union all select -1, '' union all select -2, '?!'"), BM25])} {SHOWN} from bm""",
        "table_prompts": f"""with documents as materialized (select chunk_id as doc_id, "table" as source, chunk_type, text from (
{auto_chunks([(t, t, COLUMNS[t][0][0], COLUMNS[t]) for t in ("nation", "supplier", "customer")])})),
{prompts(TABLE_QUESTIONS, "chunk_type")}""",
        "index_append": f"""with given as (select * from documents),
documents as materialized (select doc_id, case when lang in ('de', 'fr') then text || ' again again' else text end as text from given), {search}
select query_id, doc_id, round(score, 4) as score, rank from bm""",
        "memory_stream_batches": frames(4),
    }
