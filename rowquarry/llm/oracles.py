"""DuckDB SQL for the corpus queries that SQL can express: plain definitions, all pairs that share anything."""

from __future__ import annotations

from rowquarry.llm import placement

# Copies, links and reachability by definition: shingles of three words that two texts share are counted.
NEAR_DUPLICATES = r"""
with recursive worded as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
), sets as (
    select doc_id, list_distinct(case
        when len(w) = 0 then []::varchar[]
        when len(w) < 3 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as shingles
    from worded
), listed as (
    select doc_id, unnest(shingles) as shingle from sets
), shared as (
    select a.doc_id as a, b.doc_id as b, count(*) as n
    from listed a join listed b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all
), links as (
    select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b
    where 100 * n >= 85 * (len(x.shingles) + len(y.shingles) - n)
), reach as (
    select doc_id, doc_id as other from sets union select doc_id, b from reach join links on a = other
)
select s.doc_id, len(s.shingles)::bigint as n_shingles, min(r.other) as component_id, s.doc_id = min(r.other) as kept
from sets s join reach r on r.doc_id = s.doc_id group by s.doc_id, s.shingles
"""

NEAR_VECTORS = """
with recursive usable as (
    select vec_id, label, embedding::double[] as v from embeddings
    where label is not null and embedding is not null
      and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
      and list_dot_product(embedding::double[], embedding::double[]) > 0
), links as (
    select a.vec_id as a, b.vec_id as b from usable a join usable b
    on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
    where list_cosine_similarity(a.v, b.v) >= 0.98
), reach as (
    select vec_id, vec_id as other from embeddings union select vec_id, b from reach join links on a = other
), counted as (
    select a, count(*) as n from links group by a
)
select e.vec_id, coalesce(any_value(n), 0)::bigint as n_links, min(other) as component_id, e.vec_id = min(other) as kept
from embeddings e join reach r on r.vec_id = e.vec_id left join counted on a = e.vec_id group by e.vec_id
"""


# Toxic documents' pages and bad hosts by definition; a rule's length is that of host and path.
URL_FILTER = r"""
with placed as (
    select page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
    from pages
), labelled as (
    select host, path, toxic, quality from placed join labels on doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]+)', 1), '') as bigint)
), listed as (
    select host || path as key from labelled where toxic = 1
    union select host from labelled group by host having 2 * count(*) filter (toxic = 1 or quality = 0) > count(*)
), rules(host, path, verdict) as (
    values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), judged as (
    select p.*, (
        select {'rule': r.host || r.path, 'verdict': r.verdict} from rules r
        where (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
        order by length(r.host || r.path) desc limit 1) as fit
    from placed p
)
select page_id, host, path, fit.rule as rule,
    coalesce(fit.verdict, case when host <> '' and (host in (select key from listed) or host || path in (select key from listed)) then 'block' else 'allow' end) as verdict
from judged
"""

# Every phrase of one to three words is written out and counted.
COLLOCATIONS = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), worded as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), phrases as (
    select lang, s as size, unnest(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) as phrase
    from worded, (values (1), (2), (3)) t(s) where len(w) >= s
), counted as (
    select lang, size, phrase, count(*) as f from phrases group by all
), totals as (
    select lang, sum(f)::bigint as n from counted where size = 1 group by lang
), candidates as (
    select lang, size, phrase, f as a, string_split(phrase, ' ') as w from counted where size > 1 and f >= 10
), cuts as (
    select lang, phrase, a, w, unnest(range(1, size)) as k from candidates
), scored as (
    select c.lang, c.phrase, c.a, x.f as l, y.f as r, c.k, ((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f))::bigint as score
    from cuts c join counted x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.k], ' ')
    join counted y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), weakest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), kept as (
    select * from weakest s where not exists (
        select 1 from candidates x where x.lang = s.lang and x.size = 3 and 100 * x.a >= 50 * s.a
            and s.phrase in (x.w[1] || ' ' || x.w[2], x.w[2] || ' ' || x.w[3]))
), ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""

# CRC-32 byte by byte; near words by leaving out every letter.
SPELLING = r"""
with recursive steps as materialized (
    select list(list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t
    from range(256) g(i)
), cut as (
    select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[a-z\x{00C0}-\x{00FF}]+')) as run
    from documents
), runs as (
    select coalesce(doc_id::varchar, '') || ':' || run as named, run, count(*) as n from cut where length(run) >= 6 group by all
), hashed as (
    select run, n, xor(4294967295, list_reduce(
        [4294967295] || list_transform(range(1, 2 * strlen(named), 2), lambda i: ('0x' || substr(hex(encode(named)), i, 2))::bigint),
        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) as h
    from runs, steps
), vocabulary as (
    select case when h % 199 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word,
        sum(n)::bigint as n
    from hashed group by 1 having sum(n) >= 5 and length(word) >= 6
), shortened as (
    select word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) as rest from (select *, unnest(range(1, length(word) + 1)) as k from vocabulary)
), pairs as (
    select a.word, a.n, b.word as other, b.n as other_n from shortened a join shortened b on a.k = b.k and a.rest = b.rest and a.word <> b.word
    union select a.word, a.n, b.word, b.n from shortened a join vocabulary b on a.rest = b.word
    union select b.word, b.n, a.word, a.n from shortened a join vocabulary b on a.rest = b.word
), best as (
    select *, count(*) over (partition by word) as n_near, row_number() over (partition by word order by other_n desc, other) as at from pairs
), formed as (
    select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when other_n >= 5 * v.n then other end as form, case when other_n >= 5 * v.n then other_n end as form_n
    from vocabulary v left join best b on b.word = v.word and b.at = 1
), chain as (
    select word, word as root, 0 as step from formed
    union all select c.word, f.form, step + 1 from chain c join formed f on f.word = c.root where f.form is not null
)
select word, form, arg_max(root, step) as root, any_value(n) as n, any_value(n_near) as n_near, any_value(form_n) as form_n
from chain join formed using (word) group by word, form
"""


def sharding() -> str:
    """The lookup table itself is written out, two digits a slot; hashing and looking up are done in SQL."""
    owners = "".join(f"{int(k):02d}" for k in placement.lookup_table())
    return f"""
with hashed as (
    select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, chr(0) || 'null')), 1, 15))::bigint % {placement.SLOTS} as slot,
        coalesce(strlen(text), 0)::bigint as n_bytes
    from documents
)
select doc_id, slot, 'shard-0' || substr('{owners}', (2 * slot + 1)::bigint, 2) as shard, n_bytes from hashed
"""


def all_sql() -> dict[str, str]:
    """SQL by query name."""
    return {
        "op2_near_duplicates": NEAR_DUPLICATES, "op9_near_vectors": NEAR_VECTORS, "op10_sharding": sharding(),
        "op11_url_filter": URL_FILTER, "op12_collocations": COLLOCATIONS, "op13_spelling": SPELLING,
    }
