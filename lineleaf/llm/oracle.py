"""DuckDB SQL for the queries that SQL can express.

Byte-pair encodings (2, 8), the budget tree (4), the trained models (5, 10) have none; tests hold them against
the library, brute force or held-out labels.
"""

from __future__ import annotations

from . import quality

WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CHAT = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), ordered as (
  select *, row_number() over w as k, lag(role) over w as before,
    len(regexp_extract_all(text, '[<\[]\\*(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\]|END\])')) as escapes,
    len(regexp_extract_all(role, '[<\[]\\*(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|ROLE\]|/ROLE\]|END\])')) as role_escapes
  from rows window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(text) + escapes + case role when 'system' then 18 when 'user' then 15 when 'assistant' then 7
    else 18 + length(role) + role_escapes end) as bigint) as formatted_chars,
  bool_and(case when before is null then role in ('system', 'user') when before = 'system' then role = 'user'
    when before = 'user' then role = 'assistant' when before = 'assistant' then role = 'user' else false end) as valid
from ordered group by conv_id
"""

NGRAM_JOIN = f"""
with recursive words as (
  select doc_id, {WORDS.format(LOW.format("text"))} as w from documents
), grams as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [w]
    else list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) end) as g from words
), sizes as (select doc_id, count(*) as n from grams group by doc_id
), shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 90 * (p.n + q.n - c)
), reach as (
  select doc_id as x, doc_id as y from documents
  union select r.x, l.y from reach r join links l on r.y = l.x
)
select d.doc_id, coalesce(any_value(s.n), 0) as n_shingles, min(r.y) as component_id
from documents d join reach r on r.x = d.doc_id left join sizes s on s.doc_id = d.doc_id group by d.doc_id
"""

EMBEDDINGS = """
with recursive valid as (
  select vec_id, label, cast(embedding as double[]) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as x, b.vec_id as y from valid a join valid b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.98
), reach as (
  select vec_id as x, vec_id as y from embeddings union select r.x, l.y from reach r join links l on r.y = l.x
), least as (select x, min(y) as c from reach group by x
), counts as (select x, count(*) as n from links group by x)
select e.vec_id, coalesce(n, 0) as n_links, c as component_id, c = e.vec_id as kept
from embeddings e join least on least.x = e.vec_id left join counts on counts.x = e.vec_id
"""

QUALITY = rf"""
with docs as (
  select doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as text, {WORDS.format("text")} as w from documents
), windows as (
  select doc_id, i, w[i:i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from docs)
), repeated as (
  select doc_id, count(distinct i + k) as n from (
    select doc_id, i, unnest([0, 1, 2]) as k from windows
    qualify count(*) over (partition by doc_id, g) > 1
  ) group by doc_id
), lines as (
  select doc_id, host, trim(regexp_replace(regexp_replace({LOW.format("line")}, '[0-9]', '0', 'g'), '[ \t\n\x0b\x0c\r]+', ' ', 'g'), ' ') as line
  from (select doc_id, host, unnest(string_split(text, chr(10))) as line from docs)
), own as (
  select doc_id, host, line, cast(sum(length(line) - length(replace(line, ' ', '')) + 1) as bigint) as words from lines where line <> '' group by all
), frequent as (
  select host, line, min(doc_id) as first from own group by all having count(distinct doc_id) > {quality.MOST_DOCUMENTS}
), lost as (
  select doc_id, sum(words) as n from own join frequent using (host, line) where doc_id <> first group by doc_id
), duplicates as (
  select doc_id, count(*) - count(distinct line) as n
  from (select doc_id, unnest(string_split(text, chr(10))) as line from docs)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), base as (
  select d.doc_id, len(w) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    coalesce(u.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, cast(coalesce(l.n, 0) as bigint) as n_lost_words
  from docs d left join duplicates u using (doc_id) left join repeated r using (doc_id) left join lost l using (doc_id)
)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_lost_words <= {quality.MOST_LOST} * n_words as kept
from base
"""

SUFFIXES = """
with docs as (
  select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), places as (
  select doc_id, i, substr(h, 2 * i + 1, 2) as byte, case when 2 * (i + 50) <= length(h) then substr(h, 2 * i + 1, 100) end as s
  from (select doc_id, h, unnest(range(0, length(h) // 2)) as i from docs)
), firsts as (select s, min(doc_id) as first from places where s is not null group by s
), marked as (
  select p.doc_id, i, byte, max(coalesce(first < p.doc_id, false)) over (
    partition by p.doc_id order by i rows between 49 preceding and current row) as gone
  from places p left join firsts using (s)
), edges as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as starts from marked
), per as (
  select doc_id, cast(sum(gone::int) as bigint) as n_removed, cast(sum(starts::int) as bigint) as n_spans,
    coalesce(string_agg(byte, '' order by i) filter (where not gone), '') as kept
  from edges group by doc_id
)
select d.doc_id, length(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(kept, ''))) as kept_sha256
from docs d left join per using (doc_id)
"""

ORACLE_SQL = {
    "op1_chat_format": CHAT,
    "op3_ngram_join": NGRAM_JOIN,
    "op6_embedding_dedup": EMBEDDINGS,
    "op7_quality_rules": QUALITY,
    "op9_suffix_dedup": SUFFIXES,
}
