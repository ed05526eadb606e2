"""DuckDB SQL for the rows of the training-data queries that SQL can express."""

from __future__ import annotations

from vitalgrid.llm.quality_rules import RULES, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quality(source: str = "documents") -> str:
    """Every column of ``source`` with the measures, base_failed and kept."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    failed = " or ".join(r.sql() for r in RULES)
    return f"""
    with q_words as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w, coalesce(text, '') as t from {source}),
    q_gram as (select doc_id, unnest(range(1, len(w) - 3)) as p, w from q_words where len(w) > 5),
    q_key as (select doc_id, p, array_to_string(list_slice(w, p, p + 4), ' ') as g from q_gram),
    q_dup as (select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, g) as c from q_key) where c > 1),
    q_cov as (select doc_id, count(distinct p + k)::bigint as n from q_dup, (select unnest(range(0, 5)) as k) group by doc_id),
    q_line as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_WS}) <> '') as l from q_words),
    q_measure as (
      select q_words.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, len(l)::bigint as n_lines,
        coalesce(q_cov.n, 0)::bigint as n_repeat_words,
        (length(t) - length(replace(t, '!', '')))::bigint as n_shouts,
        len(list_filter(w, lambda x: x in ({stop})))::bigint as n_stop_words
      from q_words join q_line using (doc_id) left join q_cov using (doc_id)),
    q_judged as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed, ({failed}) as rule_failed from q_measure)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rule_failed as kept from q_judged"""


def lines(source: str = "documents", tag: str = "") -> str:
    """doc_id, text without repeated lines, n_lines, n_dropped."""
    return f"""
    with l_split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from {source}),
    l_line as (select doc_id, unnest(l) as line, unnest(range(0, len(l))) as i from l_split),
    l_key as (select *, {_LOW(f"trim(line, {_WS})")} as k from l_line),
    l_rep as (select k, max(doc_id) as last from l_key where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
    l_mark as (select l_key.*, l_rep.k is not null and doc_id <> last as lost from l_key left join l_rep on l_key.k = l_rep.k)
    select doc_id, count(*)::bigint as n_lines, count(*) filter (lost)::bigint as n_dropped,
      coalesce(string_agg(line, chr(10) order by i) filter (not lost), '') as text from l_mark group by doc_id"""


def components(source: str = "documents") -> str:
    """doc_id, n_shingles, component_id of near-duplicate components."""
    return f"""
    with recursive c_words as (select doc_id, regexp_extract_all({_LOW("coalesce(text, '')")}, '{_WORD}') as w from {source}),
    c_set as materialized (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) end as s from c_words),
    c_tok as materialized (select doc_id, len(s) as n, unnest(s) as t from c_set),
    c_pair as materialized (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i
      from c_tok a join c_tok b on a.t = b.t and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
    c_link as materialized (select a, b from c_pair where 100 * i >= 80 * (na + nb - i) union select b, a from c_pair where 100 * i >= 80 * (na + nb - i)),
    c_reach(a, b) as (select a, b from c_link union select r.a, l.b from c_reach r join c_link l on r.b = l.a),
    c_min as (select a, min(b) as m from c_reach group by a)
    select doc_id, len(s)::bigint as n_shingles, least(doc_id, coalesce(m, doc_id)) as component_id from c_set left join c_min on doc_id = a"""


OP3 = """
with r as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
s as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from r),
u as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from s),
rules(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best as (select page_id, arg_max(h || p, length(h) + length(p)) as rule, arg_max(v, length(h) + length(p)) as verdict
  from u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select u.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from u left join best on u.page_id = best.page_id"""

OP5 = """
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, p.payload_digest, case when first is not null and first <> page_id then 'revisit' else 'response' end as record_type,
  case when first is not null and first <> page_id then first end as refers_to
from p left join f on p.payload_digest = f.payload_digest and payload_bytes >= 100"""

OP1 = """
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
s as (select doc_id, p, b[p:p + 49] as g from (select doc_id, b, unnest(range(1, octet_length(b) - 48)) as p from d)),
f as (select g, min(doc_id) as first from s group by g),
w as (select doc_id, p, case when p - lag(p) over (partition by doc_id order by p) <= 50 then 0 else 1 end as fresh from s join f using (g) where first < doc_id),
n as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as run from w),
r as (select doc_id, run, min(p) as a, max(p) + 49 as z from n group by doc_id, run),
k as (select doc_id, coalesce(lag(z) over (partition by doc_id order by a), 0) + 1 as x, a - 1 as y from r
  union all select d.doc_id, coalesce(max(z), 0) + 1, any_value(octet_length(b)) from d left join r on d.doc_id = r.doc_id group by d.doc_id),
t as (select k.doc_id, unhex(coalesce(string_agg(hex(b[x:y]), '' order by x) filter (y >= x), '')) as kept from k join d on k.doc_id = d.doc_id group by k.doc_id),
c as (select doc_id, sum(z - a + 1)::bigint as n_removed, count(*)::bigint as n_spans from r group by doc_id)
select d.doc_id, octet_length(b)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(kept) as kept_sha256
from d join t on d.doc_id = t.doc_id left join c on d.doc_id = c.doc_id"""

_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP9 = f"""
with d as (select doc_id, regexp_extract_all({_LOW("coalesce(text, '')")}, '{_TERM}') as w from documents),
i as (select item_id, regexp_extract_all({_LOW("coalesce(text, '')")}, '{_TERM}') as w from benchmark),
x as (select item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') as g from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from i where len(w) > 0)),
m as (select distinct n from x),
y as (select doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d cross join m where len(w) >= n)),
h as (select distinct doc_id, p, y.n as n, item_id from y join x on y.n = x.n and y.g = x.g),
c as (select doc_id, count(distinct q)::bigint as n_hit from (select doc_id, unnest(range(p, p + n)) as q from h) group by doc_id),
o as (select doc_id, count(*)::bigint as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct doc_id, item_id::varchar as item_id from h) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c on d.doc_id = c.doc_id left join o on d.doc_id = o.doc_id"""

# crc32 (reflected polynomial 0xEDB88320): a table of 256 entries made by the rule, then a fold over the bytes.
_CRC_TABLE = """crc_table as materialized (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as crc_of)"""
_crc = lambda codes: f"xor(list_reduce({codes}, lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
_bytes = lambda s: f"flatten(list_transform(string_split({s}, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [192 + (unicode(x) >> 6)::bigint, 128 + (unicode(x) & 63)::bigint] end))"

# A run shows as a stretch of places whose 6 words are those q places on.
OP12 = f"""
with {_CRC_TABLE},
a as (select doc_id, {_crc(_bytes("doc_id::varchar"))} as h, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents, crc_table),
b as (select doc_id, h % 10 = 0 and len(w) > 0 as planted, w, len(w) as n, (h // 10) % greatest(len(w), 1) as a, h // 10 as g from a),
d as materialized (select doc_id, case when planted then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else w end as w from b),
k as materialized (select doc_id, p, array_to_string(list_slice(w, p + 1, p + 6), ' ') as g from (select doc_id, w, unnest(range(0, len(w) - 5)) as p from d where len(w) >= 12)),
e as (select x.doc_id, x.p, y.p - x.p as q from k x join k y on x.doc_id = y.doc_id and x.g = y.g and x.p < y.p),
s as (select doc_id, q, p, p - row_number() over (partition by doc_id, q order by p) as island from e),
r as (select doc_id, min(p) as start, max(p) + 6 + q - min(p) as length, q from s group by doc_id, q, island),
v as materialized (select doc_id, start, length, min(q) as period from r where length >= greatest(12, 2 * q) group by doc_id, start, length),
o as (select doc_id, count(*)::bigint as n_runs, arg_min({{'s': start, 'l': length, 'q': period}}, (-length, start, period)) as best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from v group by doc_id),
x as (select distinct doc_id, unnest(range(start + period, start + length)) as p from v),
z as (select doc_id, p, w[p + 1] as word from (select doc_id, w, unnest(range(0, len(w))) as p from d)),
c as (select z.doc_id, string_agg(word, ' ' order by z.p) as collapsed from z anti join x on z.doc_id = x.doc_id and z.p = x.p group by z.doc_id)
select d.doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.s::bigint as start, best.l::bigint as length, best.q::bigint as period, (best.l * 1000 // best.q)::bigint as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(collapsed, '')) as collapsed_sha256
from d left join o on d.doc_id = o.doc_id left join c on d.doc_id = c.doc_id"""

# One edit: the same remainder without the same place (a replaced letter), or a remainder that is a word (a letter more or less).
OP13 = f"""
with recursive {_CRC_TABLE},
r as (select doc_id, {_LOW("unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+'))")} as run from documents),
s as (select doc_id, run, count(*) as n from r group by doc_id, run),
h as (select run, n, {_crc(_bytes("doc_id || ':' || run"))} as h from s, crc_table),
t as (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h),
w as materialized (select word, sum(n)::bigint as n from t where length(word) >= 7 group by word having sum(n) >= 2),
d as materialized (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from w)),
p as materialized (select x.word as a, y.word as b from d x join d y on x.rest = y.rest and x.i = y.i and x.word <> y.word
  union select word, rest from d where rest in (select word from w) union select rest, word from d where rest in (select word from w)),
m as (select a, count(*)::bigint as n_near, arg_min({{'o': b, 'n': n}}, (-n, b)) as best from p join w on w.word = b group by a),
f as materialized (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when best.n >= 10 * w.n then best.o end as form, case when best.n >= 10 * w.n then best.n end as form_n from w left join m on w.word = a),
c as (select word, word as at from f union all select c.word, form from c join f on c.at = f.word where form is not null)
select f.word, f.form, e.at as root, f.n, f.n_near, f.form_n::bigint as form_n from f join (select c.word, c.at from c join f on c.at = f.word where f.form is null) e on e.word = f.word"""

ORACLE_SQL = {
    "op13_spelling_variants": OP13,
    "op12_periodic_runs": OP12,
    "op1_suffix_dedup": OP1,
    "op9_decontaminate": OP9,
    "op2_jaccard_join": components(),
    "op3_url_filter": OP3,
    "op5_warc": OP5,
    "op6_line_dedup": f"select doc_id, n_lines, n_dropped, sha256(text) as kept_sha256 from ({lines()})",
    "op8_quality_rules": quality(),
}
