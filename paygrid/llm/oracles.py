"""DuckDB SQL for the queries that SQL can express: whole tables, plain
forms (all windows, all pairs that share a shingle), no code shared."""

from __future__ import annotations

from paygrid.llm import licenses, secrets

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '')"


def _split_by(pattern: str) -> str:
    """Pieces between and of the matches: even places are matches."""
    return f"string_split(regexp_replace(t, '{pattern}', chr(57344) || '\\0' || chr(57344), 'g'), chr(57344))"


_RULES = [
    ("assign", "(?i:(password|passwd|secret|token|api_?key))[\"'']? *[:=] *[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
    *[(r.kind, r.regex, 0, 1) for r in secrets.EXTRA],
]
_FOUND = " union all ".join(
    f"select doc_id, {k} as rank, '{kind}' as kind, s, s + length(p[i]) as e from (select doc_id, p, i, "
    f"coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0)::bigint as s from (select doc_id, p, unnest(range(2, len(p), 2)) as i "
    f"from (select doc_id, {_split_by(rx)} as p from d))) where length(regexp_extract(p[i], '{rx}', {group})) >= {least}"
    for k, (kind, rx, group, least) in enumerate(_RULES))
SECRETS = f"""with d as (select doc_id, replace(coalesce(text, ''), chr(57344), chr(57345)) as t from documents),
f as ({_FOUND}),
g as (select doc_id, count(*) filter (where rank = 0) as n_assign, count(*) filter (where rank = 1) as n_access,
  count(*) filter (where rank = 2) as n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (where rank < 3), '') as base,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans from f group by 1)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)"""

PAGES = """with a as (select page_id, url, regexp_replace(coalesce(html, ''), '(?s)^.*<article>(.*?)(</article>|<footer).*$', '\\1') as h from pages),
b as (select page_id, url, replace(replace(replace(replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'),
  '&quot;', '"'), '&amp;', '&') as t from a),
c as (select page_id, url, trim(regexp_replace(t, '\\s+', ' ', 'g')) as text from b)
select page_id, url, text, length(text)::bigint as n_chars from c"""

JACCARD = f"""with d as (select doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
e as (select a, b from l union all select b, a from l),
r as (with recursive r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) select a, min(b) as m from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) as component_id
from d left join n on n.doc_id = d.doc_id left join r on r.a = d.doc_id"""

REPEATS = f"""with d as (select doc_id, {_WORDS} as w from documents),
g as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) as k from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
t as (select k from g group by 1 having count(*) > 1),
c as (select distinct doc_id, unnest(range(i, i + 35)) as p from g where k in (select k from t)),
v as (select d.doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d),
o as (select v.doc_id, count(c.p) as n_removed, coalesce(string_agg(x, ' ' order by v.p) filter (where c.p is null), '') as kept
  from v left join c on c.doc_id = v.doc_id and c.p = v.p group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join o using (doc_id)"""

RULES = f"""with d as (select doc_id, coalesce(text, '') as t, {_WORDS} as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
u as (select doc_id, k from g group by 1, 2 having count(*) > 1),
c as (select doc_id, count(distinct p) as n from (select g.doc_id, unnest(range(i, i + 8)) as p from g join u on u.doc_id = g.doc_id and u.k = g.k) group by 1),
b as (select d.doc_id, t, w, len(w)::bigint as n_words, length(regexp_replace(t, '[ \\t\\n\\x0b\\f\\r]', '', 'g'))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0b\\f\\r]')) as lines, coalesce(c.n, 0) as n_repeat_words
  from d left join c using (doc_id)),
f as (select *, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 100 * n_symbols > 30 * n_words or word_chars > 15 * n_words or word_chars < 2 * n_words
    or 3 * n_dup_lines > len(string_split(t, chr(10))) + 2
    or 2 * length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) > length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g'))
    or 2 * (length(t) - length(regexp_replace(t, '[!?]', '', 'g'))) > n_words
    or case when n_words <= 4000 then 100 * len(list_distinct(w)) < 6 * n_words
       else 10 * len(list_distinct(w))::bigint * len(list_distinct(w)) < 144 * n_words end) as kept from f"""


def _folded(text: str) -> str:
    return (f"list_filter(string_split_regex(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            "'[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')")


def _template(k: int, t: licenses.Template) -> str:
    text = t.text.replace("'", "''")
    return f"({k}, '{t.label}', {str(t.phrase).lower()}, '{text}')"


_RUNS = "select {0}, k, i, array_to_string(w[i + 1:i + k], ' ') as g from (select *, unnest(range(0, greatest(len(w) - k + 1, 0))) as i from {1})"
LICENSES = f"""with t as (select template, label, phrase, {_folded("text")} as w, if(phrase, {licenses.SHORT}, {licenses.LONG}) as k
  from (values {", ".join(_template(k, t) for k, t in enumerate((*licenses.PHRASES, *licenses.TEXTS)))}) as v(template, label, phrase, text)),
tr as ({_RUNS.format("template, label, phrase, len(w) as words, len(w) - k + 1 as runs", "t")}),
d as (select row_number() over () as key, doc_id, {_folded("text")} as w from documents),
dr as ({_RUNS.format("key", f"(select *, unnest([{licenses.SHORT}, {licenses.LONG}]) as k from d)")}),
v as (select dr.key, template, label, phrase, words, runs, dr.i - tr.i as diagonal, count(*) as votes, min(dr.i) as i0, max(dr.i) as i1,
  min(tr.i) as j0 from dr join tr on dr.k = tr.k and dr.g = tr.g group by all),
n as (select *, case when abs(diagonal - lag(diagonal) over o) <= {licenses.DRIFT} and i0 - lag(i1) over o <= {licenses.GAP}
  and j0 > lag(j0) over o then 0 else 1 end as fresh from v where not phrase window o as (partition by key, template order by i0, j0, diagonal)),
m as (select key, label, words, runs, sum(votes) as votes, min(i0) as i0, max(i1) as i1 from (select *,
  sum(fresh) over (partition by key, template order by i0, j0, diagonal) as part from n) group by key, template, label, words, runs, part),
f as (select key, label, true as phrase, diagonal as lo, 1.0::double as score from v where phrase and votes = runs
  union all select key, label, false, i0, least(1.0, round(votes / runs, 6))::double from m
  where votes >= {licenses.SHARE} * runs and i1 + {licenses.LONG} - i0 <= {licenses.STRETCH} * words),
s as (select key, count(*) filter (where phrase) as n_base, min(lo) filter (where phrase) as first_word, max(lo) filter (where phrase) as last_word,
  string_agg(distinct label, ',' order by label) filter (where phrase) as base_labels, string_agg(distinct label, ',' order by label) as labels,
  max(score) as score from f group by key)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score from d left join s using (key)"""
