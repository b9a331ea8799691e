"""SQL (DuckDB) for the queries that SQL can express over whole tables."""

from __future__ import annotations

from . import licences, lines, quality, resample, search, warc


def queries_path(div: str, string: str) -> str:
    """SQL for a document's path: some documents lie at the top of their source, others up to three directories below."""
    level = lambda n: f"cast(doc_id {div} {n} as {string})"
    below = f"case when doc_id % 4 > 0 then concat({level(1000)}, '/') else '' end, case when doc_id % 4 > 1 then concat({level(100)}, '/') else '' end, case when doc_id % 4 > 2 then concat({level(10)}, '/') else '' end"
    return f"concat(coalesce(source, ''), '/', {below}, cast(doc_id as {string}))"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


def _words(text: str, separators: str) -> str:
    return f"list_filter(string_split_regex({text}, '{separators}+'), lambda w: w <> '')"


SEPARATORS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]"

OP4 = f"""
with d as (select doc_id, {_words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')", SEPARATORS)} as w from documents),
i as (select cast(item_id as varchar) as item, {_words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')", SEPARATORS)} as w from benchmark),
n as (select item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as k from i where len(w) > 0),
win as (select distinct item, array_to_string(list_slice(w, k, k + 9), ' ') as win, least(len(w), 10) as size from n),
sizes as (select distinct size from win),
p as (select doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) as k from d, sizes where len(w) >= size),
h as (select doc_id, k, win.size, item from (select doc_id, k, size, array_to_string(list_slice(w, k, k + size - 1), ' ') as win from p) q join win on win.win = q.win and win.size = q.size),
c as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(generate_series(k, k + size - 1)) as pos from h) group by doc_id),
s as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from h group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join s using (doc_id)
"""

SPACE = r"[\x20\x09-\x0D]"


def _only(keep: str) -> str:
    return f"length(regexp_replace(t, '[^{keep}]+', '', 'g'))"


_CLASSES = [r"\x20\x09-\x0D", r"\p{Lu}", r"\p{Nd}", quality.SYMBOLS, r"!\"''()+,\-./:;=?@\[\\\]^_`{}~"]


def _entropy(x: str) -> str:
    return f"list_sum(list_transform({x}, lambda v: case when v > 0 then -v * log2(v) else 0 end))"


def _distance(p: str, q: str) -> str:
    a, b = (f"list_transform({x}, lambda v: v / list_sum({x}))" for x in (p, q))
    mean = f"list_transform(list_zip({a}, {b}), lambda z: (z[1] + z[2]) / 2)"
    return f"round(sqrt(greatest(0, {_entropy(mean)} - ({_entropy(a)} + {_entropy(b)}) / 2)), 6)"


OP7 = f"""
with d as (select doc_id, lang, coalesce(text, '') as t, {_words("coalesce(text, '')", SPACE)} as w from documents),
h as (select *, [{", ".join(_only(c) for c in _CLASSES)}] as cls, list_transform({_list(quality.COMMON_WORDS)}, lambda c: len(list_filter(w, lambda x: x = c))) as common from d),
f as (select *, list_append(cls, length(t) - list_sum(cls)) as classes, list_append(common, len(w) - list_sum(common)) as words from h),
rc as (select lang, list(v order by i) as classes from (select lang, i, sum(classes[i]) as v from f, (select unnest(generate_series(1, 6)) as i) group by all) group by lang),
rw as (select lang, list(v order by i) as words from (select lang, i, sum(words[i]) as v from f, (select unnest(generate_series(1, {len(quality.COMMON_WORDS) + 1})) as i) group by all) group by lang),
g as (select doc_id, k, array_to_string(list_slice(w, k, k + 4), ' ') as gram from (select doc_id, w, unnest(generate_series(1, len(w) - 4)) as k from d where len(w) >= 5)),
twice as (select doc_id, gram from g group by all having count(*) > 1),
r as (select doc_id, count(distinct pos) as n from (select doc_id, unnest(generate_series(k, k + 4)) as pos from g join twice using (doc_id, gram)) group by doc_id),
l as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by doc_id),
b as (select f.*, len(w) as n_words, length(array_to_string(w, '')) as word_chars, cls[4] as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, rc.classes as ref_classes, rw.words as ref_words,
             len(w) < 10 or 100 * coalesce(r.n, 0) > 20 * len(w) as base_failed
      from f left join l using (doc_id) left join r using (doc_id) left join rc on rc.lang is not distinct from f.lang left join rw on rw.lang is not distinct from f.lang),
m as (select *, not base_failed and length(t) >= {quality.LEAST_CHARS} and len(w) >= {quality.LEAST_WORDS} as measured from b),
v as (select *, case when measured then {_distance("classes", "ref_classes")} end as class_distance, case when measured then {_distance("words", "ref_words")} end as word_distance from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
       not base_failed and not (coalesce(class_distance, 0) > {quality.FAR_CLASSES} or (coalesce(class_distance, 0) > {quality.ODD_CLASSES} and coalesce(word_distance, 0) > {quality.ODD_WORDS})) as kept, class_distance, word_distance
from v
"""

OP9 = f"""
with p as (select page_id, coalesce(html, '') as html from pages), d as (select page_id, octet_length(encode(html)) as n, sha256(html) as digest from p),
f as (select digest, min(page_id) as first from d where n >= {warc.LEAST_REVISIT} group by digest)
select page_id, cast(n as bigint) as payload_bytes, d.digest as payload_digest, case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from first then first end as refers_to
from d left join f using (digest)
"""

OP10 = f"""
with t as (select doc_id, text, string_split(coalesce(text, ''), chr(10)) as ls from documents), x as (select doc_id, unnest(generate_series(1, len(ls))) as line, unnest(ls) as raw from t),
k as (select doc_id, line, list_transform({_words("raw", SPACE)}, lambda w: case when regexp_matches(w, '[0-9]') then '<*>' else w end) as w from x),
p as (select doc_id, line, md5(array_to_string(list_slice(w, 1, {lines.DEPTH}), ' ')) as lead, array_to_string(w, ' ') as s, len(w) || ' ' || array_to_string(list_slice(w, 1, {lines.DEPTH}), ' ') as g, w from k where len(list_filter(w, lambda v: v <> '<*>')) > 0),
dist as (select distinct s, g, w from p where len(w) > {lines.DEPTH}), sz as (select g, count(*) as n_lines from dist group by g having count(*) >= {lines.LEAST_DOCS}), dl as (select dist.*, n_lines from dist join sz using (g)),
cell as (select g, n_lines, unnest(generate_series(1, len(w))) as pos, unnest(w) as token from dl),
often as (select g, pos, token from cell where pos > {lines.DEPTH} group by g, n_lines, pos, token having count(*) > n_lines * {lines.SPLIT} and count(*) >= {lines.LEAST_DOCS}),
cut as (select dl.s, dl.w, dl.g || '|' || coalesce(string_agg(case when dl.w[often.pos] = often.token then often.pos || ' ' || often.token end, ' ' order by often.pos, often.token), '') as g from dl join often using (g) group by dl.s, dl.w, dl.g),
sz2 as (select g, count(*) as n_lines from cut group by g having count(*) >= {lines.LEAST_DOCS}),
cell2 as (select g, n_lines, len(w) as n, unnest(generate_series(1, len(w))) as pos, unnest(w) as token from cut join sz2 using (g)),
vote as (select g, pos, token, n_lines, n from cell2 where pos > {lines.DEPTH} group by all having count(*) > n_lines * {lines.CONSTANT} and count(*) >= {lines.LEAST_DOCS}),
leaf as (select g, count(*) as held from vote group by g, n having count(*) > (n - {lines.DEPTH}) * {lines.ALIKE}),
agree as (select s, g from (select s, cut.g, any_value(leaf.held) as held, count(*) as same from cut join leaf using (g) join vote on vote.g = cut.g and cut.w[vote.pos] = vote.token group by s, cut.g) where same = held),
named as (select doc_id, line, case when agree.s is not null then 'leaf ' || agree.g else 'line ' || p.s end as template from p left join agree on agree.s = p.s),
kinds as (select doc_id, unnest([1, 2, 3, 4]) as e, unnest([min(lead[:16]), max(lead[:16]), min(lead[17:]), max(lead[17:])]) as kind from p group by doc_id), once as (select distinct template, doc_id from named),
recur as (select template from once group by template having count(*) >= {lines.LEAST_DOCS}),
n as (select template, e, kind, count(*) as n from once join recur using (template) join kinds on kinds.doc_id is not distinct from once.doc_id group by template, e, kind),
many as (select template, min((doc_id, line)) as first from named join (select template from n group by template having sum(n) * sum(n) / sum(n * n) / 4 >= {lines.LEAST_KINDS}) using (template) group by template),
gone as (select doc_id, list(line) as gone from named join many using (template) where (doc_id, line) <> first group by doc_id),
r as (select t.*, gone from t left join gone using (doc_id))
select doc_id, case when text is null then 0 else cast(len(ls) as bigint) end as n_lines, cast(coalesce(len(gone), 0) as bigint) as n_dropped,
       case when gone is null then text else array_to_string(list_transform(list_filter(list_zip(ls, generate_series(1, len(ls))), lambda z: not list_contains(gone, z[2])), lambda z: z[1]), chr(10)) end as text
from r
"""

BETWEEN = licences.BETWEEN


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{BETWEEN}'), lambda w: w <> '')"


def _opening(w: str) -> str:
    return f"list_transform(list_slice({w}, 1, {licences.OPENING_WORDS}), lambda x: '{licences.OPENS}' || x)"


_N = len(licences.TEMPLATES) + len(licences.OPENINGS)

OP5 = f"""
with tpl as (select * from (values {", ".join(f"({i}, {_text(k)}, {_text(v)})" for i, (k, v) in enumerate([*licences.TEMPLATES, *licences.OPENINGS]))}) x(template, licence, t)),
tf as (select template, licence, token, 1 + ln(count(*)) as tf from (select template, licence, unnest(case when template < {len(licences.TEMPLATES)} then {_tokens("t")} else {_opening(_tokens("t"))} end) as token from tpl) group by all),
idf as (select token, ln({1 + _N} / (1 + count(*))) + 1 as idf from tf group by token), tw as (select template, licence, tf.token, tf * idf as w from tf join idf using (token)),
tn as (select template, sqrt(sum(w * w)) as norm from tw group by template), vec as (select template, licence, token, w / norm as weight from tw join tn using (template)),
d as (select doc_id, {queries_path("//", "varchar")} as path, coalesce(text, '') as t from documents),
e as (select *, regexp_replace(path, '/?[^/]*$', '') as dir from d),
part as (select doc_id, 0 as kind, t from d union all select doc_id, 2, string_split_regex(t, '\\n[\\x20\\x09-\\x0D]*\\n')[1] from d union all select doc_id, 3, unnest(string_split(t, chr(10))) from d),
p0 as (select doc_id, kind, {_tokens("t")} as w from part), p1 as (select * from p0 union all select doc_id, 1, {_opening("w")} from p0 where kind = 0 and len(w) >= {licences.LEAST_FILE_WORDS}),
p as (select doc_id, kind, w, array_to_string(w, ' ') as u from p1),
nt as (select u, token, 1 + ln(count(*)) as tf from (select u, unnest(w) as token from (select distinct u, w from p)) group by all),
nw as (select u, nt.token, tf * coalesce(idf, ln({(1 + _N) / 2}) + 1) as w from nt left join idf using (token)), nn as (select u, sqrt(sum(w * w)) as norm from nw group by u),
dot as (select u, template, licence, sum(w * weight) as dot from nw join vec using (token) group by all),
near as (select u, licence, round(dot / norm, 6) as cosine from dot join nn using (u) where round(dot / norm, 6) >= {licences.LEAST_COSINE}),
best as (select u, licence, cosine from (select *, row_number() over (partition by u order by cosine desc, licence) as rank from near) where rank = 1),
met as (select doc_id, kind, licence, cosine, licence = '{licences.WEAK}' as weak from p join best using (u)),
o as (select *, row_number() over (partition by doc_id order by weak, kind, cosine desc, licence) as rank from met),
c as (select doc_id, sum(case when kind = 3 then 1 else 0 end) as n_notices, bool_or(kind <= 1) as is_file from met group by doc_id),
f as (select e.doc_id, path, dir, o.licence, o.cosine, o.weak, o.kind, coalesce(n_notices, 0) as n_notices, coalesce(is_file, false) as is_licence_file from e left join c using (doc_id) left join o on o.doc_id = e.doc_id and o.rank = 1),
s as (select dir, licence, cosine from (select *, row_number() over (partition by dir order by weak, kind, cosine desc, licence) as rank from f where is_licence_file) where rank = 1),
u as (select doc_id, s.dir, s.licence, s.cosine, row_number() over (partition by doc_id order by length(s.dir) desc) as rank from f join s on f.licence is null and (s.dir = '' or f.dir = s.dir or starts_with(f.dir, s.dir || '/')))
select f.doc_id, f.path, coalesce(f.licence, u.licence) as licence, coalesce(f.cosine, u.cosine) as cosine, cast(n_notices as bigint) as n_notices, is_licence_file, u.dir as inherited_from
from f left join u on u.doc_id = f.doc_id and u.rank = 1
"""

_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP12 = f"""
with d as (select row_number() over () as r, doc_id, {_words(_LOWER, SEPARATORS)} as w from documents),
g as (select cast(count(*) as bigint) as n_all, cast(sum(len(w)) as bigint) as l_all from d where len(w) > 0),
i as (select distinct item_id, unnest({_words(_LOWER, SEPARATORS)}) as term from benchmark),
tf as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(w) as n, unnest(w) as term from d) semi join i using (term) group by all),
df as (select term, cast(floor(1000 * ln((2 * n_all + 2)::double / (2 * count(*) + 1))) as bigint) as wt from tf, g group by term, n_all),
h as (select r, doc_id, term, wt * ((1000000000 * tf) // (1000 * tf + 8 * (100 - {search.LENGTH_PERCENT} + ({search.LENGTH_PERCENT} * n * n_all) // l_all))) as hit from tf join df using (term), g),
s as (select item_id, r, doc_id, cast(sum(hit) as bigint) as score from h join i using (term) group by all having sum(hit) > 0),
k as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from s)
select * from k where rank <= {search.TOP}
"""

# CRC-32 by its definition: a table of 256 values, then a word's bytes, each distinct word once
OP13 = f"""
with recursive c as (select unnest(generate_series(0, 255)) as b), bit as (
    select b, b as v, 0 as k from c union all select b, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from bit where k < 8),
crc as (select list(v order by b) as t from bit where k = 8),
d as (select row_number() over () as r, doc_id, {_words(_LOWER, SEPARATORS)} as w from documents), q as (select {_words(_LOWER, SEPARATORS)} as w from benchmark),
u as (select r, unnest(w) as word from d union all select null, unnest(w) from q),
x as (select word, hex(encode(word)) as h from (select distinct word from u)),
y as (select word, list_transform(generate_series(1, length(h) // 2), lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i - 1]) - 1) + instr('0123456789ABCDEF', h[2 * i]) - 1) as bytes from x),
f as (select word, xor(list_reduce(list_prepend(4294967295::bigint, bytes::bigint[]), lambda v, z: xor(v >> 8, t[xor(v & 255, z) + 1])), 4294967295) % {resample.BUCKETS} as bucket from y, crc),
n as (select bucket, count(r) as s, count(*) - count(r) as t from u join f using (word) group by bucket), total as (select sum(s) as s_all, sum(t) as t_all from n),
gain as (select bucket, cast(floor(1000 * ln(((t + 1) * (s_all + {resample.BUCKETS}))::double / ((s + 1) * (t_all + {resample.BUCKETS}))::double)) as bigint) as gain from n, total),
wt as (select r, count(*) as n_features, sum(gain) as weight from u join f using (word) join gain using (bucket) where r is not null group by r),
v as (select d.r, doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('{resample.SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint as h from d left join wt using (r)),
o as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) as bigint) as score from v),
p as (select *, row_number() over (partition by n_features >= {resample.LEAST_WORDS} order by score desc, doc_id, r) as place, count(*) over (partition by n_features >= {resample.LEAST_WORDS}) as able from o)
select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score,
       case when n_features >= {resample.LEAST_WORDS} and place <= {resample.PERCENT} * able // 100 then place end as rank from p
"""

ORACLE_SQL = {"op5_licences": OP5, "op4_decontaminate": OP4, "op7_quality": OP7, "op9_warc": OP9, "op10_lines": OP10, "op12_search": OP12, "op13_resample": OP13}
