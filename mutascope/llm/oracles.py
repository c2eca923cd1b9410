"""DuckDB SQL for the queries that SQL can express: written from the result contracts, not from the operators."""

from __future__ import annotations

from mutascope.llm.licenses import PHRASES, TEMPLATES, THRESHOLD
from mutascope.llm.quality import Rules
from mutascope.llm.secrets import BASE, EXTRA, Rule

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _low(c: str) -> str:
    return f"translate(coalesce({c}, ''), '{_UPPER}', '{_LOWER}')"


def quality(r: Rules = Rules()) -> str:
    return rf"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{_SPACE}') as ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_SPACE}')) as ls from d),
g as (select rid, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] as gram
      from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w)),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) as c from g) where c > 1),
hit as (select rid, count(distinct i + k) as n from again, (values (0), (1), (2)) v(k) group by rid),
s as (select w.rid, doc_id, source, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
             len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(hit.n, 0) as n_repeat_words
      from w left join hit on w.rid = hit.rid),
f as (select *, n_words < {r.min_words} or 100 * n_repeat_words > {r.max_repeat_percent} * n_words as base_failed from s),
a as (select *, base_failed or 100 * n_symbols > {r.max_symbol_percent} * word_chars
             or 100 * n_dup_lines > {r.max_dup_line_per_100_words} * n_words
             or word_chars < {r.min_word_chars} * n_words or word_chars > {r.max_word_chars} * n_words as any_failed from f),
h as (select source, count(*) as n, sum(any_failed::int) as k from a where source is not null group by source),
m as (select sum(k) / sum(n) as m, sum(n) as nn, sum(n::double * n) as sq, count(*) as hs from h),
v as (select m, (sum(n * (k / n - m) * (k / n - m)) - (hs - 1) * m * (1 - m)) / nullif(nn - sq / nn, 0) as v from h, m group by m, nn, sq, hs),
p as (select source, case when v > 0 then (k + m * greatest(m * (1 - m) / v - 1, 0)) / (n + greatest(m * (1 - m) / v - 1, 0)) else m end
             > {r.max_rate} as poor from h, v)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (coalesce(poor, false) and any_failed) as kept, coalesce(poor, false) as host_poor
from a left join p on a.source = p.source"""


def contamination(width: int = 10) -> str:
    return rf"""
with b as (select coalesce(item_id::varchar, 'null') as item, regexp_extract_all({_low('text')}, '{_ALNUM}') as ws from benchmark),
p as (select distinct item, least({width}, len(ws)) as size, array_to_string(ws[i:i + least({width}, len(ws)) - 1], ' ') as win
      from (select *, unnest(range(1, greatest(len(ws) - {width} + 1, 1) + 1)) as i from b where len(ws) > 0)),
d as (select row_number() over () as rid, doc_id, regexp_extract_all({_low('text')}, '{_ALNUM}') as ws from documents),
q as (select rid, size, i, array_to_string(ws[i:i + size - 1], ' ') as win
      from (select rid, ws, size, unnest(range(1, len(ws) - size + 2)) as i from d, (select distinct size from p) where len(ws) >= size)),
m as (select q.rid, q.i, q.size, p.item from q join p on q.size = p.size and q.win = p.win),
n as (select rid, count(distinct k) as n_hit from (select rid, unnest(range(i, i + size)) as k from m) group by rid),
t as (select rid, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as h from (select distinct rid, item from m) group by rid)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       coalesce(h, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n on d.rid = n.rid left join t on d.rid = t.rid"""


def near_duplicates(width: int = 4, ratio: int = 80) -> str:
    """Every pair that shares a shingle, then components by repeated minima over the links."""
    return rf"""
with recursive d as (select doc_id, regexp_extract_all({_low('text')}, '{_SPACE}') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + {width - 1}], ' ') as g
      from (select doc_id, ws, unnest(range(1, greatest(len(ws) - {width - 1}, 1) + 1)) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select x.doc_id as a, y.doc_id as b, count(*) as k from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all),
e as (select a, b from c join n x on c.a = x.doc_id join n y on c.b = y.doc_id where 100 * k >= {ratio} * (x.n + y.n - k)),
l as (select a, b from e union all select b, a from e),
r as (select doc_id as node, doc_id as seen from d union select r.node, l.b from r join l on r.seen = l.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r.seen) as component_id, d.doc_id = min(r.seen) as kept
from d left join n on d.doc_id = n.doc_id join r on r.node = d.doc_id group by d.doc_id, n.n"""


def licences() -> str:
    base = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES)
    notices = ", ".join(f"('{label}', '{t}')" for label, t in TEMPLATES)
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all({_low('t')}, '{_ALNUM}') as ws from d),
p as (select label, string_split(phrase, ' ') as ps from (values {base}) v(phrase, label)),
b as (select rid, label, i - 1 as place from (select rid, ws, label, ps, unnest(range(1, len(ws) - len(ps) + 2)) as i from w, p)
      where ws[i:i + len(ps) - 1] = ps),
bb as (select rid, count(*) as n_base, min(place) as first_word, max(place) as last_word, list_distinct(list(label)) as base from b group by rid),
k as (select label, list_distinct(string_split(t, ' ')) as ts from (values {notices}) v(label, t)),
x as (select rid, list_distinct(regexp_extract_all({_low('line')}, '{_ALNUM}')) as block
      from (select rid, unnest(string_split(t, chr(10))) as line from d)),
o as (select rid, label, len(list_intersect(block, ts)) / len(ts) as c from x, k
      where len(list_intersect(block, ts)) >= ceil({THRESHOLD} * len(ts) - 1e-9)),
oo as (select rid, list_distinct(list(label)) as more, max(c) as best from o group by rid)
select doc_id, len(ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') as labels,
       case when n_base > 0 then 1.0::double else coalesce(best, 0.0)::double end as score
from w left join bb on w.rid = bb.rid left join oo on w.rid = oo.rid"""


def _re2(rule: Rule) -> str:
    """The pattern for DuckDB; case is spelled out, as its folding is Unicode's."""
    p = rule.pattern
    if rule.ignore_case:
        out, depth, k = "", 0, 0
        while k < len(p):
            c = p[k]
            if c == "\\":
                step = 4 if p[k + 1] == "x" else 2
                out, k = out + p[k:k + step], k + step
                continue
            depth += (c == "[") - (c == "]")
            out += f"[{c.lower()}{c.upper()}]" if c.isalpha() and not depth else c
            k += 1
        p = out
    return p.replace("'", "''")


def secrets() -> str:
    rules = BASE + EXTRA
    found = " union all ".join(
        f"select rid, {k} as k, '{r.kind}' as kind, {r.at_least} as least, regexp_extract_all(t, '{_re2(r)}', 0) as ms, "
        f"regexp_extract_all(t, '{_re2(r)}', {r.group}) as gs, regexp_split_to_array(t, '{_re2(r)}') as bs from d" for k, r in enumerate(rules))
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
f as ({found}),
m as (select rid, k, kind, least, ms[i] as m, gs[i] as g,
             coalesce(list_sum(list_transform(bs[1:i], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::bigint as a
      from (select *, unnest(range(1, len(ms) + 1)) as i from f)),
s as (select rid, k, kind, a, kind || ':' || a || ':' || (a + length(m)) as span from m where length(g) >= least),
t as (select rid, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
             count(*) filter (kind = 'hex') as n_hex,
             string_agg(span, ',' order by a, k) filter (k < {len(BASE)}) as base, string_agg(span, ',' order by a, k) as spans from s group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join t on d.rid = t.rid"""


def archived() -> str:
    """Base32 of the digest: five hexadecimal digits are four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    return f"""
with p as (select page_id, encode(coalesce(html, '')) as raw from pages),
d as (select page_id, octet_length(raw)::bigint as payload_bytes, sha1(raw) as hex from p),
w as (select hex, max(page_id) as last from d group by hex),
b as (select hex, last, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (5 * i + 1)::int, 5))::int) as fives from w),
e as (select hex, last, array_to_string(list_transform(range(0, 32), lambda j:
             substr('{letters}', (1 + ((fives[1 + j // 4] >> (15 - 5 * (j % 4))::int) & 31))::int, 1)), '') as payload_digest from b)
select page_id, payload_bytes, payload_digest, case when page_id is distinct from last then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from last then last end as refers_to
from d join e using (hex)"""


def filter_audit() -> str:
    """Every order applied to every document's failures, without the lattice."""
    letters = "values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)"
    names = ("a", "b", "c", "d", "e")
    tables = ", ".join(f"l {n}" for n in names)
    apart = " and ".join(f"{x}.f <> {y}.f" for i, x in enumerate(names) for y in names[i + 1:])
    return rf"""
with w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') as ws,
                  min(doc_id) over (partition by coalesce(text, '')) as first from documents),
m as (select doc_id, part, (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int
             + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::int
             + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as mask from w),
q as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
s as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
      from m left join q using (doc_id) group by all),
l(f, bit) as ({letters}),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order from {tables} where {apart}),
k as (select filter_order, unnest(range(1, 6))::int as step from o),
x as (select filter_order, step, bit, list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) as before
      from k join l on f = filter_order[step]),
r as (select part, filter_order, step, bit, coalesce(before, 0)::int as before from x, (select distinct part from s) p),
z as (select r.part, filter_order, step, bit,
             sum(n) filter (mask & (before + bit) = 0) as kept, sum(n) filter (mask & bit > 0 and mask & before = 0) as removed,
             sum(n) filter (mask & bit > 0 and mask & before > 0) as redundant, sum(n) filter (mask = bit) as unique_fails,
             sum(good) filter (mask & bit > 0 and mask & before = 0) as good_lost,
             sum(toxic) filter (mask & bit > 0 and mask & before = 0) as toxic_lost
      from s join r on s.part = r.part group by all)
select part, filter_order, step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
       coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
       coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
       (sum(coalesce(removed, 0)) over (partition by part, bit))::bigint as shapley
from z"""


def spelling(min_length: int = 6, min_count: int = 5, every: int = 199, ratio: int = 5) -> str:
    """Checksums by half bytes; near words by letters left out; forms followed recursively."""
    table = []
    for v in range(16):
        for _ in range(4):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        table.append(v)
    return rf"""
with recursive r as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as run from documents),
u as (select id, {_low('run')} as run, count(*) as c from r where length(run) >= {min_length} group by all),
h as (select run, c, hex(encode(id || ':' || run)) as x from u),
k as (select run, c, xor(list_reduce(list_concat([4294967295::ubigint], list_transform(range(0, length(x)),
             lambda i: (strpos('0123456789ABCDEF', x[1 + xor(i, 1)]) - 1)::ubigint)),
             lambda a, v: xor(a >> 4, ({table}::ubigint[])[(1 + (xor(a, v) & 15))::bigint])), 4294967295::ubigint)::bigint as h from h),
t as (select c, case when h % {every} = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from k),
w as (select word, sum(c)::bigint as n from t where length(word) >= {min_length} group by word having sum(c) >= {min_count}),
d as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select *, unnest(range(1, length(word) + 1)) as i from w)),
p as (select x.word as a, y.word as b, y.n as n from d x join d y on x.rest = y.rest and x.i = y.i and x.word <> y.word
      union select x.word, y.word, y.n from d x join w y on x.rest = y.word
      union select y.word, x.word, x.n from d x join w y on x.rest = y.word),
g as (select a, count(*) as n_near, max(n) as top from p group by a),
b as (select p.a, g.n_near, g.top, min(b) as best from p join g on p.a = g.a and p.n = g.top group by all),
f as (select word, n, coalesce(n_near, 0)::bigint as n_near, case when top >= {ratio} * n then best end as form, case when top >= {ratio} * n then top end as form_n
      from w left join b on w.word = b.a),
c as (select word, word as tip, 0 as depth from f union all select c.word, f.form, depth + 1 from c join f on c.tip = f.word where f.form is not null)
select f.word, f.form, z.root, f.n, f.n_near, f.form_n
from f join (select word, arg_max(tip, depth) as root from c group by word) z on f.word = z.word"""


ORACLES = {
    "op2_quality_rules": quality(),
    "op3_decontamination": contamination(),
    "op7_near_duplicates": near_duplicates(),
    "op8_licences": licences(),
    "op10_secrets": secrets(),
    "op11_warc": archived(),
    "op12_filter_audit": filter_audit(),
    "op13_spelling": spelling(),
}
