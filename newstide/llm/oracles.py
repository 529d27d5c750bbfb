"""DuckDB SQL that states the rows of those queries that SQL can express."""

from __future__ import annotations

from newstide.llm.quality import CLASSES, VOCABULARY, Rules

SPLIT = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def near_dups() -> str:
    """All pairs that share a shingle, their exact similarity, and what links reach."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""with recursive w as (select doc_id, {SPLIT.format(lower)} as ws from documents),
sets as (select doc_id, case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as s from w),
g as (select doc_id, unnest(s) as g from sets),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * c >= 75 * (len(x.s) + len(y.s) - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, r) as (select doc_id, doc_id from documents union select reach.doc_id, e.b from reach join both_ways e on e.a = reach.r)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from sets join (select doc_id, min(r) as component_id from reach group by doc_id) using (doc_id)"""


def quality_rules(rules: Rules = Rules()) -> str:
    """Counts by lists, references by sums, and the Jensen-Shannon formula per language."""
    literal = lambda x: "'" + x.replace("'", "''") + "'"
    classes = ", ".join(f"length(t) - length(regexp_replace(t, {literal(c)}, '', 'g'))" for c in CLASSES)
    common = ", ".join(f"len(list_filter(ws, lambda x: x = {literal(v)}))" for v in VOCABULARY)
    sizes = {"c": len(CLASSES) + 1, "w": len(VOCABULARY) + 1}
    sums = ", ".join(f"[{', '.join(f'sum({k}[{i}])' for i in range(1, n + 1))}] as {k}" for k, n in sizes.items())
    share = lambda x: f"list_transform({x}, lambda v: v / list_sum({x}))"
    half = lambda a, m: f"case when {a} > 0 then {a} * log2({a} / {m}) else 0 end"

    def distance(p: str, q: str) -> str:
        term = f"({half('z[1]', '((z[1] + z[2]) / 2)')} + {half('z[2]', '((z[1] + z[2]) / 2)')}) / 2"
        return f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: {term}))))"

    none = f"list_concat(list_transform(range({len(VOCABULARY)}), lambda i: 0e0), [1e0])"
    return f"""with docs as (select doc_id, lang, coalesce(text, '') as t, {SPLIT.format('text')} as ws from documents),
counts as (select doc_id, lang, t, ws, [{classes}] as c0, [{common}] as w0 from docs),
hist as (select doc_id, lang, t, ws, list_transform(list_concat(c0, [length(t) - list_sum(c0)]), lambda v: cast(v as double)) as c,
    list_transform(list_concat(w0, [len(ws) - list_sum(w0)]), lambda v: cast(v as double)) as w from counts),
sums as (select lang, {sums} from hist where lang is not null group by lang),
refs as (select lang, {share('c')} as qc, {share('w')} as qw from sums where list_sum(c) >= {rules.reference_chars} order by list_sum(c) desc, lang limit {rules.languages}),
near as (select doc_id, case when list_sum(c) > 0 then {distance(share('c'), 'qc')} else 0 end as cd,
    case when list_sum(w) > 0 and qw[{len(VOCABULARY) + 1}] <= 1 - {rules.reference_share} then {distance(share('w'), 'qw')} / {distance(none, 'qw')} else 0 end as wd
  from hist join refs using (lang)),
windows as (select doc_id, unnest(range(1, len(ws) - 1)) as k, ws from docs where len(ws) >= 3),
grams as (select doc_id, k, count(*) over (partition by doc_id, ws[k], ws[k + 1], ws[k + 2]) as times from windows),
places as (select doc_id, count(distinct p) as n from (select doc_id, unnest([k, k + 1, k + 2]) as p from grams where times > 1) group by doc_id),
lines as (select doc_id, count(*) - count(distinct l) as n from (select doc_id, unnest(string_split(t, chr(10))) as l from docs)
    where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by doc_id),
measured as (select doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(lines.n, 0) as n_dup_lines, coalesce(places.n, 0) as n_repeat_words,
    length(t) as chars, coalesce(cd, 0) as cd, coalesce(wd, 0) as wd
  from docs left join lines using (doc_id) left join places using (doc_id) left join near using (doc_id)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from measured)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  round(cd, 6) as class_distance, round(wd, 6) as common_distance,
  not base_failed and not ((chars >= {rules.class_chars} and cd > {rules.class_limit}) or (n_words >= {rules.common_words} and wd > {rules.common_limit})) as kept
from judged"""


def line_dedup() -> str:
    return r"""with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as k from documents),
keyed as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
shared as (select key, max(doc_id) as keep from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select doc_id, k, line, shared.key is not null and doc_id <> keep as gone from keyed left join shared using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by k) filter (where not gone), '')) as kept_sha256
from marked group by doc_id"""


def periodic_runs() -> str:
    """Every pair of equal words at a lag up to a third of the text, joined to stretches by gaps and islands."""
    byte = "[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]"  # each byte goes in, then eight bits are shifted out
    crc32 = f"""xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: {byte}))),
    lambda c, s: case when s >= 0 then xor(c, s) else xor(c >> 1, (c & 1) * 3988292384) end))"""
    return rf"""with plain as (select doc_id, {SPLIT.format('text')} as ws from documents),
h as (select doc_id, ws, len(ws) as n, {crc32} as h from plain),
picked as (select *, case when n > 0 then (h // 10) % n end as a from h),
texts as (select doc_id, n, case when h % 10 = 0 and n > 0
    then list_transform(range(n), lambda i: ws[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) end]) else ws end as ws from picked),
w as (select doc_id, n, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as i from texts),
pairs as (select x.doc_id, y.i - x.i as q, x.i from w x join w y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 3 * (y.i - x.i) <= x.n),
islands as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from pairs),
stretches as (select doc_id, q, min(i) as s, count(*) + q as l from islands group by doc_id, q, island having count(*) + q >= greatest(24, 3 * q)),
runs as (select doc_id, s, l, min(q) as q from stretches group by doc_id, s, l),
lists as (select doc_id, count(*) as n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as listed,
    first(struct_pack(s := s, l := l, q := q) order by l / q desc, s, q) as best from runs group by doc_id),
gone as (select distinct w.doc_id, i from w join runs on w.doc_id = runs.doc_id and i >= s + q and i < s + l),
rest as (select w.doc_id, string_agg(word, ' ' order by i) as t from w anti join gone on w.doc_id = gone.doc_id and w.i = gone.i group by w.doc_id)
select texts.doc_id, coalesce(n_runs, 0) as n_runs, cast(best.s as bigint) as start, cast(best.l as bigint) as length, cast(best.q as bigint) as period,
  cast(1000 * best.l // best.q as bigint) as exponent_milli, sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(t, '')) as collapsed_sha256
from texts left join lists using (doc_id) left join rest using (doc_id)"""


def filter_audit() -> str:
    """Counts by which filters fail, summed for every order and step."""
    return rf"""with firsts as (select coalesce(text, '') as t, min(doc_id) as least from documents group by 1),
marks as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id),
docs as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, {SPLIT.format('text')} as ws from documents),
flagged as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    cast(len(ws) < 50 as int) + 2 * cast(100 * len(list_distinct(ws)) < 65 * len(ws) as int)
    + 4 * cast(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) as int)
    + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(doc_id > least as int) as fails
  from docs join firsts using (t) left join marks using (doc_id)),
counts as (select part, fails, good, toxic, count(*) as n from flagged group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
orders as (select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and length(replace(replace(replace(replace(a.f || b.f || c.f || d.f || e.f, a.f, ''), b.f, ''), c.f, ''), d.f, '')) = 1),
steps as (select filter_order, cast(step as int) as step, bits[step] as bit, cast(coalesce(list_sum(bits[:step - 1]), 0) as int) as before from orders, range(1, 6) r(step)),
sums as (select part, filter_order, step, bit, sum(n) filter (where fails & (before | bit) = 0) as kept, sum(n) filter (where fails & bit > 0 and fails & before = 0) as removed,
    sum(n) filter (where fails & bit > 0 and fails & before > 0) as redundant, sum(n) filter (where fails = bit) as unique_fails,
    sum(n) filter (where good = 1 and fails & bit > 0 and fails & before = 0) as good_lost, sum(n) filter (where toxic = 1 and fails & bit > 0 and fails & before = 0) as toxic_lost
  from counts, steps group by all),
whole as (select part, bit, sum(removed) as shapley from sums group by part, bit)
select part, filter_order, step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed, cast(coalesce(redundant, 0) as bigint) as redundant,
  cast(coalesce(unique_fails, 0) as bigint) as unique_fails, cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost, cast(coalesce(shapley, 0) as bigint) as shapley
from sums join whole using (part, bit)"""
