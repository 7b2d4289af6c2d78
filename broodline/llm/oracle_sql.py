"""DuckDB SQL of the corpus queries that SQL can express.

op2, op3, op4, op6, op7 and op10 are learned, search for patterns with arithmetic checks, or
depend on a vocabulary file; tests compare them with brute force or held-out labels.
"""

from __future__ import annotations

from broodline.llm.licenses import PERCENT, TEMPLATES

# words: runs of characters other than white space; RE2 and Spark agree on these classes
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_minhash_near_dedup"] = rf"""
with recursive words as (
  select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w
  from documents where doc_id is not null
),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
    else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
  from words
),
items as (select doc_id, len(s) as n, unnest(s) as x from sets),
both_ as (
  select a.doc_id as u, b.doc_id as v, any_value(a.n) as nu, any_value(b.n) as nv, count(*) as c
  from items a join items b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id
),
links as (select u, v from both_ where 100 * c >= 80 * (nu + nv - c)),
edges as (select u, v from links union all select v, u from links),
reach(id, other) as (
  select doc_id, doc_id from sets
  union select r.id, e.v from reach r join edges e on r.other = e.u
),
comp as (select id, min(other) as component_id from reach group by id)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from sets s join comp c on c.id = s.doc_id
"""

_SYMBOLS = "[#*$%&|<>]"
ORACLE_SQL["op5_quality_rules"] = rf"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (
  select doc_id, text, {_WORDS.format("text")} as w,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from t
),
r as (select row_number() over () as k, * from w),
windows as (
  select k, i, list_slice(w, i, i + 4) as x from r, unnest(range(1, greatest(len(w) - 3, 1))) as u(i) where len(w) >= 5
),
doubled as (select k, i from (select *, count(*) over (partition by k, x) as n from windows) z where n > 1),
covered as (select k, count(distinct i + j) as n from doubled, unnest(range(0, 5)) as o(j) group by k),
b as (
  select r.doc_id, r.text, r.w, cast(len(r.w) as bigint) as n_words,
    cast(length(regexp_replace(r.text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(r.text) - length(regexp_replace(r.text, '{_SYMBOLS}', '', 'g')) as bigint) as n_symbols,
    cast(len(r.lines) as bigint) as n_lines,
    cast(len(r.lines) - len(list_distinct(r.lines)) as bigint) as n_dup_lines,
    cast(coalesce(c.n, 0) as bigint) as n_repeat_words
  from r left join covered c on c.k = r.k
),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (
    100 * n_symbols > 10 * n_words or 100 * n_dup_lines > 30 * n_lines
    or word_chars < 2 * n_words or word_chars > 15 * n_words
    or 100 * (length(text) - length(replace(text, '!', ''))) > 20 * n_words
    or 100 * length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) > 40 * word_chars
    or 100 * length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) < 50 * word_chars
    or 100 * len(list_distinct(w)) < 10 * least(n_words, 1000)) as kept
from f
"""

ORACLE_SQL["op8_chat_format"] = r"""
with c as (
  select cast(conv_id as bigint) as conv_id, cast(turn as bigint) as turn, coalesce(role, '') as role,
    coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
f as (
  select *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '#', '\h'), ':', '\c') || ': '
    || replace(replace(replace(text, '\', '\\'), '<', '\l'), '#', '\h') || ' </turn>' || chr(10) as formatted from c
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, formatted)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, formatted) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(formatted)) as bigint) as formatted_chars
from f group by conv_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NOTICES = ", ".join(f"({_quoted(name)}, {_quoted(t)})" for name, notices in TEMPLATES.items() for t in notices)


def _pairs(segment: str) -> str:
    """Distinct pairs of neighbouring normalised words."""
    words = f"string_split(trim(regexp_replace(lower({segment}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    return f"(select list_distinct(list_transform(range(1, len(z.w)), lambda i: z.w[i] || ' ' || z.w[i + 1])) from (select {words} as w) z)"


ORACLE_SQL["op9_license_scan"] = rf"""
with templates as (select name, {_pairs("t")} as p from (values {_NOTICES}) as x(name, t)),
d as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
-- sentence ends become line ends, then lines are the segments
s as (
  select k, n, {_pairs("segment")} as p from (
    select k, unnest(string_split(regexp_replace(text, '([.!?;:])[\x20\x09\x0B-\x0D]', '\1' || chr(10), 'g'), chr(10))) as segment,
      generate_subscripts(string_split(regexp_replace(text, '([.!?;:])[\x20\x09\x0B-\x0D]', '\1' || chr(10), 'g'), chr(10)), 1) as n
    from d) y
),
m as (
  select s.k, s.n, t.name, 2.0 * len(list_intersect(s.p, t.p)) / (len(s.p) + len(t.p)) as dice
  from s join templates t on len(s.p) > 0
    and 200 * len(list_intersect(s.p, t.p)) >= {PERCENT} * (len(s.p) + len(t.p))
),
best as (select k, n, arg_min(name, (-dice, name)) as name, max(dice) as dice from m group by k, n)
select d.doc_id, cast(count(b.n) as bigint) as n_matches,
  coalesce(string_agg(distinct b.name, ',' order by b.name), '') as licences,
  arg_min(b.name, (-b.dice, b.name)) as best, round(coalesce(max(b.dice), 0.0), 6) as dice
from d left join best b on b.k = d.k group by d.k, d.doc_id
"""


ORACLE_SQL["op11_filter_audit"] = r"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(source, '') as part from documents),
marks as (
  select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic
  from labels where doc_id is not null group by doc_id
),
first as (select text, min(doc_id) as first from d group by text),
w as (select d.*, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d),
f as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, [
    len(w) < 50,
    100 * len(list_distinct(w)) < 65 * len(w),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(w.doc_id > first.first, false)] as fails
  from w join first using (text) left join marks on marks.doc_id = w.doc_id
),
letters as (select * from (values (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')) as x(i, letter)),
orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.i, b.i, c.i, d.i, e.i] as o
  from letters a, letters b, letters c, letters d, letters e
  where b.i <> a.i and c.i not in (a.i, b.i) and d.i not in (a.i, b.i, c.i) and e.i not in (a.i, b.i, c.i, d.i)
),
steps as (select filter_order, o, s as step, o[s] as i, o[1 : s - 1] as before from orders, range(1, 6) as r(s)),
sets as (
  select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic,
    len(list_filter(fails, lambda x: x)) as size from f group by part, fails
),
m as (
  select part, filter_order, step, i, n, good, toxic, size, fails[i] as hit,
    len(list_filter(before, lambda j: fails[j])) > 0 as earlier
  from sets, steps
),
r as (
  select part, filter_order, step, any_value(i) as i,
    coalesce(sum(n) filter (not earlier and not hit), 0) as kept, coalesce(sum(n) filter (not earlier and hit), 0) as removed,
    coalesce(sum(n) filter (earlier and hit), 0) as redundant, coalesce(sum(n) filter (hit and size = 1), 0) as unique_fails,
    coalesce(sum(good) filter (not earlier and hit), 0) as good_lost, coalesce(sum(toxic) filter (not earlier and hit), 0) as toxic_lost
  from m group by part, filter_order, step
)
select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, i) as bigint) as shapley
from r
"""

ORACLE_SQL["op12_exact_dedup"] = """
with d as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
),
g as (select t, max(doc_id) as keep_id, count(*) as n from d group by t)
select d.doc_id, g.keep_id, g.n as group_size, d.doc_id is not distinct from g.keep_id as kept, sha256(d.t) as text_sha256
from d join g on g.t = d.t
"""

# crc32 by its bits, then the rebuilt conversations, their prefixes and all (node, descendant) pairs
ORACLE_SQL["op13_prefix_trie"] = """
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
    coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null
),
c as (
  select conv_id, conv_id - conv_id % 5 as base, xor(4294967295::bigint, list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
      lambda x, y: xor(x >> 1, (x & 1) * 3988292384::bigint)))) % 9 as h
  from (select distinct conv_id from t)
),
b as (select c.conv_id, t.pos as d, t.role, t.text from c join t on t.conv_id = c.base and t.pos <= c.h),
taken as (select c.conv_id, count(b.d) as n from c left join b using (conv_id) group by c.conv_id),
r as (
  select * from b union all
  select c.conv_id, t.pos - c.h + taken.n, t.role, t.text from c join t using (conv_id) join taken using (conv_id) where t.pos > c.h
),
p as (
  select conv_id, d, strlen(text) as bytes,
    string_agg(sha256(strlen(role) || ':' || role || text), '' order by d) over (partition by conv_id order by d) as id
  from r
),
m as (select conv_id, 0 as d, 0 as bytes, '' as id, null as parent from c
  union all select conv_id, d, bytes, id, substr(id, 1, length(id) - 64) from p),
ends as (
  select id, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as h
  from m where (conv_id, d) in (select conv_id, max(d) from m group by conv_id) group by id
),
nodes as (select id, any_value(parent) as parent, min(conv_id) as conv_id, any_value(d) as depth, count(*) as n, any_value(bytes) as bytes from m group by id),
kids as (select parent as id, count(*) as n from nodes where parent is not null group by parent),
below as (select distinct a.id, b.id as other from m a join m b on b.conv_id = a.conv_id and b.d >= a.d),
sums as (
  select below.id, count(*) filter (kids.n is null) as n_leaves, sum((nodes.n - 1) * nodes.bytes) as saved
  from below join nodes on nodes.id = below.other left join kids on kids.id = below.other group by below.id
)
select nodes.conv_id, cast(nodes.depth as bigint) as depth, up.conv_id as parent_conv_id, nodes.n as n_convs,
  cast(coalesce(kids.n, 0) as bigint) as n_children, cast(sums.n_leaves as bigint) as n_leaves,
  cast(sums.saved as bigint) as saved_tokens, coalesce(ends.h, sha256('')) as ends_sha256
from nodes join sums using (id) left join kids using (id) left join ends using (id) left join nodes up on up.id = nodes.parent
"""
