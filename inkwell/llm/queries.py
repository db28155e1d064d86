"""The operators of this subpackage as queries over the tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import bpe, chats, decontaminate, jaccard, pii, quality, rules, secrets, shards, urls
from inkwell.llm.common import read


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.documents_sharded(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.documents_scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.documents_scanned(read(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.documents_searched(read(spark, sf_dir, "documents"))


def op6_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.formatted(read(spark, sf_dir, "conversations"))


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(read(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.documents_judged(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_shards": op2_shards,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_pii": op5_pii,
    "op6_chats": op6_chats,
    "op7_leaks": op7_leaks,
    "op8_jaccard": op8_jaccard,
    "op9_urls": op9_urls,
    "op10_rules": op10_rules,
}

_OP6 = """
with t as (
  select conv_id, coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)) as x,
         '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) as y,
         row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as pos
  from conversations),
p as (select conv_id, pos, list(x) over (partition by conv_id order by pos) as xs from t),
w as (select conv_id, list(x order by pos) as xs, string_agg(y, '' order by pos) as text from t group by conv_id),
f as (select xs, count(*) as n_equal, min(conv_id) as conv_id from w group by xs),
b as (select xs, count(*) as n_begun from p group by xs)
select f.conv_id, cast(len(f.xs) as bigint) as n_turns, f.n_equal, w.text
from f join b on f.xs = b.xs join w on f.conv_id is not distinct from w.conv_id
where b.n_begun = f.n_equal
"""

_OP9 = """
with u as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
r as (
  select *, case
    when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule
  from u)
select page_id, host, path, rule,
  case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict
from r
"""

_OP10 = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
s as (select r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
w as (select r, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as p from s),
g as (select r, p, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' ' || lead(w, 4) over o as g
      from w window o as (partition by r order by p)),
again as (select r, p from (select r, p, count(*) over (partition by r, g) as n from g where g is not null) where n > 1),
cover as (select r, count(distinct p + k) as n from again, range(0, 5) as o(k) group by r),
c as (
  select d.r, doc_id, t, cast(len(ws) as bigint) as n_words, cast(length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as bigint) as word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, len(ls) as n_lines, cast(coalesce(cover.n, 0) as bigint) as n_repeat_words,
    length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as n_capitals
  from d join s using (r) left join cover using (r)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 100 * n_symbols > 20 * n_words or 100 * n_dup_lines > 60 * n_lines or 100 * n_capitals > 60 * word_chars
       or coalesce(word_chars / n_words not between 1.5 and 30, false)) as kept
from f
"""



def _op4() -> str:
    """Matches by their places, candidates from runs of a class, entropy by windows, and each class added where it meets nothing before it."""
    runs = {"a": "[0-9A-Za-z]+", "b": "[A-Za-z0-9+/_=-]{20,}"}
    kinds = (  # run, what a whole candidate matches, what it must have, window, bits
        ("a", "[0-9a-fA-F]{24,}", "[0-9].*[a-fA-F]|[a-fA-F].*[0-9]", 24, 3.0),
        ("b", ".*", None, 20, 3.7),
        ("a", "[a-z0-9]{20,}", "[0-9].*[a-z]|[a-z].*[0-9]", 20, 3.6),
        ("a", "[A-Z0-9]{20,}", "[0-9].*[A-Z]|[A-Z].*[0-9]", 20, 3.6),
        ("a", "[A-Za-z]{20,}", "[a-z].*[A-Z]", 20, 3.8),
    )
    needs = lambda x, n: f"regexp_matches({x}, '{n}')" if n else f"(regexp_matches({x}, '[0-9]') and regexp_matches({x}, '[a-z]') and regexp_matches({x}, '[A-Z]'))"
    name = lambda k: f"'{secrets.KINDS[k]}'"

    def placed(pattern: str, group: int = 0) -> str:
        return f"""(select r, v, s + e - length(m) as b, s + e as e from (select r, m, v, e, coalesce(sum(0) over (partition by r), 0) as s from (
          select r, m, v, sum(length(g) + length(m)) over (partition by r order by i) as e from (
            select r, unnest(m) as m, unnest(v) as v, unnest(g[1:len(m)]) as g, generate_subscripts(m, 1) as i from (
              select r, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {group}) as v, regexp_split_to_array(t, '{pattern}') as g from d)))))"""

    quote = lambda p: p.replace("'", "''")
    base = [quote("(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"]
    parts = ["with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents)"]
    parts += [f"run_{n} as (select r, v, b, e from {placed(p)})" for n, p in runs.items()]
    union = f"select r, 0 as k, b, e from {placed(base[0], 1)} where length(v) >= {secrets.LEAST_VALUE}"
    parts.append(f"u0 as ({union} union all select r, 1, b, e from {placed(base[1])} union all select r, 2, b, e from {placed(base[2])})")
    for k, (run, whole, need, window, high) in enumerate(kinds, 3):
        mixed = f"{needs('x', need)} and length(x) >= {window} and list_max(list_transform(range(1, length(x) - {window - 2}), lambda i: list_aggregate(string_split(substr(x, i, {window}), ''), 'entropy'))) >= {high}"
        chosen = f"select r, {k} as k, b, e from run_{run} c where regexp_full_match(v, '{whole}') and {needs('v', need)} and not regexp_matches(v, '{secrets.ALLOWED}') and len(list_filter(regexp_split_to_array(v, '{secrets.PLACEHOLDER}'), lambda x: {mixed})) > 0"
        parts.append(f"u{k - 2} as (select * from u{k - 3} union all select * from ({chosen}) c where not exists (select 1 from u{k - 3} u where u.r = c.r and u.b < c.e and u.e > c.b))")
    kind = "case k " + " ".join(f"when {k} then {name(k)}" for k in range(len(secrets.KINDS))) + " end"
    text = f"string_agg({kind} || ':' || b || ':' || e, ',' order by b, k, e)"
    counts = ", ".join(f"count(k) filter (where k = {k}) as n_{secrets.KINDS[k]}" for k in range(3))
    return ",\n".join(parts) + f"\nselect any_value(doc_id) as doc_id, {counts}, sha256(coalesce({text} filter (where k < 3), '')) as base_sha256, coalesce({text}, '') as spans from d left join u{len(kinds)} u on u.r = d.r group by d.r"


def _op7() -> str:
    """Tokens with their types, windows of them as they are and as templates, alignments by shift with one value a slot, and what they cover."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
    low = lambda x: f"translate({x}, '{upper}', '{upper.lower()}')"
    token = "(?:[A-Za-z\\x{80}-\\x{10FFFF}]+|[0-9]+(?:[.,][0-9]+)*)+"
    units = ", ".join(f"'{u}'" for u in decontaminate.UNITS)
    w, share, run = decontaminate.WINDOW, decontaminate.SHARE, decontaminate.RUN

    def tokens(source: str, key: str) -> str:
        """key, x (number of the text), v (values), p (template), l (1: literal) as lists."""
        return f"""(select k, x, list({low("m")} order by i) as v, list(case when num then '#n' when name then '#c' when unit then '#u' else {low("m")} end order by i) as p, list(case when num or name or unit then 0 else 1 end order by i) as l from (
        select *, coalesce(lag(num) over (partition by x order by i), false) and {low("m")} in ({units}) and not num and not name as unit from (
          select *, not num and not (i = 1 or regexp_matches(g, '[.!?:\\n\\r"]')) and {low("left(m, 1)")} <> left(m, 1) as name from (
            select *, regexp_matches(m, '[0-9]') as num from (
              select k, x, unnest(m) as m, unnest(g[1:len(m)]) as g, generate_subscripts(m, 1) as i from (
                select k, x, regexp_extract_all(t, '{token}') as m, regexp_split_to_array(t, '{token}') as g from (select distinct {key} as k, text as t, dense_rank() over (order by {key}, text) as x from {source} where {key} is not null and text is not null))))))
      group by k, x)"""

    windows = lambda lists, size: f"select k, x, i - 1 as pos, {size} as size, array_to_string(v[i:i + {size} - 1], ' ') as e, array_to_string(p[i:i + {size} - 1], ' ') as tp, 2 * list_sum(l[i:i + {size} - 1]) >= {size} as usable, v[i:i + {size} - 1] as v, l[i:i + {size} - 1] as l from {lists}"
    return f"""
with it as {tokens("benchmark", "item_id")}, dt as {tokens("documents", "doc_id")},
iw as (select * from ({windows("(select *, unnest(range(1, len(v) - least(8, len(v)) + 2)) as i from it where len(v) > 0)".replace("8", str(w)), f"least({w}, len(v))")})),
sizes as (select distinct size as s from iw), dw as (select * from ({windows("(select dt.*, s, unnest(range(1, len(v) - s + 2)) as i from dt, sizes where len(v) >= s)", "s")})),
n as (select x, count(*) as n, count(*) filter (where usable) as nu from iw group by x),
met as (
  select d.k as doc_id, d.x as dx, i.k as item_id, i.x as ix, d.pos - i.pos as shift, i.pos, i.usable, true as exact, list_distinct(list_filter(list_transform(range(1, len(i.v) + 1), lambda j: case when i.l[j] = 0 then struct_pack(a := i.v[j], b := i.v[j]) end), lambda s: s is not null)) as slots from dw d join iw i on d.size = i.size and d.e = i.e
  union all
  select d.k, d.x, i.k, i.x, d.pos - i.pos, i.pos, i.usable, false, list_distinct(list_filter(list_transform(range(1, len(i.v) + 1), lambda j: case when i.l[j] = 0 then struct_pack(a := i.v[j], b := d.v[j]) end), lambda s: s is not null)) from dw d join iw i on d.size = i.size and d.tp = i.tp and d.usable and i.usable),
votes as (select dx, ix, shift, s.a as a, s.b as b, count(*) as c from (select dx, ix, shift, unnest(slots) as s from met where not exact) group by all),
vals as (select dx, ix, shift, a, arg_max(b, (c, a = b, b)) as b from votes group by dx, ix, shift, a),
bad as (select distinct m.dx, m.ix, m.shift, m.pos from (select dx, ix, shift, pos, unnest(slots) as s from met where not exact) m join vals v on v.dx = m.dx and v.ix = m.ix and v.shift = m.shift and v.a = m.s.a where v.b <> m.s.b),
agreed as (select met.* from met left join bad on not met.exact and bad.dx = met.dx and bad.ix = met.ix and bad.shift = met.shift and bad.pos = met.pos where bad.pos is null),
lines as (
  select doc_id, dx, item_id, ix, shift, list(distinct pos) as at_all, coalesce(list(distinct pos) filter (where usable), []) as at_usable, list_sort(coalesce(list(distinct pos) filter (where exact), [])) as at_exact, list_distinct(flatten(list(slots))) as slots from agreed group by all),
pairs as (
  select doc_id, dx, item_id, ix, len(list_distinct(flatten(list(at_all)))) as n_all, len(list_distinct(flatten(list(at_usable)))) as n_usable, max(len(slots)) as n_slots, bool_and(len(list_filter(slots, lambda s: s.a <> s.b)) > 0) as changed,
    bool_or(len(list_filter(range(1, len(at_exact) - {run - w - 1}), lambda j: at_exact[j + {run - w}] = at_exact[j] + {run - w})) > 0) as long from lines group by all),
told as (select p.*, greatest(n_all / n.n, case when nu > 0 then n_usable / nu else 0.0 end) as coverage, case when case when nu > 0 then n_usable / nu else 0.0 end > n_all / n.n then n_usable else n_all end as n_windows, long and n.n + {w - 1} >= {run} as run from pairs p join n on n.x = p.ix),
best as (select doc_id, item_id, max(struct_pack(coverage := coverage, n_windows := n_windows, n_slots := n_slots, same := not changed)) as b from told where coverage >= {share} or run group by doc_id, item_id)
select doc_id, item_id, b.n_windows as n_windows, b.coverage as coverage, b.n_slots as n_slots, not b.same as reparameterised from best
"""


_OP8 = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
l as (select x, y from e union all select y, x from e),
r(node, other) as (select doc_id, doc_id from documents union select r.node, l.y from r join l on l.x = r.other)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(other) from r where r.node = d.doc_id) as component_id from documents d left join n on n.doc_id = d.doc_id
"""

ORACLE: dict[str, str] = {"op4_secrets": _op4(), "op7_leaks": _op7(), "op8_jaccard": _OP8, "op6_chats": _OP6, "op9_urls": _OP9, "op10_rules": _OP10}
