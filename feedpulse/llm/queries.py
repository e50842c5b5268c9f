"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedpulse.llm import (jaccard, merkle, packing, pieces, prefix_trie, quality, secrets, sharding, substring_dedup, topk, toxicity,
                           url_filter, warc)
from feedpulse.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_url_filter", """
with p as (select page_id, coalesce(url, '') as u from pages),
     q as (select page_id, regexp_extract(u, '^.*?://([^/?#]*)([^?#]*)', 1, 's') as h,
                  regexp_extract(u, '^.*?://([^/?#]*)([^?#]*)', 2, 's') as path from p),
     r as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from q),
     s as (select *, case
       when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
       when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
       when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
       when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
       when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule from r)
select page_id, host, path, rule,
       case when rule in ('example.com/en/', 'net/es/', 'net/fr/') then 'block' else 'allow' end as verdict from s""")
def op1(spark, sf):
    return url_filter.judge(table(spark, sf, "pages"))


@register("op8_sharding")
def op8(spark, sf):
    s = sharding.shard(table(spark, sf, "documents"), 8)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


# A bracket's words: runs of characters other than the six spaces.
_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"


def _quality_sql() -> str:
    bits = " | ".join(f"case when {failed} then {quality.BIT[name]} else 0 end" for name, failed in quality.RULES)
    return f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
      m as (select r, doc_id, {_WORDS.format(t="t")} as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines,
              len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(regexp_extract_all(t, '\\p{{Lu}}')) as n_upper from d),
      k as (select r, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') as k from (select r, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) as i from m)),
      c as (select r, count(distinct p) as n from (select r, unnest(range(i, i + {quality.WINDOW})) as p
              from (select r, i, count(*) over (partition by r, k) as n from k) where n > 1) group by r),
      x as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, n_symbols::bigint as n_symbols,
              (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, len(lines) as n_lines, n_upper
            from m left join c using (r)),
      b as (select *, ({bits})::bigint as fail_bits from x)
      select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {quality.BASE} <> 0 as base_failed,
             fail_bits & {quality.POLICIES["v2"]} = 0 as kept, fail_bits from b"""


@register("op10_quality_rules", _quality_sql())
def op10(spark, sf):
    led = quality.apply_policy(quality.ledger(table(spark, sf, "documents")))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "fail_bits")


@register("op3_warc", """
with p as (select page_id, coalesce(html, '') as t from pages),
     d as (select page_id, strlen(t) as payload_bytes, sha1(t) as hex from p),
     b as (select *, cast(unhex(hex) as bit)::varchar as bits from d),
     x as (select page_id, payload_bytes, hex, array_to_string(list_transform(range(0, 32), lambda i:
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + list_sum(list_transform(range(0, 5),
               lambda j: cast(substr(bits, 5 * i + j + 1, 1) as int) * (1 << (4 - j)))) as bigint), 1)), '') as payload_digest from b),
     m as (select *, max(page_id) over (partition by hex) as top from x)
select page_id, payload_bytes, payload_digest, case when page_id < top then 'revisit' else 'response' end as record_type,
       case when page_id < top then top end as refers_to from m""")
def op3(spark, sf):
    index, folder = warc.archive(table(spark, sf, "pages"), revisit_from=0)
    return warc.read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op5_best_fit_packing")
def op5(spark, sf):
    return packing.pack(table(spark, sf, "documents"))


@register("op7_exact_topk", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
           where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
     s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
           from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
     r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10""")
def op7(spark, sf):
    return topk.search(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@register("op9_substring_dedup", f"""
with m as (select row_number() over () as r, doc_id, {_WORDS.format(t="coalesce(text, '')")} as w from documents),
k as (select r, i, array_to_string(w[i:i + 34], ' ') as k from (select r, w, unnest(range(1, len(w) - 33)) as i from m)),
gone as (select r, list(distinct p) as p from (select r, unnest(range(i, i + 35)) as p
  from (select r, i, count(*) over (partition by k) as n from k) where n > 1) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(len(p), 0)::bigint as n_removed,
  sha256(array_to_string(case when p is null then w else list_filter(w, lambda x, i: not list_contains(p, i)) end, ' ')) as kept_sha256
from m left join gone using (r)""")
def op9(spark, sf):
    return substring_dedup.digest(table(spark, sf, "documents"))


@register("op6_jaccard_join", f"""
with recursive m as (select doc_id, {_WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w
  from documents where doc_id is not null),
s as (select distinct doc_id, k from (select doc_id, array_to_string(w[i:i + 4], ' ') as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from m where len(w) > 0))),
n as (select doc_id, count(*) as n from s group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.k = b.k and a.doc_id <> b.doc_id group by all),
l as (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) as (select doc_id, doc_id from m union select r.a, l.b from r join l on r.b = l.a)
select m.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.b) as component_id from m join r on r.a = m.doc_id left join n using (doc_id) group by m.doc_id""")
def op6(spark, sf):
    return jaccard.join(table(spark, sf, "documents"))


@register("op2_toxicity")
def op2(spark, sf):
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op4_sentencepiece")
def op4(spark, sf):
    return pieces.encode(table(spark, sf, "documents"), with_ids=False)


def _secrets_sql() -> str:
    """The base patterns, and each window's entropy from its own histogram instead of running counts."""
    base = [(k, i, p, least, g) for i, (k, p, least, g) in enumerate((
        ("assign", secrets.ASSIGN.replace("(?i:password|passwd|secret|token|api_?key)", "|".join(
            "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) + "?" * (w == "api_") + rest
            for w, rest in (("password", ""), ("passwd", ""), ("secret", ""), ("token", ""), ("api_", "[kK][eE][yY]")))), secrets.ASSIGN_MIN, 2),
        ("access", secrets.ACCESS, secrets.ACCESS_MIN, 0), ("hex", secrets.HEX, secrets.HEX_MIN, 0)))]
    q = lambda x: "'" + x.replace("'", "''") + "'"
    located = """select doc_id, i, hit, before, sum(length(before) + length(hit)) over (partition by doc_id order by i) - length(hit) as a
        from (select doc_id, generate_subscripts(hits, 1) as i, unnest(hits) as hit, unnest(gaps[:len(hits)]) as before
              from (select doc_id, regexp_extract_all(t, {p}) as hits, string_split_regex(t, {p}) as gaps from d))"""
    parts = [f"select doc_id, {q(k)} as kind, {i} as ord, a, a + length(hit) as b from ({located.format(p=q(p))}) "
             f"where length(regexp_extract(hit, {q(p)}, {g})) >= {least}" for k, i, p, least, g in base]
    for i, c in enumerate(secrets.CLASSES):
        letters = "".join("\\" + x if x in "-]\\^" else x for x in c.letters)
        ok = " and ".join([f"not regexp_matches(hit, {q(p)})" for p in secrets.ALLOW]
                          + [f"not regexp_matches(right(before, {secrets.CONTEXT}), {q(p)})" for p in secrets.ALLOW_BEFORE])
        parts.append(f"""select doc_id, '{c.kind}', {i + len(base)}, a + min(s), a + max(s) + {c.window} from (
          select *, sum(fresh) over (partition by doc_id, a order by s) as island from (
          select *, case when s - lag(s) over (partition by doc_id, a order by s) <= {c.window} then 0 else 1 end as fresh from (
          select *, list_sum(list_transform(map_values(list_histogram(string_split(substr(hit, s + 1, {c.window}), ''))),
                    lambda n: {secrets.weights(c.window)}[cast(n as bigint) + 1])) as total
          from (select *, unnest(range(0, length(hit) - {c.window - 1})) as s from ({located.format(p=q(f"[{letters}]{{{c.window},}}"))}) where {ok}))
          where total <= {secrets.limit(c)})) group by doc_id, a, island""")
    listed = "string_agg(kind || ':' || cast(a as bigint) || ':' || cast(b as bigint), ',' order by a, ord)"
    return f"""with d as (select doc_id, coalesce(text, '') as t from documents), s(doc_id, kind, ord, a, b) as ({" union all ".join(parts)}),
      g as (select doc_id, count(*) filter (where ord = 0) as n_assign, count(*) filter (where ord = 1) as n_access,
                   count(*) filter (where ord = 2) as n_hex, {listed} filter (where ord < 3) as base, {listed} as spans from s group by doc_id)
      select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
             sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)"""


@register("op11_secret_scan", _secrets_sql())
def op11(spark, sf):
    return secrets.digest(table(spark, sf, "documents"))


_LEAF = "sha256(" + " || ".join(f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"
                               for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"


def _crc_sql(ids: str) -> str:
    """Tables ending in crcs(id, crc): CRC-32 of the decimal ids, by its table of 256 entries."""
    return f"""tab as (select i, c from (with recursive s(i, k, c) as (select i, 0, i from range(256) r(i) union all
    select i, k + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from s where k < 8) select i, c from s where k = 8)),
lut as (select list(c order by i) as l from tab),
crc(id, s, k, c) as (select id, id::varchar, 0, 4294967295::bigint from ({ids}) x(id)
  union all select id, s, k + 1, xor(c >> 8, l[(xor(c, ascii(s[k + 1])) & 255) + 1]) from crc, lut where k < length(s)),
crcs as (select id, xor(c, 4294967295) as crc from crc where k = length(s))"""


@register("op12_merkle_manifest", f"""
with recursive {_crc_sql('select doc_id from documents')},
bad as (select id as doc_id from crcs where crc % 7 = 0),
d as (select *, {_LEAF.format(n="n_chars")} as leaf, {_LEAF.format(n="n_changed")} as changed,
        dense_rank() over (order by lang nulls first) - 1 as g,
        row_number() over (partition by lang order by doc_id nulls first) - 1 as spot, count(*) over (partition by lang) as m
      from (select *, n_chars + (doc_id in (select doc_id from bad))::int as n_changed from documents)),
t(g, lvl, pos, n, h) as (select g, 0, spot, m, leaf from d union all
  select g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from t where n > 1 group by g, lvl, pos // 2, n),
sub as (select g, h, lvl as height, count(*) over () as groups from t where n = 1),
r(lvl, pos, n, h) as (select 0, g, groups, h from sub union all
  select lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from r where n > 1 group by lvl, pos // 2, n),
steps as (  -- every level of every document: its place, and its sibling if it has one
  select d.doc_id, l.lvl, (d.spot >> l.lvl) & 1 as own, x.h as sib from d join sub s on s.g = d.g join (select unnest(range(64)) as lvl) l on l.lvl < s.height
    left join t x on x.g = d.g and x.lvl = l.lvl and x.pos = xor(d.spot >> l.lvl, 1)
  union all select d.doc_id, s.height + l.lvl, (d.g >> l.lvl) & 1, x.h from d join sub s on s.g = d.g
    join (select distinct lvl from r where n > 1) l on true left join r x on x.lvl = l.lvl and x.pos = xor(d.g >> l.lvl, 1)),
folded(doc_id, lvl, h) as (select doc_id, 0, changed from d union all
  select f.doc_id, f.lvl + 1, sha256(case when s.own = 1 then coalesce(s.sib, '') || f.h else f.h || coalesce(s.sib, '') end)
  from folded f join steps s on s.doc_id = f.doc_id and s.lvl = f.lvl),
ends as (select doc_id, arg_max(h, lvl) as folded_root from folded group by doc_id),
proofs as (select doc_id, sha256(string_agg(coalesce(sib, ''), '' order by lvl)) as proof_sha256 from steps group by doc_id)
select doc_id, leaf, sub.h as subroot, top.h as root, coalesce(proof_sha256, sha256('')) as proof_sha256,
       folded_root, folded_root = top.h as verified
from d join sub using (g) join ends using (doc_id) join (select h from r where n = 1) top on true left join proofs using (doc_id)""")
def op12(spark, sf):
    return merkle.check_documents(table(spark, sf, "documents"))


@register("op13_prefix_trie", f"""
with recursive {_crc_sql('select distinct conv_id from conversations where conv_id is not null')},
t as (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as q
      from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations) where conv_id is not null),
i as (select id as conv_id, crc % 9 as h from crcs),
heads as (select i.conv_id, t.q as d, role, text from i join t on t.conv_id = i.conv_id - i.conv_id % 5 and t.q <= h),
m as (select i.conv_id, h, count(heads.d) as m from i left join heads using (conv_id) group by all),
turns as (select * from heads union all select conv_id, m + q - h, role, text from m join t using (conv_id) where q > h),
p as (select conv_id, 0 as d, '' as k, null::varchar as up, 0 as bytes from i union all
      select conv_id, d, k, coalesce(lag(k) over (partition by conv_id order by d), ''), bytes from (
        select conv_id, d, sha256(to_json(list([role, text]) over (partition by conv_id order by d))::varchar) as k, strlen(text) as bytes from turns)),
n as (select k, d, min(conv_id) as conv_id, count(*) as n_convs, any_value(up) as up, any_value(bytes) * (count(*) - 1) as saved from p group by k, d),
kids as (select up as k, count(*) as n_children from n where d > 0 group by up),
w as (select n.*, coalesce(n_children, 0) as n_children from n left join kids using (k)),
below as (select distinct a.k as top, b.k from p a join p b on a.conv_id = b.conv_id and b.d >= a.d),
sums as (select top as k, count(*) filter (where n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from below join w on below.k = w.k group by top),
last as (select conv_id, arg_max(k, d) as k from p group by conv_id),
ends as (select k, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from last group by k)
select w.conv_id, w.d::bigint as depth, u.conv_id as parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens,
       coalesce(ends_sha256, sha256('')) as ends_sha256
from w join sums using (k) left join ends using (k) left join w u on w.d > 0 and u.k = w.up""")
def op13(spark, sf):
    return prefix_trie.trie(table(spark, sf, "conversations"))


@register("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf):
    return corpus_pipeline.run(spark, sf)
