"""Registered queries of this package, with SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontamination, fingerprints, line_dedup, lm, merkle, ngram_join, packing, quality, repair, substring_dedup, token_files, url_filter
from tidemark.llm.common import read
from tidemark.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The rules of the URL query.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _add(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_add("""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * i >= 75 * (a.n + b.n - i)),
e as (select x, y from l union all select y, x from l),
c(doc_id, r) as (select doc_id, doc_id from w union select c.doc_id, e.y from c join e on e.x = c.r)
select c.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(c.r) as component_id from c left join n on n.doc_id = c.doc_id group by c.doc_id""")
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(read(spark, sf_dir, "documents"))


@_add()
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read(spark, sf_dir, "documents"))


@_add()
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_documents(read(spark, sf_dir, "documents"))


@_add()
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(docs, path, tokenizer_path("word_bpe_49k.json"))
    return token_files.read_files(spark, path)


@_add()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = quality.id_hash() % 3 == 1
    scored = quality.score_documents(docs, labels.where(~held_out).select("doc_id", "quality"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_add()
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


@_add()
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@_add()
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(read(spark, sf_dir, "documents")).drop("text_hash")


@_add("""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) as path from u),
r(rh, rp, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
select page_id, host, path,
  (select arg_max(rh || rp, length(rh || rp)) from r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)) as rule,
  coalesce((select arg_max(v, length(rh || rp)) from r where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)), 'allow') as verdict
from h""")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.match_urls(read(spark, sf_dir, "pages"), URL_RULES)


@_add("""
with m as (select distinct conv_id, turn, coalesce(nullif(role, ''), 'unknown') as role, coalesce(text, '') as text,
    coalesce(cast(floor(turn / 64.0) as bigint), -1) as part from conversations),
p as (select distinct conv_id, role as perspective from m where role <> 'system'),
s as (select m.conv_id, perspective, part, turn, role, text, role = perspective as own,
    case when role = 'system' then '<|system|>\n' when role = perspective then '<|assistant|>\n' else '<|user name=' || role || '|>\n' end as head
  from m join p on m.conv_id is not distinct from p.conv_id),
o as (select *, cast(coalesce(sum(length(head) + length(text) + 8) over (partition by conv_id, perspective order by turn nulls first, role, text
    rows between unbounded preceding and 1 preceding), 0) as bigint) as pos from s)
select conv_id, perspective, part, min(pos) as start, count(*) as n_messages,
  string_agg(head || text || '<|end|>\n', '' order by turn nulls first, role, text) as text,
  coalesce(string_agg(case when own then cast(pos + length(head) as varchar) || '-' || cast(pos + length(head) + length(text) as varchar) end, ','
    order by turn nulls first, role, text), '') as spans
from o group by conv_id, perspective, part""".replace("\\n", "\n"))
def op5_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.perspectives(read(spark, sf_dir, "conversations"))
    return rows.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ","))


@_add()
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return lm.score_texts(docs, quality.id_hash() % 10 == 0, tokenizer_path("byte_bpe_50k.json"), 50256)


#: SQL of the CRC-32 of a text: its table of 256 values, and the fold over the bytes.
CRC_TABLE = """crc_table as (select list(v order by i) as crc_values from (select i, list_reduce([i] || range(8),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i)))"""


def crc_sql(text: str) -> str:
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: cast('0x' || h as bigint))"
    return f"""xor(4294967295, list_reduce([4294967295] || {codes}, lambda c, b: xor(c >> 8, crc_values[cast(xor(c & 255, b) + 1 as int)])))"""


def _merkle_sql(levels: int = 8) -> str:
    """Trees of up to 8 ** ``levels`` leaves, level by level, and the fold of every leaf through them."""
    def enc(c: str) -> str:
        return f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"

    def grow(name: str, key: str) -> str:
        out = []
        for k in range(levels):
            out.append(f"""{name}_s{k} as (select *, coalesce(string_agg(d, '') over (partition by {key}, pos // 8 order by pos rows between unbounded preceding and 1 preceding), '') as l,
  coalesce(string_agg(d, '') over (partition by {key}, pos // 8 order by pos rows between 1 following and unbounded following), '') as r from {name}{k})""")
            out.append(f"""{name}{k + 1} as (select {key}, pos // 8 as pos, (n + 7) // 8 as n,
  case when any_value(n) > 1 then sha256(string_agg(d, '' order by pos)) else any_value(d) end as d from {name}{k} group by {key}, pos // 8, n)""")
        return ", ".join(out)

    def climb(name: str, key: str, start: str, first: str) -> str:
        out, last = [], start
        for k in range(levels):
            out.append(f"""{first}{k} as (select x.* exclude (f, proof), case when s.n > 1 then sha256(l || f || r) else f end as f,
  case when s.n > 1 then proof || l || r else proof end as proof from {last} x join {name}_s{k} s on x.{key} is not distinct from s.{key} and s.pos = x.{name}_pos // {8 ** k})""")
            last = f"{first}{k}"
        return ", ".join(out)

    return f"""with {CRC_TABLE},
rows0 as (select doc_id, lang, sha256({" || ".join(enc(c) for c in merkle.FIELDS)}) as leaf,
  case when {crc_sql("coalesce(cast(doc_id as varchar), '')")} % 3 = 0 and doc_id is not null then
    sha256({" || ".join(enc("translate(text, '" + merkle.UPPER + "', '" + merkle.LOWER + "')" if c == "text" else c) for c in merkle.FIELDS)}) end as changed
  from documents, crc_table),
ts0 as (select *, leaf as d, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from rows0),
t0 as (select lang, pos, n, d from ts0), {grow("t", "lang")},
u0 as (select 0 as one, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n, d, lang from t{levels}),
{grow("u", "one")},
start as (select doc_id, ts0.lang as lang, 0 as one, leaf, ts0.pos as t_pos, u0.pos as u_pos, u0.d as subroot, coalesce(changed, leaf) as f, '' as proof
  from ts0 join u0 on ts0.lang is not distinct from u0.lang)
""" + f", {climb('t', 'lang', 'start', 'a')}, {climb('u', 'one', f'a{levels - 1}', 'b')}" + f"""
select doc_id, leaf, subroot, (select d from u{levels}) as root, sha256(proof) as proof_sha256, f as folded_root, f = (select d from u{levels}) as verified
from b{levels - 1}"""


@_add(_merkle_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return merkle.verified_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)


def _repair_sql() -> str:
    """Damage, faults, and a walk over the messages with the best (cost, audit, text) of each of four states."""
    def best(*xs: str) -> str:
        return f"list_sort([{', '.join(xs)}])[1]"

    def put(x: str, cost: str, letter: str, line: str) -> str:
        return (f"struct_pack(c := {x}.c + {cost}, a := {x}.a || '{letter}', "
                f"t := case when {line} is null then {x}.t else {x}.t || case when {x}.t = '' then '' else chr(10) end || {line} end)")

    def ins(x: str, role: str) -> str:
        return put(x, "3", "I", f"'{role}:'")

    def emit(x: str, role: str) -> str:
        return put(x, f"(case when gone then 1000000 when i = '{role[0]}' then 0 else 3 end + 3 * cut)", "K",
                   "role || ':' || text").replace("'K'", f"case when i = '{role[0]}' then 'K' else 'R' end").replace(
                   "role || ':' || text", f"case when i = '{role[0]}' then role else '{role}' end || ':' || text")

    start = "struct_pack(c := {}::bigint, a := '', t := '')"
    return f"""with recursive {CRC_TABLE},
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  {crc_sql("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as kind from conversations, crc_table),
m as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case when kind = 0 then 0 when kind = 3 then 2 else 1 end)) as copy from k),
f as (select conv_id, turn, role, text, left(role, 1) as i, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as last,
    row_number() over w as n, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth,
    lag(left(role, 1)) over w || left(role, 1) as pair from m window w as (partition by conv_id order by turn nulls first, role, sha256(text), copy)),
g as (select *, case when last = '' then 'b' when nth > 1 then 'd' when last not in ('.', '!', '?') then 't' else '' end as fault from f),
h as (select conv_id, n, role, text, i, fault in ('b', 'd') as gone, cast(fault = 't' as int) as cut from g),
walk as (
  select conv_id, 1 as n, {start.format(0)} as s0, {start.format(1000000)} as s1, {start.format(1000000)} as s2, {start.format(1000000)} as s3
    from (select distinct conv_id from h)
  union all
  select conv_id, n + 1, {put('s0', '4', 'D', 'null')}, {best(put('s1', '4', 'D', 'null'), put('s0', "case when gone or i <> 's' then 1000000 else 3 * cut end", 'K', "role || ':' || text"))},
    {best(put('s2', '4', 'D', 'null'), emit('s0', 'user'), emit('s1', 'user'), emit('s3', 'user'))}, {best(put('s3', '4', 'D', 'null'), emit('s2', 'assistant'))}
  from (select conv_id, n, role, text, i, gone, cut, s0, s1, {best('s2', ins('s3', 'user'))} as s2, s3
    from (select conv_id, n, role, text, i, gone, cut, s0, s1, s2, {best('s3', ins('s2', 'assistant'))} as s3
      from (select walk.conv_id, walk.n, role, text, i, gone, cut, s0, s1, {best('s2', ins('s0', 'user'), ins('s1', 'user'))} as s2, s3
        from walk join h on walk.conv_id is not distinct from h.conv_id and walk.n = h.n)))),
done as (select conv_id, {best('s0', 's3', ins('s2', 'assistant'))} as z from walk w
  where n = (select max(n) + 1 from h where h.conv_id is not distinct from w.conv_id)),
stats as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
  count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from g group by conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(z.c, 0) as cost, coalesce(z.a, '') as audit, sha256(coalesce(z.t, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join stats s on o.conv_id is not distinct from s.conv_id
  left join done d on o.conv_id is not distinct from d.conv_id"""


@_add(_repair_sql())
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_and_repaired(read(spark, sf_dir, "conversations"))
