"""The registered queries of this package and the SQL some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultferry.llm.chat import Param, formatted
from vaultferry.llm.decontaminate import benchmark_overlap, contaminated
from vaultferry.llm.exact_dedup import exact_duplicates
from vaultferry.llm.html_text import page_texts
from vaultferry.llm.merkle import LOWER, UPPER, merkle_manifest
from vaultferry.llm.mixing import Mix, domain_of, mixed_documents, tokens
from vaultferry.llm.near_dedup import near_duplicates
from vaultferry.llm.nearest import nearest
from vaultferry.llm.quality import quality_scores
from vaultferry.llm.secrets_scan import secret_spans, span_text
from vaultferry.llm.sharding import lookup_table, placed, table_size
from vaultferry.llm.support import table
from vaultferry.llm.token_alignment import token_alignment
from vaultferry.llm.toxicity import toxicity_scores

DOMAINS = ("web", "books", "code")
MIX = Mix(
    weights=(
        {"web": 0.5, "books": 0.3, "code": 0.2},
        {"en": 0.55, "de": 0.2, "fr": 0.15, "es": 0.1},
        {"src0": 2.0},
    ),
    share=0.7,
    epochs=4,
)
TOOLS = {
    "ask": {
        "prompt": Param("string", least=1, most=400),
        "words": Param("integer", least=3, most=60),
    }
}
SHARDS = tuple(f"shard-{n:03d}" for n in range(32))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mix = mixed_documents(docs, domain_of(F.col("source"), DOMAINS), MIX)
    return mix.select(
        F.col("row.doc_id").alias("doc_id"),
        "domain",
        "lang",
        "source",
        "epoch",
        "n_tokens",
        "tokens_taken",
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 85)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", "predicted")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return placed(docs, SHARDS).select("doc_id", "shard")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = quality_scores(docs, table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", "predicted")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn asks the assistant as a tool; the assistant's next turn is the result.

    A question needs the answered question before it.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")

    def call_at(shift: int) -> Column:
        return F.concat_ws("-", F.col("conv_id"), F.col("turn") - shift)

    prompt = F.coalesce("text", F.lit(""))
    calls = turns.where("role = 'user'").select(
        "conv_id",
        "turn",
        call_at(0).alias("call_id"),
        F.lit("ask").alias("tool"),
        F.to_json(F.struct(prompt.alias("prompt"), tokens(prompt).alias("words"))).alias("arguments"),
        F.array(call_at(2)).alias("after"),
    )
    results = turns.where("role = 'assistant'").select(
        "conv_id", "turn", call_at(1).alias("call_id"), F.col("text").alias("content")
    )
    messages = turns.where("role is null or role not in ('user', 'assistant')")
    return formatted(messages, calls, results, TOOLS)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("n_chunks")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


def op12_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_mixing": op2_mixing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_secret_scans": op4_secret_scans,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_html_extraction": op10_html_extraction,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_approximate_nearest_neighbours": op12_approximate_nearest_neighbours,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

SLOTS = table_size(len(SHARDS))

OVERLAP_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), b as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), bi as (
  select item_id, w, least(13, len(w)) as n, unnest(range(0, len(w) - least(13, len(w)) + 1)) as i
  from b where len(w) > 0
), bw as (
  select distinct item_id, n, array_to_string(w[i + 1 : i + n], ' ') as win from bi
), di as (
  select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as i
  from d, (select distinct n from bw) where len(w) >= n
), dw as (
  select doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') as win from di
), m as (
  select doc_id, i, n, item_id from dw join bw using (n, win)
), h as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as p from m) group by doc_id
), t as (
  select doc_id, count(distinct item_id) as n_items,
    string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items
  from m group by doc_id
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""

SHARD_SQL = f"""
with slots as (select unnest({lookup_table(SHARDS, SLOTS).tolist()})::integer as shard,
  unnest(range(0, {SLOTS})) as slot)
select doc_id, shard from documents join slots on slot =
  ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint % {SLOTS}
"""

def _shared(level: int, before: str) -> str:
    """One level of the budget tree: children share what the level above gave their parent."""
    levels = ("domain", "lang", "source")
    names = ", ".join(levels[: level + 1])
    above = ", ".join(levels[:level])
    weights = "".join(f" when '{k}' then {v}" for k, v in MIX.weights[level].items())
    weight = f"(case {levels[level]}{weights} else 1.0 end)::double" if weights else "1.0::double"
    by = f"partition by {above} " if above else ""
    order = f"{by}order by cap / weight, {levels[level]}"
    join = f"join b{before} using ({above})" if above else f"cross join b{before}"
    return f"""
c{level} as (select {names}, sum(total * {MIX.epochs})::double as cap, {weight} as weight
  from leaf group by {names}),
r{level} as (select *, (budget - coalesce(sum(cap) over (
    {order} rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over ({order} rows between current row and unbounded following) as rate
  from c{level} {join}),
b{level} as (select {names}, greatest(coalesce(least(cap, weight
  * max(case when cap > rate * weight then rate end) over ({by})), cap), 0) as budget
  from r{level})"""


MIX_SQL = f"""
with t as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    {list(DOMAINS)}[coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) as int), 0)
      % {len(DOMAINS)} + 1] as domain,
    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0b]+')) as n_tokens,
    coalesce(doc_id::varchar, md5(coalesce(text, ''))) as key
  from documents
), leaf as (select domain, lang, source, sum(n_tokens) as total from t group by all),
b as (select sum(total * {MIX.epochs}) / {MIX.epochs} * {MIX.share}::double as budget from leaf),
{_shared(0, "")}, {_shared(1, "0")}, {_shared(2, "1")},
q as (
  select domain, lang, source, total::bigint as total, floor(round(budget, 3))::bigint as quota
  from b2 join leaf using (domain, lang, source)
), f as (
  select *, if(total > 0, quota // total, 0) as reads,
    quota - if(total > 0, quota // total, 0) * total as rest from q
), p as (
  select t.*, reads, rest,
    ('0x' || substr(md5('{MIX.seed}:' || reads || ':' || key), 1, 15))::bigint as place
  from t join f using (domain, lang, source)
), o as (
  select *, sum(n_tokens) over (partition by domain, lang, source order by place) - n_tokens
    as start from p
)
select doc_id, domain, lang, source, epoch::integer as epoch, n_tokens::integer as n_tokens,
  n_tokens::integer as tokens_taken
from o, unnest(range(0, reads)) as e(epoch)
union all
select doc_id, domain, lang, source, reads::integer, n_tokens::integer,
  least(n_tokens, rest - start)::integer
from o where start < rest
"""

COPIES_SQL = """
with t as (select doc_id, coalesce(text, '') as text from documents),
g as (select text, max(doc_id) as keep_id, count(*) as group_size from t group by text)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(text) as text_sha256
from t join g using (text)
"""

CHAT_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0b]+')) as words
  from conversations
), e as (
  select t.conv_id, t.turn,
    case t.role when 'user' then 'call' when 'assistant' then 'result' else 'message' end as kind,
    case t.role when 'user' then t.conv_id || '-' || t.turn
      when 'assistant' then t.conv_id || '-' || (t.turn - 1) end as call_id,
    case when t.role = 'user' then if(n.turn is null, 'unanswered', 'answered')
      when t.role = 'assistant' then if(p.turn is null, 'orphan', 'result')
      else 'message' end as state,
    case when t.role = 'user' then case when length(t.text) < 1 then 'prompt: below 1'
        when length(t.text) > 400 then 'prompt: above 400'
        when t.words < 3 then 'words: below 3' when t.words > 60 then 'words: above 60' end
      when t.role = 'assistant' and p.turn is null then 'no such call' end as fault,
    case t.role
      when 'user' then '{"arguments":{"prompt":' || to_json(t.text) || ',"words":' || t.words
        || '},"id":"' || t.conv_id || '-' || t.turn || '","name":"ask","type":"call"}'
      when 'assistant' then '{"content":' || to_json(t.text) || ',"id":"' || t.conv_id || '-'
        || (t.turn - 1) || '","type":"result"}'
      else '{"content":' || to_json(t.text) || ',"role":' || to_json(t.role) || '}' end as json
  from t
  left join t n on n.conv_id = t.conv_id and n.turn = t.turn + 1 and n.role = 'assistant'
  left join t p on p.conv_id = t.conv_id and p.turn = t.turn - 1 and p.role = 'user'
)
select conv_id, row_number() over (partition by conv_id order by turn) - 1 as position,
  turn, kind, call_id, state, fault, json from e
"""

def _levels(name: str, key: str, count: int) -> str:
    """Levels of a tree as tables, each run of eight nodes one node of the next level."""
    by = f"{key}, " if key else ""
    group = "1, 2, 3" if key else "1, 2"
    part = f"partition by {by}pos // 8 order by pos rows between"
    return ",".join(
        f"""
{name}{n + 1} as (select {by}if(total > 1, pos // 8, pos) as pos,
  if(total > 1, (total + 7) // 8, 1) as total,
  if(any_value(total) > 1, sha256(string_agg(node, '' order by pos)), any_value(node)) as node
  from {name}{n} group by {group}),
{name}s{n} as (select *,
  coalesce(string_agg(node, '') over ({part} unbounded preceding and 1 preceding), '') as before,
  coalesce(string_agg(node, '') over ({part} 1 following and unbounded following), '') as after
  from {name}{n})"""
        for n in range(count)
    )


def _fold(name: str, key: str, place: str, start: str, count: int) -> str:
    """Fold nodes and proofs of a table up a tree, one level after another."""
    steps, before = [], start
    for n in range(count):
        same = f"x.{key} is not distinct from s.{key} and " if key else ""
        steps.append(f"""
{name}f{n} as (select x.* exclude (folded, proof),
  if(s.total > 1, sha256(s.before || folded || s.after), folded) as folded,
  proof || if(s.total > 1, s.before || s.after, '') as proof
  from {before} x join {name}s{n} s on {same}s.pos = x.{place} // {8 ** n})""")
        before = f"{name}f{n}"
    return ",".join(steps)


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}, '-')"


DEPTH = 9
MERKLE_SQL = f"""
with d as (
  select doc_id, lang, {" || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))} as head,
    text, translate(text, '{UPPER}', '{LOWER}') as lowered,
    list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(
      range(1, len(doc_id::varchar) + 1),
      lambda i: [ord(substr(doc_id::varchar, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: case when x >= 0 then xor(c, x)
        when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as crc
  from documents
), h as (
  select doc_id, lang, sha256(head || {_field("text")}) as node, sha256(head ||
    case when xor(crc, 4294967295) % 3 = 0 then {_field("lowered")} else {_field("text")} end) as shown
  from d
), a0 as (
  select doc_id, lang, node, shown, count(*) over (partition by lang) as total,
    row_number() over (partition by lang order by doc_id nulls first, node) - 1 as pos from h
), {_levels("a", "lang", DEPTH)},
b0 as (select lang, node, count(*) over () as total,
  row_number() over (order by lang nulls first) - 1 as pos from a{DEPTH}),
{_levels("b", "", DEPTH)},
leaf as (select doc_id, lang, pos, node as leaf, shown as folded, '' as proof from a0),
{_fold("a", "lang", "pos", "leaf", DEPTH)},
joined as (select f.* exclude (pos), b0.pos as place, b0.node as subroot
  from af{DEPTH - 1} f join b0 on b0.lang is not distinct from f.lang),
{_fold("b", "", "place", "joined", DEPTH)}
select doc_id, leaf, subroot, b{DEPTH}.node as root, sha256(proof) as proof_sha256,
  folded as folded_root, folded = b{DEPTH}.node as verified
from bf{DEPTH - 1} cross join b{DEPTH}
"""

ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": OVERLAP_SQL,
    "op2_mixing": MIX_SQL,
    "op6_sharding": SHARD_SQL,
    "op8_chat_formatting": CHAT_SQL,
    "op9_exact_dedup": COPIES_SQL,
    "op11_merkle_manifest": MERKLE_SQL,
}
