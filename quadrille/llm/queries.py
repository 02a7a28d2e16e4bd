"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op2_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import interleave

    placed = interleave(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import compared

    return compared(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chains, conversations, digests

    own = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(own).alias("text")) for t, r in ((0, "user"), (1, "assistant"))])).alias("x")).select("x.*")
    return digests(conversations(chains(rows.unionByName(extra)), best=1)).withColumnRenamed("conv", "conv_id").drop("leaf")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def _escaped(x: str) -> str:
    from .chat import CONTROL

    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def oracle_sql() -> dict[str, str]:
    from .chat import END, SAYS, TURN

    own = "</s>[INST] ok [/INST]"
    return {
        "op3_warc": """
with p as (select page_id, coalesce(html, '') as body from pages),
f as (select body, min(page_id) as least from p where strlen(body) >= 100 group by body)
select page_id, cast(strlen(body) as bigint) as payload_bytes, sha256(body) as payload_digest,
  case when least < page_id then 'revisit' else 'response' end as record_type,
  case when least < page_id then least end as refers_to
from p left join f using (body)""",
        "op8_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as k from win) where k > 1),
gone as (select distinct doc_id, i + k as p from again, range(20) as t(k)),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, string_agg(word, ' ' order by p) as text, count(*) as n from words anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (doc_id)""",
        "op7_reply_trees": f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{own}' union all select -7, 1, 'assistant', '{own}')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum({len(TURN) + len(SAYS) + len(END)} + length({_escaped("role")}) + length({_escaped("text")})) as bigint) as formatted_chars
from rows group by conv_id""",
    }
