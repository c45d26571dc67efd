"""One query for each training-data operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_round_trip
from .common import table
from .conversation_trie import numbered_turns, prefix_trie, rebuilt
from .decontaminate import contamination
from .interpolated_lm import language_model_scores
from .language_id import predict_language
from .near_dup import near_duplicates
from .neighbours import nearest
from .periodic_runs import periodic_runs, run_digests, with_repeats
from .quality import quality_scores
from .secret_scan import scan_secrets
from .substring_dedup import remove_repeats
from .token_shards import token_shards
from .toxicity import toxicity_scores


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(spark, table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), steps=True)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), n=5, every=50)


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, threshold=0.8)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), least=35)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(table(spark, sf_dir, "documents"))


def op11_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"), order=2)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_repeats(table(spark, sf_dir, "documents")), least=24, times=3))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(numbered_turns(table(spark, sf_dir, "conversations")), every=5, heads=9))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_shards": op1_token_shards,
    "op2_bpe": op2_bpe,
    "op3_neighbours": op3_neighbours,
    "op4_near_dup": op4_near_dup,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_secret_scan": op7_secret_scan,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
    "op11_interpolated_lm": op11_interpolated_lm,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_trie": op13_conversation_trie,
}

#: DuckDB has no crc32: a table of its 256 steps, then a fold over the bytes of the decimal number.
_TRIE_SQL = """
with table_ as (select list(v order by i) as steps from (
  select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i))),
turns as (
  select conv_id, octet_length(encode(coalesce(text, ''))) as bytes,
         sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce(text, ''))) as turn_sha,
         row_number() over (partition by conv_id order by turn nulls first, turn_sha) as pos
  from conversations where conv_id is not null),
own as (select conv_id, count(*) as n from turns group by conv_id),
hashed as (
  select conv_id, conv_id - conv_id % 5 as base, n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: ascii(x)::bigint)),
         lambda c, x: xor(c >> 8, steps[(xor(c, x) & 255) + 1])), 4294967295) % 9 as h
  from own, table_),
plan as (select p.*, least(h, coalesce(b.n, 0)) as k from hashed p left join own b on b.conv_id = p.base),
rows_ as (
  select p.conv_id, t.pos as d, t.turn_sha, t.bytes from plan p join turns t on t.conv_id = p.base and t.pos <= p.h
  union all select p.conv_id, p.k + t.pos - p.h, t.turn_sha, t.bytes from plan p join turns t on t.conv_id = p.conv_id and t.pos > p.h),
whole as (select conv_id, k + greatest(0, n - h) as m from plan),
paths as (
  select conv_id, d, string_agg(turn_sha, '') over (partition by conv_id order by d) as node, bytes from rows_
  union all select conv_id, 0, '', 0 from plan),
nodes as (
  select node, d, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (d = m), '')) as ends_sha256
  from paths join whole using (conv_id) group by node, d),
kids as (select left(node, -64) as node, count(*) as n_children from nodes where d > 0 group by all),
below as (
  select p.node, sum((u.n_convs - 1) * u.bytes) as saved_tokens, count(*) filter (c.node is null) as n_leaves
  from nodes u left join kids c on c.node = u.node join paths p on p.conv_id = u.conv_id and p.d <= u.d group by p.node)
select u.conv_id, cast(u.d as bigint) as depth, q.conv_id as parent_conv_id, cast(u.n_convs as bigint) as n_convs, cast(coalesce(c.n_children, 0) as bigint) as n_children,
       cast(b.n_leaves as bigint) as n_leaves, cast(b.saved_tokens as bigint) as saved_tokens, u.ends_sha256
from nodes u join below b on b.node = u.node left join kids c on c.node = u.node left join nodes q on u.d > 0 and q.node = left(u.node, -64)
"""

#: The other queries can't be said in SQL that ends on whole tables: they tokenize, train models, follow links or compare
#: all lags; tests hold them against brute force, round trips and held-out rows.
ORACLE_SQL: dict[str, str] = {"op13_conversation_trie": _TRIE_SQL}
