"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op01_sharding, op02_bpe, op03_language, op04_token_files, op05_quality, op06_embedding, op07_token_count, op08_toxicity, op09_decontaminate
from . import op10_simhash as simhash
from .common import fold, table

#: Shards of the sharding query.
SHARDS = [f"shard-{k:03d}" for k in range(64)]
QUALITY, TOXIC = 0.3, 0.5


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out(df: DataFrame, folds: int, which: int) -> DataFrame:
    """A null id is in no fold."""
    return df.withColumn("held_out", F.coalesce(fold("doc_id", folds) == which, F.lit(False)))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op02_bpe.encode_documents(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = op03_language.identify(docs, op03_language.learn(docs))
    return _held_out(found, 3, 1).select("doc_id", "held_out", "lang_pred", "score")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_token_files.round_trip(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def _scored(docs: DataFrame, model, threshold: float) -> DataFrame:
    found = _held_out(op05_quality.score_texts(docs, model), 5, 0)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(docs, op05_quality.learn(docs, table(spark, sf_dir, "labels")), QUALITY)


def op6_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_token_count.count_tokens(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _scored(docs, op08_toxicity.learn(docs, table(spark, sf_dir, "labels")), TOXIC)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_bpe, op3_language, op4_token_files, op5_quality, op6_embedding, op7_token_count, op8_toxicity, op9_decontamination, op10_simhash)}


def _plain_lookup_table(shards: list[str], size: int) -> list[int]:
    """The sharding table once more, by writing out every shard's whole order of preference."""
    import hashlib
    import itertools

    def preference(name: str):
        d = hashlib.md5(name.encode()).hexdigest()
        offset, skip = int(d[:16], 16) % size, int(d[16:], 16) % (size - 1) + 1
        return ((offset + j * skip) % size for j in range(size))

    orders, owner = [preference(s) for s in shards], {}
    for k, order in itertools.cycle(enumerate(orders)):
        owner[next(slot for slot in order if slot not in owner)] = k
        if len(owner) == size:
            return [owner[s] for s in range(size)]


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    size = op01_sharding.TABLE_SIZE
    owners = ",".join(map(str, _plain_lookup_table(SHARDS, size)))
    cosine = """
with v as (select vec_id, embedding::double[] as e from embeddings),
u as (select vec_id, case when e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0 then e end as e from v),
l as (select a.vec_id as s, b.vec_id as t from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.9),
r as ({components}),
n as (select s, count(*) as n from l group by s)
select u.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(r.c, u.vec_id) as component_id, u.vec_id = coalesce(r.c, u.vec_id) as kept
from u left join n on n.s = u.vec_id left join r on r.s = u.vec_id"""
    return {
        "op1_sharding": f"""
with t as (select [{owners}] as owner),
d as (select doc_id, (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {size})::bigint as slot from documents)
select doc_id, slot, owner[slot + 1]::int as shard from d, t""",
        "op6_embedding": "with recursive " + cosine.replace("\nwith ", "", 1).format(components="select s, min(c) as c from walk group by s").replace("r as (select s,", "walk(s, c) as (select s, s from l union select l.t, walk.c from walk join l on l.s = walk.s where walk.c < l.t),\nr as (select s,"),
    }
