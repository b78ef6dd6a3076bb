"""Exact duplicates: combine locally, merge salted digest groups, combine the winners of the salts.

Texts are equal when identical after deleting ASCII white space; null counts as empty. Every stage groups by the digest
and the whole normalised text, so texts are compared in full and a shared digest alone joins nothing:

1. local: each map task reduces its rows of a text to one before anything is shuffled;
2. salted: rows of a digest that holds 1 / HEAVY_SHARE of all rows or more go to SALTS groups by their map task;
3. global: the winners of the salts, a few rows, are combined.

Of equal texts the row with the most code points in the original stays, then the smallest doc_id; a null doc_id comes
last. Rows that repeat both doc_id and text are the same document: decisions mark each as kept, and ``drop_duplicates``
leaves one. An empty table gives no rows. Extra columns pass through ``drop_duplicates`` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import HEAVY_SHARE, lookup_join, materialise

SALTS = 32
#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"


Digest = Callable[[Column], Column]


def sha256(flat: Column) -> Column:
    return F.sha2(flat, 256)


def _keyed(docs: DataFrame, digest: Digest) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("size"), F.translate(text, WHITE, "").alias("flat"))
    return rows.withColumn("sha", sha256(F.col("flat"))).withColumn("digest", digest(F.col("flat")))


# Size and doc_id in one decimal, which hash aggregation can hold: size * 2^65 + 2^63 - 1 - doc_id, for a null one -1.
BEST = "cast(cast(size as decimal(15,0)) * 36893488147419103232BD + coalesce(9223372036854775807BD - doc_id, -1BD) as decimal(38,0))"
RANK = "(pmod(best + 1, 36893488147419103232BD) - 1)"
KEEP_ID = f"cast(case when {RANK} >= 0 then 9223372036854775807BD - {RANK} end as long)"
KEEP_SIZE = "cast(floor((best + 1) / 36893488147419103232BD) as long)"


def _winners(docs: DataFrame, heavy: DataFrame, digest: Digest) -> DataFrame:
    """digest, best, n and, where it was salted, flat: the salted stage, written once."""
    rows = _keyed(docs, digest).withColumn("best", F.expr(BEST)).select("digest", "flat", "best")
    marked = rows.join(F.broadcast(heavy.withColumn("hot", F.lit(True))), "digest", "left")
    salted = marked.withColumn("salt", F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(-1))
    merged = salted.groupBy("digest", "flat", "salt").agg(F.max("best").alias("best"), F.count("*").alias("n"))
    return materialise(merged.select("digest", "best", "n", "salt", F.when(F.col("salt") >= 0, F.col("flat")).alias("flat")))


def decide(docs: DataFrame, digest: Digest = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and size (code points) of every row.

    digest only deals rows out: texts that share one are told apart by their content.
    """
    keys = materialise(_keyed(docs, digest).select("doc_id", "size", "digest", "sha"))
    total = keys.count()
    heavy = keys.groupBy("digest").count().where(F.col("count") >= max(2, -(-total // HEAVY_SHARE))).select("digest")
    merged = _winners(docs, heavy, digest)
    cold = merged.where("salt < 0").select("digest", "best", "n")
    hot = merged.where("salt >= 0").groupBy("digest", "flat").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    facts = cold.unionByName(hot.select("digest", "best", "n")).select("digest", F.expr(KEEP_ID).alias("keep_id"), F.expr(KEEP_SIZE).alias("keep_size"), F.col("n").alias("group_size"))
    shared = facts.groupBy("digest").count().where("count > 1").select("digest")
    if shared.isEmpty():
        found = lookup_join(keys, facts, "digest", "group_size", total)
    else:
        found = _by_content(docs, keys, facts, shared, digest, total)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("keep_size"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"), "size")


def _by_content(docs: DataFrame, keys: DataFrame, facts: DataFrame, shared: DataFrame, digest: Digest, total: int) -> DataFrame:
    """The same for digests that different texts share: those rows meet by their whole text."""
    shared = materialise(shared)
    alone = lookup_join(keys.join(shared, "digest", "left_anti"), facts.join(shared, "digest", "left_anti"), "digest", "group_size", total)
    rows = _keyed(docs, digest).join(shared, "digest", "left_semi").withColumn("best", F.expr(BEST))
    texts = rows.groupBy("digest", "flat").agg(F.max("best").alias("best"), F.count("*").alias("group_size"))
    texts = texts.select("digest", "flat", F.expr(KEEP_ID).alias("keep_id"), F.expr(KEEP_SIZE).alias("keep_size"), "group_size")
    return alone.unionByName(rows.join(texts, ["digest", "flat"]).select(*alone.columns))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that go, all columns kept; rows that go are few, so they are what is joined."""
    decided = materialise(decide(docs))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = {"__parley_id": F.col("doc_id").cast("long"), "__parley_sha": sha256(F.translate(text, WHITE, "")), "__parley_size": F.length(text).cast("long")}
    gone = decided.where(~F.col("kept")).select(F.col("doc_id").alias("__gone_id"), F.col("text_sha256").alias("__gone_sha"), F.col("size").alias("__gone_size")).distinct()
    match = F.col("__parley_id").eqNullSafe(F.col("__gone_id")) & (F.col("__parley_sha") == F.col("__gone_sha")) & (F.col("__parley_size") == F.col("__gone_size"))
    left = docs.withColumns(keys).join(gone, match, "left_anti")
    kept = decided.where("kept").agg(F.count("*").alias("rows"), F.count_distinct("text_sha256").alias("texts")).first()
    if kept["rows"] > kept["texts"]:
        left = left.dropDuplicates(["__parley_id", "__parley_sha"])
    return left.select(*docs.columns)


def oracle(table: str = "documents") -> str:
    """The decisions in DuckDB's SQL."""
    return f"""
with d as (
  select doc_id, length(coalesce(text, '')) as size,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as flat
  from {table}),
w as (
  select flat, count(*) as group_size, arg_max(doc_id, (size, -doc_id)) as keep_id from d group by flat)
select d.doc_id, w.keep_id, w.group_size, d.doc_id = w.keep_id as kept, sha256(d.flat) as text_sha256,
       cast(d.size as bigint) as size
from d join w using (flat)"""
