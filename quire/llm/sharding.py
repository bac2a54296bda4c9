"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered in the order of (doc_id, md5 of the text), nulls first; a keyed permutation of
[0, N) shuffles the numbers; place p goes to shard p mod S and slot p div S. So the shuffle can be
repeated, shard sizes differ by at most one row (law "rows"), slots have no gaps, and
shard and slot of any row follow from its number alone.

Defined cases: a null text has size 16 and the CRC of no bytes; null and repeated ids are
numbered like others (rows alike in id and text are interchangeable); an empty table gives an empty
result; other columns play no part. Groups are not needed by this law: equal texts may part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import feistel
from quire.llm.common import global_index, materialize

KEY = "shards"
SHARDS = 40


def shard_rows(df: DataFrame, order: list, shards: int = SHARDS, key: str = KEY) -> DataFrame:
    """Add row_number, shard and slot to the rows of df, numbered in the given order."""
    numbered, n = global_index(df, order)
    place = feistel.permute(F.col("row_number"), n, key) if n else F.col("row_number")
    return (
        numbered.withColumn("_p", place)
        .withColumn("shard", (F.col("_p") % shards).cast("int"))
        .withColumn("slot", F.floor(F.col("_p") / shards).cast("long"))
        .drop("_p")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: str = KEY) -> DataFrame:
    """Size, checksum, shard and slot of every document; texts themselves are not shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("_md5"),
        )
    )
    placed = shard_rows(narrow, [F.col("doc_id").asc_nulls_first(), F.col("_md5").asc()], shards, key)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


ORACLE = f"""
WITH RECURSIVE numbered AS (
  SELECT doc_id, coalesce(text, '') AS t, count(*) OVER () AS n,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) - 1 AS row_number
  FROM documents),
crc_table AS (
  SELECT list(c ORDER BY byte) AS crcs FROM (
    SELECT byte, list_reduce([byte] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(byte))),
hexed AS (SELECT row_number, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda v: CAST('0x' || v AS BIGINT)) AS bytes FROM numbered),
summed AS (
  SELECT row_number, xor(4294967295, list_reduce([4294967295] || bytes, lambda c, v: xor(c >> 8, crcs[(xor(c, v) & 255) + 1]))) AS crc
  FROM hexed, crc_table),
{feistel.permute_sql("numbered", "row_number", KEY)}
SELECT doc_id, CAST(octet_length(encode(t)) + 16 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST(x % {SHARDS} AS INTEGER) AS shard, CAST(x // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM numbered JOIN walked USING (row_number) JOIN summed USING (row_number)
"""
