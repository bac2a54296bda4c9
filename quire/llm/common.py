"""Shared helpers: written tables, global row numbers, text columns, names that meet no other."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.work import freeze as materialize  # writes a table to the shared folder and reads it back
from quire.sources.work import release

__all__ = ["bucket", "fresh", "global_index", "labelled_texts", "lower_ascii", "materialize", "release", "table", "word_count"]

# The six white-space characters of the word definition.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def fresh(taken: Iterable[str], name: str) -> str:
    """name, with as many underscores behind it as make it differ from all names taken, in any case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def global_index(df: DataFrame, order: list[Column], name: str = "row_number") -> tuple[DataFrame, int]:
    """Number all rows from 0 in the given order, without one task that sees them all.

    Rows are dealt by range and sorted inside the ranges; a written table freezes the places.
    Only one count per partition comes to the driver. Returns the numbered rows and their number.
    """
    spark = df.sparkSession
    place, part_, start = (fresh(df.columns, x) for x in ("_place", "_part", "_start"))
    placed = materialize(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    )
    part = F.shiftright(place, 33).cast("int")
    counts = sorted(placed.groupBy(part.alias("part")).count().collect())
    starts, total = [], 0
    for k, n in counts:
        starts.append((k, total))
        total += n
    offsets = spark.createDataFrame(starts, f"{part_} int, {start} long")  # a row per partition
    numbered = (
        placed.withColumn(part_, part)
        .join(F.broadcast(offsets), part_)
        .withColumn(name, F.col(start) + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(part_, start, place)
    )
    return numbered, total


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than BLANKS; null counts as empty."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(doc_id: Column, buckets: int = 5) -> Column:
    """crc32 of the id as text, modulo; bucket 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % buckets


def labelled_texts(docs: DataFrame, labels: DataFrame, most_ones: int, most_zeros: int, most_bytes: int) -> tuple[list[str], list[str]]:
    """A bounded sample of texts labelled 1 and 0 (doc_id, label), none held out: the smallest hashes of ids, and texts of at most so many bytes.

    The ids are chosen first; a broadcast of them picks their texts from the scan.
    """
    known = labels.where(F.col("doc_id").isNotNull() & (bucket(F.col("doc_id")) != 0))
    by_hash = [F.xxhash64("doc_id").asc(), F.col("doc_id").asc()]
    picked = None
    for kind, most in ((1, most_ones), (0, most_zeros)):
        ids = known.where(F.col("label") == kind).select("doc_id", F.lit(kind).alias("_kind")).orderBy(*by_hash).limit(most)
        picked = ids if picked is None else picked.unionAll(ids)
    spark = docs.sparkSession
    chosen = spark.createDataFrame([tuple(r) for r in picked.distinct().collect()], "_id long, _kind int")
    found = docs.where(F.octet_length("text") <= most_bytes).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = sorted((r["_id"], r["_kind"], r["text"]) for r in found.select("_id", "_kind", "text").distinct().collect())
    return [t for _, k, t in rows if k], [t for _, k, t in rows if not k]
