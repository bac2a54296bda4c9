"""Record keeping: keyed upserts, scans, queues, snapshots, cascading deletes.

Tables are DataFrames; a write replaces a table or its changed partitions. Timestamps come from the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.status import OWN, Vocabulary
from quire.sources.work import freeze

# The columns of a listed record.
RECORD_COLUMNS = (
    "pdf_id", "filename", "cnr_number", "file_size_bytes", "total_pages", "selected_start_page", "selected_end_page",
    "indexed_pages", "status", "retrieval_status", "index_ready", "chat_ready", "pending_pages", "index_source",
    "queue_bucket", "deferred_decision", "last_error", "review_reason", "batch_run_id", "batch_enqueued_at", "updated_at",
)


def record_list(records: DataFrame, text: str = "") -> DataFrame:
    """All records, or those that a search finds, newest first, with the columns of a listed record."""
    flags = {c: as_flag(F.col(c)) for c in ("index_ready", "chat_ready")}
    return search(records, text, ["filename", "cnr_number", "pdf_id"]).select(*RECORD_COLUMNS).withColumns(flags).orderBy(F.desc("updated_at"), "pdf_id")


def upsert_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or update records; one that doesn't say how many pages are pending has those that are not indexed."""
    pending = F.col("pending_pages") if "pending_pages" in new.columns else F.lit(None).cast("int")
    full = new.withColumn("pending_pages", default_pending(pending, F.col("total_pages"), F.col("indexed_pages")))
    return upsert(old, full, ["pdf_id"])


def save_indexes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or update saved indexes (pdf_id, index, created_at, updated_at), counting their entries."""
    return upsert(old, new.withColumn("total_entries", F.coalesce(F.size("index"), F.lit(0))), ["pdf_id"])


def read_index(saved: DataFrame, kind: str) -> DataFrame:
    """Saved indexes as (pdf_id, index, total_entries, ...), whether they are stored as JSON or as arrays; bad JSON gives none."""
    if saved.schema["index"].dataType.typeName() != "string":
        return saved
    parsed = F.from_json("index", kind)
    return saved.withColumn("index", F.coalesce(parsed, F.array().cast(kind)))


def page_of(first: DataFrame, second: DataFrame, pdf_id, page_num: int) -> DataFrame:
    """One page of a document: from the first table, else from the second."""
    wanted = (F.col("pdf_id") == pdf_id) & (F.col("page_num") == page_num)
    a, b = (t.where(wanted).select("pdf_id", "page_num", "text") for t in (first, second))
    return a.unionByName(b.join(a, ["pdf_id", "page_num"], "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str = "updated_at", created: str | None = "created_at", ties: list[str] | None = None) -> DataFrame:
    """Insert or update by key: the row with the latest seq wins, new before old; created keeps its first value."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = [F.desc("_new"), F.desc(seq), *[F.desc(t) for t in ties or []]]
    out = both.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    if created:
        out = out.withColumn(created, F.min(created).over(W.partitionBy(*keys)))
    return out.where("_n = 1").drop("_n", "_new")


def fold_changes(changes: DataFrame, keys: list[str], seq: list[str], created: str) -> DataFrame:
    """The state after a log of upserts: the last row of each key, with the first value of created."""
    last = F.max_by(F.struct(*[F.col(c) for c in changes.columns]), F.struct(*seq))
    return changes.groupBy(*keys).agg(last.alias("_r"), F.min(created).alias("_c")).select(
        *[F.col("_c").alias(created) if c == created else F.col(f"_r.{c}").alias(c) for c in changes.columns])


def update_where(df: DataFrame, which: Column, now: Column, **fields: Column) -> DataFrame:
    """Set fields, and updated_at, of some rows; nothing changes without fields."""
    if not fields:
        return df
    set_ = {c: F.when(which, v).otherwise(F.col(c)) for c, v in fields.items()}
    if "updated_at" in df.columns:
        set_["updated_at"] = F.when(which, now).otherwise(F.col("updated_at"))
    return df.withColumns(set_)


def delete_cascade(gone: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """The tables without rows of the keys in gone; give children before parents."""
    return [t.join(gone.select(key).distinct(), key, "left_anti") for t in tables]


def with_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of first, and those of second whose key first lacks altogether."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def replace_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Delete all rows of the keys in new, then insert new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def default_pending(pending: Column, total: Column, indexed: Column) -> Column:
    return F.coalesce(pending, F.greatest(total - indexed, F.lit(0)))


def as_flag(c: Column) -> Column:
    return F.coalesce(c.try_cast("boolean"), F.lit(False))


def search(records: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows in one of whose columns the trimmed text occurs, in any case; % and _ in it are wildcards."""
    if not text.strip():
        return records
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.col(c).ilike(f"%{text.strip()}%")
    return records.where(hit)


def page_scan(pages: DataFrame, pdf_id, first: int | None = None, last: int | None = None) -> DataFrame:
    """The pages of one document between two page numbers; both conditions reach the scan."""
    out = pages.where(F.col("pdf_id") == pdf_id)
    if first is not None:
        out = out.where(F.col("page_num") >= first)
    return out.where(F.col("page_num") <= last) if last is not None else out


def _pending(v: Vocabulary) -> Column:
    return (F.col("pending_pages") > 0) & (F.col("deferred_decision") != v.skip) & (F.col("queue_bucket") != v.first_bucket)


def _oldest_first(queue: DataFrame) -> DataFrame:
    return queue.orderBy(*[c for c in ("updated_at", "pdf_id") if c in queue.columns])


def pending_sql(records: DataFrame, v: Vocabulary = OWN) -> DataFrame:
    """The pending queue as SQL sees it, oldest first: nulls are not unequal."""
    return _oldest_first(records.where(_pending(v)))


def pending_nullsafe(records: DataFrame, v: Vocabulary = OWN) -> DataFrame:
    """The pending list of the snapshot: a missing bucket counts as another one, decisions play no part."""
    return records.where((F.coalesce("pending_pages", F.lit(0)) > 0) & ~F.col("queue_bucket").eqNullSafe(v.first_bucket))


def review_queue(records: DataFrame, v: Vocabulary = OWN) -> DataFrame:
    return _oldest_first(records.where(F.col("queue_bucket") == v.review_bucket))


def first_stage_queue(records: DataFrame, v: Vocabulary = OWN) -> DataFrame:
    return _oldest_first(records.where((F.col("queue_bucket") == v.first_bucket) & F.col("status").isin(v.waiting, v.first_running)))


def numbered(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """Number all rows from 1 in the given order, which must tell every row from the others.

    Rows are dealt over tasks by range, and a row's number is its place in its range behind the rows of the ranges
    before; so no task sees them all. The dealt rows are written once, since ranges are sampled; then only one count a
    range is gathered.
    """
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    placed = freeze(dealt.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    cut = placed.withColumn("_range", F.shiftright("_at", 33).cast("int")).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per range
    starts = sizes.select("_range", before.alias("_before"))
    return cut.join(starts, "_range").withColumn(name, (F.col("_before") + F.col("_in") + 1).cast("int")).drop("_at", "_range", "_in", "_before")


def queue_position(queue: DataFrame) -> DataFrame:
    """Add position, from 1, by (updated_at, pdf_id) in the whole queue."""
    return numbered(queue, [F.col("updated_at"), F.col("pdf_id")], "position")


def snapshot(records: DataFrame, v: Vocabulary = OWN) -> DataFrame:
    """(queue, pdf_id): every record once for each queue it stands in."""
    pending = (F.coalesce("pending_pages", F.lit(0)) > 0) & ~F.col("queue_bucket").eqNullSafe(v.first_bucket)
    tags = F.array_compact(F.array(
        F.when(F.col("index_ready"), "index_ready"),
        F.when(F.col("queue_bucket") == v.first_bucket, v.first_bucket),
        F.when(pending, "pending_vectorization"),
        F.when(F.col("chat_ready"), "vectorized"),
        F.when(F.col("queue_bucket") == v.review_bucket, v.review_bucket),
        F.when(F.coalesce("last_error", F.lit("")) != "", "errors"),
    ))
    return records.select(F.explode(tags).alias("queue"), "pdf_id")


def process_pending(records: DataFrame, now: Column, v: Vocabulary = OWN) -> DataFrame:
    """Mark the pending records as vectorized with nothing pending."""
    which = F.coalesce(_pending(v), F.lit(False))
    return update_where(records, which, now, status=F.lit(v.vectorized), retrieval_status=F.lit(v.vectorized), pending_pages=F.lit(0), chat_ready=F.lit(True))


def recent(events: DataFrame, key: str, at: str, keep: int = 8) -> DataFrame:
    """The keys used last, by their last use."""
    used = events.groupBy(key).agg(F.max(at).alias("last_used"))
    return used.orderBy(F.desc("last_used"), key).limit(keep)


def export_json(items: DataFrame, order: str) -> DataFrame:
    """(pdf_id, total_items, index_json): the items of every document as one JSON text. A file's items are one index: bounded by its pages."""
    columns = [c for c in items.columns if c not in ("pdf_id", order)]
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in columns])))
    return items.groupBy("pdf_id").agg(
        F.count("*").alias("total_items"),
        F.to_json(F.transform(listed, lambda s: F.struct(*[s[c].alias(c) for c in columns]))).alias("index_json"))


def file_id(content: Column) -> Column:
    """The first 16 hex digits of the content's md5."""
    return F.substring(F.md5(content), 1, 16)


def normalize_sections(items: DataFrame) -> DataFrame:
    """Page fields of sections, where 0 counts as missing; titles likewise when empty."""
    start = F.coalesce(T.first_nonzero(F.col("pdfPageFrom"), F.col("pageFrom")), F.lit(1))
    end = F.coalesce(T.first_nonzero(F.col("pdfPageTo"), F.col("pageTo"), F.col("pageFrom")), F.lit(1))
    return items.withColumns({"pdfPageFrom": start, "pdfPageTo": end})
