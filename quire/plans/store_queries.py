"""Queries over records, queues, statuses and stored tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import status as S
from quire.functions import text as T
from quire.operators import store
from quire.plans.catalogue import ENTRIES, RECORDS, base, plain, query, read

R = plain(RECORDS)
NOW = "TIMESTAMP '2002-01-01 00:00:00'"


def _records(spark, d):
    return base(spark, d, RECORDS)


# ---- scans and searches

LISTED = ", ".join(c if c != "pending_pages" else "coalesce(pending_pages, -1) AS pending_pages" for c in store.RECORD_COLUMNS)


@query("record_list", f"SELECT {LISTED} FROM ({R})")
def record_list(spark, d):
    """All records as they are listed, newest first."""
    return store.record_list(_records(spark, d)).withColumn("pending_pages", F.coalesce("pending_pages", F.lit(-1)))


@query("display_names", f"""
SELECT pdf_id, coalesce(nullif(cnr_number, ''), filename) AS card, coalesce(nullif(cnr_number, ''), CAST(pdf_id AS VARCHAR)) AS case_name, coalesce(nullif(filename, ''), CAST(pdf_id AS VARCHAR)) AS file FROM ({R})""")
def display_names(spark, d):
    r = _records(spark, d)
    cnr, file, key = F.col("cnr_number"), F.col("filename"), F.col("pdf_id")
    return r.select("pdf_id", S.display_name(cnr, file).alias("card"), S.display_name(cnr, key).alias("case_name"), S.display_name(file, key).alias("file"))


@query("record_search", f"SELECT pdf_id, filename FROM ({R}) WHERE filename ILIKE '%no_12%' OR cnr_number ILIKE '%no_12%' OR CAST(pdf_id AS VARCHAR) ILIKE '%no_12%'")
def record_search(spark, d):
    return store.search(_records(spark, d), " No_12 ", ["filename", "cnr_number", "pdf_id"]).select("pdf_id", "filename")


@query("page_scan", "SELECT l_orderkey AS pdf_id, l_linenumber AS page_num, l_quantity FROM lineitem WHERE l_orderkey = 7 AND l_linenumber BETWEEN 2 AND 5")
def page_scan(spark, d):
    pages = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("pdf_id"), F.col("l_linenumber").alias("page_num"), "l_quantity")
    return store.page_scan(pages, 7, 2, 5)


@query("point_lookup", f"SELECT pdf_id, filename, status, index_ready FROM ({R}) WHERE pdf_id = 42")
def point_lookup(spark, d):
    return _records(spark, d).where("pdf_id = 42").select("pdf_id", "filename", "status", store.as_flag(F.col("index_ready")).alias("index_ready"))


@query("parent_child", f"""
SELECT r.pdf_id, filename, seq, qty FROM ({R}) AS r JOIN ({plain(ENTRIES)}) AS e USING (pdf_id)""")
def parent_child(spark, d):
    return _records(spark, d).select("pdf_id", "filename").join(base(spark, d, ENTRIES), "pdf_id").select("pdf_id", "filename", "seq", "qty")


# ---- queues

PENDING = "pending_pages > 0 AND deferred_decision <> 'skip' AND queue_bucket <> 'first_stage'"


@query("queue_pending_sql", f"SELECT pdf_id FROM ({R}) WHERE {PENDING}")
def queue_pending_sql(spark, d):
    return store.pending_sql(_records(spark, d)).select("pdf_id")


@query("queue_pending_nullsafe", f"SELECT pdf_id FROM ({R}) WHERE coalesce(pending_pages, 0) > 0 AND queue_bucket IS DISTINCT FROM 'first_stage'")
def queue_pending_nullsafe(spark, d):
    return store.pending_nullsafe(_records(spark, d)).select("pdf_id")


@query("queue_review", f"SELECT pdf_id, updated_at FROM ({R}) WHERE queue_bucket = 'review'")
def queue_review(spark, d):
    return store.review_queue(_records(spark, d)).select("pdf_id", "updated_at")


@query("queue_stage1", f"SELECT pdf_id FROM ({R}) WHERE queue_bucket = 'first_stage' AND status IN ('first_stage_waiting', 'first_stage_running')")
def queue_stage1(spark, d):
    return store.first_stage_queue(_records(spark, d)).select("pdf_id")


SNAP_SQL = f"""
SELECT 'index_ready' AS queue, pdf_id FROM ({R}) WHERE index_ready UNION ALL SELECT 'first_stage', pdf_id FROM ({R}) WHERE queue_bucket = 'first_stage'
UNION ALL SELECT 'pending_vectorization', pdf_id FROM ({R}) WHERE coalesce(pending_pages, 0) > 0 AND queue_bucket IS DISTINCT FROM 'first_stage'
UNION ALL SELECT 'vectorized', pdf_id FROM ({R}) WHERE chat_ready UNION ALL SELECT 'review', pdf_id FROM ({R}) WHERE queue_bucket = 'review'
UNION ALL SELECT 'errors', pdf_id FROM ({R}) WHERE last_error <> ''"""


@query("queue_snapshot", SNAP_SQL)
def queue_snapshot(spark, d):
    return store.snapshot(_records(spark, d))


@query("queue_lengths", f"SELECT queue, count(*) AS n FROM ({SNAP_SQL}) GROUP BY queue")
def queue_lengths(spark, d):
    return store.snapshot(_records(spark, d)).groupBy("queue").agg(F.count("*").alias("n"))


@query("queue_position", f"SELECT pdf_id, CAST(row_number() OVER (ORDER BY updated_at, pdf_id) AS INT) AS position FROM ({R}) WHERE queue_bucket = 'first_stage'")
def queue_position(spark, d):
    """Places in one whole queue."""
    q = _records(spark, d).where(F.col("queue_bucket") == S.OWN.first_bucket).select("pdf_id", "updated_at")
    return store.queue_position(q).select("pdf_id", "position")


@query("pending_process", f"""
SELECT pdf_id, CASE WHEN p THEN 'vectorized' ELSE status END AS status, CASE WHEN p THEN 'vectorized' ELSE retrieval_status END AS retrieval_status,
  CASE WHEN p THEN 0 ELSE coalesce(pending_pages, -1) END AS pending_pages, CASE WHEN p THEN TRUE ELSE chat_ready END AS chat_ready, CASE WHEN p THEN {NOW} ELSE updated_at END AS updated_at
FROM (SELECT *, coalesce({PENDING}, FALSE) AS p FROM ({R}))""")
def pending_process(spark, d):
    out = store.process_pending(_records(spark, d), F.expr(NOW))
    return out.select("pdf_id", "status", "retrieval_status", F.coalesce("pending_pages", F.lit(-1)).alias("pending_pages"), "chat_ready", "updated_at")


# ---- statuses

_S, _R = "lower(coalesce(status, ''))", "lower(coalesce(retrieval_status, ''))"
TONE_SQL = f"""SELECT *, CASE WHEN queue_bucket = 'review' OR {_S} = 'needs_review' OR review_reason <> '' THEN 'review'
  WHEN {_S} = 'failed' OR {_R} = 'failed' THEN 'error' WHEN contains({_R}, 'running') OR contains({_S}, 'running') THEN 'running'
  WHEN {_R} = 'vectorized' OR {_S} = 'vectorized' OR chat_ready THEN 'ready'
  WHEN {_S} = 'index_ready' OR index_ready THEN CASE WHEN coalesce(pending_pages, 0) > 0 THEN 'staged' ELSE 'indexed' END
  WHEN coalesce(pending_pages, 0) > 0 OR {_R} IN ('full_ingestion_deferred', 'full_ingestion_waiting') THEN 'queued' ELSE 'neutral' END AS tone FROM ({R})"""
LABEL_SQL = """CASE tone WHEN 'review' THEN 'Review Queue' WHEN 'ready' THEN 'Vectorized' WHEN 'indexed' THEN 'Indexed' WHEN 'staged' THEN 'Indexed Only'
  WHEN 'queued' THEN 'Pending Queue' WHEN 'running' THEN 'Processing' WHEN 'error' THEN 'Needs Review' ELSE 'Saved' END"""
TEXT_SQL = """CASE WHEN status = 'first_stage_waiting' THEN 'Waiting for Index' WHEN status = 'first_stage_running' THEN 'Index Running' WHEN status = 'extracting_text' THEN 'Extracting Text'
  WHEN status = 'building_index' THEN 'Building Index'
  WHEN status = 'index_ready' AND retrieval_status = 'full_ingestion_waiting' THEN 'Index Ready, Review Pending' WHEN status = 'index_ready' THEN 'Index Ready'
  WHEN retrieval_status = 'full_ingestion_running' THEN 'Full Ingestion Running' WHEN status = 'vectorized' OR retrieval_status = 'vectorized' THEN 'Vectorized'
  WHEN status = 'failed' OR retrieval_status = 'failed' THEN 'Failed' ELSE status END"""
STEP_SQL = """CASE WHEN review_reason <> '' OR status = 'needs_review' OR queue_bucket = 'review' THEN 'Sent to review' WHEN status = 'building_index' THEN 'Building index'
  WHEN status = 'vectorizing' THEN 'Vectorizing' WHEN status = 'extracting_text' OR retrieval_status = 'full_ingestion_running' THEN 'Extracting text'
  WHEN status = 'vectorized' OR index_ready OR chat_ready THEN 'Finalized' WHEN status = 'first_stage_waiting' THEN 'Queued' ELSE 'Ready' END"""
SAY_SQL = """CASE WHEN status = 'first_stage_running' THEN 'The index of the whole PDF is being built in the background.' WHEN review_reason <> '' THEN 'Flagged for review: ' || review_reason
  WHEN status = 'first_stage_waiting' OR queue_bucket = 'first_stage' THEN 'Uploaded; the whole PDF waits for its index. You may close the browser, the backend goes on.'
  WHEN retrieval_status = 'full_ingestion_running' AND pending_pages > 0 THEN 'All pages are being read and vectorized before the last index is built.'
  WHEN status = 'index_ready' AND pending_pages > 0 AND retrieval_status = 'full_ingestion_waiting' THEN 'Legacy partial record detected. Remaining pages are queued for full ingestion.'
  WHEN status = 'index_ready' AND pending_pages > 0 THEN 'Legacy partial record detected. Remaining pages can be vectorized from the deferred queue.'
  WHEN pending_pages > 0 THEN 'Legacy partial record detected. Remaining pages are still pending vectorization.' ELSE 'This PDF is fully ready in the backend library.' END"""


def _toned(spark, d):
    c = F.col
    r = _records(spark, d)
    return r.withColumn("tone", S.tone(c("status"), c("retrieval_status"), c("queue_bucket"), c("review_reason"), c("pending_pages"), c("index_ready"), c("chat_ready")))


@query("status_tone", f"SELECT pdf_id, tone, {LABEL_SQL} AS label, {TEXT_SQL} AS status_text, {STEP_SQL} AS step, {SAY_SQL} AS say FROM ({TONE_SQL})")
def status_tone(spark, d):
    c = F.col
    return _toned(spark, d).select(
        "pdf_id", "tone", S.tone_label(c("tone")).alias("label"), S.status_text(c("status"), c("retrieval_status")).alias("status_text"),
        S.step_label(c("status"), c("retrieval_status"), c("queue_bucket"), c("review_reason"), c("index_ready"), c("chat_ready")).alias("step"),
        S.description(c("status"), c("retrieval_status"), c("queue_bucket"), c("review_reason"), c("pending_pages")).alias("say"))


@query("tone_counts", f"""
SELECT CAST(count_if(tone IN ('indexed', 'staged')) AS BIGINT) AS indexed, CAST(count_if(tone = 'ready') AS BIGINT) AS ready,
  CAST(count_if(tone = 'review') AS BIGINT) AS review, CAST(count_if(NOT index_ready) AS BIGINT) AS not_ready FROM ({TONE_SQL})""")
def tone_counts(spark, d):
    t = F.col("tone")
    return _toned(spark, d).agg(
        F.count_if(t.isin("indexed", "staged")).alias("indexed"), F.count_if(t == "ready").alias("ready"),
        F.count_if(t == "review").alias("review"), F.count_if(~F.col("index_ready")).alias("not_ready"))


RUNNERS = """SELECT event_id, event_type = 'click' AS running, event_id % 5 = 0 AS stopping, event_id % 7 = 0 AS paused, event_id % 2 = 0 AS other, event_id % 13 = 0 AS other_stopping,
  CAST(event_id % 90 AS INT) AS processed, CAST(user_id % 60 AS INT) AS total, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 1000000.0 - value * 3 END AS beat,
  CASE event_id % 6 WHEN 0 THEN 'toc' WHEN 1 THEN 'toc-image' WHEN 2 THEN 'auto' WHEN 3 THEN 'manual' WHEN 4 THEN 'toc-stitch' ELSE NULL END AS source FROM {events}"""
AGE_SQL = "CASE WHEN coalesce(beat, 0) = 0 THEN 0 ELSE CAST(greatest(round(1000000 - beat), 0) AS BIGINT) END"


@query("heartbeat_age", f"SELECT event_id, {AGE_SQL} AS age FROM ({plain(RUNNERS)})")
def heartbeat_age(spark, d):
    return base(spark, d, RUNNERS).select("event_id", S.heartbeat_age(F.lit(1000000.0), F.col("beat")).alias("age"))


@query("system_status", f"""
SELECT event_id, CASE WHEN running AND {AGE_SQL} > 90 THEN 'stuck' WHEN (running AND stopping) OR other_stopping THEN 'stopping' WHEN paused THEN 'paused' WHEN running OR other THEN 'running' ELSE 'idle' END AS status,
  CASE WHEN running AND {AGE_SQL} > 90 THEN 'Stuck' WHEN paused THEN 'Paused' WHEN running AND stopping THEN 'Stopping' WHEN running THEN 'Running' ELSE 'Idle' END AS runner,
  CASE WHEN running THEN least(processed + 1, total) ELSE 0 END AS position,
  CASE WHEN source IN ('toc', 'toc-image') THEN 'TOC' WHEN source = 'auto' THEN 'AI' WHEN source = 'manual' THEN 'MAN' ELSE 'GAP' END AS badge FROM ({plain(RUNNERS)})""")
def system_status(spark, d):
    c, now = F.col, F.lit(1000000.0)
    main = F.struct("running", c("stopping").alias("pausing"), "paused", "beat")
    others = F.array(F.struct(c("other").alias("running"), c("other_stopping").alias("stopping")))
    return base(spark, d, RUNNERS).withColumn("main", main).select(
        "event_id", S.system_status(c("main"), others, now).alias("status"), S.runner_label(c("main"), now).alias("runner"),
        S.runner_position(c("running"), c("processed"), c("total")).alias("position"), S.source_badge(c("source")).alias("badge"))


# ---- names, labels, page fields

NAMED = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Batch_No_' || CAST(c_custkey AS STRING) || '-A_' || c_mktsegment || '_Vs_State.pdf' WHEN 1 THEN 'Appeal no 12/' || CAST(c_custkey AS STRING) || ' High Court.PDF' WHEN 2 THEN c_name || '  v. ' || c_mktsegment || ' versus X' ELSE c_name END AS name FROM {customer}"
META_STEM = r"trim(regexp_replace(regexp_replace(regexp_replace(name, '(?i)\.pdf$', ''), '[_-]+', ' ', 'g'), '\s+', ' ', 'g'))"
SIDES = r"string_split(regexp_replace(title, '(?i)\s+(?:vs\.?|versus|v\.)\s+', chr(1), 'g'), chr(1))"
META_SQL = rf"""
SELECT id, name, title, upper(regexp_extract(title, '(?i)\bbatch\s*(?:no|number)?\.?\s*[:#-]?\s*([a-z0-9/-]+)', 1)) AS batch_no,
  trim(regexp_extract(title, '(?i)\b(?:case|appeal|petition|revision|application|writ|suit)\s*(?:no|number)?\.?\s*[:#-]?\s*([a-z0-9/-]+)')) AS case_no,
  CASE WHEN len({SIDES}) > 1 THEN trim({SIDES}[1]) ELSE '' END AS plaintiff, CASE WHEN len({SIDES}) > 1 THEN trim(array_to_string({SIDES}[2:], ' Vs ')) ELSE '' END AS defendant,
  trim(regexp_replace(regexp_extract(title, '(?i)\b([a-z\s]+court)\b', 1), '\s+', ' ', 'g')) AS court FROM (SELECT *, {META_STEM} AS title FROM ({plain(NAMED)}))"""


def _meta(spark, d):
    return base(spark, d, NAMED).withColumn("m", T.document_meta(F.col("name"))).select(
        "id", "name", "m.title", F.col("m.batchNo").alias("batch_no"), F.col("m.caseNo").alias("case_no"), "m.plaintiff", "m.defendant", "m.court")


@query("doc_meta", META_SQL)
def doc_meta(spark, d):
    return _meta(spark, d)


@query("applicant_text", f"SELECT id, CASE WHEN plaintiff <> '' THEN plaintiff || ' Vs ' || coalesce(nullif(defendant, ''), '-') WHEN id % 2 = 0 AND title <> '' THEN title ELSE upper(replace(name, '.pdf', '')) END AS applicant FROM ({META_SQL})")
def applicant_text(spark, d):
    title = F.when(F.col("id") % 2 == 0, F.col("title")).otherwise(F.lit(""))
    return _meta(spark, d).select("id", T.applicant(F.col("plaintiff"), F.col("defendant"), title, F.col("name")).alias("applicant"))


@query("filename_sanitize", f"""SELECT id, substr(regexp_replace(name, '[^\\p{{L}}\\p{{N}}_\\-.]', '_', 'g'), 1, 20) AS safe, ends_with(lower(name), '.pdf') AS is_pdf FROM ({plain(NAMED)})""")
def filename_sanitize(spark, d):
    return base(spark, d, NAMED).select("id", T.safe_file_name(F.col("name"), 20).alias("safe"), F.endswith(F.lower("name"), F.lit(".pdf")).alias("is_pdf"))


SPANS = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_partkey % 9 AS INT) END AS a, CAST(l_suppkey % 9 AS INT) AS b, CAST(l_partkey % 7 AS INT) AS c, CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE CAST(l_suppkey % 7 AS INT) END AS e FROM {lineitem}"


def _span_sql(x, y):
    return f"CASE WHEN {x} >= 1 THEN CASE WHEN {x} = coalesce(nullif({y}, 0), {x}) THEN CAST({x} AS VARCHAR) ELSE {x} || '-' || coalesce(nullif({y}, 0), {x}) END END"


@query("page_value_text", f"""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN m IS NULL THEN coalesce(o, '-') WHEN o IS NULL OR m = o THEN m ELSE 'PDF ' || m || ' | TOC ' || o END AS shown
FROM (SELECT *, {_span_sql('a', 'b')} AS m, {_span_sql('c', 'e')} AS o FROM ({plain(SPANS)}))""")
def page_value_text(spark, d):
    c = F.col
    return base(spark, d, SPANS).select("l_orderkey", "l_linenumber", "l_partkey", T.page_value(c("a"), c("b"), c("c"), c("e"), "PDF", "TOC").alias("shown"))


FORMS = "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 4 WHEN 0 THEN '' ELSE CAST(l_partkey % 50 AS STRING) END AS tf, CASE l_suppkey % 3 WHEN 0 THEN 'x' ELSE CAST(l_suppkey % 50 AS STRING) END AS tt, CASE l_partkey % 3 WHEN 0 THEN '' ELSE CAST(l_suppkey % 40 AS STRING) || 'a' END AS pf, CASE l_suppkey % 5 WHEN 0 THEN '' ELSE CAST(l_partkey % 45 AS STRING) END AS pt, CAST(l_linenumber AS INT) AS stored, CAST(l_orderkey % 30 + 1 AS INT) AS total FROM {lineitem}"


def _int_sql(x):
    return rf"TRY_CAST(regexp_extract({x}, '^\s*(-?\d+)', 1) AS INT)"


@query("page_clamp", f"""
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(ntf, -1) AS ntf, coalesce(ntt, -1) AS ntt, npf, greatest(npf, least(coalesce(nullif(ipt, 0), nullif(ntt, 0), npf), total)) AS npt FROM (
  SELECT *, greatest(1, least(coalesce(nullif(ipf, 0), nullif(ntf, 0), nullif(stored, 0), 1), total)) AS npf FROM (
    SELECT *, CASE WHEN itt IS NOT NULL THEN greatest(coalesce(ntf, 1), least(itt, total)) ELSE ntf END AS ntt FROM (
      SELECT *, CASE WHEN itf IS NOT NULL THEN greatest(1, least(itf, total)) END AS ntf FROM (
        SELECT *, {_int_sql('tf')} AS itf, {_int_sql('tt')} AS itt, {_int_sql('pf')} AS ipf, {_int_sql('pt')} AS ipt FROM ({plain(FORMS)})))))""")
def page_clamp(spark, d):
    c = F.col
    f = base(spark, d, FORMS).withColumn("f", T.form_pages(c("tf"), c("tt"), c("pf"), c("pt"), c("stored"), c("total")))
    return f.select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce("f.tocFrom", F.lit(-1)).alias("ntf"), F.coalesce("f.tocTo", F.lit(-1)).alias("ntt"), c("f.pdfFrom").alias("npf"), c("f.pdfTo").alias("npt"))


STAGE_SQL = "CASE k WHEN 'ocr_time' THEN 'OCR' WHEN 'toc_detection' THEN 'TOC detection' WHEN 'click' THEN 'A click' ELSE trim(replace(k, '_', ' ')) END"
KEYS = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ocr_time' WHEN 1 THEN 'toc_detection' WHEN 2 THEN 'some_' || event_type || '_' ELSE event_type END AS k FROM {events}"


@query("stage_label", f"SELECT event_id, {STAGE_SQL} AS label FROM ({plain(KEYS)})")
def stage_label(spark, d):
    return base(spark, d, KEYS).select("event_id", T.stage_label(F.col("k"), {"click": "A click"}).alias("label"))


SUBS = "SELECT p_brand AS brand, p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN 'x' ELSE CAST(p_size AS STRING) END AS code, p_name AS name FROM {part}"


@query("sub_document_order", f"SELECT id, CAST(row_number() OVER (PARTITION BY brand ORDER BY TRY_CAST(code AS INT) NULLS LAST, name, id) AS INT) AS place FROM ({plain(SUBS)})")
def sub_document_order(spark, d):
    w = W.partitionBy("brand").orderBy(F.col("code").try_cast("int").asc_nulls_last(), "name", "id")
    return base(spark, d, SUBS).select("id", F.row_number().over(w).alias("place"))


@query("title_choice", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN NULL ELSE p_type END, ''), nullif(CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END, ''), nullif(p_brand, ''), '') AS title FROM part")
def title_choice(spark, d):
    k = F.col("p_partkey")
    shown = F.when(k % 3 == 0, "").when(k % 3 == 1, None).otherwise(F.col("p_type"))
    return read(spark, d, "part").select("p_partkey", T.first_full(shown, F.when(k % 5 == 0, "").otherwise(F.col("p_name")), F.col("p_brand")).alias("title"))


SECTIONS = "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 3 AS INT) AS pdfPageFrom, CAST(l_suppkey % 2 AS INT) AS pdfPageTo, CAST(l_partkey % 5 AS INT) AS pageFrom, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE CAST(l_suppkey % 5 AS INT) END AS pageTo FROM {lineitem}"


@query("section_normalize", f"""SELECT l_orderkey, l_linenumber, l_partkey, coalesce(nullif(pdfPageFrom, 0), nullif(pageFrom, 0), 1) AS page_from,
  coalesce(nullif(pdfPageTo, 0), nullif(pageTo, 0), nullif(pageFrom, 0), 1) AS page_to FROM ({plain(SECTIONS)})""")
def section_normalize(spark, d):
    s = store.normalize_sections(base(spark, d, SECTIONS))
    return s.select("l_orderkey", "l_linenumber", "l_partkey", F.col("pdfPageFrom").alias("page_from"), F.col("pdfPageTo").alias("page_to"))


# ---- edits, slices, caches

@query("batch_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(lower(coalesce(o_orderpriority, '')), lower('-MED'))")
def batch_filter(spark, d):
    return read(spark, d, "orders").where(F.contains(F.lower(F.coalesce("o_orderpriority", F.lit(""))), F.lower(F.lit("-MED")))).select("o_orderkey", "o_orderpriority")


@query("edit_rows", f"""
SELECT pdf_id, title, CAST(row_number() OVER (PARTITION BY pdf_id ORDER BY page, ord) AS INT) AS place FROM (
  SELECT pdf_id, 'row ' || seq AS title, qty AS page, seq AS ord FROM ({plain(ENTRIES)}) WHERE seq <> 2
  UNION ALL SELECT DISTINCT pdf_id, 'added', 10, 1000 FROM ({plain(ENTRIES)}))""")
def edit_rows(spark, d):
    """Remove the second row of each document, append one, order by page again."""
    rows = base(spark, d, ENTRIES).select("pdf_id", F.concat(F.lit("row "), F.col("seq").cast("string")).alias("title"), F.col("qty").alias("page"), F.col("seq").alias("ord"))
    added = rows.select("pdf_id").distinct().select("pdf_id", F.lit("added").alias("title"), F.lit(10).alias("page"), F.lit(1000).alias("ord"))
    w = W.partitionBy("pdf_id").orderBy("page", "ord")
    return rows.where("ord != 2").unionByName(added).select("pdf_id", "title", F.row_number().over(w).alias("place"))


@query("row_slice", f"SELECT pdf_id, status, CAST(row_number() OVER (ORDER BY updated_at DESC, pdf_id) AS INT) AS n FROM ({R}) WHERE status <> 'failed' QUALIFY n BETWEEN 11 AND 130")
def row_slice(spark, d):
    """Rows 11 to 130 of the filtered list, newest first."""
    listed = _records(spark, d).where("status != 'failed'").select("pdf_id", "status", "updated_at")
    return store.numbered(listed, [F.desc("updated_at"), F.asc("pdf_id")], "n").where(F.col("n").between(11, 130)).drop("updated_at")


@query("recent_cache", "SELECT user_id, max(ts) AS last_used FROM events GROUP BY user_id ORDER BY last_used DESC, user_id LIMIT 8")
def recent_cache(spark, d):
    return store.recent(read(spark, d, "events"), "user_id", "ts")


# ---- writes

CHANGES = "SELECT event_id, user_id AS pdf_id, event_type AS status, value, ts AS updated_at, ts AS created_at FROM {events}"


@query("record_upsert", f"""
SELECT pdf_id, arg_max(status, event_id) AS status, arg_max(value, event_id) AS value, min(created_at) AS created_at, arg_max(updated_at, event_id) AS updated_at FROM ({plain(CHANGES)}) GROUP BY pdf_id""")
def record_upsert(spark, d):
    folded = store.fold_changes(base(spark, d, CHANGES), ["pdf_id"], ["event_id"], "created_at")
    return folded.select("pdf_id", "status", "value", "created_at", "updated_at")


OLD_PAGES = f"SELECT pdf_id, seq AS page_num, qty, CAST('1999-01-01 00:00:00' AS TIMESTAMP) AS created_at, CAST('1999-01-01 00:00:00' AS TIMESTAMP) AS updated_at FROM ({ENTRIES}) WHERE seq <= 4"
NEW_PAGES = f"SELECT pdf_id, seq AS page_num, qty * 2 AS qty, CAST('2001-01-01 00:00:00' AS TIMESTAMP) AS created_at, CAST('2001-01-01 00:00:00' AS TIMESTAMP) AS updated_at FROM ({ENTRIES}) WHERE seq >= 3"


@query("page_upsert", f"""
WITH o AS ({plain(OLD_PAGES)}), n AS ({plain(NEW_PAGES)})
SELECT coalesce(n.pdf_id, o.pdf_id) AS pdf_id, coalesce(n.page_num, o.page_num) AS page_num, coalesce(n.qty, o.qty) AS qty, coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at
FROM o FULL JOIN n ON o.pdf_id = n.pdf_id AND o.page_num = n.page_num""")
def page_upsert(spark, d):
    return store.upsert(base(spark, d, OLD_PAGES), base(spark, d, NEW_PAGES), ["pdf_id", "page_num"])


@query("record_pending_default", f"""
SELECT pdf_id, CASE WHEN pdf_id % 2 = 0 THEN coalesce(pending_pages, greatest(total_pages - indexed_pages, 0)) ELSE coalesce(pending_pages, -1) END AS pending_pages,
  CASE WHEN pdf_id % 2 = 0 THEN {NOW} ELSE updated_at END AS updated_at, updated_at AS created_at FROM ({R})""")
def record_pending_default(spark, d):
    """Every second record is stored again; its pending pages follow from its counts where they aren't given."""
    old = _records(spark, d).withColumn("created_at", F.col("updated_at"))
    again = old.where("pdf_id % 2 = 0").withColumns({"updated_at": F.expr(NOW), "created_at": F.expr(NOW)})
    out = store.upsert_records(old, again)
    return out.select("pdf_id", F.coalesce("pending_pages", F.lit(-1)).alias("pending_pages"), "updated_at", "created_at")


@query("index_upsert", f"""
WITH e AS ({plain(ENTRIES)}), n AS (SELECT pdf_id, count(*) AS n FROM e WHERE pdf_id % 3 = 0 AND seq <= 2 GROUP BY pdf_id), o AS (SELECT pdf_id, count(*) AS n FROM e WHERE pdf_id % 2 = 0 GROUP BY pdf_id)
SELECT coalesce(n.pdf_id, o.pdf_id) AS pdf_id, CAST(coalesce(n.n, o.n) AS INT) AS total_entries, CASE WHEN o.pdf_id IS NOT NULL THEN TIMESTAMP '1999-01-01 00:00:00' ELSE {NOW} END AS created_at
FROM o FULL JOIN n ON o.pdf_id = n.pdf_id""")
def index_upsert(spark, d):
    """Saved indexes replaced by newer ones, with the number of their entries."""
    def saved(rows, at):
        listed = rows.groupBy("pdf_id").agg(F.array_sort(F.collect_list(F.struct("seq", "qty"))).alias("index"))
        return listed.withColumns({"created_at": F.expr(at), "updated_at": F.expr(at)})

    e = base(spark, d, ENTRIES)
    none = saved(e.limit(0), NOW).withColumn("total_entries", F.lit(0))
    first = store.save_indexes(none, saved(e.where("pdf_id % 2 = 0"), "TIMESTAMP '1999-01-01 00:00:00'"))
    return store.save_indexes(first, saved(e.where("pdf_id % 3 = 0 AND seq <= 2"), NOW)).select("pdf_id", "total_entries", "created_at")


@query("partial_update", f"SELECT pdf_id, CASE WHEN pdf_id % 5 = 0 THEN 'redo' ELSE review_reason END AS review_reason, CASE WHEN pdf_id % 5 = 0 THEN {NOW} ELSE updated_at END AS updated_at FROM ({R})")
def partial_update(spark, d):
    out = store.update_where(_records(spark, d), F.col("pdf_id") % 5 == 0, F.expr(NOW), review_reason=F.lit("redo"))
    return out.select("pdf_id", "review_reason", "updated_at")


@query("cascade_delete", f"""
SELECT 'record' AS kind, count(*) AS n FROM ({R}) WHERE pdf_id % 9 <> 0 UNION ALL SELECT 'page', count(*) FROM ({plain(ENTRIES)}) WHERE pdf_id % 9 <> 0""")
def cascade_delete(spark, d):
    records = _records(spark, d)
    pages, kept = store.delete_cascade(records.where("pdf_id % 9 = 0"), "pdf_id", base(spark, d, ENTRIES), records)
    return kept.agg(F.lit("record").alias("kind"), F.count("*").alias("n")).unionAll(pages.agg(F.lit("page").alias("kind"), F.count("*").alias("n")))


@query("fallback_union", f"""
WITH a AS (SELECT pdf_id, seq, qty FROM ({plain(ENTRIES)}) WHERE pdf_id % 3 = 0), b AS (SELECT pdf_id, seq, -qty AS qty FROM ({plain(ENTRIES)}) WHERE pdf_id % 2 = 0)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE pdf_id NOT IN (SELECT pdf_id FROM a)""")
def fallback_union(spark, d):
    e = base(spark, d, ENTRIES)
    return store.with_fallback(e.where("pdf_id % 3 = 0").select("pdf_id", "seq", "qty"), e.where("pdf_id % 2 = 0").select("pdf_id", "seq", (-F.col("qty")).alias("qty")), "pdf_id")


@query("replace_partition", f"""
WITH e AS (SELECT pdf_id, seq, qty FROM ({plain(ENTRIES)})), n AS (SELECT pdf_id, seq + 100 AS seq, qty FROM e WHERE pdf_id % 4 = 1 AND seq < 3)
SELECT * FROM e WHERE pdf_id NOT IN (SELECT pdf_id FROM n) UNION ALL SELECT * FROM n""")
def replace_partition(spark, d):
    e = base(spark, d, ENTRIES).select("pdf_id", "seq", "qty")
    return store.replace_keys(e, e.where("pdf_id % 4 = 1 AND seq < 3").withColumn("seq", F.col("seq") + 100), "pdf_id")


@query("versioned_pages", f"""
WITH e AS (SELECT pdf_id, seq, qty FROM ({plain(ENTRIES)})), n AS (SELECT pdf_id, seq + 100 AS seq, qty FROM e WHERE pdf_id % 4 = 1 AND seq < 3)
SELECT 1 AS version, * FROM e UNION ALL SELECT 2, * FROM e WHERE pdf_id NOT IN (SELECT pdf_id FROM n) UNION ALL SELECT 2, * FROM n
UNION ALL SELECT 3, * FROM e WHERE pdf_id NOT IN (SELECT pdf_id FROM n) AND pdf_id % 9 <> 0 UNION ALL SELECT 3, * FROM n WHERE pdf_id % 9 <> 0""")
def versioned_pages(spark, d):
    """Three versions of the stored pages: as first written, with some documents replaced, without deleted ones."""
    from quire.sources.versions import Tables
    from quire.sources.work import new_folder

    e, records = base(spark, d, ENTRIES).select("pdf_id", "seq", "qty"), _records(spark, d).select("pdf_id", "filename")
    tables = Tables(spark, new_folder(spark), buckets=8)
    tables.commit({"pages": e, "records": records})
    tables.commit({"pages": e.where("pdf_id % 4 = 1 AND seq < 3").withColumn("seq", F.col("seq") + 100)})
    tables.remove(records.where("pdf_id % 9 = 0"), "pages", "records")
    read = [tables.read("pages", k).select(F.lit(k).alias("version"), "pdf_id", "seq", "qty") for k in (1, 2, 3)]
    return read[0].unionAll(read[1]).unionAll(read[2])


@query("store_migrate_counts", f"SELECT 'records' AS kind, (SELECT count(*) FROM orders) AS source, (SELECT count(*) FROM ({R})) AS target UNION ALL SELECT 'pages', (SELECT count(*) FROM ({plain(ENTRIES)})), (SELECT count(*) FROM ({plain(ENTRIES)}))")
def store_migrate_counts(spark, d):
    """Copy into empty targets with wider schemas, then count both sides."""
    parts = []
    for kind, src, keys in (("records", _records(spark, d), ["pdf_id"]), ("pages", base(spark, d, ENTRIES).withColumn("updated_at", F.expr(NOW)), ["pdf_id", "seq"])):
        target = src.limit(0).withColumn("extra", F.lit(None).cast("string"))
        moved = store.upsert(target, src, keys, created=None)
        parts.append(src.agg(F.lit(kind).alias("kind"), F.count("*").alias("source")).join(moved.agg(F.count("*").alias("target"))))
    return parts[0].unionByName(parts[1])


# ---- JSON and sizes

PAYLOADS = """SELECT event_id, CASE event_id % 5
  WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || '[{{"title": "Plaint ' || CAST(user_id AS STRING) || '", "pageFrom": "3", "pageTo": "7"}}, {{"title": " "}}]' || chr(10) || '```'
  WHEN 1 THEN 'x [{{"title": "Reply", "page": "' || CAST(user_id AS STRING) || '", "serialNo": "2"}}] y' WHEN 2 THEN props WHEN 3 THEN '[broken'
  ELSE '[{{"title": "Reply", "pageFrom": "9", "pageTo": "2"}}]' END AS payload FROM {events}"""


@query("json_salvage", rf"""
WITH p AS ({plain(PAYLOADS)}),
cut AS (SELECT event_id, coalesce(nullif(regexp_extract(payload, '(?is)```(?:json)?\s*(\[.*?\])\s*```', 1), ''), regexp_extract(payload, '(?s)(\[.*\])', 1)) AS j FROM p),
items AS (SELECT event_id, unnest(CAST(j AS JSON[])) AS x FROM cut WHERE json_valid(j)),
f AS (SELECT event_id, trim(x->>'title') AS title, coalesce(x->>'serialNo', '') AS serial, CAST(coalesce(x->>'pageFrom', x->>'page') AS INT) AS page_from, CAST(x->>'pageTo' AS INT) AS pt FROM items WHERE trim(x->>'title') <> '')
SELECT event_id, title, serial, page_from, CASE WHEN pt IS NULL THEN page_from ELSE greatest(page_from, pt) END AS page_to FROM f""")
def json_salvage(spark, d):
    rows = base(spark, d, PAYLOADS).select("event_id", F.explode(T.json_rows(F.col("payload"))).alias("r"))
    return rows.select("event_id", "r.title", F.col("r.serialNo").alias("serial"), F.col("r.pageFrom").alias("page_from"), F.col("r.pageTo").alias("page_to"))


@query("index_json_roundtrip", "SELECT conv_id, turn, role, length(text) AS chars FROM conversations")
def index_json_roundtrip(spark, d):
    """Turns written as one JSON list per conversation and read back."""
    turns = read(spark, d, "conversations").select(F.col("conv_id").alias("pdf_id"), F.col("turn"), F.col("turn").alias("t"), "role", "text")
    stored = store.export_json(turns, "turn")
    back = stored.select("pdf_id", F.explode(F.from_json("index_json", "array<struct<t:bigint,role:string,text:string>>")).alias("x"))
    return back.select(F.col("pdf_id").alias("conv_id"), F.col("x.t").alias("turn"), "x.role", F.length("x.text").cast("long").alias("chars"))


@query("index_export", f"SELECT pdf_id, count(*) AS total_items, md5(string_agg(seq || ':' || qty, ',' ORDER BY seq)) AS digest FROM ({plain(ENTRIES)}) GROUP BY pdf_id")
def index_export(spark, d):
    """The exported JSON, parsed again and digested, so that both engines agree on the values."""
    out = store.export_json(base(spark, d, ENTRIES).select("pdf_id", F.col("seq").alias("o"), "seq", "qty"), "o")
    parsed = F.from_json("index_json", "array<struct<seq:int,qty:int>>")
    said = F.array_join(F.transform(parsed, lambda x: F.concat(x.seq.cast("string"), F.lit(":"), x.qty.cast("string"))), ",")
    return out.select("pdf_id", "total_items", F.md5(said.cast("binary")).alias("digest"))


@query("content_id", "SELECT page_id, substr(md5(html), 1, 16) AS pdf_id FROM pages")
def content_id(spark, d):
    return read(spark, d, "pages").select("page_id", store.file_id(F.col("html").cast("binary")).alias("pdf_id"))


@query("list_sizes", "SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def list_sizes(spark, d):
    """Parallel lists of one conversation, zipped and counted."""
    lists = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    zipped = F.arrays_zip(F.transform("x", lambda s: s.turn).alias("a"), F.transform("x", lambda s: s.text).alias("b"))
    total = F.aggregate(zipped, F.lit(0).cast("long"), lambda s, v: s + F.length(v.getField("b")))
    return lists.select("conv_id", F.size(zipped).cast("long").alias("turns"), total.alias("chars"))
