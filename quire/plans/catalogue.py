"""The query catalogue of the document operators, with DuckDB SQL beside each.

Supplied tables stand in for the document store: documents are pages, orders are records, lineitem
rows are table-of-contents entries and ranges, part and nation make a catalog.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the DuckDB SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A mapping of supplied tables to roles, written in SQL that both engines run; {table} names a table."""
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


# Roles, in SQL that both engines run.
PAGES = "SELECT source AS pdf_id, CAST(doc_id + 1 AS INT) AS page_num, coalesce(text, '') AS text FROM {documents}"
RECORDS = """
SELECT o_orderkey AS pdf_id, 'Batch_No_' || CAST(o_custkey % 50 AS STRING) || '_Ram_Vs_' || o_orderpriority || '.pdf' AS filename,
  CASE WHEN o_custkey % 8 = 0 THEN '' ELSE 'CNR' || CAST(o_custkey AS STRING) END AS cnr_number, CAST(floor(o_totalprice) AS BIGINT) AS file_size_bytes,
  CAST(o_orderkey % 40 + 1 AS INT) AS total_pages, CAST(o_orderkey % 3 + 1 AS INT) AS selected_start_page, CAST(o_orderkey % 40 + 1 AS INT) AS selected_end_page,
  CAST(o_custkey % 41 AS INT) AS indexed_pages,
  CASE o_orderkey % 9 WHEN 0 THEN 'first_stage_waiting' WHEN 1 THEN 'first_stage_running' WHEN 2 THEN 'vectorized' WHEN 3 THEN 'index_ready'
    WHEN 4 THEN 'failed' WHEN 5 THEN 'extracting_text' WHEN 6 THEN 'needs_review' WHEN 7 THEN 'building_index' ELSE 'Odd' END AS status,
  CASE o_custkey % 6 WHEN 0 THEN 'vectorized' WHEN 1 THEN 'full_ingestion_waiting' WHEN 2 THEN 'full_ingestion_running'
    WHEN 3 THEN 'full_ingestion_deferred' WHEN 4 THEN 'failed' ELSE '' END AS retrieval_status,
  o_orderkey % 3 = 0 AS index_ready, o_custkey % 4 = 0 AS chat_ready,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_custkey % 4 AS INT) END AS pending_pages,
  CASE WHEN o_orderkey % 3 = 0 THEN 'toc-hybrid' ELSE '' END AS index_source,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'first_stage' WHEN 2 THEN 'review' ELSE 'index' END AS queue_bucket,
  CASE o_custkey % 5 WHEN 0 THEN 'skip' WHEN 1 THEN NULL ELSE 'pending' END AS deferred_decision,
  CASE WHEN o_orderkey % 11 = 0 THEN 'boom' ELSE '' END AS last_error,
  CASE WHEN o_orderkey % 13 = 0 THEN 'weak index' ELSE '' END AS review_reason,
  'run ' || CAST(o_custkey % 3 AS STRING) AS batch_run_id, CAST(o_orderkey AS STRING) AS batch_enqueued_at,
  o_orderdate AS updated_at
FROM {orders}"""
#: One entry per (document, number): the least of repeated ones.
ENTRIES = """
SELECT l_orderkey AS pdf_id, l_linenumber AS seq, CAST(min(l_partkey) AS INT) AS part, CAST(min(l_suppkey) AS INT) AS supp,
  CAST(min(l_quantity) AS INT) AS qty FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""
TOC_LINES = f"""
SELECT pdf_id, seq, CASE
    WHEN part % 11 = 0 THEN 'Sr. No'
    WHEN part % 6 = 0 THEN p_name || '   ' || CAST(part % 30 + 1 AS STRING)
    ELSE CAST(seq AS STRING) || '. ' || p_name || CASE WHEN part % 4 = 0 THEN ' A-' || CAST(supp % 9 AS STRING) ELSE '' END
      || CASE WHEN part % 5 = 0 THEN chr(10) ELSE ' ' END || CAST(part % 30 + 1 AS STRING)
      || CASE WHEN part % 3 = 0 THEN '' WHEN part % 3 = 1 THEN '-' || CAST(part % 30 + supp % 9 AS STRING) ELSE ' to ' || CAST(part % 30 + 4 AS STRING) END
  END AS line
FROM ({ENTRIES}) AS e JOIN {{part}} ON part = p_partkey"""


def plain(sql: str) -> str:
    """The DuckDB form of a role."""
    return sql.format(**{t: t for t in TABLES})


def queries() -> dict[str, Query]:
    from quire.plans import store_queries, text_queries, toc_queries  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_ORACLE)
