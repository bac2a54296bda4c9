"""Schemas of the document store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = (
    "pdf_id string, page_num int, text string, used_ocr boolean, vision_used boolean, handwriting_suspected boolean, "
    "extraction_method string, stage string, created_at timestamp, updated_at timestamp"
)
RECORDS = (
    "pdf_id string, filename string, cnr_number string, file_size_bytes bigint, total_pages int, selected_start_page int, "
    "selected_end_page int, indexed_pages int, status string, retrieval_status string, index_ready boolean, chat_ready boolean, "
    "pending_pages int, index_source string, queue_bucket string, deferred_decision string, last_error string, review_reason string, "
    "batch_run_id string, batch_enqueued_at string, created_at timestamp, updated_at timestamp"
)
ITEM = (
    "struct<serialNo:string,title:string,annexure:string,pageFrom:int,pageTo:int,source:string,displayTitle:string,originalTitle:string,"
    "courtFee:string,verifiedPageFrom:int,verifiedPageTo:int,verificationStatus:string,verificationConfidence:double,"
    "matchedPages:array<int>,documentType:string>"
)
INDEXES = f"pdf_id string, index array<{ITEM}>, total_entries int, created_at timestamp, updated_at timestamp"
VECTORS = (
    "pdf_id string, page_num int, text string, embedding array<double>, filename string, used_ocr boolean, vision_used boolean, "
    "handwriting_suspected boolean, extraction_method string"
)

#: What a column gets when a table that lacks it is brought to a schema.
DEFAULTS = {"queue_bucket": "index", "deferred_decision": "pending", "index_ready": False, "chat_ready": False, "extraction_method": "unknown"}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the columns of a schema: missing ones get defaults, others are cast, extra ones go."""
    target = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[
        (F.col(f"`{f.name}`") if f.name in df.columns else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in target
    ])
