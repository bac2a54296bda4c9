"""The corpus pipeline: quality, near-dedup, pseudonyms, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents; the last returns
the packed pieces. A document that the mix takes twice or more is packed as often.

Defined cases: null and empty texts fail the quality stage; repeated rows and copies end as one document, that of the
least id; an empty table passes all stages; columns beside those of documents pass whatever their names; ties are told
apart by id, then by place, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import mixing, near, packing, pii, quality
from quire.llm.common import fresh, materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed quality rules and the base checks keep."""
    return quality.filter_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a similarity of 0.8 on five words: by SimHash's index first, exactly for what it leaves apart."""
    return near.dedup(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format; n_chars moves with the text."""
    before = fresh(docs.columns, "_before")
    masked = pii.pseudonymize(docs.withColumn(before, F.length("text")), key=pseudonym_key(spark))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.col("n_chars") + F.length("text") - F.col(before))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])


def pseudonym_key(spark: SparkSession) -> str:
    """The key of the pseudonyms: the session's setting quire.pseudonym.key, which real data should set, else a public one."""
    return spark.conf.get("quire.pseudonym.key", None) or pii.KEY


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate takes it."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fingerprints, EM and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
