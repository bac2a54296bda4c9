"""Mixing sources to target weights by repetition rates.

Words are summed per source; every source gets a target; a source's rate is target over size, and
each document is taken floor(rate) times plus once more if its seeded hash falls below the fraction. Of a few
seeds each source gets the one whose draws come nearest to its target; the choice rests on all documents.

Targets: sources in code-point order, null last, weigh weights[0], weights[1], ... in turn and
share the total by weight; a target stops at cap times its source's size, and the excess is
shared again by weight until none is above. In the end the sources whose target stands at the cap
are those with the smallest size per weight.

Defined cases: a null text counts 0 words; null is a source of its own; a source without words
gets target 0 and is taken 0 times; rows of the same id are drawn alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm import feistel
from quire.llm.common import global_index, materialize, word_count

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix"
#: Seeds that are tried per source.
SEEDS = 32


def hashed(doc_id: Column, seed: str = SEED) -> Column:
    """A number below feistel.PRIME from an id and a seed: the first 13 hex digits of an md5, reduced."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") % feistel.PRIME


def draw(h: Column, a: Column, b: Column, c: Column) -> Column:
    """A number in [0, 1) that a hashed id and the three numbers of a seed decide."""
    p = F.lit(feistel.PRIME).cast("long")
    t = (h * a + b) % p
    return ((t * t + c) % p) / F.lit(float(feistel.PRIME))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Targets for a table (source, source_size) with a row per source.

    The level is found in rounds: sources whose cap lies below their share are set to the cap and
    leave the pool. A round is one aggregate that sends a single row to the driver, so any number of
    sources will do; the pool only shrinks, and it stops after a few rounds.
    """
    ranked, _ = global_index(sizes, [F.col("source").isNull().asc(), F.encode("source", "utf-8").asc()], "_rank")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.withColumn("_w", w.cast("long")))
    limit = F.col("source_size") * cap
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level: tuple[int, int] | None = None  # words left for the pool, weight of the pool
    rest, weight = total, ranked.agg(F.sum("_w")).first()[0] or 0
    while weight and level != (rest, weight):
        level = (rest, weight)
        above = F.col("_w") * F.lit(rest).cast("double") > limit.cast("double") * F.lit(weight).cast("double")
        row = ranked.agg(F.sum(F.when(above, limit)), F.sum(F.when(above, F.col("_w"))), F.sum("_w")).first()
        rest, weight = total - (row[0] or 0), row[2] - (row[1] or 0)
    rest, weight = level or (0, 1)
    share = F.lit(rest).cast("double") * F.col("_w") / F.lit(weight).cast("double")
    return ranked.select("source", "source_size", F.least(limit.cast("double"), share).alias("target"))


def choose_seeds(sized: DataFrame, targets: DataFrame, seed: str = SEED, seeds: int = SEEDS) -> DataFrame:
    """Add to targets the number of the seed whose draws bring the source's taken words nearest to its target.

    A few very long documents can carry a source far off; one aggregate over all seeds finds a good one.
    """
    rated = sized.join(targets, sized.source.eqNullSafe(targets.source)).select(
        targets.source, "size", "target", _rate().alias("_rate"), hashed(F.col("doc_id"), seed).alias("_h"))
    sums = [
        F.sum(F.col("size") * _copies(F.col("_rate"), draw(F.col("_h"), *(F.lit(v).cast("long") for v in k))))
        for k in feistel.round_keys(seed, seeds)
    ]
    taken = rated.groupBy("source").agg(F.first("target").alias("target"), F.array(*sums).alias("_taken"))
    off = F.transform("_taken", lambda x, i: F.struct(F.abs(x - F.col("target")).alias("off"), i.alias("seed")))
    best = taken.select(F.col("source").alias("_s"), F.array_min(off).getField("seed").alias("seed"))
    return targets.join(best, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _rate() -> Column:
    return F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))


def _copies(rate: Column, u: Column) -> Column:
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def with_rates(docs: DataFrame, sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Join its source's size and target, and the number of copies, to rows with doc_id and source.

    sized: (doc_id, source, size) of the same documents.
    """
    sizes = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    chosen = materialize(choose_seeds(sized, source_targets(sizes, weights, cap), seed)).withColumnRenamed("source", "_source")
    hit = docs.join(chosen, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    keys = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(k, "abc", strict=True)]) for k in feistel.round_keys(seed, SEEDS)])
    key = F.element_at(keys, F.col("seed") + 1)
    u = draw(hashed(F.col("doc_id"), seed), key.getField("a"), key.getField("b"), key.getField("c"))
    return hit.withColumn("copies", _copies(_rate(), u)).drop("seed")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per document: size, its source's size and target, and the words taken."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return with_rates(sized, sized, weights, cap).withColumn("taken", F.col("size") * F.col("copies"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed documents themselves: every row as often as it is taken, with the columns of docs."""
    columns = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "doc_id", "source")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    taken = with_rates(own, sized, weights, cap)
    copies = taken.where("copies > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select("_row.*")


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS w FROM sizes),
ordered AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum({CAP} * source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(w) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pool
  FROM ranked),
level AS (
  SELECT CAST(total - capped AS DOUBLE) AS rest, CAST(pool AS DOUBLE) AS pool FROM ordered
  WHERE w * CAST(total - capped AS DOUBLE) <= CAST({CAP} * source_size AS DOUBLE) * pool ORDER BY capped LIMIT 1),
targets AS (
  SELECT source, source_size, least(CAST({CAP} * source_size AS DOUBLE), coalesce((SELECT rest * w / pool FROM level), 0)) AS target FROM ranked),
rated AS (
  SELECT doc_id, sized.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) % {feistel.PRIME} AS h
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
seeds(seed, a, b, c) AS (VALUES {", ".join(str((i, *k)) for i, k in enumerate(feistel.round_keys(SEED, SEEDS)))}),
tried AS (
  SELECT rated.doc_id, rated.source, rated.size, source_size, target, seed, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM (
    SELECT rated.*, seed, (((h * a + b) % {feistel.PRIME} * ((h * a + b) % {feistel.PRIME}) + c) % {feistel.PRIME}) / {float(feistel.PRIME)} AS u
    FROM rated CROSS JOIN seeds) AS rated),
chosen AS (
  SELECT source, seed FROM (SELECT source, seed, abs(sum(taken) - any_value(target)) AS off FROM tried GROUP BY source, seed)
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, seed) = 1)
SELECT doc_id, size, source_size, target, taken FROM tried JOIN chosen ON tried.seed = chosen.seed AND tried.source IS NOT DISTINCT FROM chosen.source
"""
