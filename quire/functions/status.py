"""Status vocabularies of document records: tones, labels, descriptions, queue states.

The words that a store uses for its states, and the texts shown for them, are a Vocabulary; a store with other words
passes its own. OWN is this library's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label of each tone.
TONE_LABELS = {
    "review": "Review Queue",
    "ready": "Vectorized",
    "indexed": "Indexed",
    "staged": "Indexed Only",
    "queued": "Pending Queue",
    "running": "Processing",
    "error": "Needs Review",
}

# Descriptions of partial records and of ready ones.
FIXED_DESCRIPTIONS = {
    "partial, queued": "Legacy partial record detected. Remaining pages are queued for full ingestion.",
    "partial, deferred": "Legacy partial record detected. Remaining pages can be vectorized from the deferred queue.",
    "partial": "Legacy partial record detected. Remaining pages are still pending vectorization.",
    "ready": "This PDF is fully ready in the backend library.",
}

# This library's own sentences for the other cases; a store with other sentences passes them in its Vocabulary.
DESCRIPTIONS = FIXED_DESCRIPTIONS | {
    "ingesting": "All pages of this PDF are being read and vectorized.",
    "building": "The index of the whole PDF is being built in the background.",
    "flagged": "Flagged for review: ",
    "queued": "Uploaded; the whole PDF waits for its index. You may close the browser, the backend goes on.",
    "extracting": "All pages are being read and vectorized before the last index is built.",
}


@dataclass(frozen=True)
class Vocabulary:
    """The words of a store: states of a record, of its retrieval, queue buckets, decisions; and the texts shown for them."""

    waiting: str = "first_stage_waiting"
    first_running: str = "first_stage_running"
    extracting: str = "extracting_text"
    vectorizing: str = "vectorizing"
    building: str = "building_index"
    index_ready: str = "index_ready"
    ingesting: str = "full_ingestion_running"
    vectorized: str = "vectorized"
    failed: str = "failed"
    review: str = "needs_review"
    ingestion_waiting: str = "full_ingestion_waiting"
    ingestion_deferred: str = "full_ingestion_deferred"
    running: str = "running"  # part of every state that is under way
    review_bucket: str = "review"
    first_bucket: str = "first_stage"
    skip: str = "skip"
    tone_labels: dict[str, str] = field(default_factory=lambda: TONE_LABELS)
    no_tone: str = "Saved"
    descriptions: dict[str, str] = field(default_factory=lambda: DESCRIPTIONS)
    #: Texts of states, by the state's word; the rest of texts is for states that need a second look.
    texts: dict[str, str] = field(default_factory=lambda: {
        "first_stage_waiting": "Waiting for Index", "first_stage_running": "Index Running", "extracting_text": "Extracting Text",
        "vectorizing": "Vectorizing", "building_index": "Building Index"})


OWN = Vocabulary()


def _full(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def tone(status: Column, retrieval: Column, bucket: Column, reason: Column, pending: Column, indexed: Column, chat: Column, v: Vocabulary = OWN) -> Column:
    s, r = _low(status), _low(retrieval)
    p, yes = F.coalesce(pending, F.lit(0)), F.lit(True)
    return (
        F.when((bucket == v.review_bucket) | (s == v.review) | _full(reason), "review")
        .when((s == v.failed) | (r == v.failed), "error")
        .when(r.contains(v.running) | s.contains(v.running), "running")
        .when((r == v.vectorized) | (s == v.vectorized) | chat.eqNullSafe(yes), "ready")
        .when((s == v.index_ready) | indexed.eqNullSafe(yes), F.when(p > 0, "staged").otherwise("indexed"))
        .when((p > 0) | r.isin(v.ingestion_deferred, v.ingestion_waiting), "queued")
        .otherwise("neutral")
    )


def _case(c: Column, table: dict[str, str], default: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, text in table.items():
        out = out.when(c == k, text)
    return out.otherwise(default)


def tone_label(t: Column, v: Vocabulary = OWN) -> Column:
    return _case(t, v.tone_labels, F.lit(v.no_tone))


def status_text(status: Column, retrieval: Column, v: Vocabulary = OWN) -> Column:
    s, r = _low(status), _low(retrieval)
    rest = (
        F.when((s == v.index_ready) & (r == v.ingestion_waiting), "Index Ready, Review Pending")
        .when(s == v.index_ready, "Index Ready")
        .when((s == v.ingesting) | (r == v.ingesting), "Full Ingestion Running")
        .when((s == v.vectorized) | (r == v.vectorized), "Vectorized")
        .when((s == v.failed) | (r == v.failed), "Failed")
        .otherwise(F.coalesce(F.nullif(status, F.lit("")), F.lit("Unknown")))
    )
    return _case(s, v.texts, rest)


def step_label(status: Column, retrieval: Column, bucket: Column, reason: Column, indexed: Column, chat: Column, v: Vocabulary = OWN) -> Column:
    s, r = _low(status), _low(retrieval)
    yes = F.lit(True)
    return (
        F.when(_full(reason) | (s == v.review) | (bucket == v.review_bucket), "Sent to review")
        .when(s == v.building, "Building index")
        .when(s == v.vectorizing, "Vectorizing")
        .when((s == v.extracting) | (r == v.ingesting), "Extracting text")
        .when((s == v.vectorized) | indexed.eqNullSafe(yes) | chat.eqNullSafe(yes), "Finalized")
        .when(s == v.waiting, "Queued")
        .otherwise("Ready")
    )


def description(
    status: Column, retrieval: Column, bucket: Column, reason: Column, pending: Column,
    deferred_busy: Column | None = None, index_busy: Column | None = None, v: Vocabulary = OWN,
) -> Column:
    s, r, say = _low(status), _low(retrieval), v.descriptions
    some = F.coalesce(pending, F.lit(0)) > 0
    return (
        F.when(F.lit(False) if deferred_busy is None else deferred_busy, say["ingesting"])
        .when((F.lit(False) if index_busy is None else index_busy) | (s == v.first_running), say["building"])
        .when(_full(reason), F.concat(F.lit(say["flagged"]), reason))
        .when((s == v.waiting) | (bucket == v.first_bucket), say["queued"])
        .when(((r == v.ingesting) | (s == v.ingesting)) & some, say["extracting"])
        .when((s == v.index_ready) & some & (r == v.ingestion_waiting), say["partial, queued"])
        .when((s == v.index_ready) & some, say["partial, deferred"])
        .when(some, say["partial"])
        .otherwise(say["ready"])
    )


def source_badge(source: Column) -> Column:
    return F.when(source.isin("toc", "toc-image"), "TOC").when(source == "auto", "AI").when(source == "manual", "MAN").otherwise("GAP")


def heartbeat_age(now: Column, beat: Column) -> Column:
    """Seconds since the last sign of life, 0 without one."""
    return F.when(F.coalesce(beat, F.lit(0.0)) == 0, 0).otherwise(F.greatest(F.round(now - beat), F.lit(0.0))).cast("long")


def _stuck(main: Column, now: Column, after: int) -> Column:
    return main.running & (heartbeat_age(now, main.beat) > after)


def system_status(main: Column, others: Column, now: Column, after: int = 90) -> Column:
    """stuck, stopping, paused, running or idle, the first that holds.

    main: struct(running, pausing, paused, beat); others: array of struct(running, stopping).
    """
    stopping = (main.running & main.pausing) | F.exists(others, lambda x: x.stopping)
    return (
        F.when(_stuck(main, now, after), "stuck").when(stopping, "stopping").when(main.paused, "paused")
        .when(main.running | F.exists(others, lambda x: x.running), "running").otherwise("idle")
    )


def runner_label(main: Column, now: Column, after: int = 90) -> Column:
    """The main runner's own state, where a pause goes before the wish for one."""
    return (
        F.when(_stuck(main, now, after), "Stuck").when(main.paused, "Paused").when(main.running & main.pausing, "Stopping")
        .when(main.running, "Running").otherwise("Idle")
    )


def runner_position(running: Column, processed: Column, total: Column) -> Column:
    return F.when(running, F.least(F.coalesce(processed, F.lit(0)) + 1, F.coalesce(total, F.lit(0)))).otherwise(0)


def display_name(*choices: Column) -> Column:
    """The first of a record's names that is not empty, in the order of the place that shows it."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in choices], F.lit(""))
