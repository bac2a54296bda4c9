"""Quality rules by weak supervision: rules vote or abstain, EM weighs them.

Every rule looks at figures of a text and votes good (1), bad (-1) or abstains (0). The votes
of all documents are counted by pattern; expectation-maximisation on these counts estimates the share
of good documents and, for each rule, how often its votes are right on good and on bad ones. A
document is kept if its posterior probability of being good reaches 0.5. No single rule decides.

With R rules there are at most 3 ** R patterns (6561 for the eight below), whatever the number of
documents: only these counts come to the driver, and they are exact.

Base checks of the contract (fewer than 50 words, or over half of the words in repeated
3-word windows) reject a document outright.

Defined cases: a null or empty text has all figures 0 and fails the base checks; a text without
repeated windows has 0 repeated words; repeated rows are judged alike; an empty table stays empty and
the model keeps its starting values; other columns pass through whatever their names, and columns with
names of results are replaced; texts with equal votes (ties) are judged alike.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BLANKS, materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP = 0.5
#: What a rule is thought to be right on good documents before any is seen, and how many documents that weighs.
START, WEIGHT = 0.99, 10
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "top_words", "n_letters", "n_stops")
BASE = FIGURES[:5]


def repeated_words(words: list) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    covered = done = 0
    for k, w in enumerate(windows):
        if count[w] > 1:
            covered += k + 3 - max(k, done)
            done = k + 3
    return covered


def text_figures(text: str | None) -> tuple[int, int, int, int, int, int, int]:
    """The first seven of FIGURES for one whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        max(Counter(words).values(), default=0),
    )


def _figures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_figures(t) for t in texts], columns=list(FIGURES[:7]))


def with_figures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add FIGURES; letters and sentence ends are counted in the JVM."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kind = ", ".join(f"{c} long" for c in FIGURES[:7])
    keep = [c for c in df.columns if c not in FIGURES]
    out = df.select(*[F.col(f"`{c}`") for c in keep], F.pandas_udf(_figures, kind)(F.col(f"`{text}`")).alias("_f"), (
        F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", ""))).cast("long").alias("n_letters"), (
        F.length(t) - F.length(F.translate(t, ".!?", ""))).cast("long").alias("n_stops"))
    return out.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"_f.{c}").alias(c) for c in FIGURES[:7]], "n_letters", "n_stops")


class Rule(NamedTuple):
    """Votes good in [good_from, good_to], bad below bad_under or above bad_over, else abstains."""

    name: str
    value: str
    good_from: float
    good_to: float
    bad_under: float
    bad_over: float
    applies: str = "n_words > 0"


# Shares are per word, per line or per character of words.
RULES = (
    Rule("few symbols", "n_symbols / n_words", 0.0, 0.01, -1.0, 0.1),
    Rule("few repeats", "n_repeat_words / n_words", 0.0, 0.15, -1.0, 0.3, "n_words >= 3"),
    Rule("few equal lines", "n_dup_lines / n_lines", 0.0, 0.1, -1.0, 0.4, "n_lines >= 5"),
    Rule("word length", "word_chars / n_words", 3.8, 6.5, 3.0, 8.0),
    Rule("mostly letters", "n_letters / word_chars", 0.9, 1.0, 0.75, 2.0),
    Rule("sentence ends", "n_stops / n_words", 0.02, 0.3, 0.004, 0.6),
    Rule("no ruling word", "top_words / n_words", 0.0, 0.12, -1.0, 0.25, "n_words >= 20"),
    Rule("line length", "n_words / n_lines", 3.0, 300.0, 1.5, 1000.0, "n_lines >= 5"),
)


def vote(rule: Rule) -> Column:
    v, on = F.expr(f"try_divide({rule.value.replace(' / ', ', ')})"), F.expr(rule.applies)
    return (
        F.when(~on | v.isNull(), 0)
        .when((v < rule.bad_under) | (v > rule.bad_over), -1)
        .when((v >= rule.good_from) & (v <= rule.good_to), 1)
        .otherwise(0)
    )


def with_pattern(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add the votes as one number in base 3."""
    digits = F.lit(0)
    for r in rules:
        digits = digits * 3 + vote(r) + 1
    return df.withColumn("pattern", digits.cast("int"))


class Model(NamedTuple):
    prior: float
    right_good: np.ndarray  # of each rule's votes on good documents, the share that say good
    right_bad: np.ndarray
    rules: int

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes = unpack(patterns, self.rules)
        good = np.where(votes > 0, np.log(self.right_good), np.where(votes < 0, np.log1p(-self.right_good), 0)).sum(1)
        bad = np.where(votes < 0, np.log(self.right_bad), np.where(votes > 0, np.log1p(-self.right_bad), 0)).sum(1)
        return 1 / (1 + np.exp(np.clip(bad - good + np.log1p(-self.prior) - np.log(self.prior), -700, 700)))


def unpack(patterns: np.ndarray, rules: int) -> np.ndarray:
    p = np.asarray(patterns, dtype=np.int64).reshape(-1, 1)
    return p // 3 ** np.arange(rules - 1, -1, -1) % 3 - 1


def fit(patterns: np.ndarray, counts: np.ndarray, rules: int, rounds: int = 500) -> Model:
    """EM over pattern counts. The start says which class is which: rules are mostly right on good documents.

    Bad documents come in kinds, each of which may pass most rules, so a good vote on a bad document is
    common. Accuracies on both classes are estimated; a rule that is wrong on more than half of the good documents
    would have the classes exchanged, which the bound of one half excludes.
    """
    model = Model(0.8, np.full(rules, START), np.full(rules, 0.4), rules)
    if not len(patterns):
        return model
    votes, n = unpack(patterns, rules), np.asarray(counts, float)
    for _ in range(rounds):
        p = model.posterior(patterns) * n
        q = n - p
        good = (p @ (votes > 0) + START * WEIGHT) / (p @ (votes != 0) + WEIGHT)
        bad = (q @ (votes < 0) + 0.4 * WEIGHT) / (q @ (votes != 0) + WEIGHT)
        new = Model(
            float(np.clip(p.sum() / n.sum(), 0.05, 0.95)),
            np.clip(good, 0.5, 0.9999),
            np.clip(bad, 0.05, 0.999),
            rules,
        )
        still = abs(new.prior - model.prior) + abs(new.right_good - model.right_good).max() + abs(new.right_bad - model.right_bad).max()
        model = new
        if still < 1e-9:
            break
    return model


def fit_rules(voted: DataFrame, rules: tuple[Rule, ...] = RULES) -> tuple[Model, pd.DataFrame]:
    """The model and the posterior of every pattern that occurs."""
    rows = sorted(voted.groupBy("pattern").count().collect())
    patterns = np.array([r[0] for r in rows], dtype=np.int64)
    model = fit(patterns, np.array([r[1] for r in rows], dtype=float), len(rules))
    return model, pd.DataFrame({"pattern": patterns, "posterior": model.posterior(patterns) if len(rows) else np.zeros(0)})


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add FIGURES, posterior, base_failed and kept to df (without its text, if keep_text is false)."""
    results = (*FIGURES, "posterior", "base_failed", "kept")
    keep = [c for c in df.columns if c.lower() not in results and (keep_text or c != text)]
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep])  # so no name of ours meets one of df
    voted = materialize(with_pattern(with_figures(df.select(row.alias("row"), F.col(f"`{text}`").alias("text"))), rules).drop("text"))
    _, table = fit_rules(voted, rules)
    known = df.sparkSession.createDataFrame([(int(a), float(b)) for a, b in table.itertuples(index=False)], "pattern int, posterior double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = voted.join(F.broadcast(known), "pattern", "left")  # a row per pattern
    return judged.select(
        *[F.col(f"row.`{c}`").alias(c) for c in keep], *FIGURES, "posterior", failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= KEEP)).alias("kept"),
    )


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of docs."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    return judge(rows, keep_text=False).where("kept").select("_row.*")
