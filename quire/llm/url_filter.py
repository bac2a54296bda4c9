"""URL filters: a broadcast trie over reversed host labels and path segments.

Rules are (verdict, host, path). A rule fits its host and every subdomain when the URL's
path starts with the rule's path. Among fitting rules the deepest host wins, then the
longest path; between an allow and a block rule for the same host and path, block wins.

Defined cases: a null URL, or one without "://", has an empty host and path, and no rule
fits it; an empty path is no "/" and so fits only rules with an empty path. URLs that no rule
fits get the default verdict. Repeated rows are judged alike; other columns are kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LOWER, UPPER, fresh, lower_ascii

_LOWER = str.maketrans(UPPER, LOWER)

#: The largest pickled trie that is broadcast; longer lists are joined instead.
MAX_TRIE_BYTES = 64 << 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def split_path(path: str) -> tuple[list[str], str]:
    """Closed segments (each ended by "/") and the open rest of a path."""
    *closed, rest = path.split("/")
    return closed, rest


def trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nested plain dicts: host labels from the right, then under "/" the path's closed segments.

    A node keeps the rules that end there by the open rest of their path. Plain dicts reach executors that do not
    have this package.
    """
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault(label, {})
        closed, rest = split_path(path)
        node = node.setdefault("/", {})
        for segment in closed:
            node = node.setdefault(("s", segment), {})
        ends = node.setdefault("", {})
        if ends.get(rest, ("", ""))[1] != "block":
            ends[rest] = (host + path, verdict)
    return root


def find(root: dict, host: str, path: str) -> tuple[str, str] | None:
    """The rule text and verdict of the longest match in a trie, or None."""
    node, found = root, in_path(root, path)
    for label in reversed(host.split(".")) if host else ():
        node = node.get(label)
        if node is None:
            break
        found = in_path(node, path) or found
    return found


def in_path(node: dict, path: str) -> tuple[str, str] | None:
    node, found = node.get("/"), None
    segments = path.split("/")
    for k in range(len(segments)):
        if node is None:
            break
        if ends := node.get(""):
            left = "/".join(segments[k:])
            fits = [rest for rest in ends if left.startswith(rest)]
            if fits:
                found = ends[max(fits, key=len)]
        node = node.get(("s", segments[k]))
    return found


def judge_urls(
    df: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow",
    max_trie_bytes: int = MAX_TRIE_BYTES,
) -> DataFrame:
    """Add host, path, rule and verdict to df; columns of these names are replaced."""
    rules = [(v, h.translate(_LOWER), p) for v, h, p in rules]
    host, path = url_parts(F.col(f"`{url}`"))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    parts = df.select(*keep, host.alias("host"), path.alias("path"))
    root = trie(rules)
    if len(pickle.dumps(root)) > max_trie_bytes:
        return judge_by_join(parts, rules, default)
    sent = df.sparkSession.sparkContext.broadcast(root)

    @F.pandas_udf("rule string, verdict string")
    def match(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        root, seen = sent.value, {}
        out = []
        for key in zip(hosts, paths, strict=True):
            if key not in seen:
                seen[key] = find(root, *key) or (None, default)
            out.append(seen[key])
        return pd.DataFrame(out, columns=["rule", "verdict"])

    own = fresh(parts.columns, "_hit")
    hit = parts.withColumn(own, match("host", "path"))
    return hit.select(*[F.col(f"`{c}`") for c in parts.columns], F.col(f"{own}.rule").alias("rule"), F.col(f"{own}.verdict").alias("verdict"))


def judge_by_join(parts: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """The same verdicts for lists too large to broadcast.

    Each distinct (host, path) yields a key per host suffix and closed path prefix; keys
    meet the rules in an equi-join, and the open rest is compared after it.
    """
    spark = parts.sparkSession
    listed = spark.createDataFrame(
        [(h, "/".join(split_path(p)[0]) + "/" * bool(split_path(p)[0]), split_path(p)[1], h + p, v) for v, h, p in rules],
        "_suffix string, _prefix string, _rest string, rule string, verdict string",
    )
    urls = parts.select("host", "path").distinct()
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels) + 1),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) + F.lit(1)), "."),
    )
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(segments) - 1),
        lambda i: F.concat(F.array_join(F.slice(segments, F.lit(1), i), "/"), F.when(i > 0, F.lit("/")).otherwise(F.lit(""))),
    )
    keys = urls.withColumn("_suffix", F.explode(F.array_distinct(suffixes))).withColumn("_prefix", F.explode(prefixes))
    fits = keys.join(listed, ["_suffix", "_prefix"]).where(
        F.expr("startswith(substring(path, length(_prefix) + 1), _rest)")
    )
    rank = F.struct(
        F.when(F.col("_suffix") == "", 0).otherwise(F.size(F.split("_suffix", r"\."))).alias("a"),
        (F.length("_prefix") + F.length("_rest")).alias("b"),
        (F.col("verdict") == "block").alias("c"),
    )
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("_hit"))
    own = fresh(parts.columns, "_hit")
    joined = parts.join(best.withColumnRenamed("_hit", own), ["host", "path"], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in parts.columns],
        F.col(f"{own}.rule").alias("rule"),
        F.coalesce(f"{own}.verdict", F.lit(default)).alias("verdict"),
    )
