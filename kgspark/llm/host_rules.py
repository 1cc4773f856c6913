"""Quality rules by host, with DataFrame functions only.

Every document gets base figures. Its rule failures are then counted per host
(partial aggregates), and each host's failure rate is shrunk towards the rate of
all hosts by a beta prior fitted to the hosts' own rates (method of moments), so
that a host with few documents is not judged by chance. Documents of a host whose
shrunk rate is above ``max_host_failure`` go, with those that fail themselves.

Figures are computed within the row by array functions, so no word is shuffled:
repeated windows are found by sorting the hashes of a text's windows, and only in
texts that have fewer distinct windows than windows. Figures are written once,
narrow, and read for the host table and for the join of the verdicts; Spark
splits hot hosts of that join at run time, as nothing above it needs a host's
rows together.

Defined results: a null or empty text has no words, which fails the base rule;
documents with a null host form one host of their own; repeated documents count
each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from kgspark.storage import Scratch

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class HostRules:
    """Limits: words of a text, percent of repeated words, shrunk failure rate of a host."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    max_host_failure: float = 0.5


def _window_hashes(words: str, window: int) -> Column:
    """xxhash64 of each run of ``window`` words, built up word by word."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    return one if window == 1 else F.when(F.size(words) >= window, _chained(words, window)).otherwise(
        F.array().cast("array<bigint>")
    )


def _chained(words: str, window: int) -> Column:
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for k in range(1, window):
        rest = F.slice(F.col(words), k + 1, F.size(words))
        hashes = F.zip_with(hashes, rest, lambda h, w: F.xxhash64(h, w))
    return F.slice(hashes, 1, F.size(words) - (window - 1))


def figures(docs: DataFrame, rules: HostRules = HostRules(), host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.col(host).cast("string").alias("host"), text.alias("text")).select(
        "doc_id", "host",
        F.filter(F.split("text", SPACES), lambda w: w != "").alias("words"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counted = base.select(
        "doc_id", "host", F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _window_hashes("words", rules.window).alias("hashes"),
    )
    # Positions of windows found twice or more, in order: equal hashes are neighbours once sorted.
    found = counted.withColumn("pairs", F.when(
        F.size("hashes") > F.size(F.array_distinct("hashes")),
        F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )).drop("hashes")
    found = found.withColumn("after", F.slice("pairs", 2, F.size("pairs"))).withColumn(
        "before", F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("pairs", 1, F.size("pairs") - 1))
    )
    same = found.withColumn("next", F.zip_with("pairs", "after", lambda a, b: F.struct(
        a["i"].alias("i"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("same"), a["h"].alias("h")
    ))).drop("after", "pairs")
    repeated = same.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.sort_array(F.filter(
            F.zip_with("next", "before", lambda a, b: F.when(
                a["same"] | F.coalesce(a["h"] == b["h"], F.lit(False)), a["i"]
            )), lambda i: i.isNotNull(),
        )).alias("starts"),
    )
    # Each start covers up to the next one, the last a whole window.
    covered = F.aggregate(
        F.zip_with("starts", F.slice("starts", 2, F.size("starts")),
                   lambda a, b: F.least(b - a, F.lit(rules.window))),
        F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(x, F.lit(rules.window)),
    )
    done = repeated.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("starts")
    return done.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent
    ))


def host_rates(counted: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate): failures per host and the shrunk rate.

    The prior's mean and weight come from the hosts with two or more documents,
    read as one row: with mean m and variance v of their rates, the weight is
    m (1 - m) / v - 1; hosts that do not differ get the weight of all documents.
    """
    hosts = counted.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed")
    )
    rate = F.when(F.col("n_docs") >= 2, F.col("n_failed") / F.col("n_docs"))
    all_hosts = hosts.agg(
        F.avg(rate).alias("m"), F.var_pop(rate).alias("v"),
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("failed"),
    ).first()
    mean = all_hosts["m"] if all_hosts["m"] is not None else (all_hosts["failed"] or 0) / max(1, all_hosts["n"] or 0)
    spread = mean * (1 - mean)
    weight = spread / all_hosts["v"] - 1 if all_hosts["v"] else float(all_hosts["n"] or 0)
    weight = max(weight, 0.0)
    return hosts.withColumn(
        "rate", (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    )


def judge(docs: DataFrame, scratch: Scratch, rules: HostRules = HostRules(), host: str = "source") -> DataFrame:
    """Figures of each document, its host's shrunk rate, and ``kept``."""
    counted = scratch.save(figures(docs, rules, host), "figures")
    verdicts = host_rates(counted).select(F.col("host").alias("_host"), "rate").select(
        F.struct("_host").alias("_key"), "rate"
    )
    joined = counted.withColumn("_key", F.struct(F.col("host").alias("_host")))
    joined = joined.join(verdicts, joined["_key"].eqNullSafe(verdicts["_key"]), "left").drop("_key")
    return joined.withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("rate", F.lit(0.0)) <= rules.max_host_failure)
    )
