"""Quality rules by weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on a document. Votes are counted by pattern (at most 3^rules
patterns, so what reaches the driver has a fixed bound), expectation-maximisation over the patterns estimates how often
each rule casts each vote on good and on bad documents, and each document gets the posterior probability of being good.
The verdict is that probability against a threshold; no single rule must pass.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, add_columns, free_name, map_rows, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marked", "n_short", "n_top_word", "n_lines", "n_ended", "n_pipes")
SYMBOLS = "#*$%&|<>"
MARKED = regex.compile(r"[^\p{L}\p{N}\s]{2,}+(?=[\x20\x09-\x0D]|\Z)")
UPPER, LETTER = regex.compile(r"\p{Lu}+"), regex.compile(r"\p{L}+")


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS for one text; null and empty texts give zeros."""
    if not text:
        return (0,) * len(COUNTS)
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeats = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:]))
        seen = Counter(grams)
        if len(seen) < len(grams):
            covered = bytearray(n)
            for i, g in enumerate(grams):
                if seen[g] > 1:
                    covered[i : i + 3] = b"\1\1\1"
            repeats = sum(covered)
    lengths = list(map(len, words))
    return (
        n,
        sum(lengths),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        sum(map(len, UPPER.findall(text))),
        sum(map(len, LETTER.findall(text))),
        len(MARKED.findall(text)),
        sum(x <= 3 for x in lengths),
        max(Counter(words).values(), default=0),
        len(lines),
        sum(x.rstrip()[-1:] in ".!?:;\"')" for x in lines),
        text.count("|"),
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id and COUNTS. Null and empty texts count zero; null ids stay null; extra columns are not read."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([counts(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T)], ["id", *COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], run, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS)).withColumnRenamed("id", id_col)


def _ratio(a: str, b: str):
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(bad, good=None):
    v = F.when(bad, -1)
    return (v.when(good, 1) if good is not None else v).otherwise(0)


def rules() -> dict:
    """Rule name -> vote in (-1, 0, 1), over the counts."""
    mean = _ratio("word_chars", "n_words")
    return {
        "length": _vote(F.col("n_words") < 50, F.col("n_words") >= 50),
        "word_length": _vote((mean < 2.5) | (mean > 10), mean.between(3, 8)),
        "symbols": _vote(_ratio("n_symbols", "n_words") > 0.1, _ratio("n_symbols", "n_words") < 0.02),
        "repeated_words": _vote(_ratio("n_repeat_words", "n_words") > 0.3, _ratio("n_repeat_words", "n_words") < 0.15),
        "repeated_lines": _vote(_ratio("n_dup_lines", "n_lines") > 0.3),
        "capitals": _vote(_ratio("n_upper", "n_letters") > 0.4, _ratio("n_upper", "n_letters") < 0.2),
        "marks": _vote(_ratio("n_marked", "n_words") > 0.2, _ratio("n_marked", "n_words") < 0.05),
        "short_words": _vote(_ratio("n_short", "n_words") < 0.1, _ratio("n_short", "n_words").between(0.15, 0.7)),
        "one_word": _vote(_ratio("n_top_word", "n_words") > 0.25, _ratio("n_top_word", "n_words") < 0.12),
        "tables": _vote(_ratio("n_pipes", "n_words") > 0.1),
    }


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Posterior of 'good' for each vote pattern, by EM with independent rules given the class; start: majority of votes."""
    keys = sorted(patterns)
    if not keys:
        return {}
    votes, weight = np.array(keys) + 1, np.array([patterns[k] for k in keys], float)
    n_rules = votes.shape[1]
    good = np.array([0.95 if min(k) >= 0 else (0.05 if k.count(-1) >= 2 else 0.25) for k in keys])
    for _ in range(rounds):
        prior = np.clip((weight @ good + 9) / (weight.sum() + 10), 1e-6, 1 - 1e-6)
        logs = []
        for resp in (1 - good, good):
            w = weight * resp
            table = np.stack([np.bincount(votes[:, r], w, 3) for r in range(n_rules)]) + 0.1
            logs.append(np.log(table / table.sum(1, keepdims=True))[np.arange(n_rules), votes].sum(1))
        now = 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - prior) - logs[1] - np.log(prior), -500, 500)))
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    # a pattern's bad votes never make it likelier good: monotone in the votes
    for _ in range(n_rules):
        where = {k: i for i, k in enumerate(keys)}
        for i, k in enumerate(keys):
            for r in range(n_rules):
                if k[r] == -1:
                    for v in (0, 1):
                        j = where.get(k[:r] + (v,) + k[r + 1 :])
                        if j is not None and good[i] > good[j]:
                            good[i] = good[j]
    return dict(zip(keys, good.tolist()))


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _votes(found: DataFrame) -> DataFrame:
    return found.withColumn("votes", F.array(*(v.cast("int") for v in rules().values())))


def _posterior(voted: DataFrame) -> DataFrame:
    """(votes, quality) by EM over the patterns that occur: at most 3^rules rows."""
    patterns = {tuple(r["votes"]): r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    rows = [(list(k), p) for k, p in estimate(patterns).items()]
    return voted.sparkSession.createDataFrame(rows, "votes array<int>, quality double")


def judge(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its counts, each rule's vote, base_failed, quality (posterior) and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated three-word windows; such documents are
    never kept. Null and empty texts count as zero words, so they fail. Repeated rows give a row each; extra columns
    are not read. An empty table gives an empty result.
    """
    found = written(_votes(features(docs, id_col, text_col)), "quality")
    judged = found.join(F.broadcast(_posterior(found)), "votes").withColumn("base_failed", _base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns, in place: no row is joined by its id or shuffled.

    Null, empty and short texts go; rows with null ids and repeated rows are judged like others; an empty table stays empty.
    """

    def run(texts: list[str | None]) -> list[pa.Array]:
        rows = np.array([counts(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
        return [pa.StructArray.from_arrays([pa.array(c) for c in rows.T], list(COUNTS))]

    inside = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"
    votes = _posterior(_votes(features(docs.select(text_col).withColumn("id", F.lit(0)), "id", text_col).drop("id")))
    name = free_name(docs, "_counts")
    all_counts = add_columns(docs, text_col, run, f"{name} {inside}")
    fields = {c: F.col(f"{name}.{c}") for c in COUNTS}
    judged = all_counts.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *(v.alias(k) for k, v in fields.items()))
    judged = _votes(judged).join(F.broadcast(votes), "votes").where(~_base_failed() & (F.col("quality") >= threshold))
    return judged.select("_row.*")
