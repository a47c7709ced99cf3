"""Substring deduplication by content-defined chunking.

A gear hash rolls over a text's bytes; a chunk ends where its top bits are zero, so the cuts follow the content and an
insertion only moves the cuts near it. Chunks are deduplicated by digest: a digest that occurs in several documents
marks a repeat, its first document keeps it. A run of neighbouring repeated chunks is a seed: the chunks cut across a
passage's two ends are not in it, so the windows of ``least_words`` words around it are looked up as well, and the run
counts if another document holds one of them. Chunks of a run that have the same first document join to one span.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, let_go, map_rows, may_hold

#: Least and greatest chunk in bytes; beyond the least, one byte in 2^MASK_BITS ends a chunk.
LEAST, GREATEST, MASK_BITS = 16, 128, 4
#: Bytes that the gear hash looks back on (one bit of its word for each).
REACH = 32
#: Words that a passage must share with another document to be reported: over 50.
LEAST_WORDS = 51
#: Words of whole repeated chunks that make a seed; a window is looked up if it holds so many words of one.
SEED_WORDS = 8
#: Odd multipliers of the window hashes: over a word's bytes and over a window's words.
BYTE_BASE, WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Fixed pseudo-random word for each byte, from a rule.
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The hash h[i] = 2 h[i-1] + GEAR[data[i]] mod 2^32 at every byte, by doubling the stretch it covers."""
    h = GEAR[data]
    step = 1
    while step < REACH:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step)) if len(h) > step else h[step:]
        step *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of one text's bytes; cuts never split a UTF-8 character.

    Where no byte in reach ends a chunk, the last character in reach does, unless what precedes it (REACH bytes) has
    stood in the chunk before, as in a run of one repeated word. There the least hash ends the chunk: the hashes repeat
    as well, so the cuts fall on the same place of the word wherever the run begins.
    """
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    arr = np.frombuffer(data, np.uint8)
    lead = np.r_[(arr[1:] & 0xC0) != 0x80, True]  # the next byte begins a character
    hashes = gear_hashes(arr)
    wanted = ((hashes >> np.uint32(32 - MASK_BITS)) == 0) & lead
    out, last = [], 0
    for end in [*(np.flatnonzero(wanted) + 1).tolist(), n]:
        while end - last > GREATEST:
            reach = np.flatnonzero(lead[last + LEAST - 1 : last + GREATEST]) + last + LEAST - 1
            near = hashes[reach]
            last = int(reach[np.argmin(near) if near[-1] in near[:-1] else -1]) + 1
            out.append(last)
        if end - last >= LEAST or end == n > last:
            out.append(end)
            last = end
    return out


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each chunk: id, digest (96 bits as two numbers) and its place in one number.

    at = start << 16 | characters << 8 | words begun in it: few bytes, as every chunk of the corpus is shuffled. Null and
    empty texts have no chunks; repeated rows repeat theirs; extra columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, places, digests = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for r, text in enumerate(batch.column(1).to_pylist()):
            if not text:
                continue
            data = text.encode("utf-8", "surrogatepass")
            ends = cuts(data)
            arr = np.frombuffer(data, np.uint8)
            space = (arr == 32) | ((arr >= 9) & (arr <= 13))
            at = np.array(ends)
            chars, begun = np.cumsum((arr & 0xC0) != 0x80)[at - 1], np.cumsum(~space & np.r_[True, space[:-1]])[at - 1]
            start = np.r_[0, chars[:-1]]
            rows.append(np.full(len(ends), r))
            places.append(start << 16 | (chars - start) << 8 | np.diff(begun, prepend=0))
            last = 0
            for end in ends:
                digests.append(xxhash.xxh3_128_digest(data[last:end])[:12])
                last = end
        both = np.frombuffer(b"".join(digests), np.dtype([("d1", "<i8"), ("d2", "<i4")]))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(places)), pa.array(np.ascontiguousarray(both["d1"])), pa.array(np.ascontiguousarray(both["d2"]))], ["id", "at", "d1", "d2"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], run, f"id {kind}, at long, d1 long, d2 int", 2 << 20)


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i up to n."""
    both = []
    for b in (base, np.uint64(pow(int(base), -1, 1 << 64))):
        steps = np.full(n + 1, b, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps))
    return both[0], both[1]


def _sums(values: np.ndarray, base: np.uint64) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Hashes of stretches of ``values``, from the sums of values[i] base^i before each place."""
    up, down = _powers(base, len(values))
    before = np.r_[np.uint64(0), np.cumsum(values * up[:-1])]
    return lambda start, stop: (before[stop] - before[start]) * down[start]


def window_hashes(data: bytes, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The place (in characters) of each word of a text and the 64-bit hash of each window of so many words."""
    arr = np.frombuffer(data, np.uint8)
    space = np.r_[True, (arr == 32) | ((arr >= 9) & (arr <= 13)), True]
    edges = np.flatnonzero(np.diff(space.astype(np.int8)))
    start, stop = edges[::2], edges[1::2]
    place = (np.cumsum((arr & 0xC0) != 0x80) - 1)[start]
    if len(start) < least_words:
        return place, np.zeros(0, np.int64)
    words = _sums(arr.astype(np.uint64) + np.uint64(1), BYTE_BASE)(start, stop)
    words = (words ^ (words >> np.uint64(29))) * BYTE_BASE  # so that neither base sees the other's sums
    words ^= words >> np.uint64(32)
    at = np.arange(len(start) - least_words + 1)
    found = _sums(words, WORD_BASE)(at, at + least_words)
    return place, (found ^ (found >> np.uint64(31))).astype(np.int64)


def _windows(texts: DataFrame, least_words: int, kind: str) -> DataFrame:
    """A row for each window that holds SEED_WORDS of a run: id, the run and the window's hash. Columns: id, text, runs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, runs, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r, (text, seeds) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            place, hashes = window_hashes((text or "").encode("utf-8", "surrogatepass"), least_words)
            for seed in seeds if len(hashes) else ():
                first, last = np.searchsorted(place, (seed["start"], seed["stop"]))
                some = np.unique(hashes[max(0, first - least_words + SEED_WORDS) : max(0, last - SEED_WORDS + 1)])
                rows.append(np.full(len(some), r))
                runs.append(np.full(len(some), seed["run"]))
                found.append(some)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(runs)), pa.array(np.concatenate(found))], ["id", "run", "window"])

    return map_rows(texts, ["id", "text", "runs"], run, f"id {kind}, run long, window long", 2 << 20)


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each span of repeated chunks: id, start_char, end_char, n_chunks, n_words, first_id, is_first.

    A chunk is repeated if its digest occurs in two documents or more. A run of neighbouring repeated chunks counts if
    it holds SEED_WORDS and another document holds, around a run of its own, a window of ``least_words`` words that
    takes in so many of them; whatever white space parts the words. A run is given as one span for each stretch of
    chunks with the same first document, which is ``first_id``. ``is_first`` marks the span that a deduplication keeps.
    A span ends with its whole chunks, a few words within the passage's ends; n_words counts the words begun in it.
    Documents without such a run give no row; neither do null or empty texts, nor rows with a null id. Rows that share
    an id count as one document. Extra columns are not read. Windows are equal by 64 bits of hash.
    """
    t = Scratch()
    docs = docs.where(F.col(id_col).isNotNull())
    every = t.write(chunks(docs, id_col, text_col), "chunks")
    known = every.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    known = t.write(known.where("first < last").select("d1", "d2", "first"), "repeats")
    let_go(docs.sparkSession)
    marked = every.join(known, ["d1", "d2"]).select("id", "at", "first").distinct()
    start, stop = F.shiftright("at", 16), F.shiftright("at", 16) + F.shiftright("at", 8).bitwiseAND(255)
    marked = marked.select("id", start.alias("start"), stop.alias("stop"), F.col("at").bitwiseAND(255).alias("words"), "first")
    in_order = Window.partitionBy("id").orderBy("start", "stop", "first")
    apart = ~(F.col("start") <= F.lag("stop").over(in_order))
    begins = F.when(apart | F.lag("stop").over(in_order).isNull(), 1).otherwise(0)
    turns = F.when((F.col("begins") == 1) | (F.col("first") != F.lag("first").over(in_order)), 1).otherwise(0)
    spans = marked.withColumn("begins", begins).withColumn("turns", turns)
    spans = spans.withColumn("run", F.sum("begins").over(in_order)).withColumn("part", F.sum("turns").over(in_order)).groupBy("id", "run", "part")
    spans = spans.agg(F.min("start").alias("start_char"), F.max("stop").alias("end_char"), F.count("*").alias("n_chunks"), F.sum("words").alias("n_words"), F.min("first").alias("first_id"))
    spans = spans.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("id", "run")))
    spans = t.write(spans.where(F.col("run_words") >= SEED_WORDS).drop("run_words", "part"), "spans")
    del every, known, marked
    t.drop("chunks", "repeats")
    runs = spans.groupBy("id", "run").agg(F.min("start_char").alias("start"), F.max("end_char").alias("stop"))
    runs = runs.groupBy("id").agg(F.collect_list(F.struct("run", "start", "stop")).alias("runs"))
    texts = may_hold(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), runs.select("id"), "id").join(runs, "id")
    seen = t.write(_windows(texts, least_words, docs.schema[id_col].dataType.simpleString()), "windows")
    del runs, texts
    let_go(docs.sparkSession)
    shared = seen.groupBy("window").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    shared = t.write(shared.select("window"), "shared")
    let_go(docs.sparkSession)
    held = t.write(seen.join(shared, "window", "left_semi").select("id", "run").distinct(), "held")
    t.drop("windows", "shared")
    spans = spans.join(held, ["id", "run"], "left_semi").withColumn("is_first", F.col("first_id") == F.col("id"))
    return spans.select(F.col("id").alias(id_col), "start_char", "end_char", "n_chunks", "n_words", F.col("first_id"), "is_first")
