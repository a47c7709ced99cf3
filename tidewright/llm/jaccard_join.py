"""N-gram Jaccard self-join over a token-group matrix.

Equal shingle sets are one set. The rarest tokens of every set are held against those of all others; a set that shares
too few of them with any other set is linked with nothing. What is left is partitioned into groups of similar sets (those
that agree best with one central set, by bands of minimum hashes), in blocks of bounded size. All links are found in
blocks: a query and a block are laid side by side, the query's overlap with the union of the block's tokens bounds its
overlap with every member, and only where that reaches the threshold is the block opened and its members counted.

First each group's central set asks the blocks of its own group; that joins most near copies under one label. Then the
matrix says which blocks hold which of a set's rarest tokens, under another label: two sets that reach the threshold
share a part of their rarest tokens that follows from their sizes, and blocks that hold enough of them are asked. Members
that carry the query's label already need no second proof. The result does not depend on bands, groups or blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_rows, may_hold, ship, slices, take_over
from .components import components

WORDS = 4
PERCENT = 85
BANDS, BAND_ROWS = 6, 2
#: Members of a block, and bytes of tokens that a block or the queries that meet it in one task hold (a longer set is alone).
BLOCK, BLOCK_BYTES = 64, 1 << 20
#: Cells of the frequency sketch that orders tokens from rare to frequent; fixed, so what is broadcast is 4 MB.
SKETCH_BITS, SKETCH_SLICES = 22, 128
#: Sketches merged in one step.
SKETCH_FAN = 64
#: Two linked sets share s // SHARED_PART + 1 of their rarest tokens, s the smaller size, as many more are taken than one would need.
SHARED_PART = 25
SLICE_BYTES = 2 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BOUNDS = (np.arange(BANDS * BAND_ROWS, dtype=np.float64) * (2.0**64 / (BANDS * BAND_ROWS))).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_lists(texts: list[bytes | None], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit hashes of each text's k-word shingles, one text after the other; how many each has).

    Texts are UTF-8; A-Z count as lower case and words lie between ASCII white space. Fewer than k words make one
    shingle; null texts and texts without words make none.
    """
    words = [t.lower().split() if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    h = np.fromiter((x for w in words for x in map(xxhash.xxh3_64_intdigest, w)), np.uint64, int(n.sum()))
    ends = np.cumsum(n)
    sizes = np.where(n < k, n > 0, n - k + 1)
    out = np.empty(int(sizes.sum()), np.uint64)
    at = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        for width in sorted({int(x) for x in np.minimum(n, k)} - {0}):
            rolled = np.full(len(h) - width + 1, width, np.uint64)
            for i in range(width):
                rolled = _mix(rolled * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - width + 1 + i])
            for r in np.flatnonzero(n == width if width < k else n >= k).tolist():
                start = ends[r] - n[r]
                out[at[r] : at[r] + sizes[r]] = np.sort(rolled[start : start + sizes[r]])
    owner = np.repeat(np.arange(len(texts)), sizes)
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.bincount(owner[new], minlength=len(texts))


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _split(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(sizes).tolist()
    return [flat[b - n : b] for b, n in zip(ends, sizes.tolist())]


def _digest(tokens: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def shingle_sets(docs: DataFrame, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n (set size), digest of the set (null if empty), sid (its first 64 bits), band keys.

    Besides, each task adds SKETCH_SLICES rows (part, slice, cells) of how many of its sets hold a token, by the token's
    cell; their n is null. A band key is made of the first tokens from BAND_ROWS fixed places of the hash range on.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    bands = [f"b{i}" for i in range(BANDS)]
    names = ["id", "n", "digest", "sid", *bands, "part", "slice", "cells"]
    types = [None, pa.int64(), pa.binary(), pa.int64(), *[pa.int64()] * BANDS, pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        take_over(__name__)
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        id_type = None
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                flat, sizes = shingle_lists(_texts(part.column(1)), k)
                total += np.bincount(_cell(flat), minlength=1 << SKETCH_BITS)
                keys = np.zeros((BANDS, part.num_rows), np.uint64)
                digests = []
                for r, tokens in enumerate(_split(flat, sizes)):
                    digests.append(_digest(tokens))
                    if len(tokens):
                        low = tokens[np.searchsorted(tokens, _BOUNDS) % len(tokens)].reshape(BANDS, BAND_ROWS)
                        keys[:, r] = low[:, 0] * _MIX + low[:, 1]
                with np.errstate(over="ignore"):
                    keys = _mix(keys + np.arange(BANDS, dtype=np.uint64)[:, None])
                id_type = part.column(0).type
                none = [pa.nulls(part.num_rows, t) for t in types[-3:]]
                sids = pa.array([d and int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(digests, pa.binary()), sids, *(pa.array(x.view(np.int64)) for x in keys), *none], names)
        if id_type is not None:
            small = total.astype(np.min_scalar_type(int(total.max())))  # unsigned, as wide as the largest count needs
            cells = [zlib.compress(bytes([small.itemsize]) + x.tobytes(), 1) for x in small.reshape(SKETCH_SLICES, -1)]
            mine = [pa.nulls(SKETCH_SLICES, t or id_type) for t in types[:-3]]
            number = pa.array([TaskContext.get().partitionId()] * SKETCH_SLICES, pa.int32())
            yield pa.RecordBatch.from_arrays([*mine, number, pa.array(range(SKETCH_SLICES), pa.int32()), pa.array(cells, pa.binary())], names)

    schema = f"id {kind}, n long, digest binary, sid long, " + ", ".join(f"{b} long" for b in bands) + ", part int, slice int, cells binary"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def token_levels(sketches: DataFrame) -> np.ndarray:
    """How frequent the tokens of a cell are, from 0 to 255 (a logarithm): sketches (part, slice, cells) summed in a tree.

    Each step sums SKETCH_FAN sketches of a slice, so a group has a fixed size however many tasks there were.
    """
    schema = "part int, slice int, cells binary"

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_SLICES, np.int64)
        for x in table.column("cells"):
            raw = zlib.decompress(x.as_py())
            total += np.frombuffer(raw, f"u{raw[0]}", offset=1).astype(np.int64)
        part = table.column("part")[0].as_py() // SKETCH_FAN
        return pa.table({"part": pa.array([part], pa.int32()), "slice": table.column("slice")[:1], "cells": pa.array([zlib.compress(b"\x08" + total.tobytes(), 1)], pa.binary())})

    ship(sketches.sparkSession)
    most = sketches.agg(F.max("part")).first()[0]
    out = np.zeros((SKETCH_SLICES, (1 << SKETCH_BITS) // SKETCH_SLICES), np.uint8)
    if most is None:
        return out.reshape(-1)
    sketches = sketches.select("part", "slice", "cells")
    while True:
        sketches = sketches.groupBy("slice", F.floor(F.col("part") / SKETCH_FAN).alias("to")).applyInArrow(add, schema)
        if most < SKETCH_FAN:
            break
        most //= SKETCH_FAN

    def level(batches):
        for batch in batches:
            rows = [zlib.decompress(x.as_py()) for x in batch.column("cells")]
            levels = [np.minimum(255, np.log2(np.frombuffer(x, np.int64, offset=1) + 1.0) * 6).astype(np.uint8).tobytes() for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array(levels, pa.binary())], ["slice", "levels"])

    for r in sketches.mapInArrow(level, "slice int, levels binary").collect():  # SKETCH_SLICES rows of fixed size
        out[r["slice"]] = np.frombuffer(bytes(r["levels"]), np.uint8)
    return out.reshape(-1)


def rare_tokens(docs: DataFrame, levels: np.ndarray, percent: int = PERCENT, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sid, token) for the n - ceil(percent n / 100) + n // SHARED_PART + 1 rarest tokens of each set, in one order for all.

    Of two linked sets each holds all but percent n / 100 tokens in common, so the first n // SHARED_PART + 1 common
    tokens in the order are among the rarest of both, n the smaller size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        flat, sizes = shingle_lists(_texts(part.column(0)), k)
        key = shared.value[_cell(flat)].astype(np.uint64) << np.uint64(56) | flat >> np.uint64(8)
        found: dict[int, np.ndarray] = {}  # of equal sets in a slice one is enough
        for tokens, order in zip(_split(flat, sizes), _split(key, sizes)):
            n = len(tokens)
            if n:
                sid = int.from_bytes(_digest(tokens)[:8], "little", signed=True)
                if sid not in found:
                    last = min(n, n + percent * n // -100 + n // SHARED_PART + 1) - 1  # floor of the negative: minus the ceiling
                    found[sid] = tokens[order <= np.partition(order, last)[last]]
        owners = np.repeat(np.fromiter(found, np.int64, len(found)), [len(t) for t in found.values()])
        return pa.RecordBatch.from_arrays([pa.array(owners), pa.array(np.concatenate([*found.values(), np.zeros(0, np.uint64)]).view(np.int64))], ["sid", "token"])

    return map_rows(docs.where(F.col(id_col).isNotNull()), [text_col], run, "sid long, token long", SLICE_BYTES)


def token_lists(docs: DataFrame, sets: DataFrame, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n, tokens (sorted 64-bit numbers as bytes) for the sets (id, digest) wanted; texts of other ids are not shuffled further than the join."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        lists = _split(*shingle_lists(_texts(part.column(1)), k))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([_digest(x) for x in lists], pa.binary()), pa.array([len(x) for x in lists], pa.int32()), pa.array([x.tobytes() for x in lists], pa.binary())], ["id", "digest", "n", "tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = may_hold(texts, sets, "id").join(sets.select("id").distinct(), "id", "left_semi")
    lists = map_rows(texts, ["id", "text"], run, f"id {kind}, digest binary, n int, tokens binary", SLICE_BYTES)
    lists = lists.groupBy("id", "digest").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))  # rows may repeat
    return lists.join(sets.select("id", "digest"), ["id", "digest"], "left_semi").drop("digest")


def link_components(docs: DataFrame, percent: int = PERCENT, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id reachable by links, itself included).

    Sets of documents link when 100 |A and B| >= percent |A or B|. Documents without words (null, empty) link with
    nothing. Rows that share an id count as one document for its links; a null id has a null component unless a copy has
    an id. Extra columns are not read. An empty table gives an empty result. ``docs`` is read three times.
    """
    t = Scratch()
    every = t.write(shingle_sets(docs, k, id_col, text_col), "sets")
    sets = every.where("slice is null").select("id", "n", "digest", "sid")
    levels = token_levels(every.where("slice is not null"))
    bands = [f"b{i}" for i in range(BANDS)]
    reps = every.where("n > 0 and id is not null").groupBy("digest", "sid").agg(F.min("id").alias("id"), F.max("n").cast("int").alias("n"), *(F.max(b).alias(b) for b in bands))
    reps = t.write(reps, "reps")
    rare = t.write(rare_tokens(docs, levels, percent, k, id_col, text_col), "rare")
    several = t.write(rare.groupBy("token").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).where("x < y").select("token"), "several")
    shared = t.write(rare.join(several, "token", "left_semi").distinct(), "shared")  # tokens that occur in two sets or more
    t.drop("rare", "several")
    enough = shared.groupBy("sid").agg(F.count("*").alias("k"))
    least = F.floor(F.ceil(F.col("n") * percent / 100) / SHARED_PART) + 1  # the smaller of two linked sets may have this size
    play = t.write(reps.join(enough, "sid").where(F.col("k") >= least).drop("k"), "play")
    placed = t.write(_groups(play, t), "placed")
    tokens = t.write(token_lists(docs, play, k, id_col, text_col), "tokens")
    # each group's central set asks the blocks of its group
    own = placed.where("id <> g").select(F.col("g").alias("id"), F.col("g").alias("of"), F.col("block").alias("part")).distinct()
    stars = t.write(_ask(own.withColumn("label", F.col("id")), placed.withColumn("label", F.col("id")), tokens, percent), "stars")
    up = stars.select(F.col("b").alias("id"), F.col("a").alias("up"))  # one central set each, more central than itself: a forest
    up = t.write(up.join(up.select(F.col("id").alias("up"), F.col("up").alias("top")), "up", "left").select("id", "up", F.coalesce("top", "up").alias("label")), "up")
    labelled = t.write(placed.join(up.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")
    higher = up.join(up.select(F.col("id").alias("up"), F.col("label").alias("b")), "up").where("label <> b").select(F.col("label").alias("a"), "b")
    links = _across(shared, labelled, tokens, percent, t).unionByName(higher).unionByName(_same_document(sets, reps, labelled))
    merged = components(links, t, "merged").withColumnRenamed("node", "label")
    final = reps.select("id", "digest").join(labelled.select("id", "label").distinct(), "id", "left").withColumn("label", F.coalesce("label", "id"))
    final = t.write(final.join(merged, "label", "left").select("id", "digest", F.coalesce("root", "label").alias("root")), "roots")
    lowest = final.where("id <> root").groupBy("root").agg(F.min("id").alias("low"))
    final = t.write(final.join(lowest, "root", "left").select("digest", F.least("low", "root").alias("component_id")), "final")
    t.drop(*(x for x in t.paths if x not in ("sets", "final")))
    some = sets.where("n > 0").join(final, "digest", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    none = sets.where("n = 0").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return some.unionByName(none)


def _groups(play: DataFrame, t: Scratch) -> DataFrame:
    """play with g (the most central set of the set's bands, itself if alone) and block (its place in the group).

    A set is the more central the more sets its bands hold; what near copies were made from stands in most of them.
    """
    bands = play.select("id", F.posexplode(F.array(*(f"b{i}" for i in range(BANDS)))).alias("band", "key")).dropDuplicates(["id", "band"])
    counted = bands.groupBy("band", "key").agg(F.count("*").alias("c")).where("c > 1")
    ranked = bands.join(counted, ["band", "key"])
    ranked = t.write(ranked.drop("c").join(ranked.groupBy("id").agg(F.sum("c").alias("rank")), "id"), "ranked")
    best = F.max(F.struct("rank", (-F.col("id")).alias("m"))).alias("best")
    pivots = ranked.groupBy("band", "key").agg(best)
    own = ranked.join(pivots, ["band", "key"]).groupBy("id").agg((-F.max("best")["m"]).alias("g"))
    groups = t.write(play.select("id", "n").join(own, "id", "left").select("id", "n", F.coalesce("g", "id").alias("g")), "groups")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).alias("blocks")
    groups = groups.join(groups.groupBy("g").agg(blocks), "g").select("id", "g", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
    return play.select("sid", "id", "digest", "n").join(groups.distinct(), "id")


def _same_document(sets: DataFrame, reps: DataFrame, labelled: DataFrame) -> DataFrame:
    """Links (a, b) between the labels of sets that rows with one id have."""
    named = sets.where("n > 0 and id is not null")
    twice = named.groupBy("id").agg(F.min("sid").alias("x"), F.max("sid").alias("y")).where("x < y").select(F.col("id").alias("doc"))
    sids = named.select(F.col("id").alias("doc"), "digest").join(twice, "doc", "left_semi").join(reps.select("id", "digest"), "digest")
    labels = sids.join(labelled.select("id", "label").distinct(), "id", "left").select("doc", F.coalesce("label", "id").alias("a"))
    return labels.join(labels.groupBy("doc").agg(F.min("a").alias("b")), "doc").where("a <> b").select("a", "b")


def _ask(found: DataFrame, placed: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between labels: queries found (id, label, of, part) against the members of block ``part`` of group ``of``.

    The queries that meet a block in one task are bounded by their bytes; a block with more of them goes to several tasks.
    """
    ship(tokens.sparkSession)

    def compare(queries: pa.Table, members: pa.Table) -> pa.Table:
        take_over(__name__)
        lists = [np.frombuffer(x.as_py(), np.uint64) for x in members.column("tokens")]
        sizes, kinds = np.array([len(x) for x in lists]), members.column("label").to_pylist()
        flat, owner = np.concatenate([*lists, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(lists)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        union = flat[np.r_[True, flat[1:] != flat[:-1]]] if len(flat) else flat
        a, b = [], []
        for label, x in zip(queries.column("label").to_pylist(), queries.column("tokens")):
            q = np.frombuffer(x.as_py(), np.uint64)
            place = np.minimum(np.searchsorted(union, q), max(0, len(union) - 1))
            q_in = q[union[place] == q] if len(union) else q[:0]
            if 100 * len(q_in) < percent * len(q):
                continue  # the union holds too little of the query, so every member does
            first, last = np.searchsorted(flat, q_in), np.searchsorted(flat, q_in, "right")
            at = np.arange((last - first).sum()) + np.repeat(first - np.cumsum(last - first) + (last - first), last - first)
            inter = np.bincount(owner[at], minlength=len(lists))
            hits = {kinds[i] for i in np.flatnonzero(100 * inter >= percent * (len(q) + sizes - inter))} - {label}
            a += [label] * len(hits)
            b += hits
        kind = queries.schema.field("label").type
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})

    kind = found.schema["id"].dataType.simpleString()
    asked = found.join(tokens.select("id", F.col("n").alias("n_q")), "id").groupBy("of", "part").agg(F.ceil(F.sum("n_q") * 8 / BLOCK_BYTES).cast("int").alias("turns"))
    members = placed.select("id", "label", F.col("g").alias("of"), F.col("block").alias("part")).distinct().join(asked, ["of", "part"])
    members = members.select("id", "label", "of", "part", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn")).join(tokens.select("id", "tokens"), "id")
    queries = found.join(asked, ["of", "part"]).withColumn("turn", F.pmod(F.xxhash64("id"), "turns").cast("int")).join(tokens.select("id", "tokens"), "id")
    keys = ["of", "part", "turn"]
    return queries.select("label", "tokens", *keys).groupBy(*keys).cogroup(members.select("label", "tokens", *keys).groupBy(*keys)).applyInArrow(compare, f"a {kind}, b {kind}")


def _needed(n_q: str, n_y: Column, percent: int) -> Column:
    """How many of the rarest tokens two linked sets of these sizes share at least, two less for rounding.

    They share percent (n_q + n_y) / (100 + percent) tokens, and those that are not among the rarest of both are all
    beyond the rarest of one of them.
    """
    def beyond(n: Column) -> Column:
        return F.ceil(n * percent / 100) - F.floor(n / SHARED_PART) - 1

    q = F.col(n_q)
    return F.ceil(percent * (q + n_y) / (100 + percent)) - F.greatest(beyond(q), beyond(n_y)) - 2


def _across(shared: DataFrame, placed: DataFrame, tokens: DataFrame, percent: int, t: Scratch) -> DataFrame:
    """Links (a, b) between labels: the matrix finds the blocks that hold enough of a set's rarest tokens under another label."""
    rare = t.write(shared.join(placed.drop("digest"), "sid").drop("sid"), "rows")
    across = t.write(rare.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("token"), "across")
    rare = t.write(rare.join(across, "token", "left_semi"), "across rows")
    matrix = rare.groupBy("token", "g", "block").agg(F.min("label").alias("g_label"))
    meta = placed.groupBy("g", "block").agg(F.min("n").alias("g_min"), F.max("n").alias("g_max"))
    matrix = t.write(matrix.join(meta, ["g", "block"]).withColumnsRenamed({"g": "of", "block": "part"}), "matrix")
    found = rare.join(matrix, "token").where("g_label < label").groupBy("id", "n", "label", "of", "part", "g_min", "g_max").agg(F.count("*").alias("k"))
    low, high = F.greatest(F.ceil(F.col("n") * percent / 100), "g_min"), F.least(F.floor(F.col("n") * 100 / percent), "g_max")
    enough = F.greatest(F.lit(1), F.least(_needed("n", low, percent), _needed("n", high, percent)))
    found = t.write(found.where((low <= high) & (F.col("k") >= enough)).select("id", "label", "of", "part").distinct(), "found")
    return _ask(found, placed, tokens, percent)


def keep_one(docs: DataFrame, percent: int = PERCENT, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, the one with the least id, with all its columns.

    Of rows that share an id one stays. Documents without words (null, empty) stay, and so do rows with a null id. An
    empty table stays empty. Ids that fall into no cell of an id that goes or repeats are passed on without a shuffle.
    """
    linked = link_components(docs, percent, k, id_col, text_col).select(F.col(id_col).alias("id"), "component_id")
    t = Scratch()
    gone = t.write(linked.where("component_id <> id").select("id").distinct(), "gone")
    twice = linked.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    some = t.write(gone.unionByName(twice), "some")
    named = docs.where(F.col(id_col).isNotNull())
    touched = may_hold(named, some.select(F.col("id").alias(id_col)), id_col).join(gone.select(F.col("id").alias(id_col)), id_col, "left_anti").select(*docs.columns).dropDuplicates([id_col])
    alone = may_hold(named, some.select(F.col("id").alias(id_col)), id_col, False)
    return docs.where(F.col(id_col).isNull()).unionByName(alone).unionByName(touched)
