"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts become arrays of word hashes (lower case, letters and digits only). A mask keeps some token positions of a
window and ignores the others; the hash of the kept tokens at every position of the training texts is joined with the
hashes of the benchmark items. A hit says that a document and an item may overlap on one diagonal (the distance of the
two positions); each diagonal counts once, however many seeds hit it. On it the two texts are laid side by side, and the
overlap counts if enough tokens of a window are equal, whatever stands in the other places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, may_hold

#: Fixed masks of five kept tokens: wherever up to three of a window's 13 tokens differ, one of the masks fits between.
MASKS = ("111011", "110111", "1101000011")
#: The same for the shared stretches of 8 to 12 tokens, at a text's ends and in short items (two differ in 8 and 9).
EDGE_MASKS = ("110101", "1111", "1100101", "10010011")
WINDOW = 13
#: Shortest shared stretch that is compared.
LEAST = 8
#: Share of a window's tokens, in per cent, that must be equal.
SHARE = 70
#: Benchmark seeds are broadcast up to this count (about 10 MB; the items' tokens are fewer); beyond it the joins shuffle.
BROADCAST_SEEDS = 250_000


def token_hashes(text: Column) -> Column:
    """Hashes of a text's words; null and empty texts give an empty array."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(clean == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(clean, " "), lambda w: F.xxhash64(w)))


def _seeds(hashed: DataFrame, key: str, masks: tuple[str, ...], edge_masks: tuple[str, ...], near: Column) -> DataFrame:
    """(key, at, seed) for each position and mask that fits; edge masks only where ``near``."""
    n, at, least = F.size("tokens"), F.col("at"), min(map(len, masks + edge_masks))
    each = [F.when(at + len(m) <= n, F.xxhash64(F.lit(k), *(F.get("tokens", at + o) for o, c in enumerate(m) if c == "1"))) for k, m in enumerate(masks + edge_masks)]
    # the outer form, as the plain one would have the tokens made a second time for a filter on their number
    at_each = hashed.select(key, "tokens", F.explode_outer(F.when(n >= least, F.sequence(F.lit(0), n - least))).alias("at"))
    return at_each.select(key, "at", F.explode(F.when(near, F.array(*each)).otherwise(F.array(*each[: len(masks)]))).alias("seed")).where("seed is not null")


def overlaps(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", edge_masks: tuple[str, ...] = EDGE_MASKS) -> DataFrame:
    """One row per document and benchmark item that overlap: doc id, item id, n_matched of n_window tokens in the best window, first token of it.

    Null, empty and very short texts (under eight words) overlap with nothing, nor do items under eight words. Rows
    that repeat an id count as one document. A null id stays a null id. Extra columns are not read. An empty
    benchmark or an empty table gives an empty result. The masks fit every window of 13 tokens with 70 % equal and every
    shared stretch of 8 to 12, so no such overlap is missed; other windows and shares need other masks.
    """
    t = Scratch()
    items = benchmark.select(F.col(item_col).alias("item"), token_hashes(F.col(item_text)).alias("tokens"))
    items = t.write(items.where(F.size("tokens") >= LEAST), "items")
    by_seed = t.write(_seeds(items, "item", masks, edge_masks, F.lit(True)).withColumnRenamed("at", "item_at").distinct(), "seeds")
    small = by_seed.count() <= BROADCAST_SEEDS
    # stretches under a window lie at a document's ends, unless an item is that short
    short = items.where(F.size("tokens") < window).limit(1).count() > 0
    near = F.lit(True) if short else (F.col("at") < window - 1) | (F.col("at") > F.size("tokens") - window)
    hashed = docs.select(F.col(id_col).alias("id"), token_hashes(F.col(text_col)).alias("tokens"))
    hits = _seeds(hashed, "id", masks, edge_masks, near).join(F.broadcast(by_seed) if small else by_seed, "seed")
    diagonals = t.write(hits.select("id", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "diagonals")
    # only the stretch that a diagonal shares leaves the document's tokens, and only documents with a diagonal are read for it
    texts = may_hold(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), diagonals.select("id"), "id")
    texts = texts.select(F.col("id").alias("doc"), token_hashes(F.col("text")).alias("tokens"))
    to_item = items.select(F.col("item").alias("of"), F.col("tokens").alias("item_tokens"))
    both = diagonals.join(F.broadcast(to_item) if small else to_item, F.col("item").eqNullSafe(F.col("of"))).drop("of")
    both = texts.join(both, F.col("doc").eqNullSafe(F.col("id")))
    first, last = F.greatest(F.lit(0), "shift"), F.least(F.size("tokens"), F.col("shift") + F.size("item_tokens"))
    both = both.where(last - first >= LEAST).select("id", "item", first.alias("first"), F.slice("tokens", first + 1, last - first).alias("a"), F.slice("item_tokens", first - F.col("shift") + 1, last - first).alias("b"))
    both = both.select("id", "item", "first", F.zip_with("a", "b", lambda a, b: (a == b).cast("int")).alias("equal"))
    width = F.least(F.lit(window), F.size("equal"))

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda s, e: s + e)

    both = both.where(total(F.col("equal")) * 100 >= width * share)
    starts = F.sequence(F.lit(0), F.size("equal") - width)
    best = F.array_max(F.transform(starts, lambda s: F.struct(total(F.slice("equal", s + 1, width)).alias("n_matched"), width.alias("n_window"), (-s - F.col("first")).alias("s"))))
    found = both.select("id", "item", best.alias("best")).where(F.col("best.n_matched") * 100 >= F.col("best.n_window") * share)
    out = found.groupBy("id", "item").agg(F.max("best").alias("best"))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("best.n_matched").alias("n_matched"), F.col("best.n_window").alias("n_window"), (-F.col("best.s")).alias("at_word"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without an overlap, all their columns as they were; documents with a null id stay.

    Null, empty and short texts stay, an empty table stays empty, and an empty benchmark removes nothing.
    """
    id_col = options.get("id_col", "doc_id")
    found = Scratch().write(overlaps(docs, benchmark, **options).where(F.col(id_col).isNotNull()).select(id_col).distinct(), "leaked")
    alone = may_hold(docs, found, id_col, False)
    return alone.unionByName(may_hold(docs, found, id_col).join(found, id_col, "left_anti").select(*docs.columns))
