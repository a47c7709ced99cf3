"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitting counts n-grams over all labelled rows, distributed; the driver gets languages x buckets sums (128 kB of matrix for
each language that occurs, however many rows there are), and the log-probability matrix is broadcast. Scoring gathers the matrix rows of a slice's n-grams in numpy.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, ship, slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Languages whose sums a task holds at once (16 MB); further ones make it pass on what it has.
HELD_LANGS = 64
SLICE_BYTES = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for i in [*range(0xD800), *range(0xE000, 0x32000)]:
        out[i] = unicodedata.category(chr(i))[0] == "L" if i > 127 else chr(i).isalpha()
    return out


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts (lower case, non-letters as one space, a space before each), the text of each, and whether a text has a letter."""
    lower = [(" " + t.lower()) if t else " " for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lower])
    letter = _letters()[codes]
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter | np.r_[True, letter[:-1]] | np.r_[True, owner[1:] != owner[:-1]]
    return codes[keep], owner[keep], has


def grams(codes: np.ndarray, owner: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram that lies within one text."""
    found, whose = [], []
    wide = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(wide), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if n > len(wide):
                break
            h = h[: len(wide) - n + 1] * np.uint64(1_000_003) + wide[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                own = owner[: len(h)]
                within = own == owner[n - 1 :]
                mixed = (h ^ (h >> np.uint64(29))) * _MIX
                found.append((mixed >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)[within])
                whose.append(own[within])
    return np.concatenate(found) if found else np.zeros(0, np.int64), np.concatenate(whose) if whose else np.zeros(0, np.int64)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, matrix languages x BUCKETS of log-probabilities) from all rows with a text and a language."""

    def count(batches):
        total: dict[str, np.ndarray] = {}

        def sums():
            for name, row in total.items():
                at = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "bucket", "n"])
            total.clear()

        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                langs = part.column(1).to_pylist()
                names = sorted(set(langs))
                codes, owner, _ = _codes(part.column(0).to_pylist())
                bucket, whose = grams(codes, owner)
                place = {x: i for i, x in enumerate(names)}
                index = np.array([place[x] for x in langs])[whose]
                order = np.argsort(index, kind="stable")
                bounds = np.searchsorted(index[order], np.arange(len(names) + 1))
                for i, name in enumerate(names):
                    if name not in total and len(total) == HELD_LANGS:
                        yield from sums()
                    row = np.bincount(bucket[order[bounds[i] : bounds[i + 1]]], minlength=BUCKETS)
                    total[name] = total[name] + row if name in total else row
        yield from sums()

    ship(labelled.sparkSession)
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col)
    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()  # at most languages x BUCKETS rows
    langs = sorted(got.column("lang").unique().to_pylist())
    table = np.full((len(langs), BUCKETS), 0.5)
    if langs:
        table[np.searchsorted(langs, got.column("lang").to_numpy(zero_copy_only=False).astype(str)), got.column("bucket").to_numpy()] += got.column("n").to_numpy()
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def classify(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text under equal priors; ``und`` and 0 for null texts and texts without a letter."""
    codes, owner, has = _codes(texts)
    scores = np.zeros((len(texts), max(1, len(langs))))
    if langs:
        bucket, whose = grams(codes, owner)
        for k in range(len(langs)):
            scores[:, k] = np.bincount(whose, matrix[k][bucket], len(texts))
    best = scores.argmax(1)
    p = 1 / np.exp(scores - scores.max(1, keepdims=True)).sum(1)
    ok = has & bool(langs)
    return [langs[b] if o else "und" for b, o in zip(best, ok)], np.where(ok, p, 0.0)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (0 to 1).

    Null and empty texts, texts without a letter, and all texts where no language was learned give ``und`` and 0. Of
    languages with the same score the first by name is taken. Repeated rows give a row each, null ids stay null, an empty
    table gives an empty result; extra columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, p = classify(batch.column(1).to_pylist(), *model.value)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(p, pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], run, f"id {kind}, lang_pred string, score double", SLICE_BYTES).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Rows whose CRC-32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the labelled rows that are not held out and predicts every row: id, held_out, lang_pred, score.

    Rows with a null id or a null language teach nothing and are predicted like others; see ``predict`` for the rest.
    """
    fold = docs.where(~held_out(id_col) & F.col(id_col).isNotNull())
    langs, matrix = fit(fold, text_col, lang_col)
    return predict(docs, langs, matrix, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
