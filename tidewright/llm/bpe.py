"""BPE encoding and decoding with a pair occurrence index.

The words of a slice that are not yet known are laid out as one array of symbols. An index maps each mergeable pair to
all its positions in the array; the ranks that occur are taken in ascending order from a heap, the pair's positions
are merged left to right, and the lists of the neighbouring pairs are updated. A bounded memo keeps words between
slices of a task. Decoding looks the ids up and joins the tokens as the library does for a file without decoder.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase
from tokenizers.pre_tokenizers import Split

from .common import RELEASES, map_rows

MEMO_WORDS = 300_000
SLICE_BYTES = 1 << 20
#: White space as the tokenizer file's patterns see it.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: Texts with characters from here on always take the library's own tables.
PROBED = 0x3000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def every_char() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def char_class(pattern: str) -> str:
    """The code points of a one-character pattern as the library's own regex engine knows them, as ranges of a class.

    Engines follow different versions of Unicode; newer letters would else split words in another way.
    """
    every = every_char()
    return "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for run, _ in Split(Regex(f"{pattern}+"), "removed", invert=True).pre_tokenize_str(every) if run)


class WordBpe:
    """Encoder and decoder for a tokenizer file with NFC, lower case, a word pattern, byte symbols and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        letter, digit = char_class(r"\p{L}"), char_class(r"\p{N}")
        pattern = "'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^{2}{0}{1}]+".format
        self.words, self.plain_words = regex.compile(pattern(letter, digit, SPACE)), regex.compile(pattern(r"\p{L}", r"\p{N}", SPACE))
        every = every_char()
        first = every[:PROBED]
        odd = [ord(min(found)) for kind, ours in ((letter, "L"), (digit, "N")) if (found := set(regex.findall(f"[{kind}]", first)) ^ set(regex.findall(rf"\p{{{ours}}}", first)))]
        self.lower = {}
        for k in range(0, len(every), 1 << 14):  # bit by bit, for memory
            part = every[k : k + (1 << 14)].replace("\n", "")
            self.lower |= {ord(c): x for c, x in zip(part, Lowercase().normalize_str("\n".join(part)).split("\n")) if x != c.lower()}
        #: Below it the regex module, Python and the library know the same letters, digits and lower case.
        self.plain = chr(min([*odd, *self.lower, PROBED]))
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = r
            self.made.append(vocab[a + b])
        symbols = byte_symbols()
        self.inner, self.final = [vocab[c] for c in symbols], [vocab[c + self.end] for c in symbols]
        self.ids_of: dict[str, str] = {}  # word -> decimal ids, and its tokens, joined by spaces
        self.tokens_of: dict[str, str] = {}

    def split(self, text: str) -> list[str]:
        """Normalised words of a text without special strings."""
        if text.isascii() or max(text) < self.plain:
            text = self.spaces.sub(" ", text if text.isascii() else unicodedata.normalize("NFC", text))
            return self.plain_words.findall(text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower())
        text = self.spaces.sub(" ", NFC().normalize_str(text))
        return self.words.findall(text.translate(self.lower).replace("Σ", "σ").lower())

    def learn(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Encodes words together by the pair occurrence index."""
        sym: list[int] = []
        starts: list[int] = []
        order = sorted(words)
        for w in order:
            data = w.encode("utf-8", "replace")
            starts.append(len(sym))
            sym.extend(map(self.inner.__getitem__, data[:-1]))
            sym.append(self.final[data[-1]])
            sym.append(-1)
        n = len(sym)
        prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
        rank, made = self.rank.get, self.made
        index: dict[int, list[int]] = {}
        for i, pair in enumerate(zip(sym, sym[1:])):
            if (r := rank(pair)) is not None:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
        heap = list(index)
        heapq.heapify(heap)
        pair_of = self.pairs
        while heap:
            r = heapq.heappop(heap)
            places = index.pop(r)
            left, right = pair_of[r]
            new = made[r]
            places.sort()
            for i in places:
                if sym[i] != left or sym[j := nxt[i]] != right:
                    continue  # an earlier merge took part of it
                sym[i], sym[j] = new, -2
                nxt[i] = k = nxt[j]
                prev[k] = i
                if (q := rank((new, sym[k]))) is not None:
                    if q in index:
                        index[q].append(i)
                    else:
                        index[q] = [i]
                        heapq.heappush(heap, q)
                h = prev[i]
                if h >= 0 and (q := rank((sym[h], new))) is not None:
                    if q in index:
                        index[q].append(h)
                    else:
                        index[q] = [h]
                        heapq.heappush(heap, q)
        return {w: tuple(x for x in sym[a : b - 1] if x >= 0) for w, a, b in zip(order, starts, [*starts[1:], n])}

    @property
    def pairs(self) -> list[tuple[int, int]]:
        if not hasattr(self, "_pairs"):
            self._pairs = list(self.rank)
        return self._pairs

    def pieces(self, text: str) -> list[str | int]:
        """Words and ids of special strings, in order."""
        if "<|" not in text:
            return self.split(text)
        out: list[str | int] = []
        at = 0
        for m in self.specials.finditer(text):
            out += self.split(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.split(text[at:])

    def prepare(self, texts: list[str | None]) -> list[list[str | int]]:
        """The texts' pieces; afterwards every word among them is in the memo."""
        if len(self.ids_of) > MEMO_WORDS:
            self.ids_of.clear()
            self.tokens_of.clear()
        out = [self.pieces(t) if t else [] for t in texts]
        unknown = {w for ws in out for w in ws if w not in self.ids_of and not isinstance(w, int)}
        for w, ids in self.learn(unknown).items():
            self.ids_of[w] = " ".join(map(str, ids))
            self.tokens_of[w] = " ".join(map(self.token.__getitem__, ids))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null is empty. Special strings in a text give their ids."""
        return [[i for w in ws for i in ([w] if isinstance(w, int) else map(int, self.ids_of[w].split(" ")))] for ws in self.prepare(texts)]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space; special tokens stay; ids outside the vocabulary are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


@lru_cache(maxsize=2)
def coder(path: str) -> WordBpe:
    return WordBpe(path)


RELEASES[__name__] = coder.cache_clear


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids array<int>, n_tokens, SHA-256 of the decoded text. Null and empty texts: no ids.

    Repeated rows give a row each; extra columns are not read; the tokenizer's path must exist on the executors.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(path)
        ids = c.encode(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids], pa.string())], ["id", "ids", "n_tokens", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], run, f"id {kind}, ids array<int>, n_tokens long, decoded_sha256 string", SLICE_BYTES).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, and the SHA-256 of its decimal ids and of its decoded text (nulls as in ``encode``)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(path)
        ids_of, tokens_of, token = c.ids_of, c.tokens_of, c.token
        counts, ids_sha, text_sha = [], [], []
        for ws in c.prepare(batch.column(1).to_pylist()):
            ids = " ".join([str(w) if isinstance(w, int) else ids_of[w] for w in ws])
            text = " ".join([token[w] if isinstance(w, int) else tokens_of[w] for w in ws])
            counts.append(ids.count(" ") + 1 if ids else 0)
            ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
            text_sha.append(hashlib.sha256(text.encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", SLICE_BYTES).withColumnRenamed("id", id_col)


