"""Token counts by prefix dynamic programming over a sentencepiece BPE vocabulary.

For a chunk of text the table holds, for every prefix, the exact number of tokens of that prefix and its last token.
The encoding of a prefix is the encoding of a shorter prefix plus one token; exactly one vocabulary token that ends
there may follow the shorter prefix's last token: the one for which the pair alone encodes to itself. So the table is
filled left to right, and truncation and budget questions are look-ups.

No piece joins a non-space to a later space mark, so a text falls into chunks that encode independently; the table of
a text is the running sum over its chunks plus the chunk's own prefix table, which a bounded memo keeps.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import RELEASES, map_rows

MARK = "▁"
MEMO_WORDS = 300_000
#: Chunks beyond this many characters (as found in binary junk) are not kept in the memo.
MEMO_CHARS = 64


class PrefixCounter:
    """Exact token counts at every prefix, for one sentencepiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.score: dict[str, float] = {}
        for i in range(n):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        inner = [p for p in self.score if MARK in p[1:] and p.strip(MARK)]
        if inner:
            raise ValueError(f"pieces with an inner space mark: {inner[:3]}")
        self.known = {c for p in self.score for c in p}
        newline = "" if "\n" in self.known else "\n"
        self.chunks = re.compile(rf"{MARK}+[^{MARK}{newline}]*|[^{MARK}{newline}]+" + ("|\n+" if newline else ""))
        self.memo: dict[str, tuple[int, ...]] = {}
        self.totals: dict[str, int] = {}
        self._follows: dict[int, bool] = {}
        self._build()

    def _last_merge(self, piece: str) -> tuple[str, str]:
        """The two pieces whose merge, the last one, makes the piece."""
        steps: list[tuple[str, str]] = []
        self._merge(piece, steps)
        return steps[-1]

    def _merge(self, text: str, steps: list | None = None) -> list[str]:
        """Plain BPE of a short text: best score first, leftmost among equals. steps: gets each pair merged."""
        parts: list[str | None] = list(text)
        n = len(parts)
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-s, i, text[i : i + 2]) for i in range(n - 1) if (s := self.score.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] is None or j < 0 or parts[i] + parts[j] != joined:
                continue
            if steps is not None:
                steps.append((parts[i], parts[j]))
            parts[i], parts[j] = joined, None
            nxt[i] = k = nxt[j]
            if k >= 0:
                prev[k] = i
                if (s := self.score.get(joined + parts[k])) is not None:
                    heapq.heappush(heap, (-s, i, joined + parts[k]))
            if (h := prev[i]) >= 0 and (s := self.score.get(parts[h] + joined)) is not None:
                heapq.heappush(heap, (-s, h, parts[h] + joined))
        return [p for p in parts if p is not None]

    def _adjacent(self, a: str, b: str, below: int) -> bool:
        """Whether merges of a rank under ``below`` leave a and b apart."""
        rank, split, limit = self.rank, self.split, below
        while True:
            joined = rank.get(a + b)
            if joined is not None and joined < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:  # a was made later: look into it first
                if len(a) > 1:
                    limit, a = ra, split[a][1]
                elif len(b) > 1:
                    limit, b = rb + 1, split[b][0]
                else:
                    return True
            elif len(b) > 1:
                limit, b = rb + 1, split[b][0]
            elif len(a) > 1:
                limit, a = ra, split[a][1]
            else:
                return True

    def _build(self) -> None:
        """Ranks, last merges, and a trie of the reversed pieces that encode to themselves."""
        singles = {c: i for i, c in enumerate(sorted(self.known))}
        many = sorted((p for p in self.score if len(p) > 1), key=lambda p: (-self.score[p], len(p)))
        self.rank = singles | {p: len(singles) + i for i, p in enumerate(many)}
        self.split: dict[str, tuple[str, str]] = {}
        self.trie: dict = {}
        self.number: dict[str, int] = {}
        for p in [*singles, *many]:
            if len(p) > 1:
                if self._merge(p) != [p]:
                    continue
                self.split[p] = self._last_merge(p)
            self.number[p] = len(self.number) + 1
            node = self.trie
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = self.number[p]
        self.text = [""] * (len(self.number) + 1)
        for p, i in self.number.items():
            self.text[i] = p

    def _may_follow(self, a: int, b: int) -> bool:
        if len(self._follows) > 8 * MEMO_WORDS:
            self._follows.clear()
        x, y = self.text[a], self.text[b]
        if MARK * 2 in (x[:2], y[:2]):  # runs of marks share one score, so leftmost counts, not the rank
            ok = self._merge(x + y) == [x, y]
        else:
            ok = self._adjacent(x, y, len(self.rank) + 1)
        self._follows[a << 20 | b] = ok
        return ok

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Token counts of the chunk's prefixes of 1, 2, ... characters."""
        if (got := self.memo.get(chunk)) is not None:
            return got
        n, counts, last, trie, follows = len(chunk), [0], [0], self.trie, self._follows
        for end in range(n):
            if (node := trie.get(chunk[end])) is None:  # byte fallback; nothing merges with it
                counts.append(counts[-1] + len(chunk[end].encode("utf-8", "surrogatepass")))
                last.append(0)
                continue
            start = end
            while True:
                if (piece := node.get("")) is not None:
                    before = last[start]
                    if not before or (ok if (ok := follows.get(before << 20 | piece)) is not None else self._may_follow(before, piece)):
                        counts.append(counts[start] + 1)
                        last.append(piece)
                        break
                start -= 1
                if start < 0 or (node := node.get(chunk[start])) is None:
                    raise AssertionError(f"no token ends at {end} of {chunk!r}")
        out = tuple(counts[1:])
        if n <= MEMO_CHARS:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
                self.totals.clear()
            self.memo[chunk] = out
            self.totals[chunk] = out[-1]
        return out

    def table(self, text: str | None) -> PrefixTable:
        """The prefix table of a text; null counts as empty."""
        return PrefixTable(self, text or "")

    def total(self, text: str | None) -> int:
        if not text:
            return 0
        totals, chunk, n = self.totals, self.chunk, 0
        for c in self.chunks.findall(MARK + text.replace(" ", MARK)):
            n += t if (t := totals.get(c)) is not None else chunk(c)[-1]
        return n


class PrefixTable:
    """Counts at every prefix of one text: the running count at each chunk and the chunks' own tables."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.starts, self.before, self.chunks, total, at = [], [], [], 0, -1  # at: characters of the text before the chunk; the added mark is none
        for c in counter.chunks.findall(MARK + text.replace(" ", MARK)) if text else []:
            t = counter.chunk(c)
            self.starts.append(at)
            self.before.append(total)
            self.chunks.append(t)
            total += t[-1]
            at += len(c)
        self.total, self.n_chars = total, len(text)

    def count(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters."""
        if chars <= 0 or not self.starts:
            return 0
        k = bisect_right(self.starts, min(chars, self.n_chars) - 1) - 1
        return self.before[k] + self.chunks[k][min(chars, self.n_chars) - self.starts[k] - 1]

    def cut(self, budget: int) -> int:
        """The most characters c so that no prefix of up to c characters has more than ``budget`` tokens' worth at c."""
        if self.total <= budget:
            return self.n_chars
        k = bisect_right(self.before, budget) - 1
        while k >= 0:
            fits = [i for i, n in enumerate(self.chunks[k]) if self.before[k] + n <= budget]
            if fits:
                return max(0, self.starts[k] + fits[-1] + 1)
            k -= 1
        return 0


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


RELEASES[__name__] = counter.cache_clear


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit, cut_chars (characters of the longest prefix of at most ``limit`` tokens).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows each give a row; extra columns are not read. A null id
    is carried through. The model's path must exist on the executors.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(model_path)
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        n = [c.total(t) for t in texts]
        cut = [len(t or "") if k <= limit else c.table(t).cut(limit) for t, k in zip(texts, n)]
        size = [len(t.encode()) if t else 0 for t in texts]
        return pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n]), pa.array(cut, pa.int64())], ["id", "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, [id_col, text_col], count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long").withColumnRenamed("id", id_col)
