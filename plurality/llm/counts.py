"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are emitted."""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text import Memo, cut_at_blanks, plain_pieces, released, rows_of


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies, by its published rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counter:
    """Counts tokens of a byte-level BPE file; ``specials`` inside a text are one token each."""

    def __init__(self, merges: list[tuple[bytes, bytes]], specials: list[str], pattern: str):
        ids = {bytes([b]): b for b in range(256)}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            ids.setdefault(a + b, len(ids))
            self.pairs.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.pieces = regex.compile(pattern).findall
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.piece = Memo(lambda s: self.count_piece(s.encode("utf-8", "surrogatepass")))
        self.part = Memo(lambda s: self.count_part(" " + s))

    def count_piece(self, data: bytes) -> int:
        """Initial symbols minus merges. The list links live symbols; the heap holds adjacent pairs by (rank, place)."""
        n, get = len(data), self.pairs.get
        symbol, after, before = list(data), list(range(1, n + 1)), list(range(-1, n))
        heap = [(*found, i, i + 1) for i in range(n - 1) if (found := get((data[i], data[i + 1])))]
        heap = [(rank, i, made, symbol[i], j, symbol[j]) for rank, made, i, j in heap]
        heapify(heap)
        merges = 0
        while heap:
            _, i, made, left, j, right = heappop(heap)
            if symbol[i] != left or after[i] != j or symbol[j] != right:
                continue  # one of the two has merged since
            merges += 1
            symbol[i], symbol[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := get((made, symbol[k])):
                    heappush(heap, (found[0], i, found[1], made, k, symbol[k]))
            if (h := before[i]) >= 0 and (found := get((symbol[h], made))):
                heappush(heap, (found[0], h, found[1], symbol[h], i, made))
        return n - merges

    def count_part(self, text: str) -> int:
        return sum(map(self.piece.one, plain_pieces(text) or self.pieces(text)))

    def count(self, text: str) -> int:
        texts = [text]
        if self.special and self.special.search(text):
            texts = self.special.split(text)
        total = len(texts) - 1
        for t in texts:
            first, *rest = cut_at_blanks(t)
            total += self.count_part(first) + sum(self.part.all(rest))
        return total


@lru_cache(4)
def load_counter(vocabulary: str, pattern: str) -> Counter:
    """One counter per worker process and ``tokenizers`` JSON file of byte-level BPE."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    to_byte = byte_symbols()
    raw = lambda s: bytes(to_byte[c] for c in s)
    merges = [(raw(a), raw(b)) for a, b in (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])]
    return Counter(merges, [t["content"] for t in spec.get("added_tokens", [])], pattern)


def token_counts(docs: DataFrame, vocabulary: str, pattern: str, limit: int) -> DataFrame:
    """Columns ``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    A null text is empty: 0 bytes, 0 tokens. Repeated rows repeat; other columns are not
    read. One narrow Arrow pass without a shuffle; memory is bounded by the memo tables.
    """

    def run(batches):
        counter = load_counter(vocabulary, pattern)
        for batch in batches:
            for rows in rows_of(batch):
                n = [counter.count(t or "") for _, _, t in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(coalesce(octet_length(text), 0) as bigint) n_bytes", "text")
    return docs.mapInArrow(released(run), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
