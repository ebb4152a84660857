"""Byte-level BPE: encoding as a tree reduction over a monoid of token lists, and its inverse.

The empty list is the neutral element and :meth:`Codec.join` the operation: the encoding of
``a + b`` follows from those of ``a`` and ``b`` by re-encoding a window around the seam.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .text import Memo, cut_at_blanks, plain_pieces, released, rows_of

#: bytes up to which a piece is a leaf of the tree: short, so that the same leaves come again and are remembered
LEAF_BYTES = 6
#: bytes up to which a pair is found by scanning
SCAN_BYTES = 64
#: characters up to which a text is a leaf of the tree
LEAF_CHARS = 8192


class Codec:
    """Encoder and decoder of one rank table; ``pattern`` splits text into pieces that never merge with each other."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        # where a run of letters, digits or other signs ends for good, whatever stands around
        self.safe = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=[^\p{N}\s])|(?<=\p{L})(?=[^\s\p{L}\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})")
        size = max(self.tokens) + 1
        self.lengths = np.array([len(self.tokens.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self.four = {i: i.to_bytes(4, "little") for i in self.tokens}
        self.leaf = Memo(self.merge)
        self.seam = Memo(lambda pair: self.merge(self.tokens[pair[0]] + self.tokens[pair[1]]))
        self.piece = Memo(lambda s: b"".join(map(self.four.__getitem__, self.encode_piece(s.encode("utf-8", "surrogatepass")))))
        self.part = Memo(lambda s: self.encode_part(" " + s))

    def stable(self, a: int, b: int) -> bool:
        return self.seam.one((a, b)) == [a, b]

    def merge(self, data: bytes) -> list[int]:
        """Leaf: merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        if len(data) > SCAN_BYTES:
            return self.merge_long(data)
        get = self.ranks.get
        cuts = list(range(len(data) + 1))
        found = [get(data[i : i + 2], 1 << 40) for i in range(len(data) - 1)]
        while found and (low := min(found)) < 1 << 40:
            k = found.index(low)
            del cuts[k + 1], found[k]
            if k < len(found):
                found[k] = get(data[cuts[k] : cuts[k + 2]], 1 << 40)
            if k:
                found[k - 1] = get(data[cuts[k - 1] : cuts[k + 1]], 1 << 40)
        return [self.ranks[data[a:b]] for a, b in zip(cuts, cuts[1:])]

    def merge_long(self, data: bytes) -> list[int]:
        """The same with a heap, for windows that had to grow."""
        get, n = self.ranks.get, len(data)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n)), bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, end = heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or after[j] != end:
                continue
            alive[j] = 0
            after[i] = end
            if end < n:
                before[end] = i
                if (r := get(data[i : after[end]])) is not None:
                    heappush(heap, (r, i, after[end]))
            if (h := before[i]) >= 0 and (r := get(data[h:end])) is not None:
                heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : after[i]]])
            i = after[i]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenation of two encoded byte strings.

        A token list is the encoding of its bytes if every adjacent pair of it is the
        encoding of that pair's bytes. Pairs inside either side and inside the window
        hold by construction, so only the window's two seams are checked; a side whose
        seam fails gives twice as many tokens to the window.
        """
        if not left or not right:
            return left or right
        window = self.seam.one((left[-1], right[0]))
        i, j = 1, 1
        while True:
            left_holds = i >= len(left) or self.stable(left[-i - 1], window[0])
            right_holds = j >= len(right) or self.stable(window[-1], right[j])
            if left_holds and right_holds:
                return left[: len(left) - min(i, len(left))] + window + right[j:]
            i, j = i if left_holds else 2 * i, j if right_holds else 2 * j
            window = self.merge(b"".join(map(self.tokens.__getitem__, left[-i:] + right[:j])))

    def encode_piece(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.leaf.one(data)
        half = len(data) // 2
        return self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))

    def encode_part(self, text: str) -> bytes:
        return b"".join(map(self.piece.one, plain_pieces(text) or self.pieces(text)))

    def encode(self, text: str) -> bytes:
        """Token ids of a text as packed 32-bit integers.

        Halves meet at a place where the pattern surely has a boundary, so the window of
        their join is empty and joining is concatenation.
        """
        if len(text) > LEAF_CHARS:
            half = len(text) // 2
            cut = self.safe.search(text, half) or self.safe.search(text, 1, half)
            if cut and 0 < cut.start() < len(text):
                return self.encode(text[: cut.start()]) + self.encode(text[cut.start() :])
        first, *rest = cut_at_blanks(text)
        return self.encode_part(first) + b"".join(self.part.all(rest))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of token ids: leaves are looked up, then concatenated up the tree."""
        if len(ids) > LEAF_CHARS:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        n = self.lengths[ids]
        return self.flat[np.repeat(self.starts[ids] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()


@lru_cache(4)
def load_codec(rank_file: str, pattern: str) -> Codec:
    """One codec per worker process and rank file (lines of base64 token and rank)."""
    with open(rank_file, "rb") as lines:
        return Codec({base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}, pattern)


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns ``key, ids (binary, little-endian unsigned 32-bit), decoded (binary)`` for every row.

    One narrow Arrow pass: no shuffle, so neither a hot key nor copies weigh on one task,
    and a lost task is simply run again. Null texts count as empty: no ids, no bytes.
    Repeated rows give repeated results; other columns are not read.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, ids binary, decoded binary"

    def run(batches):
        codec = load_codec(rank_file, pattern)
        for batch in batches:
            for rows in rows_of(batch):
                ids = [codec.encode(t or "") for _, t in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in rows], batch.schema.field(0).type), pa.array(ids, pa.binary()), pa.array([codec.decode(np.frombuffer(x, "<u4")) for x in ids], pa.binary())],
                    names=[key, "ids", "decoded"],
                )

    return docs.select(key, text).mapInArrow(released(run), schema)


def encoding_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Columns ``doc_id, n_tokens, ids_sha256, decoded_sha256``: the round trip of every text in digest form.

    A null text is empty: 0 tokens and the digests of no bytes.
    """
    rows = encode_texts(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), rank_file, pattern)
    return rows.selectExpr("doc_id", "cast(octet_length(ids) div 4 as bigint) n_tokens", "sha2(ids, 256) ids_sha256", "sha2(decoded, 256) decoded_sha256")
