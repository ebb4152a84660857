"""Packing of tokenized documents into windows by minimum bin slack."""

from __future__ import annotations

import json
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .counts import byte_symbols
from .text import Memo, cut_at_blanks, released, rows_of

#: pieces that wait for a window at a time; they bound a task's memory and the size of a search
POOL = 512


class LibraryIds:
    """Ids as ``tokenizers`` gives them for a byte-level BPE file, with the parts of a text remembered.

    Where the file's ids ascend with its merges, each part's ids come from the rank form
    of the same vocabulary, which has less to do per call; texts with a special string,
    and other files, go through ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte, vocab = byte_symbols(), spec["model"]["vocab"]
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        self.ranked = made == sorted(made) and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if self.ranked:
            ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t not in self.specials}
            ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.part = Memo(lambda s: array("I", ranked(" " + s)).tobytes())
            self.first = lambda s: np.array(ranked(s), "<u4").tobytes()

    def packed(self, text: str) -> bytes:
        if not self.ranked or any(s in text for s in self.specials):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = cut_at_blanks(text)
        return self.first(first) + b"".join(self.part.all(rest))


@lru_cache(4)
def load_ids(vocabulary: str, pattern: str) -> LibraryIds:
    return LibraryIds(vocabulary, pattern)


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length fill ``capacity`` with the least slack.

    Bit ``s`` of a bitset says that some multiset sums to ``s``. Lengths join one by one,
    their counts in binary portions; the best sum is then traced back to a count per length.
    """
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        steps.append((length, reach))
        left, portion = min(counts[length], capacity // length), 1
        while left:
            take = min(portion, left)
            reach |= (reach << (take * length)) & mask
            left, portion = left - take, portion * 2
        if reach >> capacity:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            chosen[length] = n
    return chosen


class Packer:
    """Fills windows from a pool of pieces; a piece is ``(key, start, ids, tokens of its document)``."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.pool: dict[int, list[tuple]] = defaultdict(list)
        self.waiting = 0

    def put(self, key, start: int, ids: bytes, tokens: int) -> None:
        if ids:
            self.pool[len(ids) // 4].append((key, start, ids, tokens))
            self.waiting += 1

    def take(self, length: int) -> tuple:
        piece = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.waiting -= 1
        return piece

    def lay(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for key, start, ids, tokens in pieces:
            yield key, start, len(ids) // 4, ids, tokens, self.sequence, offset
            offset += len(ids) // 4
        self.sequence += 1

    def window(self) -> Iterator[tuple]:
        """One window: the longest waiting piece, the best company for it, and a cut piece in what slack remains."""
        longest = max(self.pool)
        pieces, gap = [self.take(longest)], self.capacity - longest
        if gap:
            for length, n in closest_fill({k: len(v) for k, v in self.pool.items()}, gap).items():
                pieces += [self.take(length) for _ in range(n)]
                gap -= n * length
        if gap and self.pool:
            key, start, ids, tokens = self.take(max(self.pool))
            pieces.append((key, start, ids[: 4 * gap], tokens))
            self.put(key, start + gap, ids[4 * gap :], tokens)
            gap = 0
        if not gap:
            yield from self.lay(pieces)
            return
        # the task's last pieces: sequences at falling powers of two need no padding
        room, filled, group = 1 << ((self.capacity - gap).bit_length() - 1), self.capacity - gap, []
        while pieces:
            key, start, ids, tokens = pieces.pop(0)
            n = min(room, len(ids) // 4)
            group.append((key, start, ids[: 4 * n], tokens))
            if 4 * n < len(ids):
                pieces.insert(0, (key, start + n, ids[4 * n :], tokens))
            room, filled = room - n, filled - n
            if not room:
                yield from self.lay(group)
                room, group = 1 << max(0, filled.bit_length() - 1), []

    def add(self, key, ids: bytes) -> Iterator[tuple]:
        n, size = len(ids) // 4, 4 * self.capacity
        whole = len(ids) // size
        for k in range(whole):
            yield from self.lay([(key, k * self.capacity, ids[k * size : (k + 1) * size], n)])
        self.put(key, whole * self.capacity, ids[whole * size :], n)
        while self.waiting > POOL:
            yield from self.window()

    def rest(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self.window()


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Cut and pack all documents into sequences of at most ``capacity`` tokens.

    Columns ``doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset``, a row per piece; every token of a document and its end token lies
    in exactly one piece. Whole windows are cut off long documents; the rests wait in a pool
    of at most ``POOL`` pieces, from which each window takes the multiset of lengths with the
    least slack. Each task packs its own partition as it streams, so nothing is shuffled and
    a lost task gives the same sequences again; ``sequence_id`` holds the partition number
    in its upper bits. Only a task's last pieces may be short: they form sequences at powers
    of two. A null text is empty and has its end token only; repeated rows are packed again.
    """

    def run(batches):
        from pyspark import TaskContext

        library = load_ids(vocabulary, pattern)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        end = end_id.to_bytes(4, "little")
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for rows in rows_of(batch):
                if out := [piece for key, text in rows for piece in packer.add(key, library.packed(text or "") + end)]:
                    yield as_batch(out)
        if out := list(packer.rest()):
            yield as_batch(out)

    schema = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(released(run), schema)


def packing_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the ids as their unsigned CRC-32 in column ``ids_crc32``."""
    return pieces.selectExpr("doc_id", "start", "length", "crc32(ids) ids_crc32", "doc_tokens", "sequence_id", "`offset`")
