"""Stupid-backoff scores: count tables in hash shards, joined to the documents' n-grams and summed per document."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import hash_words, released, rows_of, windows

#: words of a block of documents, whose n-grams ask the shards for their counts together
BLOCK_WORDS = 3_000_000
#: characters of the corpus for each shard of the count tables
SHARD_CHARS = 32_000_000


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers in as many bytes as the largest needs, byte by byte: upper bytes, mostly zeros, compress well in a shuffle."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """The numbers written at ``at``, and where they end."""
    width = data[at]
    x = np.zeros((n, 8), np.uint8)
    x[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 1).reshape(width, n).T
    return x.reshape(-1).view("<u8"), at + 1 + n * width


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, and their counts."""
    return len(keys).to_bytes(8, "little") + _planes(np.diff(keys, prepend=np.uint64(0))) + _planes(counts)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    gaps, end = _numbers(data, n, 8)
    return np.cumsum(gaps, dtype=np.uint64), _numbers(data, n, end)[0].astype(np.int64)


class _Block:
    """Documents of one block: word hashes one after the other, and where each document starts."""

    def __init__(self):
        self.ids, self.words, self.sizes, self.total = [], [], [], 0

    def add(self, doc_id, text: str | None) -> None:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        self.ids.append(doc_id)
        self.words.append(hash_words(words))
        self.sizes.append(len(words))
        self.total += len(words)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(self.words) if self.words else np.empty(0, np.uint64), np.array(self.sizes, np.int64)


def _blocks(batches):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 24
    block = _Block()
    for batch in batches:
        for rows in rows_of(batch):
            for doc_id, text in rows:
                block.add(doc_id, text)
                if block.total >= BLOCK_WORDS:
                    yield number, block
                    number, block = number + 1, _Block()
    if block.ids:
        yield number, block


def _bigrams(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all bigrams inside documents, and the place of each one's first word."""
    inside = np.ones(max(0, len(words) - 1), bool)
    ends = np.cumsum(sizes)[:-1]
    inside[ends[(ends > 0) & (ends < len(words))] - 1] = False
    return (windows(words, 2)[inside] if len(words) > 1 else np.empty(0, np.uint64)), np.flatnonzero(inside)


def _summed(blocks: pd.Series) -> list[bytes]:
    """Counts of one shard's table for the keys that each block asked for."""
    parts = [_unpacked(b) for b in blocks]
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order][:1])) if len(keys) else np.empty(0, np.int64)
    sums = np.add.reduceat(counts[order], first) if len(keys) else counts
    back = np.empty(len(keys), "<i8")
    back[order] = np.repeat(sums, np.diff(first, append=len(keys)))
    return [len(x).to_bytes(8, "little") + _planes(x) for x in np.split(back, np.cumsum([len(k) for k, _ in parts])[:-1])]


def backoff_scores(docs: DataFrame, alpha: float = 0.4) -> DataFrame:
    """Score of every document under the word bigrams of all *other* documents.

    Columns ``doc_id, n_words, n_seen`` (words whose bigram occurs elsewhere), ``n_backed_off``
    and ``score``, the sum of log scores in millionths. With counts c from which the
    document's own are taken off, N words in all other documents: the score of b after a is
    c(ab) / c(a) where c(ab) > 0, else ``alpha * c(b) / N``, and ``alpha / N`` where b is new
    as well; a first word starts at c(b) / N. Words are the runs without ASCII blanks, case
    kept; n-grams are compared by 64-bit hashes.

    Each block of documents sends its distinct n-grams with counts to the shards, which hold
    the count tables by hash; a shard adds up and answers the blocks, and the answers meet
    the block's documents again. A frequent n-gram is one row per block, so no key is hot;
    both groupings have groups of bounded size per block and shard. Blocks are numbered by
    input partition, so ``docs`` must be a table or another plan whose partitions stay the
    same when it is computed again; an answer that does not fit raises.

    Null texts have no words and score 0, as texts without words do. Repeated rows are
    documents of their own; null ids pass through. An empty table gives no rows.
    """
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    chars = docs.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, chars / SHARD_CHARS))))

    def ask(batches):
        for number, block in _blocks(batches):
            words, sizes = block.arrays()
            rows = []
            for kind, keys in ((1, words), (2, _bigrams(words, sizes)[0])):
                keys, counts = np.unique(keys, return_counts=True)
                cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
                for shard, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts))):
                    rows.append((shard, kind, number, _packed(k, c)))
            rows.append((-1, 0, number, len(words).to_bytes(8, "little")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["shard", "kind", "block", "data"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": rows.block, "shard": rows.shard, "kind": rows.kind, "data": _summed(rows.data)})

    def count(batches):
        for batch in batches:
            n = sum(len((t or "").encode("utf-8", "surrogatepass").split()) for rows in rows_of(batch) for (t,) in rows)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    total = docs.select("text").mapInArrow(released(count), "n bigint").agg(F.sum("n")).first()[0] or 0

    def own(batches):
        for number, block in _blocks(batches):
            words, sizes = block.arrays()
            distinct, place = np.unique(words, return_inverse=True)
            data = [pa.array([number], pa.int64()), pa.array([block.ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([_packed(distinct, np.ones(len(distinct), np.int64))], pa.binary()), pa.array([len(place).to_bytes(8, "little") + _planes(place)], pa.binary())]
            yield pa.RecordBatch.from_arrays(data, names=["own_block", "ids", "sizes", "distinct", "place"])

    def score(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in blocks.itertuples(index=False):
            distinct, place = _unpacked(row.distinct)[0], _numbers(row.place, int.from_bytes(row.place[:8], "little"), 8)[0].astype(np.int64)
            told = [np.concatenate([_numbers(b, int.from_bytes(b[:8], "little"), 8)[0].astype(np.int64) for b in answers[answers.kind == k].sort_values("shard").data] or [np.empty(0, np.int64)]) for k in (1, 2)]
            out.append(_scores(np.array(row.ids, object), np.array(row.sizes, np.int64), distinct, place, told[0], told[1], total, alpha))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("doc_id", "n_words", "n_seen", "n_backed_off", "score")})

    asked = docs.mapInArrow(released(ask), "shard int, kind int, block bigint, data binary").where("kind > 0")
    answers = asked.groupBy("shard", "kind").applyInPandas(answer, "block bigint, shard int, kind int, data binary")
    mine = docs.mapInArrow(released(own), "own_block bigint, ids array<bigint>, sizes array<bigint>, distinct binary, place binary")
    return mine.groupBy("own_block").cogroup(answers.groupBy("block")).applyInPandas(score, "doc_id bigint, n_words bigint, n_seen bigint, n_backed_off bigint, score bigint")


def _scores(ids, sizes, distinct, place, words_all, bigrams_all, total: int, alpha: float) -> pd.DataFrame:
    words = distinct[place]
    bigrams, at = _bigrams(words, sizes)
    keys, which = np.unique(bigrams, return_inverse=True)
    if len(words_all) != len(distinct) or len(bigrams_all) != len(keys):
        raise RuntimeError("the documents of a block changed between two passes; write them to a table first")
    doc = np.repeat(np.arange(len(sizes)), sizes)

    def elsewhere(key: np.ndarray, owner: np.ndarray, everywhere: np.ndarray) -> np.ndarray:
        """Counts in all documents but the owner's, for each occurrence."""
        pair, back, n = np.unique(owner * max(1, len(everywhere)) + key, return_inverse=True, return_counts=True)
        return everywhere[key] - n[back]

    one = elsewhere(place, doc, words_all)
    others = np.maximum(total - sizes[doc], 1)
    single = np.where(one > 0, one, 1) / others
    first = np.zeros(len(words), bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    value = np.where(first & (one > 0), single, alpha * single)
    two = elsewhere(which, doc[at], bigrams_all)
    seen = two > 0
    after = at + 1
    value[after[seen]] = two[seen] / one[at[seen]]
    micro = np.floor(np.log(value) * 1e6 + 0.5).astype(np.int64)
    hits = np.zeros(len(words), np.int64)
    hits[after[seen]] = 1
    per = lambda x: np.bincount(doc, x, len(sizes)).astype(np.int64)  # noqa: E731  sums of whole numbers below 2^53
    n_seen = per(hits)
    return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_words": sizes, "n_seen": n_seen, "n_backed_off": np.maximum(sizes - 1, 0) - n_seen, "score": per(micro)})
