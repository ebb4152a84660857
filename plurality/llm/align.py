"""Cross-tokenizer alignment: tokens of two vocabularies as byte intervals, coalesced into groups."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .counts import byte_symbols
from .packing import LibraryIds
from .text import Memo, cut_at_blanks, released, rows_of

#: documents of a batch are aligned together up to so many characters; a longer one alone
BATCH_CHARS = 1 << 19
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


#: stands for the ids of a part that are other text than the part
UNSPELLED = b"unspelled"


def _spell(tokens: list[bytes], ids: np.ndarray, text: str) -> bool:
    return b"".join(map(tokens.__getitem__, ids.tolist())) == b" " + text.encode("utf-8", "surrogatepass")


class ByteVocabulary:
    """Side A: a byte-level BPE file for ``tokenizers``; the text gets a blank in front, special strings are plain text."""

    def __init__(self, vocabulary: str, pattern: str):
        self.ids = LibraryIds(vocabulary, pattern)
        self.ids.specials, self.ids.library.encode_special_tokens = [], True
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte, entries = byte_symbols(), spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.bytes = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.bytes[i] = token.encode() if token in special else bytes(to_byte[c] for c in token)

    def encode(self, text: str) -> np.ndarray | None:
        """Ids of the tokens, or None where they do not spell a blank and the text."""
        ids = np.frombuffer(self.ids.packed(" " + text), "<u4").astype(np.int64)
        # the rank form works on the very bytes; a file that normalises goes through the library
        return ids if self.ids.ranked or _spell(self.bytes, ids, text) else None


class PieceVocabulary:
    """Side B: a ``sentencepiece`` model, which puts the blank in front by itself."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        as_bytes = lambda p: bytes([int(m[1], 16)]) if (m := _BYTE_PIECE.fullmatch(p)) else p.replace("▁", " ").encode()
        self.bytes = [as_bytes(p) for p in pieces]
        # a blank stands in front of a piece only: then no merge crosses the place before a blank that follows other signs
        self.by_parts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.blank = array("I", self.library.encode("a ")[-1:]).tobytes()
        self.part = Memo(lambda s: self.parts([s])[0], many=self.parts)

    def parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part behind its blank; ``UNSPELLED`` where they do not spell it."""
        encoded = [array("I", ids).tobytes() if b"".join(map(self.bytes.__getitem__, ids)) == b" " + s.encode("utf-8", "surrogatepass") else UNSPELLED for s, ids in zip(parts, self.library.encode(parts, num_threads=1))]
        return [x if s else self.blank for s, x in zip(parts, encoded)]

    def encode(self, text: str) -> np.ndarray | None:
        """Ids of the tokens, or None where they do not spell a blank and the text."""
        if not self.by_parts or "▁" in text:
            ids = np.array(self.library.encode(text), np.int64)
            return ids if _spell(self.bytes, ids, text) else None
        first, *rest = cut_at_blanks(" " + text)
        ids = self.part.all([first[1:], *rest] if first else rest)
        return None if UNSPELLED in ids else np.frombuffer(b"".join(ids), "<u4").astype(np.int64)


@lru_cache(2)
def load_sides(vocabulary: str, pattern: str, model: str) -> tuple[ByteVocabulary, PieceVocabulary]:
    return ByteVocabulary(vocabulary, pattern), PieceVocabulary(model)


def coalesce(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the intervals by start and the group of each in that order.

    A group breaks where a start reaches the running maximum of the ends before it.
    """
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    new = np.zeros(len(order), np.int64)
    new[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(new)


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping pairs (token of A, token of B) of two tilings of the same bytes, and whether their ranges end together.

    Between two neighbouring ends lies one pair, so they are expanded by a merge of the ends: no pair of a group is tried in vain.
    """
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")  # two sorted runs: one merge
    ends = ends[np.r_[True, ends[1:] != ends[:-1]][: len(ends)]]
    a, b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return a, b, ends_a[a] == ends_b[b]


class Aligned:
    """Tokens, groups and overlapping pairs of a batch of documents; each document's bytes lie behind the one before."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.n_a, self.n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        self.a, self.b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b))
        ends_a, ends_b = np.cumsum(sizes_a[self.a]), np.cumsum(sizes_b[self.b])
        docs = np.arange(len(a))
        doc = np.concatenate([np.repeat(docs, self.n_a), np.repeat(docs, self.n_b)])
        side = np.repeat([0, 1], [len(self.a), len(self.b)])
        ends = np.concatenate([ends_a, ends_b])
        starts = ends - np.concatenate([sizes_a[self.a], sizes_b[self.b]])
        order, group = coalesce(starts, ends)
        # within a group A's tokens come first
        order = order[np.lexsort((starts[order], side[order], group))]
        self.doc, self.side, self.group = doc[order], side[order], group
        self.token = np.concatenate([self.a, self.b])[order]
        last = np.ones(len(group), bool)
        last[:-1] = group[1:] != group[:-1]
        self.n_groups = np.bincount(self.doc[last], minlength=len(a))
        at_a, at_b, together = overlaps(ends_a, ends_b)
        self.pair_doc, self.pair_a, self.pair_b, self.together = doc[: len(self.a)][at_a], self.a[at_a], self.b[at_b], together

    def texts(self, written: list[np.ndarray]) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document; ``written[k]`` holds all ids followed by the k-th of ``,`` ``|`` ``;``."""
        mark = np.zeros(len(self.token), np.int64)
        change = np.ones(len(self.token), bool)
        change[:-1] = (self.group[1:] != self.group[:-1]) | (self.side[1:] != self.side[:-1])
        mark[change] = 1 + self.side[change]
        parts = np.empty(len(self.token), object)
        for k in range(3):
            here = mark == k
            parts[here] = written[k][self.token[here]]
        parts, out, i = parts.tolist(), [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append("".join(parts[i : i + n])[:-1])
            i += n
        return out


def align(docs: DataFrame, vocabulary: str, pattern: str, model: str) -> DataFrame:
    """Columns ``doc_id, n_a, n_b, n_groups, groups, pairs, counts`` for every row of ``docs(doc_id, text)``.

    A encodes a blank and the text by the byte-level BPE file, B the text by the piece model,
    which adds the blank. Their tokens are byte intervals; offsets at which a token of A and
    one of B end together cut them into groups, written ``a1,a2|b1;a3|b2,b3`` by id. ``pairs``
    holds, once each and in order, ``id of A * size of B's vocabulary + id of B`` of all pairs of
    tokens that end together, ``counts`` how often each comes. A text that is null or empty,
    or whose tokens do not spell it (a normalising model), has no tokens and empty columns.

    Repeated rows repeat; other columns are not read. A narrow pass without a shuffle.
    """
    arrays = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs", "counts"]

    def emit(ids: list, a: list, b: list, sides, sizes, written) -> pa.RecordBatch:
        t = Aligned(a, b, *sizes)
        keys = (t.pair_a * len(sides[1].bytes) + t.pair_b)[t.together]
        doc = t.pair_doc[t.together]
        order = np.lexsort((keys, doc))
        keys, doc = keys[order], doc[order]
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])][: len(keys)])
        counts = np.diff(np.r_[first, len(keys)])
        cuts = pa.array(np.searchsorted(doc[first], np.arange(len(ids) + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (keys[first], counts.astype(np.int64))]
        columns = [pa.array(c, k) for c, k in zip((ids, t.n_a, t.n_b, t.n_groups, t.texts(written)), arrays)]
        return pa.RecordBatch.from_arrays([*columns, *lists], names=names)

    def run(batches):
        sides = load_sides(vocabulary, pattern, model)
        sizes = [np.array([len(x) for x in s.bytes], np.int64) for s in sides]
        most = max(map(len, sizes))
        written = [np.array([f"{i}{c}" for i in range(most)], object) for c in ",|;"]
        none = np.empty(0, np.int64)
        for batch in batches:
            ids, a, b, n = [], [], [], 0
            for rows in rows_of(batch):
                for key, text in rows:
                    x = y = none
                    if text:
                        x, y = (s.encode(text) for s in sides)
                        if x is None or y is None:
                            x = y = none
                        n += len(text)
                    ids.append(key)
                    a.append(x)
                    b.append(y)
                    if n >= BATCH_CHARS:
                        yield emit(ids, a, b, sides, sizes, written)
                        ids, a, b, n = [], [], [], 0
            if ids:
                yield emit(ids, a, b, sides, sizes, written)

    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, pairs array<bigint>, counts array<bigint>"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(released(run), schema)


def most_pairs(vocabulary: str, pattern: str, model: str) -> int:
    """Pairs of ids that can end together in any corpus: the bytes of one are the end of the other's.

    Each token has one suffix per length, so the number is bounded by the vocabularies, whatever the data.
    """
    a, b = (s.bytes for s in load_sides(vocabulary, pattern, model))
    n = 0
    for one, other in ((a, b), (b, a)):
        spelled: dict[bytes, int] = {}
        for t in other:
            if t:
                spelled[t] = spelled.get(t, 0) + 1
        n += sum(spelled.get(t[k:], 0) for t in one for k in range(len(t)))
    return n


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """Columns ``pair, n, best`` over the whole corpus: how many links hold the pair, and whether no pair of its B id has more."""
    n = aligned.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    n = n.withColumn("b", F.col("pair") % n_b)
    return n.join(n.groupBy("b").agg(F.max("n").alias("top")), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def with_pair_counts(aligned: DataFrame, table: DataFrame, bound: int) -> DataFrame:
    """``aligned`` with ``n_links``, ``n_best`` and ``count_sum`` from the corpus-wide table of pairs.

    The table holds at most ``bound`` rows of 17 bytes (:func:`most_pairs`), which the vocabularies
    alone fix; it travels to the documents, so no link is ever a shuffled row.
    """
    t = table.toArrow()
    if t.num_rows > bound:
        raise RuntimeError(f"{t.num_rows} pairs, more than the {bound} that the vocabularies allow")
    pair, n, best = t.column("pair").to_numpy(), t.column("n").to_numpy(), t.column("best").to_numpy(zero_copy_only=False)
    order = np.argsort(pair)
    sent = aligned.sparkSession.sparkContext.broadcast((pair[order], n[order], best[order].astype(np.int64)))
    columns = [c for c in aligned.columns if c not in ("pairs", "counts", "n_links", "n_best", "count_sum")]

    def run(batches):
        pair, n, best = sent.value
        for batch in batches:
            lists = [batch.column(batch.schema.get_field_index(c)) for c in ("pairs", "counts")]
            keys, times = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            size = np.array(lists[0].value_lengths().to_pylist(), np.int64)
            at = np.searchsorted(pair, keys)
            ends = np.r_[0, np.cumsum(size)]
            total = lambda x: (c := np.r_[0, np.cumsum(x)])[ends[1:]] - c[ends[:-1]]
            sums = [total(times), total(times * best[at]), total(times * n[at])] if len(pair) else [np.zeros(len(size), np.int64)] * 3
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in columns], *[pa.array(x, pa.int64()) for x in sums]], names=[*columns, "n_links", "n_best", "count_sum"])

    kinds = dict(aligned.dtypes)
    return aligned.mapInArrow(released(run), ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", n_links bigint, n_best bigint, count_sum bigint")


def alignment_digests(docs: DataFrame, vocabulary: str, pattern: str, model: str) -> DataFrame:
    """The alignments with corpus-wide link counts, ``groups`` as its digest (empty without tokens).

    The aligned rows are written once to the shared folder, with the digest in place of the
    groups; their pairs are counted there, and the counts meet the rows again without a shuffle.
    """
    spark = docs.sparkSession
    rows = align(docs, vocabulary, pattern, model)
    path = scratch_path(spark, "aligned")
    rows.select("doc_id", "n_a", "n_b", "n_groups", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"), "pairs", "counts").write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    n_b = len(load_sides(vocabulary, pattern, model)[1].bytes)
    return with_pair_counts(rows, pair_counts(rows, n_b), most_pairs(vocabulary, pattern, model))
