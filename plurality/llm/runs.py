"""Periodic runs of words: difference-cover extensions and a harmonic grid of anchors.

All documents of a batch form one sequence of word numbers with a unique mark after each,
so that no comparison crosses a document and the sorting is shared by many short texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import rows_of

#: modulus of the difference cover and its members: every distance modulo 7 is a difference of two of them
MODULUS, COVER = 7, (0, 1, 3)
#: a run holds at least so many words, and at least so many of its periods
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: words of a batch's documents up to which further documents join it; a longer one is a batch by itself
BATCH_WORDS = 100_000
#: anchors that are extended at a time
ANCHORS = 500_000


class Extensions:
    """Longest common extensions of a word sequence, to the right.

    Only suffixes at places whose residue lies in the cover are sorted: by their first seven
    words, then by doubling. Two places reach sampled places after the same few words, at most
    six, which are compared one by one; from there the common prefix is the least of the
    neighbouring ones between their ranks, read off a sparse table.
    """

    def __init__(self, words: np.ndarray):
        n, v, c = len(words), MODULUS, len(COVER)
        kinds = int(words.max()) + 1 if n else 1
        blocks = n // v + 3
        # beyond the end every place has a number of its own
        self.words = np.concatenate([words, kinds + np.arange(blocks * v - n, dtype=np.int64)])
        cover = np.array(COVER)
        self.slot = np.full(v, -1)
        self.slot[cover] = np.arange(c)
        self.wait = np.array([[next(d for d in range(v) if (i + d) % v in COVER and (j + d) % v in COVER) for j in range(v)] for i in range(v)])
        at = (np.arange(blocks - 1)[:, None] * v + cover).ravel()
        bits = int(self.words.max()).bit_length() or 1
        each = max(1, 63 // bits)
        keys = []
        for k in range(0, v, each):
            key = np.zeros(len(at), np.int64)
            for j in range(k, min(v, k + each)):
                key = (key << bits) | self.words[at + j]
            keys.append(key)
        rank, order = self._ranked(keys)
        self.levels, step = [rank], c
        while rank[order[-1]] + 1 < len(at):
            after = np.zeros(len(at), np.int64)
            after[: max(0, len(at) - step)] = rank[step:] + 1
            rank, order = self._ranked([rank * (len(at) + 1) + after])
            self.levels.append(rank)
            step *= 2
        self.rank = rank
        self.table = [self._neighbours(order)]
        while 1 << len(self.table) <= len(order):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))
        del self.levels

    @staticmethod
    def _ranked(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Dense ranks of the rows of key columns, the first column first, and the rows in order."""
        order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
        new = np.zeros(len(order), np.int64)
        for key in keys:
            s = key[order]
            new[1:] |= s[1:] != s[:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return rank, order

    def _neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common prefix, in words, of each sorted sampled suffix with the one before it; the rounds of doubling give it."""
        c, v, m = len(COVER), MODULUS, len(order)
        i, j, length = order[1:].copy(), order[:-1].copy(), np.zeros(m - 1, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank, step = self.levels[k], c << k
            ok = (np.maximum(i, j) < m) & (length >= 0)
            same = ok.copy()
            same[ok] = rank[i[ok]] == rank[j[ok]]
            i[same] += step
            j[same] += step
            length[same] += v << k
        cover = np.array(COVER)
        a, b = i // c * v + cover[i % c], j // c * v + cover[j % c]
        out = np.zeros(m, np.int32)
        out[1:] = length + self._few(a, b, np.full(m - 1, v))
        return out

    def _few(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words from ``a`` and ``b`` on, ``limit`` at most."""
        n, end = np.zeros(len(a), np.int64), len(self.words)
        live = np.flatnonzero(limit > 0)
        for k in range(MODULUS):
            x, y = a[live] + k, b[live] + k
            inside = np.maximum(x, y) < end
            same = np.zeros(len(live), bool)
            same[inside] = self.words[x[inside]] == self.words[y[inside]]
            live = live[same]
            n[live] += 1
            live = live[n[live] < limit[live]]
            if not len(live):
                break
        return n

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words in which the suffixes at the different places ``a`` and ``b`` agree."""
        wait = self.wait[a % MODULUS, b % MODULUS]
        n = self._few(a, b, wait)
        go = np.flatnonzero(n == wait)
        index = lambda x: x // MODULUS * len(COVER) + self.slot[x % MODULUS]
        r, s = self.rank[index(a[go] + wait[go])], self.rank[index(b[go] + wait[go])]
        low, high = np.minimum(r, s) + 1, np.maximum(r, s) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            here = level == k
            row = self.table[k]
            n[go[here]] += np.minimum(row[low[here]], row[high[here] - (1 << k)])
        return n


def anchors(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods to extend: for each period ``p`` every ``3 p``-th place of a document.

    Where words ``p`` apart agree along a run of four periods they do so at ``3 p`` places in
    a row, so one of them is an anchor. The number of anchors is ``n log n / 3`` for ``n`` words.
    """
    most = sizes // LEAST_PERIODS * (sizes >= LEAST_WORDS)
    doc = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    stride = (LEAST_PERIODS - 1) * period
    n = -(-(sizes[doc] - period) // stride)
    ends = np.cumsum(n)
    i = 0
    while i < len(doc):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + ANCHORS, "right")))
        k = n[i:j]
        p = np.repeat(period[i:j], k)
        step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        yield np.repeat(starts[doc[i:j]], k) + step * (LEAST_PERIODS - 1) * p, p
        i = j


def find_runs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs in documents that lie in ``words``, each followed by a unique mark."""
    found = []
    ahead = back = None
    for at, p in anchors(starts, sizes):
        hit = words[at] == words[at + p]
        at, p = at[hit], p[hit]
        if not len(at):
            continue
        if ahead is None:
            ahead, back = Extensions(words), Extensions(words[::-1].copy())
        right = ahead.of(at, at + p)
        n = len(words)
        left = np.zeros(len(at), np.int64)
        inner = at > 0
        left[inner] = back.of(n - at[inner], n - at[inner] - p[inner])
        size = left + p + right
        keep = size >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
        found.append(np.stack([(at - left)[keep], size[keep], p[keep]]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, size, p = np.concatenate(found, 1)
    # a stretch that also has a multiple of its period is found again, with the same ends
    order = np.lexsort((p, size, start))
    start, size, p = start[order], size[order], p[order]
    first = np.ones(len(p), bool)
    first[1:] = (start[1:] != start[:-1]) | (size[1:] != size[:-1])
    return start[first], size[first], p[first]


def batch_runs(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs ``(start, length, period)`` of each document's words, by start, then period."""
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(t) for t in texts], np.int64)
    words = np.empty(int(sizes.sum()) + len(texts), np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    for s, t in zip(starts.tolist(), texts):
        words[s : s + len(t)] = np.fromiter(map(number.__getitem__, t), np.int64, len(t))
    words[starts + sizes] = len(number) + np.arange(len(texts))
    start, size, period = find_runs(words, starts, sizes)
    doc = np.searchsorted(starts, start, "right") - 1
    order = np.lexsort((period, start))
    doc, start, size, period = doc[order], start[order], size[order], period[order]
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [(start[i:j] - s, size[i:j], period[i:j]) for i, j, s in zip(cuts[:-1], cuts[1:], starts)]


def collapsed(words: list[bytes], start: np.ndarray, size: np.ndarray, period: np.ndarray) -> bytes:
    """The words without those that lie in a run after its first period, joined by blanks."""
    if not len(start):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + size, -1)
    keep = np.flatnonzero(np.cumsum(change)[:-1] == 0)
    return b" ".join([words[i] for i in keep.tolist()])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Columns ``doc_id, n_words, runs, collapsed`` for every row of ``docs(doc_id, text)``.

    Words are runs of characters other than ASCII white space, compared byte by byte, not by
    hash. ``runs`` is an array of ``(start, length, period)`` by start, then period: stretches
    of at least six words and four smallest periods that no neighbouring word extends.
    ``collapsed`` is the text without the repetitions, words joined by one blank.

    A null or empty text has no words, no runs and an empty ``collapsed``; repeated rows
    repeat; other columns are not read. A narrow pass without a shuffle: short documents are
    searched together, up to ``BATCH_WORDS`` words, and a long one alone; nothing is kept
    between batches.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def emit(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = batch_runs(texts)
        ends = np.cumsum([0] + [len(s) for s, _, _ in found])
        flat = [np.concatenate([f[k] for f in found]) for k in range(3)]
        runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat], names=["start", "length", "period"]))
        kept = pa.array([collapsed(t, *f) for t, f in zip(texts, found)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), runs.cast(run_type), kept], names=names)

    def run(batches):
        for batch in batches:
            ids, texts, n = [], [], 0
            for rows in rows_of(batch):
                for key, text in rows:
                    ids.append(key)
                    texts.append((text or "").encode("utf-8", "surrogatepass").split())
                    n += len(texts[-1])
                    if n >= BATCH_WORDS:
                        yield emit(ids, texts)
                        ids, texts, n = [], [], 0
            if ids:
                yield emit(ids, texts)

    schema = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` in which a hash of the id turns the tail of one text in ten into repetitions.

    With ``h = crc32(doc_id in decimal)`` and ``g = h div 10``: where ``h % 10 = 0``, word ``i`` from
    ``a = g % n`` on becomes word ``a + (i - a) % p``, ``p = 1 + (n - a) div (3 + g % 8)``. A null id plants nothing.
    """
    n, a, p = F.col("__n"), F.col("__a"), F.col("__p")
    g = F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10")
    planted = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .withColumn("__w", F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 10 = 0"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
        .withColumn("__n", F.size("__w").cast("bigint"))
        .withColumn("__a", F.when(n > 0, g % n))
        .withColumn("__p", F.expr("1 + (__n - __a) div (3 + (crc32(cast(cast(doc_id as string) as binary)) div 10) % 8)"))
    )
    repeated = F.expr("array_join(transform(__w, (x, i) -> if(i < __a, x, element_at(__w, cast(1 + __a + pmod(i - __a, __p) as int)))), ' ')")
    return planted.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


def run_digests(rows: DataFrame) -> DataFrame:
    """Per document the number of runs, the one of greatest exact exponent, and digests of all runs and of the collapsed text."""
    # exact: fractions are compared crosswise; the array is in order of start and period, so the first of equals stays
    best = "aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), runs[0], (b, r) -> if(r.length * b.period > b.length * r.period, r, b))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    rows = rows.withColumn("__b", F.expr(f"if(size(runs) > 0, {best}, null)"))
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("__b.start").alias("start"), F.col("__b.length").alias("length"), F.col("__b.period").alias("period"),
        F.expr("(1000 * __b.length) div __b.period").alias("exponent_milli"), F.expr(f"sha2({lines}, 256)").alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
