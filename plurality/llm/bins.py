"""Best-fit packing by bin completion: branch and bound over the counts of lengths, however many pieces there are."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_small, scratch_path
from .packing import load_ids
from .text import released, rows_of

#: fillings looked at around one largest piece, and nodes of the whole search; the best found so far stands when they are used up
FILLINGS, NODES = 400, 2000
#: fillings that a node branches on
BRANCHES = 3


def pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Columns ``doc_id, piece, start, length, ids, task, nth``: the tokens of all documents with their end token, whole or cut.

    Only documents of more than ``capacity`` tokens are cut, into pieces of that many, of which
    the first takes the remainder. ``ids`` are little-endian unsigned 32-bit integers; ``nth`` numbers
    the pieces of one length within a task. A null text is empty and has its end token only;
    repeated rows repeat; other columns are not read.
    """
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
    names = ["doc_id", "piece", "start", "length", "ids", "task", "nth"]

    def run(batches):
        from pyspark import TaskContext

        library, task, seen = load_ids(vocabulary, pattern), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for rows in rows_of(batch):
                out = []
                for key, text in rows:
                    ids = library.packed(text or "") + end
                    cuts = [0, *range((len(ids) // 4 - 1) % capacity + 1, len(ids) // 4 + 1, capacity)]
                    for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                        out.append((key, k, i, j - i, ids[4 * i : 4 * j], task, seen[j - i]))
                        seen[j - i] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    schema = "doc_id bigint, piece int, start bigint, length int, ids binary, task int, nth bigint"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(released(run), schema)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """Bins that no packing can do without: the best of the bounds that set lengths above ``capacity - k`` apart for each ``k``."""
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts.keys())] = list(counts.values())
    tokens = np.cumsum(n * np.arange(capacity + 1))
    number = np.cumsum(n)
    k = np.arange(1, capacity // 2 + 1)
    large, upto, half = number[-1] - number[capacity - k], number[capacity - k], number[capacity // 2]
    small = tokens[capacity - k] - tokens[k - 1] - (upto - half) * capacity
    bounds = large + upto - half + np.maximum(0, -(-small // capacity))
    return max(-(-int(tokens[-1]) // capacity), int(bounds.max(initial=0)))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: patterns and how often each is used."""
    left, out = Counter(counts), []
    # open bins by their room; equal ones are filled together
    free: dict[int, Counter] = {}
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            k = next((r for r in sorted(free) if r >= length), None)
            if k is None:
                each = capacity // length
                full, rest = divmod(n, each)
                for size, times in ((each, full), (rest, 1 if rest else 0)):
                    if times:
                        free.setdefault(capacity - size * length, Counter())[(length,) * size] += times
                break
            pattern, times = next(iter(free[k].items()))
            size = min(k // length, n)
            used = min(times, n // size)
            free[k][pattern] -= used
            if not free[k][pattern]:
                del free[k][pattern]
                if not free[k]:
                    del free[k]
            free.setdefault(k - size * length, Counter())[pattern + (length,) * size] += used
            n -= used * size
    for kinds in free.values():
        out += kinds.items()
    return out


def fillings(counts: dict[int, int], lengths: list[int], room: int, limit: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Undominated ways to fill ``room``, as (waste, lengths), large pieces first.

    A filling is dominated where a waiting piece still fits its waste, or would fit in place of a
    smaller one of its own: the other filling leaves the smaller piece for later.
    """
    looked = 0

    def undominated(chosen: list[int], waste: int) -> bool:
        used = Counter(chosen)
        for x in [*used, 0]:
            at = bisect_right(lengths, x + waste) - 1
            # the longest piece that could stand in x's place and is not all in use
            while at >= 0 and lengths[at] > x:
                if counts[lengths[at]] > used[lengths[at]]:
                    return False
                at -= 1
        return True

    def extend(at: int, waste: int, chosen: list[int], used: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        """``at`` is the last place in ``lengths`` that may be used, ``used`` how many of it are."""
        nonlocal looked
        fits = min(at, bisect_right(lengths, waste) - 1)
        if fits < 0:
            looked += 1
            if undominated(chosen, waste):
                yield waste, tuple(chosen)
            return
        any_left = False
        for k in range(fits, -1, -1):
            taken = used if k == at else 0
            if counts[lengths[k]] <= taken:
                continue
            any_left = True
            chosen.append(lengths[k])
            yield from extend(k, waste - lengths[k], chosen, taken + 1)
            chosen.pop()
            if looked >= limit:
                return
        if not any_left:
            looked += 1
            if undominated(chosen, waste):
                yield waste, tuple(chosen)

    yield from extend(len(lengths) - 1, room, [], 0)


class Completion:
    """Depth-first bin completion over counts of lengths; a filling is used as often as the counts allow."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.nodes = capacity, 0
        self.counts = {k: n for k, n in counts.items() if n}
        self.least = least_bins(self.counts, capacity)
        self.best = best_fit(self.counts, capacity)
        self.bins = sum(n for _, n in self.best)
        self.tokens = sum(k * n for k, n in self.counts.items())

    def search(self) -> list[tuple[tuple[int, ...], int]]:
        """The first path is laid down to its end, by least waste at every bin; the bounds cut what cannot be better."""
        self.descend(dict(self.counts), sorted(self.counts), [], 0, 0)
        return self.best

    def keep(self, path: list, rest: list) -> None:
        bins = sum(n for _, n in path) + sum(n for _, n in rest)
        if bins < self.bins:
            self.bins, self.best = bins, [*path, *rest]

    def descend(self, counts: dict[int, int], lengths: list[int], path: list, bins: int, waste: int) -> None:
        stack = [(counts, lengths, path, bins, waste)]
        while stack and self.bins > self.least and self.nodes < NODES:
            counts, lengths, path, bins, waste = stack.pop()
            if not lengths:
                self.keep(path, [])
                continue
            if waste > (self.bins - 1) * self.capacity - self.tokens or bins + least_bins(counts, self.capacity) >= self.bins:
                continue
            self.nodes += 1
            if self.nodes % 16 == 1:
                self.keep(path, best_fit(counts, self.capacity))
            largest = lengths[-1]
            counts[largest] -= 1
            found: dict[tuple[int, ...], int] = {}
            for w, f in fillings(counts, lengths, self.capacity - largest, FILLINGS):
                found[f] = w
                if not w:
                    break
            counts[largest] += 1
            for f, w in reversed(sorted(found.items(), key=lambda x: (x[1], len(x[0])))[:BRANCHES]):
                pattern = (largest, *f)
                need = Counter(pattern)
                times = min(counts[x] // n for x, n in need.items())
                after = dict(counts)
                for x, n in need.items():
                    after[x] -= n * times
                stack.append((after, [x for x in lengths if after[x]], [*path, (pattern, times)], bins + times, waste + w * times))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each, together holding every piece once."""
    return Completion(counts, capacity).search()


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, which of its pieces, by number, go where: rows by (length, first number), each for one pattern."""
    rows, taken, sequence = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for length, n in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, taken[length], n, sequence, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    rows.sort()
    return {k: np.array(c, np.int64) for k, c in zip(("length", "first", "each", "sequence", "offset"), zip(*rows))} if rows else {}


def pack(rows: DataFrame, capacity: int = 1024) -> DataFrame:
    """``rows``, a written table as :func:`pieces` gives it, with ``sequence_id`` and ``offset`` in place of ``task`` and ``nth``.

    Planning needs no more than the number of pieces of each length, at most ``capacity``
    numbers; the plan has a few patterns per length, whatever the number of pieces. Each piece
    finds its place by its number among those of its length: its number within its task, and
    what the tasks before hold. Pieces meet only the latter, one row per task and length.
    """
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c not in ("task", "nth", "sequence_id", "offset")]
    per_task = rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = per_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    rows = join_small(rows, before.select("length", "task", F.coalesce("before", F.lit(0)).alias("before")), ["length", "task"])

    def run(batches):
        s = sent.value
        key = s["length"] << 48 | s["first"] if s else None
        for batch in batches:
            length, nth, before = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "nth", "before"))
            number = nth + before
            at = np.searchsorted(key, length << 48 | number, "right") - 1
            copy, place = np.divmod(number - s["first"][at], s["each"][at])
            places = [pa.array(s["sequence"][at] + copy), pa.array(s["offset"][at] + place * length)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in columns], *places], names=[*columns, "sequence_id", "offset"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(released(run), ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id bigint, `offset` bigint")


def packed_digests(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The packed pieces with the unsigned CRC-32 of their ids in place of the ids, so that the written table stays small."""
    path = scratch_path(docs.sparkSession, "pieces")
    pieces(docs, vocabulary, pattern, capacity, end_id).selectExpr("doc_id", "piece", "start", "length", "crc32(ids) ids_crc32", "task", "nth").write.parquet(path)
    out = pack(docs.sparkSession.read.parquet(path), capacity)
    return out.selectExpr("doc_id", "piece", "start", "cast(length as bigint) length", "ids_crc32", "sequence_id", "`offset`")
