"""Running counts over the scores of every class, in order, from cells of packed scores.

A row with k class scores is k scores to order, which makes the ordered table many times larger than the
input. So scores are not shuffled as rows. A task sorts those it holds per key and class, counts equal ones and
cuts them at the edges of cells; a cell's part is one row whose bytes are the differences between neighbours (of sorted
doubles the low five or six bytes). The parts of a cell meet in one place and are merged there.

Three passes over the rows, which must give the same rows each time: the edges come from a sample (they
only balance the cells), the counts per cell give every cell its offset, and the packed parts are
shuffled once. Nothing else is written, whatever the number of scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, join_small
from .ranking import ordered_prefix

#: scores a cell is meant to hold, cells a key and class may have, scores a task holds before it packs them
CELL_SCORES, MOST_CELLS, HELD_SCORES = 250_000, 1024, 4_000_000
#: one of so many units is in the sample
SAMPLE = 64
_TOP = np.uint64(1 << 63)


def to_keys(column: pa.Array) -> np.ndarray:
    """Scores as unsigned numbers of the same order: null, then -inf to inf, then NaN; both zeros are one value."""
    x = column.cast(pa.float64())
    null = x.is_null().to_numpy(zero_copy_only=False)
    x = x.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
    bits = np.where(np.isnan(x), np.nan, x).view(np.uint64)
    keys = np.where(bits & _TOP, ~bits, bits | _TOP)
    keys[null] = 0
    return keys


def to_scores(keys: np.ndarray) -> pa.Array:
    bits = np.where(keys & _TOP, keys ^ _TOP, ~keys)
    return pa.array(bits.view(np.float64), mask=keys == 0)


def pack(keys: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[int, bytes, bytes, bytes | None]:
    """(first key, differences byte by byte, positives, counts): counts are left out, and positives are bits, where no key repeats."""
    step = np.diff(keys)
    width = (int(step.max()).bit_length() + 7) // 8 if len(step) else 0
    planes = step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    if len(n) == n.sum():
        return int(keys[:1].view(np.int64)[0]), planes, np.packbits(pos.astype(bool)).tobytes(), None
    return int(keys[:1].view(np.int64)[0]), planes, pos.astype("<i8").tobytes(), n.astype("<i8").tobytes()


def unpack(size: int, first: int, planes: bytes, pos: bytes, n: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step = np.zeros((size - 1, 8), np.uint8)
    if size > 1 and planes:
        width = len(planes) // (size - 1)
        step[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, size - 1).T
    keys = np.cumsum(np.concatenate([np.array([first], np.int64).view(np.uint64), step.reshape(-1).view("<u8")]), dtype=np.uint64)
    if n is None:
        return keys, np.ones(size, np.int64), np.unpackbits(np.frombuffer(pos, np.uint8), count=size).astype(np.int64)
    return keys, np.frombuffer(n, "<i8"), np.frombuffer(pos, "<i8")


def counted(keys: np.ndarray, n: np.ndarray | None, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order with their counts."""
    order = np.argsort(keys)
    keys, pos = keys[order], pos[order]
    new = np.append(True, keys[1:] != keys[:-1])
    if new.all():
        return keys, np.ones(len(keys), np.int64) if n is None else n[order], pos.astype(np.int64)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n[order], first)
    return keys[first], n, np.add.reduceat(pos.astype(np.int64), first)


def _groups(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(values of the keys, rows that have them)"""
    if not batch.num_rows:
        return
    code, values = np.zeros(batch.num_rows, np.int64), []
    for i in range(n_keys):
        c = batch.column(i).dictionary_encode("encode")
        values.append(c.dictionary.to_pylist())
        code = code * len(values[-1]) + c.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        at, key = int(code[rows[0]]), []
        for v in reversed(values):
            at, i = divmod(at, len(v))
            key.append(v[i])
        yield tuple(reversed(key)), rows


def _parts(rows: DataFrame, by: Sequence[str], k: int, edges: dict, packed: bool) -> DataFrame:
    """Per task, key, class and cell: (by, class, cell, n, pos) and, ``packed``, (size, first, planes, p, c)."""
    kinds = dict(rows.dtypes)
    n_by, held = len(by), HELD_SCORES
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["class bigint, cell bigint, n bigint, pos bigint"] + ["size bigint, first bigint, planes binary, p binary, c binary"] * packed)
    names = [*by, "class", "cell", "n", "pos", *(["size", "first", "planes", "p", "c"] if packed else [])]
    none = np.empty(0, np.uint64)

    def told(kept: dict, types: list) -> Iterator[pa.RecordBatch]:
        for key, parts in kept.items():
            y = np.concatenate([p[0] for p in parts])
            out = []
            for j in range(k):
                keys, n, pos = counted(np.concatenate([p[1][j] for p in parts]), None, y == j)
                ends = [*np.searchsorted(keys, edges.get((*key, j), none), "right").tolist(), len(keys)]
                begin = 0
                for cell, end in enumerate(ends):
                    if end > begin:
                        s = slice(begin, end)
                        row = (*key, j, cell, int(n[s].sum()), int(pos[s].sum()))
                        out.append((*row, end - begin, *pack(keys[s], n[s], pos[s])) if packed else row)
                    begin = max(begin, end)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, total, types = {}, 0, None
        for batch in batches:
            types = [*[f.type for f in batch.schema][:n_by], *[pa.int64()] * 4, *([pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()] if packed else [])]
            y = batch.column(n_by).to_numpy(zero_copy_only=False)
            keys = np.stack([to_keys(batch.column(n_by + 1 + j)) for j in range(k)])
            for key, at in _groups(batch, n_by):
                kept.setdefault(key, []).append((y[at].astype(np.int16), keys[:, at]))
            total += keys.size
            if total >= held:
                yield from told(kept, types)
                kept, total = {}, 0
        if kept:
            yield from told(kept, types)

    return rows.mapInArrow(run, schema)


def _edges(rows: DataFrame, by: Sequence[str], k: int, unit: str) -> dict:
    """(key, class) -> edges between its cells, from quantiles of a sample of the units; a key without sampled rows has one cell."""
    some = rows.where(F.pmod(F.xxhash64(unit), F.lit(SAMPLE)) == 0)
    long = some.select(*by, F.posexplode(F.array(*[F.col(f"c{j}") for j in range(k)])).alias("class", "score"))
    steps = F.array(*[F.lit(i / MOST_CELLS) for i in range(1, MOST_CELLS)])
    per = long.groupBy(*by, "class").agg(F.count("score").alias("n"), F.percentile_approx("score", steps, 10 * MOST_CELLS).alias("q"))
    out = {}
    for r in per.where(F.col("n") * SAMPLE > CELL_SCORES).collect():
        cells = min(MOST_CELLS, -(-r["n"] * SAMPLE // CELL_SCORES))
        at = sorted({i * MOST_CELLS // cells - 1 for i in range(1, cells)})
        out[(*[r[c] for c in by], r["class"])] = np.unique(to_keys(pa.array([r["q"][i] for i in at], pa.float64())))
    return out


def running_counts(df: DataFrame, by: Sequence[str], unit: str, k: int = 6) -> DataFrame:
    """Per distinct score of each class, in descending order, running counts over the rows with a unique majority.

    (by, class, score, n_at, pos_at, cum_n, cum_pos, all_n, all_pos): rows and positive rows at the score, up to it and
    in all. ``df`` has ``y`` and the scores ``c0..``; it is read three times. ``unit`` names the column by which the
    sample is drawn, best one that a scan can filter.
    """
    by = list(by)
    rows = df.where(F.col("y") >= 0).select(*by, F.col("y").cast("smallint").alias("y"), *[F.col(f"c{j}").cast("double").alias(f"c{j}") for j in range(k)], unit)
    edges = _edges(rows, by, k, unit)
    rows = rows.drop(unit) if unit not in by else rows
    keys = [*by, "class", "cell"]
    per = _parts(rows, by, k, edges, False).groupBy(*keys).agg(F.sum("n").alias("cell_n"), F.sum("pos").alias("cell_pos"))
    whole = Window.partitionBy(*by, "class")  # a row per cell
    above = whole.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "cell_n", "cell_pos", *[F.coalesce(F.sum(f"cell_{m}").over(above), F.lit(0)).alias(f"off_{m}") for m in ("n", "pos")],
                     *[F.sum(f"cell_{m}").over(whole).alias(f"all_{m}") for m in ("n", "pos")])
    parts = join_small(_parts(rows, by, k, edges, True), per, keys)
    names = [*by, "class", "score", "n_at", "pos_at", "cum_n", "cum_pos", "all_n", "all_pos"]
    schema = T.StructType([*[parts.schema[c] for c in [*by, "class"]], T.StructField("score", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in names[-6:]]])

    def merge(cell: pa.Table) -> pa.Table:
        parts = [unpack(*r) for r in zip(*(cell.column(c).to_pylist() for c in ("size", "first", "planes", "p", "c")))]
        x, n, pos = counted(*(np.concatenate(c) for c in zip(*parts)))
        x, n, pos = x[::-1], n[::-1], pos[::-1]
        one = {c: cell.column(c)[0] for c in (*by, "class", "cell_n", "cell_pos", "off_n", "off_pos", "all_n", "all_pos")}
        if (n.sum(), pos.sum()) != (one["cell_n"].as_py(), one["cell_pos"].as_py()):
            raise ValueError("the rows to order differ between two passes")
        same = lambda c: pa.repeat(one[c], len(x))
        return pa.table([*[same(c) for c in (*by, "class")], to_scores(x), n, pos, one["off_n"].as_py() + np.cumsum(n), one["off_pos"].as_py() + np.cumsum(pos),
                         same("all_n"), same("all_pos")], names=names)

    return parts.groupBy(*keys).applyInArrow(merge, schema)


def cut_rows(df: DataFrame, by: Sequence[str], score: str, risk: str, key: str, unit: str, cut: Callable[[Column, Column, Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Order only the cells that a cut goes through: (whole cells, ranked rows of the others).

    Cells of equal shares of a sample are counted first: (by, n, s, top, before, n_total), rows, sum of ``risk``, greatest
    score and rows of lower cells. ``cut(first, last, n_total)`` tells from the ranks of a cell's ends whether its rows must be told apart; these
    come back as (by, score, risk, rank, n_total), in the order of (score, key) over all rows. ``df`` is read three times.
    """
    by = list(by)
    kinds = dict(df.dtypes)
    rows = df.select(*by, F.col(score).cast("double").alias("__v"), F.col(risk).cast("double").alias("__r"), F.col(key).alias("__k"), F.col(unit).alias("__u"))
    rows = rows.dropna(subset=by) if by else rows
    steps = F.array(*[F.lit(i / MOST_CELLS) for i in range(1, MOST_CELLS)])
    sample = rows.where(F.pmod(F.xxhash64("__u"), F.lit(SAMPLE)) == 0).groupBy(*by).agg(F.percentile_approx("__v", steps, 10 * MOST_CELLS).alias("q"))
    edges = {tuple(r[c] for c in by): np.unique(to_keys(pa.array(r["q"], pa.float64()))) for r in sample.collect() if r["q"]}
    n_by, none = len(by), np.empty(0, np.uint64)
    fields = "".join(f"`{c}` {kinds[c]}, " for c in by)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list[np.ndarray]] = {}  # per key and cell: rows, risk, rows with a risk, greatest score as a key
        for batch in batches:
            types = [*[f.type for f in batch.schema][:n_by], pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            v, r = to_keys(batch.column(n_by)), batch.column(n_by + 1)
            known, r = r.is_valid().to_numpy(zero_copy_only=False), r.fill_null(0.0).to_numpy(zero_copy_only=False)
            for key, at in _groups(batch, n_by):
                e = edges.get(key, none)
                if key not in kept:
                    kept[key] = [np.zeros(len(e) + 1, np.int64), np.zeros(len(e) + 1), np.zeros(len(e) + 1, np.int64), np.zeros(len(e) + 1, np.uint64)]
                n, s, have, top = kept[key]
                cell = np.searchsorted(e, v[at], "left")
                n += np.bincount(cell, minlength=len(n))
                s += np.bincount(cell, r[at], len(n))
                have += np.bincount(cell, known[at], len(n)).astype(np.int64)
                np.maximum.at(top, cell, v[at])
        for key, (n, s, have, top) in kept.items():
            some = np.flatnonzero(n)
            columns = [*[pa.array([x] * len(some), t) for x, t in zip(key, types)], pa.array(some), pa.array(n[some]), pa.array(s[some], mask=have[some] == 0), to_scores(top[some])]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, "cell", "n", "s", "top"])

    per = rows.drop("__k", "__u").mapInArrow(sums, fields + "cell bigint, n bigint, s double, top double")
    per = per.groupBy(*by, "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("top").alias("top"))
    whole = Window.partitionBy(*by)  # a row per cell
    per = per.withColumns({"before": F.coalesce(F.sum("n").over(whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n_total": F.sum("n").over(whole)})
    per = cut_lineage(per.withColumn("__cut", cut(F.col("before") + 1, F.col("before") + F.col("n"), F.col("n_total"))))
    wanted: dict = {}
    for r in per.where("__cut").select(*by, "cell").collect():  # a few per cut and key
        wanted.setdefault(tuple(r[c] for c in by), set()).add(r["cell"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, cells, keep = to_keys(batch.column(n_by)), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for key, at in _groups(batch, n_by):
                if key in wanted:
                    e = edges.get(key, none)
                    cells[at] = np.searchsorted(e, v[at], "left")
                    keep[at] = wanted[key][cells[at]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"]).filter(pa.array(keep))

    wanted = {k: np.isin(np.arange(len(edges.get(k, none)) + 1), list(x)) for k, x in wanted.items()}
    inner = cut_lineage(rows.drop("__u").mapInArrow(told, fields + f"__v double, __r double, __k {kinds[key]}, cell bigint"))  # few rows, read again for their range
    ranked = ordered_prefix(inner, [*by, "cell"], ["__v", "__k"]).drop("n_total").withColumnRenamed("rank", "__rank")
    ranked = join_small(ranked, per.where("__cut").select(*by, "cell", "before", "n_total"), [*by, "cell"])
    return per.where("not __cut").drop("__cut", "cell"), ranked.select(*by, F.col("__v").alias(score), F.col("__r").alias(risk), (F.col("before") + F.col("__rank")).alias("rank"), "n_total")
