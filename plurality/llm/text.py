"""Small helpers shared by the text operators: tables, words, hashes, memo tables and safe cuts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import wraps
from weakref import WeakSet

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: a blank after white space: here a blank may belong to the run before it, so it is no place to cut
_BLANK_RUNS = [c + " " for c in map(chr, range(0x3001)) if c.isspace()]
_SAFE_BLANK = re.compile(r"(?<=\S) ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Memo:
    """Values of a function by key, for as long as a task runs.

    Bounded in bytes: keys longer than ``longest`` are not kept, and of the others two
    generations of ``limit`` entries, some 250 bytes each; when the newer is full it becomes the
    older one, so that frequent keys stay. :func:`released` empties all tables when a task ends, so
    a worker that serves one stage after another does not add them up. ``many`` computes the values
    of a list of keys at once, where that is cheaper.
    """

    tables: WeakSet["Memo"] = WeakSet()

    def __init__(self, fn: Callable, limit: int = 200_000, longest: int = 64, many: Callable[[list], list] | None = None):
        self.fn, self.limit, self.longest, self.many, self.known, self.older = fn, limit, longest, many, {}, {}
        Memo.tables.add(self)

    def keep(self, key, value) -> None:
        if len(key) <= self.longest:
            if len(self.known) >= self.limit:
                self.known, self.older = {}, self.known
            self.known[key] = value

    def one(self, key):
        value = self.known.get(key)
        if value is None:
            value = self.older.get(key)
            if value is None:
                value = self.fn(key)
            self.keep(key, value)
        return value

    def all(self, keys: list) -> list:
        """Values of many keys; the known ones are looked up without leaving C."""
        out = list(map(self.known.get, keys))
        if None in out:
            if self.many:
                new = list(dict.fromkeys(k for k, v in zip(keys, out) if v is None and k not in self.older))
                found = dict(zip(new, self.many(new)))
                older = self.older
                for i, v in enumerate(out):
                    if v is None:
                        out[i] = found[keys[i]] if keys[i] in found else older[keys[i]]
                        self.keep(keys[i], out[i])
                return out
            one = self.one
            out = [one(k) if v is None else v for k, v in zip(keys, out)]
        return out

    def clear(self) -> None:
        self.known, self.older = {}, {}


def released(run: Callable) -> Callable:
    """A task's function over batches after which the worker's memo tables are empty, however the task ends."""

    @wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            for memo in Memo.tables:
                memo.clear()

    return task


def cut_at_blanks(text: str) -> list[str]:
    """Cut before every blank that follows a non-blank character; the blank itself is left out.

    A match of the pre-token pattern holds white space in front only, so each cut is also
    a boundary between matches: part 0, and each further part with one blank put back in
    front, are tokenized independently of each other.
    """
    if any(s in text for s in _BLANK_RUNS):
        return _SAFE_BLANK.split(text)
    return text.split(" ")


def plain_pieces(text: str) -> list[str] | None:
    """Pre-tokens of the commonest parts (a blank, ASCII letters, perhaps one sign), else None: spares the pattern."""
    if text.isascii() and (text[:1] == " " or text[:1].isalpha()):
        if text[1:].isalpha():
            return [text]
        if text[-1] in ",.;:!?" and text[1:-1].isalpha():
            return [text[:-1], text[-1]]
    return None


def rows_of(batch: pa.RecordBatch, step: int = 128) -> Iterator[list[tuple]]:
    """Rows of an Arrow batch as tuples, ``step`` at a time: only so many texts are Python objects at once."""
    for i in range(0, batch.num_rows, step):
        part = batch.slice(i, step)
        yield list(zip(*(part.column(j).to_pylist() for j in range(part.num_columns)), strict=True))


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def mix(a: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all windows of ``n`` words, given the words' hashes."""
    m = len(words) - n + 1
    out = words[:m].copy()
    for k in range(1, n):
        out = mix(out) * np.uint64(0x9E3779B97F4A7C15) + words[k : k + m]
    return mix(out)


#: one table of word hashes for all operators of a worker
_WORDS = Memo(word_hash, 300_000)


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.array(_WORDS.all(words), np.uint64)


#: words of more bytes are hashed one by one
_LONG_WORD = 64
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_bytes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces of ``data``, eight bytes of all pieces at a time."""
    import xxhash

    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    size = size.astype(np.uint64)
    out = mix((size + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    long = size > _LONG_WORD
    for i in np.flatnonzero(long).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[begin[i] : begin[i] + int(size[i])])
    left, done = np.flatnonzero(~long & (size > 0)), 0
    while len(left):
        part = eight[begin[left] + done] & _LOW_BYTES[np.minimum(size[left] - np.uint64(done), np.uint64(8))]
        out[left] = mix(out[left] ^ part) * np.uint64(0x9E3779B97F4A7C15)
        done += 8
        left = left[size[left] > done]
    return mix(out)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one text after the other, and where each text's words begin; the end comes last.

    Words are cut at ASCII blanks and only ASCII letters are lowered, as ``bytes.lower().split()`` does; null texts have none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, offsets = split.values, split.offsets.to_numpy()
    at = np.frombuffer(words.buffers()[1], np.int32 if words.type == pa.string() else np.int64, len(words) + 1, words.offset * (4 if words.type == pa.string() else 8)) if len(words) else np.zeros(1, np.int64)
    size = np.diff(at)
    kept = size > 0  # blanks at the ends of a text leave empty words
    data = np.frombuffer(words.buffers()[2], np.uint8) if kept.any() else np.empty(0, np.uint8)
    hashes = hash_bytes(data, at[:-1][kept].astype(np.int64), size[kept])
    return hashes, np.concatenate([[0], np.cumsum(kept)])[offsets]
