"""Quality classifier: interpolated modified Kneser-Ney trigrams from trusted text, thresholds by language and length."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from ..session import SMALL_ROWS, cut_lineage
from .backoff import _numbers, _planes
from .text import hash_words, mix, released, word_hash

#: share of the trusted documents that is trained on; the others set the thresholds
TRAIN_SHARE = 0.6
#: bytes of text in a block of documents, whose n-grams ask the model's shards together
BLOCK_BYTES = 8_000_000
#: n-grams of the model in a shard, and characters of the documents that ask it; about how many characters have a new n-gram
SHARD_GRAMS, SHARD_CHARS, CHARS_PER_WORD = 1_000_000, 32_000_000, 6
#: words that travel as numbers; others travel as hashes
WORDS = 1 << 21
#: distinct words of a block up to which three of them fit in one number
WIDEST = 1 << 21
#: the quantile of trusted text that is the threshold
QUANTILE = 0.99
#: trusted rows that a threshold rests on at least, and the rank accuracy of its quantile
LEAST_ROWS, ACCURACY = 30, 10_000
#: the greatest length bin
LONGEST = 40
#: a mark that stands before a word where a bigram's first word would be: words and bigrams share one table
_ALONE = np.uint64(0x5851F42D4C957F2D)


def _language(lang: str | None) -> np.uint64:
    return mix(np.array([word_hash((lang or "").encode())], np.uint64))[0]


def _sequence(lang: str, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the documents of one language, two start marks before each; the document of every place; which places are words.

    The language is part of every hash, so each language has a model of its own.
    """
    parts, sizes = [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        parts += [np.zeros(2, np.uint64), hash_words(words)]
        sizes.append(len(words) + 2)
    seq = np.concatenate(parts) ^ _language(lang) if parts else np.empty(0, np.uint64)
    return seq, *_places(np.array(sizes, np.int64))


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document of every place of a sequence, and which places are words."""
    real = np.ones(int(sizes.sum()), bool)
    starts = np.cumsum(sizes) - sizes
    real[starts] = real[starts + 1] = False
    return np.repeat(np.arange(len(sizes)), sizes), real


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, byte by byte and compressed: upper bytes are mostly zeros."""
    body = b"".join(len(c).to_bytes(8, "little") + _planes(np.asarray(c).astype(np.uint64)) for c in columns)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    body, at, out = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), 0, []
    while at < len(body):
        x, at = _numbers(body, int.from_bytes(body[at : at + 8], "little"), at + 8)
        out.append(x)
    return out


def _steps(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Differences of numbers that rise until ``new``, where they start again."""
    return np.where(new, x, x - np.concatenate([x[:1], x[:-1]]))


def _sums(d: np.ndarray, new: np.ndarray) -> np.ndarray:
    total = np.cumsum(d)
    at = np.flatnonzero(new)
    return total - np.repeat(total[at] - d[at], np.diff(at, append=len(d)))


class Coder:
    """Numbers for word hashes: the trained words by falling count, so that frequent ones are short.

    It is a means of writing less, not part of the model: words beyond the list are written as hashes. Only where
    the list holds every trained word (``whole``) are others known to be new and need no asking.
    """

    def __init__(self, words: np.ndarray, whole: bool):
        self.words, self.whole = words, whole

    @cached_property
    def by_hash(self) -> tuple[np.ndarray, np.ndarray]:
        rank = np.argsort(self.words)
        return self.words[rank], rank

    def numbers(self, hashes: np.ndarray, start: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """A number for each hash (-1 for words that are known to be new) and the hashes of the numbers beyond the list."""
        distinct, which = np.unique(np.concatenate([hashes, [start, _ALONE]]), return_inverse=True)
        out = np.full(len(distinct), -1, np.int64)
        if len(self.words):
            known, rank = self.by_hash
            place = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
            hit = known[place] == distinct
            out[hit] = rank[place[hit]]
        beyond = np.flatnonzero((out < 0) & ((distinct == start) | (distinct == _ALONE) | (not self.whole)))
        out[beyond] = len(self.words) + np.arange(len(beyond))
        return out[which[: len(hashes)]], distinct[beyond]

    def hashes(self, numbers: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        out, listed = np.empty(len(numbers), np.uint64), numbers < len(self.words)
        out[listed] = self.words[numbers[listed]]
        out[~listed] = beyond[numbers[~listed] - len(self.words)]
        return out


@dataclass
class Grams:
    """Distinct bigrams by number (``a, b`` ascending) and the ``n`` words ``c`` that are asked for or known after each, with a column per count.

    A word by itself is a bigram after the mark ``_ALONE``. Columns of a bigram are its count as an n-gram and,
    as a context, its total and how many words follow it once, twice and more often.
    """

    a: np.ndarray
    b: np.ndarray
    n: np.ndarray
    c: np.ndarray
    beyond: np.ndarray
    two: list[np.ndarray]
    three: list[np.ndarray]

    @staticmethod
    def of(pairs: np.ndarray, width: int, triples: np.ndarray, beyond: np.ndarray, two: list, three: list) -> "Grams":
        """From sorted keys: a * width + b, and number of the bigram * width + c."""
        return Grams(pairs // width, pairs % width, np.bincount(triples // width, minlength=len(pairs)), triples % width, beyond, two, three)

    def shards(self, coder: Coder, bits: int) -> np.ndarray:
        """The shard of each bigram, by its hash."""
        return _shard(coder.hashes(self.a, self.beyond), coder.hashes(self.b, self.beyond), bits)

    def sent(self, coder: Coder, bits: int) -> list[tuple[int, bytes]]:
        """What goes to each shard."""
        shard = self.shards(coder, bits)
        of_c = np.repeat(shard, self.n)
        return [(int(s), self._written(coder, shard == s, of_c == s)) for s in np.unique(shard)]

    def _written(self, coder: Coder, i: np.ndarray, j: np.ndarray) -> bytes:
        a, b, n, c = self.a[i], self.b[i], self.n[i], self.c[j]
        used = np.unique(np.concatenate([x[x >= len(coder.words)] for x in (a, b, c)]))
        own = lambda x: np.where(x >= len(coder.words), len(coder.words) + np.searchsorted(used, x), x)
        a, b, c = own(a), own(b), own(c)
        new = np.diff(a, prepend=-1) > 0
        first = np.zeros(len(c), bool)
        first[(np.cumsum(n) - n)[n > 0]] = True
        return _pack(_steps(a, np.arange(len(a)) == 0), _steps(b, new), n, _steps(c, first), self.beyond[used - len(coder.words)], *[x[i] for x in self.two], *[x[j] for x in self.three])

    @staticmethod
    def read(data: bytes, two: int) -> "Grams":
        """What was sent, with ``two`` columns of bigrams."""
        a, b, n, c, beyond, *columns = _unpack(data)
        a, n = np.cumsum(a).astype(np.int64), n.astype(np.int64)
        first = np.zeros(len(c), bool)
        first[(np.cumsum(n) - n)[n > 0]] = True
        b, c = _sums(b.astype(np.int64), np.diff(a, prepend=-1) > 0), _sums(c.astype(np.int64), first)
        columns = [x.astype(np.int64) for x in columns]
        return Grams(a, b, n, c, beyond, columns[:two], columns[two:])

    def hashes(self, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the bigrams and of the trigrams."""
        a, b = coder.hashes(self.a, self.beyond), coder.hashes(self.b, self.beyond)
        return _key(a, b), _key(np.repeat(a, self.n), np.repeat(b, self.n), coder.hashes(self.c, self.beyond))

    @staticmethod
    def merged(rows: list[bytes], coder: Coder, start: np.uint64) -> "Grams":
        """The sum of what was sent with counts."""
        parts, listed = [Grams.read(data, 5) for data in rows], len(coder.words)
        beyond = np.unique(np.concatenate([[start, _ALONE], *[g.beyond for g in parts]]))

        def numbers(x: np.ndarray, g: Grams) -> np.ndarray:
            own = np.searchsorted(beyond, g.beyond)
            at = np.flatnonzero(x >= listed)
            x[at] = listed + own[x[at] - listed]
            return x

        width = listed + len(beyond)
        pairs, of = np.unique(np.concatenate([numbers(g.a, g) * width + numbers(g.b, g) for g in parts]), return_inverse=True)
        triples = np.repeat(of, np.concatenate([g.n for g in parts])) * width + np.concatenate([numbers(g.c, g) for g in parts])
        triples, at = np.unique(triples, return_inverse=True)
        total = lambda x, where, k: np.bincount(where, np.concatenate(x), k).astype(np.int64)  # noqa: E731  sums of whole numbers below 2^53
        two = [total([g.two[k] for g in parts], of, len(pairs)) for k in range(5)]
        return Grams.of(pairs, width, triples, beyond, two, [total([g.three[0] for g in parts], at, len(triples))])


def _key(*words: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams, a column per word."""
    out = words[0]
    for w in words[1:]:
        out = mix(out) * np.uint64(0x9E3779B97F4A7C15) + w
    return mix(out)


def _shard(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return (_key(a, b) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(a), np.int64)


def _context(count: np.ndarray) -> list[np.ndarray]:
    """What one follower of that count adds to its context: total, once, twice, more often."""
    return [count, count == 1, count == 2, count > 2]


def _pairs_only(a: np.ndarray, b: np.ndarray, width: int, beyond: np.ndarray, columns: list[np.ndarray]) -> Grams:
    """Bigrams with summed columns and nothing after them."""
    pairs, of = np.unique(a * width + b, return_inverse=True)
    none = np.empty(0, np.int64)
    return Grams.of(pairs, width, none, beyond, [np.bincount(of, x, len(pairs)).astype(np.int64) for x in columns], [none])


def _kinds(count: np.ndarray) -> list[int]:
    """How many n-grams occur once to four times, more than twice, at all, and their total: what discounts and the lowest order need."""
    return [*(int((count == k).sum()) for k in (1, 2, 3, 4)), int((count > 2).sum()), int((count > 0).sum()), int(count.sum())]


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, ...]:
    """Modified discounts d1, d2, d3 of an order, with plain ones where counts are too few for the formula."""
    n, out = (n1, n2, n3, n4), []
    for k in (1, 2, 3):
        x = k - (k + 1) * n1 / (n1 + 2 * n2) * n[k] / n[k - 1] if n[k - 1] and n[k] and n1 + n2 else 0
        out.append(x if 0 < x < k else 0.5 * k)
    return tuple(out)


@dataclass
class Language:
    """Discounts of the three orders, and the lowest order's total, back-off weight and share of a new word."""

    discounts: list[tuple[float, ...]]
    total: float
    new: float

    @staticmethod
    def of(kinds: dict[int, list[int]]) -> "Language":
        d = [_discounts(*kinds[order][:4]) for order in (1, 2, 3)]
        n1, n2, _, _, more, words, total = kinds[1]
        return Language(d, total, (d[0][0] * n1 + d[0][1] * n2 + d[0][2] * more) / total / (words + 1))


def _interpolated(count: np.ndarray, context: list[np.ndarray], lower: np.ndarray, d: tuple[float, ...]) -> np.ndarray:
    """Probability under one order from that of the order below, which it is where the context is unknown."""
    total, once, twice, more = context
    kept = np.where(count > 0, count - np.array([0, *d])[np.minimum(count, 3)], 0)
    return np.where(total > 0, (kept + (d[0] * once + d[1] * twice + d[2] * more) * lower) / np.maximum(total, 1), lower)


class Block:
    """Documents of one language by the numbers of their words, and the n-grams that they ask for.

    A question is a key of three places in the sorted list of the block's words: the two words before a word and the
    word, or none as the third. Every document asks for its last two words too and the block for every word by itself
    (after a mark), so a place's bigram is the context of the place after it.
    """

    def __init__(self, numbers: np.ndarray, beyond: np.ndarray, sizes: np.ndarray, coder: Coder):
        self.numbers, self.beyond, self.sizes, self.coder = numbers, beyond, sizes, coder
        self.doc, self.real = _places(sizes)
        self.alone = len(coder.words) + int(np.flatnonzero(beyond == _ALONE)[0])
        there = np.zeros(len(coder.words) + len(beyond), bool)
        there[numbers[numbers >= 0]] = there[self.alone] = True
        there = np.concatenate([there, [False]])  # for -1
        self.listed = np.flatnonzero(there)
        self.width = len(self.listed) + 1
        self.local = np.where(there, np.cumsum(there), 0)[numbers]  # from 1, 0 for new words
        self.mark = int(np.searchsorted(self.listed, self.alone)) + 1
        self.single = np.delete(np.arange(1, self.width), self.mark - 1)

    @staticmethod
    def of(lang: str, texts: list[str | None], coder: Coder) -> "Block":
        seq, doc, _ = _sequence(lang, texts)
        return Block(*coder.numbers(seq, _language(lang)), np.bincount(doc, minlength=len(texts)), coder)

    @cached_property
    def contexts(self) -> list[np.ndarray]:
        """Two words before each word, the last two of each document, and the mark and each single word; 0 for those with a new word."""
        x, at, ends = np.concatenate([self.local, [0, 0]]), np.flatnonzero(self.real), np.cumsum(self.sizes)
        before = lambda i: np.where((x[i - 2] > 0) & (x[i - 1] > 0), x[i - 2] * self.width + x[i - 1], 0)
        return [before(at), before(ends), self.mark * self.width + self.single]

    @cached_property
    def dense(self) -> np.ndarray | None:
        """The distinct contexts, where three words do not fit in 63 bits."""
        return np.unique(np.concatenate([[0], *self.contexts])) if self.width >= WIDEST else None

    def keys(self) -> list[np.ndarray]:
        """Questions of the words' places, of the documents' ends and of the single words, below ``width`` where the context has a new word."""
        words, *others = self.contexts if self.dense is None else [np.searchsorted(self.dense, x) for x in self.contexts]
        return [words * self.width + self.local[self.real], *[x * self.width for x in others]]

    def grams(self, keys: np.ndarray, two: list, three: list) -> Grams:
        """Distinct keys in order as they are sent."""
        context, c = keys // self.width, keys % self.width
        first = np.diff(context, prepend=-1) > 0
        pairs = context[first] if self.dense is None else self.dense[context[first]]
        n = np.add.reduceat((c > 0).astype(np.int64), np.flatnonzero(first)) if len(keys) else np.empty(0, np.int64)
        return Grams(self.listed[pairs // self.width - 1], self.listed[pairs % self.width - 1], n, self.listed[c[c > 0] - 1], self.beyond, two, three)

    def counted(self) -> Grams:
        """All trigrams with their counts, as training sends them; it knows every word."""
        keys, count = np.unique(self.keys()[0], return_counts=True)
        g = self.grams(keys, [], [count])
        g.two = [np.zeros(len(g.a), np.int64)] * 5
        return g

    def asked(self) -> Grams:
        """All questions, none with a context that is known to be new."""
        keys = np.unique(np.concatenate(self.keys()))
        return self.grams(keys[keys >= self.width], [], [])

    def scored(self, told: dict[int, bytes], bits: int, language: Language | None) -> tuple[np.ndarray, np.ndarray]:
        """Words and log probability of each document from the answers of the shards."""
        at = np.flatnonzero(self.real)
        n = np.bincount(self.doc[at], minlength=len(self.sizes))
        if language is None:
            return n, n * np.log(1e-9)
        words, ends, single = self.keys()
        keys, which = np.unique(np.concatenate([np.zeros(1, np.int64), words, ends, single]), return_inverse=True)
        skipped = int(np.searchsorted(keys, self.width))  # keys without a context
        g = self.grams(keys[skipped:], [], [])
        shard = g.shards(self.coder, bits)
        of_c, two, three = np.repeat(shard, g.n), [np.zeros(len(g.a) + 1, np.int64) for _ in range(5)], np.zeros(len(g.c) + 1, np.int64)
        if set(told) != set(shard.tolist()):
            raise RuntimeError("the documents of a block changed between two passes; write them to a table first")
        for s, data in told.items():
            *columns, counts = _unpack(data)
            i, j = np.flatnonzero(shard == s), np.flatnonzero(of_c == s)
            if len(i) != len(columns[0]) or len(j) != len(counts):
                raise RuntimeError("the documents of a block changed between two passes; write them to a table first")
            for x, y in zip(two, columns):
                x[i] = y
            three[j] = counts
        # of each key the place of its bigram and of its trigram; the last one, which counts nothing, for none
        asked, c = keys[skipped:], keys[skipped:] % self.width > 0
        pair = np.concatenate([np.full(skipped, -1), np.cumsum(np.diff(asked // self.width, prepend=-1) > 0) - 1])[which[1:]]
        triple = np.concatenate([np.full(skipped, -1), np.where(c, np.cumsum(c) - 1, -1)])[which[1 : 1 + len(words)]]
        context, alone = np.full(len(self.numbers) + 1, -1), np.full(self.width, -1)
        alone[self.single] = pair[len(words) + len(ends) :]
        stop = np.cumsum(self.sizes)
        context[at] = pair[: len(words)]
        last = np.full(len(self.numbers), -1)
        last[stop - 1] = pair[len(words) : len(words) + len(ends)]
        after = np.where(np.isin(at, stop - 1, assume_unique=True), last[at], context[at + 1])
        word, before = alone[self.local[at]], alone[self.local[at - 1]]
        count = two[0][word]
        p = language.new + np.where(count > 0, count - np.array([0, *language.discounts[0]])[np.minimum(count, 3)], 0) / language.total
        p = _interpolated(two[0][after], [x[before] for x in two[1:]], p, language.discounts[1])
        p = _interpolated(three[triple], [x[context[at]] for x in two[1:]], p, language.discounts[2])
        return n, np.bincount(self.doc[at], np.log(p), len(self.sizes))


def _told(asks: list[bytes], known: list[bytes], coder: Coder) -> list[bytes]:
    """What a shard tells each block: the columns of the bigrams and the counts of the trigrams that it asks for, 0 where unknown."""
    parts = [Grams.read(data, 5) for data in known]
    keys, none, zero = [g.hashes(coder) for g in parts], np.empty(0, np.uint64), np.empty(0, np.int64)
    two, three = np.concatenate([none, *[k for k, _ in keys]]), np.concatenate([none, *[k for _, k in keys]])
    columns = [np.concatenate([zero, *[g.two[k] for g in parts]]) for k in range(5)]
    counts = np.concatenate([zero, *[g.three[0] for g in parts]])
    by2, by3 = np.argsort(two), np.argsort(three)
    two, three, columns, counts = two[by2], three[by3], [x[by2] for x in columns], counts[by3]

    def looked_up(keys: np.ndarray, sought: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        if not len(keys):
            return [np.zeros(len(sought), np.int64) for _ in values]
        place = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
        return [np.where(keys[place] == sought, v[place], 0) for v in values]

    out = []
    for data in asks:
        pairs, triples = Grams.read(data, 0).hashes(coder)
        out.append(_pack(*looked_up(two, pairs, columns), *looked_up(three, triples, [counts])))
    return out


@dataclass
class Shards:
    """The model: rows (lang, shard, data), 2^``bits`` shards per language, and the words that numbers stand for, broadcast."""

    rows: DataFrame
    bits: int
    listed: Broadcast


def _blocks(batches, lang_at: int, text_at: int):
    """Rows of one task in blocks: (number, language, rows), of some ``BLOCK_BYTES`` of text for all languages together."""
    from pyspark import TaskContext

    number, size, held = TaskContext.get().partitionId() << 32, 0, {}
    for batch in batches:
        for i in range(0, batch.num_rows, 32):
            part = batch.slice(i, 32)
            langs = [x or "" for x in part.column(lang_at).to_pylist()]
            for lang in dict.fromkeys(langs):
                held.setdefault(lang, []).append(part.take([k for k, x in enumerate(langs) if x == lang]))
            size += pc.sum(pc.binary_length(part.column(text_at))).as_py() or 0
            if size >= BLOCK_BYTES:
                for lang, parts in held.items():
                    yield number, lang, pa.Table.from_batches(parts)
                    number += 1
                size, held = 0, {}
    for lang, parts in held.items():
        yield number, lang, pa.Table.from_batches(parts)
        number += 1


def _listed(trusted: DataFrame) -> tuple[np.ndarray, bool]:
    """The most frequent ``WORDS`` trained words at most, by falling count, and whether these are all."""

    def counts(batches):
        for _, lang, rows in _blocks(batches, 0, 1):
            seq, _, real = _sequence(lang, rows.column(1).to_pylist())
            k, c = np.unique(seq[real], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["k", "c"])

    words = trusted.mapInArrow(released(counts), "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c")).persist()
    steps = sorted(((r["c"], r["n"]) for r in words.groupBy(F.least("c", F.lit(1 << 16)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    n, least = 0, 1 << 62
    for c, more in steps:
        n += more
        if n > WORDS:
            break
        least = c
    t = words.where(F.col("c") >= least).toArrow()
    words.unpersist()
    k, c = t.column("k").to_numpy().view(np.uint64), t.column("c").to_numpy()
    return k[np.lexsort((k, -c))], n <= WORDS


def gram_tables(trusted: DataFrame, asking: int = 0) -> tuple[Shards, dict[str, Language]]:
    """Counts of all n-grams of ``trusted(lang, text)`` in hash shards, and what a language needs besides.

    Blocks of documents send their distinct trigrams with counts to the shards of their first two words. A shard
    adds them up, which also gives what its bigrams are as contexts, and sends the continuation counts of bigrams to
    theirs; these send those of words. Everything travels as sorted numbers of words, compressed. ``asking`` is
    how many characters will ask the shards.
    """
    trusted = trusted.select(F.coalesce("lang", F.lit("")).alias("lang"), "text")
    chars = trusted.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, asking / SHARD_CHARS, chars / CHARS_PER_WORD / SHARD_GRAMS))))
    listed = trusted.sparkSession.sparkContext.broadcast(_listed(trusted))
    names = ["lang", "shard", "kind", "data", "kinds"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    schema = "lang string, shard int, kind int, data binary, kinds array<bigint>"
    table = lambda rows: pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=names)

    def grams(batches):
        coder = Coder(*listed.value)
        for _, lang, rows in _blocks(batches, 0, 1):
            sent = Block.of(lang, rows.column(1).to_pylist(), coder).counted().sent(coder, bits)
            yield from table([(lang, s, 3, data, None) for s, data in sent]).to_batches()

    def summed(t: pa.Table) -> tuple[str, int, Coder, Grams]:
        lang, coder = t.column("lang")[0].as_py(), Coder(*listed.value)
        return lang, t.column("shard")[0].as_py(), coder, Grams.merged([x for x in t.column("data").to_pylist() if x], coder, _language(lang))

    def trigrams(t: pa.Table) -> pa.Table:
        lang, shard, coder, g = summed(t)
        of, count, width = np.repeat(np.arange(len(g.a)), g.n), g.three[0], len(coder.words) + len(g.beyond)
        g.two = [np.zeros(len(g.a), np.int64), *[np.bincount(of, x, len(g.a)).astype(np.int64) for x in _context(count)]]
        ends = _pairs_only(g.b[of], g.c, width, g.beyond, [np.ones(len(of)), *[np.zeros(len(of))] * 4])
        return table([(lang, s, 3, data, _kinds(count)) for s, data in g.sent(coder, bits)] + [(lang, s, 2, data, None) for s, data in ends.sent(coder, bits)])

    def bigrams(t: pa.Table) -> pa.Table:
        lang, shard, coder, g = summed(t)
        at, alone = np.flatnonzero(g.two[0]), len(coder.words) + int(np.flatnonzero(g.beyond == _ALONE)[0])
        count, mark, zero = g.two[0][at], np.full(2 * len(at), alone), np.zeros(len(at))
        columns = [np.concatenate([np.ones(len(at)), zero]), *[np.concatenate([zero, x]) for x in _context(count)]]
        words = _pairs_only(mark, np.concatenate([g.b[at], g.a[at]]), len(coder.words) + len(g.beyond), g.beyond, columns)
        more = [(lang, -1, 3, None, x) for x in t.column("kinds").to_pylist() if x]
        return table(more + [(lang, s, 2, data, _kinds(count)) for s, data in g.sent(coder, bits)] + [(lang, s, 1, data, None) for s, data in words.sent(coder, bits)])

    def unigrams(t: pa.Table) -> pa.Table:
        lang, shard, coder, g = summed(t)
        return table([(lang, s, 1, data, _kinds(g.two[0])) for s, data in g.sent(coder, bits)])

    rows = trusted.mapInArrow(released(grams), schema).groupBy("lang", "shard").applyInArrow(trigrams, schema)
    rows = cut_lineage(rows.groupBy("lang", "shard").applyInArrow(bigrams, schema))
    words = cut_lineage(rows.where("kind = 1").groupBy("lang", "shard").applyInArrow(unigrams, schema))
    rows = rows.where("kind > 1").unionByName(words)
    found: dict[str, dict[int, list[int]]] = {}
    for r in rows.where("kinds is not null").groupBy("lang", "kind").agg(F.array(*[F.sum(F.col("kinds")[k]) for k in range(7)]).alias("kinds")).collect():
        found.setdefault(r["lang"], {})[r["kind"]] = r["kinds"]
    model = Shards(rows.where("data is not null").select("lang", "shard", "data"), bits, listed)
    return model, {lang: Language.of(kinds) for lang, kinds in found.items()}


class Model:
    """The model in this process."""

    def __init__(self, rows: dict[str, dict[int, list[bytes]]], coder: Coder, bits: int, languages: dict[str, Language]):
        self.rows, self.coder, self.bits, self.languages = rows, coder, bits, languages

    def log_probs(self, texts: list[tuple[str | None, str | None]]) -> tuple[np.ndarray, np.ndarray]:
        """Words and log probability of each document."""
        n, lp = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for lang in {lang or "" for lang, _ in texts}:
            at = [i for i, (x, _) in enumerate(texts) if (x or "") == lang]
            block = Block.of(lang, [texts[i][1] for i in at], self.coder)
            known = self.rows.get(lang, {})
            told = {s: _told([data], known.get(s, []), self.coder)[0] for s, data in block.asked().sent(self.coder, self.bits)}
            n[at], lp[at] = block.scored(told, self.bits, self.languages.get(lang))
        return n, lp


def train(trusted: DataFrame) -> Model:
    """Model of ``trusted(lang, text)`` in this process, for text that is known to be small."""
    model, languages = gram_tables(trusted)
    rows: dict[str, dict[int, list[bytes]]] = {}
    for r in model.rows.collect():
        rows.setdefault(r["lang"], {}).setdefault(r["shard"], []).append(bytes(r["data"]))
    return Model(rows, Coder(*model.listed.value), model.bits, languages)


def scored(docs: DataFrame, model: Shards, languages: dict[str, Language], without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``n_words`` and ``log_prob`` under the model of :func:`gram_tables`, whatever its size; columns ``without`` are left out.

    Each block of documents sends its distinct n-grams to the shards, which hold the counts by hash; a shard
    tells the blocks the counts of those it knows, and the answers meet the block's documents, which travel as
    numbers of words. A frequent n-gram is one row per block, so no key is hot. Blocks are numbered by input
    partition, so ``docs`` must be a table or another plan whose partitions stay the same when it is computed
    again; answers that do not fit raise.
    """
    docs = docs.drop("n_words", "log_prob")
    lang_at, text_at = (docs.columns.index(c) for c in ("lang", "text"))
    kept = [i for i, f in enumerate(docs.schema.fields) if f.name not in without]
    fields = [docs.schema.fields[i] for i in kept]
    bits, listed, none = model.bits, model.listed, lambda x: pa.array(x, pa.binary())

    def ask(batches):
        coder = Coder(*listed.value)
        for number, lang, rows in _blocks(batches, lang_at, text_at):
            sent = Block.of(lang, rows.column(text_at).to_pylist(), coder).asked().sent(coder, bits)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sent)), pa.array([s for s, _ in sent], pa.int32()), pa.array([number] * len(sent), pa.int64()), none([x for _, x in sent])], names=["lang", "shard", "block", "data"])

    def own(batches):
        coder = Coder(*listed.value)
        for number, lang, rows in _blocks(batches, lang_at, text_at):
            block = Block.of(lang, rows.column(text_at).to_pylist(), coder)
            held = pa.StructArray.from_arrays([rows.column(i).combine_chunks() for i in kept], names=[f.name for f in fields])
            held = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([lang]), none([_pack(block.numbers + 1, block.beyond, block.sizes)]), held], names=["own_block", "lang", "data", "rows"])

    def tell(asks: pa.Table, known: pa.Table) -> pa.Table:
        data = _told(asks.column("data").to_pylist(), known.column("data").to_pylist(), Coder(*listed.value))
        return pa.table([asks.column("block"), asks.column("shard"), none(data)], names=["block", "shard", "data"])

    def score(blocks: pa.Table, told: pa.Table) -> pa.Table:
        out, coder = [], Coder(*listed.value)
        answers = dict(zip(told.column("shard").to_pylist(), told.column("data").to_pylist()))
        for lang, data, rows in zip(blocks.column("lang").to_pylist(), blocks.column("data").to_pylist(), blocks.column("rows").combine_chunks()):
            numbers, beyond, sizes = _unpack(data)
            n, lp = Block(numbers.astype(np.int64) - 1, beyond, sizes.astype(np.int64), coder).scored(answers, bits, languages.get(lang))
            out.append(pa.table([*rows.values.flatten(), pa.array(n, pa.int64()), pa.array(lp, pa.float64())], names=[*[f.name for f in fields], "n_words", "log_prob"]))
        return pa.concat_tables(out)

    asked = docs.mapInArrow(released(ask), "lang string, shard int, block bigint, data binary")
    answers = asked.groupBy("lang", "shard").cogroup(model.rows.groupBy("lang", "shard")).applyInArrow(tell, "block bigint, shard int, data binary")
    mine = docs.mapInArrow(released(own), StructType([StructField("own_block", LongType()), StructField("lang", StringType()), StructField("data", BinaryType()), StructField("rows", ArrayType(StructType(fields)))]))
    return mine.groupBy("own_block").cogroup(answers.groupBy("block")).applyInArrow(score, StructType([*fields, StructField("n_words", LongType()), StructField("log_prob", DoubleType())]))


def length_bin(words: Column) -> Column:
    """Documents of about as many words: the whole part of the binary logarithm."""
    return F.floor(F.log2(F.greatest(words, F.lit(1)))).cast("int")


def thresholds(rows: DataFrame) -> DataFrame:
    """Columns ``lang, length, threshold`` (log perplexity) and ``rank`` from scored trusted text, whatever its size.

    The quantile ``QUANTILE`` of trusted text of the same language and length bin; where fewer than
    ``LEAST_ROWS`` are there, the bin above joins it, then the two above that, then all lengths. ``lang``
    null: the same over all languages. Of a document's two thresholds the one of smaller ``rank``
    counts: text of nearly the same length in all languages says more than that of other
    lengths in its own. Quantiles merge map-side as sketches of ``ACCURACY``, exact up to that many rows.
    """
    v = rows.where("n_words > 0").select("lang", length_bin(F.col("n_words")).alias("x"), (-F.col("log_prob") / F.col("n_words")).alias("v"))
    spans = [F.struct(F.lit(0).alias("rank"), F.col("x").alias("length")), *[F.struct(F.lit(1).alias("rank"), (F.col("x") - k).alias("length")) for k in (0, 1)],
             *[F.struct(F.lit(2).alias("rank"), (F.col("x") - k).alias("length")) for k in range(4)], F.struct(F.lit(3).alias("rank"), F.lit(None).cast("int").alias("length"))]
    v = v.select("v", F.explode(F.array("lang", F.lit(None).cast("string"))).alias("lang"), F.array(*spans).alias("s")).select("lang", "v", F.explode("s").alias("s"))
    found = v.groupBy("lang", "s.rank", "s.length").agg(F.percentile_approx("v", QUANTILE, ACCURACY).alias("threshold"), F.count(F.lit(1)).alias("n"))
    found = found.where((F.col("n") >= LEAST_ROWS) | (F.col("lang").isNull() & (F.col("rank") == 3)))
    every = F.when(F.col("length").isNull(), F.sequence(F.lit(0), F.lit(LONGEST))).otherwise(F.array("length"))
    order = F.element_at(F.when(F.col("lang").isNull(), F.array(*map(F.lit, (2, 3, 5, 7)))).otherwise(F.array(*map(F.lit, (0, 1, 4, 6)))), F.col("rank") + 1)
    found = found.select("lang", order.alias("rank"), "threshold", F.explode(every).alias("length")).where("length >= 0")
    return found.groupBy("lang", "length").agg(F.min_by("threshold", "rank").alias("threshold"), F.min("rank").alias("rank"))


def _with_small(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a table of a few rows per language, broadcast once it is counted."""
    small = cut_lineage(small)
    return rows.join(F.broadcast(small) if small.count() <= SMALL_ROWS else small, on, "left")


def classify(docs: DataFrame, labels: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``n_words, log_prob, perplexity, threshold`` (perplexity) and ``kept``; columns ``without`` are left out.

    Trusted text: documents labelled quality 1 and not toxic, all of them. A seeded hash of the id deals
    ``TRAIN_SHARE`` of them to training and the others to the thresholds per language and length
    (:func:`thresholds`), since text that was trained on cannot say how new text scores.
    Every document with words is judged, short ones by short trusted text, and goes if it
    lies above its threshold. The model stays in shards, which the documents ask (:func:`scored`).

    Every row is scored whole. Rows without words have no perplexity and are not kept. A
    language without trusted text enough has the pooled threshold; a null language
    is a language of its own. Columns of ``docs`` that bear a result's name are replaced.
    Repeated rows are scored alike; repeated labels count once. Without trusted text nothing is
    rejected but rows without words.
    """
    docs = docs.drop("n_words", "log_prob", "perplexity", "threshold", "kept")
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0").select(F.col("doc_id").alias("__id"))
    good = cut_lineage(good)
    small = good.count() <= 2_000_000
    good = F.broadcast(good) if small else good
    trusted = docs.select(F.col("doc_id").alias("__id"), F.coalesce("lang", F.lit("")).alias("lang"), "text").where("text is not null").join(good, "__id", "left_semi")
    dealt = F.pmod(F.xxhash64("__id", F.lit(20)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chars = docs.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    model, languages = gram_tables(trusted.where(dealt < TRAIN_SHARE), chars)
    rows = scored(docs, model, languages, without)
    if "text" in without:  # small rows: scored once
        rows = cut_lineage(rows)
        held_out = rows.withColumns({"__id": F.col("doc_id"), "lang": F.coalesce("lang", F.lit(""))}).join(good, "__id", "left_semi").where(dealt >= TRAIN_SHARE)
    else:
        held_out = trusted.where(dealt >= TRAIN_SHARE).select("lang", "text")
        held_out = held_out if small else cut_lineage(held_out)  # rows of a shuffled join come in another order each time
        held_out = scored(held_out, model, languages, ("text",))
    limits = cut_lineage(thresholds(held_out))
    rows = rows.withColumns({"__lang": F.coalesce("lang", F.lit("")), "__length": F.least(length_bin(F.col("n_words")), F.lit(LONGEST))})
    own = limits.where("lang is not null").select(F.col("lang").alias("__lang"), F.col("length").alias("__length"), F.struct("rank", "threshold").alias("__own"))
    pooled = limits.where("lang is null").select(F.col("length").alias("__length"), F.struct("rank", "threshold").alias("__pooled"))
    rows = _with_small(_with_small(rows, own, ["__lang", "__length"]), pooled, ["__length"])
    limit = F.least("__own", "__pooled")["threshold"]  # nulls aside, the smaller rank
    mean = F.when(F.col("n_words") > 0, -F.col("log_prob") / F.col("n_words"))
    rows = rows.withColumns({"perplexity": F.exp(mean), "threshold": F.exp(limit), "kept": (F.col("n_words") > 0) & F.coalesce(mean <= limit, F.lit(True))})
    return rows.select(*[c for c in docs.columns if c not in without], "n_words", "log_prob", "perplexity", "threshold", "kept")
