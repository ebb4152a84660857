"""Periodic runs, tokenizer alignment and bin completion against brute force, libraries and exhaustive packings."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plurality.llm import align, bins, kneser_ney, runs
from plurality.llm.queries import QUERIES, tokenizer

JSON, PATTERN = tokenizer("byte_bpe_50k.json")
MODEL, _ = tokenizer("piece_bpe_32k.model")
EDGE = [None, "", " ", "\n\n \t", "a", "a b", "x " * 6, "ab " * 50 + "c", "y\x0bz\x1cw é é é é é é\x85", "=" * 5000, "<|endoftext|> a <s> b</s>", "a▁b", "\0x", "  two  blanks ", "ﬁ é 日本　 😀", "p q r " * 4000]


@pytest.fixture(scope="module")
def texts(spark, data):
    rnd = random.Random(11)
    made = [" ".join(rnd.choice(["the", "of", "tion", "é", "a1"][: rnd.randint(1, 5)]) for _ in range(rnd.choice([3, 40, 200]))) for _ in range(60)]
    rows = list(enumerate([*EDGE, *made]))
    rows += [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()]
    return rows + rows[5:9] + [(None, "an id is missing missing missing missing missing missing")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names clash with results."""
    return spark.createDataFrame([(*r, 1, "x") for r in texts], "doc_id bigint, text string, n_runs int, groups string").repartition(5)


def _runs(w):
    out, seen = [], set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and (i, j) not in seen and not any(s == i and s + n == j + q for s, n, _ in out):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_runs_equal_brute_force(docs, texts):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc_id, text in texts:
        w = _planted(doc_id, (text or "").encode().split())
        found = _runs(w)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        want.append((doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = runs.run_digests(runs.periodic_runs(runs.with_planted_runs(docs))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(r.n_runs for r in got) > 20
    assert runs.run_digests(runs.periodic_runs(runs.with_planted_runs(docs.where("false")))).count() == 0


def test_runs_of_random_words():
    rnd = random.Random(12)
    for _ in range(150):
        batch = []
        for _ in range(rnd.randint(1, 9)):
            n, k = rnd.choice([0, 5, 6, 30, 150]), rnd.choice([1, 2, 4, 30])
            w = [b"%d" % rnd.randrange(k) for _ in range(n)]
            if n and rnd.random() < 0.5:
                a, p = rnd.randrange(n), rnd.randint(1, 12)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            batch.append(w)
        for w, got in zip(batch, runs.batch_runs(batch)):
            assert list(zip(*(x.tolist() for x in got))) == _runs(w)


def test_extensions_equal_plain_comparison():
    rnd = np.random.default_rng(13)
    for n, k in ((9, 2), (400, 2), (400, 400)):
        words = np.append(rnd.integers(0, k, n), k)
        ext = runs.Extensions(words)
        a, b = rnd.integers(0, n, 500), rnd.integers(0, n, 500)
        a, b = a[a != b], b[a != b]
        for i, j, got in zip(a, b, ext.of(a, b)):
            m = 0
            while max(i, j) + m <= n and words[i + m] == words[j + m]:
                m += 1
            assert got == m


def test_alignment_equals_libraries(spark, docs, texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(JSON), SentencePieceProcessor(model_file=MODEL)
    a_side.encode_special_tokens = True
    back = {v: k for k, v in __import__("plurality.llm.counts", fromlist=["x"]).byte_symbols().items()}
    links, rows = Counter(), []
    for doc_id, text in texts:
        x, y = (a_side.encode(" " + text, add_special_tokens=False), b_side.encode(text)) if text else (None, [])
        a = [(i, len(t)) for i, t in zip(x.ids, x.tokens)] if text else []
        pieces = [b_side.id_to_piece(i) for i in y]
        raw = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
        if text and (b"".join(raw) != (" " + text).encode() or "".join(x.tokens) != "".join(back[c] for c in (" " + text).encode())):
            a, y, raw = [], [], []
        b = [(i, len(r)) for i, r in zip(y, raw)]
        ends = lambda t: {sum(n for _, n in t[: k + 1]): t[k][0] for k in range(len(t))} if len(t) < 2000 else _ends(t)
        ea, eb = ends(a), ends(b)
        both = sorted(ea.keys() & eb.keys())
        groups, low = [], 0
        inside_a, inside_b = sorted(ea.items()), sorted(eb.items())
        ia = ib = 0
        for cut in both:
            ga, gb = [], []
            while ia < len(inside_a) and inside_a[ia][0] <= cut:
                ga.append(str(inside_a[ia][1]))
                ia += 1
            while ib < len(inside_b) and inside_b[ib][0] <= cut:
                gb.append(str(inside_b[ib][1]))
                ib += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        mine = [(ea[c], eb[c]) for c in both]
        links.update(mine)
        rows.append((doc_id, len(a), len(b), len(both), mine, ";".join(groups)))
    top = defaultdict(int)
    for (_, b), n in links.items():
        top[b] = max(top[b], n)
    want = [(i, na, nb, ng, len(m), sum(links[p] == top[p[1]] for p in m), sum(links[p] for p in m), hashlib.sha256(g.encode()).hexdigest() if na else "") for i, na, nb, ng, m, g in rows]
    got = align.alignment_digests(docs, JSON, PATTERN, MODEL).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert align.alignment_digests(docs.where("false"), JSON, PATTERN, MODEL).count() == 0
    assert len(links) <= align.most_pairs(JSON, PATTERN, MODEL)


def _ends(t):
    return dict(zip(np.cumsum([n for _, n in t]).tolist(), (i for i, _ in t)))


def test_coalesced_groups_and_overlaps_equal_all_pairs():
    rnd = random.Random(14)
    for _ in range(100):
        ends = [sorted({*rnd.sample(range(1, 30), rnd.randint(0, 12)), 30}) for _ in range(2)]
        starts = [[0, *e[:-1]] for e in ends]
        order, group = align.coalesce(np.array(starts[0] + starts[1]), np.array(ends[0] + ends[1]))
        assert group[-1] + 1 == len(set(ends[0]) & set(ends[1]))
        a, b, together = align.overlaps(*map(np.array, ends))
        want = [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        assert list(zip(a.tolist(), b.tolist())) == want
        assert together.tolist() == [ends[0][i] == ends[1][j] for i, j in want]


def _least(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k, room in enumerate(rooms):
            if room >= items[i] and room not in rooms[:k]:
                place(i + 1, [*rooms[:k], room - items[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_sets():
    rnd = random.Random(15)
    for _ in range(150):
        capacity = rnd.choice([20, 50, 100])
        items = [rnd.randint(capacity // 10, int(capacity * rnd.choice([0.5, 0.7, 1]))) for _ in range(rnd.randint(0, 11))]
        patterns, used = bins.plan(Counter(items), capacity), Counter()
        for pattern, n in patterns:
            assert sum(pattern) <= capacity
            used.update({x: pattern.count(x) * n for x in set(pattern)})
        assert used == Counter(items) and sum(n for _, n in patterns) == _least(items, capacity)
        assert bins.least_bins(Counter(items), capacity) <= _least(items, capacity)


def test_fillings_are_not_dominated():
    rnd = random.Random(16)
    for _ in range(60):
        counts = Counter(rnd.randint(2, 12) for _ in range(rnd.randint(1, 7)))
        room, best = rnd.randint(1, 25), 0
        for mask in range(1 << counts.total()):
            total = sum(x for k, x in enumerate(counts.elements()) if mask >> k & 1)
            best = max(best, total if total <= room else 0)
        found = list(bins.fillings(counts, sorted(counts), room, 10_000))
        assert min(w for w, _ in found) == room - best
        for waste, f in found:
            left = counts - Counter(f)
            assert sum(f) + waste == room and not Counter(f) - counts
            assert not any(x <= waste for x in left) and not any(y > x and y - x <= waste for x in f for y in left)


def test_bins_hold_every_token_once(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(JSON), Counter()
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0] + [c for c in range((len(ids) - 1) % 128 + 1, len(ids) + 1, 128)]
        want.update((doc_id, k, i, j - i, zlib.crc32(np.array(ids[i:j], "<u4").tobytes())) for k, (i, j) in enumerate(zip(cuts, cuts[1:])))
    got = bins.packed_digests(docs, JSON, PATTERN, capacity=128).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 128
    least = bins.least_bins(Counter(r.length for r in got), 128)
    assert least <= len(sequences) <= least + 2
    bins.pieces(docs, JSON, PATTERN, 128).write.parquet(str(tmp_path / "pieces"))
    rows = bins.pack(spark.read.parquet(str(tmp_path / "pieces")), 128)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"] and rows.count() == len(got)
    assert bins.packed_digests(docs.where("false"), JSON, PATTERN).count() == 0


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_tokenizer_alignment", "op13_bin_completion"])
def test_queries_cover_the_table(spark, data, name):
    rows, docs = QUERIES[name](spark, data), spark.read.parquet(f"{data}/documents.parquet")
    assert rows.select("doc_id").distinct().count() == docs.count()


def test_classifier_scores_in_shards_and_blocks(spark, docs, texts, monkeypatch):
    """many shards and blocks give what the model in one process gives."""
    own = random.Random(31)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "tion", "x"]
    trusted = spark.createDataFrame([(lang, " ".join(own.choices(words, k=own.randint(0, 80)))) for lang in ("en", "fr", "") for _ in range(60)], "lang string, text string")
    rows = docs.withColumn("lang", F.when(F.length("text") % 3 == 1, "en").when(F.length("text") % 3 == 2, "fr"))
    rows = rows.unionByName(trusted.select(F.lit(7).cast("bigint").alias("doc_id"), "text", F.lit(1).alias("n_runs"), F.lit("y").alias("groups"), "lang"))
    monkeypatch.setattr(kneser_ney, "SHARD_GRAMS", 1000)
    monkeypatch.setattr(kneser_ney, "BLOCK_BYTES", 3000)
    grams, unknown = kneser_ney.gram_tables(trusted)
    got = kneser_ney.scored(rows, grams, unknown).collect()
    n, lp = kneser_ney.train(trusted).log_probs([(r.lang, r.text) for r in got])
    assert len(got) == rows.count() and Counter((r.doc_id, r.text, r.lang) for r in got) == Counter((r.doc_id, r.text, r.lang) for r in rows.collect())
    assert [r.n_words for r in got] == n.tolist() and np.allclose([r.log_prob for r in got], lp, rtol=1e-6, atol=1e-4)


def test_classifier_trains_on_all_trusted_text(spark):
    """9 million characters in one language; words of every document dealt to training are known."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(14_999)), lambda i: F.concat(F.lit("w"), F.col("doc_id"), F.lit("x"), F.pmod(i * 7919, F.lit(500)))))
    table = spark.range(100, 190).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang")).withColumn("text", text)
    labels = table.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    got = {r.doc_id: r.perplexity for r in kneser_ney.classify(table, labels).select("doc_id", "perplexity").collect()}
    dealt = F.pmod(F.xxhash64("doc_id", F.lit(20)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    trained = {r.doc_id for r in table.select("doc_id").where(dealt < kneser_ney.TRAIN_SHARE).collect()}
    assert 40 < len(trained) < 70 and {i for i, p in got.items() if p < 100} == trained


@pytest.mark.parametrize("words, widest", [(1 << 21, 1 << 21), (50, 1 << 21), (50, 2)])
def test_classifier_model_with_few_listed_words(spark, docs, monkeypatch, words, widest):
    """Words beyond the list travel as hashes, wide blocks number their contexts: the scores stay the same; a question is a few bytes."""
    own = random.Random(32)
    texts = [" ".join(own.choices([f"w{i}" for i in range(3000)], [1 / (i + 1) for i in range(3000)], k=own.randint(0, 300))) for _ in range(200)]
    trusted = spark.createDataFrame([("en", t) for t in texts[:120]] + [("fr", t) for t in texts[100:]], "lang string, text string")
    asking = [(lang, t) for lang in ("en", "fr", "xx", None) for t in [*texts[90:110], "w0", "new", "new w1", "w1 new w2", "w0 w1 new", "", None]]
    n, want = kneser_ney.train(trusted).log_probs(asking)
    monkeypatch.setattr(kneser_ney, "WORDS", words)
    monkeypatch.setattr(kneser_ney, "WIDEST", widest)
    monkeypatch.setattr(kneser_ney, "SHARD_GRAMS", 5000)
    model, languages = kneser_ney.gram_tables(trusted)
    known, whole = model.listed.value
    assert whole == (words > 50) and len(known) <= words and model.bits > 0
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(asking)], "i bigint, lang string, text string")
    got = {r.i: r for r in kneser_ney.scored(rows, model, languages, ("text",)).collect()}
    assert [got[i].n_words for i in range(len(asking))] == n.tolist() and "text" not in got[0]
    assert np.allclose([got[i].log_prob for i in range(len(asking))], want, rtol=1e-9)
    if whole:
        block = kneser_ney.Block.of("en", texts, kneser_ney.Coder(known, whole))
        sent, asked = block.asked().sent(kneser_ney.Coder(known, whole), 0), block.asked()
        assert sum(len(data) for _, data in sent) < 5 * (len(asked.a) + len(asked.c))


def test_classifier_without_texts_judges_alike(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{data}/labels.parquet")
    rows = [sorted((r.doc_id, r.n_words, round(r.log_prob, 6), r.kept) for r in kneser_ney.classify(docs, labels, without).collect()) for without in ((), ("text",))]
    assert rows[0] == rows[1] and len(rows[0]) == docs.count()
