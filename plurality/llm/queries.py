"""Registered queries of the operators, over their whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, backoff, balltree, bins, bpe, counts, kneser_ney, neardup, packing, pii, preference, rules, runs
from .text import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> tuple[str, str]:
    """Path of a public vocabulary file and the pattern that splits text before merging."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


@query
def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kneser_ney.classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"), without=("text",))
    return rows.select("doc_id", "lang", "n_words", "log_prob", "perplexity", "threshold", "kept")


@query
def op2_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_rows(preference.swapped_replies(table(spark, sf_dir, "conversations")))


# both sides turn by turn, then the first difference between them
ORACLES["op2_preference_chat"] = """
WITH d AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM d),
l AS (SELECT conv_id, i, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS k FROM n WHERE role = 'assistant') t WHERE k = 1),
o AS (SELECT conv_id, i, coalesce(lead(conv_id) OVER (ORDER BY conv_id), (SELECT min(conv_id) FROM l)) AS nxt FROM l),
p AS (SELECT o.conv_id, o.i, l.text AS bad FROM o JOIN l ON l.conv_id = o.nxt),
b AS (SELECT n.conv_id, n.role, CASE WHEN n.i = p.i THEN p.bad ELSE n.text END AS text, n.i FROM n LEFT JOIN p ON p.conv_id = n.conv_id),
f AS (SELECT n.conv_id, coalesce(min(n.i) FILTER (WHERE n.role <> b.role OR n.text <> b.text), count(*)) AS np FROM n JOIN b ON b.conv_id = n.conv_id AND b.i = n.i GROUP BY n.conv_id),
s AS (SELECT x.*, np, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s FROM (SELECT 'c' AS side, * FROM n UNION ALL SELECT 'r' AS side, * FROM b) x JOIN f ON f.conv_id = x.conv_id),
e AS (SELECT *, sum(length(s)) OVER (PARTITION BY conv_id, side, i >= np ORDER BY i) AS stop FROM s),
m AS (SELECT *, CAST(stop - length(s) + length(role) + 5 AS BIGINT) || ':' || CAST(stop - 1 AS BIGINT) AS span FROM e)
SELECT conv_id AS pair_id, CAST(np AS BIGINT) AS n_prompt_turns, coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE side = 'c' AND i < np), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE side = 'c' AND i >= np), '') AS chosen, coalesce(string_agg(s, '' ORDER BY i) FILTER (WHERE side = 'r' AND i >= np), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (WHERE side = 'c' AND i >= np AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (WHERE side = 'r' AND i >= np AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY conv_id, np
"""


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.judged(rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "v2")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_capitals", "failed_rules")


ORACLES["op3_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g WHERE g IS NOT NULL) t WHERE c > 1),
c AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, i AS j FROM r UNION ALL SELECT rid, i + 1 FROM r UNION ALL SELECT rid, i + 2 FROM r) t GROUP BY rid),
l AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) t
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.rid, d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines,
      CAST(length(regexp_replace(d.text, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals
      FROM d JOIN w ON w.rid = d.rid LEFT JOIN l ON l.rid = d.rid LEFT JOIN c ON c.rid = d.rid),
b AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
      + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END)
      + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_capitals > 40 * word_chars THEN 32 ELSE 0 END) AS BIGINT) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_rules & 3 <> 0 AS base_failed, failed_rules = 0 AS kept, n_lines, n_capitals, failed_rules FROM b
"""


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), *tokenizer("byte_bpe_50k.tiktoken"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digests(packing.pack_documents(table(spark, sf_dir, "documents"), *tokenizer("byte_bpe_50k.json"), capacity=2048, end_id=1))


@query
def op6_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


ORACLES["op6_ball_tree_top_k"] = """
WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
w AS (SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM u),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM w q JOIN w c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.backoff_scores(table(spark, sf_dir, "documents"), alpha=0.4)


ORACLES["op7_stupid_backoff"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT rid, unnest(ws) AS b, generate_subscripts(ws, 1) AS i FROM s),
w AS (SELECT rid, i, lag(b) OVER (PARTITION BY rid ORDER BY i) AS a, b FROM p),
n AS (SELECT rid, count(*) AS n FROM p GROUP BY rid),
t AS (SELECT sum(n) AS n FROM n),
u AS (SELECT b, count(*) AS c FROM p GROUP BY b),
ud AS (SELECT rid, b, count(*) AS c FROM p GROUP BY rid, b),
g AS (SELECT a, b, count(*) AS c FROM w WHERE a IS NOT NULL GROUP BY a, b),
gd AS (SELECT rid, a, b, count(*) AS c FROM w WHERE a IS NOT NULL GROUP BY rid, a, b),
o AS (SELECT ud.rid, ud.b, u.c - ud.c AS c FROM ud JOIN u ON u.b = ud.b),
q AS (SELECT gd.rid, gd.a, gd.b, g.c - gd.c AS c FROM gd JOIN g ON g.a = gd.a AND g.b = gd.b),
v AS (SELECT w.rid, w.a, coalesce(q.c, 0) > 0 AS seen,
      CASE WHEN coalesce(q.c, 0) > 0 THEN CAST(q.c AS DOUBLE) / oa.c
           WHEN w.a IS NULL AND ob.c > 0 THEN CAST(ob.c AS DOUBLE) / greatest(t.n - n.n, 1)
           ELSE 0.4::DOUBLE * (CAST(CASE WHEN ob.c > 0 THEN ob.c ELSE 1 END AS DOUBLE) / greatest(t.n - n.n, 1)) END AS x
      FROM w JOIN n ON n.rid = w.rid CROSS JOIN t JOIN o ob ON ob.rid = w.rid AND ob.b = w.b
      LEFT JOIN o oa ON oa.rid = w.rid AND oa.b = w.a LEFT JOIN q ON q.rid = w.rid AND q.a = w.a AND q.b = w.b),
r AS (SELECT rid, count(*) AS n, count(*) FILTER (WHERE seen) AS seen, CAST(sum(CAST(floor(ln(x) * 1e6 + 0.5) AS BIGINT)) AS BIGINT) AS score FROM v GROUP BY rid)
SELECT d.doc_id, coalesce(r.n, 0) AS n_words, coalesce(r.seen, 0) AS n_seen, greatest(coalesce(r.n, 0) - 1, 0) - coalesce(r.seen, 0) AS n_backed_off, coalesce(r.score, 0) AS score
FROM d LEFT JOIN r ON r.rid = d.rid
"""


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"), width=3, percent=85)


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), *tokenizer("byte_bpe_50k.json"), limit=512)


@query
def op10_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.periodic_runs(runs.with_planted_runs(table(spark, sf_dir, "documents"))))


@query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = tokenizer("byte_bpe_50k.json")
    return align.alignment_digests(table(spark, sf_dir, "documents"), vocabulary, pattern, tokenizer("piece_bpe_32k.model")[0])


@query
def op13_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.packed_digests(table(spark, sf_dir, "documents"), *tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=2)
