"""Quality rules as a ledger of failure bits: measured once, judged by any policy later. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]"
#: rules in the order of their bits; a rule is true where a text fails it
RULES = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "duplicate_lines": lambda m: 100 * m["n_dup_lines"] > 60 * m["n_lines"],
    "word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]),
    "capitals": lambda m: 100 * m["n_capitals"] > 40 * m["word_chars"],
}
#: versions of the policy: the rules whose failure rejects a document
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals")


def mask(rules) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, though body names it many times."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside windows of three that occur twice or more in the list.

    Windows are compared by 64-bit hash. Only lists with a repeat are sorted, by hash and
    place; each repeated window then adds the words that the one before it has not covered.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j).getField("h") == x.getField("h"), F.lit(False))
        repeated = _let(placed, lambda s: F.array_sort(F.filter(F.transform(s, lambda x, j: F.when(same(s, x, j - 1) | same(s, x, j + 1), x.getField("i"))), lambda i: i.isNotNull())))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct((a["n"] + 3 - F.greatest(a["end"] - i, F.lit(0))).cast("bigint").alias("n"), (i + 3).alias("end"))
        return F.aggregate(repeated, start, step, lambda a: a["n"])

    count = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("bigint")))
    return F.when(F.size(words) >= 3, count).otherwise(F.lit(0).cast("bigint"))


def ledger(docs: DataFrame) -> DataFrame:
    """``docs`` with measurements (bigint) and ``failed_rules``, a bigint with bit k set where rule k fails.

    A text's words are its longest runs without the six ASCII blanks; lines are split at
    line feeds and count if they have a word. A null text has no words and fails
    ``few_words``. Every row is measured by itself, whole, in one narrow pass, so repeated
    rows, hot sources and copies cost nothing extra. Columns of ``docs`` that bear a
    measurement's name are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, BLANK + "+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))

    def measured(w: Column, x: Column) -> Column:
        values = {
            "n_words": F.size(w), "word_chars": without(BLANK + "+"), "n_symbols": without(r"[^#*$%&|<>]+"), "n_lines": F.size(x),
            "n_dup_lines": F.size(x) - F.size(F.array_distinct(x)), "n_repeat_words": _repeat_words(w), "n_capitals": without("[^A-Z]+"),
        }
        return F.struct(*[v.cast("bigint").alias(k) for k, v in values.items()])

    def bits(m: Column) -> Column:
        total = F.lit(0)
        for k, rule in enumerate(RULES.values()):
            total = total.bitwiseOR(F.when(rule(m), F.lit(1 << k)).otherwise(F.lit(0)))
        return total.cast("bigint")

    # one expression, every part of it computed once: a filter on its bits may then be moved to the scan without repeating it
    row = _let(words, lambda w: _let(lines, lambda x: _let(measured(w, x), lambda m: F.struct(*[m[c].alias(c) for c in MEASURES], bits(m).alias("failed_rules")))))
    return docs.drop(*MEASURES, "failed_rules").withColumn("__ledger", row).select("*", "__ledger.*").drop("__ledger")


def judged(rows: DataFrame, policy: str) -> DataFrame:
    """A ledger with ``base_failed`` and ``kept`` by a version of the policy."""
    hit = lambda m: F.col("failed_rules").bitwiseAND(F.lit(m)) != 0
    base = mask(POLICIES["base"])
    return rows.withColumns({"base_failed": hit(base), "kept": ~hit(base | mask(POLICIES[policy]))})


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy does: ``rule, n_failed, n_only`` (documents that it alone rejects), ``n_docs``.

    Documents are first counted by their bits, so at most 2^rules counts are left to fold.
    """
    m = mask(POLICIES[policy])
    by_bits = rows.groupBy(F.col("failed_rules").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("bigint").alias("bit")) for r in POLICIES[policy]])).alias("r")
    return by_bits.select("bits", "n", rules).groupBy("r.rule").agg(
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("n_only"),
        F.sum("n").alias("n_docs"),
    )
