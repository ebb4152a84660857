"""Personal data: fixed base patterns, and more spans by weak supervision. DataFrame functions only.

Labelers vote on every candidate span; expectation-maximisation estimates how reliable each
labeler is, and a naive Bayes classifier of the span is trained on the posteriors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: The base patterns, with possessive runs so that long texts are read once.
#: A local part starts where its run starts or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: candidates beyond the base: access keys, assigned secrets with blanks and quotes around the sign, national ids and local phone numbers
ASSIGNED = r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|passphrase|(?:secret|api|access|private)[_-]?key|secret|token)[\"']?\s*+[=:]{1,2}+>?+\s*+(?:\"[^\"\r\n]{6,}+\"|'[^'\r\n]{6,}+'|[^\s]{6,}+)"
LOOSE = r"\b(?:AKIA|ASIA)[A-Z0-9]{12,}+|" + ASSIGNED + r"|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])"
#: bare runs that may be random: letters and digits, 20 or more
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}+"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
KINDS = [*BASE, "key", "secret", "ssn", "local", "run"]
#: Prefixes of issued tokens, country codes, card issuers and domain endings, each as one pattern, and context words
ISSUED = r"^(?:gh[opsu]_|github_pat_|glpat-|sk[-_]|pk_|xox[abp]-|eyJ|AIza|ya29)|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$"
COUNTRY_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4|5)|35|30|36|38)"
DOMAINS = r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
WORDS = {
    "email": "mail|contact|write|address", "ip": "ip|host|server|address", "card": "card|visa|pay|credit", "phone": "phone|call|tel|mobile|fax",
    "key": "key|aws|access", "secret": "login|user|pass|secret|token", "ssn": "ssn|social|security", "local": "phone|call|tel|mobile|fax", "run": "key|token|secret|pass|auth|cred|bearer|sign",
}
LABELERS = ("shape", "gazetteer", "context", "border")
ROUNDS = 25
#: spans, one more for each row, that may be broadcast for redaction
BROADCAST_SPANS = 500_000


def _parts(text: Column, pattern: str, kind: str) -> Column:
    """Matches of a pattern with what lies before and after: (kind, i, gap, value, left, right) in order."""
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.transform(F.arrays_zip(values.alias("v"), F.slice(gaps, F.lit(1), F.size(values)).alias("g"), F.slice(gaps, F.lit(2), F.size(values)).alias("r")), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.cast("bigint").alias("i"), F.length(x["g"]).cast("bigint").alias("gap"), x["v"].alias("value"), F.right(x["g"], F.lit(32)).alias("left"), F.left(x["r"], F.lit(1)).alias("right")))
    none = F.array().cast("array<struct<kind:string,i:bigint,gap:bigint,value:string,left:string,right:string>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Digits from the right, every second one doubled and its digits added; the sum ends in 0."""
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _entropy(value: Column) -> Column:
    """Bits per character of the whole value; its alphabet is that of the candidate pattern, at most some sixty signs."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    share = F.transform(F.array_distinct(chars), lambda d: F.size(F.filter(chars, lambda c: c == d)) / F.size(chars))
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def _valid(kind: Column, value: Column) -> Column:
    """Whether a match of a base pattern holds as one."""
    n = F.length(_digits(value))
    part = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    small = F.forall(part, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(part, lambda p: F.coalesce(F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int"), F.lit(0)) <= 255)
    return (
        F.when(kind == "email", F.lit(True)).when(kind == "ip", small)
        .when(kind == "card", F.when(n.between(12, 19), _luhn(value)).otherwise(F.lit(False))).when(kind == "phone", n.between(9, 15)).otherwise(F.lit(False))
    )


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per candidate span, and one with null ``kind`` for each document without any.

    Columns ``rid`` (number of the row), ``keep``, ``kind, start, end`` (code points, end
    exclusive), ``value, left, right, base``. Places follow from running sums of the lengths
    between and of the matches. Base matches that fail their check are candidates too. A
    candidate that lies within a base span, or within a candidate of a kind that says more
    (assigned or shaped, bare run, failed base match, in this order), is left out; one that
    only overlaps stays.
    """
    text = F.coalesce("text", F.lit(""))
    found = F.concat(*[_parts(text, p, k) for k, p in BASE.items()], _parts(text, LOOSE, "loose"), _parts(text, RUN, "run"))
    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), *keep, found.alias("found"))  # before the rows multiply
    rows = numbered.select("rid", *keep, F.explode_outer("found").alias("m")).select("rid", *keep, "m.*")
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.repartition("rid").withColumn("end", F.sum(F.col("gap") + F.length("value")).over(upto)).withColumn("start", F.col("end") - F.length("value"))
    loose = (
        F.when(F.col("value").rlike("^(?:AKIA|ASIA)"), "key").when(F.col("value").rlike("^[A-Za-z]"), "secret")
        .when(F.col("value").rlike("^[0-9]{3}-[0-9]{2}-"), "ssn").otherwise("local")
    )
    rows = rows.withColumn("base", F.coalesce(_valid(F.col("kind"), F.col("value")), F.lit(False))).withColumn("kind", F.when(F.col("kind") == "loose", loose).otherwise(F.col("kind")))
    # what holds a candidate starts before it, or with it and ends later or ranks first: the last end so far of each better rank tells
    kind = F.col("kind")
    rank = F.when(F.col("base"), 0).when(kind.isin("key", "secret", "ssn", "local"), 1).when(kind == "run", 2).when(kind == "card", 4).otherwise(3)
    rows = rows.withColumn("rank", rank)
    order = Window.partitionBy("rid").orderBy("start", F.desc("end"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    held = [F.max(F.when(F.col("rank") < r, F.col("end"))).over(order) >= F.col("end") for r in (1, 2, 3, 4)]
    rows = rows.withColumn("inside", F.coalesce(F.element_at(F.array(F.lit(False), *held), F.col("rank") + 1), F.lit(False)))
    usable = kind.isNotNull() & ~F.col("inside")
    span = lambda c: F.when(usable, F.col(c)).alias(c)
    return rows.select("rid", *keep, *[span(c) for c in ("kind", "start", "end", "value", "left", "right", "base")])


def votes(rows: DataFrame) -> DataFrame:
    """Votes of the labelers: 1 for, 0 against, null where a labeler abstains."""
    kind, value = F.col("kind"), F.col("value")
    n = F.length(_digits(value))
    shape = (
        F.when(kind == "key", value.rlike("^(?:AKIA|ASIA)[A-Z0-9]{16}$")).when(kind == "secret", value.rlike("(?s)[=:].*[0-9]") & (F.length(value) >= 12))
        .when(kind == "ssn", ~value.rlike("^(?:000|666|9)")).when(kind == "local", value.rlike(r"[2-9][0-9]{2}[ .-][0-9]{4}$"))
        .when(kind == "run", (_entropy(value) >= 3) & value.rlike("(?:[0-9]++[^0-9]++){3}")).otherwise(F.col("base"))
    )
    gazetteer = (
        F.when(kind == "email", F.lower(value).rlike(DOMAINS)).when(kind == "ip", value.rlike(r"^0*[0-9]{1,3}\.") & ~value.rlike(r"^(?:0|127|2[4-5][0-9])\.")).when(kind == "card", n.between(12, 19) & _digits(value).rlike(ISSUERS))
        .when(kind == "phone", n.between(7, 18) & value.rlike(COUNTRY_CODES)).when(kind == "key", value.rlike("^AKIA")).when(kind == "secret", F.lower(value).rlike("^(?:password|secret|token)"))
        .when(kind == "local", value.rlike(r"^\(?[2-9](?!11)[0-9]{2}"))
        .when((kind == "run") & value.rlike(ISSUED), F.lit(True))
    )
    cue = None
    for k, words in WORDS.items():
        hit = F.lower("left").rlike(rf"\b(?:{words})")
        cue = F.when((kind == k) & hit, F.lit(True)) if cue is None else cue.when((kind == k) & hit, F.lit(True))
    border = ~F.right("left", F.lit(1)).rlike("[A-Za-z0-9]") & ~F.col("right").rlike("[A-Za-z0-9]")
    return rows.withColumns({name: v.cast("int") for name, v in zip(LABELERS, (shape, gazetteer, cue, border))})


def em_posteriors(patterns: DataFrame) -> DataFrame:
    """Columns of ``patterns(votes, n)`` and ``posterior``: the chance that a span with these votes is personal data.

    ``votes`` is an array with a vote per labeler, null where it abstains. Two-class
    Dawid-Skene: ROUNDS steps of expectation-maximisation inside one expression. There are at
    most 3^labelers patterns, whatever the corpus, so their list is of bounded size.
    """
    k = len(LABELERS)
    all_rows = patterns.agg(F.array_sort(F.collect_list(F.struct(F.col("votes").alias("v"), F.col("n").cast("double").alias("n")))).alias("p"))

    def posterior(p: Column, s: Column) -> Column:
        yes, no = s[0], 1 - s[0]
        for j in range(k):
            v, a, b = p["v"][j], s[1 + j], s[1 + k + j]
            yes = yes * F.when(v.isNull(), F.lit(1.0)).when(v == 1, a).otherwise(1 - a)
            no = no * F.when(v.isNull(), F.lit(1.0)).when(v == 1, b).otherwise(1 - b)
        return yes / (yes + no)

    def step(s: Column, _: Column) -> Column:
        # per pattern: weight and votes, summed with the posterior as yes and its rest as no; smoothed by one span of each
        weighed = F.transform(F.col("p"), lambda p: F.struct(p["v"].alias("v"), (p["n"] * posterior(p, s)).alias("y"), (p["n"] * (1 - posterior(p, s))).alias("m")))
        zero = F.array(*[F.lit(0.0)] * (2 + 4 * k))

        def add(acc: Column, w: Column) -> Column:
            out = [acc[0] + w["y"], acc[1] + w["m"]]
            for j in range(k):
                v, at = w["v"][j], 2 + 4 * j
                out += [acc[at] + F.when(v == 1, w["y"]).otherwise(0.0), acc[at + 1] + F.when(v.isNotNull(), w["y"]).otherwise(0.0),
                        acc[at + 2] + F.when(v == 1, w["m"]).otherwise(0.0), acc[at + 3] + F.when(v.isNotNull(), w["m"]).otherwise(0.0)]
            return F.array(*out)

        def renewed(t: Column) -> Column:
            rate = lambda at: (t[at] + 1) / (t[at + 1] + 2)
            return F.array((t[0] + 1) / (t[0] + t[1] + 2), *[rate(2 + 4 * j) for j in range(k)], *[rate(4 + 4 * j) for j in range(k)])

        return F.aggregate(weighed, zero, add, renewed)

    start = F.array(*[F.lit(x) for x in [0.7, *[0.8] * k, *[0.3] * k]])
    fitted = all_rows.select("p", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("s"))
    return fitted.select(F.explode("p").alias("p"), "s").select(F.col("p.v").alias("votes"), F.col("p.n").alias("n"), posterior(F.col("p"), F.col("s")).alias("posterior"))


def _features() -> Column:
    """What the final classifier sees of a span: names of its traits, few of each."""
    size = F.least(F.floor(F.log2(F.length("value") + 1)).cast("int"), F.lit(8))
    digits = F.floor(4 * F.length(_digits(F.col("value"))) / F.length("value")).cast("int")
    vote = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-")))
    return F.array(F.concat(F.lit("kind="), F.col("kind")), F.concat(F.lit("size="), size.cast("string")), F.concat(F.lit("digits="), digits.cast("string")), *[vote(c) for c in LABELERS])


def found_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep, spans`` for every row: the sorted (start, order, kind, end, base) of its base and added spans.

    The classifier is fitted on all candidates of the corpus; the model is a weight per trait,
    some fifty numbers. Base spans stay whatever it says.
    """
    rows = cut_lineage(votes(candidates(docs, keep)))
    spans = rows.where("kind is not null").withColumn("votes", F.array(*LABELERS))
    patterns = spans.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    labelled = F.broadcast(em_posteriors(patterns).select("votes", "posterior"))  # at most 3^labelers rows
    same = F.concat_ws(",", F.transform(F.col("votes"), lambda v: F.coalesce(v.cast("string"), F.lit("-"))))
    soft = spans.withColumn("__v", same).join(labelled.select(same.alias("__v"), "posterior"), "__v").select(F.explode(_features()).alias("trait"), "posterior")
    traits = soft.groupBy("trait").agg(F.sum("posterior").alias("y"), F.sum(1 - F.col("posterior")).alias("m")).collect()  # some fifty traits
    # prior odds; each trait's odds are smoothed towards them by one span, so rare traits say little
    kinds = [r for r in traits if r["trait"].startswith("kind=")]
    share = (sum(r["y"] for r in kinds) + 1) / (sum(r["y"] + r["m"] for r in kinds) + 2)
    prior = math.log(share / (1 - share))
    weights = {r["trait"]: math.log((r["y"] + share) / (r["m"] + 1 - share)) - prior for r in traits}
    model = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair]) if weights else F.create_map().cast("map<string,double>")
    score = F.lit(prior) + F.aggregate(_features(), F.lit(0.0), lambda a, t: a + F.coalesce(F.element_at(F.col("__model"), t), F.lit(0.0)))
    rows = rows.withColumn("__model", model).withColumn("held", F.col("kind").isNotNull() & (F.col("base") | (score > 0)))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.when(F.col("held"), F.struct("start", order.cast("int").alias("order"), "kind", "end", "base"))
    return rows.groupBy("rid", *keep).agg(F.array_sort(F.collect_list(one)).alias("spans")).drop("rid")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_digests(docs: DataFrame) -> DataFrame:
    """Columns ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added`` for every row of ``docs(doc_id, text)``.

    Counts by kind and digest are those of the base spans; ``spans`` lists base and added ones as
    ``kind:start:end``, ``n_spans`` counts both and ``n_added`` what the method added. A null text is empty and has none. Repeated rows are found alike, null
    ids pass through, an empty table gives no rows; other columns are not read. A document's
    spans are gathered in one row, as its text is.
    """
    rows = found_spans(docs.select("doc_id", "text"), ["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("bigint").alias(f"n_{k}")
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
                       F.size("spans").cast("bigint").alias("n_spans"), F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_added"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in brackets, in upper case.

    Spans that overlap are replaced together, under the name of the first. Spans are found
    per row and come back to it by id and content, so repeated rows stay repeated; documents
    without a span are not touched. Up to ``BROADCAST_SPANS`` spans, some sixty bytes each, are
    broadcast, more are joined by a shuffle.
    """
    mark = F.xxhash64("text", F.length("text"))
    found = found_spans(docs.select("doc_id", "text", mark.alias("mark")), ["doc_id", "mark"])
    found = cut_lineage(found.where(F.size("spans") > 0).dropDuplicates(["doc_id", "mark"]).withColumnsRenamed({"doc_id": "__id", "mark": "__mark", "spans": "__spans"}))
    size = found.agg(F.sum(F.size("__spans") + 1)).first()[0] or 0
    found = F.broadcast(found) if size <= BROADCAST_SPANS else found
    rows = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (mark == F.col("__mark")), "left")
    text = F.col("text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("end"))
    step = lambda a, s: F.when(s["start"] < a["end"], F.struct(a["out"].alias("out"), F.greatest(a["end"], s["end"]).alias("end"))).otherwise(F.struct(
        F.concat(a["out"], F.substring(text, (a["end"] + 1).cast("int"), (s["start"] - a["end"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), s["end"].alias("end")))
    clean = F.aggregate("__spans", start, step, lambda a: F.concat(a["out"], F.substring(text, (a["end"] + 1).cast("int"), F.length(text))))
    return rows.withColumn("text", F.when(F.col("__spans").isNull(), text).otherwise(clean)).select(*docs.columns)
