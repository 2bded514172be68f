"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Every text is measured natively. A rule rejects documents whose rate lies above a cutoff. Cutoffs are chosen on
labelled holdouts: for each stratum (language), rule and cutoff, the documents labelled good that it would reject are
counted, and the exact binomial test asks whether its false rejections are below the allowed risk. The risk of a
stratum is shared among the rules, and delta among all strata and rules (Bonferroni); a rule's cutoffs are tested from
the highest down to the first that fails (fixed sequence; rejections only grow on the way, so that is the lowest that
passes). With confidence 1 - delta no stratum loses more than the allowed share of its good documents. A rule without
a passing cutoff rejects nothing there.

Null or empty texts have no words and fail the base rules. A null language is a stratum of its own. Documents without
labels are judged all the same; without labels no rule rejects. Repeated rows give repeated rows; a null doc_id is
carried and never calibrates. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm.common import require, written

SPACE = r"\x20\x09-\x0D"
#: Allowed share of good documents that a stratum may lose to all rules, and the chance that any does lose more.
RISK, DELTA = 0.02, 0.05
CUTOFFS = [0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8]
#: rule -> its rate, of what measured() gives.
RATES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "shouting": "n_capitals / greatest(word_chars, 1)",
}


def repeated_words(words: str) -> Column:
    """Words that lie in a 3-word window found twice or more, of a column ``tri`` of sorted (hash, position)."""
    n = F.size("tri")
    repeats = F.filter("tri", lambda x, i: ((i > 0) & (F.get("tri", i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get("tri", i + 1)["h"] == x["h"])))
    spots = F.sort_array(F.transform(repeats, lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
    return F.aggregate(spots, start, lambda acc, p: F.struct((acc["n"] + (p + 3 - F.greatest(p, acc["end"]))).cast("long").alias("n"), (p + 3).alias("end")))["n"]


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_capitals for its text.

    Windows are told apart by 64-bit hashes: two different windows of one text are taken for equal with a chance of
    under 1e-13 for a thousand words."""
    text = F.coalesce("text", F.lit(""))
    others = [c for c in docs.columns if c != "text"]
    split = docs.select(
        *others,
        F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), F.lit(1)).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    hashed = split.select(
        *others,
        "n_symbols",
        "n_capitals",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))).alias("h"),
    )
    # Only texts in which a window occurs again are sorted.
    again = F.size(F.array_distinct("h")) < F.size("h")
    sorted_ = hashed.select("*", F.when(again, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("tri")).drop("h")
    return sorted_.select("*", F.coalesce(repeated_words("tri"), F.lit(0).cast("long")).alias("n_repeat_words")).drop("tri")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials with chance p each; 1 where k is at least the mean, which no test passes."""
    import math

    odds = math.log(p / (1 - p))
    first = n * math.log1p(-p)
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    walk = F.aggregate(
        steps,
        F.struct(first.alias("log"), F.exp(first).alias("sum")),
        lambda acc, j: F.struct((acc["log"] + F.log((n - j + 1) / j) + odds).alias("log"), (acc["sum"] + F.exp(acc["log"] + F.log((n - j + 1) / j) + odds)).alias("sum")),
    )["sum"]
    return F.when(k < n * p, walk).otherwise(F.lit(1.0))


def thresholds(holdout: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """holdout: stratum and the rates, of documents labelled good -> stratum, and each rule's cutoff or null."""
    strata = holdout.agg(F.count_distinct(F.coalesce("stratum", F.lit("\0")))).first()[0] or 1
    tests = strata * len(RATES)
    # One row for each stratum: counts of rejections, by rule and cutoff.
    counted = holdout.groupBy("stratum").agg(
        F.count("*").alias("n"),
        *[F.array(*[F.sum((F.col(rule) > c).cast("long")) for c in CUTOFFS]).alias(rule) for rule in RATES],
    )
    passing = {
        rule: F.array_min(
            F.filter(
                F.transform(F.arrays_zip(F.col(rule).alias("k"), F.array(*map(F.lit, CUTOFFS)).alias("c")), lambda x: F.when(binomial_tail(x["k"], F.col("n"), risk / len(RATES)) <= delta / tests, x["c"])),
                lambda c: c.isNotNull(),
            )
        ).alias(f"cut_{rule}")
        for rule in RATES
    }
    return counted.select("stratum", *passing.values())


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang), labels (doc_id, quality) -> the measures, base_failed, the rule that rejects, kept."""
    measures = measured(require(docs, "doc_id", "text", "lang").withColumnRenamed("lang", "stratum"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rated = written(measures.withColumn("base_failed", failed).select("*", *[F.expr(rate).alias(rule) for rule, rate in RATES.items()]), "rules-measures")
    good = require(labels, "doc_id", "quality").where("quality = 1").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1).select("doc_id").distinct()
    cuts = thresholds(rated.where("not base_failed").join(good, "doc_id").select("stratum", *RATES)).withColumnRenamed("stratum", "of")
    joined = rated.join(cuts, rated.stratum.eqNullSafe(cuts.of), "left")
    rule = F.coalesce(F.when(F.col("base_failed"), F.lit("base")), *[F.when(F.col(rule) > F.col(f"cut_{rule}"), F.lit(rule)) for rule in RATES])
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", rule.alias("rejected_by")).withColumn("kept", F.col("rejected_by").isNull())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts on all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
tri AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
again AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM tri),
covered AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM again WHERE c > 1) GROUP BY k),
m AS (
  SELECT w.k, doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_capitals
  FROM w LEFT JOIN covered USING (k)),
r AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {'symbols': n_symbols / greatest(word_chars, 1), 'dup_lines': n_dup_lines / greatest(n_lines, 1), 'repeats': n_repeat_words / greatest(n_words, 1), 'shouting': n_capitals / greatest(word_chars, 1)} AS rate
  FROM m),
long AS (SELECT k, doc_id, lang, base_failed, unnest([{'rule': 'symbols', 'x': rate.symbols}, {'rule': 'dup_lines', 'x': rate.dup_lines}, {'rule': 'repeats', 'x': rate.repeats}, {'rule': 'shouting', 'x': rate.shouting}], recursive := true) FROM r),
crc AS (
  SELECT DISTINCT doc_id, xor(list_reduce(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)), 4294967295), 4294967295) AS v
  FROM labels WHERE quality = 1),
good AS (SELECT doc_id FROM crc WHERE v % 3 <> 1),
held AS (SELECT long.* FROM long JOIN good USING (doc_id) WHERE NOT base_failed),
cuts AS (SELECT unnest([0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8])::double AS c),
counted AS (SELECT lang, rule, c, count(*) AS n, count(*) FILTER (x > c) AS j FROM held, cuts GROUP BY ALL),
strata AS (SELECT count(*) AS n FROM (SELECT DISTINCT lang FROM held)),
tested AS (
  SELECT *, CASE WHEN j < n * 0.005::double THEN list_sum(list_transform(range(0, j + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.005::double) + (n - i) * ln(0.995::double)))) ELSE 1 END AS p
  FROM counted),
chosen AS (SELECT lang, rule, min(c) AS cut FROM tested WHERE p <= 0.05::double / ((SELECT n FROM strata) * 4) GROUP BY ALL),
out AS (SELECT DISTINCT long.k FROM long JOIN chosen ON long.lang IS NOT DISTINCT FROM chosen.lang AND long.rule = chosen.rule AND long.x > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND k NOT IN (SELECT k FROM out) AS kept FROM r
"""
