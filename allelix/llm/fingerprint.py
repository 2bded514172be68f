"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A paragraph (a line of the text) is hashed into a wide vector and a text's fingerprint is the sum of its paragraphs'
vectors, each lane modulo 2 ** 32. So the order of paragraphs doesn't matter, and a paragraph that comes or goes is
added or taken off without the others (`combined`, `changed`). A vector holds

* 1, the paragraph; and the number of its windows;
* EQUAL lanes of the paragraph's SHA-256: texts whose fingerprints are equal have the same paragraphs;
* ALIKE lanes that count, over the paragraph's windows of WIDTH words, one bit of each window's hashes. Such a lane,
  twice the count less the number of windows, is a sum of random signs over windows, and products of lanes estimate
  how many windows two texts share (`likeness`).

Equal texts have equal fingerprints. A null text counts as the empty one, which has one empty paragraph. Words are what
single spaces part; a window at a paragraph's end is shorter. Documents follow each other by descending doc_id, null
ids last, those of one id by their texts' hashes; rows that repeat both follow each other. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelix.llm.common import require, written

WIDTH, EQUAL, ALIKE = 3, 8, 128
MODULUS = 1 << 32
#: Copies of one row that are written out by one array.
TOGETHER = 1 << 16


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, fingerprint (array of lanes) of the text of each value of the keys; where several rows share these, of all
    their paragraphs together."""
    paragraphs = texts.select(*keys, F.explode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("_p"))
    digest = F.sha2("_p", 256)
    lanes = [F.conv(F.substring(digest, 8 * j + 1, 8), 16, 10).cast("long").alias(f"_e{j}") for j in range(EQUAL)]
    words = paragraphs.select(*keys, *lanes, F.split("_p", " ").alias("_w"))
    windows = words.select(*keys, *[f"_e{j}" for j in range(EQUAL)], "_w", F.posexplode("_w").alias("_at", "_word"))
    window = [F.col("_word"), *[F.get("_w", F.col("_at") + k) for k in range(1, WIDTH)]]
    first = F.col("_at") == 0
    # Two lanes in each sum, 32 bits apart: no sum overflows below 2 ** 31 windows.
    pairs = [
        F.sum(F.shiftrightunsigned(F.xxhash64(*window, F.lit(seed)), k).bitwiseAND(F.lit(MODULUS + 1))).alias(f"_s{seed * 32 + k}")
        for seed in range(ALIKE // 64)
        for k in range(32)
    ]
    sums = windows.groupBy(*keys).agg(F.count_if(first).alias("_n"), F.count("*").alias("_m"), *[F.sum(F.when(first, F.col(f"_e{j}"))).alias(f"_e{j}") for j in range(EQUAL)], *pairs)
    packed = F.array(*[f"_s{k}" for k in range(ALIKE // 2)])
    unpacked = F.flatten(F.transform(packed, lambda s: F.array(s.bitwiseAND(F.lit(MODULUS - 1)), F.shiftrightunsigned(s, 32))))
    head = F.transform(F.array("_n", "_m", *[f"_e{j}" for j in range(EQUAL)]), lambda x: x.bitwiseAND(F.lit(MODULUS - 1)))
    return sums.select(*keys, F.concat(head, unpacked).alias("fingerprint"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint a with the paragraphs of b added, or taken off (sign -1)."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(MODULUS - 1)))


def changed(known: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """known (key, fingerprint) after changes (key, paragraph, sign: 1 comes, -1 goes), without any text but the
    changed paragraphs. Keys that aren't known begin without paragraphs."""
    parts = fingerprints(changes.where("sign in (1, -1)").withColumn("paragraph", F.explode(F.split(F.coalesce("paragraph", F.lit("")), "\n"))), [key, "sign"], "paragraph")
    delta = {s: parts.where(F.col("sign") == s).select(key, F.col("fingerprint").alias(f"_d{s}")) for s in (1, -1)}
    none = F.array_repeat(F.lit(0).cast("long"), 2 + EQUAL + ALIKE)
    met = known.select(key, "fingerprint").join(delta[1], key, "full").join(delta[-1], key, "full")
    base, come, go = (F.coalesce(c, none) for c in ("fingerprint", "_d1", "_d-1"))
    return met.select(key, combined(combined(base, come), go, -1).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of two texts' windows that they have in common: 1 for equal fingerprints, about 0 for texts that
    share none; its deviation is about 1 / sqrt(ALIKE)."""

    def signs(f: Column) -> Column:
        n = F.get(f, 1)

        def centred(x: Column) -> Column:
            v = (2 * x - n).bitwiseAND(F.lit(MODULUS - 1))
            return F.when(v >= MODULUS // 2, v - MODULUS).otherwise(v).cast("double")

        return F.transform(F.slice(f, 3 + EQUAL, ALIKE), centred)

    both = F.zip_with(signs(a), signs(b), lambda x, y: F.struct((x * y).alias("xy"), (x * x + y * y).alias("xx")))
    zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"))
    total = F.aggregate(both, zero, lambda s, p: F.struct((s["xy"] + p["xy"]).alias("xy"), (s["xx"] + p["xx"]).alias("xx")), lambda s: F.when(s["xx"] > 0, 2 * s["xy"] / s["xx"]).otherwise(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def as_text(fingerprint: Column) -> Column:
    """Lanes in hexadecimal, eight digits each."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 8, "0")), "")


#: What tells documents apart: whether the id is null, the id's complement (which ascends as ids descend), the text's hash.
KEY = ["none", "down", "h"]


def _keyed(docs: DataFrame) -> DataFrame:
    id_, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    return require(docs, "doc_id", "text").select(id_.isNull().alias("none"), F.bitwise_not(F.coalesce(id_, F.lit(0))).alias("down"), F.xxhash64(text).alias("h"), text.alias("text"))


def followed(versions: DataFrame) -> DataFrame:
    """versions (KEY, n, copies) with next: the key that follows, that of the first behind the last. A row for each
    version and, where it has several copies, one for those that another copy follows (loop); copies: how many."""
    ranges = int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(versions.repartitionByRange(ranges, *KEY).withColumn("range", F.spark_partition_id()), "fingerprint-order")
    key = F.struct(*KEY)
    # One row for each range.
    heads = placed.groupBy("range").agg(F.min(key).alias("head"))
    inside = Window.orderBy("range")
    heads = heads.select("range", F.coalesce(F.lead("head").over(inside), F.first("head").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("after"))
    led = placed.withColumn("lead", F.lead(key).over(Window.partitionBy("range").orderBy(*KEY))).join(heads, "range")
    led = led.withColumn("follower", F.coalesce("lead", "after")).withColumn("alone", F.col("follower") == key)
    last = F.struct(F.col("follower").alias("next"), F.col("alone").alias("loop"), F.when(F.col("alone"), F.col("copies")).otherwise(1).cast("long").alias("copies"))
    others = F.struct(key.alias("next"), F.lit(True).alias("loop"), F.when(F.col("alone"), 0).otherwise(F.col("copies") - 1).cast("long").alias("copies"))
    return led.select(*KEY, "n", F.inline(F.filter(F.array(last, others), lambda x: x["copies"] > 0)))


def edited(docs: DataFrame) -> DataFrame:
    """Each document of docs (doc_id, text) and its text whose last third gave way to the beginning of the next
    document's: doc_id, n_chars, edited_sha256, and the fingerprints (arrays) own, edited and next."""
    keyed = _keyed(docs)
    versions = keyed.select(*KEY, F.char_length("text").cast("long").alias("n")).groupBy(*KEY).agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    links = followed(versions).select(*[F.col(c).alias(f"to_{c}") for c in KEY], "loop", F.floor(F.col("n") / 3).cast("int").alias("take"), "copies", "next.*")
    to = [F.col(f"to_{c}").alias(c) for c in KEY]
    # One row for each version, dealt by its key; the plan's later parts read that one exchange.
    texts = keyed.groupBy(*KEY).agg(F.first("text").alias("text"))
    own = fingerprints(texts, KEY)
    given = texts.join(links, KEY).select(*to, "loop", "take", F.left("text", F.col("take")).alias("beginning"))
    following = own.join(links, KEY).select(*to, "loop", "copies", F.col("fingerprint").alias("next"))
    taken = texts.join(given, KEY).select(*KEY, "loop", F.char_length("text").cast("long").alias("n_chars"), F.concat(F.expr("left(text, char_length(text) - take)"), "beginning").alias("edited"))
    after = fingerprints(taken, [*KEY, "loop"], "edited").withColumnRenamed("fingerprint", "after")
    facts = taken.select(*KEY, "loop", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    # Rows of a version meet where its key was dealt: loop isn't among the keys, which would deal them anew.
    met = facts.join(own, KEY)
    for more in (after.withColumnRenamed("loop", "loop_"), following.withColumnRenamed("loop", "loop_")):
        met = met.join(more, KEY).where(F.col("loop").cast("int") - F.col("loop_").cast("int") == 0).drop("loop_")
    many = F.sequence(F.lit(0).cast("long"), (F.col("copies") - 1).bitwiseAND(F.lit(-TOGETHER)), F.lit(TOGETHER).cast("long"))
    id_ = F.when(~F.col("none"), F.bitwise_not("down")).alias("doc_id")
    rows = met.select(id_, "n_chars", "edited_sha256", F.col("fingerprint").alias("own"), F.col("after").alias("edited"), "next", "copies", F.explode(many).alias("from"))
    here = F.least(F.col("copies") - F.col("from"), F.lit(TOGETHER)).cast("int")
    return rows.select("doc_id", "n_chars", "edited_sha256", "own", "edited", "next", F.explode(F.array_repeat(F.lit(0), here)).alias("_")).drop("_")


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    found = edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
