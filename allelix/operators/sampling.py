"""Samples that repeat exactly: bottom-k by a 64-bit hash of the site, and a replayed reservoir."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelix.functions.lineage import fixed

U = np.uint64


def fnv1a64(text: str) -> int:
    """FNV-1a over UTF-8 bytes."""
    h = 0xCBF29CE484222325
    for byte in text.encode():
        h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def splitmix64(v: np.ndarray) -> np.ndarray:
    z = v + U(0x9E3779B97F4A7C15)
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


def priority_key(seed: int):
    """A pandas UDF of (contig, pos, ref, alt): the site's 64-bit key, its sign bit flipped so that signed order is
    the key's unsigned order."""

    @F.pandas_udf("long")
    def key(contig: pd.Series, pos: pd.Series, ref: pd.Series, alt: pd.Series) -> pd.Series:
        hashed = lambda s: s.map({x: fnv1a64(x) for x in s.unique()}).to_numpy(dtype=U)
        z = hashed(contig) ^ (pos.to_numpy().astype(U) * U(0xD6E8FEB86659FD93)) ^ hashed(ref + ">" + alt) ^ U(seed)
        return pd.Series((splitmix64(z) ^ U(1 << 63)).astype(np.int64))

    return key


def bottom_k(sites: DataFrame, k: int, seed: int) -> DataFrame:
    """The k sites of least key, in that order (place from 1): samples of growing k are nested. Sites' k least are
    found in every task before they meet."""
    key = priority_key(seed)("contig", "pos", "ref", "alt")
    least = sites.withColumn("priority", key).orderBy("priority", "site_id").limit(k)
    return least.withColumn("place", F.row_number().over(Window.orderBy("priority", "site_id")))


def nested(sample: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """The sample's prefixes as conditions: rows with panel_size, for each size that they belong to."""
    each = F.explode(F.filter(F.array(*map(F.lit, sizes)), lambda n: F.col("place") <= n))
    return sample.withColumn("panel_size", each)


#: Random words that are looked at together.
WORDS = 1 << 20


def _words(seed: int):
    """CPython's generator for a seed, as one that gives arrays of its 32-bit words."""
    key = random.Random(seed).getstate()[1]
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(key[:-1], np.uint32), "pos": key[-1]}}
    return bits


def reservoir_slots(n: int, k: int, seed: int) -> dict[int, int]:
    """slot -> ordinal (from 0) of what a reservoir of k holds after n records."""
    return {i: i for i in range(min(n, k))} | replaced(k, n, k, seed)


def replaced(i: int, n: int, k: int, seed: int) -> dict[int, int]:
    """slot -> the last of records i to n - 1 that takes it: where CPython's randint(0, i) would give a slot below k, for
    one record after the other, from blocks of random words.

    A draw below m takes as many leading bits of a word as m has (of two words, beyond 32) and is made again where it
    isn't below m. m grows with every draw that is taken, so which are taken is found by counting those before, again
    until nothing changes: each time more of the block's beginning is settled."""
    slots: dict[int, int] = {}
    bits = _words(seed)
    held = np.zeros(0, np.uint64)
    while i < n:
        width = (i + 1).bit_length()
        each = 1 if width <= 32 else 2
        if len(held) < each:
            held = np.concatenate([held, bits.random_raw(WORDS)])
        whole = held[: len(held) // each * each].astype(np.uint64)
        if each == 1:
            drawn = (whole >> np.uint64(32 - width)).astype(np.int64)
        else:
            drawn = (whole[::2] | ((whole[1::2] >> np.uint64(64 - width)) << np.uint64(32))).astype(np.int64)
        taken = drawn < i + 1
        while True:
            before = np.cumsum(taken) - taken
            now = drawn < i + 1 + before
            if (now == taken).all():
                break
            taken = now
        # As far as the number of bits stays the same, and records are left.
        spots = np.flatnonzero(taken)[: min(n, (1 << width) - 1) - i]
        for at in np.flatnonzero(drawn[spots] < k).tolist():
            slots[int(drawn[spots[at]])] = i + at
        done = len(spots)
        ended = i + done >= min(n, (1 << width) - 1)
        used = (int(spots[-1]) + 1 if done else 0) if ended else len(drawn)
        held, i = held[used * each :], i + done
    return slots


def reservoir(rows: DataFrame, ordinal: str, k: int, seed: int) -> DataFrame:
    """The rows a sequential reservoir of k would hold, with their slot. ordinal: a column of 0, 1, … in record order.
    The driver replays decisions, not rows: k numbers are kept, and shipped as a join."""
    spark: SparkSession = rows.sparkSession
    slots = reservoir_slots(rows.count(), k, seed)
    held = spark.createDataFrame(pd.DataFrame({"slot": list(slots.keys()), "_at": list(slots.values())}, dtype="int64"), "slot long, _at long")
    return rows.join(F.broadcast(held), F.col(ordinal) == F.col("_at")).drop("_at")


def ordinals(rows: DataFrame, order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """0, 1, … in a given total order, without one task that sees all rows: ranges are sorted on their own, and start
    behind the ranges before them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fixed(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    placed = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row for each range.
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_part", "_at", "_before")
