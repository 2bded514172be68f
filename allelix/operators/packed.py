"""Genotypes as bit planes: for each site, words of 64 samples that tell who is called and whose dosage reaches 1, 2, ….

Planes come from bitwise aggregates, so a site's calls are combined before the shuffle and stay a few integers for any
panel; counts over groups of samples are AND and popcount."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64
DIPLOID = 2


def _bit(place: int) -> int:
    """The place's bit in its word, as a signed 64-bit number."""
    bit = 1 << (place % WORD)
    return bit - (1 << WORD) if bit >> (WORD - 1) else bit


def words(n: int) -> int:
    return -(-n // WORD)


def packed_sites(cells: DataFrame, samples: Sequence[str], keys: Sequence[str] = ("site_id",), most: int = DIPLOID) -> DataFrame:
    """cells (keys…, sample_id, dosage) -> keys…, planes: array of longs, the words of who is called, then those of who
    has 1, 2, … most. samples: the panel in the order of its places; others, and missing calls, take no part (a site
    with none but these has empty planes). A sample with several calls at a site has the least of them. A dosage outside
    0 to most is an error."""
    spark = cells.sparkSession
    places = spark.createDataFrame([(s, k // WORD, _bit(k)) for k, s in enumerate(samples)], "_s string, _word int, _bit long")
    d = F.col("dosage")
    odd = F.raise_error(F.concat(F.lit(f"dosage outside 0 to {most}: "), d.cast("string"))).cast("int")
    calls = cells.select(*keys, F.col("sample_id").cast("string").alias("_s"), F.when(d.isNull() | d.between(0, most), d.cast("int")).otherwise(odd).alias("_d"))
    rows = calls.join(F.broadcast(places), "_s", "left")
    word = range(words(len(samples)))
    at = lambda w, held: F.coalesce(F.bit_or(F.when(held & (F.col("_word") == w), F.col("_bit"))), F.lit(0).cast("long"))
    called = [at(w, F.col("_d").isNotNull()).alias(f"_c{w}") for w in word]
    # The least call reaches t unless one is below it.
    below = [at(w, F.col("_d") < t).alias(f"_b{t}_{w}") for t in range(1, most + 1) for w in word]
    planes = [F.col(f"_c{w}") for w in word] + [F.col(f"_c{w}").bitwiseAND(F.bitwise_not(F.col(f"_b{t}_{w}"))) for t in range(1, most + 1) for w in word]
    return rows.groupBy(*keys).agg(*called, *below).select(*keys, F.array(*planes).alias("planes"))


def planes_of(dosages: str, n: int, most: int = DIPLOID) -> Column:
    """The planes of an array of n dosages, NULL where a call is missing."""
    bits = F.array(*[F.lit(_bit(k)).cast("long") for k in range(n)])
    zero = F.lit(0).cast("long")

    def plane(least: int) -> list[Column]:
        held = F.zip_with(F.slice(F.col(dosages), 1, n), bits, lambda d, b: F.when(d >= least, b).otherwise(zero))
        return [F.aggregate(F.slice(held, w * WORD + 1, WORD), zero, lambda x, y: x.bitwiseOR(y)) for w in range(words(n))]

    return F.array(*[c for t in range(most + 1) for c in plane(t)])


def as_planes(column: pa.ListArray, n: int, most: int = DIPLOID) -> np.ndarray:
    """An Arrow column of planes as (plane, site, word) unsigned words; plane 0: called."""
    flat = np.asarray(column.flatten()).astype(np.int64, copy=False).view(np.uint64)
    return flat.reshape(len(column), most + 1, words(n)).transpose(1, 0, 2)


def mask(members: np.ndarray, n: int) -> np.ndarray:
    """Places as words; members: (…, k) places, -> (words, …)."""
    held = np.zeros((*members.shape[:-1], words(n) * WORD), bool)
    np.put_along_axis(held, members, True, -1)
    return np.moveaxis(np.packbits(held, axis=-1, bitorder="little").view(np.uint64), -1, 0)


def by_sample(plane: np.ndarray, n: int) -> np.ndarray:
    """A plane of sites (site, word) as (sample, words of 64 sites): the transposed bits."""
    bits = np.unpackbits(np.ascontiguousarray(plane).view(np.uint8), axis=1, bitorder="little")[:, :n]
    short = -len(bits) % WORD
    bits = np.pad(bits, ((0, short), (0, 0)))
    return np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view(np.uint64)
