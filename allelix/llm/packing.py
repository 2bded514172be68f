"""Best-fit packing: token pieces into sequences under several capacities at once.

Every piece asks for tokens, one document slot and an attention cost (its length squared). Pieces go, longest first,
into the bin that holds them under every capacity and suits them best: by the least norm of what would stay free, or
by the largest dot product of demand and residual, both weighted. Pieces are dealt by a hash into blocks of some
thousand sequences, and of no more than some hundred thousand pieces, and each block is packed on its own, so no task
ever sees more than a block; a block ends with one bin that isn't full.

Null or empty texts are a document of one token, the end id. Rows that repeat are packed as often as they occur. A
null doc_id is carried. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm.common import require, written

#: Sequences and pieces, about, that are packed together.
BLOCK, PIECES = 4096, 200_000
LONG_RUN = 4000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(4)
def encoder(path: str):
    """text -> unsigned ids, as the tokenizers library encodes by this byte-level file, without special tokens added.

    Merge order and id order agree in such files (checked), so the file's ids serve tiktoken as ranks; that is some
    four times as fast. Unbroken runs of thousands of characters, quadratic there, go to the library itself."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    letters, vocab = byte_alphabet(), model["model"]["vocab"]
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
    order = [vocab["".join(m)] for m in merges]
    if order != sorted(order) or (order and order[0] < 256):
        raise ValueError(f"{path}: ids don't follow the order of merges")
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
    fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()

    def encode(text: str) -> np.ndarray:
        if max(map(len, text.split()), default=0) > LONG_RUN:
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, allowed_special="all")

    return encode


_piece_schema = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """docs (doc_id, text) -> the pieces of every document's ids and end id. Only documents longer than capacity are
    cut, into full pieces after a first one that may be shorter. deal: a number that deals pieces out evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(tokenizer), 0
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                a, b = 0, len(ids) % capacity or min(len(ids), capacity)
                piece = 0
                while a < len(ids):
                    seen += 1
                    deal = zlib.crc32(b"%d %d %d" % (doc or 0, piece, seen)) << 20 ^ seen
                    out.append((doc, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), deal))
                    piece, a, b = piece + 1, b, b + capacity
            names = [x.split()[0] for x in _piece_schema.split(", ")]
            kinds = [pa.int32() if n == "piece" else pa.int64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=names)

    return docs.mapInArrow(run, _piece_schema)


def vector_best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_attention: int, weights=(1.0, 0.01, 0.01), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece; no bin goes beyond capacity tokens, max_docs pieces or max_attention cost.

    rule: "norm" takes the bin whose residual after the piece has the least weighted norm, "dot" the one with the
    largest weighted dot product of demand and residual; ties go to the older bin. A piece whose own attention cost
    is above the capacity stands alone."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"rule {rule!r} is neither norm nor dot")
    limits = np.array([capacity, max_docs, max_attention], float)
    weights = np.array(weights, float)[:, None]
    demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2]) / limits[:, None]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    alone = (lengths[order] >= capacity) | (demand[2][order] >= 1)
    n = int(alone.sum())
    bins[order[alone]] = np.arange(n)
    rest = order[~alone]
    least = lengths[rest[-1]] / capacity if len(rest) else 0
    free, names, used = np.empty((3, 64)), np.empty(64, np.int64), 0
    eps = 1e-9
    for t, k in enumerate(rest):
        d = demand[:, k : k + 1]
        at = -1
        if used:
            left = free[:, :used] - d
            fits = (left > -eps).all(0)
            if fits.any():
                score = (weights * left * left).sum(0) if rule == "norm" else -(weights * d * free[:, :used]).sum(0)
                at = int(np.where(fits, score, np.inf).argmin())
        if at < 0:
            if used == free.shape[1]:
                open_ = np.flatnonzero((free[0, :used] > least - eps) & (free[1, :used] > eps))
                size = max(64, 2 * len(open_))
                more, tags = np.empty((3, size)), np.empty(size, np.int64)
                more[:, : len(open_)], tags[: len(open_)] = free[:, open_], names[open_]
                free, names, used = more, tags, len(open_)
            at, used = used, used + 1
            free[:, at], names[at], n = 1.0, n, n + 1
        bins[k], offsets[k] = names[at], round((1 - free[0, at]) * capacity)
        free[:, at] -= d[:, 0]
    return bins, offsets


def pack(pieces: DataFrame, capacity: int, max_docs: int, max_attention: int, rule: str = "norm", block: int = BLOCK) -> DataFrame:
    """Pieces with sequence_id and offset. block: sequences, about, that are packed together."""
    total, count = pieces.agg(F.sum("length"), F.count("*")).first()
    blocks = max(1, round((total or 0) / capacity / block), -(-count // PIECES))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = vector_best_fit(group["length"].to_numpy(), capacity, max_docs, max_attention, rule=rule)
        return group.assign(sequence_id=group["block"] * (1 << 32) + bins, offset=offsets).drop(columns=["block", "deal"])

    dealt = pieces.withColumn("block", F.pmod("deal", F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = 2048, max_docs: int | None = None, max_attention: int | None = None, rule: str = "norm", end_id: int = 0) -> DataFrame:
    """Tokenises docs (doc_id, text) and packs them. Unset capacities are those that tokens alone imply."""
    docs = require(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    pieces = written(token_pieces(docs, tokenizer, capacity, end_id), "packing-pieces")
    return pack(pieces, capacity, max_docs or capacity, max_attention or capacity * capacity, rule)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packed_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
