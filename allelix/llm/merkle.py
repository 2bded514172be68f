"""Merkle manifest of a dataset, with incremental witnesses.

A document's leaf is the SHA-256 of its fields, each as its byte count, a colon and its value, or "-" where it is null.
Leaves of a language ascend by doc_id; runs of FAN consecutive nodes become the SHA-256 of their digests (in
hexadecimal), level by level while several nodes remain; the languages' roots, nulls first and then by their bytes,
are a tree of the same kind.

`Appender` takes nodes one at a time. A node that joins an open run gets the digests before it as its partial witness,
and each sibling completed later extends the witnesses of all in the run; a full run is a completed subtree, which is
appended a level higher. Witnesses stay with subtrees, so what all leaves below one share is kept once. Only aligned
appends are taken: a subtree of level n where no smaller one is open. Spark deals leaves in aligned blocks of
FAN ** LEVELS, whose roots are further appends, in blocks again, until each tree has one; then witnesses go down the
same blocks, and each task folds its own leaves' up to the root. No task holds more than a block.

Leaves of one language and doc_id are ordered by their digests; repeated rows are leaves of their own. A null doc_id
comes first. Empty tables give no rows. Extra columns are ignored. Witnesses without siblings hash the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelix.llm.common import require, written

FAN, LEVELS = 8, 4
BLOCK = FAN**LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


class Subtree:
    """A completed subtree (or leaf): its digest, the siblings on either side of it so far, and the subtree it is part of."""

    __slots__ = ("above", "digest", "left", "right")

    def __init__(self, digest: bytes):
        self.digest, self.left, self.right, self.above = digest, b"", b"", None

    def witness(self) -> Iterator[tuple[bytes, bytes]]:
        """(siblings before, siblings behind) on each level up to the highest completed subtree."""
        node = self
        while node.above is not None:
            yield node.left, node.right
            node = node.above


class Appender:
    """A tree that grows by appends. ``open[n]`` is the run of completed subtrees of level n that isn't full yet; with
    these alone (`frontier`) a tree can be taken up again later."""

    def __init__(self, frontier: list[list[bytes]] | None = None):
        self.open: list[list[Subtree]] = []
        for level, run in enumerate(frontier or []):
            self.open.append([])
            for d in run:
                self._join(Subtree(d), level)

    def frontier(self) -> list[list[bytes]]:
        return [[node.digest for node in run] for run in self.open]

    def append(self, digest: bytes, level: int = 0) -> Subtree:
        """A completed subtree of the given level (0: a leaf)."""
        if any(self.open[:level]):
            raise ValueError("an append must be aligned: a smaller subtree is still open")
        node = Subtree(digest)
        self._join(node, level)
        return node

    def _join(self, node: Subtree, level: int) -> None:
        while len(self.open) <= level:
            self.open.append([])
        run = self.open[level]
        if run:
            node.left = run[-1].left + run[-1].digest
        for sibling in run:
            sibling.right += node.digest
        run.append(node)
        if len(run) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        above = Subtree(digest(b"".join(node.digest for node in run)))
        for node in run:
            node.above = above
        self._join(above, level + 1)

    def close(self, height: int | None = None) -> Subtree:
        """Completes open runs and returns the root: of the given height, or where one node remains."""
        level = 0
        while level != height:
            rest = sum(map(len, self.open[level:]))
            if height is None and rest == 1 and len(self.open[level]) == 1:
                break
            if level >= len(self.open) or not rest:
                raise ValueError("no node to close")
            if self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0]


def leaf(row: dict[str, Column]) -> Column:
    """A document's digest, of 32 bytes."""

    def field(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[field(row[c]) for c in FIELDS]), 256))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (tree, …) with i, their places in their tree by ``order``, and n, their tree's size."""
    keys = ["tree", *order]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            tree = batch.column(batch.schema.get_field_index("tree"))
            if not len(tree):
                continue
            codes = np.asarray(tree.dictionary_encode().indices)
            begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            at = np.arange(len(codes)) - np.repeat(begins, np.diff(np.r_[begins, len(codes)]))
            first = tree[0].as_py()
            if first == last:
                end = begins[1] if len(begins) > 1 else len(codes)
                at[:end] += seen
            seen, last = int(at[-1]) + 1, tree[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), part)), pa.array(at)], names=[*batch.schema.names, "range", "at"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", range long, at long"
    placed_ = written(dealt.mapInArrow(placed, schema), "merkle-placed")
    # One row for each range and tree in it: ranges are sorted by tree, so there are no more than ranges and trees together.
    counts = placed_.groupBy("range", "tree").agg(F.count("*").alias("size"))
    of = Window.partitionBy("tree")
    starts = counts.select("range", "tree", (F.sum("size").over(of.orderBy("range")) - F.col("size")).alias("start"), F.sum("size").over(of).alias("n"))
    return placed_.join(starts, ["range", "tree"]).withColumn("i", F.col("start") + F.col("at")).drop("range", "at", "start")


def _appended(table: pa.Table, levels: int) -> tuple[list[Subtree], Subtree]:
    """The nodes of a block of so many levels, ascending by i, and its root."""
    tree = Appender()
    nodes = [tree.append(d.hex().encode()) for d in table.column("digest").to_pylist()]
    # A block beside others becomes a node of their level; one alone ends where one node remains.
    return nodes, tree.close(levels if table.column("n")[0].as_py() > FAN**levels else None)


def roots(nodes: DataFrame) -> DataFrame:
    """Nodes of the next blocks up: tree, i, n, digest of each block of nodes (tree, i, n, digest)."""
    levels = LEVELS

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        root = _appended(table, levels)[1]
        i, n = table.column("i")[0].as_py() // FAN**levels, -(-table.column("n")[0].as_py() // FAN**levels)
        return pa.table({"tree": table.column("tree").slice(0, 1), "i": [i], "n": [n], "digest": pa.array([bytes.fromhex(root.digest.decode())], pa.binary())})

    block = F.floor(F.col("i") / BLOCK).alias("block")
    return written(nodes.select("tree", "i", "n", "digest").groupBy("tree", block).applyInArrow(run, "tree string, i long, n long, digest binary"), "merkle-nodes")


def grown(nodes: DataFrame) -> list[DataFrame]:
    """nodes, their blocks, those' blocks, and so on to one node for each tree: log(nodes) / log(BLOCK) steps."""
    levels = [nodes]
    while (levels[-1].agg(F.max("n")).first()[0] or 1) > 1:
        levels.append(roots(levels[-1]))
    return levels


ABOVE = "tree string, i long, lefts array<string>, rights array<string>, subroot string, root string"


def _path(node: Subtree, lefts: list[str], rights: list[str]) -> tuple[list[str], list[str]]:
    own = [(a.decode(), b.decode()) for a, b in node.witness()]
    return [a for a, _ in own] + lefts, [b for _, b in own] + rights


def _met(nodes: DataFrame, above: DataFrame, run, schema: str) -> DataFrame:
    """Each block of nodes with its own witness and roots, in one task."""
    block = F.floor(F.col("i") / BLOCK).alias("block")
    left, right = nodes.select("*", block), above.withColumnRenamed("i", "block")
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(run, schema)


def lowered(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Witnesses of nodes, given those of their blocks."""
    levels = LEVELS

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        table, up = table.sort_by("i"), upper.slice(0, 1).to_pylist()[0]
        paths = [_path(node, up["lefts"], up["rights"]) for node in _appended(table, levels)[0]]
        same = {c: [up[c]] * len(paths) for c in ("subroot", "root")}
        kinds = pa.list_(pa.string())
        found = {"tree": table.column("tree"), "i": table.column("i"), "lefts": pa.array([p[0] for p in paths], kinds), "rights": pa.array([p[1] for p in paths], kinds)}
        return pa.table(found | {c: pa.array(x, pa.string()) for c, x in same.items()})

    return written(_met(nodes.select("tree", "i", "n", "digest"), above, run, ABOVE), "merkle-witnesses")


PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proven(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """PROVEN for leaves (tree, i, n, digest, doc_id, claimed): the hash of all a leaf's siblings, and the root that the
    claimed digest (null: the leaf's own) gives with them."""
    levels = LEVELS

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        table, up = table.sort_by("i"), upper.slice(0, 1).to_pylist()[0]
        upward = [(a.encode(), b.encode()) for a, b in zip(up["lefts"], up["rights"], strict=True)]
        rows: list[tuple] = []
        for doc_id, claimed, node in zip(table.column("doc_id").to_pylist(), table.column("claimed").to_pylist(), _appended(table, levels)[0], strict=True):
            folded = node.digest if claimed is None else claimed.hex().encode()
            siblings = sha256()
            for a, b in (*node.witness(), *upward):
                siblings.update(a + b)
                folded = digest(a + folded + b)
            folded_root = folded.decode()
            rows.append((doc_id, node.digest.decode(), up["subroot"], up["root"], siblings.hexdigest(), folded_root, folded_root == up["root"]))
        kinds = [("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())]
        return pa.table([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds))

    return _met(nodes, above, run, PROVEN)


def manifest(leaves: DataFrame) -> DataFrame:
    """PROVEN for leaves (lang, doc_id, digest, claimed)."""
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    # Rows that repeat are ordered by where they were read, so that many of them are dealt to many ranges.
    rows = written(leaves.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), "digest", "claimed", F.monotonically_increasing_id().alias("spot")), "merkle-leaves")
    nodes = numbered(rows, ["doc_id", "digest", "spot"]).drop("spot")
    below = grown(nodes)
    subroots = below[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    top = grown(written(numbered(subroots, ["of"]), "merkle-subroots"))
    none = F.array().cast("array<string>")
    hex_ = F.lower(F.hex("digest"))
    above = written(top[-1].select("tree", "i", none.alias("lefts"), none.alias("rights"), hex_.alias("subroot"), hex_.alias("root")), "merkle-witnesses")
    for level in reversed(top[:-1]):
        above = lowered(level, above)
    above = above.join(top[0].select("i", "of", hex_.alias("own")), "i").select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("i"), "lefts", "rights", F.col("own").alias("subroot"), "root")
    above = written(above, "merkle-witnesses")
    for level in reversed(below[1:-1]):
        above = lowered(level, above)
    return proven(nodes, above)


LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; a third of them are tampered with afterwards and no longer verify, if that changes them."""
    docs = require(spark.read.parquet(f"{sf_dir}/documents.parquet"), *FIELDS)
    row = {c: F.col(c) for c in FIELDS}
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    claimed = F.when(tampered, leaf(row | {"text": F.translate("text", *LOWER)}))
    return manifest(docs.select("lang", "doc_id", leaf(row).alias("digest"), claimed.alias("claimed")))


def _sql(leaf_levels: int = 9, lang_levels: int = 4) -> str:
    """Trees of up to 8 ** leaf_levels documents in each of up to 8 ** lang_levels languages; a level whose tree has one
    node left repeats it."""

    def fields(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in (*FIELDS[:-1], text)) + ")"

    crc = """xor(list_reduce(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)), 4294967295), 4294967295)"""
    parts = [
        f"""WITH d AS (SELECT coalesce('1' || lang, '0') AS tree, doc_id, {fields("text")} AS leaf,
  CASE WHEN {crc} % 3 = 0 THEN {fields(f"translate(text, '{LOWER[0]}', '{LOWER[1]}')")} END AS claimed FROM documents),
a0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d, count(*) OVER (PARTITION BY tree) AS n, doc_id, claimed FROM d)"""
    ]
    run = "CASE WHEN max(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (max(n) + 7) // 8 AS n, max(n) AS below, list(d ORDER BY i) AS run"
    for k in range(leaf_levels):
        parts.append(f"a{k + 1} AS (SELECT tree, i // 8 AS i, {run} FROM a{k} GROUP BY tree, i // 8)")
    parts.append(f"b0 AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS i, d, count(*) OVER () AS n FROM a{leaf_levels})")
    for k in range(lang_levels):
        parts.append(f"b{k + 1} AS (SELECT i // 8 AS i, {run} FROM b{k} GROUP BY i // 8)")
    parts.append("f0 AS (SELECT tree, i, doc_id, d AS leaf, coalesce(claimed, d) AS cur, '' AS proof FROM a0)")
    before, behind = "array_to_string(run[1:f.i % 8], '')", "array_to_string(run[f.i % 8 + 2:], '')"
    step = f"doc_id, leaf, CASE WHEN below = 1 THEN cur ELSE sha256({before} || cur || {behind}) END AS cur, proof || {before} || {behind} AS proof"
    for k in range(leaf_levels):
        parts.append(f"f{k + 1} AS (SELECT f.tree, f.i // 8 AS i, {step} FROM f{k} f JOIN a{k + 1} p ON p.tree = f.tree AND p.i = f.i // 8)")
    parts.append(f"g0 AS (SELECT b0.i, doc_id, leaf, cur, proof, b0.d AS subroot FROM f{leaf_levels} f JOIN b0 USING (tree))")
    for k in range(lang_levels):
        parts.append(f"g{k + 1} AS (SELECT f.i // 8 AS i, {step}, subroot FROM g{k} f JOIN b{k + 1} p ON p.i = f.i // 8)")
    end = f"SELECT doc_id, leaf, subroot, p.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = p.d AS verified FROM g{lang_levels} g JOIN b{lang_levels} p ON p.i = g.i"
    return ",\n".join(parts) + "\n" + end


OP12_SQL = _sql()
