"""Text read by ranges: block-compressed gzip by many tasks, and FASTA records that reach over any number of splits."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelix.functions.lineage import fixed
from allelix.sources.streams import seekable

#: Compressed bytes of a file that a task reads at least, and at most that a block of block-compressed gzip has.
RANGE, BLOCK = 32 << 20, 1 << 16
#: An empty block, which ends a file.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Characters of a sequence's piece, about.
PIECE = 1 << 20
#: Lines of a batch that goes back to Spark, and their bytes, about.
ROWS, BYTES = 8_192, 4 << 20


def block_size(head: bytes) -> int:
    """Bytes of the block that begins with head, 0 where head isn't the beginning of one."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    extra = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]]
    at = 0
    while at + 4 <= len(extra):
        length = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"BC" and length == 2 and at + 6 <= len(extra):
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + length
    return 0


def _at(stream, where: int, length: int) -> bytes:
    stream.seek(where)
    return stream.read(length)


def first_block(stream, start: int, size: int) -> int:
    """Where the first block at or behind start begins; size (the file's) where there is none. A place counts if the
    blocks from there on follow each other: three of them, or up to the file's end."""
    if start == 0:
        return 0
    # A block is no longer than BLOCK, so one begins in here, and three more behind it.
    held = _at(stream, start, 5 * BLOCK)
    at = held.find(b"\x1f\x8b\x08\x04")
    while 0 <= at < 2 * BLOCK:
        place = at
        for _ in range(4):
            if place == at or start + place < size:
                step = block_size(held[place : place + BLOCK])
                if not step:
                    break
                place += step
        else:
            return start + at
        at = held.find(b"\x1f\x8b\x08\x04", at + 1)
    return size


def _inflated(block: bytes, path: str) -> bytes:
    try:
        reader = zlib.decompressobj(31)
        text = reader.decompress(block)
    except zlib.error as e:
        raise ValueError(f"{path}: a damaged block: {e}") from e
    if not reader.eof:
        raise ValueError(f"{path}: ends within a block")
    return text


def _blocks(stream, at: int, size: int, path: str) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the blocks from one on."""
    while at < size:
        held = _at(stream, at, BLOCK)
        step = block_size(held)
        if not step or at + step > size:
            raise ValueError(f"{path}: ends within a block")
        yield at, _inflated(held[:step], path)
        at += step


def _members(stream, path: str) -> Iterator[bytes]:
    """Text of gzip that isn't in blocks, from its beginning; members may follow each other."""
    stream.seek(0)
    reader, open_ = zlib.decompressobj(31), False
    while data := stream.read(1 << 20):
        while data:
            open_ = True
            try:
                yield reader.decompress(data)
            except zlib.error as e:
                raise ValueError(f"{path}: damaged: {e}") from e
            data = b""
            if reader.eof:
                data, reader, open_ = reader.unused_data, zlib.decompressobj(31), False
    if open_:
        raise ValueError(f"{path}: ends within a member")


def range_text(path: str, start: int, end: int, size: int) -> Iterator[bytes]:
    """Text of the lines that belong to a range of a compressed file. A line belongs to the range that the text before
    it ends in: a range leaves out what comes before its first line's end, and reads on behind its own blocks to the end
    of the line it is in. Gzip without blocks can't be entered midway and belongs to the first range."""
    with seekable(path) as stream:
        if not block_size(_at(stream, 0, BLOCK)):
            if start == 0:
                yield from _members(stream, path)
            return
        begun = start == 0
        for at, text in _blocks(stream, first_block(stream, start, size), size, path):
            inside = at < end
            if not begun:
                if not inside:
                    return
                cut = text.find(b"\n")
                if cut < 0:
                    continue
                begun, text = True, text[cut + 1 :]
            if not inside:
                cut = text.find(b"\n")
                yield text if cut < 0 else text[: cut + 1]
                if cut >= 0:
                    return
            else:
                yield text


def _lines(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Lines without their ends; the last may have none."""
    kept: list[bytes] = []
    for part in parts:
        *whole, rest = part.split(b"\n")
        if whole:
            yield b"".join([*kept, whole[0]])
            yield from whole[1:]
            kept = []
        if rest:
            kept.append(rest)
    if kept:
        yield b"".join(kept)


def compressed_lines(spark: SparkSession, path: str, each: int = RANGE) -> DataFrame:
    """file, start (of a range), at (within it), value: the lines of gzip files. Files in blocks are read by a task for
    each range of so many bytes, others by a task each. What isn't UTF-8 becomes U+FFFD; carriage returns at line ends
    go. A truncated or damaged file is an error."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(each).cast("long"))).alias("start"))
    # A row for each range; as many tasks, up to a bound.
    dealt = ranges.repartition(max(1, min(10_000, ranges.count())), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held: list[str] = []
                at = size = 0

                def packed(file: str = row["path"], start: int = row["start"]) -> pa.RecordBatch:
                    n = len(held)
                    return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array([start] * n), pa.array(np.arange(at - n, at)), pa.array(held, pa.string())], names=["file", "start", "at", "value"])

                for line in _lines(range_text(row["path"], row["start"], row["start"] + each, row["length"])):
                    held.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    at += 1
                    size += len(line)
                    if len(held) >= ROWS or size >= BYTES:
                        yield packed()
                        held, size = [], 0
                if held:
                    yield packed()

    return dealt.select("path", "start", "length").mapInArrow(run, "file string, start long, at long, value string")


def block_compressed(text: bytes, level: int = 6) -> Iterator[bytes]:
    """Blocks of text, without the last empty one."""
    for k in range(0, len(text), 0xFF00):
        part = text[k : k + 0xFF00]
        packer = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = packer.compress(part) + packer.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25)
        yield head + body + struct.pack("<II", zlib.crc32(part), len(part))


def write_block_compressed(lines: DataFrame, path: str) -> None:
    """Lines (value) as .gz files in blocks, one for each partition, under a folder that must not be there. Spark writes
    the blocks as rows of a binary table; a task joins each of its files into one, under a new name that it takes last."""
    from allelix.sources.streams import folder

    spark = lines.sparkSession
    folder(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from allelix.sources.streams import moved, sink

        context = TaskContext.get()
        name, held = f"{path}/part-{context.partitionId():05d}.gz", b""
        attempt = f"{path}/_{context.partitionId()}-{context.taskAttemptId()}"
        with sink(attempt) as out:
            for batch in batches:
                held += b"".join(v.encode() + b"\n" for v in batch.column(0).to_pylist())
                whole = len(held) // 0xFF00 * 0xFF00
                for block in block_compressed(held[:whole]):
                    out.write(block)
                held = held[whole:]
            for block in block_compressed(held):
                out.write(block)
            out.write(END)
        moved(attempt, name)
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    lines.select("value").mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def located_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of a split or range), value: lines, those of one split in order."""
    if path.lower().endswith((".gz", ".bgz")):
        return compressed_lines(spark, path).select("file", "start", "value")
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def fasta_pieces(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """file, record (its number in the file, from 1), record_id, description, offset, sequence: pieces of records, each
    of about ``piece`` characters at most and of one split; a record without a sequence has one empty piece.

    A line that starts with ">" begins a record, whatever else it holds; text before the first is no record's. Tasks cut
    the lines of their split into pieces; which record a split begins in, and how far in, is carried over the splits of
    a file, of which there is a row each. So a record may be longer than a split, or than a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: list[str] = []
        split, heads, head, local, size, at, shown = None, 0, None, 0, 0, 0, True

        def cut() -> None:
            nonlocal local, size, at, shown
            if held or not shown:
                rows.append((*split, at, heads, head, local, size, "".join(held)))
                held.clear()
                local, size, at, shown = local + size, 0, at + 1, True

        def packed() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "start", "at", "heads", "head", "local", "size", "sequence"])

        for batch in batches:
            for file, start, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, start) != split:
                    if split:
                        cut()
                    split, heads, head, local, size, at, shown = (file, start), 0, None, 0, 0, 0, True
                if line.startswith(">"):
                    cut()
                    heads, head, local, shown = heads + 1, line[1:].strip(), 0, False
                elif text := line.strip():
                    held.append(text)
                    size += len(text)
                    if size >= piece:
                        cut()
                if len(rows) >= 64:
                    yield packed()
                    rows.clear()
        if split:
            cut()
        if rows:
            yield packed()

    cutting = located_lines(spark, path).mapInArrow(run, "file string, start long, at long, heads long, head string, local long, size long, sequence string")
    pieces = fixed(cutting)
    last = F.struct("head", (F.col("local") + F.col("size")).alias("tail"))
    splits = pieces.groupBy("file", "start").agg(F.max("heads").alias("heads"), F.sum("size").alias("size"), F.max_by(last, "at").alias("last"))
    upto = Window.partitionBy("file").orderBy("start")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    summed = splits.withColumn("_end", F.sum("size").over(upto))
    begins = F.col("heads") > 0
    carried = summed.select(
        "file",
        "start",
        F.coalesce(F.sum("heads").over(before), F.lit(0)).alias("_records"),
        F.last(F.when(begins, F.col("last.head")), True).over(before).alias("_head"),
        (F.col("_end") - F.col("size") - F.last(F.when(begins, F.col("_end") - F.col("last.tail")), True).over(before)).alias("_from"),
    )
    met = pieces.join(carried, ["file", "start"])
    full = F.when(F.col("heads") > 0, F.col("head")).otherwise(F.col("_head"))
    offset = F.col("local") + F.when(F.col("heads") > 0, 0).otherwise(F.coalesce("_from", F.lit(0)))
    found = met.select("file", (F.col("_records") + F.col("heads")).alias("record"), full.alias("_full"), offset.alias("offset"), "sequence").where(F.col("_full").isNotNull())
    name = F.regexp_extract("_full", r"^(\S+)", 1)
    return found.select("file", "record", name.alias("record_id"), F.trim(F.regexp_replace("_full", r"^\S+", "")).alias("description"), "offset", "sequence")


def record_lengths(pieces: DataFrame) -> DataFrame:
    """record_id, description, length of each record, without putting any together."""
    reach = F.col("offset") + F.char_length("sequence")
    return pieces.groupBy("file", "record", "record_id", "description").agg(F.max(reach).alias("length")).select("record_id", "description", "length")


def whole_records(pieces: DataFrame) -> DataFrame:
    """record_id, description, sequence, length: records put together, for those that a string may hold (2 GB)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "sequence")))
    whole = pieces.groupBy("file", "record", "record_id", "description").agg(F.array_join(F.transform(parts, lambda p: p["sequence"]), "").alias("sequence"))
    return whole.select("record_id", "description", "sequence", F.char_length("sequence").cast("long").alias("length"))


def record_chunks(pieces: DataFrame, size: int, overlap: int, least: int = 1) -> DataFrame:
    """record_id, chunk_index, chunk_start, chunk_end (1-based), sequence of overlapping chunks, as intervals.chunks cuts
    them, from pieces: no record is put together, and a chunk meets only the pieces it reaches into."""
    step = max(1, size - overlap)
    n = F.char_length("sequence")
    lengths = pieces.groupBy("file", "record").agg(F.max(F.col("offset") + n).alias("length"))
    first = F.greatest(F.lit(0), F.floor((F.col("offset") - size) / step) + 1)
    parts = pieces.where(n > 0).select("file", "record", "record_id", "offset", "sequence", F.explode(F.sequence(first, F.floor((F.col("offset") + n - 1) / step))).alias("k"))
    a = F.greatest(F.col("k") * step, F.col("offset"))
    b = F.least(F.col("k") * step + size, F.col("offset") + n)
    own = parts.select("file", "record", "record_id", "k", a.alias("a"), F.substring("sequence", (a - F.col("offset") + 1).cast("int"), (b - a).cast("int")).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "text"))), lambda p: p["text"]), "")
    whole = own.groupBy("file", "record", "record_id", "k").agg(joined.alias("sequence")).join(lengths, ["file", "record"])
    last = F.greatest(F.lit(0), F.ceil((F.col("length") - size) / step))
    end = F.least(F.col("k") * step + size, F.col("length"))
    kept = whole.where((F.col("k") <= last) & (end - F.col("k") * step >= least))
    return kept.select("record_id", (F.col("k") + 1).alias("chunk_index"), (F.col("k") * step + 1).alias("chunk_start"), end.alias("chunk_end"), "sequence")
