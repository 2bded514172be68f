"""Text read by ranges, against gzip and a plain loop."""

import gzip
import random

import pytest

from allelix.sources import ranges, readers

ALPHABET = "ACGTN>\t ;é"


def text(seed, lines, longest):
    rng = random.Random(seed)
    return "".join("".join(rng.choice(ALPHABET) for _ in range(rng.randrange(longest))) + "\n" for _ in range(lines))


def blocks(data):
    return b"".join(ranges.block_compressed(data)) + ranges.END


def read(spark, path, each):
    return [r["value"] for r in ranges.compressed_lines(spark, path, each).orderBy("file", "start", "at").collect()]


@pytest.mark.parametrize("lines,longest,each", [(6_000, 200, 9_973), (40, 60_000, 20_000), (3, 400_000, 30_000), (1, 5, 7)])
def test_blocks_by_ranges(spark, tmp_path, lines, longest, each):
    """Lines across blocks and ranges, lines longer than a range, and ranges within a block."""
    whole = text(lines, lines, longest)
    path = tmp_path / "a.vcf.gz"
    path.write_bytes(blocks(whole.encode()))
    assert gzip.decompress(path.read_bytes()).decode() == whole
    found = ranges.compressed_lines(spark, str(path), each)
    assert read(spark, str(path), each) == whole.split("\n")[:-1]
    if lines > 100:
        assert found.select("start").distinct().count() > 5


def test_blocks_that_end_with_lines(spark, tmp_path):
    """A range may begin where a line does: the line still comes once."""
    path = tmp_path / "a.gz"
    rows = [f"{k:09d}" for k in range(4_000)]
    path.write_bytes(b"".join(b"".join(ranges.block_compressed(f"{r}\n".encode())) for r in rows) + ranges.END)
    for each in (37, 1_000, 4_096):
        assert read(spark, str(path), each) == rows


def test_false_starts(spark, tmp_path):
    """Bytes that look like a block's beginning within incompressible data."""
    rng = random.Random(3)
    fake = bytes.fromhex("1f8b08040000000000ff0600424302001b00")
    rows = [bytes(rng.randrange(32, 127) for _ in range(70)) for _ in range(3_000)]
    out = b""
    for k in range(0, len(rows), 50):
        (block,) = ranges.block_compressed(b"\n".join(rows[k : k + 50]) + b"\n", level=0)
        out += block
    out += b"".join(ranges.block_compressed(b"x" + fake.replace(b"\n", b"") + b"\n", level=0)) + ranges.END
    path = tmp_path / "a.gz"
    path.write_bytes(out)
    found = read(spark, str(path), 3_001)
    assert len(found) == 3_001
    assert found[:-1] == [r.decode() for r in rows]


def test_plain_gzip_and_damage(spark, tmp_path):
    whole = text(1, 3_000, 90)
    plain = tmp_path / "p.gz"
    plain.write_bytes(gzip.compress(whole[:9_000].encode()) + gzip.compress(whole[9_000:].encode()))
    assert read(spark, str(plain), 5_000) == whole.split("\n")[:-1]
    short = tmp_path / "s.gz"
    short.write_bytes(plain.read_bytes()[:-20])
    cut = tmp_path / "c.gz"
    cut.write_bytes(blocks(whole.encode())[:-60])
    bad = tmp_path / "b.gz"
    data = bytearray(blocks(whole.encode()))
    data[len(data) // 2] ^= 0xFF
    bad.write_bytes(data)
    for path in (short, cut, bad):
        with pytest.raises(Exception, match="ends within|damaged"):
            read(spark, str(path), 1 << 20)
    empty = tmp_path / "e.gz"
    empty.write_bytes(ranges.END)
    assert read(spark, str(empty), 10) == []
    ends = tmp_path / "n.gz"
    ends.write_bytes(blocks(b"a\r\n\nb\xff"))
    assert read(spark, str(ends), 10) == ["a", "", "b�"]


def test_blocks_written_by_spark(spark, tmp_path):
    rows = [(x,) for x in text(5, 5_000, 80).split("\n")[:-1]]
    path = str(tmp_path / "out")
    ranges.write_block_compressed(spark.createDataFrame(rows, "value string").repartition(3), path)
    assert sorted(read(spark, path, 5_000)) == sorted(r[0] for r in rows)
    with pytest.raises(ValueError, match="already"):
        ranges.write_block_compressed(spark.createDataFrame(rows, "value string"), path)


def plain_records(text):
    found, name = [], None
    for line in text.splitlines():
        if line.startswith(">"):
            name = line[1:].strip()
            found.append([name.split(None, 1)[0] if name else "", name.split(None, 1)[1] if " " in name else "", ""])
        elif name is not None:
            found[-1][2] += line.strip()
    return sorted(map(tuple, found))


@pytest.mark.parametrize("piece,split", [(1 << 20, "128m"), (7, "200b"), (50, "61b")])
def test_fasta_by_lines(spark, tmp_path, piece, split):
    """Records over many splits and pieces, headers that hold ">", text before the first, empty records."""
    rng = random.Random(piece)
    out = "ACGT before any\n"
    for k in range(30):
        out += f">r{k}{rng.choice(['', ' G->A variant', ' a > b >> c'])}\n"
        for _ in range(rng.choice([0, 1, 3, 40])):
            out += "".join(rng.choice("ACGTN") for _ in range(rng.randrange(30))) + rng.choice(["\n", " \n", "\n\n"])
    (tmp_path / "a.fa").write_text(out)
    (tmp_path / "b.fa.gz").write_bytes(blocks(out.encode()))
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for c in before:
        spark.conf.set(c, split)
    try:
        for name in ("a.fa", "b.fa.gz"):
            pieces = ranges.fasta_pieces(spark, str(tmp_path / name), piece)
            rows = ranges.whole_records(pieces).collect()
            expected = plain_records(out)
            assert sorted((r["record_id"], r["description"], r["sequence"]) for r in rows) == expected
            assert sorted(map(tuple, ranges.record_lengths(pieces).collect())) == [(a, b, len(s)) for a, b, s in expected]
            chunks = {(r["record_id"], r["chunk_start"]): r["sequence"] for r in ranges.record_chunks(pieces, 20, 5).collect()}
            whole = {a: s for a, _, s in expected}
            wanted = {(a, k * 15 + 1): s[k * 15 : k * 15 + 20] for a, s in whole.items() if s for k in range(max(0, -(-(len(s) - 20) // 15)) + 1)}
            assert chunks == wanted
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_fasta_reader(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 G->A variant\nACGT\nAC\n>r2\nTT")
    rows = readers.fasta(spark, str(tmp_path / "a.fa")).orderBy("record_id").collect()
    assert [tuple(r) for r in rows] == [("r1", "G->A variant", "ACGTAC", 6), ("r2", "", "TT", 2)]
