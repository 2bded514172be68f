"""Readers: VCF, GFF3, FASTA, tabular BLAST, JSON lines and delimited metadata as DataFrames. Missing is NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from allelix.functions.lineage import fixed, once
from allelix.functions.scalars import analysis_group, attributes, chunk_coordinates, format_index, gt_dosage, hsp_orientation, hsp_target, seqid
from allelix.sources import ranges

BLAST_SCHEMA = "query string, qlen long, qstart long, qend long, target string, slen long, sstart long, send long, pident double, length long, bitscore double, evalue double"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of a file or folder; compressed ones (.gz, .bgz) are read by ranges where they are in blocks."""
    return ranges.compressed_lines(spark, path).select("value") if path.lower().endswith((".gz", ".bgz")) else spark.read.text(path)


def vcf_header(text: DataFrame) -> tuple[list[str], DataFrame, DataFrame]:
    """(sample names, contigs (contig, length or NULL), fields of ## lines). Lines that start with # are taken out once,
    in one pass over the text, and all parts come from these."""
    text = fixed(text.where(F.col("value").startswith("#")))
    head = text.where(F.col("value").startswith("#CHROM")).limit(1).collect()
    names = head[0]["value"].rstrip("\r\n").split("\t")[9:] if head else []
    if not names:
        raise ValueError("a VCF without samples")
    meta = text.where(F.col("value").startswith("##"))
    contigs = meta.where(F.col("value").startswith("##contig=<")).select(
        F.nullif(F.regexp_extract("value", "ID=([^,>]+)", 1), F.lit("")).alias("contig"), F.regexp_extract("value", r"length=(\d+)", 1).try_cast("long").alias("length")
    ).where("contig is not null")
    fields = meta.where(~F.col("value").startswith("##contig=<")).select(F.regexp_extract("value", "^##([^=]+)=", 1).alias("field"), F.regexp_replace("value", "^##[^=]+=", "").alias("value"))
    return names, contigs, fields


def vcf_records(text: DataFrame, short: bool = False) -> DataFrame:
    """contig, pos, ref, alt, filter, format, samples of lines with ten fields or more; short: of all lines, with NULLs
    where one has fewer."""
    f = F.split("value", "\t")
    rows = text.where(~F.col("value").startswith("#")).select(once(f).alias("f"))
    whole = F.size("f") >= 10
    if not short:
        rows = rows.where(whole)
    at = lambda k: F.when(whole, F.get("f", F.lit(k)))
    samples = F.when(whole, F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))))
    return rows.select(at(0).alias("contig"), at(1).try_cast("long").alias("pos"), at(3).alias("ref"), at(4).alias("alt"), at(6).alias("filter"), at(8).alias("format"), samples.alias("samples"))


def dosages(records: DataFrame, columns: Sequence[int]) -> DataFrame:
    """Records with ``dosages``: the panel's calls, by sample columns (from 0)."""
    gt = format_index("format", "GT")
    picked = F.array(*[F.get("samples", F.lit(c)) for c in columns])
    return records.withColumn("_gt", gt).withColumn("dosages", F.transform(picked, lambda s: gt_dosage(s, F.col("_gt")))).drop("_gt")


def long_cells(records: DataFrame, site: str, samples: DataFrame) -> DataFrame:
    """One row for each site and sample. samples: place (from 0 in dosages), sample_id, grp; a panel's rows."""
    flat = records.select(F.col(site).alias("site_id"), "contig", "pos", "ref", "alt", F.posexplode("dosages").alias("place", "dosage"))
    return flat.join(samples, "place").drop("place")


def gff3(text: DataFrame, exact_fields: bool = False) -> DataFrame:
    """seqid, type, start, end, strand, attributes (map) and raw_attributes of feature lines."""
    f = F.split("value", "\t")
    size = (F.size("f") == 9) if exact_fields else (F.size("f") >= 9)
    rows = text.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(f.alias("f")).where(size)
    at = lambda k: F.get("f", F.lit(k))
    return rows.select(seqid(at(0)).alias("seqid"), F.lower(at(2)).alias("type"), at(3).try_cast("long").alias("start"), at(4).try_cast("long").alias("end"), at(6).alias("strand"), attributes(at(8)).alias("attributes"), at(8).alias("raw_attributes"))


def genes(features: DataFrame) -> DataFrame:
    """Gene rows with their fallbacks: ID or gene_id; Name, gene or gene_name; product, description or Note."""
    first = lambda *keys: F.coalesce(*[F.try_element_at("attributes", F.lit(k)) for k in keys], F.lit(""))
    return features.where("type = 'gene'").select("seqid", "start", "end", "strand", first("ID", "gene_id").alias("gene_id"), first("Name", "gene", "gene_name").alias("gene_name"), first("product", "description", "Note").alias("product"), "raw_attributes")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """record_id, description, sequence, length; a record is a row. Lengths and chunks of longer ones come from
    ranges.fasta_pieces()."""
    return ranges.whole_records(ranges.fasta_pieces(spark, path))


def blast(spark: SparkSession, path: str) -> DataFrame:
    """Hits with the source and target coordinates their chunk names imply."""
    raw = spark.read.schema(BLAST_SCHEMA).option("sep", "\t").csv(path)
    rows = raw.withColumn("_c", chunk_coordinates("query")).withColumn("_t", hsp_target("sstart", "send"))
    return rows.select(*raw.columns, F.col("_c.chunk").alias("chunk"), (F.col("_c.start") + F.col("qstart") - 1).alias("source_start"), (F.col("_c.start") + F.col("qend") - 1).alias("source_end"), F.col("_t.start").alias("target_start"), F.col("_t.end").alias("target_end"), F.col("_t.strand").alias("strand"), seqid("target").alias("target_seqid"))


def supported(hits: DataFrame, identity: float = 98.0, length: int = 10_000) -> DataFrame:
    return hits.where((F.col("pident") >= identity) & (F.col("length") >= length))


def on_chunks(hits: DataFrame, chunks: DataFrame, identity: float = 0.0, length: int = 0) -> DataFrame:
    """Hits whose chunks' places come from a table (query, source_start) and not from their names: source and target
    spans in order, and the orientation of both directions together. A chunk that the table lacks gives NULLs."""
    kept = hits.where((F.col("pident") >= identity) & (F.col("length") >= length))
    met = kept.join(chunks.select("query", F.col("source_start").alias("_at")), "query", "left")
    way = hsp_orientation("qstart", "qend", "sstart", "send")
    return met.select(*hits.columns, (F.col("_at") + F.least("qstart", "qend") - 1).alias("source_hsp_start"), (F.col("_at") + F.greatest("qstart", "qend") - 1).alias("source_hsp_end"), F.least("sstart", "send").alias("target_hsp_start"), F.greatest("sstart", "send").alias("target_hsp_end"), F.when(way >= 0, "+").otherwise("-").alias("orientation"))


def intervals(spark: SparkSession, path: str | None, default: Sequence[tuple]) -> DataFrame:
    """The analysis intervals of a CSV, or the default rows."""
    schema = "subgenome string, source_contig string, source_start long, source_end long, expected_target_seqid string, expected_target_label string"
    return spark.read.schema(schema).option("header", True).csv(path) if path else spark.createDataFrame(list(default), schema)


def jsonl_inventory(text: DataFrame, paths: Sequence[str], alias_keys: Sequence[str] = ("name", "alias", "synonym")) -> DataFrame:
    """One row: records, the first record's values at the paths, and whether any record has, at any depth, a key that
    speaks of a sequence's name, alias or synonym. Strings are told from keys by the colon behind them."""
    strings = F.regexp_extract_all("value", F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?'), F.lit(0))
    low = F.transform(strings, lambda x: F.lower(x))
    named = F.exists(low, lambda x: x.endswith(":") & x.contains("sequence") & x.rlike("|".join(alias_keys)))
    some = text.where(F.trim("value") != "").withColumn("_at", F.monotonically_increasing_id())
    first = F.min_by("value", "_at")
    return some.agg(F.count("*").alias("n_records"), first.alias("_first"), F.coalesce(F.bool_or(named), F.lit(False)).alias("has_alias")).select("n_records", *[F.get_json_object("_first", p).alias(p.split(".")[-1]) for p in paths], "has_alias")


def metadata(spark: SparkSession, path: str, renames: dict[str, str], required: Sequence[str]) -> DataFrame:
    """Delimited metadata with columns renamed, required ones checked, text trimmed and the analysis group derived."""
    raw = spark.read.option("header", True).csv(path)
    named = raw.withColumnsRenamed({k: v for k, v in renames.items() if k in raw.columns})
    missing = [c for c in required if c not in named.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    trimmed = named.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in named.columns])
    return trimmed.withColumn("analysis_group", analysis_group("species_name", "variety"))


def gatk_fields(text: DataFrame, n_samples: int) -> DataFrame:
    """field, value of a VCF's header: the format, counts of samples and contigs, and versions, ploidies and reference
    paths of the two GATK commands ('' where a line or a part of it isn't there; the last of repeated lines counts)."""
    meta = text.where(F.col("value").startswith("##"))
    at = lambda prefix: F.when(F.col("value").startswith(prefix), F.col("value"))
    calls, haps = "##GATKCommandLine.GenotypeGVCFs", "##GATKCommandLine.HaplotypeCaller"
    one = meta.withColumn("_at", F.monotonically_increasing_id()).agg(*[F.max_by(at(p), F.when(at(p).isNotNull(), F.col("_at"))).alias(n) for n, p in (("f", "##fileformat="), ("g", calls), ("h", haps))], F.count_if(F.col("value").startswith("##contig=")).alias("c"))
    part = lambda c, pattern: F.coalesce(F.regexp_extract(c, pattern, 1), F.lit(""))
    fields = {
        "fileformat": F.trim(F.coalesce(F.regexp_replace("f", "^[^=]*=", ""), F.lit(""))),
        "sample_count": F.lit(n_samples),
        "contig_count": F.col("c"),
        "GenotypeGVCFs_version": part("g", "Version=([^,>]+)"),
        "HaplotypeCaller_version": part("h", "Version=([^,>]+)"),
        "GenotypeGVCFs_sample_ploidy": part("g", "sample_ploidy=([0-9]+)"),
        "HaplotypeCaller_sample_ploidy": part("h", "sample_ploidy=([0-9]+)"),
        "combined_reference_path": part("g", "reference_sequence=([^ ]+)"),
        "subgenome_reference_path": part("h", "reference_sequence=([^ ]+)"),
    }
    return one.select(*[v.cast("string").alias(k) for k, v in fields.items()]).unpivot([], list(fields), "field", "value")


def regions_and_genes(text: DataFrame, subgenome: str) -> tuple[DataFrame, DataFrame]:
    """Region and gene features of lines with exactly nine fields: (seqid, start, end, length, subgenome,
    chromosome_label, region_name), (seqid, start, end, strand, gene_id, gene_name, description, gene_biotype,
    subgenome). A file without either is an error."""
    rows = gff3(text, exact_fields=True)
    value = lambda k: F.try_element_at("attributes", F.lit(k))
    regions = rows.where("type = 'region'").select("seqid", "start", "end", (F.col("end") - F.col("start") + 1).alias("length"), F.lit(subgenome).alias("subgenome"), value("chromosome").alias("chromosome_label"), value("Name").alias("region_name"))
    named = F.coalesce(F.nullif(value("gene"), F.lit("")), F.nullif(value("Name"), F.lit("")), value("ID"))
    found = rows.where("type = 'gene'").select("seqid", "start", "end", "strand", value("ID").alias("gene_id"), named.alias("gene_name"), F.coalesce(value("description"), F.lit("")).alias("description"), value("gene_biotype").alias("gene_biotype"), F.lit(subgenome).alias("subgenome"))
    for kind, df in (("region", regions), ("gene", found)):
        if df.isEmpty():
            raise ValueError(f"no {kind} rows")
    return regions, found


def on_blocks(features: DataFrame, blocks: DataFrame, width: int = 100_000) -> DataFrame:
    """Genes (seqid, start, end, …) that share a position with a block (seqid, start, end) of their sequence."""
    from allelix.operators.intervals import overlapping

    a = features.withColumnsRenamed({"start": "a_start", "end": "a_end"})
    hit = overlapping(a, blocks.select("seqid", F.col("start").alias("b_start"), F.col("end").alias("b_end")), "seqid", width, "left_semi")
    return hit.withColumnsRenamed({"a_start": "start", "a_end": "end"})


def contig_inventory(*tables: DataFrame) -> DataFrame:
    """Distinct rows of contig tables (contig_id, contig_length) with letter, subgenome, is_major and scaffold_token
    taken from their names."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    pattern = "^chr_([A-L])_sg_([CE])_"
    part = lambda p, k: F.nullif(F.regexp_extract("contig_id", p, k), F.lit(""))
    return out.distinct().select("contig_id", "contig_length", part(pattern, 1).alias("letter"), F.concat(F.lit("sg"), part(pattern, 2)).alias("subgenome"), F.coalesce(F.col("contig_id").rlike(pattern), F.lit(False)).alias("is_major"), part(r"(Scaffold_\d+;HRSCAF_\d+)", 1).alias("scaffold_token"))


def with_coordinates(meta: DataFrame) -> DataFrame:
    """Metadata with has_latitude, has_longitude, has_altitude, and order as a number (NULL where it is none)."""
    flags = {f"has_{name}": F.col(c).isNotNull() for name, c in (("latitude", "Latitude"), ("longitude", "Longitude"), ("altitude", "altitude"))}
    return meta.withColumns(flags).withColumn("order", F.col("order").try_cast("double"))


def priorities(spark: SparkSession, path: str | None, default: Sequence[str]) -> DataFrame:
    """display_order, accession from a CSV (in its order without that column), or the default list."""
    if path is None:
        return spark.createDataFrame(list(enumerate(default, 1)), "display_order int, accession string")
    raw = spark.read.option("header", True).csv(path)
    if "accession" not in raw.columns:
        raise ValueError(f"{path}: no column accession")
    order = F.col("display_order").try_cast("int") if "display_order" in raw.columns else F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
    return raw.where("accession is not null").select(order.alias("display_order"), F.trim("accession").alias("accession"))


def contexts(spark: SparkSession, path: str | None, required: Sequence[str]) -> DataFrame:
    """A CSV with required columns, trimmed; an empty table of these without a path."""
    if path is None:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in required))
    raw = spark.read.option("header", True).csv(path)
    missing = sorted(set(required) - set(raw.columns))
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return raw.withColumn(required[0], F.trim(F.col(f"`{required[0]}`")))


def wide_matrix(spark: SparkSession, path: str) -> DataFrame:
    """row, col, value of a CSV whose first column and header name its rows and columns; what is no number is NULL."""
    raw = spark.read.option("header", True).csv(path)
    first, *rest = raw.columns
    text = raw.select(F.col(f"`{first}`").cast("string").alias("row"), *[F.col(f"`{c}`") for c in rest])
    return text.unpivot(["row"], [F.col(f"`{c}`") for c in rest], "col", "value").select("row", "col", F.col("value").try_cast("double").alias("value"))


def fasta_record(records: DataFrame, record_id: str) -> DataFrame:
    """The first record of that name, or no row."""
    return records.where(F.col("record_id") == record_id).limit(1)
