"""The subgenome-filtered variant analysis, assembled: one parse of a VCF's text gives the filter's audit, the eligible
sites with their dosage arrays, and sampled conditions, which sensitivity.py compares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelix.functions.lineage import once
from allelix.functions.scalars import format_index, gt_dosage, is_biallelic_snp, keeps_contig, subgenome_of
from allelix.operators import sampling
from allelix.sources.readers import vcf_records


def _mean(dosages: Column, places: Sequence[int]) -> Column:
    """Mean allele frequency of the samples at these places of a dosage array; NULL without a call."""
    known = F.filter(F.array(*[F.get(dosages, F.lit(p)) for p in places]), lambda x: x.isNotNull()) if places else F.array().cast("array<int>")
    return F.aggregate(known, F.lit(0.0), lambda a, x: a + x / F.lit(2.0)) / F.nullif(F.size(known), F.lit(0))


def scanned(text: DataFrame, subgenome: str, mode: str, columns: Sequence[int], groups: Sequence[str], compared: tuple[str, str], call_rate: float = 0.80, maf: float = 0.05, short: bool = False) -> DataFrame:
    """Records of a VCF's lines with what the filters say: contig, pos, ref, alt, contig_class, retained, snp, dosages
    (array over the panel), called, call_rate, maf, af_a, af_b, abs_delta_af, eligible.

    columns: the panel's sample columns (from 0); groups: their groups; compared: the two groups of the difference. A
    FORMAT without GT is an error. short: lines of fewer than ten fields come too, as NULLs, for audit() to count."""
    records = vcf_records(text, short)
    has_gt = F.array_contains(F.split("format", ":"), "GT")
    place = F.when(has_gt, format_index("format", "GT")).otherwise(F.raise_error(F.concat(F.lit("FORMAT field without GT: "), "format")).cast("int"))
    kept = F.when(F.col("contig").isNotNull(), keeps_contig("contig", subgenome, mode))
    snp = kept & is_biallelic_snp("ref", "alt")
    rows = records.withColumns({"contig_class": F.when(F.col("contig").isNotNull(), subgenome_of("contig")), "retained": kept, "snp": snp})
    picked = F.transform(F.array(*[F.get("samples", F.lit(c)) for c in columns]), lambda s: gt_dosage(s, F.col("_gt")))
    rows = rows.withColumn("_gt", F.when(F.col("snp"), place)).withColumn("dosages", once(F.when(F.col("snp"), picked)))
    known = F.filter("dosages", lambda x: x.isNotNull())
    rows = rows.withColumn("called", F.size(known)).withColumn("_alt", F.aggregate(known, F.lit(0), lambda a, x: a + x))
    freq = F.col("_alt") / F.nullif(F.lit(2.0) * F.col("called"), F.lit(0.0))
    of = [[k for k, g in enumerate(groups) if g == name] for name in compared]
    rows = rows.withColumns({"call_rate": F.col("called") / F.lit(float(len(columns))), "maf": F.least(freq, 1 - freq), "af_a": _mean(F.col("dosages"), of[0]), "af_b": _mean(F.col("dosages"), of[1])})
    ok = F.col("snp") & (F.col("called") > 0) & (F.col("call_rate") >= call_rate) & (F.col("maf") >= maf)
    return rows.select("contig", "pos", "ref", "alt", "filter", "contig_class", "retained", "snp", "dosages", "called", "call_rate", "maf", "af_a", "af_b", F.abs(F.col("af_a") - F.col("af_b")).alias("abs_delta_af"), F.coalesce(ok, F.lit(False)).alias("eligible"))


def audit(scan: DataFrame, subgenome: str) -> DataFrame:
    """One row of the filter's counters, from one pass. scan: with short lines, which the total counts too."""
    opposite = ~F.col("retained") & F.col("contig_class").isin("sgC", "sgE")
    return scan.agg(
        F.count("*").alias("variant_lines_total"),
        *[F.count_if(F.col("contig_class") == c).alias(f"records_on_{c}_contigs") for c in ("sgC", "sgE", "unassigned")],
        F.count_if(opposite).alias("opposite_subgenome_records_excluded"),
        F.count_if(~F.col("retained") & ~opposite).alias("unassigned_records_excluded"),
        F.count_if("retained").alias("retained_contig_records"),
        F.count_if("snp").alias("biallelic_snp_lines"),
        F.count_if("eligible").alias("eligible_variants"),
    ).select(F.lit(subgenome).alias("subgenome"), "*")


def variant_classes(records: DataFrame) -> DataFrame:
    """The older classification's counters, one row: all alleles of one base and none a star make a SNP."""
    alleles = F.split("alt", ",")
    snp = (F.char_length("ref") == 1) & F.forall(alleles, lambda a: (F.char_length(a) == 1) & (a != "*"))
    both = snp & (F.size(alleles) == 1)
    return records.agg(F.count("*").alias("variant_lines"), F.count_if(snp).alias("snp_variant_lines"), F.count_if(~snp).alias("non_snp_variant_lines"), F.count_if(both).alias("biallelic_snp_variant_lines"), F.count_if(~both).alias("non_biallelic_or_non_snp_variant_lines"))


def conditions(sites: DataFrame, sizes: Sequence[int], seeds: Sequence[int], reservoir: tuple[int, int] | None = None) -> DataFrame:
    """Sites (site_id, contig, pos, ref, alt, …) by condition: for each seed the nested samples of the sizes, and the
    reservoir (size, seed) over sites in order. A sample has no more sites than its size; samples of one seed are
    prefixes of one."""
    out = None
    for seed in seeds:
        ranked = sampling.bottom_k(sites, max(sizes), seed).drop("priority")
        each = sampling.nested(ranked, sizes)
        named = each.withColumn("condition", F.concat(F.lit(f"priority_seed_{seed}_"), "panel_size")).drop("place", "panel_size")
        out = named if out is None else out.unionByName(named)
    if reservoir:
        k, seed = reservoir
        held = sampling.reservoir(sampling.ordinals(sites, [F.col("site_id")]), "ordinal", k, seed).drop("ordinal", "slot")
        named = held.withColumn("condition", F.lit(f"filtered_reservoir_{k}"))
        out = named if out is None else out.unionByName(named)
    if out is None:
        raise ValueError("no seed and no reservoir: nothing to sample")
    return out
