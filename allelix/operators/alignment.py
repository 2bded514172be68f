"""Alignment hits: coverage and status of mapped intervals, length matching, hotspot overlap and gene support."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelix.functions.lineage import fixed, stored
from allelix.functions.ranking import best_rows, medians, with_average_ranks
from allelix.functions.scalars import CANDIDATES, GENE_LIBRARY, confidence, interval_jaccard, seqid
from allelix.operators import intervals as I
from allelix.operators.linalg import pearson, weighted_mean
from allelix.operators.marts import keyword_hits


#: Positions of a bin of islands.
WIDTH = 10_000


def _best() -> list[Column]:
    return [F.desc("bitscore"), F.desc("length"), F.desc("pident"), F.asc("target"), F.asc("source_start")]


def best_hits(hits: DataFrame, by: Sequence[str]) -> DataFrame:
    """The hit of largest bitscore, length and identity of each key; ties by target and source start. Keys are sorted by
    their hash first, which is cheaper to compare than names."""
    return best_rows(hits.withColumn("_key", F.xxhash64(*by)), ["_key", *by], _best()).drop("_key")


def best_by_target(hits: DataFrame, regions: DataFrame, *columns: str) -> DataFrame:
    """The best hit of each region, query and target, with ``columns`` of its region, _named (whether it has a query) and
    _top (whether it is the best of its region and query too). Hits are dealt once, by region and query, and what is left
    of them is written once, as all measures come from it; regions are broadcast (a report's rows)."""
    own = ["region", "query", "target", "source_start", "source_end", "target_start", "target_end", "strand", "length", "pident", "bitscore"]
    rows = hits.select(*own).join(F.broadcast(regions.select("region", *columns)), "region").repartition("region", "query")
    best = best_hits(rows, ["region", "query", "target"])
    first = F.row_number().over(Window.partitionBy(F.xxhash64("region", "query"), "region", "query").orderBy(*_best()))
    return stored(best.withColumn("_top", first == 1).withColumn("_named", F.col("query").isNotNull()).drop("query", "bitscore"), "hits")


def coverage(best: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Covered source positions of best_by_target()'s rows: by region and target, and by region over all its targets. The
    latter come from the former's islands."""
    islands = fixed(I.merged_binned(best, ["region", "target"], width, "source_start", "source_end"))
    whole = I.union_length(islands, ["region"]).select("region", F.col("covered").alias("all_covered"))
    return islands.groupBy("region", "target").agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered")), whole


def interval_mapping(hits: DataFrame, regions: DataFrame, width: int = WIDTH) -> DataFrame:
    """regions (region, region_start, region_end, expected), hits with region -> one row for each region: dominant
    target, its coverage, weighted identity, target envelope, strands, the largest other coverage, what all targets
    cover together, how many there are, and the status. A region without hits fails. width: of the bins of islands."""
    span = (F.col("region_end") - F.col("region_start") + 1).cast("double")
    regions = fixed(regions)
    best = best_by_target(hits, regions)
    covered, whole = coverage(best, width)
    strand = F.when(F.col("strand") >= 0, "+").otherwise("-")
    # A query has one row for each target.
    shape = best.groupBy("region", "target").agg(weighted_mean("pident", "length").alias("weighted_identity"), F.min("target_start").alias("mapped_start"), F.max("target_end").alias("mapped_end"), F.array_join(F.array_sort(F.collect_set(strand)), ";").alias("strands"), F.count("*").alias("n_hits"), F.count_if("_named").alias("n_chunks"))
    # A row for each region and target.
    by = covered.join(shape, ["region", "target"]).join(medians(best, "pident", ["region", "target"], "median_identity"), ["region", "target"], "left")
    by = fixed(by.join(F.broadcast(regions.select("region", span.alias("_span"))), "region").withColumn("fraction", F.col("covered") / F.col("_span")).drop("_span"))
    first = best_rows(by, ["region"], [F.desc("covered"), F.desc("median_identity"), F.asc("target")]).drop("median_identity").withColumnRenamed("target", "dominant")
    other = by.join(first.select("region", "dominant"), "region").where("target <> dominant").groupBy("region").agg(F.max("fraction").alias("other"))
    whole = whole.join(by.groupBy("region").agg(F.count("*").alias("n_target_contigs")), "region")
    out = regions.join(first, "region", "left").join(other, "region", "left").join(whole, "region", "left")
    share, alt = F.coalesce("fraction", F.lit(0.0)), F.least(F.coalesce("other", F.lit(0.0)), F.lit(1.0))
    fits = F.coalesce(F.regexp_replace(F.lower("dominant"), "[^a-z0-9]", "") == F.regexp_replace(F.lower("expected"), "[^a-z0-9]", ""), F.lit(False))
    identity = F.coalesce("weighted_identity", F.lit(0.0))
    status = F.when(fits & (share >= 0.70) & (alt <= 0.10) & (identity >= 90), "PASS").when(fits & (share >= 0.40) & (identity >= 85), "WARN").otherwise("FAIL")
    return out.select("region", "dominant", fits.alias("expected_match"), F.coalesce("covered", F.lit(0).cast("long")).alias("covered"), share.alias("fraction"), alt.alias("largest_other"), "weighted_identity", "mapped_start", "mapped_end", "strands", F.coalesce("n_hits", F.lit(0).cast("long")).alias("n_hits"), F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"), (F.coalesce("all_covered", F.lit(0)) / span).alias("all_target_fraction"), (F.col("mapped_end") - F.col("mapped_start") + 1).alias("mapped_span"), F.coalesce("n_target_contigs", F.lit(0).cast("long")).alias("n_target_contigs"), status.alias("status"))


def chromosome_support(hits: DataFrame, regions: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for each region: share of queries whose best hit is on the expected target, union coverage there,
    weighted identity, share of forward hits, order correlation, largest other coverage, and the three statuses. width:
    of the bins of islands."""
    regions = fixed(regions.withColumn("_span", (F.col("region_end") - F.col("region_start") + 1).cast("double")))
    best = best_by_target(hits, regions, "expected")
    top = best.where("_top").groupBy("region").agg(F.avg((F.col("target") == F.col("expected")).cast("double")).alias("top_fraction"), F.count("*").alias("n_queries"))
    own = best.where("target = expected")
    shape = own.groupBy("region").agg(weighted_mean("pident", "length").alias("weighted_identity"), F.avg((F.col("strand") >= 0).cast("double")).alias("forward_fraction"))
    middles = own.select("region", ((F.col("source_start") + F.col("source_end")) / F.lit(2.0)).alias("sm"), ((F.col("target_start") + F.col("target_end")) / F.lit(2.0)).alias("tm"))
    order = with_average_ranks(middles, {"sm": "rs", "tm": "rt"}, ["region"]).groupBy("region").agg(pearson("rs", "rt").alias("order_spearman"))
    # A row for each region and target.
    share = coverage(best, width)[0].join(F.broadcast(regions.select("region", "expected", "_span")), "region").withColumn("share", F.col("covered") / F.col("_span"))
    covered = share.where("target = expected").select("region", F.col("share").alias("fraction"))
    other = share.where("target <> expected").groupBy("region").agg(F.max("share").alias("other"))
    out = regions.select("region").join(top, "region", "left").join(shape.join(order, "region"), "region", "left").join(covered, "region", "left").join(other, "region", "left").withColumn("other", F.coalesce("other", F.lit(0.0)))
    chromosome = F.coalesce((F.col("top_fraction") >= 0.95) & (F.col("fraction") >= 0.60) & (F.col("weighted_identity") >= 98) & (F.col("other") <= 0.10) & (F.col("order_spearman") >= 0.95), F.lit(False))
    boundary = F.coalesce((F.col("fraction") >= 0.90) & (F.col("forward_fraction") >= 0.98), F.lit(False))
    return out.select("*", F.when(chromosome, "PASS").otherwise("WARN").alias("chromosome_status"), F.when(boundary, "PASS").otherwise("WARN").alias("boundary_status"), F.when(chromosome & boundary, "PASS").when(chromosome, "WARN").otherwise("FAIL").alias("overall_status"))


def length_matches(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """sources (contig, length), targets (seqid, target_length): for every source the target of least length difference
    relative to the target's length (ties: shorter, then by name), at any distance, the gap to the next best (NULL
    without one) and the confidence. Sources without a positive length, or without any target, are unresolved.

    Every distinct length meets its nearest two targets on each side in a sorted sweep, so nothing is crossed: on
    either side of a source the relative difference grows with the distance."""
    kinds = dict(targets.dtypes)
    v = F.col("length").cast("double")
    marks = targets.where("target_length is not null").groupBy(F.col("target_length").cast("double").alias("_v")).agg(F.min("seqid").alias("_hit"), F.count("*").alias("_n"))
    found = I.neighbours(sources.where("length > 0").select(v.alias("_v")).distinct(), marks)
    rel_to = lambda x: F.abs(x - F.col("_v")) / F.greatest(x, F.lit(1.0))
    below, above = rel_to(F.col("_b._v")), rel_to(F.col("_a._v"))
    lower = F.col("_b").isNotNull() & (F.col("_a").isNull() | (below <= above))
    best = F.when(lower, F.col("_b")).otherwise(F.col("_a"))
    rel = rel_to(best["_v"])
    # The next best: another target of the same length, the other side's nearest, or the one behind.
    second = F.when(best["_n"] > 1, rel).otherwise(F.least(F.when(lower, above).otherwise(below), rel_to(best["_far"])))
    gap = second - rel
    near = found.select("_v", best["_hit"].alias("seqid"), best["_v"].cast(kinds["target_length"]).alias("target_length"), rel.alias("rel_diff"), gap.alias("gap"), confidence(rel, gap).alias("confidence"))
    out = sources.withColumn("_v", v).join(near, "_v", "left")
    return out.select("contig", "length", "seqid", "target_length", "rel_diff", "gap", F.coalesce("confidence", F.lit("unresolved")).alias("confidence"))


def hotspot_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Hotspots (contrast, contig, min_pos, max_pos, n_markers) of two sides on the same contrast and contig, with
    overlap, Jaccard (spans as differences) and what kind of pair it is."""
    other = b.select("contrast", "contig", F.col("min_pos").alias("b_min"), F.col("max_pos").alias("b_max"), F.col("n_markers").alias("n_markers_b"))
    start, end = F.greatest("min_pos", "b_min"), F.least("max_pos", "b_max")
    return a.join(other, ["contrast", "contig"]).select("contrast", "contig", "n_markers", "n_markers_b", F.greatest(end - start, F.lit(0)).alias("overlap_bp"), interval_jaccard("min_pos", "max_pos", "b_min", "b_max").alias("jaccard"), F.when(start <= end, "overlap").otherwise("same_contig").alias("kind"))


def gene_support(hotspots: DataFrame, genes: DataFrame, width: int = 100_000) -> DataFrame:
    """hotspots (hotspot, seqid, a_start, a_end), genes (gene_id, seqid, b_start, b_end, coding, hits, categories):
    genes, coding and keyword genes of each hotspot, and the union of their categories; 0 and '' without any."""
    pairs = I.overlapping(hotspots, genes, "seqid", width)
    items = pairs.select("hotspot", F.explode_outer(F.split("categories", "; ")).alias("item"))
    named = items.where("item <> ''").groupBy("hotspot").agg(F.array_join(F.array_sort(F.collect_set("item")), "; ").alias("categories"))
    counted = pairs.groupBy("hotspot").agg(F.count_distinct("gene_id").alias("n_genes"), F.count_if(F.col("coding")).alias("n_coding"), F.count_if(F.col("hits") > 0).alias("n_keyword"), F.sum("overlap_bp").alias("overlap_bp"))
    out = hotspots.select("hotspot").join(counted, "hotspot", "left").join(named, "hotspot", "left")
    zero = F.lit(0).cast("long")
    return out.select("hotspot", *[F.coalesce(c, zero).alias(c) for c in ("n_genes", "n_coding", "n_keyword", "overlap_bp")], F.coalesce("categories", F.lit("")).alias("categories"))


def gene_overlaps(hotspots: DataFrame, genes: DataFrame, library: Mapping[str, Sequence[str]], width: int = 100_000) -> DataFrame:
    """hotspots (hotspot, seqid, a_start, a_end) and genes (gene_id, seqid, b_start, b_end, gene_name, description,
    gene_biotype) that share a position: the overlap and its share of the hotspot, keyword categories, terms and hits,
    whether the gene codes for a protein, and its priority."""
    pairs = I.overlapping(hotspots, genes, "seqid", width)
    named = pairs.withColumn("_k", keyword_hits(F.concat_ws(" ", F.coalesce("gene_name", F.lit("")), F.coalesce("description", F.lit(""))), library))
    share = F.col("overlap_bp") / F.greatest(F.lit(1).cast("long"), F.col("a_end") - F.col("a_start") + 1)
    out = named.select("hotspot", "gene_id", "seqid", "overlap_start", "overlap_end", "overlap_bp", share.alias("overlap_fraction"), "_k.categories", "_k.terms", "_k.hits", F.coalesce(F.col("gene_biotype") == "protein_coding", F.lit(False)).alias("coding"))
    return gene_priority(out)


def candidate_genes(genes: DataFrame, pattern: str = CANDIDATES, library: Mapping[str, Sequence[str]] = GENE_LIBRARY) -> DataFrame:
    """genes (gene_name, product, raw_attributes, …) of which a name, product or attribute matches the pattern, without
    regard to case, with the library's categories and terms in name and product. NULL texts count as empty."""
    text = lambda *columns: F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])
    found = genes.where(text("gene_name", "product", "raw_attributes").rlike(f"(?i){pattern}"))
    return found.withColumn("_k", keyword_hits(text("gene_name", "product"), library)).select(*genes.columns, "_k.categories", "_k.terms", "_k.hits")


def gene_priority(pairs: DataFrame) -> DataFrame:
    """pairs (…, hits, coding, overlap_bp) with the score hits + 0.25 coding + overlap over the largest overlap."""
    top = pairs.agg(F.greatest(F.lit(1).cast("long"), F.max("overlap_bp")).alias("_top"))
    return pairs.crossJoin(F.broadcast(top)).withColumn("priority", F.col("hits") + F.when(F.col("coding"), 0.25).otherwise(0.0) + F.col("overlap_bp") / F.col("_top")).drop("_top")


def routed(hotspots: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """hotspots (contrast, contig, subgenome, min_pos, max_pos) by (subgenome, contig) to crosswalk (subgenome, contig,
    length, seqid, target_length, confidence), positions scaled to the target; unmatched rows keep a status."""
    from allelix.functions.scalars import transferred

    out = hotspots.join(crosswalk, ["subgenome", "contig"], "left")
    direct = F.col("length") == F.col("target_length")
    ends = [F.when(direct, F.col(c).cast("long")).otherwise(transferred(c, "length", "target_length")) for c in ("min_pos", "max_pos")]
    status = F.when(F.col("confidence").isNull(), "no_crosswalk").when(F.col("seqid").isNull(), "no_paired_contig").when(direct, "direct").otherwise("length_scaled")
    return out.select(F.concat_ws("::", "contrast", "contig", "subgenome").alias("hotspot"), "contrast", "contig", "subgenome", "seqid", F.least(*ends).alias("target_start"), F.greatest(*ends).alias("target_end"), F.coalesce("confidence", F.lit("unresolved")).alias("confidence"), status.alias("status"))


_ANYWHERE = -(1 << 62)  # instead of a step of the scale of lengths: at any length


def alias_matches(aliases: DataFrame, records: DataFrame) -> DataFrame:
    """aliases (alias, length, tokens array), records (record_id, description, record_length): the best record of each
    alias by score (100 for the alias in the text, 20 for each token in it, 80 for the same length, 30 for one that
    differs by less than 0.1 %), ties by length difference and record, whether it is the only one with that score, and
    how it was found: alias_and_length from 100 points, exact_length, best_available. Under 50 points an alias is
    unmapped and has no record. Texts, aliases and tokens are compared by their letters and digits (a text with an NC_
    accession by that alone); empty ones name nothing.

    Fifty points take the alias itself, three tokens, or a token beside a fitting length. So an alias meets the stretches
    of a text that have its length, by key, and so do all tokens but the two shortest (of three that are in a text one is
    among these); the others meet only records whose length lies in the alias's part of a logarithmic scale or next to
    it, so that tokens which most texts hold name no candidates by themselves. Candidates are scored by looking into
    their text. Of records that score by length alone only the nearest ones can be best, and a sorted sweep finds these;
    where one of them has a hit in its text too, that row has more points. Best rows are aggregates, so an alias with
    very many hits isn't one task."""
    who, what = ["alias", "length", "tokens"], ["record_id", "description", "record_length"]
    plain = lambda x: F.regexp_replace(F.lower(seqid(x)), "[^a-z0-9]+", "")
    text = plain(F.concat_ws(" ", "record_id", "description"))
    whole = F.coalesce(plain(F.col("alias")), F.lit("")).alias("_name")
    parts = F.coalesce(F.filter(F.transform("tokens", plain), lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>")).alias("_parts")
    a = aliases.groupBy(*who).agg(F.count("*").alias("_na")).select("*", whole, parts)
    r = records.groupBy(*what).agg(F.count("*").alias("_nr"))
    # Longest first; any order serves, long ones are rarer.
    ordered = F.transform(F.reverse(F.array_sort(F.transform("_parts", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))), lambda t: t["t"])
    telling = F.slice(ordered, 1, F.greatest(F.size("_parts") - 2, F.lit(0)))
    anywhere = F.filter(F.concat(F.array("_name"), telling), lambda t: t != "")
    # Lengths that differ by less than 0.1 % lie in one step of this scale or in neighbouring ones.
    step = lambda x: F.when(x > 0, F.floor(F.log(x) / 0.002)).otherwise(F.floor(x) - 10_000_000)
    around = step(F.col("length").cast("double"))
    beside = F.flatten(F.transform("_parts", lambda t: F.transform(F.sequence(around - 1, around + 1), lambda k: F.struct(t.alias("key"), k.alias("step")))))
    keys = F.concat(F.transform(anywhere, lambda t: F.struct(t.alias("key"), F.lit(None).cast("long").alias("step"))), F.coalesce(beside, F.array().cast("array<struct<key:string,step:bigint>>")))
    named = a.select("*", F.explode(F.array_distinct(keys)).alias("_e")).select(*a.columns, F.col("_e.key").alias("_key"), F.col("_e.step").alias("_step"))
    # One row: the lengths that these have.
    sizes = named.agg(F.collect_set(F.when(F.col("_step").isNull(), F.length("_key"))).alias("_anywhere"), F.collect_set(F.when(F.col("_step").isNotNull(), F.length("_key"))).alias("_beside"))
    stretches = lambda n: F.transform(F.sequence(F.lit(1), F.length("_text") - n + 1), lambda i: F.substring(F.col("_text"), i, n))
    cuts = lambda c: F.array_distinct(F.flatten(F.transform(F.filter(c, lambda n: n <= F.length("_text")), stretches)))
    at = r.withColumn("_text", text).join(F.broadcast(sizes)).withColumn("_at", step(F.col("record_length").cast("double")))
    found_in = F.concat(F.transform(cuts("_anywhere"), lambda t: F.struct(t.alias("key"), F.lit(None).cast("long").alias("step"))), F.when(F.col("_at").isNull(), F.array().cast("array<struct<key:string,step:bigint>>")).otherwise(F.transform(cuts("_beside"), lambda t: F.struct(t.alias("key"), F.col("_at").alias("step")))))
    cut = at.select(*what, "_nr", F.explode(found_in).alias("_e")).select(*what, "_nr", F.col("_e.key").alias("_key"), F.coalesce("_e.step", F.lit(_ANYWHERE)).alias("_step"))
    off = F.abs(F.col("record_length") - F.col("length"))
    near = lambda d: F.when(d == 0, 80).when((F.col("length") > 0) & (d / F.nullif(F.col("length").cast("double"), F.lit(0.0)) < 0.001), 30).otherwise(0)
    pairs = named.withColumn("_step", F.coalesce("_step", F.lit(_ANYWHERE))).join(cut, ["_key", "_step"]).select(*a.columns, *r.columns).distinct().withColumn("_text", text)
    points = F.when((F.col("_name") != "") & F.contains(F.col("_text"), F.col("_name")), 100).otherwise(0) + 20 * F.size(F.filter("_parts", lambda t: F.contains(F.col("_text"), t)))
    by_text = pairs.select("alias", "record_id", (points + near(off)).cast("long").alias("score"), off.alias("off"), (F.col("_na") * F.col("_nr")).alias("_n"))

    v = F.col("length").cast("double")
    marks = r.where("record_length is not null").groupBy(F.col("record_length").cast("double").alias("_v")).agg(F.min("record_id").alias("_hit"), F.sum("_nr").alias("_n"))
    found = I.neighbours(a.where("length is not null").select(v.alias("_v")).distinct(), marks)
    sides = found.select("_v", F.explode(F.array("_b", "_a")).alias("_m")).where("_m is not null").select("_v", F.abs(F.col("_m._v") - F.col("_v")).alias("_off"), "_m._hit", "_m._n")
    nearest = a.withColumn("_v", v).join(sides, "_v")
    by_length = nearest.select("alias", F.col("_hit").alias("record_id"), near(F.col("_off")).cast("long").alias("score"), F.col("_off").cast(dict(by_text.dtypes)["off"]).alias("off"), (F.col("_na") * F.col("_n")).alias("_n")).where("score > 0")

    scored = by_text.unionByName(by_length).where("score >= 50").groupBy("alias", "score", "off").agg(F.min("record_id").alias("record_id"), F.sum("_n").alias("_n"))
    best = scored.groupBy("alias").agg(F.min(F.struct((-F.col("score")).alias("score"), "off", "record_id", "_n")).alias("_b"))
    out = aliases.select("alias").distinct().join(best, "alias", "left")
    how = F.when(F.col("_b").isNull(), "unmapped").when(F.col("_b.score") <= -100, "alias_and_length").when(F.col("_b.off") == 0, "exact_length").otherwise("best_available")
    return out.select("alias", "_b.record_id", (-F.col("_b.score")).alias("score"), F.col("_b.off").alias("length_difference"), (F.col("_b._n") == 1).alias("unique"), how.alias("method"))
