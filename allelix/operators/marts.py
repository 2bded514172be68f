"""Report marts: quality joins with deltas, marker support, gene and accession shortlists, contrast tables, scored
directions, top regions, and the tables and texts that go into reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelix.functions.ranking import best_rows, percentile_rank, with_facts
from allelix.functions.scalars import sign_label, term_hits
from allelix.operators.sampling import ordinals

RATES = ("het_rate", "call_rate", "nonref_rate")


def quality_asymmetry(sgc: DataFrame, sge: DataFrame, metadata: DataFrame, rates: Sequence[str] = RATES) -> DataFrame:
    """Sample quality of both subgenomes (sample_id, rates, …), joined fully, with metadata (seq_id, …) and the
    differences sgC - sgE; columns carry their subgenome."""
    named = [df.select("sample_id", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "sample_id"]) for df, side in ((sgc, "sgC"), (sge, "sgE"))]
    both = named[0].join(named[1], "sample_id", "full").join(metadata, F.col("sample_id") == F.col("seq_id"), "left")
    return both.select("*", *[(F.col(f"sgC_{r}") - F.col(f"sgE_{r}")).alias(f"delta_{r}") for r in rates])


def rescued_quality(sgc: DataFrame, sge: DataFrame, metadata: DataFrame, least: int, rates: Sequence[str] = RATES) -> DataFrame:
    """The same for samples reconciled to a canonical_id that both have (unresolved ones meet nothing), with whether
    the sample's analysis_group has ``least`` members or more."""
    known = [df.where("canonical_id is not null") for df in (sgc, sge)]
    named = [df.select("canonical_id", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "canonical_id"]) for df, side in zip(known, ("sgC", "sgE"), strict=True)]
    both = named[0].join(named[1], "canonical_id").join(metadata, F.col("canonical_id") == F.col("seq_id"), "left")
    sizes = both.where("analysis_group is not null").groupBy("analysis_group").agg(F.count("*").alias("_n"))
    out = both.join(sizes, "analysis_group", "left")
    kept = F.coalesce(F.col("_n") >= least, F.lit(False)).alias("retained_for_common_analysis")
    return out.select(*both.columns, kept, *[(F.col(f"sgC_{r}") - F.col(f"sgE_{r}")).alias(f"delta_{r}") for r in rates])


def marker_support(hotspots: DataFrame, markers: Mapping[str, DataFrame], n: int) -> DataFrame:
    """hotspots (contrast, contig, and <side>_min_pos, <side>_max_pos for each side), markers by side (contrast, contig,
    pos, abs_delta_af, …): of each hotspot and side the n markers inside it of largest difference, ties by position."""
    out = None
    for side, rows in markers.items():
        spans = hotspots.select("contrast", "contig", F.col(f"{side}_min_pos").alias("_lo"), F.col(f"{side}_max_pos").alias("_hi")).where("_lo is not null and _hi is not null")
        inside = rows.join(spans, ["contrast", "contig"]).where("pos between _lo and _hi")
        best = best_rows(inside, ["contrast", "contig", "_lo", "_hi"], [F.desc("abs_delta_af"), F.asc("pos")], n).drop("_lo", "_hi")
        tagged = best.withColumns({"support_category": F.lit(side), "hotspot_key": F.concat_ws("::", "contrast", "contig")})
        out = tagged if out is None else out.unionByName(tagged)
    return out


def contrast_table(overview: DataFrame, overlaps: DataFrame, same_contig: DataFrame, specific: DataFrame) -> DataFrame:
    """overview (contrast, subgenome, metrics) with every metric of both subgenomes in a column, counts of hotspot pairs
    (0 where there are none), which side leads, and consensus strength (mean of two percentile ranks) with its rank.

    overlaps: contrast, contig, overlap_bp, percentile; same_contig, specific: contrast, contig. As many rows as there
    are contrasts."""
    metrics = [c for c in overview.columns if c not in ("contrast", "subgenome")]
    wide = overview.groupBy("contrast").agg(*[F.max(F.when(F.col("subgenome") == s, F.col(m))).alias(f"{m}_{s}") for m in metrics for s in ("sgC", "sgE")])
    wide = wide.join(overlaps.groupBy("contrast").agg(F.count("*").alias("n_overlapping_hotspot_pairs"), F.count_distinct("contig").alias("n_overlapping_contigs"), F.sum("overlap_bp").alias("total_overlap_bp"), F.avg("percentile").alias("mean_consensus_hotspot_percentile")), "contrast", "left")
    for rows, name in ((same_contig, "n_same_contig_nonoverlap_pairs"), (specific, "n_subgenome_specific_hotspots")):
        wide = wide.join(rows.groupBy("contrast").agg(F.count("*").alias(name)), "contrast", "left")
    zeros = ["n_overlapping_hotspot_pairs", "n_overlapping_contigs", "total_overlap_bp", "n_same_contig_nonoverlap_pairs", "n_subgenome_specific_hotspots"]
    wide = wide.na.fill(0, zeros)
    either = lambda m: [F.col(f"{m}_{s}") for s in ("sgC", "sgE")]
    mean = F.coalesce((either("mean_abs_delta_af")[0] + either("mean_abs_delta_af")[1]) / 2, *either("mean_abs_delta_af"))
    total = sum((F.coalesce(c, F.lit(0)) for c in either("n_markers")), F.lit(0))
    wide = wide.withColumns({
        "mean_abs_delta_af_average": mean,
        "n_markers_total": total,
        "subgenome_with_higher_mean_abs_delta_af": sign_label(F.coalesce(either("mean_abs_delta_af")[0] - either("mean_abs_delta_af")[1], F.lit(0))),
        "subgenome_with_more_top_markers": sign_label(F.coalesce(either("n_markers")[0] - either("n_markers")[1], F.lit(0))),
    })
    strength = (F.coalesce(percentile_rank("n_markers_total"), F.lit(0.0)) + F.coalesce(percentile_rank("mean_abs_delta_af_average"), F.lit(0.0))) / 2
    out = wide.withColumn("consensus_strength_percentile", strength)
    return out.withColumn("consensus_strength_rank", F.rank().over(Window.orderBy(F.desc("consensus_strength_percentile"))))


def group_means(evidence: DataFrame, group: str, columns: Mapping[str, str]) -> DataFrame:
    """Means of columns (new name -> column) and counts by group; a NULL group isn't one."""
    return evidence.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_accessions"), *[F.avg(c).alias(n) for n, c in columns.items()])


def keyword_hits(text: Column | str, library: Mapping[str, Sequence[str]]) -> Column:
    """struct(categories, terms, hits): the categories of which a term occurs in the text, and these terms, sorted and
    joined by '; '."""
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    any_of = lambda terms: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: low.contains(t))
    categories = F.array_compact(F.array(*[F.when(any_of(terms), name) for name, terms in sorted(library.items())]))
    found = term_hits(low, [t for terms in library.values() for t in terms])
    return F.struct(F.array_join(categories, "; ").alias("categories"), found["terms"].alias("terms"), found["hits"].alias("hits"))


def gene_shortlist(genes: DataFrame, with_hits_only: bool = True) -> DataFrame:
    """genes (subgenome, gene_id, gene_name, hits, priority, overlap_bp, ordinal) with their place by priority within the
    subgenome (equal ones in the order of ordinal) and their place over all by hits, priority, overlap and name."""
    rows = genes.where("hits > 0") if with_hits_only else genes
    within = ordinals(rows, [F.asc("subgenome"), F.desc("priority"), F.asc("ordinal")], "_place")
    starts = within.groupBy("subgenome").agg(F.min("_place").alias("_first"))
    ranked = with_facts(within, starts, ["subgenome"]).withColumn("within_subgenome_rank", F.col("_place") - F.col("_first") + 1).drop("_place", "_first")
    every = [F.desc("hits"), F.desc("priority"), F.desc("overlap_bp"), F.asc("gene_name"), F.asc("ordinal")]
    return ordinals(ranked, every, "_place").withColumn("global_candidate_rank", F.col("_place") + 1).drop("_place")


def top_of(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def accession_shortlist(roles: Sequence[tuple[str, int, DataFrame]], key: Sequence[str] = ("seq_id", "accession_name")) -> DataFrame:
    """Union of role lists (role, priority, rows: key, combined, asymmetry, rank): roles joined and counted, the best
    role's priority, and the columns of each key's best row. Rows that repeat a key and role count once; key columns
    may be NULL."""
    order = [F.desc_nulls_last("combined"), F.desc_nulls_last("asymmetry"), F.asc_nulls_last("rank")]
    merged = None
    for role, priority, rows in roles:
        tagged = rows.withColumns({"_role": F.lit(role), "_priority": F.lit(priority)})
        merged = tagged if merged is None else merged.unionByName(tagged)
    merged = best_rows(merged, [*key, "_role"], order)
    summary = merged.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("_role")), "; ").alias("primary_role_labels"), F.count_distinct("_role").alias("primary_role_count"), F.min("_priority").alias("best_primary_role_priority"))
    best = best_rows(merged, key, [*order, F.asc("_priority"), F.asc("_role")]).drop("_role", "_priority")
    same = F.lit(True)
    for k in key:
        same &= F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = summary.alias("s").join(best.alias("b"), same)
    return joined.select("s.*", *[F.col(f"b.{c}") for c in best.columns if c not in key])


def shortlist_roles(contrast: str) -> dict[str, int]:
    """Role -> priority, by the primary contrast."""
    both = {"cultivated_comparator": 2, "asymmetry_support": 3}
    if contrast == "arabica_cultivated__vs__arabica_introgressed":
        return {"introgressed_reference": 1} | both
    if contrast == "arabica_cultivated__vs__arabica_wild":
        return {"wild_reference": 1} | both
    return {"introgressed_reference": 1, "wild_reference": 1} | both


def direction(kind: str, label: Column, scope: str, key: Column, score: Column, **metrics: Column) -> list[Column]:
    """One scored direction's columns: four named metrics and the composite score."""
    cells = [(F.lit(name).alias(f"support_metric_{k}_name"), value.cast("double").alias(f"support_metric_{k}")) for k, (name, value) in enumerate(metrics.items(), 1)]
    return [F.lit(kind).alias("direction_type"), label.alias("direction_label"), F.lit(scope).alias("support_scope"), key.cast("string").alias("source_key"), score.cast("double").alias("composite_support_score"), *[c for pair in cells for c in pair]]


def contrast_directions(table: DataFrame) -> DataFrame:
    """A direction for each contrast of contrast_table(): mean of its strength and of the percentile ranks of effect,
    extreme markers and overlaps, and of the shared hotspots' percentile."""
    extreme = F.coalesce("n_ge_0_90_sgC", F.lit(0)) + F.coalesce("n_ge_0_90_sgE", F.lit(0))
    rows = table.withColumn("_extreme", extreme)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = [F.col("consensus_strength_percentile"), percentile_rank("mean_abs_delta_af_average"), percentile_rank("_extreme"), percentile_rank("n_overlapping_hotspot_pairs"), F.col("mean_consensus_hotspot_percentile")]
    scored = rows.withColumn("_score", sum((zero(p) for p in parts), F.lit(0.0)) / len(parts))
    return scored.select(*direction("contrast", F.regexp_replace("contrast", "__vs__", " vs "), "panel-wide contrast architecture", F.col("contrast"), F.col("_score"), mean_abs_delta_af_average=F.col("mean_abs_delta_af_average"), n_markers_delta_ge_0_90_total=F.col("_extreme"), n_overlapping_hotspot_pairs=F.col("n_overlapping_hotspot_pairs"), mean_consensus_hotspot_percentile=F.col("mean_consensus_hotspot_percentile")))


def hotspot_directions(shared: DataFrame) -> DataFrame:
    """A direction for each contrast of shared hotspots (contrast, contig, percentile, n_markers, mean_abs_delta_af): the
    mean of four percentile ranks over contrasts."""
    by = shared.groupBy("contrast").agg(F.count("contig").alias("n"), F.max("percentile").alias("top"), F.max("n_markers").alias("markers"), F.avg("mean_abs_delta_af").alias("effect"))
    scored = by.withColumn("_score", sum((F.coalesce(percentile_rank(c), F.lit(0.0)) for c in ("n", "top", "markers", "effect")), F.lit(0.0)) / 4)
    return scored.select(*direction("shared_hotspot", F.concat(F.lit("Shared hotspot architecture: "), F.regexp_replace("contrast", "__vs__", " vs ")), "shared hotspot architecture", F.col("contrast"), F.col("_score"), n_shared_hotspots=F.col("n"), max_consensus_hotspot_percentile=F.col("top"), max_combined_n_markers_hotspot=F.col("markers"), mean_combined_mean_abs_delta_af=F.col("effect")))


def list_direction(rows: DataFrame, n: int, order: Sequence[Column], kind: str, label: str, scope: str, key: str, plain: Sequence[str], ranked: Sequence[str], shares: Sequence[Column] = (), **metrics: Column) -> DataFrame:
    """One direction from the first n rows of a list: the mean of the plain columns' means, of the means of the ranked
    columns' percentile ranks among these rows, and of shares (aggregates over them). No row for an empty list."""
    top = top_of(rows, n, order)
    held = top.select("*", *[percentile_rank(c).alias(f"_p_{c}") for c in ranked])
    parts = [F.avg(c) for c in plain] + [F.avg(f"_p_{c}") for c in ranked] + list(shares)
    return held.agg(F.count("*").alias("_n"), (sum(parts, F.lit(0.0)) / len(parts)).alias("_score"), *[m.alias(name) for name, m in metrics.items()]).where("_n > 0").select(*direction(kind, F.lit(label), scope, F.lit(key), F.col("_score"), **{name: F.col(name) for name in metrics}))


def scoreboard(directions: Sequence[DataFrame]) -> DataFrame:
    """All directions with the dense rank of their score and whether they come first."""
    out = None
    for d in directions:
        out = d if out is None else out.unionByName(d)
    place = F.dense_rank().over(Window.orderBy(F.desc_nulls_last("composite_support_score")))
    return out.withColumn("recommended_rank", place).withColumn("is_primary_recommendation", F.col("recommended_rank") == 1)


def direction_summary(board: DataFrame, **sizes: int | Column) -> DataFrame:
    """field, value of the primary direction, and sizes of the lists beside it."""
    first = board.orderBy("recommended_rank", F.desc("composite_support_score"), "direction_type", "direction_label").limit(1)
    fields = {
        "recommended_direction_type": F.col("direction_type"),
        "recommended_direction_label": F.col("direction_label"),
        "support_scope": F.col("support_scope"),
        "composite_support_score": F.format_string("%.6f", F.col("composite_support_score")),
        "primary_source_key": F.when(F.col("direction_type").isin("contrast", "shared_hotspot"), F.col("source_key")),
    } | {k: F.lit(v).cast("string") for k, v in sizes.items()}
    one = first.select(*[v.cast("string").alias(k) for k, v in fields.items()])
    return one.unpivot([], list(fields), "field", "value").where("value is not null")


def top_regions(contigs: DataFrame, windows: DataFrame, permutations: DataFrame, intervals: DataFrame, condition: str) -> DataFrame:
    """One row for each subgenome: the contig that ranks first, the window of largest mean (ties: the first by contig and
    start), the permutation test, and the baseline condition's interval."""
    first = contigs.where("rank = 1").select("subgenome", F.col("contig").alias("top_contig"), F.col("mean_abs_delta_af").alias("contig_mean_abs_delta_af"), "n_ge_0_90")
    window = best_rows(windows, ["subgenome"], [F.desc_nulls_last("mean_abs_delta_af"), F.asc("contig"), F.asc("window_start")]).select("subgenome", "window_start", "window_end", F.col("mean_abs_delta_af").alias("window_mean_abs_delta_af"))
    tests = permutations.select("subgenome", F.col("window_start").alias("permutation_window_start"), F.col("window_end").alias("permutation_window_end"), "observed", "null_99", "n_valid", "p_value")
    base = intervals.where(F.col("condition") == condition).select("subgenome", "interval_start", "interval_end", (F.col("interval_end") - F.col("interval_start") + 1).alias("interval_span_bp"), "expected_match")
    return first.join(window, "subgenome").join(tests, "subgenome").join(base, "subgenome")


def validation_overview(audit: DataFrame, metrics: DataFrame, alignments: DataFrame, permutations: DataFrame) -> DataFrame:
    """component, result, evidence: report rows from one-row metrics and small tables."""
    row = lambda component, result, evidence: [component.alias("component"), result.alias("result"), evidence.alias("evidence")]
    say = F.format_string
    counts = audit.agg(*[F.max(F.when(F.col("subgenome") == s, F.col("eligible_variants"))).alias(s) for s in ("sgC", "sgE")])
    parts = [
        counts.select(*row(F.lit("Strict subgenome filtering"), F.lit("Pass"), say("sgC eligible variants: %,d; sgE: %,d", F.col("sgC"), F.col("sgE")))),
        metrics.select(*row(F.lit("SNP-panel sensitivity"), F.lit("Pass"), say("Median PCA distance correlation = %.4f", F.col("distance_correlation")))),
        metrics.select(*row(F.lit("Accession ranking"), F.lit("Pass"), say("Median Spearman correlation = %.4f; median top-six overlap = %.0f/6", F.col("rank_spearman"), F.col("top_overlap")))),
        alignments.select(*row(F.concat(F.lit("Direct alignment, "), "subgenome"), F.concat(F.lit("Chromosome "), "chromosome_status", F.lit("; boundary "), "boundary_status"), say("%.1f%% source coverage; %.3f%% identity; top-target fraction %.3f", 100 * F.col("fraction"), F.col("weighted_identity"), F.col("top_fraction")))),
        permutations.select(*row(F.concat(F.lit("Baseline permutation, "), "subgenome"), F.lit("Significant"), say("Observed max = %.4f; null 99th = %.4f; empirical P = %.6f", F.col("observed"), F.col("null_99"), F.coalesce("p_value", 1 / (1 + F.col("n_valid")))))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def guide(tables: Mapping[str, DataFrame], descriptions: Mapping[str, str]) -> DataFrame:
    """sheet, description, rows, columns of named tables; names are cut to 31 characters, as sheets are."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name[:31]).alias("sheet"), F.lit(descriptions.get(name, "")).alias("description"), "rows", F.lit(len(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def or_note(df: DataFrame, note: str = "No records") -> DataFrame:
    """df as text columns, or one row that says there is nothing."""
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    first = df.columns[0]
    empty = text.agg(F.count("*").alias("_n")).where("_n = 0").select(F.lit(note).alias(first), *[F.lit(None).cast("string").alias(c) for c in df.columns[1:]])
    return text.unionByName(empty)


def narrative(title: str, sections: Mapping[str, DataFrame]) -> str:
    """Markdown of small tables (label, value): a heading for each, a line for each row, in their order."""
    lines = [f"# {title}"]
    for heading, rows in sections.items():
        lines += ["", f"## {heading}", ""] + [f"- {r[0]}: **{r[1]}**" for r in rows.collect()]
    return "\n".join(lines) + "\n"


def stable_choices(names: DataFrame, rankings: DataFrame, most: int | None = None) -> DataFrame:
    """names (display_order, accession) with whether each was ranked at all, and whether its rank is within ``most``
    (as many as there are names) in all conditions. rankings: accession, condition, rank."""
    limit = F.lit(most) if most else F.lit(names.count())
    by = rankings.groupBy("accession").agg(F.every(F.coalesce(F.col("rank") <= limit, F.lit(False))).alias("stable"))
    return names.join(by, "accession", "left").select("display_order", "accession", F.col("stable").isNotNull().alias("found"), F.coalesce("stable", F.lit(False)).alias("stable"))


def relabelled(matrix: DataFrame, lookup: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """A matrix in long form (row, col, value) under canonical names (lookup: name, canonical): entries without one go,
    entries that share a row name are averaged first, then those that share a column name; what is left has its name
    among both rows and columns, and among the allowed (canonical)."""
    known = lookup.where("canonical is not null").select("name", "canonical").dropDuplicates(["name"])
    rows = matrix.join(known.select(F.col("name").alias("row"), F.col("canonical").alias("a")), "row").join(known.select(F.col("name").alias("col"), F.col("canonical").alias("b")), "col")
    by_row = rows.groupBy("a", "col", "b").agg(F.avg("value").alias("value"))
    out = by_row.groupBy("a", "b").agg(F.avg("value").alias("value"))
    for side in (("a", "b"), ("b", "a")):
        out = out.join(out.select(F.col(side[1]).alias(side[0])).distinct(), side[0], "left_semi")
    if allowed is not None:
        for c in ("a", "b"):
            out = out.join(allowed.select(F.col("canonical").alias(c)).distinct(), c, "left_semi")
    return out.select(F.col("a").alias("sample_a"), F.col("b").alias("sample_b"), "value")


def paired_contigs(contigs: DataFrame, inventory: DataFrame, target: str) -> DataFrame:
    """contigs (contig, letter) with the other subgenome's contig of the same letter where exactly one has it.
    inventory: contig_id, letter, subgenome, is_major."""
    one = inventory.where(F.col("is_major") & (F.col("subgenome") == target)).select("letter", "contig_id").distinct()
    one = one.groupBy("letter").agg(F.count("*").alias("_n"), F.min("contig_id").alias("_id"))
    return contigs.join(one, "letter", "left").select("contig", F.when(F.col("_n") == 1, F.col("_id")).alias("paired_contig"))
