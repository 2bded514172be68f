"""Column expressions: genotype decoders, label and category functions, coordinates. Missing is NULL throughout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Expr = Column | str


def _c(x: Expr) -> Column:
    return F.col(x) if isinstance(x, str) else x


def gt_dosage(sample: Expr, index: Expr | int = 0) -> Column:
    """Alternate alleles (0, 1, 2) of a diploid biallelic call; NULL for anything else. index: GT's place in FORMAT."""
    gt = F.split_part(_c(sample), F.lit(":"), (F.lit(index) if isinstance(index, int) else _c(index)) + 1)
    # Both alleles are zeros before a 0 or a 1, so their sum is the number of ones.
    return F.when(gt.rlike(r"^0*[01][/|]0*[01]$"), F.char_length(gt) - F.char_length(F.replace(gt, F.lit("1"), F.lit("")))).cast("int")


def gt_dosage_any(sample: Expr, index: int = 0) -> Column:
    """Sum of allele numbers of a call of any ploidy; NULL where an allele is missing or no number."""
    gt = F.get(F.split(_c(sample), ":"), F.lit(index))
    alleles = F.transform(F.split(gt, r"[/|]"), lambda x: x.try_cast("int"))
    return F.when((gt != "") & ~F.exists(alleles, lambda x: x.isNull()), F.aggregate(alleles, F.lit(0), lambda a, x: a + x)).cast("double")


def genotype(sample: Expr, gt: int = 0, dp: int | None = None) -> Column:
    """struct(dosage, depth, missing) of a call of any ploidy: dosage is the sum of allele numbers (NULL if missing),
    depth is DP where it is a whole number. A call that is only a dot has no depth either."""
    s = _c(sample)
    bare = s.isin(".", "./.", ".|.", "")
    dosage = F.when(~bare, gt_dosage_any(s, gt))
    depth = F.when(~bare, F.get(F.split(s, ":"), F.lit(dp)).try_cast("int")) if dp is not None else F.lit(None).cast("int")
    return F.struct(dosage.alias("dosage"), depth.alias("depth"), dosage.isNull().alias("missing"))


def format_index(fmt: Expr, key: str) -> Column:
    """Zero-based place of a key in a FORMAT string; NULL if it isn't there."""
    at = F.array_position(F.split(_c(fmt), ":"), key)
    return F.when(at > 0, (at - 1).cast("int"))


def is_biallelic_snp(ref: Expr, alt: Expr) -> Column:
    return ~F.contains(_c(alt), F.lit(",")) & (F.char_length(_c(ref)) == 1) & (F.char_length(_c(alt)) == 1) & (_c(alt) != "*")


def subgenome_of(contig: Expr) -> Column:
    """sgC, sgE or unassigned, by the tag inside a contig's name."""
    c = _c(contig)
    return F.when(c.rlike(r"_sg_C_|_sgCC(_|$)"), "sgC").when(c.rlike(r"_sg_E_|_sgEE(_|$)"), "sgE").otherwise("unassigned")


def keeps_contig(contig: Expr, subgenome: str, mode: str) -> Column:
    """The contig filter's three modes."""
    found = subgenome_of(contig)
    if mode == "none":
        return F.lit(True)
    if mode == "matching_pseudomolecules_only":
        return found == subgenome
    if mode == "matching_plus_unassigned":
        return found.isin(subgenome, "unassigned")
    raise ValueError(f"unknown contig filter mode {mode!r}")


def expected_chr4(contig: Expr, subgenome: str) -> Column:
    """Whether a contig is the expected chromosome 4 of a subgenome (sgC or sgE); NULL isn't."""
    c = _c(contig)
    return F.coalesce(c.startswith("chr_D") & c.contains(f"_sg_{subgenome[-1]}_"), F.lit(False))


def chromosome_number(contig: Expr) -> Column:
    """A = 1, B = 2, … of the letter in chr_<letter>_sg_…; NULL without one."""
    letter = F.regexp_extract(_c(contig), "^chr_([A-L])_sg_[CE]_", 1)
    return F.when(letter != "", F.ascii(letter) - 64).cast("int")


def chromosome_label(contig: Expr, suffix: str = "") -> Column:
    """4c with the suffix c (NULL for other names); without a suffix Chr4, or the name itself."""
    n = chromosome_number(contig).cast("string")
    return F.concat(n, F.lit(suffix)) if suffix else F.coalesce(F.concat(F.lit("Chr"), n), _c(contig))


def window_start(pos: Expr, width: int) -> Column:
    """First position of the tumbling window (1-based) that holds pos."""
    return (F.floor((_c(pos) - 1) / F.lit(width)) * width + 1).cast("long")


def token(value: Expr) -> Column:
    """Lower-case letters and digits of a name; NULL if none are left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(_c(value).cast("string"))), "[^a-z0-9]+", ""), F.lit(""))


def name_candidates(sample: Expr) -> Column:
    """A sample's name and the forms it takes without subgenome or species suffixes, in order and without repeats."""
    s = F.trim(_c(sample))
    ends = [F.regexp_replace(s, f"(?i){p}$", "") for p in ("_(sgc|sge)", "_eugenioides", "_canephora")]
    inside = [F.regexp_replace(s, p, "") for p in ("_sg[CE]", "_(Eugenioides|Canephora)")]
    return F.filter(F.array_distinct(F.transform(F.array(s, *ends, *inside), lambda x: F.btrim(x, F.lit("_ ")))), lambda x: x != "")


def analysis_group(species: Expr, variety: Expr) -> Column:
    """The panel's groups: arabica by variety (introgressed before cultivated before wild), and the two diploids."""
    s, v = F.lower(F.coalesce(_c(species), F.lit(""))), F.lower(F.coalesce(_c(variety), F.lit("")))
    return (
        F.when(s.contains("canephora"), "canephora")
        .when(s.contains("eugenioides"), "eugenioides")
        .when(s.contains("arabica") & v.contains("introgress"), "arabica_introgressed")
        .when(s.contains("arabica") & v.contains("cultivated"), "arabica_cultivated")
        .when(s.contains("arabica") & v.contains("wild"), "arabica_wild")
        .when(s.contains("arabica"), "arabica_other")
        .otherwise("other")
    )


def seqid(value: Expr) -> Column:
    """The NC_ accession inside a sequence id, or the id without surrounding bars and spaces."""
    nc = F.regexp_extract(_c(value), r"(NC_\d+\.\d+)", 1)
    return F.coalesce(F.nullif(nc, F.lit("")), F.btrim(_c(value), F.lit("| ")))


def chunk_coordinates(query: Expr) -> Column:
    """struct(chunk, start, end) of names like chunk0001|src=100-299; an error for others."""
    q, pattern = _c(query), r"chunk(\d+)\|src=(\d+)-(\d+)"
    part = [F.regexp_extract(q, pattern, k).try_cast("long") for k in (1, 2, 3)]
    checked = F.when(q.rlike(pattern), part[0]).otherwise(F.raise_error(F.concat(F.lit("no chunk name: "), q)).cast("long"))
    return F.struct(checked.alias("chunk"), part[1].alias("start"), part[2].alias("end"))


def attributes(text: Expr) -> Column:
    """key=value;key=value as a map: the first = splits, items without one are skipped, the last of a key wins."""
    items = F.filter(F.split(F.coalesce(_c(text), F.lit("")), ";"), lambda x: x.contains("="))
    pairs = F.transform(items, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def first_category(text: Expr, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The name of the first (name, pattern) that text matches, without regard to case."""
    t, out = F.coalesce(_c(text), F.lit("")), None
    for name, pattern in rules:
        test = t.rlike(f"(?i){pattern}")
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(default) if out is None else out.otherwise(default)


def all_categories(text: Expr, rules: Sequence[tuple[str, str]]) -> Column:
    """Every category whose pattern text matches, sorted and joined by '; '."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(t.rlike(f"(?i){p}"), n) for n, p in rules]))), "; ")


def term_hits(text: Expr, terms: Sequence[str]) -> Column:
    """struct(terms, hits): which of the terms occur in text, sorted and joined, and how many."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    found = F.array_sort(F.filter(F.array(*[F.lit(x.lower()) for x in sorted(set(terms))]), lambda x: t.contains(x)))
    return F.struct(F.array_join(found, "; ").alias("terms"), F.size(found).alias("hits"))


def utc_now() -> Column:
    """The present time in UTC, as ISO 8601 to the second."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def renamed(value: Expr, names: Mapping[str, str]) -> Column:
    """A name by which it is shown, where there is one; else the name itself."""
    v, out = _c(value), None
    for name, shown in names.items():
        out = F.when(v == name, shown) if out is None else out.when(v == name, shown)
    return v if out is None else out.otherwise(v)


def sign_label(x: Expr, positive: str = "sgC", negative: str = "sgE") -> Column:
    """Which side a difference favours; NULL and zero are a tie."""
    return F.when(_c(x) > 0, positive).when(_c(x) < 0, negative).otherwise("tie")


def mean_of(*columns: Expr) -> Column:
    """Mean of the values that aren't NULL; NULL if all are."""
    values = F.array_compact(F.array(*[_c(c).cast("double") for c in columns]))
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def median_of(*columns: Expr) -> Column:
    values = F.array_sort(F.array_compact(F.array(*[_c(c).cast("double") for c in columns])))
    n = F.size(values)
    return F.when(n > 0, (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2)


def known_of(*columns: Expr) -> Column:
    """How many of the columns aren't NULL."""
    return F.size(F.array_compact(F.array(*[_c(c) for c in columns])))


def interval_jaccard(s1: Expr, e1: Expr, s2: Expr, e2: Expr) -> Column:
    """Overlap over hull of two spans as differences (no +1); NULL if the hull is empty."""
    s1, e1, s2, e2 = map(_c, (s1, e1, s2, e2))
    return F.greatest(F.lit(0.0), (F.least(e1, e2) - F.greatest(s1, s2)).cast("double")) / F.nullif((F.greatest(e1, e2) - F.least(s1, s2)).cast("double"), F.lit(0.0))


def confidence(rel_diff: Expr, gap: Expr) -> Column:
    """Ladder of length matches: exact; within 8 % graded by the difference and the gap to the next best (NULL: none)."""
    d, g = _c(rel_diff), F.coalesce(_c(gap), F.lit(-1.0))
    return (
        F.when(d == 0, "exact")
        .when((d <= 0.08) & (g >= 0.01), F.when(d <= 0.03, "high").otherwise("medium"))
        .when(d <= 0.08, F.when(d <= 0.03, "medium").otherwise("low"))
        .otherwise("unresolved")
    )


def transferred(pos: Expr, source_length: Expr, target_length: Expr) -> Column:
    """A position scaled to another length: half-even rounding, kept inside the target; NULL without all three."""
    scaled = F.bround(_c(pos).cast("double") * _c(target_length) / F.nullif(_c(source_length).cast("double"), F.lit(0.0)), 0).cast("long")
    at = F.when(_c(source_length) == _c(target_length), _c(pos).cast("long")).otherwise(scaled)
    return F.when(at.isNotNull(), F.greatest(F.lit(1).cast("long"), F.least(at, _c(target_length).cast("long"))))


def stretched(start: Expr, end: Expr, source_length: Expr, target_length: Expr) -> Column:
    """struct(start, end) of an interval scaled outwards to another length: the start is rounded down, the end up, both
    kept inside the target and put in order. NULL without all lengths, or where the source's is 0."""
    scale = _c(target_length).cast("double") / F.nullif(_c(source_length).cast("double"), F.lit(0.0))
    a = F.greatest(F.lit(1).cast("long"), F.floor(_c(start) * scale).cast("long"))
    b = F.least(_c(target_length).cast("long"), F.ceil(_c(end) * scale).cast("long"))
    return F.when(scale.isNotNull() & _c(start).isNotNull() & _c(end).isNotNull(), F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end")))


def hsp_target(start: Expr, end: Expr) -> Column:
    """struct(start, end, strand) of a hit's target, strand by the order of its ends."""
    a, b = _c(start), _c(end)
    return F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"), F.when(a <= b, 1).otherwise(-1).alias("strand"))


def hsp_orientation(qstart: Expr, qend: Expr, sstart: Expr, send: Expr) -> Column:
    """The other definition: sign of the product of both directions."""
    return F.signum(((_c(qend) - _c(qstart)) * (_c(send) - _c(sstart))).cast("double")).cast("int")


def tier(roles: Expr, best_rank: Expr) -> Column:
    return F.when(_c(roles) >= 3, "core").when((_c(roles) >= 2) | (_c(best_rank) <= 3), "high").otherwise("supporting")


def gate(passed: Sequence[Column]) -> Column:
    """PASS if all hold, WARN if all but one do, FAIL otherwise; NULL counts as not held."""
    n = sum((F.coalesce(p, F.lit(False)).cast("int") for p in passed), F.lit(0))
    return F.when(n == len(passed), "PASS").when(n == len(passed) - 1, "WARN").otherwise("FAIL")


# Ordered annotation categories, the candidate pattern and the anchored keyword lists.
CATEGORIES = [
    ("Defense receptor", r"resistan|disease|immune|\bRPP\b|RPP\d|RGA\d|NLR|NBS|TIR|LRR"),
    ("Kinase signaling", r"kinase|phosphatase|MAPK|WNK|signaling|calmodulin"),
    ("Stress response", r"stress|defen[cs]e|pathogenesis|chitin|heat shock|oxidative"),
    ("Transcriptional regulation", r"transcription|\bNAC\b|JA2L|WRKY|MYB|bZIP|TCP"),
    ("Membrane transport", r"transport|transporter|channel|pump|aquaporin|membrane"),
]
OTHER_CATEGORY = "Other candidate annotation"
CANDIDATES = "resistan|disease|defen|immune|NLR|NBS|LRR|RPP|RGA|kinase|RLK|WAK|NAC|JA2L|stress|transport|receptor"
KEYWORDS = {
    "defense_receptor": ("receptor", "receptor-like", "wall-associated receptor kinase", "leucine-rich", "LRR", "RLK", "RLP"),
    "kinase_signaling": ("kinase", "MAPK", "signaling", "calmodulin", "phosphatase"),
    "stress_response": ("stress", "pathogen", "disease", "defense", "autophagy", "oxidative", "wound"),
    "transcriptional_regulation": ("transcription factor", "MYB", "WRKY", "NAC", "ERF", "bHLH"),
    "transport_membrane": ("transporter", "channel", "ATPase", "membrane", "ABC"),
}
KEYWORD_RULES = [(name, r"\b(" + "|".join(words) + r")\b") for name, words in KEYWORDS.items()]

# The gene-description library, categories and their terms.
GENE_LIBRARY = {
    "receptor_kinase": ("receptor kinase", "receptor-like kinase", "wall-associated receptor kinase", "serine/threonine-protein kinase", "protein kinase", "kinase-like"),
    "resistance_like": ("disease resistance", "resistance protein", "nb-arc", "nbs-lrr", "leucine-rich repeat", "lrr", "rpp", "rpm", "rps"),
    "defense_or_stress": ("defense", "stress", "pathogenesis-related", "peroxidase", "chitinase", "thaumatin", "wound", "immune"),
    "transcription_factor": ("transcription factor", "wrky", "myb", "bhlh", "bzip", "nac", "ap2", "erf"),
    "transporter": ("transporter", "abc transporter", "mfs transporter", "sugar transporter", "ion channel"),
}
