"""Interval algebra over closed, 1-based intervals, as windows and joins.

Sequential steps (merging, gaps) run over sorted starts. Merging deals sorted ranges to tasks and carries each range's
reach on to the next, so that one long contig isn't one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelix.functions.lineage import fixed
from allelix.functions.ranking import with_facts


def merged(df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end", max_gap: int = 0, weight: str | None = None) -> DataFrame:
    """Islands of intervals that overlap, touch, or lie within max_gap: by…, start, end, n (how many, or the sum of their
    weights); for keys of any size.

    Distinct intervals are dealt by sorted ranges. Within a range, a running maximum of ends tells where islands begin;
    how far the ranges before it reach, and which island was open at their end, is carried over one row for each key and
    range. Islands then meet as aggregates."""
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*by, F.least(start, end).alias("start"), F.greatest(start, end).alias("end"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    distinct = rows.groupBy(*by, "start", "end").agg(F.sum("_w").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fixed(distinct.repartitionByRange(parts, *by, "start", "end").withColumn("_part", F.spark_partition_id()))
    own = [*by, "_part"]
    order = Window.partitionBy(*own).orderBy("start", "end")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tops = dealt.groupBy(*own).agg(F.max("end").alias("_top")).select(*own, F.max("_top").over(before).alias("_from"))
    reach = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), "_from")
    new = F.when(F.col("start") <= reach + max_gap + 1, 0).otherwise(1)
    local = with_facts(dealt, tops, own).withColumn("_new", new).withColumn("_at", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.groupBy(*own, "_at").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    # What stands before a range's first beginning belongs to the island that began last before the range.
    begun = F.when(F.col("_last") > 0, F.struct(F.col("_part").alias("_p"), F.col("_last").alias("_a")))
    open_ = local.groupBy(*own).agg(F.max("_at").alias("_last")).select(*own, F.last(begun, True).over(before).alias("_open"))
    island = F.when(F.col("_at") > 0, F.struct(F.col("_part").alias("_p"), F.col("_at").alias("_a"))).otherwise(F.col("_open"))
    return with_facts(local, open_, own).groupBy(*by, island.alias("_island")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_island")


def merged_within(df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end", max_gap: int = 0) -> DataFrame:
    """The same for keys that a task each can hold (users, bins): one shuffle, and no range to be found."""
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*by, F.least(start, end).alias("start"), F.greatest(start, end).alias("end"))
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") <= F.col("_reach") + max_gap + 1, 0).otherwise(1)
    islands = rows.withColumn("_reach", reach).withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_island")


def merged_binned(df: DataFrame, by: Sequence[str], width: int, start: str = "start", end: str = "end", max_gap: int = 0) -> DataFrame:
    """The same where intervals are many times denser than bins of ``width``: islands inside bins first, then islands of
    what these leave, by ranges."""
    rows = df.withColumn("_bin", F.floor(F.least(start, end) / F.lit(width)))
    # Bins lead, as sorting by a number that tells rows apart is cheaper than by names that don't.
    first = merged_within(rows, ["_bin", *by], start, end, max_gap).select(*by, "start", "end", F.col("n").alias("_n"))
    return merged(first, by, max_gap=max_gap, weight="_n")


def _islands(df: DataFrame, by: Sequence[str], start: str, end: str, max_gap: int, width: int | None) -> DataFrame:
    return merged_binned(df, by, width, start, end, max_gap) if width else merged(df, by, start, end, max_gap)


def union_length(df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end", width: int | None = None) -> DataFrame:
    """Positions covered at least once, by key. width: of bins, where keys have very many intervals."""
    return _islands(df, by, start, end, 0, width).groupBy(*by).agg(F.sum(F.col("end") - F.col("start") + 1).alias("covered"))


def blocks(df: DataFrame, by: Sequence[str], max_gap: int, start: str = "start", end: str = "end", width: int | None = None) -> DataFrame:
    """Merged blocks with a 1-based index in each key and their span."""
    index = F.row_number().over(Window.partitionBy(*by).orderBy("start"))
    return _islands(df, by, start, end, max_gap, width).select(*by, index.alias("block_index"), "start", "end", (F.col("end") - F.col("start") + 1).alias("span"))


def gaps(df: DataFrame, by: Sequence[str], first: int | str, last: int | str, start: str = "start", end: str = "end", width: int | None = None) -> DataFrame:
    """What [first, last] has uncovered, by key; first and last: numbers, or columns that are constant in a key."""
    lo = F.lit(first) if isinstance(first, int) else F.min(first)
    hi = F.lit(last) if isinstance(last, int) else F.max(last)
    bounds = df.groupBy(*by).agg(lo.cast("long").alias("_lo"), hi.cast("long").alias("_hi"))
    rows = _islands(df, by, start, end, 0, width).join(bounds, list(by)).where("end >= _lo and start <= _hi")
    before = F.lag("end").over(Window.partitionBy(*by).orderBy("start"))
    inner = rows.select(*by, F.greatest(F.coalesce(before + 1, F.col("_lo")), F.col("_lo")).alias("start"), (F.col("start") - 1).alias("end"))
    tail = rows.groupBy(*by).agg(F.max("end").alias("_last"), F.max("_hi").alias("_hi")).select(*by, (F.col("_last") + 1).alias("start"), F.col("_hi").alias("end"))
    none = bounds.join(rows.select(*by).distinct(), list(by), "left_anti").select(*by, F.col("_lo").alias("start"), F.col("_hi").alias("end"))
    return inner.unionByName(tail).unionByName(none).where("start <= end")


FINER = 16  # a level's bins are that many times as wide as the level's below
LEVELS = 6


def _leveled(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """With _level: of the finest bins of which the interval touches FINER or fewer (the last level's have any length)."""
    crossed = [F.floor(F.col(end) / F.lit(width * FINER**k)) - F.floor(F.col(start) / F.lit(width * FINER**k)) for k in range(LEVELS)]
    level = F.coalesce(*[F.when(c < FINER, F.lit(k)) for k, c in enumerate(crossed)], F.lit(LEVELS))
    return df.where(F.col(start) <= F.col(end)).withColumn("_level", level)


def _bins(level: Column, start: str, end: str, width: int) -> Column:
    """The level's bins that the interval touches; the last level is one bin."""
    size = F.element_at(F.array(*[F.lit(float(width * FINER**k)) for k in range(LEVELS)]), F.least(level, F.lit(LEVELS - 1)) + 1)
    return F.when(level < LEVELS, F.sequence(F.floor(F.col(start) / size), F.floor(F.col(end) / size))).otherwise(F.array(F.lit(0).cast("long")))


def overlapping(a: DataFrame, b: DataFrame, on: str, width: int, how: str = "inner") -> DataFrame:
    """Pairs of a (on, a_start, a_end) and b (on, b_start, b_end) that share a position, with overlap_start, _end and
    _bp; how: inner, or left_semi for the rows of a that meet any b. An interval that ends before it starts meets none.

    Bins have levels, each FINER times as wide as the level's below, the finest ``width``. An interval stands in FINER
    bins of its own level or fewer, however long it is, and once or twice in those of the coarser levels that the other
    side has, so a pair meets in the coarser level of both and the join is on (key, level, bin): no key is one task. A
    pair is kept in the bin of its overlap's first position only. Each side is read once more for its coarsest level."""
    left = _leveled(a.withColumn("_row", F.monotonically_increasing_id()) if how == "left_semi" else a, "a_start", "a_end", width)
    right = _leveled(b.select(on, "b_start", "b_end") if how == "left_semi" else b, "b_start", "b_end", width)

    def coarsest(df: DataFrame) -> DataFrame:
        return F.broadcast(df.agg(F.coalesce(F.max("_level"), F.lit(-1)).alias("_top")))  # one row

    def met(df: DataFrame, other: DataFrame, start: str, end: str, own: str) -> DataFrame:
        """One row for each bin, with whether the interval is at home at its level."""
        top = F.greatest("_level", "_top")
        at = df.crossJoin(coarsest(other)).withColumn("_at", F.explode(F.sequence(F.col("_level"), top)))
        return at.withColumn("_bin", F.explode(_bins(F.col("_at"), start, end, width))).withColumn(own, F.col("_level") == F.col("_at")).drop("_level", "_top")

    cut_a, cut_b = met(left, right, "a_start", "a_end", "_home_a"), met(right, left, "b_start", "b_end", "_home_b")
    # Two visitors have met at a finer level already, so visitors meet homes only: the key says which. The finest level
    # has no visitors.
    roles = F.explode(F.when(F.col("_home_a") & (F.col("_at") > 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("_role")
    cut_a = cut_a.select("*", roles).drop("_home_a")
    cut_b = cut_b.withColumn("_role", F.when(F.col("_home_b"), 1).otherwise(0)).drop("_home_b")
    size = F.element_at(F.array(*[F.lit(float(width * FINER**k)) for k in range(LEVELS)]), F.least(F.col("_at"), F.lit(LEVELS - 1)) + 1)
    meets = (F.col("a_start") <= F.col("b_end")) & (F.col("a_end") >= F.col("b_start"))
    if how == "left_semi":
        return cut_a.join(cut_b, [on, "_at", "_bin", "_role"]).where(meets).select("_row", *a.columns).distinct().drop("_row")
    first = (F.col("_at") == LEVELS) | (F.floor(F.greatest("a_start", "b_start") / size) == F.col("_bin"))
    pairs = cut_a.join(cut_b, [on, "_at", "_bin", "_role"]).where(meets & first)
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    return pairs.drop("_at", "_bin", "_role").select("*", start.alias("overlap_start"), end.alias("overlap_end"), (end - start + 1).alias("overlap_bp"))


def points_within(points: DataFrame, spans: DataFrame, on: str, width: int) -> DataFrame:
    """Counts of points (on, pos) in each closed span (span_id, on, start, end); spans without points count 0."""
    cut = spans.where("start <= end").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / F.lit(width)), F.floor(F.col("end") / F.lit(width)))))
    at = points.select(on, "pos", F.floor(F.col("pos") / F.lit(width)).alias("_bin"))
    counted = cut.join(at, [on, "_bin"]).where("pos between start and end").groupBy("span_id").agg(F.count("*").alias("n_points"))
    return spans.join(counted, "span_id", "left").select(*spans.columns, F.coalesce("n_points", F.lit(0).cast("long")).alias("n_points"))


def nearest_value(left: DataFrame, right: DataFrame, value: str, target: str, key: str, decimals: int | None = None) -> DataFrame:
    """For each left row, the right row of the nearest value (ties: smaller value, then smaller key), and the distance
    to it: a sorted sweep over both sides within ranges of the value, not a cross join.

    left: key…, value; right: target_key ``key``, ``target``. Values that repeat on the right are met by their least key.
    decimals: places to which distances are rounded before they are compared, so that a value in the middle of two
    decimal fractions is as far from both; values on one side of it are met in their own order."""
    wanted = right.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("double").alias("_v")).agg(F.min(key).alias("_key"))
    rows = left.withColumn("_v", F.col(value).cast("double")).withColumn("_hit", F.lit(None).cast(dict(wanted.dtypes)["_key"]))
    marks = wanted.select("_v", F.col("_key").alias("_hit"), F.lit(True).alias("_mark"))
    both = rows.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fixed(both.repartitionByRange(parts, "_v").withColumn("_part", F.spark_partition_id()))
    mark = F.when(F.col("_mark"), F.struct("_v", "_hit"))
    down = Window.partitionBy("_part").orderBy("_v", F.desc("_mark")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("_part").orderBy(F.desc("_v"), F.desc("_mark")).rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt.groupBy("_part").agg(F.max(mark).alias("_top"), F.min(mark).alias("_bottom"))
    side = Window.orderBy("_part")
    carried = ends.select("_part", F.last("_top", True).over(side.rowsBetween(Window.unboundedPreceding, -1)).alias("_left"), F.first("_bottom", True).over(side.rowsBetween(1, Window.unboundedFollowing)).alias("_right"))
    swept = dealt.select("*", F.last(mark, True).over(down).alias("_below"), F.last(mark, True).over(up).alias("_above")).where(~F.col("_mark"))
    found = swept.join(carried, "_part").select(*left.columns, "_v", F.coalesce("_below", "_left").alias("_b"), F.coalesce("_above", "_right").alias("_a"))
    away = lambda x: x if decimals is None else F.round(x, decimals)
    below, above = away(F.col("_v") - F.col("_b._v")), away(F.col("_a._v") - F.col("_v"))
    lower = F.col("_b").isNotNull() & (F.col("_a").isNull() | (below <= above))
    best = F.when(lower, F.col("_b")).otherwise(F.col("_a"))
    return found.select(*left.columns, best["_hit"].alias(key), best["_v"].alias("nearest"), F.abs(F.col("_v") - best["_v"]).alias("distance"))


def neighbours(values: DataFrame, marks: DataFrame) -> DataFrame:
    """values (_v, no repeats), marks (_v, _hit, _n; no repeats of _v) -> _v with the marks around it: _b (at it or
    below) and _a (above it), structs of _v, _hit, _n and _far, the value of the mark behind that one. The sorted sweep
    of nearest_value with two marks on each side: a range hands on its outermost two marks, and nothing is crossed."""
    both = values.select("_v", F.lit(False).alias("_mark")).unionByName(marks.select("_v", "_hit", "_n", F.lit(True).alias("_mark")), allowMissingColumns=True)
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = fixed(both.repartitionByRange(parts, "_v").withColumn("_part", F.spark_partition_id()))
    down = Window.partitionBy("_part").orderBy("_v", F.desc("_mark"))
    up = Window.partitionBy("_part").orderBy(F.desc("_v"), "_mark")
    ahead, so_far = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
    value = F.when(F.col("_mark"), F.col("_v"))
    # What lies behind a mark inside its range.
    near = dealt.withColumn("_low", F.last(value, True).over(down.rowsBetween(*ahead))).withColumn("_high", F.last(value, True).over(up.rowsBetween(*ahead)))
    lower = F.when(F.col("_mark"), F.struct("_v", "_hit", "_n", F.col("_low").alias("_far")))
    upper = F.when(F.col("_mark"), F.struct("_v", "_hit", "_n", F.col("_high").alias("_far")))
    # One row for each range.
    ends = near.groupBy("_part").agg(F.max_by(lower, value).alias("_top"), F.min_by(upper, value).alias("_bottom"), F.max(value).alias("_max"), F.min(value).alias("_min"))
    before, behind = Window.orderBy("_part").rowsBetween(*ahead), Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    ends = ends.withColumn("_left_v", F.last("_max", True).over(before)).withColumn("_right_v", F.first("_min", True).over(behind))
    filled = lambda c, far: F.when(F.col(c).isNotNull(), F.struct(f"{c}._v", f"{c}._hit", f"{c}._n", F.coalesce(f"{c}._far", far).alias("_far")))
    ends = ends.withColumn("_top", filled("_top", "_left_v")).withColumn("_bottom", filled("_bottom", "_right_v"))
    carried = ends.select("_part", "_left_v", "_right_v", F.last("_top", True).over(before).alias("_left"), F.first("_bottom", True).over(behind).alias("_right"))
    swept = near.withColumn("_below", F.last(lower, True).over(down.rowsBetween(*so_far))).withColumn("_above", F.last(upper, True).over(up.rowsBetween(*so_far))).where(~F.col("_mark"))
    return swept.join(carried, "_part").select("_v", F.coalesce(filled("_below", "_left_v"), "_left").alias("_b"), F.coalesce(filled("_above", "_right_v"), "_right").alias("_a"))


def named_chunks(df: DataFrame, sequence: str, start: str, end: str, size: int, overlap: int, least: int = 1_000) -> DataFrame:
    """chunks() of the stretch start to end (1-based, closed) of each row's sequence: query (chunk0001|src=1-200),
    chunk_index, source_start, source_end, chunk_length and the chunk's own sequence."""
    cut = df.withColumn("_piece", F.substring(F.col(sequence), F.col(start), F.greatest(F.lit(0), F.least(F.col(end), F.char_length(sequence)) - F.col(start) + 1))).withColumn("_n", F.char_length("_piece").cast("long"))
    rows = chunks(cut, "_n", size, overlap, least)
    a, b = F.col(start) + F.col("chunk_start") - 1, F.col(start) + F.col("chunk_end") - 1
    n = F.col("chunk_end") - F.col("chunk_start") + 1
    name = F.concat(F.lit("chunk"), F.lpad(F.col("chunk_index").cast("string"), 4, "0"), F.lit("|src="), a.cast("string"), F.lit("-"), b.cast("string"))
    others = [c for c in df.columns if c not in (sequence, start, end)]
    return rows.select(*others, name.alias("query"), "chunk_index", a.alias("source_start"), b.alias("source_end"), n.alias("chunk_length"), F.substring(F.col("_piece"), F.col("chunk_start").cast("int"), n.cast("int")).alias("chunk_sequence"))


def chunks(df: DataFrame, length: str, size: int, overlap: int, least: int) -> DataFrame:
    """Rows of df with chunk_index, chunk_start, chunk_end (1-based) of overlapping chunks: none starts behind the one
    that reaches the end, and none is shorter than ``least``."""
    step = max(1, size - overlap)
    n = F.col(length)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("long")
    at = F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_k")
    rows = df.where(n > 0).select("*", at)
    out = rows.select(*df.columns, (F.col("_k") + 1).alias("chunk_index"), (F.col("_k") * step + 1).alias("chunk_start"), F.least(F.col("_k") * step + size, n).alias("chunk_end"))
    return out.where(F.col("chunk_end") - F.col("chunk_start") + 1 >= least)
