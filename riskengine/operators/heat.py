"""Keys that hold too many rows for one task, and what to do with them.

A window partitioned by payer or device puts all rows of that key into one task.
That is right for ordinary keys and fatal for a hot one (the ``unknown_device``
sentinel alone can own most rows). Hot keys are found by an exact count, and
their rows take a sliced form of the same computation: partitions are
(key, time slice), and what earlier slices contribute arrives as one extra
"carry" row per slice, made from pre-aggregated slice totals. Slices are spans of
time; a span with too many rows is cut again where its own rows lie.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskengine.functions.timing import SECOND
from riskengine.session import materialise

HOT_ROWS = 200_000      # a key with more rows than this is not left to one task
MAX_HOT_KEYS = 10_000   # length of the key list in a plan; more hot keys are recognised by a bitmap
BITMAP_BITS = 24        # 2 MB, whatever the number of keys
SLICE_SECONDS = 900
SLICE_ROWS = 200_000    # rows of a slice, as long as they do not share one time
MOST_SLICES = 1 << 13   # slices of one span of time


@dataclass(frozen=True)
class KeyProfile:
    """Hot keys of one column, and a proven bound on the rows of any other key.

    ``bitmap`` (rows of a fixed number of bits) marks further hot keys. Other keys that share a bit with
    one of them are treated as hot too, which changes no result.
    """

    hot: tuple = ()
    cold_bound: int = HOT_ROWS
    slice_us: int = SLICE_SECONDS * SECOND
    bitmap: DataFrame | None = None

    def flagged(self, df: DataFrame, key: str, flag: str = "_hot") -> DataFrame:
        values = [v for v in self.hot if v is not None]
        listed = F.coalesce(F.col(key).isin(values), F.lit(False)) if values else F.lit(False)
        if self.bitmap is None:
            return df.withColumn(flag, listed)
        place = df.withColumn("_slot", _slot(key))
        byte = F.conv(F.hex(F.expr("substring(_bits, cast(bitmap_bit_position(_slot) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        marked = F.getbit(byte, (F.bitmap_bit_position("_slot") % 8).cast("int")) == 1
        return (place.join(F.broadcast(self.bitmap), F.bitmap_bucket_number("_slot") == F.col("_bucket"), "left")  # at most 512 rows of 4 KB
                .withColumn(flag, listed | F.coalesce(F.col(key).isNotNull() & marked, F.lit(False)))
                .drop("_slot", "_bucket", "_bits"))


def _slot(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("string")).bitwiseAND((1 << BITMAP_BITS) - 1) + 1


def profile_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS,
                 max_keys: int = MAX_HOT_KEYS) -> KeyProfile:
    """Exact row counts per key (map-side combined); the heaviest ``max_keys`` above ``hot_rows`` reach the driver.

    If there are more, a bitmap of all of them goes along, so that no key above ``hot_rows`` is left to one task.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    top = counts.orderBy(F.col(key).isNotNull(), F.desc("_n")).limit(max_keys).collect()  # a hot NULL comes first
    if len(top) < max_keys:
        return KeyProfile(tuple(r[key] for r in top), hot_rows)
    bitmap = counts.filter(F.col(key).isNotNull()).withColumn("_slot", _slot(key)).groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    return KeyProfile(tuple(r[key] for r in top), hot_rows, bitmap=materialise(bitmap, "hot-keys"))


def by_heat(df: DataFrame, key: str, profile: KeyProfile,
            cold: Callable[[DataFrame], DataFrame], hot: Callable[[DataFrame], DataFrame],
            null: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Ordinary keys through ``cold``, hot ones through ``hot``, heavy NULLs through ``null``.

    NULL is no entity and has no history. A light NULL group goes with the cold
    rows (which mask it); a heavy one skips the shuffle.
    """
    if not profile.hot:
        return cold(df)
    flagged = profile.flagged(df, key)
    side = lambda cond: flagged.filter(cond).drop("_hot")
    parts = []
    if None in profile.hot:
        parts.append(null(df.filter(F.col(key).isNull())))
        parts.append(cold(side(F.col(key).isNotNull() & ~F.col("_hot"))))
    else:
        parts.append(cold(side(~F.col("_hot"))))
    if profile.bitmap is not None or any(v is not None for v in profile.hot):
        parts.append(hot(side(F.col("_hot"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def time_slices(rows: DataFrame, keys: list[str], pos: str, slice_us: int) -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``_slice``, which rises with ``pos``, to tables of the same keys and places.

    A span of ``slice_us`` in which a key has more than ``SLICE_ROWS`` rows is cut at places of equal row counts, taken
    from a sketch of these rows. Rows of one place stay together.
    """
    span = F.floor(F.col(pos) / slice_us)
    dense = materialise(rows.groupBy(*keys, span.alias("_span")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_lo"), F.max(pos).alias("_hi")).filter(
            (F.col("_n") > SLICE_ROWS) & (F.col("_lo") < F.col("_hi"))), "dense-spans")
    heaviest = dense.agg(F.max("_n")).first()[0]
    if heaviest is None:
        return lambda d: d.withColumn("_slice", span * MOST_SLICES)
    parts = min(MOST_SLICES - 1, -(-heaviest // SLICE_ROWS) + 1)
    where = [*keys, "_span"]
    edges = rows.withColumn("_span", span).join(dense.select(*where), where, "left_semi").groupBy(*where).agg(
        F.array_distinct(F.percentile_approx(pos, [i / parts for i in range(1, parts)], 20 * parts)).alias("_edges"))
    edges = materialise(edges, "dense-edges")

    def cut(d: DataFrame) -> DataFrame:
        inside = F.coalesce(F.size(F.filter("_edges", lambda e: e <= F.col(pos))), F.lit(0))
        return d.withColumn("_span", span).join(edges, where, "left").withColumn(
            "_slice", F.col("_span") * MOST_SLICES + inside).drop("_span", "_edges")
    return cut


def prefix_sums(rows: DataFrame, keys: list[str], pos: str, measures: dict[str, Column],
                slice_us: int | None = None, light: DataFrame | None = None) -> DataFrame:
    """Add, per measure, its sum over the rows of the key with a strictly smaller ``pos``.

    A running frame is one pass over the sorted partition, whatever the density.
    With ``slice_us`` the partitions are (keys, time slice) and each slice starts
    from the totals of the earlier ones. Measures are computed after the shuffle:
    only the columns they are made from travel. ``light`` may give the same rows
    without their payload, for the totals.
    """
    names = list(measures)

    def running(parts):
        w = Window.partitionBy(*parts).orderBy(pos).rangeBetween(Window.unboundedPreceding, -1)
        return {m: F.sum(f"_m{i}").over(w) for i, m in enumerate(names)}

    inputs = {f"_m{i}": measures[m].cast("long") for i, m in enumerate(names)}
    if slice_us is None:
        return rows.withColumns(inputs).withColumns(running(keys)).drop(*inputs)

    slim = rows if light is None else light
    cut = time_slices(slim, keys, pos, slice_us)
    sliced = cut(rows)
    totals = cut(slim).groupBy(*keys, "_slice").agg(F.min(pos).alias("_first"), *[F.sum(v).alias(m) for m, v in inputs.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_slice", (F.col("_first") - 1).alias(pos),
                          F.array(*[F.sum(m).over(before) for m in inputs]).alias("_carry"))
    both = sliced.withColumn("_carry", F.lit(None).cast("array<bigint>")).unionByName(
        carry, allowMissingColumns=True).repartition(*keys, "_slice")
    carried = {m: F.coalesce(F.element_at("_carry", i + 1), v) for i, (m, v) in enumerate(inputs.items())}
    return (both.withColumns(carried).withColumns(running([*keys, "_slice"]))
            .filter(F.col("_carry").isNull()).drop("_carry", "_slice", *inputs))


def row_running(rows: DataFrame, keys: list[str], pos: str, tie: str,
                measures: dict[str, tuple[str, Column]], slice_us: int | None = None,
                last: int = 0) -> DataFrame:
    """Running aggregates in the total order (pos, tie) within the keys.

    ``measures`` maps an output to ("sum" | "min", value). ``last=-1`` leaves the
    row itself out. Sliced, every slice starts from the aggregates of the earlier
    slices, as in :func:`prefix_sums`.
    """
    fold = {"sum": F.sum, "min": F.min}
    rows = rows.withColumns({f"_m_{o}": v.cast("long") for o, (_, v) in measures.items()})
    values = [f"_m_{o}" for o in measures]

    def running(parts):
        w = (Window.partitionBy(*parts).orderBy(F.col(pos), F.col(tie).asc_nulls_first())
             .rowsBetween(Window.unboundedPreceding, last))
        return {o: fold[kind](f"_m_{o}").over(w) for o, (kind, _) in measures.items()}

    if slice_us is None:
        return rows.withColumns(running(keys)).drop(*values)
    sliced = time_slices(rows, keys, pos, slice_us)(rows)
    totals = sliced.groupBy(*keys, "_slice").agg(
        F.min(pos).alias("_first"), *[fold[kind](f"_m_{o}").alias(f"_m_{o}") for o, (kind, _) in measures.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_slice", (F.col("_first") - 1).alias(pos),
                          *[fold[kind](f"_m_{o}").over(before).alias(f"_m_{o}")
                            for o, (kind, _) in measures.items()],
                          F.lit(True).alias("_carry"))
    return (sliced.withColumn("_carry", F.lit(False))
            .unionByName(carry, allowMissingColumns=True)
            .withColumns(running([*keys, "_slice"]))
            .filter(~F.col("_carry")).drop("_carry", "_slice", *values))


def row_ranks(rows: DataFrame, keys: list[str], pos: str, tie: str, out: str,
              slice_us: int | None = None) -> DataFrame:
    """Row number of each row in (pos, tie) order within its keys."""
    return row_running(rows, keys, pos, tie, {out: ("sum", F.lit(1))}, slice_us)


def next_time(rows: DataFrame, keys: list[str], pos: str, tie: str, out: str,
              slice_us: int | None = None) -> DataFrame:
    """``pos`` of the next row of the same keys, NULL for the last one.

    Sliced, the first position of the keys' next slice closes each slice as a
    carry row, so the plain ``lead`` finds it.
    """
    if slice_us is None:
        w = Window.partitionBy(*keys).orderBy(pos, tie)
        return rows.withColumn(out, F.lead(pos).over(w))
    sliced = time_slices(rows, keys, pos, slice_us)(rows)
    firsts = sliced.groupBy(*keys, "_slice").agg(F.min(pos).alias("_first"))
    carry = firsts.select(
        *keys, "_slice", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_slice")).alias(pos),
        F.lit(True).alias("_carry"))
    w = Window.partitionBy(*keys, "_slice").orderBy("_carry", pos, tie)
    return (sliced.withColumn("_carry", F.lit(False))
            .unionByName(carry, allowMissingColumns=True)
            .withColumn(out, F.lead(pos).over(w))
            .filter(~F.col("_carry")).drop("_carry", "_slice"))


def nth_later(rows: DataFrame, keys: list[str], pos: str, tie: str, steps: int, out: str,
              slice_us: int | None = None) -> DataFrame:
    """``pos`` of the row ``steps`` places later within the keys, NULL past the end.

    Sliced, the rows are numbered, written once and met by number: the join key
    (keys, number) is unique on both sides, so it spreads evenly.
    """
    if slice_us is None:
        w = Window.partitionBy(*keys).orderBy(pos, tie)
        return rows.withColumn(out, F.lead(pos, steps).over(w))
    ranked = materialise(row_ranks(rows, keys, pos, tie, "_rank", slice_us), "ranked")
    ahead = ranked.select(*keys, (F.col("_rank") - steps).alias("_rank"), F.col(pos).alias(out))
    return ranked.join(ahead, [*keys, "_rank"], "left").drop("_rank")
