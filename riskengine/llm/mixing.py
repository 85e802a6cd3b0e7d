"""Temperature mixing of sources, native Spark only.

Source shares p become weights proportional to p^a. The exponent a is bisected, in steps
of a millionth: either the smallest one under which no source is read more than ``repeat``
times, or the largest one whose weights reach a share ``entropy`` of the largest possible
entropy. The bisection works on the table of sources: each round tries a hundred exponents
in one aggregate.

The budget is the smallest one that uses every document at least once, so that the source
with the largest share is read once and others up to ``repeat`` times; a smaller ``budget`` in
tokens can be given. A source's quota is its weight times the budget. Epoch by epoch its
documents stand in the order of a hash, and the first ones up to the quota are taken.
A document at the share f of its source's quota goes to block floor(f x blocks): each block
holds each source in its target weight, up to one document. Inside a block, documents of
all sources are permuted by another hash.

Running sums are taken over slices of some thousand documents cut by the hash, so a source
with most of the rows is many small windows. A document's tokens are its words and one end mark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskengine.llm.text import whole
from riskengine.session import materialise

STEPS = 1_000_000
SLICE_ROWS = 4000
BLOCK_TOKENS = 250_000
WORD = r"[^\x20\x09-\x0D]+"
SEED = 17


@dataclass(frozen=True)
class Target:
    repeat: float | None = 1.5
    entropy: float | None = None  # used if repeat is None
    budget: int | None = None


def tokens(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long") + 1


def number(*parts: Column) -> Column:
    """A pseudo-random number below 2^60 that any SQL engine can make."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def measures(sources: DataFrame, exponents: list[int]) -> dict[int, tuple[float, float]]:
    """(largest repetition, entropy as a share of the possible) under each exponent."""
    top = F.max("p").over(Window.partitionBy("step"))
    rows = sources.select("p", F.explode(F.array(*[F.lit(e) for e in exponents])).alias("step"))
    # relative to the largest share no power can overflow or vanish as a whole
    rows = rows.withColumn("x", F.pow(F.col("p") / top, F.col("step") / STEPS)).withColumn("r", F.col("x") * top / F.col("p"))
    sums = rows.groupBy("step").agg(F.max("r").alias("r"), F.sum("x").alias("z"), F.sum(F.col("x") * F.ln("x")).alias("s"), F.count("*").alias("n"))
    share = F.when(F.col("n") <= 1, 1.0).otherwise((F.ln("z") - F.col("s") / F.col("z")) / F.ln(F.col("n").cast("double")))
    return {x.step: (x.r, x.h) for x in sums.select("step", "r", share.alias("h")).collect()}


def exponent(sources: DataFrame, target: Target) -> int:
    """In millionths. 1 keeps the shares; 0 makes all sources equal. Both goals are monotone in it."""
    if target.repeat is not None:
        ok = lambda m: m[0] <= target.repeat  # noqa: E731  holds from some exponent on
    else:
        ok = lambda m: m[1] < target.entropy  # noqa: E731  fails up to some exponent
    lo, hi = -1, STEPS  # ok fails at lo, and holds at hi as far as any exponent does
    while hi - lo > 1:
        tries = sorted({lo + 1 + (hi - lo - 1) * i // 100 for i in range(100)} & set(range(lo + 1, hi)))
        seen = measures(sources, tries)
        good = [e for e in tries if e in seen and ok(seen[e])]
        bad = [e for e in tries if e in seen and not ok(seen[e])]
        if not seen:
            return STEPS
        hi = min([hi, *good])
        lo = max([lo, *(e for e in bad if e < hi)])
    if target.repeat is not None:
        return hi
    return hi if not ok(measures(sources, [hi])[hi]) else max(0, hi - 1)


def plan(df: DataFrame, target: Target = Target(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per use of a document: key, source, epoch, block, slot (its place in the block), n_tokens.

    A NULL source is a source of its own; NULL texts are empty; NULL keys and repeated rows are
    documents like others. Without rows there is nothing to plan.
    """
    rows = materialise(df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")).alias("name"),
                                 F.xxhash64(whole(text)).alias("h"), tokens(F.col(text)).alias("n")), "mixing-rows")
    sums = rows.groupBy("name").agg(F.sum("n").alias("total"), F.count("*").alias("docs"))
    sources = materialise(sums.join(F.broadcast(sums.agg(F.sum("total").alias("all")))).withColumn("p", F.col("total") / F.col("all")), "mixing-sources")
    a = exponent(sources, target) / STEPS
    best = sources.agg(F.max("p").alias("top"), F.max("total").alias("largest"), F.sum(F.pow("p", F.lit(a))).alias("z")).first()
    if best.top is None:
        top, budget, z = 1.0, 0.0, 1.0
    else:
        top, z = best.top, best.z
        budget = float(target.budget) if target.budget is not None else best.largest * z / top ** a
    share = F.pow("p", F.lit(a)) / F.lit(z)
    quota = F.round(share * F.lit(budget)).cast("long")
    table = sources.withColumn("quota", quota).withColumn("slices", F.ceil(F.col("docs") / SLICE_ROWS)).select("name", "total", "quota", "slices")
    blocks = max(1, -(-round(budget) // BLOCK_TOKENS))

    epochs = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("quota") / F.col("total")) - 1))
    used = rows.join(table, "name").where("quota > 0").withColumn("epoch", F.explode(epochs))
    used = used.withColumn("u", number(F.lit(SEED), "epoch", F.coalesce(F.col("key").cast("string"), F.lit("")))).withColumn(
        "slice", F.floor(F.col("u") / F.lit(float(1 << 60)) * F.col("slices")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("name", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = used.groupBy("name", "epoch", "slice").agg(F.sum("n").alias("n")).select("name", "epoch", "slice", before.alias("from"))
    order = Window.partitionBy("name", "epoch", "slice").orderBy("u", "key", "n", "h").rowsBetween(Window.unboundedPreceding, -1)
    at = (used.withColumn("inside", F.coalesce(F.sum("n").over(order), F.lit(0))).join(starts, ["name", "epoch", "slice"])
          .withColumn("at", F.col("epoch") * F.col("total") + F.col("from") + F.col("inside")).where("at < quota"))
    block = F.floor(F.col("at") / F.col("quota") * blocks).cast("long")
    mixed = number(F.lit(SEED + 1), "epoch", "name", F.coalesce(F.col("key").cast("string"), F.lit("")))
    inner = Window.partitionBy("block").orderBy("v", "key", "epoch", "n", "h")
    return (at.withColumn("block", block).withColumn("v", mixed).withColumn("slot", F.row_number().over(inner).cast("long"))
            .select(F.col("key").alias(key), F.col("source").alias(source), "epoch", "block", "slot", F.col("n").alias("n_tokens"), F.col("h").alias("_h")))


def mix(df: DataFrame, target: Target = Target(), key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents with all their columns, each as often as its plan uses it.

    Texts are dealt out once, by content; copies of one content share its uses evenly.
    """
    names = ["_k", "_h"]
    number_key = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    uses = materialise(plan(df, target, key, source, text).select(number_key.alias("_k"), F.col("_h"), F.col(source).alias("_s")).groupBy(
        *names, "_s").agg(F.count("*").alias("_uses")), "mixing-uses")
    same = Window.partitionBy(*names, "_s")
    rows = df.withColumn("_k", number_key).withColumn("_h", F.xxhash64(whole(text))).withColumn("_s", F.col(source))
    both = rows.alias("d").join(uses.alias("u"), (F.col("d._k") == F.col("u._k")) & (F.col("d._h") == F.col("u._h")) & F.col("d._s").eqNullSafe(F.col("u._s")))
    both = both.select("d.*", "u._uses").withColumn("_of", F.count("*").over(same)).withColumn("_at", F.row_number().over(same.orderBy(F.lit(1))))
    times = F.floor(F.col("_uses") / F.col("_of")) + (F.col("_at") <= F.col("_uses") % F.col("_of")).cast("int")
    return both.withColumn("_times", times.cast("int")).where("_times > 0").withColumn(
        "_each", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*df.columns)
