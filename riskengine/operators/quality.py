"""Data-quality expectations. All row rules run in one aggregate pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskengine.functions.timing import event_date, hours_between


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    unexpected: Column | None = None   # row rules: true for a bad row
    kind: str = "row"                  # row | exists | type | unique | order
    arg: str = ""
    mostly: float = 1.0                # the share of rows that has to be as expected


def exists(column: str) -> Rule:
    return Rule("column_exists", column, kind="exists")


def of_type(column: str, type_name: str) -> Rule:
    return Rule("type_is", column, kind="type", arg=type_name)


def unique(column: str) -> Rule:
    return Rule("unique", column, kind="unique")


def between(column: str, low: float | None = None, high: float | None = None) -> Rule:
    c = F.col(column)
    bad = F.lit(False)
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return Rule("between", column, bad)


def greater(a: str, b: str) -> Rule:
    return Rule("greater_than_" + b, a, F.col(a) <= F.col(b))


def not_null(column: str) -> Rule:
    return Rule("not_null", column, F.col(column).isNull())


def in_set(column: str, values: list) -> Rule:
    return Rule("in_set", column, ~F.col(column).isin(values))


def increasing(column: str, mostly: float = 1.0) -> Rule:
    """Values never fall along a stored table (see :func:`with_places`); NULLs are passed over."""
    return Rule("increasing", column, kind="order", mostly=mostly)


def with_places(df: DataFrame) -> DataFrame:
    """A table as read from files, with the place of each row: rows of a file in their order, files by their paths."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


SCHEMA_SUITE = [exists(c) for c in ("transaction_id", "amount", "event_timestamp", "payer_id", "currency")]


def transaction_suite() -> list[Rule]:
    return SCHEMA_SUITE + [
        between("amount", low=0.01), of_type("transaction_id", "string"), unique("transaction_id"),
        greater("label_available_timestamp", "event_timestamp"),
        not_null("label_available_timestamp")]


def business_suite() -> list[Rule]:
    return [between("amount", 0, 1_000_000), in_set("currency", ["INR"]), not_null("payer_id")]


def quality_report(df: DataFrame, suites: dict[str, list[Rule]] | None = None) -> DataFrame:
    """(suite, rule, column, unexpected, total, pct, success), one row per rule."""
    suites = suites or {"transactions": transaction_suite(), "business_logic": business_suite()}
    rules = [(s, i, r) for s, rs in suites.items() for i, r in enumerate(rs)]
    cols = set(df.columns)
    row_rules = [(s, i, r) for s, i, r in rules if r.kind == "row" and r.column in cols]
    aggs = [F.count(F.when(F.coalesce(r.unexpected, F.lit(False)), 1)).alias(f"u_{n}")
            for n, (_, _, r) in enumerate(row_rules)]
    one = df.agg(F.count(F.lit(1)).alias("total"), *aggs)

    def entry(s, i, r, bad, total):
        return F.struct(F.lit(s).alias("suite"), F.lit(i).alias("position"), F.lit(r.name).alias("rule"),
                        F.lit(r.column).alias("column"), bad.cast("long").alias("unexpected"),
                        total.cast("long").alias("total"), F.lit(float(r.mostly)).alias("_mostly"))

    entries = [entry(s, i, r, F.col(f"u_{n}"), F.col("total"))
               for n, (s, i, r) in enumerate(row_rules)]
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    for s, i, r in rules:
        if r.kind == "exists":
            entries.append(entry(s, i, r, F.lit(0 if r.column in cols else 1), F.lit(1)))
        elif r.kind == "type":
            entries.append(entry(s, i, r, F.lit(0 if types.get(r.column) == r.arg else 1), F.lit(1)))
        elif r.kind == "row" and r.column not in cols:
            entries.append(entry(s, i, r, F.col("total"), F.col("total")))
    for n, (s, i, r) in enumerate((s, i, r) for s, i, r in rules if r.kind == "unique"):
        # every row of a repeated value is unexpected; NULLs are not compared
        repeated = (df.filter(F.col(r.column).isNotNull()).groupBy(r.column)
                    .agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias(f"dup_{n}")))
        one = one.crossJoin(F.broadcast(repeated))  # one row each
        entries.append(entry(s, i, r, F.col(f"dup_{n}"), F.col("total")))
    for n, (s, i, r) in enumerate((s, i, r) for s, i, r in rules if r.kind == "order"):
        found = out_of_order(df, r.column).withColumnsRenamed({"unexpected": f"fall_{n}", "total": f"of_{n}"})
        one = one.crossJoin(F.broadcast(found))  # one row each
        entries.append(entry(s, i, r, F.col(f"fall_{n}"), F.col(f"of_{n}")))
    e = one.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return e.withColumns({
        "pct": F.when(F.col("total") > 0, 100 * F.col("unexpected") / F.col("total")).otherwise(0.0),
        "success": F.col("total") - F.col("unexpected") >= F.col("_mostly") * F.col("total")}).drop("_mostly")


def gate(report: DataFrame) -> bool:
    """Stops a load when a rule failed (the report has one row per rule)."""
    failed = [f"{r['suite']}.{r['rule']}({r['column']})" for r in report.filter(~F.col("success")).collect()]
    if failed:
        raise ValueError("data quality gate: " + ", ".join(failed))
    return True


def fraud_summary(df: DataFrame) -> DataFrame:
    """Rows, frauds and rate by pattern; the NULL pattern is a group of its own."""
    return df.groupBy("fraud_pattern").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_fraud") == 1, 1)).alias("frauds"),
        F.avg(F.col("is_fraud").cast("double")).alias("fraud_rate"))


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, distinct ids, time bounds and labels in one row."""
    g = df.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_timestamp").alias("a"), F.max("event_timestamp").alias("b"),
        F.count("is_fraud").alias("l"), F.count(F.when(F.col("is_fraud") == 1, 1)).alias("f"))
    return g.agg(F.sum("n").alias("n_rows"), F.count("transaction_id").alias("n_ids"),
                 event_date(F.min("a")).cast("string").alias("first_day"),
                 event_date(F.max("b")).cast("string").alias("last_day"),
                 F.sum("l").alias("n_labelled"), F.sum("f").alias("n_fraud"))


def label_delay_stats(df: DataFrame) -> DataFrame:
    h = hours_between("label_available_timestamp", "event_timestamp")
    return df.agg(F.count(h).alias("n"), F.avg(h).alias("avg_hours"), F.min(h).alias("min_hours"),
                  F.max(h).alias("max_hours"), F.count(F.when(h <= 0, 1)).alias("not_after_event"))


def feature_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, max, mean, negatives and NULLs of each column, one pass."""
    aggs, rows = [], []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        aggs += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"), F.avg(v).alias(f"c{i}"),
                 F.count(F.when(v < 0, 1)).alias(f"d{i}"), F.count(F.when(v.isNull(), 1)).alias(f"e{i}")]
        rows.append(F.struct(F.lit(c).alias("feature"), F.col(f"a{i}").alias("min_value"),
                             F.col(f"b{i}").alias("max_value"), F.col(f"c{i}").alias("avg_value"),
                             F.col(f"d{i}").alias("n_negative"), F.col(f"e{i}").alias("n_null")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def monotonicity_violations(features: DataFrame) -> DataFrame:
    """Rows where a longer window holds less than a shorter one."""
    def bad(a, b):
        return F.col(a) > F.col(b)
    c = "payer_txn_count_"
    return features.filter(bad(c + "5min", c + "1h") | bad(c + "1h", c + "24h")
                           | bad("device_txn_count_1h", "device_txn_count_24h"))


def consistency_check(transactions: DataFrame, features: DataFrame, expected_columns: int = 13,
                      low: float = 0.0, high: float = 0.2) -> DataFrame:
    """Row counts of both tables, column count and fraud-rate band in one row."""
    t = transactions.agg(F.count(F.lit(1)).alias("n_transactions"),
                         F.avg(F.col("is_fraud").cast("double")).alias("fraud_rate"))
    f = features.agg(F.count(F.lit(1)).alias("n_features"))
    return t.crossJoin(F.broadcast(f)).withColumns({
        "rows_match": F.col("n_transactions") == F.col("n_features"),
        "columns_match": F.lit(len(features.columns) == expected_columns),
        "fraud_rate_in_band": F.col("fraud_rate").between(low, high)})


def file_order(df: DataFrame, column: str, mostly: float = 1.0) -> DataFrame:
    """Per file, the share of rows not below the row before them.

    A distributed table has no row order; a Parquet file does.
    """
    w = Window.partitionBy("_file").orderBy("_row")
    rows = df.select(F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.row_index").alias("_row"), F.col(column).alias("_v"))
    ok = F.col("_v") >= F.lag("_v").over(w)
    share = F.avg(F.coalesce("_ok", F.lit(True)).cast("double"))
    return (rows.withColumn("_ok", ok).groupBy("_file").agg(share.alias("increasing_share"))
            .withColumn("success", F.col("increasing_share") >= mostly)
            .withColumnRenamed("_file", "file"))


def out_of_order(df: DataFrame, column: str) -> DataFrame:
    """One row: how many values are below the value before them, of how many.

    ``df`` has places. Each file is judged by itself, in one task; then files meet through one row each, which
    carries the first and the last value of a file, so falls between files count as well.
    """
    rows = df.select("_file", "_row", F.col(column).alias("_v"))
    before = Window.partitionBy("_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    held = F.when(F.col("_v").isNotNull(), F.struct("_row", "_v"))
    files = rows.withColumn("_before", F.last("_v", ignorenulls=True).over(before)).groupBy("_file").agg(
        F.count("_v").alias("n"), F.count(F.when(F.col("_v") < F.col("_before"), 1)).alias("falls"),
        F.min(held)["_v"].alias("first"), F.max(held)["_v"].alias("last"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    joint = F.coalesce(F.col("first") < F.last("last", ignorenulls=True).over(earlier), F.lit(False))
    return files.select("n", (F.col("falls") + joint.cast("long")).alias("falls")).agg(
        F.coalesce(F.sum("falls"), F.lit(0)).alias("unexpected"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def dataset_validation(df: DataFrame) -> DataFrame:
    """Unique ids, labels strictly after events, fraud totals, as (check, unexpected, total); of a table with places also its time order."""
    rules = [unique("transaction_id"), greater("label_available_timestamp", "event_timestamp"), not_null("event_timestamp")]
    if "_file" in df.columns:
        rules.append(increasing("event_timestamp"))
    report = quality_report(df, {"dataset": rules})
    fraud = df.agg(F.lit("fraud_total").alias("rule"),
                   F.count(F.when(F.col("is_fraud") == 1, 1)).alias("unexpected"),
                   F.count(F.lit(1)).alias("total"))
    return report.select("rule", "unexpected", "total").unionByName(fraud)
