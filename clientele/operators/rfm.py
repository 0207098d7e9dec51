"""Transaction log in, one row per customer out."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.errors import DataProblem
from clientele.functions.coerce import dtype_of, half_even, is_blank, is_text, quoted, to_number, to_timestamp
from clientele.functions.rules import RFM_DEFAULT_BASES, RFM_FEATURES
from clientele.session import use_utc, written

MICROS_PER_DAY = 86_400_000_000
BLANK_ORDER = "The order ID contains blank values: fill them, or leave the order column out to count rows."
NO_ROWS = "No transaction has a customer, a readable date and a readable amount."
EARLY_REFERENCE = "The reference date lies before the latest purchase."


def _check_roles(frame: DataFrame, customer: str, when: str, amount: str, order: str | None) -> None:
    roles = [customer, when, amount] + ([order] if order else [])
    if len(set(roles)) < len(roles):
        raise DataProblem("Customer, date, amount and order must be four different columns.")
    absent = [name for name in roles if name not in frame.columns]
    if absent:
        raise DataProblem("Columns not found in the transactions: " + ", ".join(absent))


def usable_transactions(
    frame: DataFrame,
    customer: str,
    when: str,
    amount: str,
    order: str | None = None,
    formats: Sequence[str] = (),
) -> DataFrame:
    """Typed transactions ``(customer_id, purchased, amount[, order_id])`` without rows that miss a key value."""
    columns = [
        quoted(customer).alias("customer_id"),
        to_timestamp(quoted(when), dtype_of(frame, when), formats).alias("purchased"),
        to_number(quoted(amount), dtype_of(frame, amount)).alias("amount"),
    ]
    if order:
        columns.append(quoted(order).alias("order_id"))
    # The raw null tests reach the file scan; the typed ones catch values that could not be read.
    present = quoted(customer).isNotNull() & quoted(when).isNotNull() & quoted(amount).isNotNull()
    return frame.filter(present).select(*columns).dropna(subset=["customer_id", "purchased", "amount"])


def _days(micros: Column) -> Column:
    return half_even(micros / F.lit(float(MICROS_PER_DAY)), 2)


def _literal_instant(value: str | date | datetime) -> datetime:
    if isinstance(value, str):
        try:
            value = datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError as problem:
            raise DataProblem(f"The reference date {value!r} is not an ISO date.") from problem
    elif not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)


def build_rfm(
    frame: DataFrame,
    customer_column: str,
    date_column: str,
    amount_column: str,
    order_column: str | None = None,
    reference_date: str | date | datetime | None = None,
    *,
    date_formats: Sequence[str] = (),
    check: bool = True,
) -> DataFrame:
    """One row per customer with recency, frequency, monetary value, mean order value and tenure.

    With an order column, lines are first summed per (customer, order). That first shuffle is keyed on both columns,
    so a customer who owns a third of the log is spread over all tasks and reaches the second shuffle as one partial
    row per task. Without a reference date, recency counts to one day after the latest purchase.

    The log is read once. Whenever the whole log must be known (``check=True``, or no reference date), the roll-up, one
    row per customer, is written to the shared folder, and the latest purchase and the blank orders are taken from
    there. ``check=True`` raises ``DataProblem`` at once; otherwise problems surface as a Spark error when the result is
    used. Text dates without ``date_formats`` have their format detected from the whole column first.
    """
    use_utc(frame.sparkSession)
    _check_roles(frame, customer_column, date_column, amount_column, order_column)
    fixed = None if reference_date is None else _literal_instant(reference_date)
    if not date_formats and is_text(dtype_of(frame, date_column)):
        date_formats = detect_date_formats(frame, date_column)
    log = usable_transactions(frame, customer_column, date_column, amount_column, order_column, date_formats)

    if order_column:
        blank = is_blank(F.col("order_id"))
        orders = (
            log.select("customer_id", F.when(~blank, F.col("order_id").cast("string")).alias("order_id"), "purchased", "amount")
            .groupBy("customer_id", "order_id")
            .agg(
                F.sum("amount").alias("order_value"),
                F.min("purchased").alias("opened"),
                F.max("purchased").alias("closed"),
            )
        )
        if not check:
            stop = F.raise_error(F.lit(BLANK_ORDER)).cast("double")
            orders = orders.withColumn("order_value", F.when(F.col("order_id").isNull(), stop).otherwise(F.col("order_value")))
        unnamed = F.count_if(F.col("order_id").isNull())
    else:
        orders = log.select(
            "customer_id",
            F.col("amount").alias("order_value"),
            F.col("purchased").alias("opened"),
            F.col("purchased").alias("closed"),
        )
        unnamed = F.lit(0).cast("long")
    customers = orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.sum("order_value").alias("monetary_value"),
        F.avg("order_value").alias("average_order_value"),
        F.min("opened").alias("first_purchase"),
        F.max("closed").alias("last_purchase"),
        unnamed.alias("unnamed_orders") if order_column else F.max(unnamed).alias("unnamed_orders"),
    )
    last = F.unix_micros("last_purchase")
    newest = None
    if check or fixed is None:
        customers = written(customers)
        newest = _check_rolled(customers, check, fixed)
    if fixed is None:
        reference = F.lit(newest).cast("long") + F.lit(MICROS_PER_DAY)
    else:
        moment = F.lit(int((fixed - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000))
        reference = F.when(last > moment, F.raise_error(F.lit(EARLY_REFERENCE)).cast("long")).otherwise(moment)
    return customers.select(
        "customer_id",
        _days(reference - last).alias("recency_days"),
        "frequency",
        "monetary_value",
        "average_order_value",
        _days(last - F.unix_micros("first_purchase")).alias("customer_tenure_days"),
    )


def _check_rolled(customers: DataFrame, check: bool, reference: datetime | None) -> int | None:
    """Latest purchase of a written roll-up; with ``check``, the reasons why it must not be used."""
    found = customers.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("unnamed_orders").alias("blank"), F.unix_micros(F.max("last_purchase")).alias("latest")
    ).first()
    if check:
        if not found["rows"]:
            raise DataProblem(NO_ROWS)
        if reference is not None and reference.timestamp() * 1_000_000 < found["latest"]:
            raise DataProblem(EARLY_REFERENCE)
        if found["blank"]:
            raise DataProblem(BLANK_ORDER)
    return found["latest"]


# Date layouts that are tried on text columns, after the ISO forms.
DATE_LAYOUTS = (
    "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "d.M.yyyy", "M-d-yyyy", "d-M-yyyy", "yyyyMMdd", "d MMM yyyy", "MMM d, yyyy",
    "M/d/yyyy H:m", "d/M/yyyy H:m", "yyyy/M/d H:m", "d.M.yyyy H:m", "M/d/yyyy H:m:s", "d/M/yyyy H:m:s", "yyyy/M/d H:m:s",
    "d.M.yyyy H:m:s",
)
MIXED_DATES = "The dates of column {} can be read as month/day and as day/month: pass date_formats."


def detect_date_formats(frame: DataFrame, column: str) -> list[str]:
    """Layouts that the text dates of a column need beside the ISO forms, from all its values in one aggregate.

    A value is looked at only if the ISO forms do not read it. Day and month change places in some layouts: a pair
    of such layouts is decided by the values that only one of them reads. If no value decides, or values decide both
    ways, that is an error, not a guess.
    """
    value = quoted(column)
    left = frame.select(value.alias("v")).filter(value.isNotNull() & value.try_cast("timestamp").isNull() & ~is_blank(value))
    read = {layout: F.try_to_timestamp("v", F.lit(layout)).isNotNull() for layout in DATE_LAYOUTS}
    twins = [(a, a.replace("M", "#").replace("d", "M").replace("#", "d")) for a in DATE_LAYOUTS if a.startswith("M") and a[1] in "/-"]
    facts = [F.count_if(test).alias(f"n{i}") for i, test in enumerate(read.values())]
    for i, (one, other) in enumerate(twins):
        differ = read[one] & read[other] & (F.try_to_timestamp("v", F.lit(one)) != F.try_to_timestamp("v", F.lit(other)))
        facts += [
            F.count_if(read[one] & ~read[other]).alias(f"a{i}"), F.count_if(read[other] & ~read[one]).alias(f"b{i}"), F.count_if(differ).alias(f"d{i}")
        ]
    found = left.agg(*facts).first()
    kept = [layout for i, layout in enumerate(DATE_LAYOUTS) if found[f"n{i}"]]
    for i, (one, other) in enumerate(twins):
        if found[f"a{i}"] and found[f"b{i}"] or found[f"d{i}"] and not (found[f"a{i}"] or found[f"b{i}"]):
            raise DataProblem(MIXED_DATES.format(column))
        loser = other if found[f"a{i}"] else one if found[f"b{i}"] else None
        kept = [layout for layout in kept if layout != loser]
    return kept


def rfm_bases(chosen: Sequence[str] | None = None) -> tuple[tuple[str, ...], list[str]]:
    """Validated basis names for a rolled-up table, with a warning when value is counted twice."""
    bases = tuple(chosen) if chosen is not None else RFM_DEFAULT_BASES
    unknown = [name for name in bases if name not in RFM_FEATURES]
    if unknown:
        raise DataProblem("Not produced by the roll-up: " + ", ".join(unknown))
    notes = []
    if {"frequency", "monetary_value", "average_order_value"} <= set(bases):
        notes.append("Monetary value is frequency times average order value: drop one of the three.")
    return bases, notes
