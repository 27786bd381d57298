"""Rows of each kind of source as canonical rows, or the reason why a row is refused.

A kind names its side and metric and makes the key, the amount, the day and the
refusals out of the columns that it needs. All of it is one projection: accepted
and refused rows are two filters over the same scan, and no row is lost.

Cells are text as they came. Amounts are understood by `parse_number`, days by
`parse_date`; a month stands for its first day.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions import text
from saldo.functions.money import MONEY

# Words for money in, money out, and entities that are products.
INCOMING = ("收入", "入账", "收款")
OUTGOING = ("支出", "出账", "付款", "扣款")
PRODUCTS = ("商品", "product")

MONTH_ONLY = r"^((?:19|20)\d{2})[-/.年]?(0?[1-9]|1[0-2])月?$"
MONTHS = r"((?:19|20)\d{2}[-/.年]?(?:0[1-9]|1[0-2]))"


def cell(name: str) -> Column:
    """A cell's text; blanks and null tokens are null."""
    return text.clean_cell(F.col(name).cast("string"))


def amount(name: str, blank_is_zero: bool = False) -> Column:
    value = text.parse_number(F.col(name).cast("string"))
    return F.when(cell(name).isNull(), F.lit(0).cast(MONEY)).otherwise(value) if blank_is_zero else value


def day_of(*names: str) -> Column:
    """The day in the first of the cells that is filled."""
    shown = F.coalesce(*map(cell, names))
    month = F.try_to_date(F.concat_ws("-", F.regexp_extract(shown, MONTH_ONLY, 1), F.lpad(F.regexp_extract(shown, MONTH_ONLY, 2), 2, "0"), F.lit("01")))
    return F.when(shown.rlike(MONTH_ONLY), month).otherwise(text.parse_date(shown))


def precision_of(*names: str) -> Column:
    """Whether a time is told to the second, the day or the month."""
    shown = F.coalesce(*map(cell, names))
    return F.when(shown.rlike(MONTH_ONLY), "month").when(shown.rlike(r"\d{1,2}:\d{2}"), "second").otherwise("day")


def spans_months(*names: str) -> Column:
    """Whether a cell names two months or more, as a range does."""
    shown = F.coalesce(*map(cell, names))
    months = F.regexp_extract_all(shown, F.lit(MONTHS), F.lit(1))
    several = F.size(F.array_distinct(F.transform(months, lambda m: F.regexp_replace(m, r"\D", "")))) > 1
    # Two months have twelve characters at least.
    return F.coalesce(F.when(F.length(shown) >= 12, several), F.lit(False))


@dataclass(frozen=True)
class Kind:
    """What a kind of source says about each of its rows."""

    dataset: str
    side: str
    metric: str
    key: Column
    key_kind: Column
    value: Column
    day: Column
    precision: Column
    sku: Column = field(default_factory=lambda: F.lit(None).cast("string"))
    refused: tuple[tuple[str, Column], ...] = ()


def _dated(*names: str) -> dict:
    return {"day": day_of(*names), "precision": precision_of(*names)}


def _range(*names: str) -> tuple[str, Column]:
    return "ambiguous_period", spans_months(*names)


def orders() -> Kind:
    """Paid less refunded; a negative payment is refused, never turned around."""
    paid, refund = amount("paid_amount"), F.abs(amount("refund_amount", blank_is_zero=True))
    return Kind("order", "order", "net_order_amount", cell("order_id"), F.lit("order_id"), paid - refund, sku=cell("sku"), refused=(("unexpected_amount_direction", paid < 0), _range("business_date")), **_dated("business_date"))


def _wallet_key() -> dict:
    order = cell("merchant_order_id")
    return {"key": F.coalesce(order, cell("transaction_id")), "key_kind": F.when(order.isNotNull(), "merchant_order_id").otherwise("transaction_id")}


def two_column_ledger() -> Kind:
    """Income and expense in columns of their own; blanks are zero."""
    value = F.abs(amount("income_amount", True)) - F.abs(amount("expense_amount", True))
    return Kind("platform_ledger", "platform", "platform_net_amount", value=value, refused=(_range("accounting_date"),), **_wallet_key(), **_dated("accounting_date"))


def direction_ledger() -> Kind:
    """One amount whose sign a word tells; other words are refused."""
    size, word = F.abs(amount("amount")), F.coalesce(text.fold_header(F.col("direction").cast("string")), F.lit(""))
    value = F.when(word.isin(*INCOMING), size).when(word.isin(*OUTGOING), -size)
    unknown = ("unknown_money_direction", ~word.isin(*INCOMING, *OUTGOING))
    return Kind("platform_ledger", "platform", "platform_net_amount", value=value, refused=(unknown, _range("accounting_date")), **_wallet_key(), **_dated("accounting_date"))


def platform_fee() -> Kind:
    """A fee, always negative, under the first order number that is filled."""
    names = ("sub_order_id", "main_order_id", "merchant_order_id")
    key = F.coalesce(*map(cell, names))
    kind = F.coalesce(*[F.when(cell(n).isNotNull(), n) for n in names])
    return Kind("platform_fee", "platform", "platform_fee", key, kind, -F.abs(amount("fee_amount")), sku=cell("sku"), refused=(_range("business_date", "billing_period"),), **_dated("business_date", "billing_period"))


def cost(month: str | None = None) -> Kind:
    """Minus quantity times unit cost, four decimals with halves to even; without a day it falls on the month given."""
    exact = F.bround(amount("quantity").cast("decimal(18,4)") * amount("unit_cost").cast("decimal(18,4)"), 4)
    key = F.when(cell("order_id").isNotNull() & cell("sku").isNotNull(), F.concat_ws("|", cell("order_id"), cell("sku")))
    day, precision = day_of("business_date"), precision_of("business_date")
    if month:
        blank = cell("business_date").isNull()
        day, precision = F.when(blank, F.to_date(F.lit(f"{month}-01"))).otherwise(day), F.when(blank, "month").otherwise(precision)
    return Kind("cost", "operational", "cost", key, F.lit("order_id+sku"), -exact.cast(MONEY), day, precision, cell("sku"), (_range("business_date"),))


def advertising() -> Kind:
    """Spend by day and campaign; a product is named only by rows about products."""
    entity = F.coalesce(F.lower(cell("entity_type")), F.lit(""))
    day = day_of("business_date")
    key = F.when(day.isNotNull() & cell("campaign").isNotNull(), F.concat_ws("|", day.cast("string"), cell("campaign")))
    sku = F.when(entity.isin("", *PRODUCTS), cell("sku"))
    return Kind("advertising", "operational", "advertising", key, F.lit("business_date+campaign"), -F.abs(amount("spend_amount")), day, precision_of("business_date"), sku, (_range("business_date"),))


def freight() -> Kind:
    """A carrier's statement by tracking number."""
    return Kind("freight", "operational", "freight", cell("tracking_number"), F.lit("tracking_number"), -F.abs(amount("freight_amount")), sku=cell("sku"), refused=(_range("business_date"),), **_dated("business_date"))


def order_freight(row: str = "row_no") -> Kind:
    """Freight that the shop notes by order and row, its sign as it stands."""
    key = F.when(cell("order_id").isNotNull(), F.concat_ws("|", cell("order_id"), F.col(row).cast("string")))
    return Kind("freight", "operational", "freight", key, F.lit("order_id+source_row"), amount("freight_amount"), refused=(_range("business_date"),), **_dated("business_date"))


def period_control() -> Kind:
    """Declared income and expense of a period."""
    value = F.abs(amount("income_amount")) - F.abs(amount("expense_amount"))
    return Kind("control_total", "platform", "platform_control_net", cell("period"), F.lit("control_period"), value, refused=(_range("period"),), **_dated("period"))


def category_control(month: str) -> Kind:
    """Declared totals of a category in a known month; the declared net must be income less expense."""
    net, made = amount("net_amount"), F.abs(amount("income_amount")) - F.abs(amount("expense_amount"))
    key = F.concat_ws("|", F.lit(month), F.coalesce(cell("category"), F.lit("")))
    return Kind("control_total", "platform", "platform_control_net", key, F.lit("control_period+category"), net, F.to_date(F.lit(f"{month}-01")), F.lit("month"), refused=(("control_total_mismatch", net != made),))


def canonical(rows: DataFrame, kind: Kind, keep: tuple[str, ...] = ()) -> DataFrame:
    """One canonical row per row: the columns kept, then key, amount, day and, if it is refused, the issue."""
    # What is read of a row's cells is worked out once, in a projection of its own.
    read = rows.select(
        *keep, kind.key.alias("_key"), kind.key_kind.alias("_key_kind"), kind.sku.alias("_sku"), kind.day.alias("_day"), kind.precision.alias("_precision"), kind.value.cast(MONEY).alias("_value"),
        *[F.coalesce(test, F.lit(False)).alias(f"_refused{i}") for i, (_, test) in enumerate(kind.refused)],
    )
    own = [F.when(F.col(f"_refused{i}"), code) for i, (code, _) in enumerate(kind.refused)]
    issue = F.coalesce(F.when(F.col("_key").isNull(), "missing_business_key"), *own, F.when(F.col("_day").isNull(), "missing_occurred_at"), F.when(F.col("_value").isNull(), "invalid_money"))
    said = read.select(
        *keep, F.lit(kind.dataset).alias("dataset"), F.lit(kind.side).alias("side"), F.lit(kind.metric).alias("metric"), F.col("_key").alias("business_key"), F.col("_key_kind").alias("key_kind"),
        F.col("_sku").alias("sku"), F.col("_day").alias("occurred_on"), F.col("_precision").alias("precision"), F.col("_value").alias("amount"), issue.alias("issue"),
    )
    return said.withColumn("amount", F.when(F.col("issue").isNull(), F.col("amount")))
