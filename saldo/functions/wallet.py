"""What a wallet row is about and whose order it belongs to, from its remark and its merchant order id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saldo.functions.money import column
from saldo.functions.rules import matcher, outcome, winner

# Rules in their order, as (how, text, meaning); the first that matches wins.
DESCRIPTIONS = (
    ("regex", "^订单.*打款$", "0010001|交易收款-交易收款"),
    ("regex", "^订单.*退款$", "0020001|交易退款-余额退款"),
    ("starts", "品牌新享-首单拉新计划", "品牌新享-首单拉新计划"),
    ("contains", "品牌新享天猫新客营销托管", "品牌新享天猫新客营销托管"),
    ("starts", "品牌新享-超级流量加速软件服务费", "品牌新享-超级流量加速软件服务费"),
    ("starts", "品牌新享新品孵化软件服务费", "品牌新享新品孵化软件服务费"),
    ("regex", "^订单.*保证金管控资金使用$", "008000200003|保证金-天猫-扣除转移"),
    ("starts", "淘宝平台提现", "其他支出\\收入"),
    ("starts", "淘宝新品礼金技术服务费", "淘宝新品礼金技术服务费"),
    ("starts", "淘宝新客礼金技术服务费", "淘宝新客礼金技术服务费"),
    ("starts", "品牌新享淘宝老客礼金软件服务费", "品牌新享淘宝老客礼金软件服务费"),
    ("starts", "品牌新享淘宝限时礼金软件服务费", "品牌新享淘宝限时礼金软件服务费"),
    ("starts", "品牌新享淘宝新客营销托管", "品牌新享淘宝新客营销托管"),
    ("starts", "品牌新享天猫超级老客加速软件服务费", "品牌新享天猫超级老客加速软件服务费"),
    ("starts", "品牌新享-淘宝营销托管软件服务费", "品牌新享-淘宝营销托管软件服务费"),
    ("starts", "阿里妈妈无界账户", "万相台"),
    ("starts", "店铺过户自动提现", "其他支出\\收入"),
    ("starts", "淘特营销推广服务费", "淘特营销推广服务费"),
    ("starts", "品牌新享-限时加速服务费", "品牌新享-限时加速服务费"),
    ("starts", "品牌新享-天猫营销托管软件服务费", "品牌新享-天猫营销托管软件服务费"),
    ("starts", "品牌新享天猫新品营销托管", "品牌新享天猫新品营销托管"),
    ("starts", "猫猫币抵扣项目平台垫付资金", "猫猫币抵扣项目平台垫付资金"),
    ("starts", "先用后付技术服务费", "先用后付技术服务费"),
    ("equals", "保证金额度不足充值", "保证金额度不足充值"),
    ("starts", "天猫APP专享折扣服务费", "天猫APP专享折扣服务费"),
    ("starts", "猫猫币抵扣项目推广服务费", "猫猫币抵扣项目推广服务费"),
    ("contains", "保证金充值", "保证金充值"),
    ("contains", "光合平台软件服务费", "光合平台软件服务费"),
)
# An order id, one behind a prefix, and one that a deposit's remark names.
ORDER_ID, PREFIXED, NAMED = r"^\d{19}$", r"(?i)(?<![A-Z0-9])T200P(\d{19})(?!\d)", r"订单编号：(\d{19})(?!\d)"
DEPOSIT = "保证金充值"


def description(remark: Column | str) -> tuple[Column, Column]:
    """(index of the rule that wins or -1, meaning) of a remark; blank remarks match nothing."""
    text = F.trim(column(remark))
    index = winner([matcher(text, how, value) for how, value, _ in DESCRIPTIONS])
    return index, outcome(index, [meaning for *_, meaning in DESCRIPTIONS])


def _distinct(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))


def order_key(merchant: Column | str, remark: Column | str, meaning: Column | str) -> tuple[Column, Column]:
    """(key, status): a merchant id that is an order's; the one prefixed id of both texts; for a deposit the one order its remark
    names; else none, with the status ambiguous or missing."""
    own, text = F.coalesce(F.trim(column(merchant)), F.lit("")), F.coalesce(F.trim(column(remark)), F.lit(""))
    prefixed = F.array_union(_distinct(own, PREFIXED), _distinct(text, PREFIXED))
    named = F.when(F.coalesce(column(meaning) == DEPOSIT, F.lit(False)), _distinct(text, NAMED)).otherwise(F.array().cast("array<string>"))
    tests = [own.rlike(ORDER_ID), F.size(prefixed) == 1, F.size(prefixed) > 1, F.size(named) == 1, F.size(named) > 1]
    index = winner(tests)
    return outcome(index, [own, F.get(prefixed, 0), None, F.get(named, 0), None]), outcome(index, ["found", "found", "ambiguous", "found", "ambiguous"], "missing")
