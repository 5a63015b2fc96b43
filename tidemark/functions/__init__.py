"""Column helpers shared by the views and queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def period(ts: Column, pattern: str) -> Column:
    """A date pattern of a timestamp as an integer, such as 202401."""
    return F.date_format(ts, pattern).cast("int")


def none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def exact_product(rate: Column, amount: Column) -> Column:
    """rate * amount without loss: operands are narrowed first, as wide decimals would drop digits."""
    return (rate.cast("decimal(15,6)") * amount.cast("decimal(22,3)")).cast("decimal(38,10)")


def joined_values(value: Column, distinct: bool = False, most: int = 1000) -> Column:
    """Values in order, joined by commas, the first `most` characters; null without any value."""
    values = F.array_sort(F.collect_set(value) if distinct else F.collect_list(value))
    return F.when(F.size(values) > 0, F.substring(F.array_join(values, ","), 1, most))


def bare_head(head: Column) -> Column:
    """A summary's head id without the deletion mark that ends it."""
    return F.replace(F.replace(head, F.lit("false"), F.lit("")), F.lit("true"), F.lit(""))


def weighted_values(value: str, weight: str, most: int = 1000) -> Column:
    """As joined_values, with every value as often as its row weighs."""
    values = F.array_sort(F.array_compact(F.flatten(F.collect_list(F.expr(f"array_repeat({value}, CAST({weight} AS INT))")))))
    return F.when(F.size(values) > 0, F.substring(F.array_join(values, ","), 1, most))
