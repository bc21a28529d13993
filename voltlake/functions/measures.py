"""Expressions over measures: quality flags, component sums, balance KPIs."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero_flag(value: Column, variant: str) -> Column:
    """Variant "A": zero or unknown; variant "B": known and exactly zero."""
    if variant == "A":
        return F.coalesce(value, F.lit(0.0)) == 0
    if variant == "B":
        return F.coalesce(value == 0, F.lit(False))
    raise ValueError(f"unknown variant: {variant}")


def date_mismatch_flag(ts: Column, local_date: Column) -> Column:
    """True where both dates are known and differ."""
    return F.coalesce(F.to_date(ts) != local_date, F.lit(False))


def bad_hour_flag(hour: Column) -> Column:
    return ~F.coalesce(hour.between(1, 25), F.lit(False))


def component_sum(components: Iterable[str]) -> Column:
    """Null-safe sum, left to right."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in components])


def component_gap(total: str, components: Iterable[str]) -> Column:
    """Absolute difference between a total and the sum of its components, nulls as 0."""
    return F.abs(F.coalesce(F.col(total), F.lit(0.0)) - component_sum(components))


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is null or 0."""
    return F.try_divide(numerator, denominator)


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def balance_columns(consumption: Column, production: Column) -> dict[str, Column]:
    """Balance, ratio and the two exclusive flags; equality and unknown values raise neither flag."""
    return {
        "saldo_kwh": production - consumption,
        "ratio_producao_consumo": guarded_ratio(production, consumption),
        "flag_defice": is_true(production < consumption),
        "flag_excedente": is_true(production > consumption),
    }


def complete_reading(consumption: Column, production: Column, missing_source: Column) -> Column:
    return consumption.isNotNull() & production.isNotNull() & ~is_true(missing_source)


def percentage(part: Column, whole: Column) -> Column:
    """100 × part / whole, 0 where the whole is null or 0."""
    return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))
