"""Fail-closed checks.

Row rules run *inside* the plan with ``guard`` so that 100 TB are not scanned a
second time just to be validated. Set rules ("no row may be left over") use
``require_empty``, which stops at the first offending row.
"""
from pyspark.sql import Column, DataFrame, functions as F


class ContractError(ValueError):
    """Input breaks a declared data contract."""


def guard(value: Column, broken: Column, message: str, dtype: str) -> Column:
    """``value``, or a runtime error naming the rule when ``broken`` is true."""
    return F.when(broken, F.raise_error(F.lit(message)).cast(dtype)).otherwise(value)


def require_empty(df: DataFrame, message: str) -> None:
    found = df.take(1)
    if found:
        raise ContractError(f"{message}: {found[0].asDict()}")


def require_columns(df: DataFrame, columns) -> None:
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ContractError(f"missing columns {absent}")


def violations(df: DataFrame, rules: dict) -> DataFrame:
    """One row of violation counts: ``rules`` maps a name to a boolean Column."""
    return df.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
                    for name, cond in rules.items()])


def enforce(df: DataFrame, rules: dict) -> DataFrame:
    """Eager version of :func:`violations`: raise on any count above zero."""
    counts = violations(df, rules).first().asDict()
    broken = {k: v for k, v in counts.items() if v}
    if broken:
        raise ContractError(f"contract violations: {broken}")
    return df


def positive_int(value, name):
    """``value`` if it counts something: 1, 2, 3, ... and no truth value."""
    if type(value) is int and value > 0:
        return value
    raise ContractError(f"{name}: a whole number from 1 up is needed, not {value!r}")
