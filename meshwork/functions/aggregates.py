"""Aggregate functions. A builder takes the argument column's name, so that SQL-only forms can be used too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(x: str, distinct: bool) -> Column:
    values = F.collect_set(x) if distinct else F.collect_list(x)
    return F.when(F.count(x) > 0, F.array_join(F.sort_array(F.transform(values, lambda v: v.cast("string"))), ","))


def _either(plain: Callable[[str], Column], distinct: Callable[[str], Column]) -> Callable[[str, bool], Column]:
    return lambda x, d: distinct(x) if d else plain(x)


AGGREGATES: dict[str, Callable[[str, bool], Column]] = {
    "count": _either(F.count, F.count_distinct),
    "count_if": lambda x, d: F.count_if(F.col(x)),
    "sum": _either(F.sum, F.sum_distinct),
    "avg": _either(F.avg, lambda x: F.expr(f"avg(DISTINCT `{x}`)")),
    "min": lambda x, d: F.min(x),
    "max": lambda x, d: F.max(x),
    "collect": _either(F.collect_list, F.collect_set),
    "stddev": lambda x, d: F.stddev_pop(x),
    "variance": lambda x, d: F.var_pop(x),
    "string_agg": _joined,
    "group_concat": _joined,
    "percentile_disc": lambda x, d: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{x}`)"),
    "percentile_cont": lambda x, d: F.expr(f"percentile_cont(0.5) WITHIN GROUP (ORDER BY `{x}`)"),
    "approx_count_distinct": lambda x, d: F.approx_count_distinct(x),
}
