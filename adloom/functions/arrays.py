"""Expressions over the nested arrays of a log record."""

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom import constants as C


def first_or(values: Column, default: Column) -> Column:
    """First element, or the default when there is none."""
    return F.coalesce(F.get(values, F.lit(0)), default)


def keep_ids(ids: Column, wanted: Iterable[int]) -> Column:
    """The wanted members of an id array, repeats kept; id 0 is never kept."""
    chosen = [i for i in wanted if i != C.NO_EXPERIMENT]
    return F.filter(ids, lambda i: i.isin(chosen))


def target_experiment(exp_ids: Column, targets: Iterable[int]) -> Column:
    """First id of the position that is a target, else 0."""
    return first_or(keep_ids(exp_ids, targets), F.lit(C.NO_EXPERIMENT))


def placement_type(triggers: Column) -> Column:
    """Value of the first placement trigger."""
    values = F.transform(
        F.filter(triggers, lambda t: t["key"] == C.PLACEMENT_TRIGGER_KEY), lambda t: t["value"]
    )
    return first_or(values, F.lit(C.NO_PLACEMENT))


def second_class(vertical_ids: Column) -> Column:
    """Second category level: first vertical id at or above the base, less the base."""
    above = F.filter(vertical_ids, lambda v: v >= C.CATEGORY_BASE)
    return first_or(F.transform(above, lambda v: v - C.CATEGORY_BASE), F.lit(0).cast("bigint"))


def first_class(second: Column) -> Column:
    """First category level from the second (whole division)."""
    return F.floor(second / C.CATEGORY_STEP).cast("int")


def joined_ids(ids: Column) -> Column:
    """Ids as one comma-separated text."""
    return F.coalesce(F.array_join(ids.cast("array<string>"), ","), F.lit(""))
