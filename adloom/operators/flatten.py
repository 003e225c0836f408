"""Array generators over the nested page-view record.

Each takes the columns to carry and yields one row per element of the next level.
Elements are not kept for empty or unset arrays. Carried columns are computed before
the rows are generated: once per page or position, not once per impression.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom import constants as C


def each(rows: DataFrame, array: str, name: str, *carry: Column | str) -> DataFrame:
    """One row per element of `array`, as column `name`, with the carried columns."""
    kept = rows.select(*carry, F.col(array).alias("elements"))
    return kept.select(*kept.columns[:-1], F.explode("elements").alias(name))


def to_positions(pageviews: DataFrame, *carry: Column) -> DataFrame:
    """Page views to positions, as struct column `position`."""
    return each(pageviews, "positions", "position", *carry)


def to_impressions(positions: DataFrame, *carry: Column | str) -> DataFrame:
    """Positions to impressions, as struct column `imp`."""
    return each(positions, "position.imps", "imp", *carry)


def to_experiments(positions: DataFrame, wanted: Iterable[int], *carry: Column | str) -> DataFrame:
    """Positions to one row per wanted experiment id, as column `exp_id`; id 0 is never
    wanted, and an id listed twice counts twice.

    Done before the impressions are generated, so that positions outside the
    experiments drop out early.
    """
    chosen = [i for i in wanted if i != C.NO_EXPERIMENT]
    listed = each(positions, "position.exp_ids", "exp_id", *carry, "position")
    return listed.filter(F.col("exp_id").isin(chosen))


def to_clicks(impressions: DataFrame, *carry: Column | str) -> DataFrame:
    """Impressions to clicks, as struct column `click`."""
    return each(impressions, "imp.clicks", "click", *carry)


def to_traces(clicks: DataFrame, *carry: Column | str) -> DataFrame:
    """Clicks to conversion traces, as struct column `trace`."""
    return each(clicks, "click.traces", "trace", *carry)
