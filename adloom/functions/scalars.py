"""Scalar column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom import constants as C

INT_MAX = 2147483647


def or_zero(value: Column) -> Column:
    """An unset number reads as 0."""
    return F.coalesce(value, F.lit(0))


def or_blank(value: Column) -> Column:
    """An unset text reads as the empty text."""
    return F.coalesce(value, F.lit(""))


def micros_to_units(micros: Column) -> Column:
    return micros / F.lit(float(C.MICROS_PER_UNIT))


def cents_to_units(cents: Column) -> Column:
    return cents / F.lit(float(C.CENTS_PER_UNIT))


def text_to_number(cell: Column, as_type: str) -> Column:
    """A warehouse text cell: blank is 0, anything else must parse (ANSI cast)."""
    return F.when(or_blank(cell) == "", F.lit(0).cast(as_type)).otherwise(cell.cast(as_type))


def play_seconds(end_time: Column) -> Column:
    """Play end times come in seconds or, when large, in milliseconds."""
    end_time = or_zero(end_time)
    seconds = F.floor(end_time / C.MILLIS_PER_SECOND).cast("int")
    return F.when(end_time > C.PLAY_MILLIS_ABOVE, seconds).otherwise(end_time)


def deviation(predicted: Column, events: Column, trials: Column) -> Column:
    """predicted / (events / trials) - 1, null where a divisor is 0."""
    return F.try_divide(predicted, F.try_divide(events, trials)) - 1


def truncate_to_int(value: Column) -> Column:
    """Toward zero, held at the largest int instead of raising."""
    return F.least(value, F.lit(float(INT_MAX))).cast("int")


def percent_of(part: Column, whole: Column) -> Column:
    """The smallest whole percentage that covers the share."""
    return F.ceil(part * F.lit(100.0) / whole).cast("int")


def hex_text(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def utf8_text(raw: Column) -> Column:
    return F.decode(raw, "UTF-8")


def is_platform_trade_left_out(product_type: Column, action_type: Column, trade_type: Column) -> Column:
    """Platform orders count only for the listed trade types."""
    return (
        (or_zero(product_type) == C.PLATFORM_PRODUCT_TYPE)
        & (or_zero(action_type) == C.PLATFORM_ACTION_TYPE)
        & ~or_zero(trade_type).isin(*C.PLATFORM_TRADE_TYPES)
    )
