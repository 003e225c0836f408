"""Small building-block jobs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP_SPAN = 1000


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word, count) over text split at single spaces.

    Blanks inside and before the text give empty words, those at its end do not; a
    text of blanks alone gives none, an empty text one empty word.
    """
    value = F.col(column)
    trimmed = F.rtrim(value)
    only_blanks = (trimmed == "") & (value != "")
    words = lines.filter(~only_blanks).select(F.explode(F.split(trimmed, " ")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def drop_incomplete(rows: DataFrame) -> DataFrame:
    """Rows without null or NaN in any column."""
    return rows.na.drop()


def parity(value: Column) -> Column:
    return F.when(value % 2 == 0, "even").otherwise("odd")


def group_members(rows: DataFrame, label: Column, member: str, span: int = GROUP_SPAN) -> DataFrame:
    """Members of each group, with their `copies`, in lists.

    A group may be any size, so its list comes in pieces: `piece` numbers stretches
    of `span` whole-number member values. Copies are counted before lists are built,
    so a list has at most `span` entries.
    """
    counted = rows.groupBy(label.alias("label"), F.col(member).alias("member")).agg(
        F.count(F.lit(1)).alias("copies")
    )
    return counted.groupBy("label", F.floor(F.col("member") / span).alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("member", "copies"))).alias("members")
    )


def square(rows: DataFrame, column: str) -> DataFrame:
    """Adds `square`; an int is widened first."""
    wide = F.col(column).cast("bigint")
    return rows.withColumn("square", wide * wide)
