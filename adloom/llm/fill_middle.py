"""Fill-in-the-middle by a counted pattern.

A text is a row of units: a run of ASCII letters, or any other single character. Counting the matches of
the unit's pattern gives n; a hash of the row's key gives two cuts a <= b of 0 to n. A pattern made for
the row, with the possessive groups `(unit){a}+` and `(unit){b-a}+`, then captures prefix, middle
and suffix in one match, and its replacement puts them in the order of the row's form. Possessive
groups are matched in a loop without a way back, so very long texts need no stack.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]++|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = "|".join((PREFIX, SUFFIX, MIDDLE))
#: The order of the groups (1 prefix, 2 middle, 3 suffix) by form.
_REPLACED = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}


def _draw(key: Column, seed: int, place: int) -> Column:
    """A number of 0 to 2^32 - 1: eight digits of the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * place + 1, 8), 16, 10).cast("long")


def transformed(
    docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row of `docs`: key (under its name), n, form and output.

    The form is `plain` for an empty text, for one that holds a mark and for about `plain_percent` of
    the rows, and the output is the text; else `spm` for about `spm_percent`, or `psm`. A null text counts as
    empty, a null key draws like an empty string. Rows of equal keys draw alike; repeated rows give
    equal results; more columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    drawn = docs.select(
        F.col(key), whole.alias("_text"), F.regexp_count(whole, F.lit(UNIT)).cast("long").alias("_n"),
        *[_draw(F.col(key), seed, i).alias(f"_h{i + 1}") for i in range(4)],
    )
    plain = (F.col("_text") == "") | F.col("_text").rlike(_MARKS) | (F.col("_h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm")
    cuts = [F.col(h) % (F.col("_n") + 1) for h in ("_h1", "_h2")]
    cut = drawn.select(
        key, "_text", "_n", form.alias("_form"), F.least(*cuts).alias("_a"), F.greatest(*cuts).alias("_b")
    )
    pattern = F.format_string(
        rf"(?s)\A((?:{UNIT}){{%d}}+)((?:{UNIT}){{%d}}+)(.*+)\z", F.col("_a"), F.col("_b") - F.col("_a")
    )
    order = F.when(F.col("_form") == "spm", _REPLACED["spm"]).otherwise(_REPLACED["psm"])
    output = F.when(F.col("_form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, order))
    return cut.select(key, F.col("_n").alias("n"), F.col("_form").alias("form"), output.alias("output"))


def restored(rows: DataFrame) -> DataFrame:
    """`rows` of `transformed` with prefix, middle, suffix (null if plain) and restored: the text, rebuilt
    from output and form alone.

    Texts beside the marks hold none, and none can arise where texts and marks meet: a mark
    begins with `<` and has no other, so an output is cut at its marks alone.
    """
    cut = rows.select("*", F.when(F.col("form") != "plain", F.split("output", _MARKS, -1)).alias("_cut"))
    spm = F.col("form") == "spm"
    first, second = F.get("_cut", F.lit(1)), F.get("_cut", F.lit(2))
    named = cut.select(
        *rows.columns, F.when(spm, second).otherwise(first).alias("prefix"), F.get("_cut", F.lit(3)).alias("middle"),
        F.when(spm, first).otherwise(second).alias("suffix"),
    )
    return named.select("*", F.coalesce(F.concat("prefix", "middle", "suffix"), "output").alias("restored"))
