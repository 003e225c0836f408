"""User ids from a record's id locators."""

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from adloom.functions.scalars import hex_text, or_blank, or_zero


def preferred_user_id(locators: Column) -> Column:
    """The encrypted id in hex when set, else the open id."""
    return F.coalesce(hex_text(locators["encrypted_id"]), locators["openid"], F.lit(""))


def fallback_user_id(locators: Column, mapped_bits: Mapping[str, int]) -> Column:
    """The first usable id of a record, or the empty text.

    `mapped_bits` names, per locator field, the bit of `id_from_mapping` that marks
    the id as inferred; inferred ids are passed over.
    """

    def own(field: str, shown: Column) -> Column:
        mask = 1 << mapped_bits[field]
        inferred = or_zero(locators["id_from_mapping"]).bitwiseAND(F.lit(mask)) != 0
        return F.when(~inferred, shown)

    return or_blank(
        F.coalesce(
            locators["media_specified_id"],
            own("guid", hex_text(locators["guid"])),
            own("wuid", locators["wuid"]),
            locators["openid"],
            own("md5_imei", hex_text(locators["md5_imei"])),
            own("md5_idfa", hex_text(locators["md5_idfa"])),
            own("qidfa", F.upper(locators["qidfa"])),
        )
    )
