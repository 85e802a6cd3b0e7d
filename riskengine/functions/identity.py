"""Identity expressions: salted hashes, fingerprints and payment addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskengine.functions.timing import col

# Fixed values that must match existing data.
SALT = "upi_phase1_v1"
UNKNOWN_DEVICE = "unknown_device"
CARD_COLUMNS = ["card1", "card2", "card3", "card4", "card5", "card6"]


def short_hash(text: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def fingerprint(*columns: Column | str) -> Column:
    """Columns as text, NULL as empty, joined by a bar."""
    return F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns])


def payer_hash(*columns: Column | str) -> Column:
    return short_hash(F.concat(F.lit(SALT + "|"), fingerprint(*columns)))


def payer_address(payer: Column | str) -> Column:
    return F.concat(F.lit("user_"), col(payer), F.lit("@upi"))


def payee_address(merchant: Column | str) -> Column:
    return F.concat(F.lit("merchant_"), col(merchant).cast("string"), F.lit("@upi"))


def device_hash(info: Column | str) -> Column:
    text = F.coalesce(col(info).cast("string"), F.lit(""))
    return F.when(text == "", F.lit(UNKNOWN_DEVICE)).otherwise(
        short_hash(F.concat(F.lit(SALT + "|dev|"), text)))


def payer_of_address(vpa: Column | str) -> Column:
    """``user_X@upi`` gives X; any other address gives the part before the at sign."""
    v = col(vpa)
    bare = F.replace(F.replace(v, F.lit("user_"), F.lit("")), F.lit("@upi"), F.lit(""))
    return F.when(F.startswith(v, F.lit("user_")), bare).otherwise(
        F.split_part(v, F.lit("@"), F.lit(1)))
