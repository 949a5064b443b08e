"""The alphabet of machine-readable zones and the layout of a TD3 document, as the standard fixes them."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters in index order, the filler, the weights of check digits, the length of a line.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789<"
FILLER = "<"
VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WEIGHTS = (7, 3, 1)
LENGTH = 44
SEXES = ("M", "F", "<")

#: Field, line, first character from 1, length.
LAYOUT = {
    "document_code": (1, 1, 2),
    "issuing_state": (1, 3, 3),
    "name": (1, 6, 39),
    "document_number": (2, 1, 9),
    "document_number_cd": (2, 10, 1),
    "nationality": (2, 11, 3),
    "birth_date": (2, 14, 6),
    "birth_date_cd": (2, 20, 1),
    "sex": (2, 21, 1),
    "expiry_date": (2, 22, 6),
    "expiry_date_cd": (2, 28, 1),
    "optional_data": (2, 29, 14),
    "optional_data_cd": (2, 43, 1),
    "composite_cd": (2, 44, 1),
}
#: Slices of line 2 under the composite check digit, as (first, length), and its places, from 0, that no check digit covers.
COMPOSITE = ((1, 10), (14, 7), (22, 22))
UNPROTECTED = (10, 11, 12, 20)

#: Codes beside the ISO ones.
SPECIAL_STATES = ("UTO", "XXA", "XXB", "XXC", "XXX", "UNO", "UNA", "UNK", "EUE", "RKS", "GBD", "GBN", "GBO", "GBP", "GBS", "D")


def iso_states(spark: SparkSession) -> list[str]:
    """The ISO 3166 three-letter codes, from the Java runtime's own table."""
    locale = spark.sparkContext._jvm.java.util.Locale
    return sorted(locale.getISOCountries(locale.IsoCountryCode.valueOf("PART1_ALPHA3")))


def known_states(spark: SparkSession) -> list[str]:
    return sorted({*iso_states(spark), *SPECIAL_STATES})


def is_state(code: Column, states: list[str]) -> Column:
    """Whether the code, without fillers at its end, is among states."""
    return F.rtrim(code, F.lit(FILLER)).isin(states)


def is_mrz_char(c: Column) -> Column:
    return c.rlike(r"\A[A-Z0-9<]\z")


def is_mrz_text(text: Column) -> Column:
    return text.rlike(r"\A[A-Z0-9<]*\z")


def char_value(c: Column) -> Column:
    """0-9 for digits, 10-35 for letters, 0 for the filler, null for anything else."""
    return F.when(c == FILLER, 0).when(c.rlike(r"\A[A-Z0-9]\z"), F.instr(F.lit(VALUES), c) - 1)


def blind_class(c: Column) -> Column:
    """Characters of one class can't be told apart by a check digit."""
    return F.pmod(char_value(c), F.lit(10))


def is_protected(place: Column) -> Column:
    """Whether a check digit covers the place, from 0, of line 2. The last place is the composite digit itself, which none covers."""
    return place.between(0, LENGTH - 2) & ~place.isin(list(UNPROTECTED))
