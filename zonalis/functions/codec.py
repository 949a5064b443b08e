"""TD3 text as column expressions: check digits, padding, names, serialising, splitting and parsing, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.alphabet import ALPHABET, COMPOSITE, FILLER, LAYOUT, LENGTH, VALUES, WEIGHTS, is_mrz_text

#: What Python counts as a line break, and white space at the ends in the Unicode sense.
LINE_BREAK = r"\R|[\x1c-\x1e]"
ENDS = r"(?U)\A\s+|\s+\z"


def characters(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def check_digit(value: Column) -> Column:
    """The check digit as text; '0' for an empty value, null if a character is outside the alphabet."""
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    points = F.transform(characters(value), lambda c, i: F.greatest(F.instr(F.lit(VALUES), c) - 1, F.lit(0)) * F.get(weights, F.pmod(i, F.lit(3))))
    return F.when(is_mrz_text(value), F.pmod(F.aggregate(points, F.lit(0), lambda a, x: a + x), F.lit(10)).cast("string"))


def verify_check_digit(value: Column, digit: Column, lenient: bool = False) -> Column:
    """lenient: a filler in the digit's place is right for a value of fillers alone."""
    right = digit == check_digit(value)
    return F.coalesce((digit == FILLER) & value.rlike(r"\A<*\z") | right, F.lit(False)) if lenient else F.coalesce(right, F.lit(False))


def pad(value: Column, length: int) -> Column:
    """Filled at the right; null if too long, since nothing is cut off silently."""
    return F.when(F.length(value) <= length, F.rpad(value, length, FILLER))


def normalize(value: Column) -> Column:
    """Upper case, blanks and hyphens as fillers; null if anything else is outside the alphabet."""
    plain = F.translate(F.upper(value), " -", "<<")
    return F.when(is_mrz_text(plain), plain)


def encode_name(primary: Column, secondary: Column) -> Column:
    """Both parts normalised, cut to 39 characters and filled; null if either can't be normalised."""
    first, second = normalize(primary), normalize(F.coalesce(secondary, F.lit("")))
    both = F.when(F.length(second) > 0, F.concat(first, F.lit("<<"), second)).otherwise(first)
    return F.when(second.isNotNull(), F.rpad(F.substring(both, 1, 39), 39, FILLER))


def decode_name(field: Column) -> Column:
    """struct(primary, secondary): parted at the first double filler."""
    bare = F.rtrim(field, F.lit(FILLER))
    at = F.instr(bare, "<<")
    clean = lambda x: F.trim(F.translate(x, FILLER, " "))
    first = F.when(at > 0, F.substr(bare, F.lit(1), at - 1)).otherwise(bare)
    return F.struct(clean(first).alias("primary"), F.when(at > 0, clean(F.substr(bare, at + 2))).otherwise("").alias("secondary"))


def clean(value: Column) -> Column:
    """For display."""
    return F.trim(F.translate(value, FILLER, " "))


def composite_payload(line2: Column) -> Column:
    return F.concat(*[F.substring(line2, at, n) for at, n in COMPOSITE])


FIELD_ORDER = ("document_code", "issuing_state", "primary_name", "secondary_name", "document_number", "nationality", "birth_date", "expiry_date", "optional_data", "sex")


def with_lines(df: DataFrame, fields: dict[str, Column], filler_optional_cd: bool = True) -> DataFrame:
    """df with line1, line2 and error from the ten fields. error names the first field that fails, in the order in which they are normalised, then lengths, then the sex; the lines are null then.

    filler_optional_cd: an optional field of fillers alone has a filler for its check digit, else 0. Each step is a projection of its own,
    so that what later steps use several times is worked out once.
    """
    got = {"document_code": F.lit("P<"), "optional_data": F.lit(""), **fields}
    got["sex"] = F.when(F.coalesce(got["sex"], F.lit("")) == "", FILLER).otherwise(got["sex"])
    step = df.withColumns({f"_{k}": normalize(F.coalesce(got[k], F.lit(""))) for k in FIELD_ORDER})
    plain = {k: F.col(f"_{k}") for k in FIELD_ORDER}
    error = F.coalesce(
        *[F.when(plain[k].isNull(), k) for k in FIELD_ORDER],
        *[F.when(F.length(plain[k]) != n, k) for k, n in (("birth_date", 6), ("expiry_date", 6), ("sex", 1))],
        F.when(~plain["sex"].isin("M", "F", FILLER), "sex"),
        *[F.when(F.length(plain[k]) > n, k) for k, n in (("document_code", 2), ("issuing_state", 3), ("document_number", 9), ("nationality", 3), ("optional_data", 14))],
    )
    step = step.withColumns({"error": error, "_number": pad(plain["document_number"], 9), "_optional": pad(plain["optional_data"], 14)})
    number, birth, expiry, optional = F.col("_number"), plain["birth_date"], plain["expiry_date"], F.col("_optional")
    optional_cd = F.when(optional.rlike(r"\A<*\z"), FILLER if filler_optional_cd else "0").otherwise(check_digit(optional))
    body = F.concat(number, check_digit(number), pad(plain["nationality"], 3), birth, check_digit(birth), plain["sex"], expiry, check_digit(expiry), optional, optional_cd)
    both = F.when(F.length(plain["secondary_name"]) > 0, F.concat(plain["primary_name"], F.lit("<<"), plain["secondary_name"])).otherwise(plain["primary_name"])
    line1 = F.concat(pad(plain["document_code"], 2), pad(plain["issuing_state"], 3), F.rpad(F.substring(both, 1, 39), 39, FILLER))
    step = step.withColumns({"_body": body, "_line1": line1})
    fine = F.col("error").isNull()
    line2 = F.concat(F.col("_body"), check_digit(composite_payload(F.col("_body"))))
    made = F.struct(F.when(fine, F.col("_line1")).alias("line1"), F.when(fine, line2).alias("line2"), "error")
    # a row of its own for the result: filters on it stay above, else they would be pushed down and work every step out again
    return step.select(*df.columns, F.inline_outer(F.array(made)))


def split_lines(mrz: Column) -> Column:
    """Array of the lines, stripped, without empty ones."""
    strip = lambda x: F.regexp_replace(x, ENDS, "")
    return F.filter(F.transform(F.split(strip(mrz), LINE_BREAK), strip), lambda x: x != "")


def lines_error(lines: Column) -> Column:
    """null, or the first thing wrong: lines (not two of them), length1, charset1, length2, charset2."""
    checks = [F.when(F.size(lines) != 2, "lines")]
    for k in (1, 2):
        line = F.get(lines, F.lit(k - 1))
        checks += [F.when(F.length(line) != LENGTH, f"length{k}"), F.when(~is_mrz_text(line), f"charset{k}")]
    return F.coalesce(*checks)


def parse(line1: Column, line2: Column) -> Column:
    """struct of all fields and check digits by place; content isn't judged. Number and optional data lose fillers at their end."""
    take = lambda k: F.substring({1: line1, 2: line2}[LAYOUT[k][0]], *LAYOUT[k][1:])
    bare = lambda k: F.rtrim(take(k), F.lit(FILLER))
    name = decode_name(take("name"))
    parts = {k: bare(k) if k in ("document_number", "optional_data") else take(k) for k in LAYOUT if k != "name"}
    return F.struct(*[v.alias(k) for k, v in parts.items()], name["primary"].alias("primary_name"), name["secondary"].alias("secondary_name"))


def field(line1: Column, line2: Column, name: str) -> Column:
    """A field's characters as they stand."""
    return F.substring({1: line1, 2: line2}[LAYOUT[name][0]], *LAYOUT[name][1:])


def encode_labels(text: Column) -> Column:
    """Class indices of a line; null for a wrong length or character."""
    return F.when((F.length(text) == LENGTH) & is_mrz_text(text), F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1))


def decode_labels(indices: Column) -> Column:
    """The line of class indices; null if one is out of range."""
    fine = F.forall(indices, lambda i: (i >= 0) & (i < len(ALPHABET)))
    return F.when(fine, F.array_join(F.transform(indices, lambda i: F.substr(F.lit(ALPHABET), i + 1, F.lit(1))), ""))
