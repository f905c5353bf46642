"""Column expressions the operators share. All stay inside Spark SQL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_code(c: Column | str, case: str = "upper") -> Column:
    """Trimmed symbol (upper case) or series code (lower case); null when nothing is left."""
    fold = F.upper if case == "upper" else F.lower
    return F.nullif(fold(F.trim(col_of(c))), F.lit(""))


def first_non_blank(*choices: Column | str) -> Column:
    """The first choice that is neither null nor empty."""
    return F.coalesce(*(F.nullif(col_of(c), F.lit("")) for c in choices))


def display_name(info: Column, ticker: Column | str) -> Column:
    """Short name, else long name, else the ticker itself."""
    return first_non_blank(info["shortName"], info["longName"], ticker)


def simple_return(value: Column, previous: Column) -> Column:
    """``value / previous - 1`` under IEEE rules: a zero previous gives inf or NaN, not an error."""
    value, previous = value.cast("double"), previous.cast("double")
    by_zero = value * F.lit(float("inf"))
    return F.when(previous == 0, by_zero).otherwise(value / previous) - F.lit(1.0)


def _plain_date(text: Column) -> Column:
    """The date of a text in the usual form, by a cast, which costs far less than a pattern; else null."""
    return F.when(text.rlike(r"\A[12][0-9]{3}-[0-9]{2}-[0-9]{2}\z"), text.try_cast("date"))


def strict_date(c: Column | str) -> Column:
    """ISO date; a malformed text raises (ANSI mode)."""
    return F.coalesce(_plain_date(col_of(c)), F.to_date(col_of(c), "yyyy-MM-dd"))


def lenient_date(c: Column | str) -> Column:
    """ISO date; a malformed text becomes null."""
    return F.coalesce(_plain_date(col_of(c)), F.try_to_date(col_of(c), "yyyy-MM-dd"))


def parse_number(c: Column | str) -> Column:
    """Text to double, null when it is no number. The suffixes d and f are not numbers here."""
    text = col_of(c)
    suffixed = F.trim(text).rlike("(?i)[0-9.][df]$")
    return F.when(~suffixed, text.try_cast("double"))


def run_id_of(path: Column | str) -> Column:
    """Text after ``run_id=`` in a file path, up to the next dot or slash."""
    return F.nullif(F.regexp_extract(col_of(path), r"run_id=([^./]+)", 1), F.lit(""))


def bucket_and_key(uri: Column | str) -> tuple[Column, Column]:
    """Split ``s3://bucket/key``; both are null for another kind of uri."""
    pattern = r"^s3://([^/]+)/(.*)$"
    uri = col_of(uri)
    is_s3 = uri.rlike(pattern)
    return (
        F.when(is_s3, F.regexp_extract(uri, pattern, 1)),
        F.when(is_s3, F.regexp_extract(uri, pattern, 2)),
    )


def path_safe(c: Column | str) -> Column:
    """Series codes such as usd/cad hold a slash, which may not enter a path."""
    return F.replace(col_of(c), F.lit("/"), F.lit("-"))


def zero_padded_cik(c: Column | str) -> Column:
    """At least ten digits; a longer number is kept whole."""
    text = col_of(c).cast("string")
    return F.when(F.length(text) < 10, F.lpad(text, 10, "0")).otherwise(text)


def exclusive_end(end: Column | str) -> Column:
    """Inclusive end day to exclusive end day."""
    return F.date_add(col_of(end), 1)


def cut_text(text: str) -> str:
    """An exception's text as a note takes it."""
    return text[:500]


def run_status(rows: Column, failed: Column) -> Column:
    """No rows at all still counts as success; otherwise one failed key makes it partial."""
    return F.when((rows == 0) | (failed == 0), F.lit("success")).otherwise(F.lit("partial"))


def random_run_id() -> Column:
    """A fresh id for every row: 32 hexadecimal digits."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))
