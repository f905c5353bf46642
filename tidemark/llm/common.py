"""Helpers the operators share: written tables and row numbers of the library, text columns, names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

from tidemark.operators.numbering import numbered as ranked, written  # noqa: F401  shared by the operators

#: The white space that separates words, [\x20\x09-\x0D], and the letters A to Z.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def own(name: str) -> str:
    """A column name that no caller's column has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def whole_text(column: str = "text") -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))
