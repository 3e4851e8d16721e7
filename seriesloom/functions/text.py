"""String functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Whitespace as Python's str.strip sees it.
WHITESPACE = r"[\s\x1c-\x1f]"
CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"
MARK = "\ue000 "


def strip_whitespace(text: Column) -> Column:
    """Drop all Unicode whitespace at both ends (``trim`` only drops blanks)."""
    return F.regexp_replace(text, rf"(?U)^{WHITESPACE}+|{WHITESPACE}+$", "")


def title_case(text: Column) -> Column:
    """Capital after any character without case, small letters elsewhere.

    ``initcap`` starts a word only after a blank: it gives ``O'neil-x`` and ``3rd``
    where this gives ``O'Neil-X`` and ``3Rd``. So every character without case
    gets a mark that ends in a blank, and the marks go again afterwards. A mark
    in the text itself survives, as it is marked too.
    """
    marked = F.regexp_replace(text, rf"([^{CASED}])", f"$1{MARK}")
    return F.replace(F.initcap(marked), F.lit(MARK), F.lit(""))
