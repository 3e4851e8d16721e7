"""Words and word shingles as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Lower-casing touches A-Z alone, and words end at ASCII white space.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 5


def word_hashes(text: str) -> Column:
    """The 64-bit hash of each word of a text; null and empty texts have none."""
    lowered = f"translate(coalesce(cast({text} AS string), ''), '{UPPER}', '{LOWER}')"
    return F.expr(f"transform(filter(split({lowered}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> ''), w -> xxhash64(w))")


def shingle_hashes(words: str, size: int = WORDS) -> Column:
    """Non-negative hashes of every run of ``size`` words, repeats included; none for fewer words."""
    run = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return F.expr(
        f"""CASE WHEN size({words}) >= {size} THEN transform(sequence(0, size({words}) - {size}), i -> shiftrightunsigned(xxhash64({run}), 1))
            ELSE cast(array() AS array<bigint>) END"""
    )
