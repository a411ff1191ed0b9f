"""Text functions on titles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def slug(title: Column) -> Column:
    """URL slug: lower case, blanks to hyphens, letters, digits and hyphens only.

    Runs of hyphens collapse to one and none is left at either end. Only U+0020
    becomes a hyphen; tabs, newlines and underscores are dropped.
    """
    hyphenated = F.replace(F.lower(title), F.lit(" "), F.lit("-"))
    kept = F.regexp_replace(hyphenated, r"[^\p{L}\p{N}-]", "")
    return F.btrim(F.regexp_replace(kept, "-+", "-"), F.lit("-"))
