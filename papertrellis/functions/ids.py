"""Name-based identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uuid_v5(namespace: str, material: Column) -> Column:
    """RFC 4122 version 5 uuid of the text under a namespace uuid."""
    seed = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(material, "UTF-8"))
    h = F.lower(F.sha1(seed))
    variant = (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"),
        F.substring(h, 9, 4), F.lit("-5"),
        F.substring(h, 14, 3), F.lit("-"),
        F.substring(F.lit("89ab"), variant, F.lit(1)), F.substring(h, 18, 3), F.lit("-"),
        F.substring(h, 21, 12),
    )
