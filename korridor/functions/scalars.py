"""Column functions with fixed meanings: digests, composite ids, geometry, JSON pointers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_digest(seed: str, *columns: str) -> Column:
    """Order by which a seeded sample is taken; the same in any engine that has SHA-256."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in columns)), 256)


def fingerprint(*columns: str) -> Column:
    """Digest of a tuple in which null differs from every text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def stable_index(text: Column, n: int) -> Column:
    """0 to n - 1 by the digest of a text."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long"), F.lit(n))


def composite(one: str, two: str) -> Column:
    """``len:one two`` without a separator that either could hold."""
    a, b = F.col(one).cast("string"), F.col(two).cast("string")
    return F.concat(F.length(a).cast("string"), F.lit(":"), a, b)


def composite_parts(name: str) -> tuple[Column, Column]:
    n = F.substring_index(name, ":", 1).cast("int")
    rest = F.expr(f"substring({name}, length(substring_index({name}, ':', 1)) + 2)")
    return F.substring(rest, F.lit(1), n), F.substring(rest, n + 1, F.length(rest))


def equirectangular(lat: str, lon: str, lat2: str, lon2: str, lat_km: float = 111.0, lon_km: float = 104.0) -> Column:
    return F.sqrt(F.pow((F.col(lat) - F.col(lat2)) * lat_km, F.lit(2)) + F.pow((F.col(lon) - F.col(lon2)) * lon_km, F.lit(2)))


def interpolate(start: Column, end: Column, share: Column) -> Column:
    return start + (end - start) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))


def pointer(document: str, path: str) -> Column:
    """The value at an RFC 6901 pointer of a JSON text, as text."""
    steps = [p.replace("~1", "/").replace("~0", "~") for p in path.split("/")[1:]]
    return F.get_json_object(document, "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in steps))


def neutralised(text: str) -> Column:
    """Text that a spreadsheet would take for a formula gets a quote before it."""
    return F.when(F.ltrim(F.col(text)).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(text))).otherwise(F.col(text))
