"""MinHash in built-in expressions: the configuration whose values plain SQL can compute as well.

Base hashes are the first seven hexadecimal digits of an md5, coefficients stay below 2**31, so no product leaves 63 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIME = (1 << 61) - 1


def coefficients(perms: int) -> list[tuple[int, int]]:
    """Multiplier and offset of each permutation, from a linear congruential rule."""
    out, x = [], 42
    for _ in range(perms):
        pair = []
        for _ in range(2):
            x = (1103515245 * x + 12345) % (1 << 31)
            pair.append(x | 1)
        out.append((pair[0], pair[1]))
    return out


def banded(docs: DataFrame, shingles: Column, n_bands: int = 4, rows: int = 4, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, the columns in ``keep``, and bands: array<string>, the minima of each band, joined by dashes.

    Rows without a shingle have null for bands. With h < 2**28 and a, b < 2**31 no a * h + b reaches ``PRIME``: the remainder changes
    nothing, every permutation keeps the order of h, and all minima are those of the least h. So one least digest a row is
    found beside the scan, without making rows of shingles, and rows of one id meet by it. Repeated shingles do no harm.
    """
    return with_bands(least(docs.select(id_col, *keep, least_hash(shingles).alias("h")), id_col, keep), n_bands, rows)


def least_hash(shingles: Column) -> Column:
    """The least base hash; hexadecimal digits of one length have the order of their numbers."""
    return F.conv(F.substring(F.array_min(F.transform(shingles, lambda s: F.md5(s))), 1, 7), 16, 10).cast("long")


def least(hashed: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    return hashed.groupBy(id_col, *keep).agg(F.min("h").alias("h"))


def with_bands(hashed: DataFrame, n_bands: int = 4, rows: int = 4) -> DataFrame:
    """hashed with bands for its column h, which goes."""
    given = coefficients(n_bands * rows)
    assert all(a > 0 and a * (2**28 - 1) + b < PRIME for a, b in given)
    minima = [(F.col("h") * F.lit(a) + F.lit(b)).cast("string") for a, b in given]
    keys = [F.concat_ws("-", *minima[k * rows : (k + 1) * rows]) for k in range(n_bands)]
    return hashed.select(*[c for c in hashed.columns if c != "h"], F.when(F.col("h").isNotNull(), F.array(*keys)).alias("bands"))
