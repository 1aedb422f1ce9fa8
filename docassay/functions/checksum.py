"""Checksums and masks of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dihedral(a: int, b: int) -> int:
    """Product in the symmetry group of the pentagon, elements 0-4 rotations and 5-9 reflections."""
    turn, flip = a % 5, a // 5
    sign = -1 if flip else 1
    return (turn + sign * (b % 5)) % 5 + 5 * (flip ^ (b // 5))


def _permutations() -> list[list[int]]:
    """The eight powers of the Verhoeff permutation."""
    step, rows = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [list(range(10))]  # fixed value: the permutation
    while len(rows) < 8:
        rows.append([step[d] for d in rows[-1]])
    return rows


PRODUCT = [_dihedral(a, b) for a in range(10) for b in range(10)]
PERMUTED = [d for row in _permutations() for d in row]


def verhoeff_valid(number: Column, digits: int = 12) -> Column:
    """True for ``digits`` digits whose Verhoeff checksum is zero."""
    product, permuted = (F.array(*[F.lit(x) for x in t]) for t in (PRODUCT, PERMUTED))
    digit = lambda i: F.substring(number, F.lit(digits) - i, F.lit(1)).try_cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.lit(digits - 1)), F.lit(0), lambda c, i: F.coalesce(F.get(product, c * 10 + F.get(permuted, (i % 8) * 10 + digit(i))), F.lit(99)))
    return F.coalesce(number.rlike(rf"^\d{{{digits}}}$") & (total == 0), F.lit(False))


def mask_number(number: Column) -> Column:
    return F.concat(F.lit("XXXX XXXX "), F.right(number, F.lit(4)))
