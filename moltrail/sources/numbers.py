"""Whole numbers in the narrow columns of PDB files. What is too long for decimals is written in hybrid-36, as the larger of the PDB's
own programs do: after 99999 come A0000 to ZZZZZ, then a0000 to zzzzz, so that five columns reach 87,440,031 and four 2,436,111."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _steps(width: int) -> tuple[int, int, int]:
    """The first number with letters, how many begin with letters of one case, and what A00.. is in base 36."""
    return 10**width, 26 * 36 ** (width - 1), 10 * 36 ** (width - 1)


def hybrid(number: Column, width: int) -> Column:
    """The number as at most width characters; null is empty. A number that no such text stands for is an error."""
    first, case, base = _steps(width)
    n = number.cast("long")
    letters = lambda less: F.conv((n - first - less + base).cast("string"), 10, 36)
    text = F.when(n.isNull(), "").when(n.between(-(10 ** (width - 1)) + 1, first - 1), n.cast("string"))
    text = text.when(n.between(first, first + case - 1), letters(0)).when(n.between(first + case, first + 2 * case - 1), F.lower(letters(case)))
    return text.otherwise(F.raise_error(F.concat(n.cast("string"), F.lit(f" doesn't fit {width} columns"))).cast("string"))


def from_hybrid(text: Column, width: int) -> Column:
    """The int that trimmed text stands for, null where it is none."""
    first, case, base = _steps(width)
    value = F.conv(text, 36, 10).try_cast("long") - base + first
    rest = f"[0-9%s]{{{width - 1}}}$"
    number = F.when(text.rlike("^[A-Z]" + rest % "A-Z"), value).when(text.rlike("^[a-z]" + rest % "a-z"), value + case).otherwise(text.try_cast("int"))
    return number.cast("int")
