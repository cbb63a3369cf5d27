"""Rounding to half-precision floats with column arithmetic.

A value first becomes a single-precision float, as a tensor of plain numbers
does, and is then rounded to the nearest multiple of its quantum, ties to even:
``2 ** (exponent - digits)``, where the exponent does not fall below that of the
smallest normal number, so subnormal results come out right.  Scaling by powers
of two is exact in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits behind the leading bit, exponent of the smallest normal number, greatest finite value.
FORMATS = {
    "float16": (10, -14, 65504.0),
    "bfloat16": (7, -126, float.fromhex("0x1.fep127")),
}


def _exponent(a: Column) -> Column:
    """Exponent of a positive double; the logarithm may miss it by one next to a power of two."""
    near = F.floor(F.log2(a)).cast("double")
    return F.when(F.pow(F.lit(2.0), near) > a, near - 1).when(F.pow(F.lit(2.0), near + 1) <= a, near + 1).otherwise(near)


def rounded(x: Column, fmt: str) -> Column:
    """``x`` (double) in ``fmt``, as a double; beyond the greatest value infinite, NaN stays NaN."""
    digits, least, most = FORMATS[fmt]
    single = x.cast("float").cast("double")
    size = F.abs(single)
    quantum = F.pow(F.lit(2.0), F.greatest(_exponent(size), F.lit(float(least))) - digits)
    near = F.rint(single / quantum) * quantum
    out = F.when(F.abs(near) > most, F.signum(near) * F.lit(float("inf"))).otherwise(near)
    return F.when((size > 0) & (size < float("inf")), out).otherwise(single)


def to_dtype(x: Column, dtype: Column) -> Column:
    """``x`` as a tensor of type ``dtype`` holds it (with or without the prefix ``torch.``); other types keep the double."""
    name = F.regexp_replace(dtype, r"^torch\.", "")
    return F.when(name == "float16", rounded(x, "float16")).when(name == "bfloat16", rounded(x, "bfloat16")).otherwise(x)
