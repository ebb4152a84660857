"""Deterministic draws, canonical hashes, bit masks and the inverse normal as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def hex_int(text: Column, start: int = 1) -> Column:
    """Eight hexadecimal digits as an unsigned 32-bit number."""
    return F.conv(F.substring(text, start, 8), 16, 10).cast("bigint")


def md5_int(*parts: Column | str | int) -> Column:
    """32-bit number from an md5 over '|'-joined parts: equal on every engine and partitioning."""
    return hex_int(F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])))


def md5_unit(*parts: Column | str | int) -> Column:
    return md5_int(*parts) / F.lit(TWO32)


PRIME31 = 2147483647


def mix_state(key: Column | str, seed: Column, stream: Column) -> Column:
    """Whole-number state of a (key, seed, stream); plain bigint arithmetic, no strings."""
    k = F.col(key) if isinstance(key, str) else key
    s = F.pmod(F.pmod(k, F.lit(PRIME31)) * 1000003 + seed * 7919 + stream * 104729, F.lit(PRIME31))
    return F.pmod(s * s + 12345, F.lit(PRIME31))


def mix_units(state: Column, n: int = 8) -> list[Column]:
    """n numbers in [0, 1) from one state: squares modulo a prime at n offsets."""
    out = []
    for i in range(n):
        w = F.pmod(state + F.lit((i + 1) * 715225739 % PRIME31), F.lit(PRIME31))
        out.append(F.pmod(w * w, F.lit(PRIME31)) / F.lit(float(PRIME31)))
    return out


def canonical_hash(columns: dict[str, Column], length: int = 16) -> Column:
    """SHA-256 prefix of the JSON object of the columns in sorted key order."""
    body = F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]))
    return F.substring(F.sha2(body, 256), 1, length)


def pack_bits(mask: Column, n: int) -> Column:
    """Little-endian bytes (0..255) of a boolean array of length n."""
    n_bytes = (n + 7) // 8

    def one(i: Column) -> Column:
        piece = F.slice(mask, i * 8 + 1, F.lit(8))
        bits = F.transform(piece, lambda b, j: F.when(b, F.pow(F.lit(2.0), j)).otherwise(0.0))
        return F.aggregate(bits, F.lit(0.0), lambda a, b: a + b).cast("bigint")

    return F.transform(F.sequence(F.lit(0), F.lit(n_bytes - 1)), one)


def unpack_bits(packed: Column, n: int) -> Column:
    def one(i: Column) -> Column:
        byte = F.element_at(packed, (F.floor(i / 8) + 1).cast("int"))
        return F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(i, F.lit(8)))), F.lit(2)) == 1

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile by Acklam's published rational approximation (rel. error < 1.2e-9)."""
    # fixed values: coefficients of the published approximation
    a = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2,
         1.383577518672690e2, -3.066479806614716e1, 2.506628277459239e0)
    b = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2,
         6.680131188771972e1, -1.328068155288572e1, 1.0)
    c = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838e0,
         -2.549732539343734e0, 4.374664141464968e0, 2.938163982698783e0)
    d = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996e0, 3.754408661907416e0, 1.0)

    def horner(coef: tuple, x: Column) -> Column:
        out = F.lit(coef[0])
        for k in coef[1:]:
            out = out * x + F.lit(k)
        return out

    low = 0.02425
    tail = F.sqrt(-2.0 * F.ln(F.least(p, 1.0 - p)))
    outer = horner(c, tail) / horner(d, tail)
    mid = p - 0.5
    inner = horner(a, mid * mid) * mid / horner(b, mid * mid)
    return F.when(p < low, outer).when(p > 1.0 - low, -outer).otherwise(inner)
