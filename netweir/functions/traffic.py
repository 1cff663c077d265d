"""Column functions on addresses, flags, rates and levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flagged(flags: Column | str, mask: int, value: int) -> Column:
    """Whether the masked flags equal ``value``."""
    return col(flags).bitwiseAND(F.lit(mask)) == value


def ratio(a: Column, b: Column) -> Column:
    """a / b with a denominator of at least 1."""
    return a / F.greatest(b, F.lit(1))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def ip_text(ip: Column | str) -> Column:
    """Dotted quad of an unsigned 32-bit number."""
    n = col(ip).cast("long")
    return F.concat_ws(".", *[(F.shiftright(n, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)])


def ip_number(text: Column | str) -> Column:
    """The number of a dotted quad, null if it is none."""
    parts = F.split(col(text), r"\.", -1)
    octets = [F.get(parts, F.lit(i)).try_cast("long") for i in range(4)]
    ok = reduce(lambda a, b: a & b, [o.between(0, 255) for o in octets]) & (F.size(parts) == 4)
    return F.when(ok, reduce(lambda a, b: a * 256 + b, octets))


def swapped(ip: Column | str) -> Column:
    """Byte order reversed."""
    n = col(ip).cast("long")
    byte = lambda s: F.shiftright(n, s).bitwiseAND(F.lit(255))
    return F.shiftleft(byte(0), 24) + F.shiftleft(byte(8), 16) + F.shiftleft(byte(16), 8) + byte(24)


def network(ip: Column | str, length: Column | int) -> Column:
    """The address with all but its first ``length`` bits cleared."""
    shift = 32 - (F.lit(length) if isinstance(length, int) else length)
    size = F.pow(F.lit(2.0), shift).cast("long")
    return F.floor(col(ip) / size).cast("long") * size


def flow_key(a: Column | str, b: Column | str, proto: Column | str) -> Column:
    """The same key for both directions."""
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), col(proto).alias("proto"))


def cases(*pairs: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    out = F.when(pairs[0][0], pairs[0][1])
    for c, v in pairs[1:]:
        out = out.when(c, v)
    return out.otherwise(otherwise)


def level(score: Column, cuts: list[tuple[float, str]], below: str) -> Column:
    """The name of the highest cut that the score reaches."""
    return cases(*[(score >= c, n) for c, n in sorted(cuts, reverse=True)], otherwise=below)


def jsd(p: list[Column], q: list[Column]) -> Column:
    """Jensen-Shannon divergence in bits, 0 to 1, of two share vectors; empty shares are floored."""
    eps = 1e-10
    p, q = ([F.greatest(c, F.lit(eps)) for c in x] for x in (p, q))
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: reduce(lambda a, b: a + b, [c * F.log(c / d) for c, d in zip(x, m, strict=True)])
    return clamp((kl(p) + kl(q)) / 2 / F.log(F.lit(2.0)), 0.0, 1.0)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a share; (0, 1) without trials."""
    p, z2 = k / n, z * z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(mid + half, F.lit(1.0))).otherwise(1.0)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, to about 1e-7: exp(-x*x) times a polynomial in 1 / (1 + x / 2)."""
    t = 1 / (1 + x / 2)
    # fixed values: the coefficients of the rational Chebyshev fit, lowest power first
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    return t * F.exp(-x * x + reduce(lambda a, c: a * t + c, reversed(fit[:-1]), F.lit(fit[-1])))
