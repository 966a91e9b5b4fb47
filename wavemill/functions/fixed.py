"""Integer fixed-point arithmetic as column expressions.

Three roundings occur and must not be mixed up: truncation (``tdiv``), floor (``shiftright``,
``dec_fdiv``) and half-up (``half_up``). 64-bit values that may pass 2**63 are DECIMAL(38,0);
``div`` is never used on them, as it wraps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

I32 = (-(2**31), 2**31 - 1)
U64_MAX = 2**64 - 1
BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3


def num(value: int) -> Column:
    """A DECIMAL(38,0) literal."""
    return F.lit(str(value)).cast("decimal(38,0)")


def dec(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def sat32(x: Column) -> Column:
    """Saturate a BIGINT to 32 bits."""
    return clamp(x, *I32).cast("int")


def tdiv(a: Column, b: Column) -> Column:
    """BIGINT division that truncates toward zero."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def half_up(x: Column, shift: int) -> Column:
    """Arithmetic shift right after adding half of the last place; none for 0."""
    return F.shiftright(x + (1 << (shift - 1)), shift) if shift else x


def dec_fdiv(a: Column, b: Column) -> Column:
    """DECIMAL division that rounds down; b is positive."""
    return dec((a - F.pmod(a, b)) / b)


def dec_tdiv(a: Column, b: Column) -> Column:
    """DECIMAL division that truncates toward zero."""
    return dec((a - a % b) / b)


def total(xs: Column, start: Column | None = None) -> Column:
    """Sum of an array, as BIGINT or in the type of ``start``."""
    zero = F.lit(0).cast("long") if start is None else start
    return F.aggregate(xs, zero, lambda a, x: a + x if start is None else dec(a + x))


def longs(xs: Column) -> Column:
    return F.transform(xs, lambda x: x.cast("long"))


def isqrt(x: Column) -> Column:
    """Floor of the square root of a DECIMAL below 2**64: a double's guess, mended by one."""
    guess = dec(F.floor(F.sqrt(x.cast("double"))))
    one = num(1)

    def mended(r: Column) -> Column:
        return F.when(dec(r * r) > x, dec(r - one)).when(dec(dec(r + one) * dec(r + one)) <= x, dec(r + one)).otherwise(r)

    return F.when(x <= 0, num(0)).otherwise(let(guess, mended))


def _halves(x: Column, f) -> Column:
    """f of the upper and lower 32 bits of a DECIMAL below 2**64, as BIGINT."""
    low = lambda v: (v % num(1 << 32)).cast("long")
    return let(dec(x), lambda v: let(F.struct(dec_fdiv(v, num(1 << 32)).cast("long").alias("hi"), low(v).alias("lo")), lambda h: f(h["hi"], h["lo"])))


def log2_q16(x: Column) -> Column:
    """Base-2 logarithm in Q16 of a DECIMAL below 2**64; 0 for 0.

    The mantissa is 2**32 + f; its square, shifted by 32, is 2**32 + 2 f + (f * f >> 32), and
    f * f is taken from halves of 16 bits, so that all fits into BIGINT.
    """
    left = lambda v, n: F.call_function("shiftleft", v, n.cast("int"))
    right = lambda v, n: F.call_function("shiftright", v, n.cast("int"))

    def of(hi: Column, lo: Column) -> Column:
        msb = F.when(hi > 0, F.length(F.bin(hi)) + 31).otherwise(F.length(F.bin(lo)) - 1)

        def started(n: Column) -> Column:
            m = F.when(n <= 32, left(left(hi, F.lit(32)) + lo, F.greatest(F.lit(32) - n, F.lit(0)))).otherwise(left(hi, F.greatest(F.lit(64) - n, F.lit(0))) + right(lo, F.greatest(n - 32, F.lit(0))))
            return F.aggregate(F.sequence(F.lit(15), F.lit(0), F.lit(-1)), F.struct(m.alias("m"), (n * 65536).cast("int").alias("r")), step, lambda acc: acc["r"])

        return let(msb, started)

    def step(acc: Column, bit: Column) -> Column:
        f = acc["m"] - (1 << 32)
        a, b = F.shiftright(f, 16), f.bitwiseAND(F.lit(0xFFFF).cast("long"))
        square = a * a + F.shiftright(2 * a * b + F.shiftright(b * b, 16), 16)

        def carried(m: Column) -> Column:
            up = m >= 1 << 33
            return F.struct(F.when(up, F.shiftright(m, 1)).otherwise(m).alias("m"), (acc["r"] + F.when(up, left(F.lit(1), bit)).otherwise(F.lit(0))).alias("r"))

        return let((1 << 32) + 2 * f + square, carried)

    return F.when(x <= 0, F.lit(0)).otherwise(_halves(x, of))


def le_bytes(x: Column, width: int) -> Column:
    """The little-endian bytes of an integer (two's complement) of 4 or 8 bytes, as an array of BIGINT."""
    if width == 4:
        return u32_bytes(x)
    return _halves(F.pmod(dec(x), num(1 << 64)), lambda hi, lo: F.concat(u32_bytes(lo), u32_bytes(hi)))


def u32_bytes(x: Column) -> Column:
    """``le_bytes`` of four bytes without decimals, for integers of 32 bits."""
    return let(F.pmod(x.cast("long"), F.lit(1 << 32)), lambda u: F.array(*(F.shiftright(u, 8 * k).bitwiseAND(F.lit(255)) for k in range(4))))


def fnv1a64(data: Column, basis: Column | None = None) -> Column:
    """FNV-1a of an array of byte values, as a DECIMAL; ``basis`` continues an earlier digest.

    The digest is two halves of 32 bits. The prime is 2**40 + 435, so that a product's upper half
    is that of the upper half by 435, the carry, and the lower half moved by 8 bits.
    """
    low_bits = lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF))

    def step(h: Column, b: Column) -> Column:
        mixed = h["lo"].bitwiseXOR(b.cast("long"))
        product = mixed * (PRIME & 0xFFFF)
        upper = h["hi"] * (PRIME & 0xFFFF) + F.shiftright(product, 32) + F.shiftleft(mixed, 8)
        return F.struct(low_bits(upper).alias("hi"), low_bits(product).alias("lo"))

    digest = lambda start: F.aggregate(data, start, step, lambda h: dec(dec(dec(h["hi"]) * num(1 << 32)) + dec(h["lo"])))
    start = lambda hi, lo: F.struct(hi.alias("hi"), lo.alias("lo"))
    if basis is None:
        return digest(start(F.lit(BASIS >> 32).cast("long"), F.lit(BASIS & 0xFFFFFFFF).cast("long")))
    return _halves(basis, lambda hi, lo: digest(start(hi, lo)))


def hex64(x: Column) -> Column:
    """An unsigned 64-bit DECIMAL as 0x and sixteen lower-case digits."""
    half = lambda v: F.lpad(F.lower(F.hex(v.cast("long"))), 8, "0")
    return F.concat(F.lit("0x"), half(dec_fdiv(x, num(1 << 32))), half(x % num(1 << 32)))


def text_bytes(x: Column) -> Column:
    """The UTF-8 bytes of a string, as an array of BIGINT."""
    digits = F.hex(x.cast("binary"))
    n = F.octet_length(x)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
