"""Polynomials over GF(2) as bit masks and arithmetic of GF(2^m): small driver-side helpers of the code constructors."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

#: Conway polynomials over GF(2) by degree, as bits.
PRIMITIVE = {2: 0b111, 3: 0b1011, 4: 0b10011, 6: 0b1011011, 8: 0b100011101, 9: 0b1000010001, 10: 0b10001101111, 12: 0b1000011101011, 15: 0b1000000000110101}


def primitive_polynomial(m: int) -> int:
    if m not in PRIMITIVE:
        raise ValueError(f"no primitive polynomial of degree {m} is known here")
    return PRIMITIVE[m]


def product(a: int, b: int, m: int, modulus: int) -> int:
    """Product in GF(2^m); elements are bit masks."""
    full = 0
    for k in range(b.bit_length()):
        full ^= (a << k) * (b >> k & 1)
    for k in range(full.bit_length() - 1, m - 1, -1):
        full ^= (modulus << (k - m)) * (full >> k & 1)
    return full


def tables(m: int, modulus: int) -> tuple[list[int], list[int]]:
    """log (of 0: -1) and antilog tables of GF(2^m) for the generator x; antilog's last entry is 0."""
    antilog = [1]
    for _ in range(2**m - 2):
        antilog.append(product(antilog[-1], 2, m, modulus))
    log = [-1] * 2**m
    for i, x in enumerate(antilog):
        log[x] = i
    return log, [*antilog, 0]


def zech(log: Sequence[int], antilog: Sequence[int]) -> dict[int, int]:
    """For each power i of the generator the j with x^j = x^i + 1. The power 0 has none, as 1 + 1 is zero."""
    return {log[x]: log[x ^ 1] for x in antilog if x > 1}


def inverse_modulo(n: int, p: int) -> int:
    """The inverse of n modulo the prime p; an error where there is none."""
    return pow(n, -1, p)


def mask_of(powers: Iterable[int]) -> int:
    """The sum of x^p over GF(2) as a bit mask; equal powers cancel."""
    return reduce(lambda mask, p: mask ^ 1 << p, powers, 0)


def powers_of(mask: int) -> list[int]:
    return [p for p in range(mask.bit_length()) if mask >> p & 1]


def remainder(f: int, g: int) -> int:
    """f modulo g, both bit masks."""
    while f.bit_length() >= g.bit_length():
        f ^= g << f.bit_length() - g.bit_length()
    return f


def common_divisor(f: int, g: int) -> int:
    """The greatest common divisor of two polynomials over GF(2), as bit masks."""
    return common_divisor(g, remainder(f, g)) if g else f
