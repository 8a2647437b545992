"""Keyed permutations of 0..n-1 as column expressions: a Feistel network on a mixed-radix square, with cycle walking."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4


def shape(n: int, reach: int = 2000) -> tuple[int, int]:
    """Radices a, b with a * b >= n, near-square, and as few values beyond n as found.

    Cycle walking from a value below n passes only values at or above n before
    it returns below n, so a walk has at most a * b - n + 1 steps: the smaller
    the excess, the tighter that bound.
    """
    if n <= 1:
        return 1, 1
    root = math.isqrt(n - 1) + 1
    a = min(range(max(1, root - reach), root + 1), key=lambda a: (-n % a, -a))
    return a, -(-n // a)


def _round(value: str, key: str, k: int, modulus: str) -> str:
    return f"pmod(xxhash64({key}, {k}L, {value}), {modulus})"


def _network(x: str, a: str, b: str, key: str) -> str:
    left, right = f"(({x}) div {b})", f"(({x}) % {b})"
    for k in range(ROUNDS):
        if k % 2 == 0:
            left = f"(({left} + {_round(right, key, k, a)}) % {a})"
        else:
            right = f"(({right} + {_round(left, key, k, b)}) % {b})"
    return f"({left} * {b} + {right})"


def permuted(x: str, n: str, a: str, b: str, key: str) -> Column:
    """The place of x (0 <= x < n) under the permutation that key picks.

    All arguments are SQL expressions of type long, so the domain may differ
    from row to row. Values that leave the domain walk on until they are back
    inside; the number of steps allowed is the proven bound of ``shape``.
    """
    once = _network(x, a, b, key)
    walk = f"aggregate(sequence(1L, {a} * {b} - {n} + 1L), {once}, (v, i) -> if(v < {n}, v, {_network('v', a, b, key)}))"
    return F.expr(f"if({once} < {n}, {once}, {walk})")
