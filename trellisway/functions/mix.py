"""Deterministic draws for sampling: a fixed integer mix of (arrival id, seed, salt).

The text is plain SQL inside signed 64 bits, so any engine that has + * % computes the same
numbers, whatever the partitioning. Draws are uniform in [0, MODULUS)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647


def draw_sql(eid: str, seed: str | int, salt: int) -> str:
    first = f"((({eid}) % {MODULUS}) * 48271 + (({eid}) % 998244353) * 16807 + ({seed}) * 69621 + {salt * 40692 + 12345}) % {MODULUS}"
    second = f"(({first}) * ({first}) + ({first}) * 25173 + 13849) % {MODULUS}"
    third = f"(({second}) * ({second}) + ({second}) * 39373 + 7) % {MODULUS}"
    return f"((({third}) * 48271) % {MODULUS})"


def draw(eid: str, seed: str | int, salt: int) -> Column:
    return F.expr(draw_sql(eid, seed, salt))


def rho_sql(draw: str) -> str:
    """floor(-log2(1 - draw / 2^31)) + 1, by the length of a binary number and so without rounding."""
    return f"(32 - length(bin({MODULUS + 1} - ({draw}) - 1)))"
