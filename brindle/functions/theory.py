"""Entropy of multinomial counts: published bounds and the exact value, in nats.

Bounds are sums over the categories, and of terms for categories that stay empty or get
one ball.  Expressions are SQL text, so they can be used in any query: ``n`` (a double),
``p`` (probability) and ``q`` (a stand-in that is at least 2 / n).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published bounds, term by term.
UPPER_Q = "(8 * q * q - 15 * q + 8) / (12 * n * q) - (24 * q * q * q - 55 * q * q + 41 * q - 10) / (12 * n * n * q * q) - (3 * q * q - 5 * q + 2) / (6 * n * n * n * q * q)"
UPPER_P = "-3 * n * n * n * n * p * p * p / 64 + (54 * n * n * n * p * p * p + 5 * n * n * n * p * p - 99 * n * n * p * p * p + 39 * n * n * p * p - 106 * n * n * p) / 192 + (27 * n * p * p * p - 76 * n * p * p + 97 * n * p - 82 * n) / 96 + (27 * p * p - 76 * p + 73) / 48 + (27 * p - 76) / (24 * n) + 9 / (4 * n * n)"
LOWER_Q = "(-4 * q * q + 9 * q - 5) / (12 * n * q) + (2 * q * q - 3 * q + 1) / (6 * n * n * q * q)"
# the n^3 p^2 and n p^2 terms over 48 are as published by the source of the inventory
LOWER_P = "(n * n * n * p * p - 3 * n * p * p - 10 * n * p) / 48 + (n * p * p + 3 * n * p - 23 * n) / 24 + (p - 3) / 12 + 1 / (6 * n)"
EMPTY_UPPER = "-5.0 / 6 + 1 / (3 * n * q)"
EMPTY_LOWER = "-n * q / 3 - 11.0 / 12"
SINGLE_UPPER = "-11.0 / 3 + 9 / (2 * n * q) - 9 / (4 * n * n * q * q) + 1 / (2 * n * n * n * q * q * q)"
SINGLE_LOWER = "-n * q / 3 - 29.0 / 12 + 5 / (2 * n * q) - 11 / (12 * n * n * q * q) + 1 / (6 * n * n * n * q * q * q)"
HALF = f"0.5 * ln({2 * math.pi!r} * n * q)"

#: Terms of one category.
G_UPPER = f"({UPPER_Q} - power(1 - p, n) * ({HALF} + {EMPTY_UPPER}) - n * p * power(1 - p, n - 1) * ({HALF} + ln(n * q) + {SINGLE_UPPER}) + (q - p) * ({UPPER_P}))"
G_LOWER = f"({LOWER_Q} - power(1 - p, n) * ({HALF} + {EMPTY_LOWER}) - n * p * power(1 - p, n - 1) * ({HALF} + ln(n * q) + {SINGLE_LOWER}) + (q - p) * ({LOWER_P}))"


def bounds_sql(source: str) -> str:
    """Upper and lower bounds of each ``id, n`` of a relation with a row a category (``id, n, p``).

    q = greatest(p, 2 / n); where q is p in all categories the terms for q <> p are zero, so one form serves both.
    """
    return f"""SELECT id, n,
 a - k + sum_u AS upper_nats, a - 1 / (12.0 * n) - k + sum_l AS lower_nats
FROM (SELECT id, n, 0.5 * ((count(*) - 1) * ln({2 * math.pi * math.e!r} * n) + sum(ln(q))) AS a, n * sum(p * ln(p / q)) AS k,
 sum({G_UPPER}) AS sum_u, sum({G_LOWER}) AS sum_l
 FROM (SELECT id, CAST(n AS DOUBLE) AS n, p, greatest(p, 2.0 / n) AS q FROM {source}) z GROUP BY id, n) y"""


def log_factorial(n: Column) -> Column:
    """ln n! by summing logs."""
    return F.aggregate(F.when(n >= 2, F.sequence(F.lit(2), n.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda t, x: t + F.log(x.cast("double")))


def binomial(n: Column, p: Column, j: Column) -> Column:
    """Probability of j successes."""
    rest = F.when(p < 1, (n - j) * F.log(1 - p)).otherwise(F.when(n == j, F.lit(0.0)).otherwise(F.lit(float("-inf"))))
    return F.exp(log_factorial(n) - log_factorial(j) - log_factorial(n - j) + j * F.log(p) + rest)
