"""Keyed permutations of [0, n) as column expressions: Feistel rounds with cycle walking.

A number x = l * b + r lives on the grid a * b >= n with a = ceil(sqrt(n)) and b = ceil(n / a).
Even rounds add a function of r to l modulo a, odd rounds a function of l to r modulo b; each
can be undone, so all of them together permute the grid. Values that land at n or above are
permuted again until they are below n, which permutes [0, n) itself. Fewer than a values
lie above n, so a step lands there with a probability under 1 / b.

Only long arithmetic below 2^62 is used: it runs inside the JVM, and any SQL engine can repeat it.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
ROUNDS = 6
#: Steps of the walk that a plan has; the chance that a row needs more is under (1 / b) ** WALK.
WALK = 40


def round_keys(key: str, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three numbers in [1, PRIME) for every round, from a key."""
    out = []
    for i in range(rounds):
        d = hashlib.sha256(f"{key}/{i}".encode()).digest()
        out.append(tuple(int.from_bytes(d[8 * j : 8 * j + 8], "big") % (PRIME - 1) + 1 for j in range(3)))
    return out


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def mixed(x: int, k: tuple[int, int, int]) -> int:
    """The round function on numbers."""
    t = (x % PRIME * k[0] + k[1]) % PRIME
    t = (t * t + k[2]) % PRIME
    return (t * t + k[0]) % PRIME


def permute_int(x: int, n: int, key: str) -> int:
    """The permutation on one number, for tests and small tables."""
    a, b = grid(n)
    keys = round_keys(key)
    while True:
        left, right = divmod(x, b)
        for i, k in enumerate(keys):
            if i % 2:
                right = (right + mixed(left, k)) % b
            else:
                left = (left + mixed(right, k)) % a
        x = left * b + right
        if x < n:
            return x


def _mixed(x: Column, k: Column) -> Column:
    p = F.lit(PRIME).cast("long")

    def square(t: Column, c: Column) -> Column:
        # one-element arrays bind t once, so that expressions do not double in size
        return F.transform(F.array(t), lambda v: (v * v + c) % p)[0]

    t = (x % p * k.getItem("a") + k.getItem("b")) % p
    return square(square(t, k.getItem("c")), k.getItem("a"))


def permute(x: Column, n: int, key: str, walk: int = WALK) -> Column:
    """The permutation of [0, n) as an expression over a long column with values in [0, n).

    Null stays null. A row whose walk would be longer raises an error, never a wrong value.
    """
    a, b = grid(n)
    steps = F.array(*[
        F.struct(F.lit(i % 2).alias("odd"), *[F.lit(v).cast("long").alias(c) for v, c in zip(k, "abc", strict=True)])
        for i, k in enumerate(round_keys(key))
    ])
    la, lb = F.lit(a).cast("long"), F.lit(b).cast("long")

    def once(v: Column) -> Column:
        start = F.struct(F.call_function("div", v, lb).alias("l"), (v % lb).alias("r"))
        return F.aggregate(
            steps,
            start,
            lambda s, k: F.struct(
                F.when(k.odd == 0, (s.l + _mixed(s.r, k)) % la).otherwise(s.l).alias("l"),
                F.when(k.odd == 1, (s.r + _mixed(s.l, k)) % lb).otherwise(s.r).alias("r"),
            ),
            lambda s: s.l * lb + s.r,
        )

    bound = min(walk, a * b - n)
    out = once(x)
    if bound > 0:
        out = F.aggregate(F.sequence(F.lit(1), F.lit(bound)), out, lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(out < n, out).when(out.isNotNull(), F.raise_error(F.lit("walk too long: choose another key")).cast("long"))


def permute_text(text: Column, key: str, alphabets: tuple[str, ...], rounds: int = ROUNDS) -> Column:
    """The permutation of strings of one shape: characters move within their alphabet, others stay.

    The halves of the string take turns: each character of one half moves ahead by a number drawn
    from a SHA-512 over key, round and the other half, so every round can be undone. The image has the
    shape of the original. Null stays null.
    """
    size = F.length(text)
    half = F.call_function("div", size, F.lit(2)).cast("int")

    def moved(part: Column, other: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("/", F.lit(key), i.cast("string"), other), 512)

        def step(c: Column, at: Column) -> Column:
            v = F.conv(F.substr(stream, (at % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            out = F.when(F.lit(False), c)
            for letters in alphabets:
                place = F.instr(F.lit(letters), c)
                out = out.when(place > 0, F.substr(F.lit(letters), (place - 1 + v) % len(letters) + 1, F.lit(1)))
            return out.otherwise(c)

        return F.array_join(F.transform(F.when(part == "", F.array().cast("array<string>")).otherwise(F.split(part, "")), step), "")

    whole = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))
    return F.aggregate(
        F.array(*[F.lit(i) for i in range(rounds)]),
        whole,
        lambda s, i: F.when(i % 2 == 0, F.struct(moved(s.l, s.r, i).alias("l"), s.r.alias("r"))).otherwise(
            F.struct(s.l.alias("l"), moved(s.r, s.l, i).alias("r"))
        ),
        lambda s: F.concat(s.l, s.r),
    )


def permute_text_str(text: str, key: str, alphabets: tuple[str, ...], rounds: int = ROUNDS) -> str:
    """The permutation on one string, for tests."""
    left, right = text[: len(text) // 2], text[len(text) // 2 :]

    def moved(part: str, other: str, i: int) -> str:
        stream = hashlib.sha512("/".join((key, str(i), other)).encode()).digest()
        out = ""
        for at, c in enumerate(part):
            letters = next((a for a in alphabets if c in a), None)
            out += letters[(letters.index(c) + stream[at % 64]) % len(letters)] if letters else c
        return out

    for i in range(rounds):
        if i % 2:
            right = moved(right, left, i)
        else:
            left = moved(left, right, i)
    return left + right


def permute_sql(source: str, row: str, key: str) -> str:
    """DuckDB SQL (a list of WITH RECURSIVE parts) that walks table source(row, n) to walked(row, n, x)."""
    keys = round_keys(key)
    pick = lambda j: "[" + ", ".join(str(k[j]) for k in keys) + f"][(i % {ROUNDS}) + 1]"

    def f(v: str) -> str:
        t = f"(({v} % {PRIME} * {pick(0)} + {pick(1)}) % {PRIME})"
        t = f"list_transform([{t}], lambda t: (t * t + {pick(2)}) % {PRIME})[1]"
        return f"list_transform([{t}], lambda t: (t * t + {pick(0)}) % {PRIME})[1]"

    return f"""
sized AS (SELECT {row} AS x0, n, greatest(1, CAST(ceil(sqrt(n)) AS BIGINT)) AS a FROM {source}),
gridded AS (SELECT *, greatest(1, (n + a - 1) // a) AS b FROM sized),
walk(x0, n, a, b, l, r, i) AS (
  SELECT x0, n, a, b, x0 // b, x0 % b, 0 FROM gridded
  UNION ALL
  SELECT x0, n, a, b,
    CASE WHEN i % 2 = 0 THEN (l + {f("r")}) % a ELSE l END,
    CASE WHEN i % 2 = 1 THEN (r + {f("l")}) % b ELSE r END,
    i + 1
  FROM walk WHERE NOT (i > 0 AND i % {ROUNDS} = 0 AND l * b + r < n)),
walked AS (SELECT x0 AS {row}, n, l * b + r AS x FROM walk WHERE i > 0 AND i % {ROUNDS} = 0 AND l * b + r < n)"""
