"""Permutations by formula: a row's new place from its place, without sorting anything."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
# Fixed value: the largest prime below 2**31, so that products of two remainders fit a BIGINT.
PRIME = 2**31 - 1


def round_keys(seed: int | str) -> list[tuple[int, int, int]]:
    """Three numbers below ``PRIME`` for each round, the second not zero."""
    keys = []
    for k in range(ROUNDS):
        digits = hashlib.md5(f"{seed}|permute|{k}".encode(), usedforsecurity=False).hexdigest()
        a, b, c = (int(digits[i : i + 8], 16) for i in (0, 8, 16))
        keys.append((a % PRIME, b % (PRIME - 1) + 1, c % PRIME))
    return keys


def sides(n: Column) -> tuple[Column, Column]:
    """Two numbers whose product is at least ``n``, and less than one side more."""
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("bigint")
    return a, F.greatest(F.ceil(n.cast("double") / a), F.lit(1)).cast("bigint")


def _with(fn, *rest):
    return lambda s: fn(s, *rest)


def permute(position: Column, n: Column, seed: int | str = 0) -> Column:
    """Where ``position`` goes in a permutation of 0 to ``n - 1`` that seed and ``n`` fix.

    A Feistel network on pairs (position / b, position % b): each round adds a hash of one half to
    the other, modulo that half's range, so it can be undone and no two places meet. The pairs are at
    most one side more than ``n``; a place beyond ``n`` is permuted on until it falls inside, which
    ends within as many steps as there are such places. ``n`` must be below 2**52.
    """

    def mixed(x: Column, key: tuple[int, int, int]) -> Column:
        a, b, c = (F.lit(k).cast("bigint") for k in key)
        y = (x + a) % PRIME
        return (y * y % PRIME * b + c) % PRIME

    def one_round(s: Column, a: Column, b: Column, k: int, key: tuple[int, int, int]) -> Column:
        if k % 2 == 0:
            return F.struct(((s["l"] + mixed(s["r"], key)) % a).alias("l"), s["r"].alias("r"))
        return F.struct(s["l"].alias("l"), ((s["r"] + mixed(s["l"], key)) % b).alias("r"))

    def network(at: Column, a: Column, b: Column) -> Column:
        # Lambdas bind the state; written out, every round would double the expression.
        states = F.array(F.struct(F.floor(at / b).cast("bigint").alias("l"), (at % b).alias("r")))
        for k, key in enumerate(round_keys(seed)):
            states = F.transform(states, _with(one_round, a, b, k, key))
        return F.get(F.transform(states, lambda s: s["l"] * b + s["r"]), F.lit(0))

    def walked(at: Column, a: Column, b: Column) -> Column:
        beyond = F.sequence(F.lit(1).cast("bigint"), F.greatest(a * b - n, F.lit(1)))
        step = lambda v, _: F.when(v < n, v).otherwise(network(v, a, b))
        return F.when(at < n, at).otherwise(F.aggregate(beyond, at, step))

    a, b = sides(n)
    shape = F.array(F.struct(a.alias("a"), b.alias("b"), position.cast("bigint").alias("at")))
    first = F.transform(
        shape, lambda s: F.struct(s["a"], s["b"], network(s["at"], s["a"], s["b"]).alias("at"))
    )
    return F.get(F.transform(first, lambda s: walked(s["at"], s["a"], s["b"])), F.lit(0))
