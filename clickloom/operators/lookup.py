"""Left lookups into tables with unique keys, safe against skewed keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from clickloom.session import store

HOT_KEYS = 4096
SAMPLE = 0.01
SKETCH_ITEMS = 512  # values that a sketch of one column holds


def heavy_keys(sampled: DataFrame, on: Sequence[str], keys: int = HOT_KEYS) -> DataFrame:
    """The most frequent keys of a sample: at most ``keys`` rows.

    The sample only chooses which keys travel by broadcast; any choice gives
    the same lookup result.
    """
    top = sampled.groupBy(*on).count().orderBy(F.desc("count"), *on).limit(keys)
    return store(top.select(*on), "heavy-keys")


def store_with_heavy(
    df: DataFrame, columns: Sequence[str], name: str, keys: int = HOT_KEYS
) -> tuple[DataFrame, list[tuple[str, object, int]]]:
    """Keep ``df``, and find the most frequent values of ``columns`` in the same pass.

    Returns the kept rows and at most ``keys`` of ``(column, value, about how often)``. Each task has a
    sketch of bounded size per column, and the sketches are merged; no row is read again. Values that
    hold more than a ``SKETCH_ITEMS``-th of a column are always among them, if ``keys`` allow it.
    """
    each = max(1, min(keys, SKETCH_ITEMS // 2))
    seen = Observation()
    sketches = [
        F.expr(f"approx_top_k(`{c}`, {each}, {SKETCH_ITEMS})").alias(f"c{i}") for i, c in enumerate(columns)
    ]
    kept = store(df.observe(seen, F.count(F.lit(1)).alias("rows"), *sketches), name)
    found = [
        (c, r["item"], r["count"])
        for i, c in enumerate(columns)
        for r in (seen.get[f"c{i}"] or [])
        if r["item"] is not None and r["count"] > 1
    ]
    found.sort(key=lambda r: -r[2])
    return kept, found[:keys]


def skewed_lookup(
    probe: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    spread: Sequence[str] = (),
    sampled: DataFrame | None = None,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Left join of ``probe`` to ``table`` for a table too large to broadcast.

    Heavy keys are answered from a broadcast of at most ``HOT_KEYS`` table
    rows: those of ``heavy`` (``on`` columns, at most ``HOT_KEYS`` rows), or else
    the most frequent of ``sampled``. Only rows of other keys are shuffled, without
    any value of the table. ``probe`` is read twice, so rows that cost work are kept before.
    ``spread`` is without effect: rows of heavy keys stay where they are.
    """
    values = [c for c in table.columns if c not in on]
    asked = heavy_keys(sampled, on) if heavy is None else heavy
    # The keys go to the table, at most HOT_KEYS rows, so the table is not shuffled for them.
    answered = store(table.join(F.broadcast(asked), list(on)), "heavy-rows")
    hot = asked.join(F.broadcast(answered), list(on), "left").withColumnsRenamed({v: f"_hot_{v}" for v in values})
    others = probe.join(F.broadcast(asked), list(on), "left_anti").join(table, list(on), "left")
    columns = [F.col(c) for c in probe.columns]
    found = probe.join(F.broadcast(hot), list(on)).select(*columns, *[F.col(f"_hot_{v}").alias(v) for v in values])
    return found.unionByName(others.select(*columns, *values))
