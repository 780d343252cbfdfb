"""Which record starts a chain of records reaches, found without reading files from their start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.session import store, store_counted


def reached(links: DataFrame, starts: DataFrame) -> DataFrame:
    """Offsets reached from ``starts`` (``path``, ``offset``) by following ``links``.

    ``links`` has ``path``, ``offset`` and ``successor``, one row per offset. The last offset of a
    chain, which no link leaves, counts as reached. Each round doubles how far a link goes, so a chain
    of n links takes about log2(n) rounds of joins by path and offset. Links that no other link and no
    start leads to are left out at once.
    """
    entered = links.select("path", F.col("successor").alias("offset")).unionByName(starts).distinct()
    jumps = store(links.join(entered, ["path", "offset"], "left_semi"), "jumps")
    seen, now = store_counted(starts.distinct(), "reached")
    known = -1
    while now > known:
        known = now
        step = seen.join(jumps, ["path", "offset"]).select("path", F.col("successor").alias("offset"))
        seen, now = store_counted(seen.unionByName(step).distinct(), "reached")
        far = jumps.select("path", F.col("offset").alias("successor"), F.col("successor").alias("beyond"))
        farther = jumps.join(far, ["path", "successor"], "left")
        jumps = store(
            farther.select("path", "offset", F.coalesce("beyond", "successor").alias("successor")), "jumps"
        )
    return seen
