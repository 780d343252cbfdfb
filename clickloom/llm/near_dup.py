"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

The sketch is Dahlgaard, Knudsen and Thorup's: in round i every element is hashed into one of t
bins with a value that later rounds cannot undercut; from round t on, round i serves bin i - t
alone. Rounds go on until every bin is filled, so each coordinate is a fair sample of the set, for
sets of any size, and the share of equal coordinates is concentrated around the similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.common import LOWER_BYTES, keep, mixed, texts_of

WIDTH = 5
PERCENT = 75
# 48 bands of 5: a pair of similarity 0.75 shares no band with a chance of 2 in a million, a pair
# of similarity 0.3 shares one with a chance of 1 in 9.
BANDS = 48
ROWS = 5

_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_VALUE_BITS = np.uint64(48)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text, A-Z lower-cased.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    tokens = text.encode().translate(LOWER_BYTES).split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64)
    hashed = mixed(np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens)))
    size = min(width, len(tokens))
    rolled = np.full(len(tokens) - size + 1, np.uint64(size))
    for i in range(size):
        rolled = rolled * _STEP + hashed[i : i + len(rolled)]
    return np.unique(mixed(rolled))


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of ``bins`` coordinates per set; rows of empty sets are left at the highest value."""
    table = np.full((len(sets), bins), _EMPTY, np.uint64)
    flat = table.reshape(-1)
    open_ = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    for turn in range(2 * bins):
        if not len(open_):
            break
        sizes = np.array([len(sets[i]) for i in open_])
        rows = np.repeat(open_, sizes)
        elements = np.concatenate([sets[i] for i in open_])
        hashes = mixed(elements + np.uint64((turn + 1) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        value = (np.uint64(turn) << _VALUE_BITS) | (hashes >> np.uint64(16))
        if turn < bins:
            # The low 16 bits choose the bin; the value uses the others.
            at = ((hashes & np.uint64(0xFFFF)) * np.uint64(bins) >> np.uint64(16)).astype(np.int64)
        else:
            at = np.full(len(rows), turn - bins)
        np.minimum.at(flat, rows * bins + at, value)
        open_ = open_[(table[open_] == _EMPTY).any(axis=1)]
    return table


def band_keys(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band and row of ``table``."""
    grouped = table.reshape(len(table), bands, rows)
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(table), 1))
    for i in range(rows):
        keys = mixed(keys * _STEP + grouped[:, :, i])
    return keys


def sketched(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``docs`` as struct ``row``, with the set's size ``n``, fingerprint ``fp`` and ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            for at in range(0, len(texts), 256):
                sets = [shingles(t) for t in texts[at : at + 256]]
                keys = band_keys(sketches(sets, bands * rows), bands, rows)
                full = np.array([len(s) > 0 for s in sets])
                ends = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))])
                flat = keys[full].reshape(-1).view(np.int64)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                    ],
                    ["row", "n", "fp", "bands"],
                )

    framed = docs.select(F.struct("*").alias("row"), F.col("text"))
    added = T.StructType.fromDDL("n long, fp binary, bands array<long>")
    return framed.mapInArrow(run, T.StructType([framed.schema["row"], *added.fields]))


def set_elements(rows: DataFrame) -> DataFrame:
    """``node, n, elements`` of ``rows`` (``node``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in texts_of(batches):
            for at in range(0, len(texts), 256):
                sets = [shingles(t) for t in texts[at : at + 256]]
                ends = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate(sets).view(np.int64)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                    ],
                    ["node", "n", "elements"],
                )

    return rows.select("node", "text").mapInArrow(run, "node long, n long, elements array<long>")


def shared_buckets(members: DataFrame) -> DataFrame:
    """``members`` (``key, node, n``) of the keys that two or more share, with the key's ``size``.

    Counts combine before their shuffle; the join back is from many rows to one row per key, which
    Spark splits where a key is frequent.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    return members.join(sizes, "key")


def pivots(buckets: DataFrame) -> DataFrame:
    """Distinct ``a, b``: a member of a bucket, and the pivot of that bucket.

    The pivot is the member with most company over all its buckets. In a family of edited copies
    that is the one least edited, to which most others are similar.
    """
    company = buckets.groupBy("node").agg(F.sum("size").alias("company"))
    central = buckets.select("key", "node").join(company, "node")
    chosen = central.groupBy("key").agg(F.max(F.struct("company", -F.col("node"))).alias("top"))
    chosen = chosen.select("key", (-F.col("top.col2")).alias("b"))
    return (
        buckets.select("key", F.col("node").alias("a")).join(chosen, "key")
        .where("a <> b").select("a", "b").distinct()
    )


def similar(shared, n, m):
    return 100 * shared >= PERCENT * (n + m - shared)


def paired(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (``a, b``) with both whole sets: ``na, ea, nb, eb``."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("elements").alias("ea"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("eb"))
    return pairs.join(left, "a").join(right, "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` whose whole sets are similar enough."""
    shared = F.size(F.array_intersect("ea", "eb"))
    found = paired(pairs, sets).where(similar(shared, F.col("na"), F.col("nb")))
    return keep(found.select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for the nodes of ``links`` (``a, b``): the least node reachable.

    Alternating large and small stars: every step hangs the neighbours of a node on the least of
    them, until nothing moves.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    edges, before = keep(edges.distinct(), "edges"), None
    while True:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = keep(large.distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        small = small.unionByName(least.select("a", F.col("least").alias("b"))).distinct()
        state = Observation()
        counted = small.observe(
            state, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("sum")
        )
        edges = keep(counted, "small-star")
        now = tuple(state.get.values())
        if now == before or not now[0]:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
            return keep(
                edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots),
                "components",
            )
        before = now


def candidates(measured: DataFrame, comps: DataFrame) -> DataFrame:
    """Distinct pairs ``a, b`` that may link two components and share a bucket.

    ``measured`` has for each member and pivot how many elements they share and the ``rest`` of the
    member. Two members of one pivot share at most the smaller of their parts in the pivot, and of
    their rests the elements that occur in several rests. A set needs 75 % of itself in any similar
    one. So either its part in the pivot reaches that alone, or it shares some of its rarest other
    elements: as many as are left over when the needed number is counted from the most frequent
    end. Both are exact. What a family has in common never makes a pair, and what many texts quote
    comes last among the rests. Only members outside the pivot's component look for partners, so a
    family that holds a third of all texts is not paired with itself.
    """
    pivot = measured.select(F.col("b").alias("a"), "b", F.col("nb").alias("n"), F.col("nb").alias("part"))
    pivot = pivot.distinct().withColumn("rest", F.expr("cast(array() as array<bigint>)"))
    member = measured.select("a", "b", F.col("na").alias("n"), F.col("shared").cast("long").alias("part"), "rest")
    named = comps.withColumnRenamed("node", "a")
    own = member.unionByName(pivot).join(named, "a", "left").withColumn("comp", F.coalesce("comp", "a"))
    home = comps.select(F.col("node").alias("b"), F.col("comp").alias("home"))
    own = own.join(home, "b", "left").withColumn("outside", F.col("comp") != F.coalesce("home", "b")).drop("home")
    spans = own.groupBy("b").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    own = keep(own.join(spans.where("low <> high").select("b"), "b", "left_semi"), "open-members")

    cells = own.select("a", "b", F.explode("rest").alias("element"))
    often = cells.groupBy("b", "element").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")
    ranked = cells.join(often, ["b", "element"]).groupBy("a", "b").agg(
        F.sort_array(F.collect_list(F.struct("docs", "element"))).alias("order")
    )
    lists = own.select("a", "b", "n", "part", "comp", "outside").join(ranked, ["a", "b"], "left")
    needed = F.ceil(F.col("n") * PERCENT / 100) - F.col("part")
    lists = lists.withColumn("more", F.coalesce(F.size("order"), F.lit(0)).cast("long"))
    lists = lists.where(F.col("more") >= needed).withColumn("needed", needed.cast("long"))
    lists = keep(lists, "open-lists")

    def joined(asking: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
        names = ("a", "n", "part", "comp", "more", "outside")
        x = asking.select(*on, *[F.col(c).alias(f"x_{c}") for c in names])
        y = asked.select(*on, *[F.col(c).alias(f"y_{c}") for c in names])
        most = F.least("x_part", "y_part") + F.least("x_more", "y_more")
        possible = similar(most, F.col("x_n"), F.col("y_n")) & (F.col("x_comp") != F.col("y_comp"))
        once = ~F.col("y_outside") | (F.col("x_a") < F.col("y_a"))
        pairs = x.join(y, on).where(possible & once)
        return pairs.select(F.least("x_a", "y_a").alias("a"), F.greatest("x_a", "y_a").alias("b"))

    # A partner has 75 % of the size at least, and together with it no more than can be shared.
    close = lists.where("needed <= 0").drop("order").withColumn("band", _band(F.col("n")))
    least = F.ceil(F.col("n") * PERCENT / 100)
    most = F.floor((100 + PERCENT) * (F.col("part") + F.col("more")) / PERCENT) - F.col("n")
    most = F.least(most, F.floor(F.col("n") * 100 / PERCENT))
    seeking = close.where("outside").where(least <= most).withColumn(
        "band", F.explode(F.sequence(_band(least), _band(most)))
    )
    length = F.col("more") - F.greatest("needed", F.lit(1)) + 1
    rare = lists.where("more > 0").withColumn(
        "element", F.explode(F.slice("order", F.lit(1), length.cast("int"))["element"])
    ).drop("order")
    by_part = joined(seeking, close, ["b", "band"])
    return by_part.unionByName(joined(rare.where("outside"), rare, ["b", "element"])).distinct()


def _band(n):
    """Sizes within 5 % of each other."""
    return F.floor(F.log(n.cast("double")) / 0.04879016).cast("int")


def all_links(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, comp`` after every link that the buckets can hold has been looked at.

    First every member is compared with the pivots of its buckets. Where members of one pivot are
    then in several components, the pairs across these that can still be links are compared.
    """
    measured = paired(pivots(buckets), sets).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("ea", "eb")).alias("shared"), F.array_except("ea", "eb").alias("rest")
    )
    measured = keep(measured, "measured")
    links = measured.where(similar(F.col("shared"), F.col("na"), F.col("nb"))).select("a", "b")
    comps = components(links)
    more = verified(candidates(measured, comps), sets)
    return comps if more.isEmpty() else components(links.unionByName(more))


def grouped(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``docs`` as struct ``row``, with ``n_shingles``, ``component_id``, ``kept`` and ``sole``.

    ``component_id`` is the smallest ``doc_id`` reachable over links, ``kept`` whether it is the
    row's own. Texts of equal sets are one node, so copies are never paired. Null texts and texts
    without words link with nothing. A null ``doc_id`` is larger than any other and kept only
    where its whole component has none. ``sole`` marks one row of each component, also among
    repeated rows; rows without words are all marked.
    """
    stored = sketched(docs, bands, rows).withColumn("uid", F.monotonically_increasing_id())
    stored = keep(stored, "sketches")
    worded = stored.where("n > 0")
    classes = keep(worded.groupBy("fp").agg(F.min("uid").alias("node")), "classes")
    nodes = stored.join(classes.select(F.col("node").alias("uid")), "uid", "left_semi")
    members = nodes.select(F.explode("bands").alias("key"), F.col("uid").alias("node"), "n")
    buckets = keep(shared_buckets(members), "buckets")
    met = buckets.select(F.col("node").alias("uid")).distinct()
    texts = stored.join(met, "uid", "left_semi").select(F.col("uid").alias("node"), F.col("row.text").alias("text"))
    sets = keep(set_elements(texts), "sets")
    comps = all_links(buckets, sets)

    own = worded.select("uid", "fp", F.col("row.doc_id").alias("doc_id")).join(classes, "fp")
    own = own.join(comps, "node", "left").select(
        "uid", "doc_id", F.coalesce("comp", "node").alias("comp")
    )
    own = keep(own, "memberships")
    # Kept, so that the join below is from many rows to one and a large component can be split.
    first = own.groupBy("comp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("first")
    )
    first = keep(first, "component-heads")
    decided = own.join(first, "comp").select(
        "uid", F.col("first.doc_id").alias("component_id"), (F.col("uid") == F.col("first.uid")).alias("sole")
    )
    lone = stored.where("n = 0").select(
        "row", F.col("n").alias("n_shingles"), F.col("row.doc_id").alias("component_id"), F.lit(True).alias("sole")
    )
    joined = stored.where("n > 0").join(decided, "uid").select(
        "row", F.col("n").alias("n_shingles"), "component_id", "sole"
    )
    same = F.col("row.doc_id").eqNullSafe(F.col("component_id"))
    return joined.unionByName(lone).withColumn("kept", same)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs``."""
    return grouped(docs).where("sole").select("row.*")
