"""Nearest neighbours by inner product with a forest of random-projection trees.

The trees are fitted on a bounded sample and hold split planes only; every vector is indexed by its
leaf in every tree. A query walks all trees with one priority queue: the branch whose plane it is
nearest to is opened next, whatever its tree. The leaves it opens are searched by Spark, and the
vectors found are ranked by the exact product.

Largest inner products become smallest distances when every vector gets one more component, which
brings it to the length of the longest; a query gets a zero there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.common import keep

NEAREST = 20
TREES = 12
SAMPLE = 16_384  # vectors that the trees are fitted on
LEAF = 64  # sample vectors in a leaf at most
LEAVES = 240  # leaves that a query opens, over all trees: enough for vectors without any clusters
BLOCK = 20_000  # vectors, and queries, of one leaf that one task handles at once


@dataclass
class Tree:
    """Split planes; children are node numbers, or ``~leaf``."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray


def grow(points: np.ndarray, leaf: int, seed: int) -> Tree:
    """One tree: planes between two random points, moved to the median, until leaves are small."""
    rng = np.random.default_rng(seed)
    planes, offsets, children = [], [], []
    leaves = 0
    waiting: list[tuple[np.ndarray, int, int]] = [(np.arange(len(points)), -1, 0)]

    def attach(parent: int, side: int, child: int) -> None:
        if parent >= 0:
            children[parent][side] = child

    while waiting:
        own, parent, side = waiting.pop()
        split = None
        if len(own) > leaf:
            for _ in range(4):
                a, b = points[rng.choice(own, 2, replace=False)]
                plane = a - b
                size = float(np.linalg.norm(plane))
                if size < 1e-12:
                    continue
                plane = plane / size
                at = points[own] @ plane
                middle = float(np.median(at))
                left = at < middle
                if left.any() and not left.all():
                    split = plane, middle, own[left], own[~left]
                    break
        if split is None:
            attach(parent, side, ~leaves)
            if parent < 0:
                planes.append(np.zeros(points.shape[1]))
                offsets.append(0.0)
                children.append([~0, ~0])
            leaves += 1
            continue
        node = len(planes)
        planes.append(split[0])
        offsets.append(split[1])
        children.append([0, 0])
        attach(parent, side, node)
        waiting.append((split[2], node, 0))
        waiting.append((split[3], node, 1))
    return Tree(np.array(planes), np.array(offsets), np.array(children, np.int64))


def leaf_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    node = np.zeros(len(points), np.int64)
    moving = np.arange(len(points))
    while len(moving):
        n = node[moving]
        above = np.einsum("ij,ij->i", points[moving], tree.planes[n]) >= tree.offsets[n]
        node[moving] = tree.children[n, above.astype(np.int64)]
        moving = moving[node[moving] >= 0]
    return ~node


def opened(trees: list[Tree], margins: list[np.ndarray], leaves: int) -> list[int]:
    """Leaves (tree << 32 | leaf) that one query opens; ``margins`` by tree and node."""
    queue = [(0.0, t, 0) for t in range(len(trees))]
    found: list[int] = []
    seen = set()
    while queue and len(found) < leaves:
        far, t, node = heapq.heappop(queue)
        tree, margin = trees[t].children, margins[t]
        while node >= 0:
            m = margin[node]
            near = 1 if m >= 0 else 0
            heapq.heappush(queue, (max(far, abs(m)), t, int(tree[node, 1 - near])))
            node = int(tree[node, near])
        key = t << 32 | ~node
        if key not in seen:
            seen.add(key)
            found.append(key)
    return found


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding``: no nulls, no zero vectors, finite, of the commonest length."""
    whole = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0")
    whole = whole.where(
        ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    sizes = whole.groupBy(F.size("embedding").alias("size")).count()
    commonest = sizes.orderBy(F.desc("count"), "size").limit(1).collect()
    return whole.where(F.size("embedding") == (commonest[0][0] if commonest else 0))


def products(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last."""
    total = np.zeros((len(queries), len(points)))
    for d in range(queries.shape[1]):
        total += queries[:, d, None] * points[None, :, d]
    return total


def nearest(
    vectors: DataFrame, is_query, k: int = NEAREST, trees: int = TREES, leaves: int = LEAVES,
    sample: int = SAMPLE, leaf: int = LEAF,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows where ``is_query``, the ``k`` nearest found.

    Equal vectors are searched once, as a class with its ``k + 1`` smallest ids: ids beyond can be
    no result, since ties go to smaller ids. A query is never its own neighbour. An id that occurs
    several times counts once, with the vector of its first row by content.
    """
    whole = usable(vectors.select("vec_id", "embedding"))
    one = whole.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = keep(one.withColumn("class", F.xxhash64("embedding")), "vectors")
    # The window keeps k + 1 rows of a class in every task before its shuffle.
    window = Window.partitionBy("class").orderBy("vec_id")
    few = rows.withColumn("at", F.row_number().over(window)).where(F.col("at") <= k + 1)
    classes = keep(
        few.groupBy("class").agg(
            F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("embedding").alias("embedding")
        ),
        "vector-classes",
    )
    longest = classes.agg(
        F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.max(F.size("embedding"))
    ).collect()[0]
    chosen = classes.select("class").orderBy(F.xxhash64(F.lit("sample"), "class"), "class").limit(sample)
    points = classes.join(F.broadcast(chosen), "class").select("class", "embedding").collect()
    points = [r[1] for r in sorted(points, key=lambda r: r[0])]
    asked = rows.where(is_query).select("class", F.col("vec_id").alias("query_id"))
    if not points:
        return asked.limit(0).select(
            "query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")
        )
    top, size = float(longest[0]), int(longest[1])

    def lifted(x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(0.0, top - np.einsum("ij,ij->i", x, x)))
        return np.column_stack([x, more])

    fitted = lifted(np.array(points, np.float64))
    forest = [grow(fitted, leaf, seed) for seed in range(trees)]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = lifted(_matrix(batch.column(0), size))
            keys = np.stack([(t << 32) | leaf_of(tree, x) for t, tree in enumerate(forest)], 1)
            ends = np.arange(len(x) + 1) * len(forest)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.record_batch([batch.column(0), batch.column(1), lists], ["embedding", "ids", "leaves"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), size)
            x = np.column_stack([x, np.zeros(len(x))])
            sides = [x @ tree.planes.T - tree.offsets for tree in forest]
            lists = [opened(forest, [s[i] for s in sides], leaves) for i in range(len(x))]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64()))],
                ["class", "embedding", "leaves"],
            )

    kind = classes.schema["embedding"].dataType.simpleString()
    indexed = keep(
        classes.select("embedding", "ids").mapInArrow(
            index, f"embedding {kind}, ids array<long>, leaves array<long>"
        ),
        "index",
    )
    queried = classes.join(asked.select("class").distinct(), "class", "left_semi")
    walked = keep(
        queried.select("class", "embedding").mapInArrow(
            walk, f"class long, embedding {kind}, leaves array<long>"
        ),
        "walks",
    )

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        """Into how many blocks the rows of each leaf go; trees times sample leaves, so bounded."""
        counted = rows.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count()
        return F.broadcast(counted.select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias(name)))

    def dealt(rows: DataFrame, own: str, other: str, number) -> DataFrame:
        """The rows of each leaf, in one of its own blocks, once for each block of the other side."""
        placed = rows.withColumn("leaf", F.explode("leaves")).drop("leaves")
        placed = placed.join(blocks(indexed, "m"), "leaf").join(blocks(walked, "q"), "leaf")
        placed = placed.withColumn(f"{own}_block", F.pmod(number, F.col(own)).cast("int"))
        return placed.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    members = dealt(indexed, "m", "q", F.xxhash64("ids"))
    wanted = dealt(walked, "q", "m", F.xxhash64("class"))

    def rank(key, queries, points):
        import pandas as pd

        if not len(queries) or not len(points):
            return pd.DataFrame({"class": [], "vec_id": [], "score": []}).astype(
                {"class": "int64", "vec_id": "int64", "score": "float64"}
            )
        x = np.stack(points["embedding"].to_numpy()).astype(np.float64)
        ids = points["ids"].to_numpy()
        out = []
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            asked_for = np.stack(part["embedding"].to_numpy()).astype(np.float64)
            rough = asked_for @ x.T  # its last digits depend on the shape; what is near is redone
            for c, y, s in zip(part["class"], asked_for, rough, strict=True):
                near = np.arange(len(s))
                if len(s) > k + 1:
                    edge = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                    near = np.flatnonzero(s >= edge - 1e-9 * max(1.0, abs(edge)))
                exact = products(y[None], x[near])[0]
                pairs = [(c, int(v), e) for i, e in zip(near, exact, strict=True) for v in ids[i]]
                out += sorted(pairs, key=lambda p: (-p[2], p[1]))[: k + 1]
        found = pd.DataFrame(out, columns=["class", "vec_id", "score"])
        return found

    keys = ["leaf", "m_block", "q_block"]
    found = (
        wanted.select(*keys, "class", "embedding")
        .groupBy(*keys)
        .cogroup(members.select(*keys, "embedding", "ids").groupBy(*keys))
        .applyInPandas(rank, "class long, vec_id long, score double")
    )
    best = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
    top_of = (
        found.distinct().withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
        .groupBy("class").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("found"))
    )
    top_of = keep(top_of, "nearest")
    own = asked.join(top_of, "class").select(
        "query_id",
        F.posexplode(
            F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
        ).alias("pos", "f"),
    )
    return own.select("query_id", (F.col("pos") + 1).alias("rank"), "f.vec_id", "f.score")
