"""Best-fit packing of documents into sequences, after Martello and Toth's reduction.

Pieces of one length are interchangeable, so the whole instance is a table of at most
``capacity`` rows (length, count), whatever the corpus. The plan is made from that table in the
driver; a piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import keep, texts_of
from clickloom.llm.tokens import encoder
from clickloom.operators.numbering import number_rows

CAPACITY = 4096
END_ID = 1

Pattern = tuple[int, list[tuple[int, int]]]  # sequences, [(length, pieces of it in each)]


def token_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, little-endian unsigned 32-bit).

    Null texts are empty: their one piece is the end id. Documents longer than ``capacity`` are
    cut into pieces of that length; repeated rows give repeated pieces.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch, texts in texts_of(batches):
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(texts):
                whole = encode(text or "") + end
                for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at : at + 4 * capacity]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [
                batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.record_batch(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", ids binary" if with_ids else ""
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{more}"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def reduce_instance(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Fix sets that dominate every other set holding their largest piece; lowers ``counts``.

    For a piece j in order of falling length, with room r = capacity - j: at most k of the
    smallest pieces fit beside it. A set dominates when every other feasible set with j can be
    exchanged for it piece by piece. All copies that the argument covers are fixed in one step,
    because taking pieces away only makes its conditions hold more firmly.
    """
    fixed: list[Pattern] = []
    for j in range(capacity, 0, -1):
        while counts[j]:
            counts[j] -= 1  # the piece j itself; the others are looked for among the rest
            found = _dominating(counts, capacity - j)
            counts[j] += 1
            if found is None:
                break
            need: dict[int, int] = {j: 1}
            for partner in found:
                need[partner] = need.get(partner, 0) + 1
            times = min(int(counts[w]) // n for w, n in need.items())
            if not found:
                times = int(counts[j])
            for w, n in need.items():
                counts[w] -= n * times
            fixed.append((times, sorted(need.items(), reverse=True)))
    return fixed


def _dominating(counts: np.ndarray, room: int) -> tuple[int, ...] | None:
    """Partners of the dominating set, () if nothing fits, None if none is proved."""
    fitting = np.flatnonzero(counts[: room + 1])
    if not len(fitting):
        return ()
    least = int(fitting[0])
    best = int(fitting[-1])
    if best == room:
        return (best,)
    second = least if counts[least] > 1 else int(fitting[1]) if len(fitting) > 1 else None
    if second is None or least + second > room:
        return (best,)  # one partner at most
    if counts[least] > 2:
        three = 3 * least
    elif counts[least] == 2:
        three = 2 * least + int(fitting[1]) if len(fitting) > 1 else room + 1
    else:
        after = second if counts[second] > 1 else int(fitting[2]) if len(fitting) > 2 else None
        three = room + 1 if after is None else least + second + after
    if three <= room:
        return None
    # Two partners at most: the pair with the largest sum that fits.
    at = np.searchsorted(fitting, room - fitting, "right") - 1
    ok = at >= 0
    partner = fitting[np.maximum(at, 0)]
    alone = ok & (partner == fitting) & (counts[fitting] < 2)
    lower = np.maximum(at - 1, 0)
    partner = np.where(alone, fitting[lower], partner)
    ok &= ~(alone & (at < 1))
    sums = np.where(ok, fitting + partner, -1)
    if int(sums.max()) <= best:
        return (best,)
    b = int(partner[-1]) if ok[-1] and partner[-1] <= best else None
    if b is None:
        return None
    # {best, b}: every other pair has its smaller piece at most b, if no pair above b fits.
    above = fitting[fitting > b]
    rest = counts[above]
    if not len(above) or (rest[0] < 2 and len(above) < 2):
        return (best, b)
    pair = 2 * above[0] if rest[0] > 1 else above[0] + above[1]
    return (best, b) if pair > room else None


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over lengths with counts; sequences filled alike are one pattern."""
    open_: dict[int, list[Pattern]] = {}
    has = np.zeros(capacity + 1, bool)

    def put(room: int, pattern: Pattern) -> None:
        open_.setdefault(room, []).append(pattern)
        has[room] = True

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = length + int(np.argmax(has[length:]))
            if has[room]:
                sequences, inside = open_[room].pop()
                has[room] = bool(open_[room])
            else:
                room, sequences, inside = capacity, left, []
            each = min(room // length, left)
            times = min(sequences, left // each)
            if sequences > times and inside:
                put(room, (sequences - times, inside))
            put(room - each * length, (times, [*inside, (length, each)]))
            left -= times * each
    return [p for patterns in open_.values() for p in patterns]


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """All sequences for ``lengths`` (length to count)."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        counts[length] = n
    return reduce_instance(counts, capacity) + best_fit(counts, capacity)


def places(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, pieces of it in each, first sequence, offset), in order."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, inside in patterns:
        offset = 0
        for length, each in inside:
            first = used.get(length, 0)
            rows.append((length, first, each, sequence, offset))
            used[length] = first + times * each
            offset += length * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (``doc_id``, ``piece``, ``length`` and more) with ``sequence_id`` and ``offset``.

    Lengths are from 1 to ``capacity``. The pieces are numbered within their length by a range
    partitioning, so a length that holds a third of all pieces spans many tasks.
    """
    stored = keep(pieces, "pieces")
    counted = {r[0]: r[1] for r in stored.groupBy("length").count().collect()}  # <= capacity rows
    table = places(plan(counted, capacity))
    keys = (table[:, 0] << 40) | table[:, 1]
    order = [F.col("doc_id"), F.col("piece")]
    ranked = number_rows(stored, order, within=["length"], name="_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(names.index("_rank")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (length << 40) | rank, "right") - 1
            _, first, each, sequence, offset = table[at].T if len(at) else np.zeros((5, 0), np.int64)
            step = rank - first
            columns = [batch.column(i) for i, n in enumerate(names) if n != "_rank"]
            columns += [
                pa.array(sequence + step // np.maximum(each, 1)),
                pa.array(offset + step % np.maximum(each, 1) * length),
            ]
            yield pa.record_batch(
                columns, [*[n for n in names if n != "_rank"], "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{c}` {k}" for c, k in stored.dtypes)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")
