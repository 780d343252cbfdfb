"""Near duplicates against all pairs by brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from clickloom.llm import near_dup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    out = []
    for i, (doc, _) in enumerate(rows):
        known = [d for d in least[find(i)] if d is not None]
        component = min(known) if known else None
        out.append((doc, len(sets[i]), component, doc == component))
    return sorted(out, key=str)


def found(frame, **more):
    rows = near_dup.grouped(frame, **more)
    return sorted(
        ((r.row.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows.collect()), key=str
    )


def family(rng, size, members, changes):
    base = [f"w{rng.randrange(900)}" for _ in range(size)]
    out = []
    for _ in range(members):
        copy = list(base)
        for _ in range(rng.randrange(changes + 1)):
            copy[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_odd_rows(docs):
    rows = [
        (5, "one two three four five six seven"), (3, "ONE two three four five six seven"),
        (9, None), (10, ""), (11, " \t\n"), (12, "short text"), (13, "Short\x0btext"), (14, "text"),
        (None, "one two three four five six seven"), (None, "alone with no id at all here"),
        (5, "one two three four five six seven"), (15, "one two three"), (16, "É two"), (17, "é two"),
    ]
    frame = docs(*rows, extra="uid long, fp long")
    assert found(frame) == brute(rows)


def test_chains_and_families(docs, small_batches):
    rng = random.Random(3)
    texts = []
    for size, members, changes in ((40, 30, 3), (120, 25, 8), (12, 10, 1), (300, 8, 12)):
        texts += family(rng, size, members, changes)
    chain = [f"c{i}" for i in range(60)]
    for step in range(12):  # each like its neighbour only
        texts.append(" ".join(chain))
        chain = chain[4:] + [f"d{step}-{i}" for i in range(4)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(10)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, start=1))
    assert found(docs(*rows)) == brute(rows)


def test_large_buckets_are_exact(spark, docs):
    """Texts that share half of their words fill buckets that no component explains."""
    rng = random.Random(4)
    common = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        own = [f"o{rng.randrange(10**6)}" for _ in range(30)]
        texts.append(" ".join([*common, *own]))
        if rng.random() < 0.4:
            own[rng.randrange(30)] = "changed"
            texts.append(" ".join([*common, *own]))
    rows = list(enumerate(texts, start=1))
    frame = docs(*rows)
    wanted = brute(rows)
    assert found(frame, bands=48, rows=2) == wanted  # low selectivity: buckets of nearly all rows


@pytest.mark.parametrize("seed", range(4))
def test_edited_families_are_exact(docs, seed):
    """Families whose members are edited around the limit, and share passages their pivot lacks."""
    rng = random.Random(seed)
    passages = [[f"p{k}-{i}" for i in range(25)] for k in range(3)]
    texts = []
    for _ in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 100, 150]))]
        for _ in range(35):
            copy = list(base)
            for _ in range(rng.randrange(9)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.5:
                at = rng.randrange(len(copy))
                copy[at:at] = rng.choice(passages)[: rng.randrange(5, 25)]
            if rng.random() < 0.3:
                copy = copy[rng.randrange(len(copy) // 3) :]
            texts.append(" ".join(copy))
    rows = list(enumerate(texts, start=1))
    assert found(docs(*rows), bands=80, rows=2) == brute(rows)


def test_one_of_each(docs):
    same = "one two three four five six seven eight"
    frame = docs((4, same), (4, same), (2, same + " nine"), (7, None), (8, ""))
    left = near_dup.one_of_each(frame)
    assert left.columns == frame.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 7, 8]


def test_empty_table(docs):
    assert near_dup.grouped(docs()).collect() == []


@pytest.mark.parametrize("size", [1, 3, 30, 500])
def test_sketch_is_filled_and_fair(size):
    rng = np.random.default_rng(size)
    shared = rng.integers(0, 2**63, size, dtype=np.uint64)
    own = rng.integers(0, 2**63, (200, 2, max(1, size // 4)), dtype=np.uint64)
    sets = [np.unique(np.concatenate([shared, own[i, j]])) for i in range(200) for j in range(2)]
    table = near_dup.sketches(sets, 240)
    assert (table != np.uint64(2**64 - 1)).all()
    equal = (table[::2] == table[1::2]).mean()
    true = size / (size + 2 * max(1, size // 4))
    assert abs(equal - true) < 0.12 if size < 30 else abs(equal - true) < 0.02
