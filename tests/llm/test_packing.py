"""Packing: tokens equal the tokenizer's, places are gapless, plans are near the lower bound."""

import random
from collections import Counter, defaultdict
from itertools import combinations_with_replacement
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given as examples
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clickloom.llm import packing
from clickloom.llm.queries import vocabulary
from clickloom.llm.tokens import WordEncoder

PATH = vocabulary("word_bpe_49k.json")
ODD = ["don't stop", "ﬁne ΑΣ İstanbul", "été é", "a b\tc\r\nd", "<|endoftext|> x", "日本語 12,5€!!",
       "A.B_c-d 'S 'tis", "", " ", "\n\n", "x" * 3000, "naïve,Ünder... (ÄB)"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(reference, given):
    encoder = WordEncoder(PATH)
    texts = ODD + [r[0] for r in given.select("text").limit(60).collect()]
    for text in texts:
        wanted = np.array(reference.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode(text) == wanted, text[:60]
        assert encoder.encode(text) == wanted  # now from memory


@settings(max_examples=60, deadline=None)
@examples(st.text(max_size=40))
def test_ids_of_any_text(text):
    encoder = _ENCODER
    wanted = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == np.array(wanted, "<u4").tobytes()


_ENCODER = WordEncoder(PATH)


def check(rows, capacity):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_query_against_brute_force(spark, docs, reference):
    texts = [None, "", "word " * 5000, "Hello, world!", "Hello, world!", "the of and " * 300]
    frame = docs(*texts, (None, "no id"), (2, "again 2"))
    rows = packing.pack(packing.token_pieces(frame, PATH, with_ids=True)).collect()
    assert check(rows, 4096) == -(-sum(r.length for r in rows) // 4096)
    found = defaultdict(dict)
    for r in rows:
        assert r.ids_crc32 == crc32(r.ids) and len(r.ids) == 4 * r.length
        found[r.doc_id].setdefault(r.piece, []).append((r.start, r.length, r.ids))
    for i, text in enumerate(texts, start=1):
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = [ids[a : a + 4096] for a in range(0, len(ids), 4096)]
        assert sorted(found[i]) == list(range(len(pieces)))
        for k, piece in enumerate(pieces):
            assert (k * 4096, len(piece), np.array(piece, "<u4").tobytes()) in found[i][k]
    assert len(found[None]) == 1 and len(found[2][0]) == 2


def test_empty_table(docs):
    assert packing.pack(packing.token_pieces(docs(), PATH)).collect() == []


def bins(patterns):
    return sum(times for times, _ in patterns)


def least(lengths, capacity):
    """The least number of sequences, by trying all subsets for the first piece."""
    if not lengths:
        return 0
    first, rest = lengths[0], lengths[1:]
    best = [len(lengths)]

    def fill(room, left, chosen_from):
        smaller = least(left, capacity)
        best[0] = min(best[0], 1 + smaller)
        for i in range(chosen_from, len(left)):
            if left[i] <= room and (i == chosen_from or left[i] != left[i - 1]):
                fill(room - left[i], left[:i] + left[i + 1 :], i)

    fill(capacity - first, rest, 0)
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_an_optimum(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 13, 20])
    lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
    counts = np.bincount(lengths, minlength=capacity + 1)
    fixed = packing.reduce_instance(counts, capacity)
    left = [w for w in range(capacity, 0, -1) for _ in range(counts[w])]
    used = Counter(w for times, inside in fixed for w, n in inside for _ in range(times * n))
    assert used + Counter(left) == Counter(lengths)
    assert all(sum(w * n for w, n in inside) <= capacity for _, inside in fixed)
    assert bins(fixed) + least(left, capacity) == least(lengths, capacity)


def test_plan_is_near_the_bound():
    rng = random.Random(5)
    lengths = Counter(min(4096, max(1, int(rng.lognormvariate(6, 1.2)))) for _ in range(20_000))
    lengths[4096] += 500
    patterns = packing.plan(dict(lengths))
    used = Counter()
    for times, inside in patterns:
        assert sum(w * n for w, n in inside) <= 4096
        for w, n in inside:
            used[w] += times * n
    assert used == lengths
    bound = -(-sum(w * n for w, n in lengths.items()) // 4096)
    assert bins(patterns) <= bound + 2


def test_pairs_that_fill_exactly():
    counts = {a: 3 for pair in combinations_with_replacement((1, 2048, 4095), 1) for a in pair}
    assert bins(packing.plan(counts)) == 3 + 2


@pytest.mark.parametrize("rows", [1, 400])
def test_one_length_holds_all(spark, docs, rows):
    found = packing.pack(packing.token_pieces(docs(*["same text here"] * rows), PATH)).collect()
    assert check(found, 4096) == 1
