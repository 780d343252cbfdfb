"""The pipeline's stages in order, on given and odd documents; the queries' SQL."""

import random
from collections import defaultdict
from zlib import crc32

import check
import numpy as np
import pytest
import test_near_dup
import test_packing
import test_pii
import test_quality
from tokenizers import Tokenizer

import corpus_pipeline
from clickloom.llm import pii, quality_rules
from clickloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    words = " ".join(f"w{i}" for i in range(80))
    texts = [words, words + " w80", " ".join(f"v{i}" for i in range(70)) + " mail a.b@c.de", None, "", "short"]
    frame = docs(*texts, (1, words), extra="uid long, row long, kept long")
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        names.append((name, sorted(r.doc_id for r in frame.collect())))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars", "uid", "row", "kept"]
    assert [ids for _, ids in names] == [[1, 1, 2, 3], [1, 3], [1, 3], [1, 3]]
    rows = {r.doc_id: r for r in frame.collect()}
    assert rows[3].text.endswith("mail <email>") and rows[3].n_chars == len(rows[3].text)
    assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == 2


def test_empty_documents(spark, docs):
    frame = docs()
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
    assert frame.collect() == []


def planted():
    """Near copies, passages that repeat across texts, personal data, and texts to reject."""
    rng = random.Random(7)

    def prose(n):
        return [f"{rng.choice('bdklmnrst')}{rng.choice('aeiou')}{rng.randrange(4000)}" for _ in range(n)]

    passages = [prose(60), prose(35)]
    texts = ["too few words", None, "", "again and again " * 40, "$ % & " * 60]
    for _ in range(6):
        base = prose(rng.randrange(80, 200))
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
        texts += [" ".join(base)] * rng.randrange(3)
    for i in range(8):
        own = prose(90)
        own[20:20] = rng.choice(passages)
        own[10:10] = [f"mail u{i}@host.example.org", "10.0.0.7", "4111 1111 1111 1111"][: i % 4]
        own.append(f"key: {rng.getrandbits(160):040x} token={rng.getrandbits(52):013x} n: {rng.randrange(10**8)} é")
        texts.append(" ".join(own))
    return texts


def without_repeats(rows):
    seen, out = set(), []
    for doc, text in sorted(rows):
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        out.append((doc, bytes(c for c, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")))
    return out


def trusted(found, rounds=3, threshold=0.5, support=3):
    """Reliable patterns of ``(value, patterns, seed)``, by plain loops over the graph."""
    edges, seeds = defaultdict(set), defaultdict(bool)
    for value, patterns, seed in found:
        for p in patterns:
            edges[p].add(value)
            seeds[value] |= seed
    trust = {v: float(s) for v, s in seeds.items()}
    for _ in range(rounds):
        patterns = {p: sum(trust[v] for v in vs) / len(vs) for p, vs in edges.items() if len(vs) >= support}
        trust = {
            v: max(float(s), *[patterns.get(p, 0.0) for p, vs in edges.items() if v in vs]) for v, s in seeds.items()
        }
    return {p for p, t in patterns.items() if t >= threshold}


def without_personal_data(rows):
    found = {doc: pii.candidates(text) for doc, text in rows}
    reliable = trusted([c[2:] for cs in found.values() for c in cs])
    out = []
    for doc, text in rows:
        spans = test_pii.plain(text)
        known = {s[:2] for s in spans}
        spans += {
            (s, e, "id") for s, e, _, ps, seed in found[doc] if (seed or reliable & set(ps)) and (s, e) not in known
        }
        parts, at = [], 0
        for s, e, kind in sorted(spans, key=lambda x: (x[0], pii.KINDS.index(x[2]), x[1])):
            if s >= at:
                parts += [text[at:s], f"<{kind}>"]
            at = max(at, e)
        out.append((doc, "".join([*parts, text[at:]])))
    return out


def test_run_against_brute_force(spark, tmp_path, docs):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    rows += list(enumerate(planted(), start=10**6))
    docs(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    limits = quality_rules.Limits()
    sizes = [len(rows)]
    rows = [r for r in rows if test_quality.brute(r[1], limits)[-1]]
    sizes.append(len(rows))
    kept = {doc for doc, *_, keeps in test_near_dup.brute(rows) if keeps}
    rows = [r for r in rows if r[0] in kept]
    sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[2] > 30
    cut = without_repeats(rows)
    assert cut != sorted(rows)
    clean = without_personal_data(cut)
    kinds = {k for _, text in clean for k in pii.KINDS if f"<{k}>" in text}
    assert kinds >= {"email", "ip", "card", "id"}
    tokenizer = Tokenizer.from_file(test_packing.PATH)
    wanted = []
    for doc, text in clean:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            wanted.append((doc, piece, at, len(part), crc32(part.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(wanted)
    used = test_packing.check(found, 4096)
    assert used <= 1 + -(-sum(r.length for r in found) // 4096)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.piece for r in rows} >= {0}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert check.compare(spark, check.database(SF), SF, name).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
