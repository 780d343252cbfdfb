"""Abbreviations are learned from texts, and their periods stay with them."""

import math

from pyspark.sql import functions as F

from clickloom.operators import sentences as N

LINES = [
    "Dr. Lee met Mr. Ng on Jan. 3 at 10 a.m. in town. They talked about the house.",
    "The house was old. Dr. Kim saw it, e.g. its roof. (Mr. Ng did not.) It was sold in Jan. 2001.",
    "He likes the town hall. A town. She likes Dr. Lee. Prices, i.e. costs, rose at 9 a.m. in Jan. again.",
    "A house in the town. Old houses in old towns. We talked. We saw. It rained at 7 a.m. today, e.g. here.",
] * 4


def brute(lines):
    counts = {}
    for w in " ".join(lines).split():
        w = w.lstrip("\"'(").rstrip("\"'),;:!?")
        ended = w.endswith(".")
        w = (w[:-1] if ended else w).lower()
        if w.replace(".", "").isalpha():
            n, k = counts.get(w, (0, 0))
            counts[w] = n + 1, k + ended
    p = sum(k for _, k in counts.values()) / sum(n for n, _ in counts.values())
    out = {}
    for w, (n, k) in counts.items():
        if k:
            m = len(w.replace(".", ""))
            ratio = 2 * (k * math.log(0.99) + (n - k) * math.log(0.01) - k * math.log(p) - (n - k) * math.log(1 - p))
            out[w] = n, k, ratio * math.exp(-m) * (len(w) - m + 1) * m ** -(n - k)
    return out


def table(spark, lines=LINES):
    return spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id int, text string")


def test_scores(spark):
    wanted = brute(LINES)
    found = {r["word"]: r for r in N.abbreviation_scores(N.period_counts(table(spark))).collect()}
    assert set(found) == set(wanted)
    for w, (n, k, score) in wanted.items():
        assert (found[w]["n"], found[w]["k"]) == (n, k) and abs(found[w]["score"] - score) < 1e-5


def test_learned(spark):
    known = N.learn_abbreviations(table(spark))
    assert {"dr", "mr", "jan", "a.m", "e.g", "i.e"} <= set(known)
    assert not {"town", "house", "talked", "old"} & set(known)
    assert N.learn_abbreviations(table(spark), most=2) == known[:2]


def tokens(spark, text, known):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(N.tokenize(F.col("t"), known).alias("x")).first()["x"]


def test_sentences_with_abbreviations(spark):
    known = ["dr", "mr", "a.m", "st"]
    cases = {
        "Dr. Lee left. He ran.": "Dr. Lee left . He ran .",
        "Dr. Mr. St. Lee came.": "Dr. Mr. St. Lee came .",
        "At 9 a.m. John slept.": "At 9 a.m. John slept .",
        "We met the Dr.": "We met the Dr .",
        "(Mr. Ng) DR. NO. Mdr. X": "( Mr. Ng ) DR. NO . Mdr . X",
        "It cost 3.50. So what?": "It cost 3.50 . So what ?",
        "J. Smith": "J . Smith",
        "": "",
    }
    for text, wanted in cases.items():
        assert " ".join(tokens(spark, text, known)) == wanted
    assert " ".join(tokens(spark, "Dr. Lee", [])) == "Dr . Lee"
    assert tokens(spark, None, known) is None


def test_letters_only(spark):
    df = spark.createDataFrame([("<Dr. Lee> slept.",)], "t string")
    assert df.select(N.preprocess_text(F.col("t"), ["dr"]).alias("x")).first()["x"] == ["Lee", "slept"]


def test_no_texts(spark):
    assert N.learn_abbreviations(table(spark, [None, "", "no period here"])) == []
    assert N.learn_abbreviations(table(spark, [])) == []


def many_words(n):
    return [f"{chr(98 + i // 400)}{chr(98 + i // 20 % 20)}{chr(98 + i % 20)}" for i in range(n)]


def test_all_abbreviations_count(spark):
    """More abbreviations than one pattern would hold: all are learned, and all are left whole."""
    words = many_words(1500)
    lines = [f"We saw {w}. and {w}. here " + "in the old town " * 10 for w in words]
    known = N.learn_abbreviations(table(spark, lines))
    assert set(known) == set(words)
    for w in (words[0], words[-1], known[-1]):
        assert tokens(spark, f"A {w}. came. So {w.upper()}. {w.title()}. left.", known) == \
            ["A", f"{w}.", "came", ".", "So", f"{w.upper()}.", f"{w.title()}.", "left", "."]


def test_set_and_pattern_agree(spark, monkeypatch):
    known = ["dr", "mr", "a.m", "st", "é", "ß", "z.b"]
    texts = ["Dr. Mr. St. Lee", "(Dr. x) [a.m. \"st. 'mr. “é. ‘ß. SS. É. \n", "x.dr. dr.. dr. x dr. x dr.\x0bx\tdr.\rz",
             "dr.", " dr. ", "dr.dr. a.a.m. ..dr. d'mr. d’mr. Z.B. z.B. Z.b.  st.\x85x", "", None, "st.,x {dr. }dr. *dr. x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def held():
        return [tuple(r) for r in df.select("i", N.hold_periods(F.col("t"), known)).orderBy("i").collect()]

    by_pattern = held()
    monkeypatch.setattr(N, "PATTERN_FORMS", 0)
    assert held() == by_pattern and sum((t or "").count(N.HELD) for _, t in by_pattern) > 15
