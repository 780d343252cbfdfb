"""Abbreviations learned from the texts themselves, so that their periods end no sentence.

After Kiss and Strunk, "Unsupervised multilingual sentence boundary detection" (2006): a word that
nearly always has a period, against how common periods are at all, is an abbreviation; short words
and words with inner periods count more, every occurrence without the period counts against it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import text as X
from clickloom.session import store

# Fixed values of the method: how sure a period follows an abbreviation, and the least score.
FOLLOWED = 0.99
LEAST_SCORE = 0.3
# Forms of abbreviations that one pattern names, for it tries them one by one; more are looked up in a set.
PATTERN_FORMS = 300
# What may stand before and behind a word, and what a word is.
BEFORE = r"^[\"'“”‘’(\[{]+"
BEHIND = r"[\"'“”’)\]},;:!?]+$"
WORD = r"^\p{L}+(\.\p{L}+)*$"
# What may stand before an abbreviation, and behind its period; what stands between the two, as Java reads it.
_STARTS, _SPACE = r"\s\"'“‘(\[", r"[ \t\n\x0b\f\r]"
_RUN = re.compile(rf"(?<![^{_STARTS}])([^{_STARTS}]+)\.(?={_SPACE})".replace(r"\s", _SPACE[1:-1]))
# A character for private use stands for the period of an abbreviation while a text is cut.
HELD = "\ue000"


def period_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per word in small letters: ``n`` occurrences, ``k`` of them with one period behind."""
    # Words as they stand are counted first, so that each is looked at once.
    words = docs.select(F.explode(F.split(F.col(text), r"\s+")).alias("w"))
    words = words.groupBy("w").agg(F.count(F.lit(1)).alias("times"))
    bare = words.select(F.regexp_replace(F.regexp_replace("w", BEFORE, ""), BEHIND, "").alias("w"), "times")
    ended = F.col("w").endswith(".")
    stem = F.when(ended, F.expr("substring(w, 1, char_length(w) - 1)")).otherwise(F.col("w"))
    stems = bare.select(F.lower(stem).alias("word"), ended.alias("ended"), "times").where(F.col("word").rlike(WORD))
    return stems.groupBy("word").agg(
        F.sum("times").alias("n"), F.sum(F.when(F.col("ended"), F.col("times")).otherwise(0)).alias("k")
    )


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """``word``, ``n``, ``k`` and ``score`` of the words that ever have a period.

    The counts are kept and added up once more for the share of periods, one number.
    """
    counts = store(counts, "period-counts")
    share = counts.agg(F.sum("k") / F.sum("n")).first()[0]
    n, k, p = F.col("n"), F.col("k"), F.lit(share).cast("double")
    likelier = 2.0 * (
        k * F.log(F.lit(FOLLOWED)) + (n - k) * F.log(F.lit(1 - FOLLOWED))
        - k * F.log(p) - F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)
    )
    letters = F.char_length(F.replace("word", F.lit("."), F.lit("")))
    inner = F.char_length("word") - letters
    score = likelier * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -(n - k).cast("double"))
    return counts.where("k > 0").select("word", "n", "k", F.round(score, 6).alias("score"))


def learn_abbreviations(docs: DataFrame, text: str = "text", most: int | None = None) -> list[str]:
    """Abbreviations of the texts, without their last period, the surest first; ``most`` keeps the first ones."""
    scores = abbreviation_scores(period_counts(docs, text)).where(F.col("score") >= LEAST_SCORE)
    words = scores.orderBy(F.desc("score"), "word").select("word")
    return [r["word"] for r in (words if most is None else words.limit(most)).collect()]


def _forms(abbreviations: Iterable[str]) -> dict[str, None]:
    return dict.fromkeys(f for a in abbreviations for f in (a, a[:1].upper() + a[1:], a.upper()))


def _pattern(forms: Iterable[str]) -> str:
    return rf"(^|[{_STARTS}])(" + "|".join(f.replace(".", r"\.") for f in forms) + r")\.(\s)"


def _held_from(forms: Iterable[str]) -> Callable[[Column], Column]:
    """What two passes of ``_pattern`` do, at a cost that does not grow with the number of forms.

    No form has a space or a character of ``_STARTS``, so what stands between one of these and a period
    with a space behind it is the only form that can match there.
    """
    known = frozenset(forms)

    def held(texts: pa.Array) -> pa.Array:
        def one(found: re.Match) -> str:
            return found[1] + HELD if found[1] in known else found[0]

        return pa.array([None if t is None else _RUN.sub(one, t) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(held, "string")


def hold_periods(text: Column, abbreviations: Sequence[str]) -> Column:
    """The text with the periods of abbreviations replaced by ``HELD``, unless the text ends there.

    Twice, because two abbreviations in a row share the space between them.
    """
    if not abbreviations:
        return text
    forms = _forms(abbreviations)
    if len(forms) > PATTERN_FORMS:
        return _held_from(forms)(text)
    for _ in range(2):
        text = F.regexp_replace(text, _pattern(forms), f"$1$2{HELD}$3")
    return text


def tokenize(text: Column, abbreviations: Sequence[str] = ()) -> Column:
    """``functions.text.tokenize`` that leaves abbreviations whole, period included."""
    cut = X.tokenize(hold_periods(text, abbreviations))
    return F.transform(cut, lambda t: F.translate(t, HELD, ".")) if abbreviations else cut


def preprocess_text(text: Column, abbreviations: Sequence[str] = ()) -> Column:
    """Markup removed, tokenized with abbreviations, letter-only tokens kept."""
    return X.keep_alpha(tokenize(X.strip_markup(text), abbreviations))
