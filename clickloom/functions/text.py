"""Text to word tokens with regular-expression functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters deleted from marked-up text.
MARKUP = "@<>"

# The tokenizer's rules, applied in this order to the text with a space on both
# ends. Each is (pattern, replacement) in syntax that Java and RE2 share, except
# that Java writes group references as $1. Patterns begin with a rare character
# where they can, which lets the matcher skip the rest of the text.
TOKEN_RULES = (
    # quotes, brackets and symbols stand alone
    (r"([\"“”„‘«»\[\](){}<>;!?#$%&*@…`])", r" \1 "),
    # commas and colons stand alone, unless a digit follows
    (r"([,:]+)([^0-9,:])", r" \1 \2"),
    # dashes of two or more
    (r"(-{2,})", r" \1 "),
    # runs of periods
    (r"(\.{2,})", r" \1 "),
    # a period ends a sentence before a word that does not begin with a small
    # letter ...
    (r"\.(['’)]*\s+[^\p{Ll}\s])", r" . \1"),
    # ... and at the end of the text
    (r"\.(['’)\s]*)\z", r" . \1"),
    # the last period of a run belongs to the run
    (r"(\.+) +\.(\s)", r"\1.\2"),
    # a single quote before a word
    (r"(\s)(['’])(\p{L})", r"\1\2 \3"),
    # negation and other English endings
    (r"(?i)(n['’]t)(\s)", r" \1\2"),
    (r"(?i)(['’](?:s|m|d|ll|re|ve))(\s)", r" \1\2"),
    # words that are two
    (r"(?i)\b(can)(not)\b", r"\1 \2"),
    (r"(?i)\b(gim|lem)(me)\b", r"\1 \2"),
    (r"(?i)\b(gon|wan)(na)\b", r"\1 \2"),
    (r"(?i)\b(got)(ta)\b", r"\1 \2"),
    # a single quote after a word
    (r"(['’])(\s)", r" \1\2"),
)

# Rules in runs, with what a text must contain for any rule of the run to match, in small letters for
# the last but one. A text without it skips the run: a search for a few characters costs far less than a
# match. No rule adds characters other than spaces, so what is missing before a run is missing inside it.
_QUOTES = ("'", "’")
_TWO_WORDS = ("cannot", "gimme", "lemme", "gonna", "wanna", "gotta")
_RUNS = (
    (tuple("\"“”„‘«»[](){}<>;!?#$%&*@…`"), TOKEN_RULES[:1]),
    ((",", ":"), TOKEN_RULES[1:2]),
    (("--",), TOKEN_RULES[2:3]),
    (("..",), TOKEN_RULES[3:4]),
    ((".",), TOKEN_RULES[4:7]),
    (_QUOTES, TOKEN_RULES[7:10]),
    (_TWO_WORDS, TOKEN_RULES[10:14]),
    (_QUOTES, TOKEN_RULES[14:]),
)

# Fixed value: a token made of letters only.
LETTERS = r"^\p{L}+$"
# The same between the spaces of a spaced text.
_SPACED_LETTERS = r"(?<!\S)\p{L}++(?!\S)"


def _bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is made once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _contains(text: Column, needles: Sequence[str]) -> Column:
    return reduce(Column.__or__, [text.contains(n) for n in needles])


def strip_markup(text: Column) -> Column:
    return _bound(text, lambda t: F.when(_contains(t, MARKUP), F.translate(t, MARKUP, "")).otherwise(t))


def _spaced(text: Column) -> Column:
    """The text with a space on both ends and between its tokens."""

    def run(needles: Sequence[str], rules: Sequence[tuple[str, str]]) -> Callable[[Column], Column]:
        def applied(t: Column) -> Column:
            out = t
            for pattern, replacement in rules:
                out = F.regexp_replace(out, pattern, replacement.replace("\\", "$"))
            if needles is _TWO_WORDS:
                possible = F.exists(F.array(F.lower(t)), lambda low: _contains(low, needles))
            else:
                possible = _contains(t, needles)
            return F.when(possible, out).otherwise(t)

        return applied

    spaced = F.array(F.concat(F.lit(" "), text, F.lit(" ")))
    for needles, rules in _RUNS:
        spaced = F.transform(spaced, run(needles, rules))
    return F.get(spaced, F.lit(0))


def tokenize(text: Column) -> Column:
    """Word and punctuation tokens of a text, in order."""
    return F.array_remove(F.split(_spaced(text), r"\s+"), "")


def lowercase_tokens(text: Column) -> Column:
    return tokenize(F.lower(text))


def keep_alpha(tokens: Column) -> Column:
    # Java's $ also matches before a line's end, such as U+0085.
    return F.filter(tokens, lambda t: t.rlike(LETTERS.replace("$", r"\z")))


def preprocess_text(text: Column) -> Column:
    """Markup removed, tokenized, letter-only tokens kept."""
    return F.regexp_extract_all(_spaced(strip_markup(text)), F.lit(_SPACED_LETTERS), F.lit(0))


def chunk_text(text: Column, k: int) -> Column:
    """``k`` equal character ranges; the last one also takes the remainder."""
    size = F.floor(F.char_length(text) / k).cast("int")
    chunks = [F.substr(text, size * i + 1, size) for i in range(k - 1)]
    return F.array(*chunks, F.substr(text, size * (k - 1) + 1))


def tokens_by_chunk(text: Column, k: int) -> Column:
    """Tokens of each chunk, one array per chunk in order."""
    return F.array(*[preprocess_text(chunk_text(text, k)[i]) for i in range(k)])


def flatten_tokens(chunks: Column) -> Column:
    return F.flatten(chunks)
