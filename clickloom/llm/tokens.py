"""Token ids by a published tokenizer, with the ids of known words kept between texts."""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer

# A word of Latin letters without combining marks, then ASCII punctuation: two pre-tokens at
# most, each encoded on its own. Any other run goes through the whole tokenizer.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
CACHED = 150_000


def byte_letters() -> dict[int, int]:
    """The letters that byte-level vocabularies write for the bytes that do not print."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printing]
    return {b: 256 + i for i, b in enumerate(hidden)}


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes, equal to the tokenizer's own for whole texts.

    Spaces and line feeds end pre-tokens and are dropped by this vocabulary, so the ids of a text
    are those of its runs in order. At most ``CACHED`` runs and words are remembered.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.runs: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {"": b""}

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            shown = part.encode().decode("latin-1").translate(self.letters)
            ids = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            if len(self.parts) >= CACHED:
                self.parts = {"": b""}
            self.parts[part] = ids
        return ids

    def _run(self, run: str) -> bytes:
        plain = _PLAIN.fullmatch(run)
        if plain:
            return self._part(plain[1].lower()) + self._part(plain[2])
        ids = self.tokenizer.encode(run, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        runs = text.replace("\n", " ").split(" ")
        known = self.runs
        try:
            return b"".join([known[r] for r in runs])
        except KeyError:
            pass
        if len(known) >= CACHED:
            known = self.runs = {"": b""}
        out = []
        for run in runs:
            ids = known.get(run)
            if ids is None:
                ids = self._run(run)
                if len(run) <= 64:
                    known[run] = ids
            out.append(ids)
        return b"".join(out)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
