"""Byte-level BPE: words keep the space ahead of them, every byte is a token, nothing is normalised.

A text is cut into units, a run of white space and the run without any that follows it; no word reaches over a unit's end.
Units that occur again are encoded once. New words are merged many at once, between forced boundaries (see ``bpe``).

Defined results: a null text counts as empty and has no tokens. Special tokens of the vocabulary are recognised.
"""

from __future__ import annotations

import json
from itertools import islice

import numpy as np
import regex

from brindle.llm.bpe import ForcedBoundaryBPE

#: Bytes of units and of their tokens that a task remembers at most, for units and for words; beyond it starts anew.
REMEMBERED_BYTES = 96 << 20
#: What an entry takes besides its bytes, about.
_ENTRY = 180

# Unicode's white space; narrower than the module's own. All but spaces and line feeds is rare.
_RARE = r"\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_W = r"\n\x20" + _RARE
_UNIT = regex.compile(rf"[{_W}]*[^{_W}]+|[{_W}]+", regex.V1)
_ODD = regex.compile(rf"[\x00{_RARE}]", regex.V1)
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_W}\p{{L}}\p{{N}}]+|[{_W}]+(?![^{_W}])|[{_W}]+", regex.V1)
_MARKS = frozenset(".,;:!?\"'()|-")


class ByteLevelBPE(ForcedBoundaryBPE):
    """Encoder of one byte-level vocabulary file; read lazily, once in each Python worker."""

    _open: dict[str, ByteLevelBPE] = {}

    @classmethod
    def at(cls, path: str) -> ByteLevelBPE:
        if path not in cls._open:
            with open(path, encoding="utf-8") as f:
                cls._open[path] = cls(json.load(f))
        return cls._open[path]

    def __init__(self, spec: dict):
        super().__init__(spec | {"model": spec["model"] | {"end_of_word_suffix": ""}})
        self.held = self.held_words = 0

    @staticmethod
    def cut_units(units: list[str]) -> tuple[list[str], list[int]]:
        """The words of all units, in order, and how many each unit has."""
        words, counts = [], []
        for u in units:
            first, rest = u[0], u[1:]
            if first == " " and rest.isalpha():
                words.append(u)
                counts.append(1)
            elif first == " " and u[-1] in _MARKS and rest[:-1].isalpha():
                words += u[:-1], u[-1]
                counts.append(2)
            elif first == "\n" and rest.isalpha():
                words += first, rest
                counts.append(2)
            else:
                found = _WORD.findall(u)
                words += found
                counts.append(len(found))
        return words, counts

    def learn(self, chunks: set[str]) -> None:
        names = list(chunks)
        words, counts = self.cut_units(names)
        if self.held_words > REMEMBERED_BYTES:
            self.word.clear()
            self.held_words = 0
        fresh = list(set(words).difference(self.word))
        if fresh:
            raw = [w.encode() for w in fresh]
            tokens, per = self.encode_words(raw)
            ids, ends = tokens.astype("<u4").tobytes(), (4 * np.cumsum(per)).tolist()
            self.word.update(zip(fresh, [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
            self.held_words += len(ids) + sum(map(len, raw)) + _ENTRY * len(fresh)
        part = iter(map(self.word.__getitem__, words))
        made = [next(part) if n == 1 else next(part) + next(part) if n == 2 else b"".join(islice(part, n)) for n in counts]
        self.known.update(zip(names, made, strict=True))
        self.held += sum(map(len, names)) + sum(map(len, made)) + _ENTRY * len(names)

    def pieces(self, text: str) -> list[str]:
        """The units of a text, in order; a special token is one with a NUL ahead of it."""
        if "<" in text and self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += [*self.pieces(text[at : m.start()]), "\0" + m[0]]
                at = m.end()
            return out + self.pieces(text[at:])
        if not text:
            return []
        if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or text[0] in " \n" or text[-1] in " \n" or _ODD.search(text):
            return _UNIT.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def cut_up(self, texts: list[str]) -> list[list[str]]:
        if self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0
        for s, i in self.specials.items():
            self.known["\0" + s] = np.uint32(i).astype("<u4").tobytes()
        cut = [self.pieces(t) for t in texts]
        wanted = set().union(*cut).difference(self.known)
        if wanted:
            self.learn(wanted)
        return cut


__all__ = ["ByteLevelBPE"]
