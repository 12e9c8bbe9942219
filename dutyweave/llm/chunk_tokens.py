"""Token ids of whole texts by way of their distinct chunks.

A text is cut at every single blank between two characters that are no white space. The
byte-level tokenizers' own pattern always cuts before such a blank, and no piece of the
public piece vocabulary holds a word mark after another character, so a chunk's ids do not
depend on what stands around it: a text's ids are those of its chunks, one after another.
Each distinct chunk is encoded once a worker; the memory for them is bounded and then
started anew, which changes nothing but time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

#: Distinct chunks that a worker holds before it starts anew.
MOST_CHUNKS = 1_000_000
#: Chunks of one text or of several that are put together at a time.
SLICE = 1 << 18
_CUT = re.compile(r"(?<=\S) (?=\S)")


def path(name: str) -> str:
    """Where the file of a public vocabulary is; a path of one's own is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_VISIBLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_BYTE_OF = {chr(b): b for b in _VISIBLE} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*_VISIBLE}))}


def written_bytes(token: str) -> bytes:
    """Bytes of a byte-level entry: visible Latin-1 characters stand for themselves, the other bytes, in order, for U+0100 and on."""
    return bytes(_BYTE_OF[c] for c in token)


class ByteEncoder:
    """A byte-level tokenizer, read from its file. Special tokens of the file are plain text, or found in texts first."""

    def __init__(self, name: str, special_as_text: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path(name))
        self.tokenizer.encode_special_tokens = special_as_text
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = [] if special_as_text else sorted(special)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = token.encode() if token in special else written_bytes(token)
        ranks = {written_bytes(t): i for t, i in vocabulary.items() if t not in special}
        # the same vocabulary and pattern; for short texts four times as fast
        self.encode_one = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        out = list(map(self.encode_one, texts))
        if any(s in t for s in self.special for t in ["\n".join(texts)]):
            for k, t in enumerate(texts):
                if any(s in t for s in self.special):
                    out[k] = self.tokenizer.encode(t, add_special_tokens=False).ids
        return out


class Ragged:
    """Rows of integers of different length in one growing array."""

    def __init__(self) -> None:
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.rows = np.zeros(1 << 12, np.int64), 0

    def extend(self, rows: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.rows + len(rows) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(rows), np.int32, total)
        self.start[self.rows + 1 : self.rows + 1 + len(rows)] = self.used + np.cumsum(sizes)
        self.used += total
        self.rows += len(rows)

    def sizes(self, at: np.ndarray) -> np.ndarray:
        return self.start[at + 1] - self.start[at]

    def take(self, at: np.ndarray) -> np.ndarray:
        """The rows at these places, one after another."""
        size = self.sizes(at)
        return self.flat[np.repeat(self.start[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


class ChunkStore:
    """Numbers of distinct chunks; `learn` gets the chunks that are new, in the order of their numbers, and whether each opens its text."""

    def __init__(self, learn: Callable[[list[str], list[bool]], None], forget: Callable[[], None], first_differs: bool, most: int = MOST_CHUNKS) -> None:
        self.learn, self.forget, self.first_differs, self.most = learn, forget, first_differs, most
        self.number: dict = {}
        self.new: list[tuple[str, bool]] = []

    def _of(self, key: object, chunk: str, first: bool) -> int:
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.number)
            self.new.append((chunk, first))
        return at

    def _carefully(self, text: str) -> list[int]:
        """White space beside a blank, or at an end of the text: cut where both neighbours are none."""
        out = []
        for k, chunk in enumerate(_CUT.split(text)):
            first = k == 0 and self.first_differs
            plain = not first and not chunk[:1].isspace() and not chunk[-1:].isspace()
            out.append(self._of(chunk if plain else (first, chunk), chunk, first))
        return out

    def _numbers(self, text: str) -> list[int]:
        parts = text.split(" ")
        head = parts.pop(0) if self.first_differs else ""
        found = list(map(self.number.get, parts))
        if self.first_differs and (not head or head[-1].isspace() or head[0].isspace()):
            return self._carefully(text)
        if None in found:  # chunks with white space at an end are never known under their own name
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                part = parts[at]
                if not part or part[0].isspace() or part[-1].isspace():
                    return self._carefully(text)
                found[at] = self._of(part, part, False)
        return [self._of((True, head), head, True), *found] if self.first_differs else found

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The chunks of each text, by number; an empty text has none."""
        if len(self.number) > self.most:
            self.number.clear()
            self.forget()
        out = [np.array(self._numbers(t), np.int64) if t else np.zeros(0, np.int64) for t in texts]
        if self.new:
            self.learn([c for c, _ in self.new], [f for _, f in self.new])
            self.new = []
        return out


def slices(rows: list[np.ndarray], most: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bounds, numbers): parts of rows of at most so many numbers in all; a longer row comes in several parts, in order."""
    of, parts, held = [], [], 0
    for i, row in enumerate(rows):
        for a in range(0, len(row), most):
            part = row[a : a + most]
            if held + len(part) > most:
                yield np.array(of), np.cumsum([0, *map(len, parts)]), np.concatenate(parts)
                of, parts, held = [], [], 0
            of.append(i)
            parts.append(part)
            held += len(part)
    if parts:
        yield np.array(of), np.cumsum([0, *map(len, parts)]), np.concatenate(parts)
