"""Pre-tokens of a lower-casing word BPE as 64-bit numbers, and their pieces, inside tasks.

The tokenizer file is read where it is needed; the path is a parameter. Texts of ASCII
and Latin-1 letters are split here for a whole run at once by the file's own rule
(contractions, letter runs, single digits, other runs); every other text is split by the
library's normalizer and pre-tokenizer.
"""

from __future__ import annotations

import os
import re

import numpy as np

from ticketlab.llm.words import SPACED, Words, mix

KNOWN = 1_000_000  # pre-tokens a task remembers
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


class Splitter:
    """Pre-tokens of runs of texts."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.words = Words(SPACED)
        names = sorted(special_strings(self.tokenizer), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        kind = np.full(256, _OTHER, np.int8)
        kind[list(SPACED)] = _SPACE
        kind[48:58] = _DIGIT
        kind[65:91] = kind[97:123] = kind[128:] = _LETTER
        self.kind = kind
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.odd = np.zeros(256, bool)  # bytes only the library may judge
        self.odd[0x1C:0x20] = True
        self.odd[0xC0:] = True
        self.odd[0xC3] = False

    def _library(self, text: str) -> list[str]:
        found = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                found.append(part)
            elif part:
                part = self.tokenizer.normalizer.normalize_str(part)
                found += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return found

    def split(self, data: np.ndarray, offsets: np.ndarray):
        """(hashes, bounds, word): pre-tokens of all texts, where each text's begin, and a
        function that gives the i-th pre-token as a string.
        """
        n = len(offsets) - 1
        gap = offsets + np.arange(n + 1)  # a space before each text and after the last
        raw = np.full(len(data) + n + 1, 0x20, np.uint8)
        raw[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = data
        after_c3 = np.zeros(len(raw), bool)
        after_c3[1:] = raw[:-1] == 0xC3
        odd = self.odd[raw] | (after_c3 & ((raw == 0x97) | (raw == 0xB7)))
        odd[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
        strange = np.unique(np.searchsorted(gap, np.flatnonzero(odd), "right") - 1)
        low = self.lower[raw]
        low[after_c3 & (raw >= 0x80) & (raw <= 0x9E)] += 0x20
        kind = self.kind[raw]
        start = kind != _SPACE
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        # An apostrophe alone before s, t, re, ve, m, ll or d takes these letters with it.
        mark = np.flatnonzero(start[:-1] & (low[:-1] == 0x27) & (kind[1:] == _LETTER))
        if len(mark):
            one, two = low[mark + 1], low[np.minimum(mark + 2, len(low) - 1)]
            short = np.isin(one, list(b"stmd"))
            long = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
            taken = mark[short | long]
            rest = taken + np.where(short, 2, 3)[short | long]
            start[taken + 1] = False
            rest = rest[kind[rest] == _LETTER]
            start[rest] = True
        starts = np.flatnonzero(start)
        if len(starts):
            sizes = np.add.reduceat(kind != _SPACE, starts, dtype=np.int64)
            with np.errstate(over="ignore"):
                at = np.arange(starts[0], len(low)) - np.repeat(starts, np.diff(np.append(starts, len(low))))
                terms = self.words.value[low[starts[0] :]] * self.words.power(at)
                hashes = mix(np.add.reduceat(terms, starts - starts[0]))
        else:
            sizes, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        bounds = np.searchsorted(starts, gap)
        text = low.tobytes()
        if not len(strange):
            return hashes, bounds, lambda i: text[starts[i] : starts[i] + sizes[i]].decode()
        parts, extra, cut, origin = [], {}, [0], []
        strange = set(strange.tolist())
        for i in range(n):
            if i in strange:
                found = self._library(data[offsets[i] : offsets[i + 1]].tobytes().decode())
                h = np.array([self.words.hash(w) for w in found], np.uint64)
                extra.update({cut[-1] + k: w for k, w in enumerate(found)})
                origin.append(np.full(len(found), -1))
            else:
                h = hashes[bounds[i] : bounds[i + 1]]
                origin.append(np.arange(bounds[i], bounds[i + 1]))
            parts.append(h)
            cut.append(cut[-1] + len(h))
        origin = np.concatenate(origin)

        def word(i: int) -> str:
            j = origin[i]
            return extra[i] if j < 0 else text[starts[j] : starts[j] + sizes[j]].decode()

        return np.concatenate(parts), np.array(cut), word


class Pieces:
    """Ids of pre-tokens, each looked up once per task as long as it is remembered."""

    def __init__(self, path: str):
        self.splitter = Splitter(path)
        tokenizer = self.splitter.tokenizer
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        size = tokenizer.get_vocab_size(with_added_tokens=True) + 1
        self.suffix = tokenizer.model.end_of_word_suffix
        self.last = np.zeros(size, bool)
        self.sentence = np.zeros(size, bool)
        for piece, i in vocabulary.items():
            if piece.endswith(self.suffix):
                self.last[i] = True
                self.sentence[i] = piece.removesuffix(self.suffix)[-1:] in (".", "!", "?")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # For pre-tokens that are already normalized and stand between single spaces.
        self.plain = Tokenizer(tokenizer.model)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 15, np.int64)
        self.size = np.zeros(1 << 15, np.int64)
        self.used = 0

    def _look_up(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of pre-tokens and how many each has, in portions."""
        ids, sizes = [], []
        for at in range(0, len(words), 200):
            part = words[at : at + 200]
            if any(w in self.special or " " in w for w in part):
                for w in part:
                    one = [self.special[w]] if w in self.special else self.plain.encode(w, add_special_tokens=False).ids
                    ids.append(np.array(one, np.uint32))
                    sizes.append(np.array([len(one)]))
                continue
            found = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[found]) + 1
            assert len(ends) == len(part)
            ids.append(found)
            sizes.append(np.diff(ends, prepend=0))
        return ids, sizes

    def count(self, words: list[str]) -> np.ndarray:
        """How many pieces each pre-token has."""
        return np.concatenate([np.zeros(0, np.int64), *self._look_up(words)[1]])

    def _add(self, hashes: list[int], words: list[str]) -> None:
        ids, sizes = self._look_up(words)
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        first = len(self.place)
        for name, more in (("ids", self.used + len(ids)), ("start", first + len(sizes)), ("size", first + len(sizes))):
            old = getattr(self, name)
            if more > len(old):
                setattr(self, name, np.concatenate((old, np.zeros(max(more, 2 * len(old)) - len(old), old.dtype))))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[first : first + len(sizes)] = sizes
        self.start[first : first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.place.update(zip(hashes, range(first, first + len(hashes))))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin."""
        hashes, bounds, word = self.splitter.split(data, offsets)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.place) > KNOWN:
            self.forget()
        names = distinct.tolist()
        unseen = [k for k, h in enumerate(names) if h not in self.place]
        if unseen:
            self._add([names[k] for k in unseen], [word(where[k]) for k in unseen])
        place = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))[back]
        size = self.size[place]
        ends = np.cumsum(size)
        at = np.repeat(self.start[place] - (ends - size), size) + np.arange(ends[-1])
        return self.ids[at], np.concatenate(([0], ends))[bounds]
