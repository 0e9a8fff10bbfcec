"""Byte-pair token ids and the exact number of tokens of every prefix of a text, for byte-level BPE files of `tokenizers`.

A text is cut by the vocabulary's fixed pattern, and what belongs to a cut piece is computed once and remembered: its ids,
or the token counts of its prefixes. The memory is bounded; forgetting costs time only.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from itertools import accumulate

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: The pattern by which byte-level BPE cuts a text, and its contractions.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)\Z")
SPACES = regex.compile(r"\s+")
#: Letters, digits and spaces of these ranges are the same in every Unicode version; other texts are cut by the library itself.
STABLE = re.compile(r"[\x00-\u024f\u2010-\u2027\u20ac]*\Z")
_L, _N, _S = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be", r"\t-\r \x85\xa0"
#: The pieces of the pattern, for texts of those ranges, each with the white space before it: what follows a text's end can
#: change how trailing white space is cut, and nothing else.
UNIT = re.compile(rf"[{_S}]*(?:[{_L}]+|[{_N}]+)|(?:[{_S}]*[\t-\r\x85\xa0])?'(?:s|t|re|ve|m|ll|d)|[{_S}]*[^{_S}{_L}{_N}]+|[{_S}]+")


class Memory(dict):
    """Calls `make` for what it does not hold. Two generations: when the younger is full, it becomes the older, which goes."""

    def __init__(self, make, most: int = 400_000, longest: int = 200):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = {x.content: i for i, x in self.library.get_added_tokens_decoder().items()}
        self.by_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.units = Memory(self._unit)
        self.spaces = Memory(self._counts)
        self.pairs = Memory(self._pair)
        self.same: dict[bytes, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        """Token ids as the library gives them, its special strings included."""
        if not self.by_rank or not STABLE.match(text):
            return np.array(self._encode(text), "<u4")
        found: list[int] = []
        for part, is_special in self._parts(text):
            found += [self.special[part]] if is_special else self.by_rank.encode_ordinary(part)
        return np.array(found, "<u4")

    def prefix_steps(self, text: str) -> bytes:
        """Little-endian int16 per code point: by how much it changes the number of tokens of the text up to and with it."""
        found, before = [], ""
        for part, is_special in self._parts(text):
            if is_special:  # one token once it is complete; until then ordinary text after the part before it
                done = sum(array("h", found.pop())) if before else 0
                found.append(self._steps(before + part[:-1]))
                found.append(array("h", [done + 1 - sum(array("h", found[-1]))]).tobytes())
                before = ""
            else:
                found.append(self._steps(part))
                before = part
        return b"".join(found)

    def _steps(self, part: str) -> bytes:
        return b"".join(map(self.units.__getitem__, self._cut(part)))

    def _encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _parts(self, text: str) -> list[tuple[str, bool]]:
        if not self.by_special or not any(s in text for s in self.special):
            return [(text, False)]
        return [(x, bool(k % 2)) for k, x in enumerate(self.by_special.split(text)) if x]

    def _cut(self, part: str) -> list[str]:
        if STABLE.match(part):
            return UNIT.findall(part)
        units, start = [], 0
        for _, (_, end) in self.library.pre_tokenizer.pre_tokenize_str(part):
            if end == len(part) or not SPACES.fullmatch(part, start, end):
                units.append(part[start:end])
                start = end
        return units

    def _unit(self, unit: str) -> bytes:
        spaces = SPACES.match(unit)
        space = spaces.group() if spaces else ""
        core = unit[len(space) :]
        counts = list(self.spaces[space]) if space else []
        if core:
            if CONTRACTION.match(core):
                own, cut = [len(self._encode(core[:k])) for k in range(1, len(core) + 1)], (space[:-1], space[-1:])
            elif space.endswith(" "):
                own, cut = self._counts(" " + core)[1:], (space[:-1],)
            else:
                own, cut = self._counts(core), (space[:-1], space[-1:])
            before = sum(self.spaces[x][-1] for x in cut if x)
            counts += [before + n for n in own]
        steps = array("h", [n - m for m, n in zip([0, *counts], counts, strict=False)]).tobytes()
        return self.same.setdefault(steps, steps) if len(steps) <= 40 else steps

    def _counts(self, piece: str) -> list[int]:
        """Tokens of each prefix of one piece, by dynamic programming: the last token of a prefix is the one that the pair before it allows."""
        data, tokens, pairs, sizes = piece.encode(), self.tokens, self.pairs, self.sizes
        count, last = [0], [-1]
        for end in range(1, len(data) + 1):
            for size in sizes[data[end - 1]]:
                start = end - size
                if start < 0:
                    continue
                token = tokens.get(data[start:end])
                if token is not None and pairs[last[start], token]:
                    count.append(count[start] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends {data[:end][-20:]!r}")
        return [count[k] for k in accumulate(len(c.encode()) for c in piece)] if len(data) != len(piece) else count[1:]

    @functools.cached_property
    def names(self) -> list[str]:
        """The vocabulary's spelling of each token."""
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        names = [""] * (max(vocabulary.values()) + 1)
        for name, token in vocabulary.items():
            names[token] = name
        return names

    @functools.cached_property
    def tokens(self) -> dict[bytes, int]:
        """Bytes of each token that byte-pair merging itself can give."""
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that are written as themselves
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        return {bytes(byte_of[c] for c in name): token for token, name in enumerate(self.names) if name and all(c in byte_of for c in name)}

    @functools.cached_property
    def by_rank(self) -> tiktoken.Encoding | None:
        """The same merges, without the offsets that the library keeps, if the file numbers its tokens in the order of its merges."""
        model = json.loads(self.library.to_str())["model"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [model["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))) or len(self.tokens) != 256 + len(merged):
            return None
        return tiktoken.Encoding("pieces", pat_str=SPLIT, mergeable_ranks=self.tokens, special_tokens={})

    @functools.cached_property
    def sizes(self) -> list[list[int]]:
        """Of the tokens that end in a byte their sizes, longest first."""
        found: list[set[int]] = [set() for _ in range(256)]
        for token in self.tokens:
            found[token[-1]].add(len(token))
        return [sorted(x, reverse=True) for x in found]

    def _pair(self, pair: tuple[int, int]) -> bool:
        """Whether the second token can follow the first inside one piece (first -1: stand at its start)."""
        want = [t for t in pair if t >= 0]
        return [t.id for t in self.library.model.tokenize("".join(self.names[t] for t in want))] == want


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)
