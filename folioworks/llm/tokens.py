"""Token ids of whole texts by the tokenizers library, each distinct pre-token of a batch encoded once.

A byte-level BPE model with the usual splitting pattern encodes each pre-token by itself, so the ids of a text are
those of its pre-tokens, one after another. Pre-tokens are found for a whole Arrow batch at once with numpy, their
distinct strings go through the library's BPE model, and a gather puts the ids together. Texts that hold a string of
an added token, and tokenizers with another pre-tokenizer, take the library's plain path.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
import pyarrow as pa

from folioworks.llm.common import code_points, range_hashes, spread, texts_of, worker_state

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: The contractions of the splitting pattern of byte_bpe_50k.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Pre-tokens whose ids a Python worker keeps, and the characters of one on average.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 32

_CLASSES: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """The class of every code point, as the pattern's \\p{L}, \\p{N} and \\s see it."""
    global _CLASSES
    if _CLASSES is None:
        import regex

        table = np.zeros(0x110000, np.uint8)
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, everything):
                first, last = ord(m[0][0]), ord(m[0][-1])
                if last - first == len(m[0]) - 1:
                    table[first : last + 1] = kind
                else:
                    for c in m[0]:
                        table[ord(c)] = kind
        _CLASSES = table
    return _CLASSES


def pretoken_bounds(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions at which a pre-token starts, in the code points of many texts; bounds: the texts' ends, 0 first."""
    n = len(codes)
    kinds = char_classes()[codes]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    change = first[:n].copy()
    change[1:] |= kinds[1:] != kinds[:-1]
    starts = change.copy()
    space = kinds == SPACE
    # The last white space before a visible character: a blank joins what follows, any other stands alone.
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    starts[before] = True
    blank = np.flatnonzero(before & (codes == 32))
    starts[blank + 1] = False
    # Contractions, where an apostrophe starts a run that no blank leads.
    for i in np.flatnonzero((codes == 39) & starts):
        end = int(bounds[np.searchsorted(bounds, i, "right")])
        rest = "".join(map(chr, codes[i : min(i + 3, end)]))
        for c in CONTRACTIONS:
            if rest.startswith(c):
                if i + len(c) < end:
                    starts[i + len(c)] = True
                starts[i + 1] = False
                break
    return np.flatnonzero(starts)


def byte_letters() -> list[str]:
    """The printable character that a byte-level model has for each byte: visible Latin-1 stays, the rest follows 255."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Encoder:
    """Encodes Arrow columns of texts with a tokenizer file of the tokenizers library."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.entries = entries
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.splits = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"].get("type") == "BPE"
        self.letters = dict(enumerate(byte_letters()))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.flat, self.filled = np.zeros(1 << 16, np.uint32), 0
        self.offsets, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) and the bounds of each text in them; a null text is empty."""
        text, bounds = texts_of(column)
        if self.splits and not any(a in text for a in self.added):
            return self._by_pretokens(text, bounds)
        whole = [text[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(whole, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encodes words by the library's BPE model and keeps their ids."""
        tokenize, letters = self.model.tokenize, self.letters
        ids = [[t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))] for w in words]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
        have = len(self.known)
        while self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while have + len(words) > len(self.offsets):
            self.offsets, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offsets, self.lengths))
        self.flat[self.filled : self.filled + len(flat)] = flat
        self.offsets[have : have + len(words)] = self.filled + np.cumsum(lengths) - lengths
        self.lengths[have : have + len(words)] = lengths
        self.filled += len(flat)
        self.chars += sum(map(len, words))
        self.known.update(zip(words, range(have, have + len(words)), strict=True))

    def _by_pretokens(self, text: str, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = code_points(text)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        starts = pretoken_bounds(codes, bounds)
        ends = np.append(starts[1:], len(codes))
        which, words = distinct_words(text, codes, starts, ends)
        if len(self.known) + len(words) > self.entries or self.chars > self.entries * CACHE_CHARS:
            self._forget()
        if new := [w for w in words if w not in self.known]:
            self._learn(new)
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        offsets, lengths = self.offsets[index][which], self.lengths[index][which]
        out = self.flat[spread(offsets, lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return out, upto[np.searchsorted(starts, bounds)]


def distinct_words(text: str, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The distinct strings of the ranges, and which of them each range is. Ranges are grouped by a hash, and each is then
    compared with the string of its group; where a hash stood for two strings, the strings themselves are grouped."""
    which, hashes = pd.factorize(range_hashes(codes, starts, ends))
    at = np.zeros(len(hashes), np.int64)
    at[which[::-1]] = np.arange(len(which))[::-1]
    sizes = ends - starts
    first = at[which]
    # Ranges lie one after another, so the characters of all of them are codes[starts[0]:].
    if (sizes == sizes[first]).all() and (codes[int(starts[0]) :] == codes[spread(starts[first], sizes)]).all():
        return which, [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
    which, words = pd.factorize(np.array([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], object))
    return which, words.tolist()


def encoder(path: str, entries: int = CACHE_ENTRIES) -> Encoder:
    """The encoder of a Python worker, loaded once."""
    state = worker_state("tokens")
    if (path, entries) not in state:
        state[path, entries] = Encoder(path, entries)
    return state[path, entries]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with end_id after each text, and the new bounds."""
    lengths = np.diff(bounds)
    bounds = bounds + np.arange(len(bounds))
    out = np.full(int(bounds[-1]), end_id, np.uint32)
    out[spread(bounds[:-1], lengths)] = ids
    return out, bounds
