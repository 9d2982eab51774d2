"""Fast exact tokenisation with a word-level BPE vocabulary, and a cache of words.

The vocabulary drops white space and never merges over it, so a text's ids are those of its words in a
row: each distinct word is encoded once and then looked up. New words are encoded together by a byte
pair encoder that works on bytes and ranks, with the end of a word as a byte of its own. Texts with
characters beyond a plain set, whose normalisation may need more than a word, and texts that spell out
an added token, which the tokenizer reads as one id, go to the tokenizer whole.
"""

from __future__ import annotations

import json
import re
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Any character outside the set for which lower-casing and splitting by word is the whole normalisation.
_ODD = re.compile("[^\t-\r -~¡-¬®-įı-ſ‐-‧‰-⁞]")
_LETTERS = "a-zªµºß-öø-ÿĀ-ſ"
_NUMBERS = "0-9²³¹¼-¾"
#: The vocabulary's own split of a lower-cased text, for the plain set; a line end stands between words.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+|\n")
_END = b"\x00"


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others for 256 and up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTokenizer:
    """`encode` gives the ids of many texts. The cache is emptied when it would hold more than `max_words` words."""

    def __init__(self, path: str, max_words: int = 600_000):
        from tiktoken import _tiktoken
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        special = {t.content for t in self.inner.get_added_tokens_decoder().values()}
        self.whole = re.compile("|".join([_ODD.pattern, *(re.escape(t) for t in sorted(special))]))
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in t.removesuffix("</w>")) + _END * t.endswith("</w>"): i for t, i in vocab.items() if t not in special}
        self.pairs = _tiktoken.CoreBPE(ranks, {}, "[^\\x00]*\\x00")
        self.line = ranks[b"\n" + _END]
        self.max_words = max_words
        self.clear()

    @staticmethod
    @cache
    def of(path: str) -> WordTokenizer:
        return WordTokenizer(path)

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 18, np.uint16 if self.inner.get_vocab_size() <= 1 << 16 else np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def _learn(self, words: list[str]) -> None:
        pieces = _PIECE.findall(" \n ".join(words))
        ids = np.array(self.pairs.encode_ordinary("\0".join(pieces) + "\0"), self.ids.dtype)
        lines = ids == self.line
        ends = np.append(np.flatnonzero(lines) - np.arange(len(words) - 1), len(ids) - len(words) + 1)
        n, k = len(self.index), len(ids) - len(words) + 1
        while self.n_ids + k > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.ids[self.n_ids : self.n_ids + k] = ids[~lines]
        self.sizes[n : n + len(words)] = np.diff(ends, prepend=0)
        self.starts[n : n + len(words)] = self.n_ids + ends - self.sizes[n : n + len(words)]
        self.index.update(zip(words, range(n, n + len(words)), strict=True))
        self.n_ids += k

    def _indices(self, words: list[str]) -> np.ndarray:
        """Places of distinct words in the cache; unknown ones are learnt."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new) and self.index and len(self.index) + len(new) > self.max_words:
            self.clear()
            new = np.arange(len(words))
        if len(new):
            n = len(self.index)
            self._learn([words[i] for i in new.tolist()])
            at[new] = np.arange(n, n + len(new))
        return at

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, each followed by `end_id`, and where each text ends. Null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        plain = np.array([not self.whole.search(t) for t in texts.to_pylist()], bool)
        words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts.filter(pa.array(plain)))))
        coded = words.flatten().dictionary_encode()
        at = self._indices(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(coded.indices)]
        n = self.sizes[at].astype(np.int64)
        ids = self.ids[np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.uint32)
        upto = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(words), np.int64))])]
        tail = np.array([] if end_id is None else [end_id], np.uint32)
        other = iter(self.inner.encode_batch(texts.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False) if not plain.all() else [])
        out, sizes, w = [], [], 0
        for p in plain.tolist():
            part = ids[upto[w] : upto[w + 1]] if p else np.array(next(other).ids, np.uint32)
            w += p
            out += [part, tail]
            sizes.append(len(part) + len(tail))
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.cumsum(sizes, dtype=np.int64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        return np.diff(self.encode(texts)[1], prepend=0)
