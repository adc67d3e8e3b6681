"""Token ids of whole texts by a public tokenizer's vocabulary file.

The tokenizer drops white space and never joins across it, so a text's ids are those of its
words one after another. Each distinct word is encoded once and its ids are kept (at most
KEPT_WORDS words in a Python worker, then anew); texts are put together from these by arrays.
"""

from __future__ import annotations

import functools
import os

import numpy as np

from foliospark.llm.textkit import Texts, words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
KEPT_WORDS, ENCODED_WORDS = 1 << 20, 1 << 13
VOCABULARY = "word_bpe_49k.json"
END = 2


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def _learn(self, keys: np.ndarray, values: list[str]) -> None:
        if len(self.keys) + len(keys) > max(KEPT_WORDS, len(keys)):
            raise OverflowError
        encode = self.tokenizer.encode_batch_fast  # in parts: an encoding is far larger than its ids
        found = [e.ids for i in range(0, len(values), ENCODED_WORDS) for e in encode(values[i : i + ENCODED_WORDS], add_special_tokens=False)]
        size = np.array([len(x) for x in found], np.int32)
        flat = np.array([i for x in found for i in x], np.int32)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * len(self.ids) + len(flat), np.int32)])
        self.ids[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = (np.insert(a, where, b) for a, b in ((self.keys, keys), (self.at, at), (self.size, size)))

    def encode(self, texts: Texts, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``end`` last, and the index of each text's first id."""
        w = words(texts, lower=False)
        distinct, sample, word = np.unique(w.hashes, return_index=True, return_inverse=True)
        for _ in range(2):
            near = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
            new = self.keys[near] != distinct if len(self.keys) else np.ones(len(distinct), bool)
            if not new.any():
                break
            missing = sample[new]
            values = [texts.data[a:b].tobytes().decode("utf-8") for a, b in zip(w.starts[missing], w.ends[missing], strict=True)]
            try:
                self._learn(distinct[new], values)
            except OverflowError:
                self.forget()
                values = [texts.data[a:b].tobytes().decode("utf-8") for a, b in zip(w.starts[sample], w.ends[sample], strict=True)]
                self._learn(distinct, values)
        where = np.searchsorted(self.keys, distinct)[word]
        size = self.size[where].astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        first = begin[w.first] + np.arange(len(w.first))
        inner = np.ones(first[-1], bool)
        inner[first[1:] - 1] = False
        out = np.full(first[-1], end, np.int32)
        out[inner] = self.ids[np.arange(begin[-1]) - np.repeat(begin[:-1] - self.at[where], size)]
        return out, first


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
