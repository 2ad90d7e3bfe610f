"""Whole-text encoding with a public tokenizer, sped up by encoding each word once.

The tokenizer's normaliser, pre-tokeniser and merges never look across ASCII
white space, which they drop, so a text's ids are the concatenated ids of its
white-space separated chunks. Chunks go through the tokenizers library; a
bounded two-generation cache keeps the ids of frequent ones.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from samplight.llm.common import Words, kept, ragged_take

#: Strings that a store holds before it starts anew.
CACHE_WORDS = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class IdStore:
    """Ids of strings in flat arrays; when it is full, strings met once go."""

    def __init__(self, size: int, make: Callable[[list[str]], list[list[int]]]):
        self.size, self.make = size, make
        self.index: dict[str, int] = {}
        self.starts, self.lengths, self.met = (np.zeros(0, np.int64) for _ in range(3))
        self.flat = np.zeros(0, np.uint32)

    def _shrink(self) -> None:
        keep = self.met > 1
        if keep.sum() > self.size // 2:
            keep[:] = False
        row = np.where(keep, np.cumsum(keep) - 1, -1).tolist()
        self.index = {k: row[i] for k, i in self.index.items() if row[i] >= 0}
        self.flat = ragged_take(self.flat, self.starts[keep], self.lengths[keep])
        self.lengths, self.met = self.lengths[keep], self.met[keep]
        self.starts = np.cumsum(self.lengths) - self.lengths

    def find(self, keys: list[str]) -> np.ndarray:
        """Each key's row in starts and lengths."""
        if len(self.index) + len(keys) > self.size:
            self._shrink()
        get = self.index.get
        rows = np.array([get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new):
            missing = list(dict.fromkeys([keys[i] for i in new.tolist()]))
            ids = self.make(missing)
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            more = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum()))
            self.index.update(zip(missing, range(len(self.starts), len(self.starts) + len(missing)), strict=True))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.flat = np.concatenate((self.flat, more))
            self.met = np.concatenate((self.met, np.zeros(len(missing), np.int64)))
            rows[new] = [self.index[keys[i]] for i in new.tolist()]
        self.met[rows] += 1
        return rows


#: Characters that a chunk's end is cut off at; never letters, digits or "'".
TAIL = ".,!?;:*$&%#|"


#: What tail() leaves of a chunk.
TAIL_PATTERN = r"(?s)^.*?([.,!?;:*$&%#|]*)$"


def may_cut(core: str) -> bool:
    """Whether the pre-tokeniser cuts after core where punctuation of TAIL follows.

    It does after a letter or digit; only characters below U+0250 are trusted
    to be one, without the one that gains a combining mark in lower case.
    """
    return not core or (core[-1].isalnum() and core[-1] < "\u0250" and core[-1] != "\u0130")


def cut_tails(chunks: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, list[str]]:
    """Codes and strings of the chunks' cores, and of the punctuation after them."""
    cores = pc.utf8_rtrim(chunks, characters=TAIL)
    encoded = cores.dictionary_encode()
    code, strings = np.asarray(encoded.indices, np.int64), encoded.dictionary.to_pylist()
    tails = pc.replace_substring_regex(chunks, pattern=TAIL_PATTERN, replacement=r"\1").dictionary_encode()
    tail_code, tail_strings = np.asarray(tails.indices, np.int64), tails.dictionary.to_pylist()
    never = ~np.fromiter(map(may_cut, strings), bool, len(strings))
    if never.any():
        none = len(tail_strings)
        tail_strings.append("")
        has_tail = np.asarray(pc.not_equal(chunks, cores))
        whole = np.flatnonzero(never[code] & has_tail)
        code[whole] = len(strings) + np.arange(len(whole))
        strings += chunks.take(pa.array(whole)).to_pylist()
        tail_code[whole] = none
    return code, strings, tail_code, tail_strings


def is_plain_word(core: str) -> bool:
    """Whether the tokenizer takes core as one piece that normalising only lower-cases."""
    return core.isalpha() and (core.isascii() or (max(core) < "\u0250" and "\u0130" not in core))


class LibraryEncoder:
    """Ids of texts by the tokenizers library, without special tokens added."""

    #: Plain words that one call encodes, as a text with spaces between.
    JOINED = 200

    def __init__(self, vocabulary: str, store_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.store = IdStore(store_words, self._encode)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _each(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, cores: list[str]) -> list[list[int]]:
        """Plain words many at a time, cut again at tokens that end a word; others one by one."""
        found: dict[str, list[int]] = {}
        plain, other = [], []
        for c in cores:
            (plain if is_plain_word(c) else other).append(c)
        for k in range(0, len(plain), 50 * self.JOINED):
            parts = [plain[j : j + self.JOINED] for j in range(k, min(len(plain), k + 50 * self.JOINED), self.JOINED)]
            for words, ids in zip(parts, self._each([" ".join(p) for p in parts]), strict=True):
                ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist() if ids else []
                if len(ends) != len(words) or ends[-1] != len(ids):
                    other += words
                    continue
                at = 0
                for w, end in zip(words, ends, strict=True):
                    found[w] = ids[at:end]
                    at = end
        for k in range(0, len(other), 10_000):
            found.update(zip(other[k : k + 10_000], self._each(other[k : k + 10_000]), strict=True))
        return [found[c] for c in cores]

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of the texts); null counts as empty."""
        words = Words(column, fold=True)
        code, cores, tail_code, tails = cut_tails(words.uniq)
        rows = self.store.find(cores + tails)
        rows = np.stack((rows[code], rows[len(cores) + tail_code]), axis=1)
        lengths = self.store.lengths[rows]
        flat = ragged_take(self.store.flat, self.store.starts[rows].ravel(), lengths.ravel())
        lengths = lengths.sum(axis=1)
        starts = np.cumsum(lengths) - lengths
        of_word = lengths[words.codes]
        out = ragged_take(flat, starts[words.codes], of_word)
        ends = np.concatenate(([0], np.cumsum(of_word)))
        return out, ends[words.offsets]


def library_encoder(vocabulary: str, store_words: int = CACHE_WORDS) -> LibraryEncoder:
    return kept(("library", vocabulary, store_words), lambda: LibraryEncoder(vocabulary, store_words))
