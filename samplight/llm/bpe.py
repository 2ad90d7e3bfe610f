"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one token can be the last of its encoding:
the token that matches a suffix of the prefix and is compatible with the last
token of what stands before it. An Aho-Corasick automaton (suffix links over
the vocabulary) lists the matches, a pair-compatibility test picks the one,
and back-pointers from the whole piece give the ids.

Two adjacent tokens are compatible when merging their symbols together would
leave the border between them alone. Merges of a piece run in rising rank, so
the border is crossed if and only if some merge joins a symbol that ends the
left token, before that symbol is merged away inside it, with one that starts
the right token, likewise; on equal ranks the leftmost goes first.

Normalising and pre-tokenising follow the vocabulary file, by the library's
own parts where a chunk isn't plain ASCII. Special tokens in a text are found
as the library does. Texts are cut at ASCII white space first, which the
pre-tokeniser drops.

Edge cases: null counts as empty and gives no ids, the empty text and the
hashes of nothing; other columns are ignored; rows that repeat are each
encoded; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from samplight.llm.common import Words, kept, map_arrow, ragged_take, text_slices
from samplight.llm.tokens import CACHE_WORDS, IdStore, cut_tails, default_vocabulary

WORD_END = "</w>"
#: Pairs of tokens whose test is remembered.
PAIR_MEMORY = 200_000
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+", re.ASCII)


class MergeTable:
    """The merges of a vocabulary as a forest: each token's rank and its two parts."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merge_rank: dict[tuple[int, int], int] = {}
        for r, (left, right) in enumerate(merges):
            pair, made = (vocab[left], vocab[right]), vocab[left + right]
            if made in self.parts:
                raise ValueError(f"two merges make token {left + right!r}; its last token would not be unique")
            self.parts[made], self.rank[made], self.merge_rank[pair] = pair, r, r
        self._pairs: dict[tuple[int, int], bool] = {}

    def _border(self, token: int, side: int) -> list[tuple[int, float]]:
        """The symbols at one end of token as it is merged up, with the rank that ends each."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until = self.rank[token]
            token = self.parts[token][side]

    def _crossed(self, left: int, right: int, whole: bool) -> bool:
        """Whether a merge crosses the border; whole: but for the merge of the two themselves."""
        starts = self._border(right, 0)
        for x, x_until in self._border(left, 1):
            for y, y_until in starts:
                r = self.merge_rank.get((x, y))
                if r is not None and r < x_until and r <= y_until and not (whole and x == left and y == right):
                    return True
        return False

    def compatible(self, left: int, right: int) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= PAIR_MEMORY:
                self._pairs.clear()
            known = self._pairs[left, right] = not self._crossed(left, right, False)
        return known

    def reachable(self) -> set[int]:
        """Tokens that their own symbols are encoded as."""
        good = set(self.vocab.values()) - set(self.parts)
        for token in sorted(self.parts, key=self.rank.get):
            left, right = self.parts[token]
            if left in good and right in good and not self._crossed(left, right, True):
                good.add(token)
        return good


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it prints, else one from U+0100 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PrefixEncoder:
    """Ids of pieces over one vocabulary with word ends."""

    #: Added to a letter that ends its piece, so that a symbol is one character.
    END = 0x1000

    def __init__(self, table: MergeTable):
        import ahocorasick

        self.table = table
        self.automaton = ahocorasick.Automaton()
        good = table.reachable()
        for text, token in table.vocab.items():
            if token in good:
                symbols = self.symbols(text[: -len(WORD_END)]) if text.endswith(WORD_END) and text != WORD_END else text
                self.automaton.add_word(symbols, (token, len(symbols)))
        self.automaton.make_automaton()

    def symbols(self, letters: str) -> str:
        return letters[:-1] + chr(ord(letters[-1]) + self.END) if letters else letters

    def encode_sorted(self, pieces: list[str]) -> list[list[int]]:
        """Ids of pieces (letters of bytes) in sorted order: common prefixes are solved once."""
        out = []
        last: list[int] = [-1]  # last[i]: the last token of the first i symbols
        back: list[int] = [0]  # where that token starts
        before = ""
        compatible, matches = self.table.compatible, self.automaton.iter
        for piece in pieces:
            text = self.symbols(piece)
            n, same = len(text), 0
            most = min(n, len(before)) - 1
            while same < most and text[same] == before[same]:
                same += 1
            last[same + 1 :] = [-1] * (n - same)
            back[same + 1 :] = [0] * (n - same)
            for end, (token, length) in matches(text):
                if end >= same and last[end + 1] < 0:
                    start = end + 1 - length
                    if start == 0 or (last[start] >= 0 and compatible(last[start], token)):
                        last[end + 1], back[end + 1] = token, start
            if n and last[n] < 0:
                raise ValueError(f"no encoding of {piece!r}")
            ids, at = [], n
            while at:
                ids.append(last[at])
                at = back[at]
            ids.reverse()
            out.append(ids)
            before = text
        return out


class TextCoder:
    """Encodes and decodes as the library does with one vocabulary file."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        spec = json.load(open(vocabulary, encoding="utf-8"))
        model = spec["model"]
        if model.get("end_of_word_suffix") != WORD_END or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("not a BPE vocabulary with word ends")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.encoder = PrefixEncoder(MergeTable(model["vocab"], merges))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.strings = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        library = Tokenizer.from_file(vocabulary)
        self.normalise, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        letters = byte_letters()
        self.to_letters = {b: letters[b] for b in range(128)}
        self.store = IdStore(CACHE_WORDS, self._encode_chunks)

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        order = sorted(range(len(pieces)), key=pieces.__getitem__)
        out: list[list[int]] = [[]] * len(pieces)
        for k, ids in zip(order, self.encoder.encode_sorted([pieces[k] for k in order]), strict=True):
            out[k] = ids
        return out

    def _cut(self, chunk: str) -> list[str]:
        """The byte letters of a chunk's pieces."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            return [p.translate(self.to_letters) for p in _ASCII_PIECES.findall(chunk.lower())]
        return [p for p, _ in self.cut(self.normalise(chunk))]

    def _encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        cut: list[list[str | int]] = []
        for c in chunks:
            if self.special_pattern and "<|" in c:
                parts = self.special_pattern.split(c)
                cut.append([x for k, p in enumerate(parts) for x in ([self.special[p]] if k % 2 else self._cut(p) if p else [])])
            else:
                cut.append(self._cut(c))
        pieces = list(dict.fromkeys(p for parts in cut for p in parts if isinstance(p, str)))
        found = dict(zip(pieces, self._encode_pieces(pieces), strict=True))
        return [found[parts[0]] if len(parts) == 1 and isinstance(parts[0], str) else [i for p in parts for i in (found[p] if isinstance(p, str) else [p])] for parts in cut]

    def encode(self, text: str) -> list[int]:
        ids, offsets = self.batch(pa.array([text]))
        return ids[: offsets[1]].tolist()

    def decode(self, ids: list[int]) -> str:
        """As the library without a decoder part: the tokens' strings with spaces between."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)

    def words(self, column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
        """The words of the texts, with flat ids and lengths for each distinct one."""
        words = Words(column, fold=True)
        code, cores, tail_code, tails = cut_tails(words.uniq)
        found = self.store.find(cores + tails)
        rows = np.stack((found[code], found[len(cores) + tail_code]), axis=1)
        lengths = self.store.lengths[rows]
        flat = ragged_take(self.store.flat, self.store.starts[rows].ravel(), lengths.ravel())
        return words, flat, lengths.sum(axis=1)

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of the texts); null counts as empty."""
        words, flat, lengths = self.words(column)
        starts, of_word = np.cumsum(lengths) - lengths, lengths[words.codes]
        ends = np.concatenate(([0], np.cumsum(of_word)))
        return ragged_take(flat, starts[words.codes], of_word), ends[words.offsets]


def text_coder(vocabulary: str) -> TextCoder:
    return kept(("bpe", vocabulary), lambda: TextCoder(vocabulary))


def _joined(strings: pa.Array, lengths: np.ndarray) -> pa.Array:
    """Runs of strings joined by one space each."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, strings), " ")


def _digests(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(vocabulary)
        top = max(coder.strings)
        id_text = pa.array([str(i) for i in range(top + 1)])
        token_text = pa.array([coder.strings.get(i, "") for i in range(top + 1)])
        for batch in batches:
            for rows in text_slices(batch, limit=4 << 20):
                words, flat, lengths = coder.words(rows.column("text"))
                counts = lengths[words.codes]
                n_tokens = np.concatenate(([0], np.cumsum(counts)))[words.offsets]
                there = counts > 0  # words of nothing would join as empty strings
                before = np.concatenate(([0], np.cumsum(there)))[words.offsets]
                codes = pa.array(words.codes[there])
                out = []
                for strings in (id_text, token_text):
                    of_word = _joined(strings.take(pa.array(flat)), lengths)
                    texts = _joined(of_word.take(codes), np.diff(before))
                    out.append([hashlib.sha256(memoryview(x.as_buffer())).hexdigest() for x in texts])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.diff(n_tokens)), pa.array(out[0], pa.string()), pa.array(out[1], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def encode_and_decode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; no shuffle."""
    run = _digests(vocabulary or default_vocabulary())
    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
