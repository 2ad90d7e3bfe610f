"""Language identification by unigrams summed over all segmentations.

Each language has a probability for every piece of one fixed public
vocabulary. A forward pass over a word sums the probabilities of all ways to
cut it into pieces; pieces never cross word borders, so the sum for a text is
the product over its words. Expectation-maximisation (forward-backward counts)
fits the pieces on a bounded sample of labelled documents, whole texts.

Texts are put in lower case, cut at white space, and punctuation at the ends
of words is dropped; a character that no piece covers costs a fixed share.
Words of more than PLAIN_CHARS characters are summed in logarithms, as their
products underflow; those of more than ARC_CHARS keep the arcs of a part only.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as
is everything where no labelled text was there to learn from; rows that repeat
a document get the same answer; an empty table gives an empty result.
``keep_identified`` carries all other columns untouched.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplight.llm.common import Words, kept, map_arrow, plain_strings, text_slices
from samplight.llm.wordstore import WordStore

#: Labelled documents of a language that the model is fitted on, on average (chosen by a hash of doc_id).
SAMPLE_DOCS = 800
ROUNDS = 4
#: Added to every piece's expected count.
SMOOTHING = 0.05
#: Characters of the longest words that are summed as plain products.
PLAIN_CHARS = 32
#: Words, and characters of longer words, that are held in memory with all their arcs.
ARC_WORDS, ARC_CHARS = 4_096, 262_144
STORE_WORDS = 200_000
#: Text bytes that one step of a prediction works on.
PREDICT_BYTES = 2 << 20
#: Below this posterior probability a document counts as not identified.
LEAST_SCORE = 0.5
ENDS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‚‘’¿¡…–—"
MARK = "▁"  # what the vocabulary writes before a word


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Where the vocabulary's pieces lie in words."""

    def __init__(self, vocabulary: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        strings = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.automaton = ahocorasick.Automaton()
        for k, s in enumerate(strings):
            self.automaton.add_word(s, (k, len(s)))
        self.automaton.make_automaton()
        #: One more stands for a character that is no piece.
        self.count = len(strings) + 1
        self.longest = max(map(len, strings))

    def arcs(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first position of each word, arcs' starts, ends, pieces), arcs by place in their word, then by end.

        Each word has one position more than it has characters with its mark.
        """
        joined = "\n".join(MARK + w for w in words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        firsts = np.cumsum(lengths) - lengths
        found = [(end, k, n) for end, (k, n) in self.automaton.iter(joined)]
        table = np.array(found, np.int64).reshape(-1, 3)
        ends, pieces, sizes = table[:, 0] + 1, table[:, 1], table[:, 2]
        single = np.zeros(int(lengths.sum()) + 1, bool)
        single[ends[sizes == 1]] = True
        inner = np.ones(int(lengths.sum()), bool)
        inner[firsts] = False
        bare = np.flatnonzero(inner & ~single[:-1])
        ends = np.concatenate((ends, bare))
        starts = np.concatenate((ends[: len(sizes)] - sizes, bare - 1))
        pieces = np.concatenate((pieces, np.full(len(bare), self.count - 1)))
        place = ends - firsts[np.searchsorted(firsts, ends, side="right") - 1]
        order = np.lexsort((ends, place))
        self.places = place[order]
        return firsts, starts[order], ends[order], pieces[order]


def _sweep(source: np.ndarray, to: np.ndarray, step: np.ndarray, weight: np.ndarray, values: np.ndarray) -> None:
    """values[to] += values[source] * weight, one step after the other; arcs in order of step, then of to."""
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            target = to[a:b]
            begin = np.concatenate(([0], np.flatnonzero(np.diff(target)) + 1))
            values[target[begin]] = np.add.reduceat(values[source[a:b]] * weight[a:b], begin, axis=0)


def _add_logs(source: np.ndarray, to: np.ndarray, step: np.ndarray, weight: np.ndarray, values: np.ndarray) -> None:
    """_sweep on logarithms; what values[to] holds already counts too."""
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            target = to[a:b]
            begin = np.concatenate(([0], np.flatnonzero(np.diff(target)) + 1))
            values[target[begin]] = np.logaddexp(values[target[begin]], np.logaddexp.reduceat(values[source[a:b]] + weight[a:b], begin, axis=0))


def plain_chars(chances: np.ndarray) -> int:
    """Characters of the longest words whose products can't underflow, PLAIN_CHARS at most."""
    return min(PLAIN_CHARS, int(290 / max(1e-9, -math.log10(chances.min()))) - 1)


def batches_of(words: Sequence[str], most: int) -> Iterator[tuple[np.ndarray, str]]:
    """(rows of words, how they are summed: plain up to most characters, logs or parts) with bounded arcs each."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    plain = np.flatnonzero(sizes <= most)
    for k in range(0, len(plain), ARC_WORDS):
        yield plain[k : k + ARC_WORDS], "plain"
    long = np.flatnonzero((sizes > most) & (sizes <= ARC_CHARS))
    long = long[np.argsort(sizes[long], kind="stable")]
    bins = np.cumsum(sizes[long]) // ARC_CHARS
    for rows in np.split(long, np.flatnonzero(np.diff(bins)) + 1):
        if len(rows):
            yield rows, "logs"
    for k in np.flatnonzero(sizes > ARC_CHARS):
        yield np.array([k]), "parts"


def _parts(pieces: Pieces, word: str, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, ends, pieces) of the arcs that end in each part of a word, by end."""
    text = MARK + word
    bounds = range(0, len(text), ARC_CHARS)
    for s in reversed(bounds) if backwards else bounds:
        e, off = min(len(text), s + ARC_CHARS), max(0, s - pieces.longest)
        found = [(off + end + 1, k, n) for end, (k, n) in pieces.automaton.iter(text[off:e]) if off + end >= s]
        table = np.array(found, np.int64).reshape(-1, 3)
        ends, which, sizes = table.T
        bare = np.setdiff1d(np.arange(s + 1, e + 1), ends[sizes == 1])
        starts, ends = np.concatenate((ends - sizes, bare - 1)), np.concatenate((ends, bare))
        which = np.concatenate((which, np.full(len(bare), pieces.count - 1)))
        order = np.argsort(ends, kind="stable")
        yield starts[order], ends[order], which[order]


def _forward_parts(pieces: Pieces, word: str, logs: np.ndarray) -> np.ndarray:
    alpha = np.full((len(word) + 2, logs.shape[1]), -np.inf)
    alpha[0] = 0
    for starts, ends, which in _parts(pieces, word):
        _add_logs(starts, ends, ends, logs[which], alpha)
    return alpha


def forward(pieces: Pieces, words: Sequence[str], chances: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability in each language, over all segmentations."""
    out, logs = np.zeros((len(words), chances.shape[1])), np.log(chances)
    for rows, way in batches_of(words, plain_chars(chances)):
        some = [words[k] for k in rows.tolist()]
        if way == "parts":
            out[rows] = _forward_parts(pieces, some[0], logs)[-1]
            continue
        firsts, starts, ends, which = pieces.arcs(some)
        last = firsts + np.fromiter(map(len, some), np.int64, len(some)) + 1
        if way == "plain":
            alpha = np.zeros((int(last.max()) + 1, chances.shape[1]))
            alpha[firsts] = 1
            _sweep(starts, ends, pieces.places, chances[which], alpha)
            out[rows] = np.log(alpha[last])
        else:
            alpha = np.full((int(last.max()) + 1, chances.shape[1]), -np.inf)
            alpha[firsts] = 0
            _add_logs(starts, ends, pieces.places, logs[which], alpha)
            out[rows] = alpha[last]
    return out


def fit(pieces: Pieces, words: list[str], counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (piece x language) from word counts (word x language)."""
    n_langs = counts.shape[1]
    chances = np.full((pieces.count, n_langs), 1 / pieces.count)
    for _ in range(rounds):
        sums = np.full((pieces.count, n_langs), SMOOTHING)
        for rows, way in batches_of(words, plain_chars(chances)):
            {"plain": _expect, "logs": _expect_logs, "parts": _expect_parts}[way](pieces, [words[k] for k in rows.tolist()], counts[rows], chances, sums)
        chances = sums / sums.sum(axis=0)
    return chances


def _expect_logs(pieces: Pieces, words: list[str], counts: np.ndarray, chances: np.ndarray, sums: np.ndarray) -> None:
    """_expect for words whose products underflow."""
    firsts, starts, ends, which = pieces.arcs(words)
    last = firsts + np.fromiter(map(len, words), np.int64, len(words)) + 1
    word_of = np.searchsorted(firsts, ends - 1, side="right") - 1
    to_end = last[word_of] - starts
    back = np.lexsort((starts, to_end))
    weight = np.log(chances)[which]
    alpha, beta = (np.full((int(last[-1]) + 1, chances.shape[1]), -np.inf) for _ in range(2))
    alpha[firsts], beta[last] = 0, 0
    _add_logs(starts, ends, pieces.places, weight, alpha)
    _add_logs(ends[back], starts[back], to_end[back], weight[back], beta)
    expected = np.exp(alpha[starts] + weight + beta[ends] - alpha[last][word_of]) * counts[word_of]
    for j in range(chances.shape[1]):
        sums[:, j] += np.bincount(which, expected[:, j], pieces.count)


def _expect_parts(pieces: Pieces, words: list[str], counts: np.ndarray, chances: np.ndarray, sums: np.ndarray) -> None:
    """_expect for one word with the arcs of a part of it at a time, from its end."""
    logs, word = np.log(chances), words[0]
    alpha = _forward_parts(pieces, word, logs)
    beta = np.full_like(alpha, -np.inf)
    beta[-1] = 0
    for starts, ends, which in _parts(pieces, word, backwards=True):  # adds to beta before the part too, where more follows
        back = np.lexsort((ends, -starts))
        starts, ends, which = starts[back], ends[back], which[back]
        _add_logs(ends, starts, -starts, logs[which], beta)
        expected = np.exp(alpha[starts] + logs[which] + beta[ends] - alpha[-1]) * counts
        for j in range(chances.shape[1]):
            sums[:, j] += np.bincount(which, expected[:, j], pieces.count)


def _expect(pieces: Pieces, words: list[str], counts: np.ndarray, chances: np.ndarray, sums: np.ndarray) -> None:
    """Add to sums how often each piece is expected in words that occur counts times."""
    firsts, starts, ends, which = pieces.arcs(words)
    last = firsts + np.fromiter(map(len, words), np.int64, len(words)) + 1
    word_of = np.searchsorted(firsts, ends - 1, side="right") - 1
    to_end = last[word_of] - starts
    back = np.lexsort((starts, to_end))
    weight = chances[which]
    alpha, beta = (np.zeros((int(last[-1]) + 1, chances.shape[1])) for _ in range(2))
    alpha[firsts], beta[last] = 1, 1
    _sweep(starts, ends, pieces.places, weight, alpha)
    _sweep(ends[back], starts[back], to_end[back], weight[back], beta)
    expected = alpha[starts] * weight * beta[ends] * (counts / alpha[last])[word_of]
    for j in range(chances.shape[1]):
        sums[:, j] += np.bincount(which, expected[:, j], pieces.count)


def cores(column: pa.Array) -> tuple[Words, np.ndarray, list[str]]:
    """The texts' words, and for each distinct one its core's row in a list of distinct cores."""
    words = Words(pc.utf8_lower(plain_strings(column)))
    encoded = pc.utf8_trim(words.uniq, characters=ENDS).dictionary_encode()
    return words, np.asarray(encoded.indices, np.int64), encoded.dictionary.to_pylist()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch):
            words, code, strings = cores(rows.column("text"))
            langs = rows.column("lang").dictionary_encode()
            lang = np.repeat(np.asarray(langs.indices, np.int64), np.diff(words.offsets))
            pair, n = np.unique(lang * len(strings) + code[words.codes], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(pair // max(1, len(strings)))), pa.array(strings, pa.string()).take(pa.array(pair % max(1, len(strings)))), pa.array(n)],
                names=["lang", "word", "n"],
            )


def may_learn() -> str:
    """The rows that a model may learn from, as SQL."""
    return "lang is not null and text is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 4) != 2"


class Model:
    def __init__(self, langs: list[str], vocabulary: str, chances: np.ndarray):
        self.langs, self.vocabulary, self.chances, self.key = langs, vocabulary, chances, uuid.uuid4().hex


def train(docs: DataFrame, vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on about sample_docs documents of each language that may be learnt from."""
    vocabulary = vocabulary or default_vocabulary()
    usable = docs.select("doc_id", "text", "lang").filter(may_learn())
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], vocabulary, np.zeros((0, 0)))
    rates = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1_000_000, math.ceil(1_000_000 * sample_docs / sizes[k])))])
    sample = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000)) < F.element_at(rates, F.col("lang")))
    counted = map_arrow(sample.select("text", "lang"), _count_words, "lang string, word string, n long")
    counted = counted.filter("word != ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    cells = counted.toArrow()  # the distinct words of about sample_docs documents of each language, in one job
    if not cells.num_rows:
        return Model([], vocabulary, np.zeros((0, 0)))
    words = cells.column("word").combine_chunks().dictionary_encode()
    counts = np.zeros((len(words.dictionary), len(langs)))
    counts[np.asarray(words.indices), np.searchsorted(np.array(langs, object), cells.column("lang").to_pylist())] = cells.column("n").to_numpy()
    order = np.argsort(np.array(words.dictionary.to_pylist(), object))
    return Model(langs, vocabulary, fit(Pieces(vocabulary), words.dictionary.take(pa.array(order)).to_pylist(), counts[order]))


def _scorer(model: Model) -> WordStore:
    def make() -> WordStore:
        pieces = Pieces(model.vocabulary)
        return WordStore(STORE_WORDS, len(model.langs), lambda words: forward(pieces, words, model.chances))

    return kept(("langid", model.key), make)


def predict(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(language or und, posterior probability under equal shares) of each text."""
    letters = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False))
    if not model.langs or not len(column):
        return np.full(len(column), "und", object), np.zeros(len(column))
    words, code, strings = cores(column)
    logs = words.per_text(_scorer(model).get(strings)[code]) if len(strings) else np.zeros((len(column), len(model.langs)))
    best = logs.argmax(axis=1)
    share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
    return np.where(letters, np.array(model.langs, object)[best], "und"), np.where(letters, share, 0.0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; only text is an input of the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces of the vocabulary x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, limit=PREDICT_BYTES):
                lang, score = predict(shared.value, rows.column("text"))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    held_out = F.expr("coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, false)")
    return map_arrow(docs.select("doc_id", "text", held_out.alias("held_out")), run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs without those that have no letter or a score below least_score; all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch, limit=PREDICT_BYTES):
                _, score = predict(shared.value, rows.column("text"))
                good = rows.filter(pa.array(score >= least_score))
                if good.num_rows:
                    yield good

    return map_arrow(docs, run, docs.schema)
