"""The whole pipeline against a brute-force version of every stage, and its stages on odd tables."""

import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from samplight.llm import langid, packing
from samplight.llm.common import free_names, stage
from samplight.llm.tokens import default_vocabulary, library_encoder

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import WORDS, _lower, brute_quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lost_id string, same_group string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    letters = {"en": "etaoinshrdlu", "de": "äöüßkzwgpfbm"}
    words = {k: ["".join(r.choice(v) for _ in range(r.randrange(3, 9))) for _ in range(90)] for k, v in letters.items()}
    prose = lambda k, n: " ".join(r.choice(words[k]) + ("." if j % 9 == 8 else "") for j in range(n))
    texts = [(prose(k, r.randrange(70, 140)), k) for _ in range(14) for k in letters]
    texts += [(texts[j][0].replace(" ", "\n\t", 3), texts[j][1]) for j in range(4)]  # exact copies
    for j in range(4, 9):  # near copies
        w = texts[j][0].split()
        w[len(w) // 2] = "changed"
        texts.append((" ".join(w), texts[j][1]))
    texts += [("### $$$ " * 60 + prose("en", 60), "en"), (prose("en", 20), "en"), ("so so " * 60, "en"), ("12 !? 34 " * 40, "en"), ("", "de"), (None, "de"), (prose("de", 90), None)]
    texts += [("| ".join(prose("de", 80).split()), "de"), (prose("en", 2500), "en")]
    out = [(i, t, k, "s", 1, "x", "y") for i, (t, k) in enumerate(texts)]
    return [*out, out[2], out[2], (None, texts[5][0], "de", "s", 1, "x", "y"), (None, prose("en", 100), "en", "s", 1, "x", "y"), (None, prose("en", 101), None, None, None, None, None)]


def _arcs(index, count, longest, word):
    text = langid.MARK + word
    found = [(a, b, index[text[a:b]][0]) for b in range(1, len(text) + 1) for a in range(max(0, b - longest), b) if text[a:b] in index]
    covered = {b for a, b, _ in found if b - a == 1}
    return len(text), found + [(b - 1, b, count - 1) for b in range(1, len(text) + 1) if b not in covered]


def brute_langid(rows):
    """Whether each row is identified: probabilities of pieces by expectation-maximisation word by word."""
    pieces = langid.Pieces(langid.default_vocabulary())
    index, n = dict(pieces.automaton.items()), pieces.count
    cores = lambda t: [w.strip(langid.ENDS) for w in WORDS.findall((t or "").lower())]
    counts: dict[str, Counter] = defaultdict(Counter)
    for i, t, lang, *_ in rows:
        if lang is not None and t is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[lang].update(w for w in cores(t) if w)
    arcs = {w: _arcs(index, n, pieces.longest, w) for w in {w for _, t, *_ in rows for w in cores(t)}}

    def forward(word, p):
        size, found = arcs[word]
        alpha = [1.0] + [0.0] * size
        for a, b, k in sorted(found, key=lambda x: x[1]):
            alpha[b] += alpha[a] * p[k]
        return alpha

    model = {}
    for lang, words in counts.items():
        p = np.full(n, 1 / n)
        for _ in range(langid.ROUNDS):
            sums = np.full(n, langid.SMOOTHING)
            for w, c in words.items():
                size, found = arcs[w]
                alpha, beta = forward(w, p), [0.0] * size + [1.0]
                for a, b, k in sorted(found, key=lambda x: -x[0]):
                    beta[a] += beta[b] * p[k]
                for a, b, k in found:
                    sums[k] += c * alpha[a] * p[k] * beta[b] / alpha[-1]
            p = sums / sums.sum()
        model[lang] = p
    out = []
    for _, t, *_ in rows:
        logs = [sum(math.log(forward(w, p)[-1]) for w in cores(t)) for p in model.values()]
        share = 1 / sum(math.exp(x - max(logs)) for x in logs)
        out.append(any(c.isalpha() for c in t or "") and share >= langid.LEAST_SCORE)
    return out


def _order(row):
    return (row[0] is None, row[0] or 0)


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", r[1] or "")].append(r)
    return [min(g, key=_order) for g in groups.values()]


def brute_near(rows):
    sets = []
    for r in rows:
        w = WORDS.findall(_lower(r[1]))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    members = defaultdict(list)
    for r, g in zip(rows, group, strict=True):
        members[g].append(r)
    return [min(g, key=_order) for g in members.values()]


def brute_pack(rows):
    tokenizer = library_encoder(default_vocabulary()).tokenizer
    pieces = []
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, packing.END_ID]
        for k in range(0, len(ids), packing.WIDTH):
            part = ids[k : k + packing.WIDTH]
            pieces.append((r[0], k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    room, out = [], []
    for p in sorted(pieces, key=lambda p: (-p[2], _order(p), p[1], p[3])):
        bin_ = next((k for k, x in enumerate(room) if x >= p[2]), len(room))
        if bin_ == len(room):
            room.append(packing.WIDTH)
        out.append((*p, bin_, packing.WIDTH - room[bin_]))
        room[bin_] -= p[2]
    return out


def brute_pipeline(rows):
    rows = [r for r, good in zip(rows, brute_langid(rows), strict=True) if good]
    rows = [r for r, (_, kept) in zip(rows, brute_quality([r[1] for r in rows]), strict=True) if kept]
    return brute_pack(brute_near(brute_exact(rows)))


def _key(row):
    return tuple((x is None, x or 0) for x in row)


def test_pipeline_against_brute_force(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    want = brute_pipeline(rows)
    assert 20 < len({r[0] for r in want}) < len({r[0] for r in rows}) - 10
    assert sorted(got, key=_key) == sorted(want, key=_key)


def test_stages_keep_columns_and_take_odd_tables(spark, rows, tmp_path):
    tables = {
        "all": spark.createDataFrame(rows, SCHEMA),
        "empty": spark.createDataFrame([], SCHEMA),
        "nulls": spark.createDataFrame([(None,) * 7] * 3, SCHEMA),
        "long": spark.createDataFrame([(1, " ".join(f"word{i % 7000}." for i in range(200_000)), "en", None, None, None, None)] * 2, SCHEMA),
    }
    for name, docs in tables.items():
        docs = stage(docs, "odd")
        for label, function in corpus_pipeline.STAGES[:-1]:
            out = stage(function(spark, docs, str(tmp_path)), label)
            assert out.schema == docs.schema, (name, label)
            assert out.count() <= docs.count()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.agg({"length": "sum"}).first()[0] == (None if name == "empty" else packed.filter("start = 0").agg({"doc_tokens": "sum"}).first()[0])


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, LOST_ID string")
    assert free_names(docs, "lost_id", "lost_id_", "other") == ["lost_id_", "lost_id__", "other"]
