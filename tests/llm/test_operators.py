"""Each operator against a brute-force version, with nulls, empty and odd texts, repeated rows, extra columns and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from samplight.llm import bpe, exact_dedup, langid, minhash, packing, ppm, quality, sharding, token_files, toxicity
from samplight.llm.tokens import default_vocabulary, library_encoder

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, size string, kept string"


def _texts() -> list[str | None]:
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(60, 200))) for _ in range(12)]
    near = []
    for b in base[:6]:
        for _ in range(6):
            w = b.split()
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    odd = [None, "", " \n\t ", "one", "One two\x0bthree", "x  y", "x\ny", "<|endoftext|> İstanbul ẖ 漢字 '12's!?", "a b " * 3000, " ".join(r.choice(vocabulary) for _ in range(20000))]
    return base + near + base[:4] + odd


@pytest.fixture(scope="module")
def rows():
    texts = _texts()
    return [(i, t, "en" if i % 2 else "de", "s", "k") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", "k"), (3, texts[3], "en", "s", "k")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, rows, percent):
    sets = {}
    for i, t, *_ in rows:
        w = WORDS.findall(_lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    got = minhash.near_duplicates(docs, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == sorted((i, len(sets[i]), group[i], group[i] == i) for i, *_ in rows)


def test_near_duplicates_in_many_blocks(docs, monkeypatch):
    want = sorted(r["component_id"] for r in minhash.near_duplicates(docs, 85).collect())
    monkeypatch.setattr(minhash, "BLOCK", 2)
    assert sorted(r["component_id"] for r in minhash.near_duplicates(docs, 85).collect()) == want


def test_exact_dedup(docs, rows):
    norm = {i: re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for i, t, *_ in rows}
    groups = Counter(norm[i] for i, *_ in rows)
    keep = {n: min(i for i in norm if norm[i] == n) for n in groups}
    want = sorted((i, keep[norm[i]], groups[norm[i]], keep[norm[i]] == i, hashlib.sha256(norm[i].encode()).hexdigest()) for i, *_ in rows)
    got = exact_dedup.exact_dedup(docs).drop("text_hash").collect()
    assert sorted(map(tuple, got)) == want
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns
    assert {r["doc_id"] for r in exact_dedup.drop_exact_copies(docs).collect()} == set(keep.values())


def test_dedup_leaves_one_row_of_each_group(spark):
    r = random.Random(8)
    a, b, c, d = (" ".join(f"w{r.randrange(900)}" for _ in range(120)) for _ in range(4))
    rows = [(1, a, "y"), (1, a, "x"), (1, a.replace(" ", "  "), "z"), (2, a, "x"), (None, b, "x"), (None, b, "y"), (None, c, "x"), (7, c, "x"), (9, d, "x"), (9, "other", "x"), (None, None, "n"), (None, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = exact_dedup.drop_exact_copies(docs).collect()
    assert sorted((x["doc_id"] or -1, " ".join((x["text"] or "").split())) for x in got) == sorted([(1, a), (7, c), (9, "other"), (9, d), (-1, ""), (-1, b)])
    near = spark.createDataFrame([(None, a + " end", "x"), (3, a, "x"), (3, a, "y"), (3, a, "y"), (None, b, "x"), (None, b, "x"), (None, c, "x")], docs.schema)
    out = minhash.keep_representatives(near, 80).collect()
    assert sorted((x["doc_id"] or -1, x["text"]) for x in out) == sorted([(3, a), (-1, b), (-1, c)])
    assert minhash.keep_representatives(near, 80).columns == docs.columns


def _library_ids(rows):
    t = library_encoder(default_vocabulary()).tokenizer
    return [e.ids for e in t.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]


def test_token_files(docs, rows, spark, tmp_path):
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    ids = [x + [2] for x in _library_ids(rows)]
    starts = np.cumsum([0] + [len(ids[k]) for k in order])
    want = sorted((rows[k][0], int(s), len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes())) for k, s in zip(order, starts, strict=False))
    token_files.write_token_files(docs, str(tmp_path / "t"), block_ids=3000)
    assert sorted(map(tuple, token_files.read_token_files(spark, str(tmp_path / "t")).collect())) == want
    flat = np.concatenate([ids[k] for k in order])
    files = token_files.TokenFiles(spark, str(tmp_path / "t"))
    at = [0, 1, len(flat) - 1, *random.Random(4).sample(range(len(flat)), 200)]
    assert [files.token_at(i) for i in at] == flat[at].tolist()
    before = files.bytes_read
    for i in at:
        files.token_at(i)
    assert files.bytes_read - before < 100 * len(at)  # every file's footer and every block's head were read before
    for i in (-1, len(flat)):
        with pytest.raises(IndexError):
            files.token_at(i)


def test_addressable_codes():
    r = np.random.default_rng(1)
    for ids in (r.integers(0, 2**k, 5000, dtype=np.uint32) for k in (1, 8, 9, 17, 32)):
        block = token_files.dac_encode(ids)
        reader, ranges = token_files.DacReader(block), token_files.DacRanges(lambda at, n: block[at : at + n])  # noqa: B023
        assert all(ranges[i] == ids[i] for i in range(0, 5000, 7))
        assert (reader.all() == ids).all() and all(reader[i] == ids[i] for i in (0, 1, 511, 512, 4095, 4999))
    assert len(token_files.DacReader(token_files.dac_encode(np.zeros(0, np.uint32)))) == 0


def test_packing(docs, rows):
    ids = {r[0]: x + [1] for r, x in zip(rows, _library_ids(rows), strict=True)}
    got = packing.pack(docs, width=256, group_pieces=50).collect()
    fill = Counter()
    for r in got:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 256 and sum(fill.values()) == sum(len(ids[r[0]]) for r in rows)


def test_bpe_against_the_library():
    coder, library = bpe.text_coder(default_vocabulary()), library_encoder(default_vocabulary())
    r = random.Random(5)
    alphabet = "abcXYZ 's'tT.,!?\n\t\x0b\x85 éÉñüßİǰẖ ́12٣Ⅷ漢<|endoftext|>-_$%&#*|\x1c\x00"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(1500)] + _texts() + ["<|ENDOFTEXT|> <|endoftext|>"]
    for encoder in (bpe.text_coder(default_vocabulary()), library):
        ids, offsets = encoder.batch(pa.array(texts))
        want = [e.ids for e in library.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want
    assert all(coder.decode(x) == library.tokenizer.decode(x, skip_special_tokens=False) for x in want)


def test_bpe_digests(docs, rows):
    t = library_encoder(default_vocabulary()).tokenizer
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((r[0], len(x), sha(" ".join(map(str, x))), sha(t.decode(x, skip_special_tokens=False))) for r, x in zip(rows, _library_ids(rows), strict=True))
    assert sorted(map(tuple, bpe.encode_and_decode(docs).collect())) == want


@pytest.mark.parametrize(("block", "group", "merge"), [(ppm.BLOCK_BYTES, ppm.GROUP_BLOCKS, ppm.MERGE), (20_000, 3, 1000)])
def test_lm_score(docs, rows, empty, monkeypatch, block, group, merge):
    for name, value in (("BLOCK_BYTES", block), ("GROUP_BLOCKS", group), ("MERGE", merge)):
        monkeypatch.setattr(ppm, name, value)
    order = ppm.ORDER
    tokens = [[*WORDS.findall(_lower(t)), "\n"] for _, t, *_ in rows]
    texts = [b"\n" * order + b"".join(w.encode() + b" " for w in t[:-1]) + b"\n" for t in tokens]
    held = [zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    words = Counter(x for t, h in zip(tokens, held, strict=True) if not h for x in t)
    n, v = sum(words.values()), len(words)
    counts: dict[bytes, Counter] = {}
    for s, h in zip(texts, held, strict=True):
        for k in range(order, len(s) if not h else 0):
            for j in range(order + 1):
                counts.setdefault(s[k - j : k], Counter())[s[k]] += 1
    memory: dict[bytes, list[float]] = {}

    def chances(context: bytes) -> list[float]:
        if context not in memory:
            low = chances(context[1:]) if context else [1 / 256] * 256
            here = counts.get(context)
            if here:
                total, distinct = sum(here.values()), len(here)
                rest = 1 - sum(low[s] for s in here)
                low = [here[s] / (total + distinct) if s in here else distinct / (total + distinct) * x / rest for s, x in enumerate(low)]
                assert sum(low) == pytest.approx(1)
            memory[context] = low
        return memory[context]

    got = ppm.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        k = next(k for k, x in enumerate(rows) if x[0] == r["doc_id"])
        s, t = texts[k], tokens[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(t), sum(words[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert r["score"] == pytest.approx(sum(math.log10(chances(s[j - order : j])[s[j]]) for j in range(order, len(s))), rel=1e-4)
    assert ppm.score(empty).collect() == []


def test_lm_score_without_training(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    docs = spark.createDataFrame([(i, t) for i, t in zip(ids, ("a b", None, "x"), strict=True)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ppm.score(docs).collect()}
    assert [got[i]["score"] for i in ids] == pytest.approx([math.log10(1 / 256) * k for k in (5, 1, 3)], rel=1e-5)
    assert {r["train_tokens"] for r in got.values()} == {0}


def test_op6_scores_texts_by_the_order_of_their_words(spark, tmp_path):
    from samplight.llm.queries import QUERIES

    phrase = "the quick brown fox jumps over a lazy dog".split()
    mixed = phrase[::2] + phrase[1::2]
    texts = [" ".join(phrase)] * 40 + [" ".join(mixed)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    score = {r["doc_id"]: r["score"] for r in QUERIES["op6_lm_score"](spark, str(tmp_path)).collect()}
    assert score[0] > score[40] + 1


def test_quality_statistics(docs, rows):
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for i, t, *_ in rows:
        w = WORDS.findall(t or "")
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(windows)
        covered = {j for k, x in enumerate(windows) if often[x] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_windows_of_very_long_texts(spark, tmp_path):
    n = 3_000_000
    docs = spark.createDataFrame([(1, 0), (2, 5)], "doc_id long, again int")
    docs = docs.selectExpr("doc_id", f"concat_ws(' ', transform(sequence(0, {n - 1} + again), i -> hex(i % {n}))) as text")
    docs.write.parquet(str(tmp_path / "long"))
    docs = spark.read.parquet(str(tmp_path / "long"))
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.statistics(docs).collect()}
    assert got == {1: 0, 2: 10}  # five words again at the end: three windows, twice


def _share(text, pattern):
    return len(re.findall(pattern, text))


def _votes(text):
    """Votes by the rules' plain reading."""
    import regex

    w = WORDS.findall(text or "")
    n, joined = max(1, len(w)), "".join(w)
    windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    often = Counter(windows)
    covered = len({j for k, x in enumerate(windows) if often[x] > 1 for j in (k, k + 1, k + 2)})
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    chars = max(1, len(joined))
    values = {
        "symbols": _share(joined, r"[#*$%&|<>]") / n, "marked_words": _share(text or "", r"[#*$%&|<>]+") / n, "letters": -len(regex.findall(r"\p{L}", joined)) / chars,
        "capitals": len(regex.findall(r"\p{Lu}", joined)) / chars, "exclaiming": _share(joined, "!") / n, "repeated_windows": covered / n,
        "repeated_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "long_words": len(joined) / n, "short_words": -len(joined) / n,
        "distinct_words": -sum(len(set(w[k : k + 200])) for k in range(0, len(w), 200)) / n, "sentences": -_share(joined, "[.?!]") / n,
    }
    failed = len(w) < 50 or 100 * covered > 50 * len(w)
    return tuple(1 if x <= quality.RULES[k][1] else -1 if x > quality.RULES[k][2] else 0 for k, x in values.items()), failed


def brute_quality(texts):
    """(p_good, kept) of each text, by expectation-maximisation document by document."""
    voted = [_votes(t) for t in texts]
    used = [v for v, failed in voted if not failed]
    rules = range(len(quality.RULES))
    accuracy, prior = [quality.START[:2] for _ in rules], quality.START[2]

    def p_good(v):
        odds = math.log(prior / (1 - prior))
        for k in rules:
            g, b = accuracy[k]
            odds += {1: math.log(g / (1 - b)), -1: math.log((1 - g) / b), 0: 0.0}[v[k]]
        return 1 / (1 + math.exp(-odds))

    for _ in range(quality.ROUNDS if used else 0):
        p = [p_good(v) for v in used]
        extra = quality.PRIOR_SHARE * len(used)
        new = []
        for k in rules:
            yes, no = (sum(x for v, x in zip(used, p, strict=True) if v[k] == s) for s in (1, -1))
            wrong, right = (sum(1 - x for v, x in zip(used, p, strict=True) if v[k] == s) for s in (1, -1))
            new.append(((yes + quality.START[0] * extra) / (yes + no + extra), (right + quality.START[1] * extra) / (right + wrong + extra)))
        accuracy, prior = new, (sum(p) + quality.START[2] * extra) / (len(used) + extra)
    return [(x := p_good(v), not failed and x >= 0.5) for v, failed in voted]


def test_quality_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows += [(-1, None), (-2, ""), (-3, rows[0]["text"])]
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
    want = brute_quality([r[1] for r in rows])
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for r, (p, kept) in zip(rows, want, strict=True):
        assert got[r[0]]["p_good"] == pytest.approx(p, abs=1e-3) and got[r[0]]["kept"] == kept


def test_quality_is_learnt_and_more_than_all_rules_passing(spark):
    d = "/root/testdata/sf0.01"
    voted = quality.stage(quality.votes(quality.statistics(spark.read.parquet(f"{d}/documents.parquet"))), "votes")
    accuracy, prior = quality.estimate(voted)
    assert len({round(a, 3) for a in sum(accuracy.values(), ())}) > 6 and 0.8 < prior < 0.99
    assert all(quality.START[:2] != a and 0 < a[0] < 1 and 0 < a[1] < 1 for a in accuracy.values())
    rows = voted.withColumn("kept", quality.verdict(accuracy, prior)).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    passing = lambda r: all(r[f"v_{k}"] >= 0 for k in quality.RULES)
    assert any(r["kept"] and not passing(r) for r in rows)
    assert sum(r["kept"] for r in rows if r["quality"] == 1) >= 0.99 * sum(r["quality"] == 1 for r in rows)
    assert sum(r["kept"] for r in rows if r["quality"] == 0) <= 0.1 * sum(r["quality"] == 0 for r in rows)


def test_quality_reads_distinct_words_of_whole_texts(spark):
    r = random.Random(11)
    clean = [f"word{r.randrange(3000)}" for _ in range(4000)]
    poor = [f"w{r.randrange(15)}" for _ in range(4000)]
    texts = {1: clean[:200] + poor, 2: poor[:200] + clean, 3: clean, 4: poor, 5: clean[:150], 6: []}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.votes(quality.statistics(docs)).collect()}
    for i, w in texts.items():
        assert got[i]["n_distinct"] == sum(len(set(w[k : k + 200])) for k in range(0, len(w), 200))
    assert {i: got[i]["v_distinct_words"] for i in range(1, 6)} == {1: -1, 2: 1, 3: 1, 4: -1, 5: 1}


def test_sharding(docs, rows):
    got = sharding.shard_by_bytes(docs, 5).collect()
    by_shard: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        by_shard.setdefault(r["shard"], []).append(r)
    order = [r for k in sorted(by_shard) for r in by_shard[k]]
    assert [r["doc_id"] for r in order] == sorted(r[0] for r in rows)
    assert all([r["slot"] for r in x] == list(range(len(x))) for x in by_shard.values())
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in got)
    largest = max(r["size"] for r in got)
    assert all(sum(r["size"] for r in x) <= sum(r["size"] for r in got) / 5 + largest for x in by_shard.values())


def test_langid_sums_all_segmentations():
    pieces = langid.Pieces(langid.default_vocabulary())
    chances = np.random.default_rng(2).random((pieces.count, 2))
    word = "thing"
    text = langid.MARK + word
    index = dict((k, n) for k, n in pieces.automaton.items())
    total = np.zeros(2)

    def walk(at, p):
        nonlocal total
        if at == len(text):
            total = total + p
        for j in range(at + 1, len(text) + 1):
            if text[at:j] in index:
                walk(j, p * chances[index[text[at:j]][0]])

    walk(0, np.ones(2))
    assert np.allclose(langid.forward(pieces, [word], chances)[0], np.log(total))


def test_langid_sums_whole_long_words(monkeypatch):
    pieces = langid.Pieces(langid.default_vocabulary())
    chances = np.random.default_rng(2).random((pieces.count, 2)) / 1000
    index = dict((k, n) for k, n in pieces.automaton.items())
    longest = max(map(len, index))
    words = ["thing", "interpretation" * 6, "https://example.org/under/standing?of=things" * 30, "漢字かな交じり文" * 20, "x" * 32, "internationalisation" * 2, "a"]

    def total(word):
        text, logs = langid.MARK + word, np.full((len(word) + 2, 2), -np.inf)
        logs[0] = 0
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - longest), end):
                piece = text[start:end]
                k = index[piece][0] if piece in index else pieces.count - 1 if len(piece) == 1 else None
                if k is not None:
                    logs[end] = np.logaddexp(logs[end], logs[start] + np.log(chances[k]))
        return logs[-1]

    want = [total(w) for w in words]
    assert np.allclose(langid.forward(pieces, words, chances), want)
    short, counts = [w for w in words if len(w) <= 90], np.arange(1.0, 11).reshape(5, 2)
    plain = np.zeros((pieces.count, 2))
    langid._expect(pieces, short, counts, chances, plain)
    for chars in (langid.ARC_CHARS, 50):
        monkeypatch.setattr(langid, "ARC_CHARS", chars)
        assert np.allclose(langid.forward(pieces, words, chances), want)
        got = np.zeros((pieces.count, 2))
        for rows, way in langid.batches_of(short, langid.PLAIN_CHARS):
            {"plain": langid._expect, "logs": langid._expect_logs, "parts": langid._expect_parts}[way](pieces, [short[k] for k in rows], counts[rows], chances, got)
        assert np.allclose(got, plain)


def test_langid_and_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = langid.train(docs, sample_docs=100)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    odd = spark.createDataFrame([(1, None, None), (2, "12 !?", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(odd, model).collect()} == {"und"}


def test_langid_does_not_underflow():
    pieces = langid.Pieces(langid.default_vocabulary())
    chances = np.full((pieces.count, 2), 1e-12)
    chances[:, 1] = 1e-11
    for n in (5, 31, 32, 33):
        got = langid.forward(pieces, ["\u4e00" * n, "a"], chances)
        assert np.isfinite(got).all() and (got[:, 1] > got[:, 0]).all()
    assert langid.plain_chars(chances) < 32 == langid.plain_chars(np.full((2, 2), 1e-3))


def test_toxicity_finds_labelled_documents_that_it_did_not_learn_from(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    learnt = "pmod(xxhash64(doc_id, 99L), 4) != 0"
    model = toxicity.train(docs, labels.filter(learnt))
    rows = toxicity.grade(docs, model).join(labels.filter(f"not ({learnt})").select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    toxic, clean = ([r for r in rows if r["label"] == y] for y in (1, 0))
    assert len(toxic) >= 50 and sum(r["toxic"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["toxic"] for r in clean) <= 0.02 * len(clean)
    assert all((np.diff(model.thresholds) > 0).tolist()) and all(0 <= r["expected_severity"] <= len(model.thresholds) for r in rows)


def test_toxicity_with_labels_that_contradict(spark):
    docs = spark.createDataFrame([(i, "filthy rubbish here" if i % 2 else "clean words here") for i in range(60)] + [(None, "filthy")], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)] + [(0, 1), (1, 0), (None, 1), (5, None), (2, 7)]
    found = [{r["doc_id"]: r["p_toxic"] for r in toxicity.grade(docs, toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int"))).collect()} for x in (labels, labels[::-1])]
    assert found[0] == found[1] and found[0][1] > 0.5 > found[0][0]


def test_langid_fits_on_all_words_of_its_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", lambda pieces, words, counts: seen.append((len(words), counts.sum())) or np.ones((pieces.count, 1)))
    words = ["".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(45_000)]
    langid.train(spark.createDataFrame([(i, " ".join(words[i::3]), "en") for i in range(3)], "doc_id long, text string, lang string"))
    assert seen == [(45_000, 45_000)]


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for run in (
        lambda d: minhash.near_duplicates(d), exact_dedup.exact_dedup, token_files.token_table, packing.pack, bpe.encode_and_decode, ppm.score,
        quality.quality, sharding.shard_by_bytes, lambda d: langid.identify(d, langid.train(d)), lambda d: toxicity.grade(d, toxicity.train(d, labels)),
    ):
        assert run(empty).collect() == []


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, d)
        assert out.columns == docs.columns
    assert corpus_pipeline.run(spark, d).select("doc_id").distinct().count() == out.count()
