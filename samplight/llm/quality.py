"""Quality by weak supervision, in DataFrame functions only.

Each rule looks at one statistic of a text and votes good (1), bad (-1) or
abstains (0). Expectation-maximisation over the counts of vote patterns (three
values a rule, so a table of at most 3**len(RULES) rows, whatever the input)
estimates how often each rule is right on good and on bad documents; the
posterior probability of a good document replaces a list of rules that must
all pass: a bad vote of a rule that is often wrong on good documents is
outweighed by the others. The accuracies have no bounds; a weak prior (as if
PRIOR_SHARE of the documents more had been seen, with the starting values) keeps
what was never seen from counting as impossible. A document with fewer than 50
words, or with more than half of its words in repeated 3-word windows, fails
before any vote.

The thresholds are round values in common use for web text (at most a tenth of
marks a word, four fifths of letters, words of 3 to 10 characters, three tenths
of repeated lines, ...), not fitted to labels.

Words are runs of characters other than ``[\\x20\\x09-\\x0D]``. Distinct words are
counted in each of a text's consecutive windows of SPAN words, the last one
shorter, and summed: over the number of words that is the mean share of
distinct words, weighted by length, which doesn't fall as a text gets longer.

Edge cases: null and empty texts have no words and fail; an empty table gives
an empty result; rows that repeat a document get the same verdict; null doc_ids
are carried. ``keep_good`` carries all other columns untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samplight.llm.common import stage, text_hash, without

SPACE = "[\\x20\\x09-\\x0D]"
MIN_WORDS = 50
#: Words of one window in which distinct words are counted.
SPAN = 200
#: Rule: statistic, good if at most, bad if above (between them it abstains).
#: Negated statistics make "at least" rules.
RULES: dict[str, tuple[str, float, float]] = {
    "symbols": ("n_symbols / n_words", 0.02, 0.10),
    "marked_words": ("n_marks / n_words", 0.02, 0.10),
    "letters": ("-n_letters / greatest(word_chars, 1)", -0.90, -0.80),
    "capitals": ("n_capitals / greatest(word_chars, 1)", 0.10, 0.30),
    "exclaiming": ("n_exclaiming / n_words", 0.02, 0.10),
    "repeated_windows": ("n_repeat_words / n_words", 0.05, 0.18),
    "repeated_lines": ("n_dup_lines / greatest(n_lines, 1)", 0.05, 0.30),
    "long_words": ("word_chars / n_words", 8.0, 10.0),
    "short_words": ("-word_chars / n_words", -4.0, -3.0),
    "distinct_words": ("-n_distinct / n_words", -0.50, -0.30),
    "sentences": ("-n_stops / n_words", -0.03, -0.01),
}
#: Where expectation-maximisation starts: right on good and on bad documents, and the share of good ones.
START = (0.95, 0.30, 0.85)
#: Weight of the starting values, as a share of the documents.
PRIOR_SHARE = 0.01
ROUNDS = 60
TOLERANCE = 1e-5


def _without(text: str, pattern: str) -> str:
    return f"cast(length({text}) - length(regexp_replace({text}, '{pattern}', '')) as long)"


def _twice(t: DataFrame, n: str, at: str, words: str) -> DataFrame:
    """t with the positions p of those of n windows whose hash another one has too; at is the position of window j."""
    t = t.withColumn("bits", F.expr(f"coalesce(cast(ceil(log2({n} + 1)) as int), 0)"))
    hashed = f"xxhash64({words.replace('@', at)})"
    t = t.withColumn("k", F.expr(f"if({n} < 2, cast(array() as array<bigint>), sort_array(transform(sequence(0, {n} - 1), j -> coalesce(shiftleft({hashed}, bits) | cast(j as bigint), 0L))))"))
    same = "shiftright(get(k, j), bits) = shiftright(get(k, j - 1), bits) or shiftright(get(k, j), bits) = shiftright(get(k, j + 1), bits)"
    found = "cast(get(k, j) & (shiftleft(1L, bits) - 1L) as int)"
    place = found if at == "j" else f"get(p, {found})"
    return t.withColumn("p", F.expr(f"if(size(k) = 0, cast(array() as array<int>), transform(filter(sequence(0, size(k) - 1), j -> {same}), j -> {place}))")).drop("k", "bits")


def statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, the counts that the rules read, and the columns carried; no shuffle.

    Repeated windows: hashes of all 3-word windows are sorted with their
    positions in the low bits, and equal neighbours give the positions of windows
    that may occur twice. As the low bits cost hash bits in very long texts, those
    go through the same with a second hash. Gaps between the positions give the
    words covered.
    """
    t = docs.select("doc_id", *carried, F.coalesce("text", F.lit("")).alias("t"))
    t = t.withColumn("b", F.expr("btrim(t, ' \\t\\n\\u000b\\u000c\\r')"))
    t = t.withColumn("w", F.expr(f"if(b = '', cast(array() as array<string>), split(b, r'{SPACE}+'))"))
    t = t.withColumn("lines", F.expr("filter(split(t, '\\n'), x -> btrim(x, ' \\t\\n\\u000b\\u000c\\r') != '')"))
    t = t.select(
        "doc_id", *carried, "w",
        F.size("w").cast("long").alias("n_words"),
        F.expr(f"cast(length(regexp_replace(b, r'{SPACE}+', '')) as long)").alias("word_chars"),
        F.expr(_without("b", "[#*$%&|<>]+")).alias("n_symbols"),
        F.expr("cast(regexp_count(b, '[#*$%&|<>]+') as long)").alias("n_marks"),
        F.expr("cast(length(regexp_replace(b, '[^\\\\p{L}]+', '')) as long)").alias("n_letters"),
        F.expr(_without("b", "\\\\p{Lu}+")).alias("n_capitals"),
        F.expr(_without("b", "!+")).alias("n_exclaiming"),
        F.expr(_without("b", "[.?!]+")).alias("n_stops"),
        F.size("lines").cast("long").alias("n_lines"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as long)").alias("n_dup_lines"),
        F.expr(f"if(b = '', 0L, aggregate(sequence(0, (size(w) - 1) div {SPAN}), 0L, (a, i) -> a + size(array_distinct(slice(w, cast(i as int) * {SPAN} + 1, {SPAN})))))").alias("n_distinct"),
        F.expr("greatest(size(w) - 2, 0)").alias("m"),
    )
    t = _twice(t, "m", "j", "get(w, @), get(w, @ + 1), get(w, @ + 2)")
    t = _twice(t, "size(p)", "get(p, j)", "7L, get(w, @ + 2), get(w, @ + 1), get(w, @)").withColumn("p", F.sort_array("p")).drop("w", "m")
    covered = "aggregate(sequence(1, size(p) - 1), 3L, (a, i) -> a + least(3L, get(p, i) - get(p, i - 1)))"
    return t.withColumn("n_repeat_words", F.expr(f"if(size(p) = 0, 0L, {covered})")).drop("p")


def votes(stats: DataFrame) -> DataFrame:
    """stats with base_failed and one column v_<rule> of 1, 0 or -1 for each rule."""
    stats = stats.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words"))
    for name, (statistic, good, bad) in RULES.items():
        value = F.expr(f"cast(({statistic.replace('/ n_words', '/ greatest(n_words, 1)')}) as double)")
        stats = stats.withColumn(f"v_{name}", F.when(value <= good, 1).when(value > bad, -1).otherwise(0))
    return stats


def _log_odds(accuracy: dict[str, tuple[float, float]], prior: float) -> Column:
    out = F.lit(math.log(prior / (1 - prior)))
    for name, (on_good, on_bad) in accuracy.items():
        vote = F.col(f"v_{name}")
        out = out + F.when(vote == 1, math.log(on_good / (1 - on_bad))).when(vote == -1, math.log((1 - on_good) / on_bad)).otherwise(0.0)
    return out


def posterior(accuracy: dict[str, tuple[float, float]], prior: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_log_odds(accuracy, prior)))


def estimate(voted: DataFrame) -> tuple[dict[str, tuple[float, float]], float]:
    """Each rule's accuracies on good and bad documents, and the share of good ones.

    The driver sees one row of sums a round.
    """
    names = list(RULES)
    patterns = stage(voted.filter("not base_failed").groupBy(*[f"v_{n}" for n in names]).agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    accuracy, prior = dict.fromkeys(names, START[:2]), START[2]
    for _ in range(ROUNDS):
        good = F.col("n") * F.col("good")
        sums = [F.sum("n").alias("all"), F.sum(good).alias("good")]
        for name in names:
            vote = F.col(f"v_{name}")
            for of, weight in (("good", good), ("bad", F.col("n") - good)):
                sums += [F.sum(F.when(vote == v, weight).otherwise(0.0)).alias(f"{name}_{of}_{v + 1}") for v in (1, -1)]
        got = patterns.withColumn("good", posterior(accuracy, prior)).agg(*sums).first()
        if not got["all"]:
            break
        extra = PRIOR_SHARE * got["all"]
        mean = lambda right, wrong, start: (right + start * extra) / (right + wrong + extra)
        new = {n: (mean(got[f"{n}_good_2"], got[f"{n}_good_0"], START[0]), mean(got[f"{n}_bad_0"], got[f"{n}_bad_2"], START[1])) for n in names}
        new_prior = mean(got["good"], got["all"] - got["good"], START[2])
        moved = max([abs(prior - new_prior), *(abs(a - b) for k in names for a, b in zip(accuracy[k], new[k], strict=True))])
        accuracy, prior = new, new_prior
        if moved < TOLERANCE:
            break
    return accuracy, prior


def quality(docs: DataFrame, *carried: str) -> DataFrame:
    """Statistics, votes, p_good, kept and the columns carried for every row of docs."""
    voted = stage(votes(statistics(docs, *carried)), "votes")
    accuracy, prior = estimate(voted)
    return voted.withColumn("p_good", posterior(accuracy, prior)).withColumn("kept", verdict(accuracy, prior))


def verdict(accuracy: dict[str, tuple[float, float]], prior: float) -> Column:
    return ~F.col("base_failed") & (posterior(accuracy, prior) >= 0.5)


def keep_good(docs: DataFrame) -> DataFrame:
    """docs without the rows that are not kept; all columns as they were."""
    named = docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash"))
    return without(docs, quality(named, "text_hash").filter("not kept"))
