"""Quality rules: an isolation forest over rule statistics, with a threshold from labelled rows.

Random axis-parallel splits separate unusual documents early, so their mean path is short. Each
tree draws its own ``ROWS_A_TREE`` rows from the whole table by a hash below a bound, so only the drawn
rows leave their tasks; every document is scored. Which statistics the trees split on is chosen
on a bounded sample of labelled rows: an anomaly in one that says nothing about quality only blurs
the score. The threshold comes from all labelled rows: it is the score that rejects most bad ones
while the share of good ones rejected stays within ``MISTAKES``.

Null texts have no words. A text without words fails the base rule. Rows are judged one by one, so
repeated rows get equal verdicts; a draw takes rows that agree in id and text once. Without usable labels only the base rule rejects.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import keep

SYMBOLS = "#*$%&|<>"  # fixed value
BLANKS = " \t\n\r\x0b\x0c"  # fixed value: the complement of a word's characters
MIN_WORDS = 10
MAX_REPEAT = 20  # per cent of words in repeated windows
WINDOW = 5
LABELLED = 6_000  # most labelled rows that the choice of statistics looks at
TREES = 100
ROWS_A_TREE = 256  # drawn for each tree from the whole table
SPARE = 1.6  # rows asked for per row needed: hashes decide, so their number varies
MISTAKES = 0.002  # most of the good labelled documents that the threshold may reject
BINS = 2000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
FEATURES = ("mean_word", "symbols", "dup_lines", "repeats")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words covered by a window that occurs at least twice. Windows are compared exactly, by rank doubling."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    key, span = code, 1
    while span < width:
        step = min(span, width - span)  # a window of span + step words from two that overlap or touch
        key = key[: len(words) - span - step + 1] * (int(key.max()) + 1) + key[step : step + len(words) - span - step + 1]
        key, span = np.unique(key, return_inverse=True)[1], span + step
    twice = np.flatnonzero(np.bincount(key)[key] > 1)
    if not len(twice):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts(text: bytes | None) -> tuple[int, ...]:
    """The values named in ``COUNTS``."""
    data = text or b""
    words, chars = data.split(), data.decode("utf-8", "replace")
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (
        len(words), len(chars) - sum(map(chars.count, BLANKS)), sum(map(chars.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words), len(lines),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, ``text_hash``, ``COUNTS`` and ``base_failed``."""

    def run(batches):
        for batch in batches:
            rows = [counts(t) for t in batch.column(1).to_pylist()]
            cols = zip(*rows) if rows else [[]] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "text_hash", *COUNTS])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS)
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def features(stats: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return stats.withColumns(dict(zip(FEATURES, (
        F.log1p(ratio("word_chars", "n_words")), F.log1p(100 * ratio("n_symbols", "word_chars")),
        ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words"),
    ))))


def mean_path(n: float) -> float:
    """Mean path of an unsuccessful search in a random search tree of n keys."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(parts: list[np.ndarray], seed: int = 7) -> list[tuple[np.ndarray, ...]]:
    """A tree for each of ``parts``, as arrays: feature (-1: leaf), cut, left child, right child, path length at a leaf."""
    rng, forest = np.random.default_rng(seed), []
    for part in parts:
        deepest = int(np.ceil(np.log2(max(2, len(part)))))
        nodes, todo = [[-1, 0.0, 0, 0, 0.0]], [(0, part, 0)]
        while todo:
            at, x, depth = todo.pop()
            low, high = x.min(0), x.max(0)
            able = np.flatnonzero(high > low)
            if depth >= deepest or len(x) < 2 or not len(able):
                nodes[at][4] = depth + mean_path(len(x))
                continue
            f = int(rng.choice(able))
            cut = rng.uniform(low[f], high[f])
            side = x[:, f] < cut
            nodes[at][:4] = f, cut, len(nodes), len(nodes) + 1
            nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
            todo += [(nodes[at][2], x[side], depth + 1), (nodes[at][3], x[~side], depth + 1)]
        forest.append(tuple(np.array(c) for c in zip(*nodes)))
    return forest


def anomaly(forest, x: np.ndarray, per_tree: int = ROWS_A_TREE) -> np.ndarray:
    """2 ** -(mean path / expected path): near 1 for rows that are easy to separate."""
    total = np.zeros(len(x))
    for feature, cut, left, right, path in forest:
        at = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            here = at[inner]
            at[inner] = np.where(x[inner, feature[here]] < cut[here], left[here], right[here])
        total += path[at]
    return 2.0 ** -(total / max(1, len(forest)) / mean_path(per_tree)) if forest else total


def cut(good: np.ndarray, bad: np.ndarray, mistakes: float) -> tuple[float, int]:
    """Best gain (share of bad less share of good rejected) and its lowest rejected bin, from counts by bin."""
    good, bad = (x[::-1].cumsum()[::-1] for x in (good, bad))
    if not good[0] or not bad[0]:
        return 0.0, 0
    gain = np.where(good <= mistakes * good[0], bad / bad[0] - good / good[0], 0.0)
    return float(gain.max()), int(np.argmax(gain))


def bins(score: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.bincount(np.floor(score[of] * BINS).astype(int), minlength=BINS + 1)


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that pass the base rule and have a label; of several labels the lower counts."""
    known = labels.filter("quality IN (0, 1)").select(F.col("doc_id").alias("l_id"), "quality").groupBy("l_id").agg(F.min("quality").alias("quality"))
    return stats.filter("NOT base_failed").join(known, F.col("doc_id") == F.col("l_id")).drop("l_id")


def draws(have: DataFrame, times: int, size: int, *more: str) -> list[np.ndarray]:
    """``times`` samples of at most ``size`` different rows, each over the whole table, with the columns ``FEATURES`` and ``more``.

    A row is in sample t if its hash with t lies below a bound that lets about ``SPARE * size`` rows pass;
    of these the lowest hashes count. The driver gets these rows alone, however many rows or tasks there are.
    """
    rows = have.select("doc_id", "text_hash", *FEATURES, *more).distinct()
    n = rows.count()
    share = min(1.0, SPARE * size / max(1, n))
    least = min(2**63 - 1, int((2 * share - 1) * 2**63))
    chance = lambda t: F.xxhash64("doc_id", "text_hash", t)
    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(times - 1)), lambda t: F.struct(t.alias("t"), chance(t).alias("h"))), lambda d: d.h <= F.lit(least).cast("long"))
    found = rows.select(F.inline(drawn), *FEATURES, *more).toPandas()
    # in the order of hashes: the samples depend on the rows alone, not on which task sent them first
    found = found.sort_values(["t", "h", *FEATURES, *more])
    return [part.drop(columns=["t", "h"]).head(size).to_numpy(float) for _, part in found.groupby("t")]


def fit(stats: DataFrame, labels: DataFrame, mistakes: float = MISTAKES) -> tuple[list, list[int]]:
    """The forest and the positions in ``FEATURES`` of the statistics it uses."""
    have = features(stats)
    parts = draws(have.filter("NOT base_failed"), TREES, ROWS_A_TREE)
    known = np.concatenate([np.empty((0, len(FEATURES) + 1)), *draws(labelled(have, labels), 1, LABELLED, "quality")])
    best = (0.0, list(range(len(FEATURES))))
    for n in range(1, len(FEATURES) + 1) if len(known) else ():
        for use in map(list, combinations(range(len(FEATURES)), n)):
            s = anomaly(grow([p[:, use] for p in parts]), known[:, use])
            gain, _ = cut(bins(s, known[:, -1] == 1), bins(s, known[:, -1] == 0), mistakes)
            if gain > best[0] + 1e-9:  # fewer statistics win ties
                best = (gain, use)
    return grow([p[:, best[1]] for p in parts]), best[1]


def score(stats: DataFrame, forest: list, use: list[int]) -> DataFrame:
    """``stats`` with the forest's ``score``."""

    def run(frames):
        for frame in frames:
            frame["score"] = anomaly(forest, frame[list(FEATURES)].to_numpy(float)[:, use])
            yield frame.drop(columns=list(FEATURES))

    kinds = ", ".join(f"{n} {t}" for n, t in stats.dtypes)
    return features(stats).mapInPandas(run, f"{kinds}, score double")


def threshold(scored: DataFrame, labels: DataFrame, mistakes: float = MISTAKES) -> float:
    """Score from which to reject. Only counts per score bin reach the driver."""
    hist = np.zeros((2, BINS + 1), np.int64)
    for b, q, n in labelled(scored, labels).groupBy(F.floor(F.col("score") * BINS).cast("int").alias("bin"), "quality").count().collect():
        hist[q, b] += n
    gain, at = cut(hist[1], hist[0], mistakes)
    return at / BINS if gain > 0 else float("inf")


def judge(docs: DataFrame, labels: DataFrame, mistakes: float = MISTAKES) -> DataFrame:
    """doc_id, ``text_hash``, ``COUNTS``, ``base_failed``, ``score`` and ``kept`` for every row of ``docs``."""
    stats = keep(statistics(docs), "rules")
    scored = keep(score(stats, *fit(stats, labels, mistakes)), "scores")
    limit = threshold(scored, labels, mistakes)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") < F.lit(limit)))


def filtered(docs: DataFrame, labels: DataFrame, mistakes: float = MISTAKES) -> DataFrame:
    """Rows of ``docs`` that are kept, with all their columns. Of rows that share a doc_id, each is judged by its own text."""
    verdicts = judge(docs, labels, mistakes).filter(~F.col("kept")).select(F.col("doc_id").alias("_bad"), F.col("text_hash").alias("_bad_text")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"))
    cond = F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_text") == F.col("_bad_text"))
    return rows.join(verdicts, cond, "left_anti").select("_row.*")
