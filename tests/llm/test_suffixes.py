"""Matches of the suffix order, settled text by text in NumPy columns."""

import random
import time
from collections import Counter

import pyarrow as pa

from wellspring.llm import suffixes


def matched_text(rng, n, gap, least, seed):
    """Records of one text: n anchors ``gap`` bytes apart, with chance matches in both orders."""
    side, rows = least - seed, []
    for k in range(n):
        for order in (suffixes.RIGHT, suffixes.LEFT):
            sides = [rng.choice([(0, 0), (side, seed), (0, least), (rng.randrange(side + 1), seed + rng.randrange(side + 1))]) for _ in (0, 1)]
            rows.append(dict(zip(suffixes.FOUND, (side + k * gap, order, k * 7 - 3, *sides[0], *sides[1]))))
    return rows


def settled(texts, least, seed):
    kind = pa.struct([(c, pa.int64() if c == "seed" else pa.int32()) for c in suffixes.FOUND])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.list_(kind))], names=["id", "found"])
    return suffixes.settled(batch, least, seed).to_pylist()


def test_settled_matches_as_by_brute_force():
    least, seed = 20, 4
    texts = [[], *(matched_text(random.Random(k), 1 + k, 1 + k % 30, least, seed) for k in range(60))]
    for text, got in zip(texts, settled(texts, least, seed), strict=True):
        covered, reach = set(), {}
        for m in text:
            far, back, done = reach.setdefault((m["seed"], m["at"]), [[0], [0], set()])
            for left, right in ((m["left0"], m["right0"]), (m["left1"], m["right1"])):
                (far if m["ord"] == suffixes.RIGHT else back).append(right if m["ord"] == suffixes.RIGHT else left)
                if left + right >= least:
                    covered.update(range(m["at"] - left, m["at"] + right))
                    done.update(range(least - right, left + 1))
        left = set()
        for (s, p), (far, back, done) in reach.items():
            asked = [o for o in range(max(0, least - max(far)), min(max(back), least - seed) + 1) if o not in done]
            runs = [(o, next(e for e in range(o, least + 1) if e + 1 not in asked)) for o in asked if o - 1 not in asked]
            left |= {(s, p, a, b) for a, b in runs if not covered.issuperset(range(p - b, p - a + least))}
        assert {x for a, b in zip(got["froms"], got["tos"]) for x in range(a, b)} == covered
        assert all(b < a for b, a in zip(got["tos"], got["froms"][1:]))
        assert Counter(tuple(x.values()) for x in got["open"]) == Counter(left)


def test_matches_of_a_long_text_settle_in_proportion():
    """Open windows were held against every range of their text: 30,000 of each took the square of it."""
    least, seed, n = 400, 32, 30_000
    none, whole, some = (0, 0, 0, 0), (0, least, 0, 0), (least - seed, seed, 0, 0)
    rows = []
    for k in range(n):  # one anchor covers its own range, the next one has 400 bytes only from two neighbours
        p = (k + 1) * 4 * least
        rows += [dict(zip(suffixes.FOUND, (p, suffixes.RIGHT, 2 * k, *whole))), dict(zip(suffixes.FOUND, (p, suffixes.LEFT, 2 * k, *none)))]
        for order, sides in ((suffixes.RIGHT, (0, least - 10, 0, 0)), (suffixes.LEFT, (least - seed - 10, seed, 0, 0))):
            rows.append(dict(zip(suffixes.FOUND, (p + 2 * least, order, 2 * k + 1, *sides))))
    start = time.process_time()
    (got,) = settled([rows], least, seed)
    assert time.process_time() - start < 10
    assert len(got["froms"]) == len(got["open"]) == n
