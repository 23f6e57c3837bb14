"""Operators that work in steps give what one step gives; draws come from the whole table."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from wellspring.llm import chat, lines, quality, simhash

TURNS = "conv_id long, turn long, role string, text string"


def test_long_conversations_take_time_in_proportion(spark):
    def run(n):
        rows = spark.range(n).selectExpr("1L conv_id", "id turn", "if(id % 3 = 0, 'user', 'assistant') role", "concat('tür [x] <y> \\\\ ', repeat('word ', 20), id) text")
        out = chat.formatted(rows)
        began = time.perf_counter()
        (row,) = out.select(chat.loss_text(F.col("formatted"), F.col("loss")).alias("learnt"), F.size("loss").alias("n"), chat.turns_of(F.col("formatted")).alias("turns")).collect()
        took = time.perf_counter() - began
        want = [("user" if k % 3 == 0 else "assistant", "tür [x] <y> \\ " + "word " * 20 + str(k)) for k in range(n)]
        assert [tuple(t) for t in row["turns"]] == want
        assert row["learnt"] == "".join(t for r, t in want if r == "assistant") and row["n"] == sum(r == "assistant" for r, _ in want)
        return took

    run(300)
    assert run(8000) < 2 * run(4000) + 1


def test_loss_text_without_spans_and_around_the_stretch(spark):
    for n in (0, 1, chat.STRETCH, chat.STRETCH + 1):
        rows = spark.createDataFrame([(1, -1, "user", "q"), *[(1, k, "assistant", f"ä{k}" if k % 5 else "") for k in range(n)]], TURNS)
        out = chat.formatted(rows).select(chat.loss_text(F.col("formatted"), F.col("loss")).alias("t"))
        assert out.first()["t"] == "".join(f"ä{k}" if k % 5 else "" for k in range(n))


def test_draws_come_from_the_whole_table(spark):
    rows = spark.range(60_000).selectExpr("id doc_id", "hash(id) text_hash", *[f"cast(id as double) {f}" for f in quality.FEATURES])
    rows = rows.withColumn("text_hash", F.col("text_hash").cast("long")).cache()
    parts = quality.draws(rows, 20, 256)
    ids = [p[:, 0].astype(int).tolist() for p in parts]
    assert [len(set(p)) for p in ids] == [256] * 20 and len(set(sum(ids, []))) > 4500  # samples differ
    share = np.histogram(sum(ids, []), bins=10, range=(0, 60_000))[0] / (256 * 20)
    assert abs(share - 0.1).max() < 0.02
    assert all((a == b).all() for a, b in zip(parts, quality.draws(rows.repartition(37), 20, 256)))
    assert sorted(quality.draws(rows.limit(30), 1, 256)[0][:, 0]) == sorted(r[0] for r in rows.limit(30).collect())
    copies = rows.limit(3).unionByName(rows.limit(1).crossJoin(spark.range(500)).drop("id"))
    assert [len(p) for p in quality.draws(copies, 2, 256)] == [3, 3]
    assert quality.draws(rows.limit(0), 5, 256) == []


def test_forest_separates_what_is_planted(spark):
    rng = random.Random(4)
    plain = [(k, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 200)))) for k in range(600)]
    odd = [(1000 + k, " ".join(f"w{rng.randrange(3000)}#$|" for _ in range(60))) for k in range(30)]
    docs = spark.createDataFrame(plain + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in plain[::2] + odd[::2]], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.filtered(docs, labels).collect()}
    assert len([i for i, _ in plain if i in kept]) >= 590 and len([i for i, _ in odd if i in kept]) <= 3


def test_fingerprints_in_steps(monkeypatch):
    text = " ".join(f"Word{k % 977}" for k in range(5000)).encode()
    whole = simhash.fingerprint(text)
    for step in (1, 7, 4997):
        monkeypatch.setattr(simhash, "STEP", step)
        assert simhash.fingerprint(text) == whole


def test_repeated_rows_and_many_later_documents(spark):
    block = "\n".join(f"line {k} of the shared block" for k in range(6))
    rows = [(1, block), *[(2, f"mine\n{block}")] * 400, *[(k, f"own {k}\n{block}") for k in range(3, 203)]]
    got = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("_row.doc_id", "_row.text", "n_removed").collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == {(1, block, 0), (2, "mine", 6), *[(k, f"own {k}", 6) for k in range(3, 203)]}
