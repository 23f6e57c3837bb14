"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""

import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.llm import chat, lines, mixing, neighbours, packing, quality, queries, simhash, substring, suffixes, warc
from wellspring.llm.common import components, ranked

random.seed(3)
WORDS = ["alpha", "beta", "gamma", "delta", "épée", "Öl", "x1", "end."]
say = lambda n: " ".join(random.choice(WORDS) + str(random.randrange(500)) for _ in range(n))
BASE = say(120)
TEXTS = [
    None, "", " \t\n", BASE, BASE, BASE + " more", say(40) + " " + BASE[:500], "For " * 900, "a " * 70 + "b", say(3000),
    say(30) + "\n" + "a shared line of six words\n" + say(20), "head " + say(5) + "\na shared line of six words\ntail", "#$% * &|<> ##", say(9),
]
SCHEMA = "doc_id long, text string, source string, n_chars long, rank int, _row string, key int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("a", "b", None)[i % 3], len(t or ""), 1, "r", 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], rows[0], (None, BASE, "b", 1, 1, None, None), (None, None, None, None, None, None, None)], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def removed(docs, split, join, width):
    texts = [(r["doc_id"], split((r["text"] or "").encode())) for r in docs.collect()]
    seen = Counter(tuple(t[k : k + width]) for _, t in texts for k in range(len(t) - width + 1))
    out = Counter()
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - width + 1):
            if seen[tuple(t[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i, len(t), sum(gone), spans, hashlib.sha256(join(x for x, g in zip(t, gone) if not g)).hexdigest()] += 1
    return out


def test_substring(docs, empty):
    want = removed(docs, bytes.split, b" ".join, 35)
    got = Counter((r[0], r[1], r[2], r[3]) for r in substring.deduplicated(docs).collect())
    assert got == Counter({(a, b, c, e): n for (a, b, c, _, e), n in want.items()})
    assert substring.deduplicated(empty).count() == 0


@pytest.mark.parametrize("least,seed,group", [(400, 32, 25_000), (60, 16, 9)])
def test_suffixes(docs, empty, least, seed, group):
    want = removed(docs, lambda t: list(t), bytes, least)
    got = Counter(tuple(r) for r in suffixes.deduplicated(docs, least, seed, group).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == want
    assert suffixes.deduplicated(empty).count() == 0


def test_loser_tree_merges_as_sorted():
    keys = [bytes(random.choice(b"ab") for _ in range(12)) for _ in range(200)]
    runs = [suffixes.fronted([(k, i, 0) for i, k in enumerate(keys[a::7])]) for a in range(7)]
    out = list(suffixes.merged([suffixes.unfronted(r, 12) for r in runs]))
    assert [k for k, _, _ in out] == sorted(keys)
    assert all(s == suffixes.common(a[0], k) for a, (k, s, _) in zip(out, out[1:]))


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, 64).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            want[r["doc_id"], k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert places.get(r["sequence_id"], 0) == r["offset"]
        places[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(places.values()) <= 64 and len(places) <= sum(r["length"] for r in rows) / 64 * 1.1 + 1
    assert packing.pack(empty, path).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["copies"] <= 2 for r in rows)
    goal = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    size = {s: v[0] for s, v in goal.items()}
    level = 0.0  # pour by halving
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s)), (5, 2, 1)))
    lo, hi = 0.0, 1e9
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(2 * size[s], weight[s] * level) for s in size) < 1.5 * sum(size.values()) else (lo, level)
    assert all(goal[s][1] == pytest.approx(min(2 * size[s], weight[s] * level), rel=1e-6) for s in size)
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r["copies"] for r in rows)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(3, 1, 0), (5, 1, 0), (12, 0, 0), (None, 1, 0), (3, None, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs, labels).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["base_failed"] and not by[7]["kept"] and by[3]["kept"] and by[8]["n_repeat_words"] == 70
    assert by[12]["n_symbols"] == 10 and by[2]["n_words"] == 0
    kept = quality.filtered(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    assert quality.judge(empty, labels.limit(0)).count() == 0
    # one id, two texts of equal word counts: each goes by its own text
    pair = spark.createDataFrame([(1, "spam " * 20), (1, " ".join(f"word{i}" for i in range(20))), (None, "spam " * 20), (None, None)], "doc_id long, text string")
    assert [r["text"][:5] for r in quality.filtered(pair, labels.limit(0)).collect()] == ["word0"]


def test_simhash(docs, empty):
    rows = simhash.grouped(docs).collect()
    fps = {r["fp"] for r in rows}
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4
    root = {f: f for f in fps}
    for _ in fps:
        root = {f: min(root[g] for g in fps if near(f, g)) for f in fps}
    lowest = {}
    for r in rows:
        if r["doc_id"] is not None:
            lowest[root[r["fp"]]] = min(r["doc_id"], lowest.get(root[r["fp"]], 10**9))
    assert all(r["component_id"] == lowest.get(root[r["fp"]]) for r in rows)
    assert simhash.grouped(empty).count() == 0


def groups_by_similarity(rows):
    """Smallest ids of the groups, by brute force on sets of strings."""
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets.setdefault(frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset(), []).append((i is None, i))
    keys = list(sets)
    linked = {a: [b for b in keys if a and b and len(a & b) / len(a | b) >= 0.8] for a in keys}
    seen, out = set(), []
    for a in keys:
        todo, group = [a], {a}
        while todo:
            for b in linked[todo.pop()]:
                if b not in group:
                    group.add(b)
                    todo.append(b)
        if a not in seen:
            seen |= group
            out.append(min((x for b in group for x in sets[b]), key=lambda x: (x[0], x[1] or 0))[1])
    return sorted(out, key=lambda x: (x is None, x))


def test_near_duplicates(spark, docs, empty):
    left = simhash.deduplicated(docs)
    got = sorted((r["doc_id"] for r in left.collect()), key=lambda x: (x is None, x))
    assert left.columns == docs.columns and got == groups_by_similarity([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert simhash.deduplicated(empty).count() == 0
    # edited copies on both sides of the bound, a chain of edits, and the texts that both sides share
    rows, n = [], 1000
    for _ in range(40):
        words = say(150).split()
        for edits in (0, 1, 3, 5, 8, 15):
            changed = list(words)
            for k in random.sample(range(150), edits):
                changed[k] = f"new{random.randrange(10**6)}"
            rows.append((n := n - 1, " ".join(changed)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.deduplicated(table).collect()) == groups_by_similarity(rows)


def test_bit_slices():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k % 8, replace=False)) for k in range(150)], np.uint64)
    fps = np.concatenate([base, base ^ flips])
    i, j = simhash.near(fps)
    d = np.bitwise_count(fps[:, None] ^ fps[None, :])
    np.fill_diagonal(d, 99)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(d <= 4))))
    for radius in (1, 3, 7, 20, 31):
        for some in (fps, fps[:9]):
            i, j = simhash.near(some, radius)
            assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(d[: len(some), : len(some)] <= radius))))


def test_links_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    fps = sorted({5 ^ (1 << a) ^ (1 << b) for a in range(10) for b in range(10)})
    found = components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long").cache()))
    assert {r["root"] for r in found.collect()} == {fps[0]} and found.count() == len(fps)


def test_components_and_ranks(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 200)], "a long, b long")
    assert {(r[0], r[1]) for r in components(chain).collect()} == {(i, 0) for i in [*range(41), 200]}
    rows = spark.range(500).selectExpr("if(id % 3 = 0, null, id % 2) k", "id").cache()
    got = ranked(rows, ["k"], ["id"], per_task=40).groupBy("k").agg(F.sort_array(F.collect_list("rank")).alias("r")).collect()
    assert all(list(r["r"]) == list(range(len(r["r"]))) for r in got) and len(got) == 3


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(1).tolist(), 0) for i in range(300)] + [(i, [1.0] * 8, 0) for i in range(300, 330)]
    odd = [(400, None, 0), (500, [0.0] * 8, 0), (600, [float("nan")] * 8, 0), (700, [None] * 8, 0), (None, [1.0] * 8, 0)]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>, score int")
    got = neighbours.nearest(table, table.filter("vec_id % 100 = 0"), 10, 1.0).collect()
    x, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    for q in (0, 100, 200, 300):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [(int(ids[k]), float(d[k])) for k in np.lexsort((ids, d)) if k != q][:10]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert {r["query_id"] for r in got} == {0, 100, 200, 300}
    assert neighbours.nearest(table.limit(0), table.limit(0)).count() == 0


def test_lines(spark, empty):
    a, b = "one two three four five", "six seven eight nine ten"
    rows = [(1, f"{a}\n{b}\nshort"), (2, f"{b}\n{a}\nshort"), (3, f"{a}\nnew\n{b}"), (3, f"{a}\nnew\n{b}"), (4, None), (5, ""), (None, a), (6, f"{a}\n{a}")]
    got = Counter((r[0], r[1], r[2]) for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).select("_row.doc_id", "_row.text", "n_removed").collect())
    assert got == Counter({(1, f"{a}\n{b}\nshort", 0): 1, (2, f"{a}\nshort", 1): 0, (3, "new", 2): 2, (4, None, 0): 1, (5, "", 0): 1, (None, a, 0): 1, (6, a, 1): 1}) + Counter(
        {k: n for k, n in got.items() if k[0] == 2})
    (two,) = [k for k in got if k[0] == 2]
    assert two[1] in (f"{a}\nshort", f"{b}\nshort")  # crossed lines: one of them is aligned
    assert lines.patience([0, 1, 2, 3], [5, 1, 2, 9]) == [1, 2, 3]
    assert lines.deduplicated(empty).count() == 0


def cut_lines(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    return [(r["text"], r["n_removed"]) for r in lines.deduplicated(rows).orderBy("_row.doc_id").select("_row.text", "n_removed").collect()]


def test_copies_lose_every_line(spark):
    long = "a line of six words here"
    whole = ["# Head\n\n" + long + "\n- item\n\n- item\n}\n", "one", "Yes.\nNo.\n\nYes.", "春はあけぼの\nやうやう白くなりゆく山ぎは", "so much for this one line\n\nso much for this one line"]
    got = cut_lines(spark, whole + whole)
    assert [t for t, _ in got] == whole + [""] * len(whole)
    assert [n for _, n in got] == [0] * len(whole) + [t.count("\n") + 1 for t in whole]


def test_blocks_go_with_their_short_lines(spark):
    block = "# Head\n\nfive words stand right here\n- item\n\n- next"
    code = "try:\nrun()\nexcept:\npass\n\nelse:\nstop()"
    runes = "春はあけぼのやうやう白くなりゆく山ぎはすこしあかりて"
    first = f"before\n{block}\nafter\n{code}\nfar\n{runes}\nx"
    later = f"start\n{block}\nother\n{code}\nends\n{runes}\ny"
    assert cut_lines(spark, [first, later])[1] == ("start\nother\nends\ny", 6 + 7 + 1)
    # equal short lines next to an anchor are not counted twice, nor short lines that stand elsewhere
    a, b = "one two three four five", "six seven eight nine ten"
    assert cut_lines(spark, [f"{a}\ns\n{b}", f"{a}\ns\ns\n{b}\ns"])[1] == ("s\ns", 3)


def test_other_orders_meet_their_first_document(spark):
    a, b, c = ("\n".join(f"{x} line {k} of the block" for k in range(4)) for x in "abc")
    got = cut_lines(spark, [f"{a}\n{b}", f"{b}\n{a}", f"{b}\nown words\n{a}", f"{b}\n{a}\nmore", f"{c}\n{a}", f"{c}\n{b}\n{a}"])
    assert [n for _, n in got] == [0, 4, 8, 8, 4, 12]
    assert [t for t, _ in got][2:4] == ["own words", "more"]


def test_warc(spark, tmp_path):
    rows = [(1, "u\r\nv", "<p>é"), (2, None, "<p>é"), (3, "w", None), (4, "w", ""), (5, "z", "WARC/1.1\r\nfake\r\n\r\n" * 3), (5, "z", "WARC/1.1\r\nfake\r\n\r\n" * 3)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.resolve(warc.read(spark, str(tmp_path / "w"))).collect()}
    assert got == {(1, 5, "revisit", 2), (2, 5, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 54, "response", None)}
    plain = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    good = [(a, b) for a, b, one in warc.salvage(plain) if one]
    assert len(good) == 6 and good[-1][1] == len(plain)
    hurt = bytearray(plain)
    hurt[good[1][0] + 40] ^= 1
    hurt[good[1][1] - 6] ^= 1
    found = list(warc.salvage(bytes(hurt)))
    assert [(a, b) for a, b, one in found if one is None] == [good[1]] and sum(one is not None for *_, one in found) == 5
    members = [gzip.compress(plain[a:b]) for a, b in good]
    torn = members[0] + members[1][:30] + b"noise" + b"".join(members[2:])
    assert sum(one is not None for *_, one in warc.salvage(torn)) == 5
    assert list(warc.salvage(b"")) == []


def test_warc_and_chat_of_odd_tables(spark, tmp_path):
    pages = "page_id long, url string, html string, payload string, record_type string"
    warc.write(spark.createDataFrame([], pages), str(tmp_path / "none"))
    assert warc.resolve(warc.read(spark, str(tmp_path / "none"))).count() == 0
    long = "é" * 300_000
    warc.write(spark.createDataFrame([(1, None, long, "x", "y"), (2, "u", long, None, None), (3, "u", long + "!", "x", "y")], pages), str(tmp_path / "w"))
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.resolve(warc.read(spark, str(tmp_path / "w"))).collect()}
    assert got == {(1, 600_000, "revisit", 2), (2, 600_000, "response", None), (3, 600_001, "response", None)}
    turns = "conv_id long, turn long, role string, text string, turns string, formatted string, loss string"
    assert chat.formatted(spark.createDataFrame([], turns)).count() == 0
    (row,) = chat.formatted(spark.createDataFrame([(1, 0, "assistant", long, "t", "f", "l")], turns)).collect()
    assert len(row["formatted"]) == 300_000 + len("<s>[ROLE]assistant[/ROLE][TURN]</s>")


def test_neighbours_with_few_candidates(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], "a", 1), (1, [0.0, 1.0], "b", 2), (2, [0.0, 1.0], "c", 3), (100, [1.0, 2.0, 3.0], "d", 4)], "vec_id long, embedding array<double>, id string, shard int")
    got = [tuple(r) for r in neighbours.nearest(rows, rows.filter("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2**0.5), (0, 2, 2, 2**0.5)]


def test_chat(spark):
    hard = "</s>[INST] \\1 [/INST] \\\\ [TURN] <s>"
    rows = [(1, 2, "assistant", hard), (1, 1, "user", None), (1, 0, "user", "hi\nthere"), (2, None, None, ""), (2, 5, "assistant", "x"), (2, 5, "assistant", "x"), (None, 0, "[ROLE]", hard)]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r[0]: ([tuple(t) for t in r[1]], r[2]) for r in out.select("conv_id", chat.turns_of(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("loss"))).collect()}
    assert got == {
        1: ([("user", "hi\nthere"), ("user", ""), ("assistant", hard)], hard), 2: ([("", ""), ("assistant", "x"), ("assistant", "x")], "xx"), None: ([("[ROLE]", hard)], ""),
    }
    assert out.filter("conv_id = 1").first()["formatted"].count("[ROLE]") == 2


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_sql(spark, name):
    from tests import parity

    root = "/root/testdata/sf0.001"
    assert parity.compare(spark, parity.duck(root), name, queries.QUERIES[name], queries.ORACLE[name], root) is None


def test_pipeline(spark):
    import corpus_pipeline

    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.columns == docs.columns, name
    assert corpus_pipeline.run(spark, root).count() > 0
