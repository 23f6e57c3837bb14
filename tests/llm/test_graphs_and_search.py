"""The conversation trie, vector near-dedup, lexical search and dense near-dedup groups against brute force on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests import parity
from wellspring.llm import descent, lexical, neighbours, quality, queries, simhash, trie

random.seed(5)


# --- trie ----------------------------------------------------------------------------------------
def brute_trie(rows):
    conv = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            conv.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    conv = {c: [x[1:] for x in sorted(v)] for c, v in conv.items()}
    built = {c: conv.get(c - c % 100, [])[: zlib.crc32(b"%d" % c) % 6] + v[zlib.crc32(b"%d" % c) % 6 :] for c, v in conv.items()}
    members, kids, below, out = {}, {}, {}, []
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        n, under = len(members[k]), kids.get(k, [])
        below[k] = (sum(below[x][0] for x in under) or 1, (n - 1) * (len(k[-1][1]) if k else 0) + sum(below[x][1] for x in under))
        ends = ",".join(str(c) for c in sorted(members[k]) if len(built[c]) == len(k))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, n, len(under), *below[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


TURNS = "conv_id long, turn long, role string, text string, id string, depth int, ka long"


def conversations():
    rows = []
    say = lambda: random.choice(["hi", "ja", "no\n", "ÄÖ", "", None, "x" * 50])
    for c in [*range(0, 60), *range(100, 330), 1000, 100_000_000_007]:
        for t in range(random.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, random.choice([t, t, t, None]), random.choice(["user", "assistant", None]), say(), "z", 1, 2))
    rows += [(7, t, "user", "turn %d" % t, None, None, None) for t in range(3000)]  # one long conversation
    rows += [(400 + i, 0, "user", "same", "s", 0, 0) for i in range(99)]  # one turn that many share
    return [*rows, rows[0], rows[0], (None, 1, "user", "no id", "z", 1, 1), (55, 0, "user", "y" * 200_000, "z", 1, 1)]


@pytest.mark.parametrize("local,piece", [(100_000, 20_000), (300, 20)])
def test_trie(spark, monkeypatch, local, piece):
    monkeypatch.setattr(trie, "PIECE", piece)
    monkeypatch.setattr(trie, "RUN", 64)
    monkeypatch.setattr(trie, "BLOCK", 500)
    rows = conversations()
    got = trie.trie(spark.createDataFrame(rows, TURNS), local).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[:2]) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "a", "b", "c", 1, 1)], TURNS)).count() == 0
    (only,) = trie.trie(spark.createDataFrame([(300, 1, None, None, "c", 1, 1)], TURNS).limit(1)).filter("depth = 0").collect()
    assert (only["conv_id"], only["parent_conv_id"], only["n_convs"], only["n_leaves"]) == (300, None, 1, 1)


def test_list_rank(spark):
    order = random.sample(range(10_000), 2000)
    links = spark.createDataFrame([(a, b, 1) for a, b in zip(order, [*order[1:], None])], "arc long, nxt long, hops long").cache()
    for local in (5000, 40):  # at once; two levels of rulers
        assert {r["arc"]: r["steps"] for r in trie.list_rank(links, local).collect()} == {a: len(order) - 1 - k for k, a in enumerate(order)}


# --- vectors --------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int, id string, u long"


def vectors():
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(600)]
    ball = rng.normal(size=16)
    rows += [(1000 + i, (ball + rng.normal(scale=0.16, size=16)).tolist(), 1) for i in range(300)]  # many near each other, not all linked
    chain = np.cumsum(rng.normal(scale=0.22, size=(60, 16)), axis=0) + 4 * rng.normal(size=16)
    rows += [(2000 + i, v.tolist(), 2) for i, v in enumerate(chain)]
    rows += [(3000 + i, rows[5][1], 2) for i in range(50)]  # copies
    rows += [(3100, [2 * x for x in rows[5][1]], 2), (3101, rows[5][1], 0), (3102, rows[5][1], None), (3103, [0.0] * 16, 1), (3104, None, 1), (3105, [1.0, None], 1)]
    rows += [(3106, [float("nan")] + [1.0] * 15, 1), (3107, [float("inf")] * 16, 1), (3108, [1.0, 2.0], 1), (3109, [2.0, 4.1], 1), (None, rows[0][1], 0), (3000, rows[7][1], 1), rows[9]]
    return [(*r, "x", 1) for r in rows]


def brute_links(rows):
    fine = lambda r: r[0] is not None and r[2] is not None and r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])
    at = [k for k, r in enumerate(rows) if fine(r)]
    unit = {k: np.float32(rows[k][1]).astype(float) / np.linalg.norm(np.float32(rows[k][1]).astype(float)) for k in at}
    near = {k: [q for q in at if q != k and rows[q][2] == rows[k][2] and len(unit[q]) == len(unit[k]) and unit[q] @ unit[k] >= 0.93] for k in at}
    root, out = {k: rows[k][0] for k in at}, Counter()
    while True:
        new = {k: min([root[k], *(root[q] for q in near[k])]) for k in at}
        if new == root:
            break
        root = new
    for k, r in enumerate(rows):
        comp = root.get(k, r[0])
        out[r[0], len(near.get(k, [])), comp, comp is None or comp == r[0]] += 1
    return out


@pytest.mark.parametrize("block", [256, 24])
def test_vector_near_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(descent, "BLOCK", block)
    monkeypatch.setattr(descent, "LEAF", 64)
    rows = vectors()
    got = descent.linked(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    assert Counter(map(tuple, got)) == brute_links(rows)


def test_vector_near_dedup_of_nothing(spark):
    assert descent.linked(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(1, None, 1, "x", 1), (2, [1.0], None, "x", 1), (3, [1.0], 4, "x", 1)]
    assert sorted(map(tuple, descent.linked(spark.createDataFrame(rows, VECTORS)).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_audit_counts_what_is_missing(spark):
    _, nodes = descent.nodes_of(spark.createDataFrame(vectors(), VECTORS))
    none = spark.createDataFrame([], "id long, links long")
    assert descent.audit(nodes, none, 0.93) == 0.0 and descent.audit(nodes, none, 1.1) == 1.0


def test_neighbour_search_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 24))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = Counter()
    for r in neighbours.nearest(rows, rows.filter("vec_id % 100 = 0"), 10).collect():
        found[r["query_id"]] += r["vec_id"] in np.argsort(((x - x[r["query_id"]]) ** 2).sum(axis=1), kind="stable")[1:11]
    assert sum(found.values()) >= 0.9 * 600


# --- search ---------------------------------------------------------------------------------------
WORDS = [f"w{i}" for i in range(300)] + ["Épée", "ÄÖ", "it's", "42", "日本"]
DOCS = "doc_id long, text string, item_id long, rank int, items string"


def documents():
    say = lambda n: " ".join(random.choices(WORDS, weights=[1 / (k + 1) for k in range(len(WORDS))], k=n))
    texts = [say(random.choice([1, 5, 40, 200])) for _ in range(400)] + [None, "", " .,-\t", "w1 " * 5000, say(60_000), "W1-w2_W3", "\x00\x7f"]
    rows = [(i, t, 1, 1, "a") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[5], 1, 1, "a"), (5, texts[9], 1, 1, "a")]


def brute_search(docs, items, k):
    term = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    held = [(r[0], Counter(term.findall(low(r[1])))) for r in docs]
    total, length = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df, asked, out = Counter(t for _, c in held for t in c), {}, Counter()
    for r in items:
        asked.setdefault(r[0], set()).update(term.findall(low(r[1])))
    for item, query in asked.items():
        scores = []
        for ident, c in held:
            m = 10 + (90 * sum(c.values()) * total) // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in query if c[t])
            scores += [(-s, ident is not None, ident or 0)] if s > 0 else []
        for rank, (s, named, ident) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, ident if named else None, -s] += 1
    return out


@pytest.mark.parametrize("cells,chunk", [(1 << 25, 200_000), (1 << 14, 30)])
def test_lexical_search(spark, monkeypatch, cells, chunk):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "CHUNK_TERMS", chunk)
    docs = documents()
    items = [(i, " ".join(random.sample(WORDS, 12)), "x") for i in range(25)] + [(30, None, "x"), (31, "unknown words", "x"), (32, "w1", "x"), (0, "w2 W3", "x"), (None, "w7 w8 日本", "x")]
    got = lexical.search(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, "item_id long, text string, term string"), 10).collect()
    assert Counter(map(tuple, got)) == brute_search(docs, items, 10)


def test_an_index_task_holds_few_terms(spark, monkeypatch):
    """Blocks of several widths in one task are given out before they hold more terms than allowed; each document is in one of them."""
    monkeypatch.setattr(lexical, "HELD", 300)
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(3 + i % 5 * 20)), "en", "web", 1) for i in range(60)]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").coalesce(1)
    built = lexical.index(df).collect()
    assert sorted(i for r in built for i in r["ids"]) == list(range(60))
    assert max(len(r["terms"]) for r in built) <= 300 + 83
    monkeypatch.setattr(lexical, "HELD", 10**9)
    assert len(lexical.index(df).collect()) < len(built)


def test_lexical_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "w1", "x")], "item_id long, text string, term string")
    assert lexical.search(docs, items).count() == 0
    some = spark.createDataFrame([(1, "w1 w2", 1, 1, "a")], DOCS)
    assert lexical.search(some, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in lexical.search(some, items).collect()] == [(1, 1, 1)]


def test_bounds_never_fall_short():
    """A signature shows every term of a document, however often it occurs."""
    block = lexical._Block(512)
    sets = [Counter(lexical.terms(" ".join(random.choices(WORDS, k=30)).encode())) for _ in range(20)]
    for i, c in enumerate(sets):
        block.add(i, i, c)
    row = block.row()
    slices = np.frombuffer(row["slices"], np.uint8).reshape(512, -1)
    for level, least in enumerate(lexical.LEVELS):
        for d, c in enumerate(sets):
            for t, n in c.items():
                if n >= least:
                    at = lexical._positions(lexical._hashed([t]), level, 512)[0]
                    assert np.unpackbits(slices[at], axis=1)[:, d].all()


# --- near-dedup and earlier operators ---------------------------------------------------------------
def test_dense_groups_are_compared_whole(spark, monkeypatch):
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in random.sample(range(80), random.choice([0, 1, 2, 3])):
            words[k] = f"c{random.randrange(40)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    root = list(range(120))
    for _ in rows:
        root = [min(root[j] for j in range(120) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8) for i in range(120)]
    want = sorted(set(root))
    for dense in (0, 10**9):
        monkeypatch.setattr(simhash, "DENSE", dense)
        assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == want, dense
    assert 1 <= len(want) < 120


def test_common_counts(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 40)) for _ in range(12)]
    owner, value = np.repeat(np.arange(12), [len(s) for s in sets]), np.concatenate(sets)
    i, j = np.triu_indices(12, 1)
    for bits in (1 << 25, 1 << 10):
        monkeypatch.setattr(simhash, "BLOCK_BITS", bits)
        assert simhash.common_counts(owner, value, i, j, 12).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]


def test_fingerprints_by_hand(spark):
    texts = [None, "", "One two", "a b c d e f a b c d", "Ä B\tc\nd  e " * 30]

    def by_hand(text):
        w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)):016x}"

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["f"] for r in simhash.grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f")).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}


def test_quality_base_columns_by_hand(spark):
    say = lambda n: " ".join(random.choices(["one", "two", "a#b", "x|y", "três"], k=n))
    texts = [None, "", say(9), say(40), "\n".join(say(4) for _ in range(30)), "same line\nsame line\n\n\nsame  line\n", "q " * 200]

    def by_hand(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        seen, hit, lines, dup = Counter(runs), set(), set(), 0
        for k, r in enumerate(runs):
            hit |= set(range(k, k + 5)) if seen[r] > 1 else set()
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.add(line)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality.judge(docs, labels).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}


def test_sql_on_copies_and_long_conversations(spark, tmp_path):
    """Revisit records and conversations of a thousand turns, which the given tables do not hold."""
    html = [None, "", "<p>a</p>", "<p>a</p>", "<p>ä</p>", "<p>a</p>", None]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    turns = [(c, t, ("user", "assistant", None)[(c + t) % 3], f"t{t} [x] <y> \\ {c}") for c, n in ((1, 1000), (2, 3), (3, 1)) for t in range(n)]
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb

    con = duckdb.connect()
    for name in ("pages", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("op9_warc", "op10_chat_format", "op11_conversation_trie"):
        assert parity.compare(spark, con, name, queries.QUERIES[name], queries.ORACLE[name], str(tmp_path)) is None, name
    assert {r["record_type"] for r in queries.op9_warc(spark, str(tmp_path)).collect()} == {"response", "revisit"}


def test_special_strings_are_tokens_wherever_they_stand():
    from tokenizers import Tokenizer

    from wellspring.llm import packing

    plain = Tokenizer.from_file(queries.tokenizer_path())
    texts = ["<|endoftext|> hi", "Word<|startoftext|>glued. And more", "<|EndOfText|> <| x |>", "a\n<|endoftext|><|endoftext|>", "no such thing", "", "Ä <|endoftext|>" + " x" * 5000]
    got = [np.frombuffer(b, "<u4").tolist() for b in packing.id_bytes([t.encode() for t in texts], queries.tokenizer_path())]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_odd_chunks_in_small_blocks(monkeypatch):
    from tokenizers import Tokenizer

    from wellspring.llm import packing

    path = queries.tokenizer_path()
    plain, rng = Tokenizer.from_file(path), np.random.default_rng(3)
    bits = ["a", "Z", "the", "é", "É", "ß", "İ", "ŉ", "ſ", "ÿ", "µ", "9", "²", ".", ",", "!!", "'", "'s", "&&&", "=", "̸", "̇", " ", " ", "\n", "\t", "\x85", "क़", "한", "Σ", "Å", "<|"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(3000)] + ["word, " * 500, "", "a" * 900 + ".", "x <|endoftext|>."]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for block, cached in ((packing.BLOCK_BYTES, packing.CACHED_BYTES), (3000, 20_000), (3000, 0)):
        monkeypatch.setattr(packing, "BLOCK_BYTES", block)
        monkeypatch.setattr(packing, "CACHED_BYTES", cached)
        packing._known.clear()
        assert [np.frombuffer(b, "<u4").tolist() for b in packing.id_bytes([t.encode() for t in texts], path)] == want


def test_a_worker_remembers_a_bounded_number_of_bytes():
    import tracemalloc

    import pyarrow as pa

    from wellspring.llm import packing

    path, letters = queries.tokenizer_path(), "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(letters[k // 26**i % 26] for i in range(5))
    next(packing.id_bytes([b"first"], path))
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    for at in range(0, 400_000, 10_000):
        assert all(packing.id_bytes([" ".join(word(k) for k in range(at, at + 10_000)).encode()], path))
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 32 << 20
