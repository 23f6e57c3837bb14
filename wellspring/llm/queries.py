"""Registered queries of the operators and, where SQL can say the result, that SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspring.llm import chat, descent, lexical, lines, mixing, neighbours, packing, quality, simhash, substring, suffixes, trie, warc
from wellspring.llm.common import table
from wellspring.sources.tables import scratch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op1_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(table(spark, root, "documents"), tokenizer_path())


@query()
def op2_source_mixing(spark: SparkSession, root: str) -> DataFrame:
    mixed = mixing.mix(table(spark, root, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query()
def op6_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    judged = quality.judge(table(spark, root, "documents"), table(spark, root, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_BASE32 = " || ".join(f"substr(d, ((v{i} >> {s}) & 31)::INT + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))


@query(f"""
WITH pages_in AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS d FROM pages),
parts AS (SELECT *, {', '.join(f"('0x' || substr(hex, {5 * i + 1}, 5))::BIGINT AS v{i}" for i in range(8))} FROM pages_in),
dig AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, payload FROM parts),
held AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS top FROM dig)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM held""")
def op9_warc(spark: SparkSession, root: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(table(spark, root, "pages"), path)
    return warc.resolve(warc.read(spark, path))


@query("""
WITH rows_in AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS first,
    length(text) + length(regexp_replace(text, '[^\\\\<[]', '', 'g')) AS text_chars,
    length(role) + length(regexp_replace(role, '[^\\\\<[]', '', 'g')) AS role_chars FROM rows_in)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + 6 + CASE WHEN first THEN role_chars + 20 ELSE 0 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id""")
def op10_chat_format(spark: SparkSession, root: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{hard}' AS text UNION ALL SELECT -7L, 1L, 'assistant', '{hard}'")
    out = chat.formatted(table(spark, root, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    turns = chat.turns_of(F.col("formatted"))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learnt = chat.loss_text(F.col("formatted"), F.col("loss"))
    back = out.select("conv_id", "formatted", F.size(turns).cast("long").alias("n_turns"), lines.alias("lines"), learnt.alias("learnt"))
    return back.select(
        "conv_id", "n_turns", F.sha2("lines", 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op3_neighbours(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings")
    return neighbours.nearest(rows, rows.filter("vec_id % 100 = 0"), k=10)


@query()
def op7_simhash(spark: SparkSession, root: str) -> DataFrame:
    found = simhash.grouped(table(spark, root, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query()
def op8_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    cut = lines.deduplicated(table(spark, root, "documents"))
    return cut.select("_row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("_row.text", F.lit("")), 256).alias("kept_sha256"))


@query()
def op4_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    return substring.deduplicated(table(spark, root, "documents"))


@query()
def op5_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, root, "documents"))


# the CRC-32 of a short text: one byte, then its eight shifts, at a time
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(c::VARCHAR, '')])),
  lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""


@query(f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 100 AS head, count(*) AS n, {_CRC} % 6 AS h FROM turns GROUP BY c),
given AS (SELECT a.c, a.head, a.h, least(a.h, coalesce(b.n, 0)) AS k FROM convs a LEFT JOIN convs b ON b.c = a.head),
rebuilt AS (
  SELECT g.c, t.i + 1 AS pos, role, text FROM given g JOIN turns t ON t.c = g.head AND t.i < g.k
  UNION ALL SELECT g.c, g.k + t.i - g.h + 1, role, text FROM given g JOIN turns t ON t.c = g.c AND t.i >= g.h
  UNION ALL SELECT c, 0, '', '' FROM convs),
paths AS (
  SELECT c, pos AS d, length(text) AS chars, pos = max(pos) OVER (PARTITION BY c) AS ends,
    sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, '' ) OVER (PARTITION BY c ORDER BY pos)) || pos AS k FROM rebuilt),
parents AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up FROM paths),
nodes AS (
  SELECT k, min(c) AS c, any_value(d) AS d, any_value(up) AS up, count(*) AS n, any_value(chars) AS chars,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM parents GROUP BY k),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up),
below AS (
  SELECT p.k, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((a.n - 1) * a.chars) AS saved
  FROM nodes a JOIN paths p ON p.c = a.c AND p.d <= a.d LEFT JOIN kids ON kids.up = a.k GROUP BY p.k)
SELECT a.c AS conv_id, a.d::BIGINT AS depth, b.c AS parent_conv_id, a.n AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, a.ends_sha256
FROM nodes a LEFT JOIN nodes b ON b.k = a.up LEFT JOIN kids ON kids.up = a.k JOIN below ON below.k = a.k""")
def op11_conversation_trie(spark: SparkSession, root: str) -> DataFrame:
    return trie.trie(table(spark, root, "conversations"))


@query()
def op12_embedding_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return descent.linked(table(spark, root, "embeddings"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query(f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(t) AS term FROM docs) GROUP BY r, doc_id, term),
sizes AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
every AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
freq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT item_id, term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM asked JOIN freq USING (term), every),
scores AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM w JOIN tf USING (term) JOIN sizes USING (r), every GROUP BY item_id, r),
best AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM best WHERE rank <= 10""")
def op13_lexical_search(spark: SparkSession, root: str) -> DataFrame:
    return lexical.search(table(spark, root, "documents"), table(spark, root, "benchmark"))
