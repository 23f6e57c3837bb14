"""Best-fit packing planned on the length histogram.

The driver sees one count per length (at most ``capacity`` of them), never a document. It places
whole runs of equal lengths, best fit first, and writes the plan as rank ranges: documents of a
length whose rank lies in [first, last] take consecutive sequences at one offset. Documents then
find their slot by joining on (length, rank).

Nulls and empty texts are documents of the end id alone. Repeated rows are packed as often as they
occur. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.common import keep, ranked

CAPACITY = 4096
END_ID = 1  # fixed value: the id after each document
BLOCK_BYTES = 2 << 20  # texts looked up together: cut at the text that reaches so many bytes
CACHED_BYTES = 16 << 20  # chunks and ids that a Python worker remembers
POINTS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # fixed value: one run of them is one word to the tokenizer
LATIN = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"  # fixed value: letters that stay single letters when normalized
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

_tokenizers: dict = {}
_known: dict = {}


class Spans(NamedTuple):
    """Entry k stands for ``length[k]`` of ``ids`` from ``first[k]`` on."""

    first: np.ndarray
    length: np.ndarray
    ids: np.ndarray

    def take(self, entries: np.ndarray) -> Spans:
        """The ids of ``entries``, one after the other."""
        length = self.length[entries]
        first = np.cumsum(length) - length
        return Spans(first, length, self.ids[np.repeat(self.first[entries] - first, length) + np.arange(length.sum())])

    def plus(self, other: Spans) -> Spans:
        """The entries of both."""
        return Spans(np.concatenate([self.first, other.first + len(self.ids)]), np.concatenate([self.length, other.length]), np.concatenate([self.ids, other.ids]))


def _spans(parts: list[np.ndarray]) -> Spans:
    """An entry for each of ``parts``."""
    length = np.array([len(p) for p in parts], np.int64)
    return Spans(np.cumsum(length) - length, length, np.concatenate([np.empty(0, "<u4"), *parts]))


def _tokenizer(path: str):
    """The tokenizer, the same for lower-case words of ``LATIN``, per id whether its token ends a word, and the strings that are tokens wherever they stand."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer, pre_tokenizers

        made = Tokenizer.from_file(path)
        latin = Tokenizer(made.model)  # one model; nothing to normalize, words are cut at blanks
        latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        special = [t.content.lower() for t in made.get_added_tokens_decoder().values()]
        vocabulary = made.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        _tokenizers[path] = made, latin, ends, special
    return _tokenizers[path]


def _encoded(words: pa.Array, path: str) -> Spans:
    """Ids of words. Those of ``LATIN`` alone are encoded many at a time and cut where a token ends a word."""
    made, latin, ends, _ = _tokenizer(path)
    one_by_one = lambda texts: _spans([np.array(e.ids, "<u4") for e in made.encode_batch_fast(texts, add_special_tokens=False)])
    simple = pc.match_substring_regex(words, rf"\A[{LATIN}]+\z")
    lower, groups = pc.utf8_lower(words.filter(simple)).to_pylist(), []
    for at in range(0, len(lower), 500):
        group = lower[at : at + 500]
        ids = np.array(latin.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ends[ids]) + 1
        length = np.diff(cuts, prepend=0)
        groups.append(Spans(cuts - length, length, ids) if len(cuts) == len(group) else one_by_one(group))
    groups.append(one_by_one(words.filter(pc.invert(simple)).to_pylist()))
    length, ids = np.concatenate([g.length for g in groups]), np.concatenate([g.ids for g in groups])
    place = np.argsort(~simple.to_numpy(zero_copy_only=False), kind="stable")  # entry k of the groups is word place[k]
    found = Spans(np.empty(len(words), np.int64), np.empty(len(words), np.int64), ids)
    found.first[place], found.length[place] = np.cumsum(length) - length, length
    return found


def _learnt(chunks: pa.Array, path: str) -> Spans:
    """Ids of chunks. A chunk that ends in points after a letter of ``LATIN`` or a digit is two parts, as to the tokenizer."""
    stems = pc.utf8_rtrim(chunks, characters=POINTS)
    stems = pc.if_else(pc.match_substring_regex(stems, rf"[0-9{LATIN}]\z"), stems, chunks)
    over = pc.subtract(pc.binary_length(chunks), pc.binary_length(stems)).to_numpy(zero_copy_only=False)
    pointed = [np.flatnonzero(over == n) for n in np.unique(over[over > 0])]
    points = [pc.utf8_slice_codeunits(chunks.take(pa.array(at)), start=-int(over[at[0]])) for at in pointed]
    parts = pa.concat_arrays([stems, *points]).dictionary_encode()
    codes = parts.indices.to_numpy()
    seconds = np.zeros(len(chunks), np.int64)
    if pointed:
        seconds[np.concatenate(pointed)] = codes[len(chunks) :]
    n = 1 + (over > 0)
    at = np.cumsum(n) - n
    order = np.empty(n.sum(), np.int64)
    order[at] = codes[: len(chunks)]
    order[at[over > 0] + 1] = seconds[over > 0]
    each = _encoded(parts.dictionary, path).take(order)
    length = np.add.reduceat(each.length, at) if len(at) else each.length
    return Spans(np.cumsum(length) - length, length, each.ids)


def _looked_up(chunks: pa.Array, path: str) -> Spans:
    """Ids of different chunks. What a worker remembers is bounded in bytes; when full, it goes on with the chunks of this call."""
    known, spans = _known.get(path, (pa.array([], pa.string()), _spans([])))
    at = pc.fill_null(pc.index_in(chunks, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    new = np.flatnonzero(at < 0)
    fresh = chunks.take(pa.array(new))
    at[new] = len(known) + np.arange(len(new))
    known, spans = pa.concat_arrays([known, fresh]), spans.plus(_learnt(fresh, path))
    found = Spans(spans.first[at], spans.length[at], spans.ids)
    size = lambda known, spans: known.nbytes + sum(x.nbytes for x in spans)
    if size(known, spans) > CACHED_BYTES:
        known, spans = chunks, spans.take(at)
    _known[path] = (known, spans) if size(known, spans) <= CACHED_BYTES else (pa.array([], pa.string()), _spans([]))
    return found


def _strings(texts: pa.Array) -> pa.Array:
    try:
        return pc.fill_null(texts.cast(pa.string()), "")
    except pa.ArrowInvalid:  # not UTF-8
        return pa.array([(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def id_bytes(texts: pa.Array | list[bytes | None], path: str) -> Iterator[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers.

    Only for lower-casing tokenizers with word ends and byte-level tokens, whose tokens never hold or cross a blank or
    a line feed and keep letters and punctuation apart: a text is then the concatenation of its
    blank-separated chunks, less case. A text that holds the string of a special token, in any case, is
    encoded whole and as it is.
    """
    texts = pa.array(texts, pa.binary()) if isinstance(texts, list) else texts
    made, _, _, special = _tokenizer(path)
    block = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        text = _strings(texts[a:b])
        low = pc.ascii_lower(text)
        whole = np.zeros(b - a, bool)
        for s in special:
            whole |= pc.match_substring(low, s).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(whole), "", low), "\n", " "), " ")
        chunks = lists.flatten().dictionary_encode()
        spans = _looked_up(chunks.dictionary, path).take(chunks.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(spans.length)])[np.cumsum(pc.list_value_length(lists).to_numpy())].tolist()
        for k, (first, last) in enumerate(zip([0, *ends], ends)):
            yield np.array(made.encode(text[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes() if whole[k] else spans.ids[first:last].tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and cut: one row per piece of at most ``capacity`` ids (``PIECES``)."""

    def run(batches):
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for doc, data in zip(ids, id_bytes(batch.column(1), tokenizer)):
                data += end
                for k, at in enumerate(range(0, len(data) // 4, capacity)):
                    part = data[4 * at : 4 * (at + capacity)]
                    out.append((doc, k, at, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, last rank, first sequence, offset).

    Open sequences are kept as blocks of equal free space. A length goes to the block with the least
    space that still holds it; if the block has more sequences than the length has documents, it is
    split. Blocks and steps depend on the number of lengths, not on the number of documents.
    """
    free: list[int] = []  # free spaces that some block has, ascending
    blocks: dict[int, list[tuple[int, int]]] = {}  # free space -> [(first sequence, number)]
    slots, sequences = [], 0

    def put(space: int, first: int, number: int) -> None:
        if space and number:
            if space not in blocks:
                bisect.insort(free, space)
                blocks[space] = []
            blocks[space].append((first, number))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(free, length)
            if at == len(free):  # open as many sequences as this length fills on its own
                number = -(-left // (capacity // length))
                put(capacity, sequences, number)
                sequences += number
                continue
            space = free[at]
            first, number = blocks[space].pop()
            if not blocks[space]:
                del blocks[space], free[at]
            used = min(number, left)
            slots.append((length, rank, rank + used - 1, first, capacity - space))
            put(space, first + used, number - used)
            put(space - length, first, used)
            rank, left = rank + used, left - used
    return slots


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their ``sequence_id`` and gapless ``offset``."""
    spark = docs.sparkSession
    cut = keep(pieces(docs, tokenizer, capacity), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    slots = spark.createDataFrame(plan(histogram, capacity), "len long, first long, last long, sequence long, at long")
    placed = ranked(cut, ["length"], ["doc_id", "piece", "ids_crc32"])
    # the plan's size follows the number of lengths (at most `capacity`), so it is safe to broadcast
    return placed.join(
        F.broadcast(slots), (F.col("length") == F.col("len")) & F.col("rank").between(F.col("first"), F.col("last"))
    ).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("at").alias("offset"),
    )
