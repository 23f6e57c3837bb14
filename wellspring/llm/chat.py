"""Chat formatting with Spark expressions only: turns to one training text with its loss mask, and back.

A conversation's turns are collected as structs, sorted by (turn, role, text), adjacent turns of one
role are merged into a block by folding the array, and blocks are concatenated:

    <s>[ROLE]role[/ROLE][TURN]text[TURN]text</s>

Every control string starts with ``<`` or ``[``. Roles and texts have these and the escape sign
replaced, so they never hold a control string, and the replacement can be undone exactly. The loss
mask is a list of (start, length) in code points over the assistant's texts in the formatted text.

Null texts are empty, null roles are the empty role, null turns come first, rows without a conv_id
form one conversation. Repeated rows are turns of their own. Empty tables give empty results, and
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.functions.arrays import let

# Fixed values of the template: escape sign with its codes, then the control strings.
CODES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))
BEGIN, ROLE, ROLE_END, TURN, END = "<s>", "[ROLE]", "[/ROLE]", "[TURN]", "</s>"
LEARNT = "assistant"
STRETCH = 64  # spans that are read from one stretch of the text


def escape(text: Column) -> Column:
    for sign, code in CODES:
        text = F.replace(text, F.lit(sign), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for sign, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def _merged(turns: Column) -> Column:
    """Adjacent turns of one role as one block: (role, texts)."""
    places = F.filter(
        F.sequence(F.lit(1), F.size(turns)),
        lambda i: (i == 1) | (F.element_at(turns, F.greatest(i - 1, F.lit(1))).role != F.element_at(turns, i).role),
    )

    def blocks(starts: Column) -> Column:
        def block(first: Column, k: Column) -> Column:
            last = F.coalesce(F.try_element_at(starts, k + 2) - 1, F.size(turns))
            return F.struct(
                F.element_at(turns, first).role.alias("role"),
                F.transform(F.slice(turns, first, last - first + 1), lambda t: t.text).alias("texts"),
            )

        return F.transform(starts, block)

    return F.when(F.size(turns) > 0, let(places, blocks))


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, ``formatted`` text and ``loss`` spans of every conversation in ``rows`` (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    blocks = turns.select("conv_id", _merged(F.col("turns")).alias("blocks"))
    # pieces of the output in order; `learn` marks those under the loss mask
    piece = lambda text, learn: F.struct(text.alias("text"), learn.alias("learn"))
    no = F.lit(False)
    of_block = lambda b: F.concat(
        F.array(piece(F.concat(F.lit(BEGIN + ROLE), escape(b.role), F.lit(ROLE_END)), no)),
        F.flatten(F.transform(b.texts, lambda t: F.array(piece(F.lit(TURN), no), piece(escape(t), b.role == LEARNT)))),
        F.array(piece(F.lit(END), no)),
    )
    pieces = blocks.select("conv_id", F.posexplode(F.flatten(F.transform("blocks", of_block))).alias("pos", "piece"))
    # a piece starts where the earlier ones end; rows stay on the task of their conversation
    earlier = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("piece.text").cast("long")
    placed = pieces.select("conv_id", "pos", "piece.*", size.alias("length"), F.coalesce(F.sum(size).over(earlier), F.lit(0).cast("long")).alias("start"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text", "learn", "start", "length"))).alias("pieces"))
    spans = F.transform(F.filter("pieces", lambda p: p.learn), lambda p: F.struct(p.start.alias("start"), p.length.alias("length")))
    return whole.select("conv_id", F.array_join("pieces.text", "").alias("formatted"), spans.alias("loss"))


def turns_of(text: Column) -> Column:
    """The (role, text) structs that ``formatted`` was made of, read from the text alone."""
    blocks = F.slice(F.split(text, BEGIN), 2, 1_000_000_000)
    def read(block: Column) -> Column:
        parts = F.split(F.replace(block, F.lit(END), F.lit("")), r"\[/ROLE\]")
        role = unescape(F.replace(parts[0], F.lit(ROLE), F.lit("")))
        texts = F.slice(F.split(parts[1], r"\[TURN\]"), 2, 1_000_000_000)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, read))


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined. Spans are cut from a stretch of ``STRETCH`` spans, since a cut counts code points from the start."""

    def cut_all(stretch: Column) -> Column:
        from_ = F.element_at(stretch, 1).start
        last = F.element_at(stretch, -1)
        part = F.substring(text, (from_ + 1).cast("int"), (last.start + last.length - from_).cast("int"))
        cut = lambda whole: F.transform(stretch, lambda s: F.substring(whole, (s.start - from_ + 1).cast("int"), s.length.cast("int")))
        return let(part, lambda whole: F.array_join(F.transform(cut(whole), unescape), ""))

    firsts = F.sequence(F.lit(1), F.size(spans), F.lit(STRETCH))
    stretches = F.when(F.size(spans) > 0, F.transform(firsts, lambda k: F.slice(spans, k, STRETCH)))
    return F.coalesce(F.array_join(F.transform(stretches, lambda s: let(s, cut_all)), ""), F.lit(""))
