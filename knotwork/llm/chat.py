"""Chat formatting by prefix-target expansion.

A turn is written as ``### role: text</turn>`` and a line feed. Inside roles and texts the
characters that control strings need are escaped, so no control string can occur there and
reading back is exact. Every assistant turn is exploded into an example whose context is all
that stands before its text and whose text alone is trainable.

Turns stay rows: each holds its own piece of the conversation's string and the place where it
starts. An example's context is a prefix of that string, kept by its length; so the examples of
a conversation take room linear in it, and :func:`with_context` writes contexts out. Places are
sums over segments of a conversation's turn numbers and then over the few rows of its segments,
so tasks share a long conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
#: A control character and what stands for it; texts may hold colons, roles may not.
ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
BACK = {v[1]: k for k, v in ESCAPES.items()}
TURN = re.compile(r"### ([^:]*): ([^<]*)</turn>\n")
#: Turn numbers of a segment.
SEGMENT = 1024


def escape(text: str, role: bool = False) -> str:
    for plain, written in ESCAPES.items():
        if plain != ":" or role:
            text = text.replace(plain, written)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: BACK[m[1]], text) if "\\" in text else text


def _escaped(text: Column, role: bool = False) -> Column:
    for plain, written in ESCAPES.items():
        if plain != ":" or role:
            text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def format_chats(turns: DataFrame, train_on: str = "assistant", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: (conv_id, start long, piece, head int, loss int).

    ``piece`` is the turn in the template, ``start`` the number of characters before it in the
    conversation, ``head`` that of the piece before its text and ``loss`` that of its trainable
    text, null where the role is not ``train_on``. Turns go by number, null first, ties by role
    and text; all rows count, repeated ones too. A null role or text is empty; rows with a null
    id form one conversation. An empty table gives no rows. Other columns are not read.
    """
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    head = F.concat(F.lit(HEAD), _escaped(F.col("role"), True), F.lit(MIDDLE))
    rows = rows.withColumns({"segment": F.floor(F.col("turn") / SEGMENT), "before": head, "body": _escaped(F.col("text"))})
    rows = rows.withColumn("n", F.length("before") + F.length("body") + len(END))
    sums = rows.groupBy(F.col("conv_id").alias("c"), F.col("segment").alias("s")).agg(F.sum("n").alias("size"))
    sums = sums.select("c", "s", (F.sum("size").over(Window.partitionBy("c").orderBy("s")) - F.col("size")).alias("base"))
    within = Window.partitionBy("conv_id", "segment").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("at", F.sum("n").over(within) - F.col("n")).join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("segment").eqNullSafe(F.col("s")))
    loss = F.when(F.col("role") == train_on, F.length("body"))
    return placed.select("conv_id", (F.col("at") + F.col("base")).alias("start"), F.concat("before", "body", F.lit(END)).alias("piece"), F.length("before").alias("head"), loss.alias("loss"))


def _examples(start: Column, piece: Column, head: Column, loss: Column) -> Column:
    """Array of the turn's example, empty if it has none."""
    example = F.struct((start + head).alias("context_end"), F.substring(piece, head + 1, loss).alias("target"))
    return F.when(loss.isNull(), F.array().cast("array<struct<context_end:bigint,target:string>>")).otherwise(F.array(example))


def expand(formatted: DataFrame) -> DataFrame:
    """One row per example: (conv_id, context_end, target).

    The context is the first ``context_end`` characters of the conversation, by reference; only
    ``target`` (escaped, as in the template) is trainable. Turns without a loss give no example,
    repeated turns one each, an empty table none.
    """
    found = F.explode(_examples(*map(F.col, ("start", "piece", "head", "loss"))))
    return formatted.select("conv_id", found.alias("x")).select("conv_id", "x.context_end", "x.target")


def with_context(examples: DataFrame, formatted: DataFrame) -> DataFrame:
    """(conv_id, context, target): contexts written out, in room quadratic in a conversation."""
    turns = formatted.select(F.col("conv_id").alias("c"), "start", "piece")
    met = examples.withColumn("n", F.monotonically_increasing_id()).join(turns, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("start") < F.col("context_end")))
    part = F.struct("start", F.expr("left(piece, cast(least(context_end - start, length(piece)) as int))").alias("piece"))
    return met.groupBy("n", "conv_id", "target").agg(F.array_sort(F.collect_list(part)).alias("parts")).select("conv_id", F.array_join("parts.piece", "").alias("context"), "target")


def _read_back(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    current, state, m, start = None, None, None, 0
    for b in batches:
        done = []
        for conv, is_example, at, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "is_example", "at", "text")), strict=True):
            if state is not None and conv != current:
                done.append((current, *state))
                state = None
            if state is None:
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            if is_example:
                if at != start + m.start(2):
                    raise ValueError(f"an example of conversation {conv} does not follow its context")
                target = unescape(text)
                state[2] += len(target)
                state[3].update(target.encode())
                continue
            m, start = TURN.fullmatch(text), at
            if m is None or start != state[4]:
                raise ValueError(f"a turn of conversation {conv} is not in the template or not in its place")
            state[0] += 1
            state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            state[4] += len(text)
        yield _digests(done, b.schema.field("conv_id").type, kinds, names)
        kind = b.schema.field("conv_id").type
    if state is not None:
        yield _digests([(current, *state)], kind, kinds, names)


def _digests(done: list, kind, kinds: tuple, names: list):
    import pyarrow as pa

    rows = [(c, n, turns.hexdigest(), chars, loss.hexdigest(), size) for c, n, turns, chars, loss, size in done]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((kind, *kinds))], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from formatted conversations, one row each.

    ``turns_sha256`` is over role, line feed, text, line feed per turn; ``loss_*`` over the
    unescaped targets of the exploded examples in order, with nothing between. Each turn is
    parsed by the template and each example held against its place; what isn't in the template
    raises a ValueError. A digest runs over its conversation in order, so one task reads it, turn
    by turn, in memory for one batch. Repeated turns count each; a conversation without an
    assistant has the digest of nothing; an empty table gives no rows.
    """
    small_batches(formatted.sparkSession)
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "start")
    # each turn, and behind it its example, is a row of its own; made after the shuffle, in its order
    turn = F.struct(F.lit(False).alias("is_example"), F.col("start").alias("at"), F.col("piece").alias("text"))
    examples = F.transform(_examples(*map(F.col, ("start", "piece", "head", "loss"))), lambda e: F.struct(F.lit(True).alias("is_example"), e["context_end"].alias("at"), e["target"].alias("text")))
    rows = ordered.select("conv_id", F.explode(F.concat(F.array(turn), examples)).alias("x")).select("conv_id", "x.is_example", "x.at", "x.text")
    return rows.mapInArrow(_read_back, f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
