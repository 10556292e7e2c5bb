"""Reply trees: root-to-leaf paths by iterative self-joins, ranked by score, each formatted as one chat.

The joins double: a node that knows its 2^k-th ancestor joins that one's row and so knows the 2^(k+1)-th,
with the score in between. A thread of depth d takes log2(d) joins, over as many rows as there are
messages. Only the chosen leaves are then expanded, again by doubling, so what is written grows with
the output. State between the joins lies in checkpoints.

Template: ``### role: text</turn>`` and a newline for each turn. The marks are escaped inside roles and
texts, so a chat can be read back exactly.

Defined results: a NULL role or text counts as empty. A message whose parent is missing is a root.
Messages that lead into a cycle have no root and are left out. Ties in a branch's score go to the
smaller leaf. Repeated rows of a conversation are turns of their own, ordered by turn, role and text.
A NULL conversation id is one conversation. A chat is one row, so it has to fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolelens.llm.text import let, prefix_sums
from rolelens.session import ensure_checkpoint_dir

HEAD, SEP, END = "### ", ": ", "</turn>"
#: What may not stand inside a text, and what stands for it; the backslash comes first.
_ESCAPES = (("\\", "\\b"), ("###", "\\h"), (END, "\\e"))
_ROLE_ESCAPES = (*_ESCAPES, (":", "\\c"))


def escape(c: Column, pairs=_ESCAPES) -> Column:
    for mark, code in pairs:
        c = F.replace(c, F.lit(mark), F.lit(code))
    return c


def unescape(c: Column, pairs=_ESCAPES) -> Column:
    """The inverse: every backslash of an escaped text starts one of the codes."""
    for mark, code in reversed(pairs):
        c = F.replace(c, F.lit(code), F.lit(mark))
    return c


def thread_messages(conversations: DataFrame) -> DataFrame:
    """A conversation's rows as a reply chain: conv_id, node, parent, role, text, score.

    ``conversations`` has conv_id, turn, role, text.
    """
    own = conversations.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("node"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "node")
    return own.select(
        "conv_id", "node", F.lag("node").over(order).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def _jumps(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """For k = 0, 1, ...: node and its 2^k-th ancestor, where it has one; and per node its path's depth and score."""
    known = nodes.select(F.col("node").alias("parent"))
    state = nodes.select("node", "score", "parent").join(known, "parent", "left_semi")
    roots = nodes.select("node", "score").join(state.select("node"), "node", "left_anti")
    # up: the next ancestor not yet summed; a node that has none is done
    one = F.lit(1).cast("long").alias("depth")
    open_ = state.select("node", F.col("parent").alias("up"), "score", one).checkpoint()
    done = roots.select("node", F.lit(None).cast("long").alias("up"), "score", one).checkpoint()
    total = open_.count() + done.count()
    jumps, reach = [], 1
    while reach < 2 * total and not open_.isEmpty():
        jumps.append(open_.select("node", "up"))
        above = open_.unionByName(done).select(
            F.col("node").alias("up"), F.col("up").alias("next"),
            F.col("score").alias("more"), F.col("depth").alias("deeper"),
        )
        state = (
            open_.join(above, "up")
            .select(
                "node", F.col("next").alias("up"),
                (F.col("score") + F.col("more")).alias("score"), (F.col("depth") + F.col("deeper")).alias("depth"),
            )
            .checkpoint()
        )
        done = done.unionByName(state.where("up IS NULL"))
        open_ = state.where("up IS NOT NULL")
        reach *= 2
    return jumps, done.select("node", "score", "depth")


def reply_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Root-to-leaf paths, best score first: conv_id, leaf, branch (rank from 1), score, turns.

    ``messages`` has conv_id, node (unique), parent, role, text, score; a path's score is the sum of its
    messages'. ``branches`` keeps the best paths of each conversation, by default all of them. ``turns``
    is an array of {at, role, text} from the root on.
    """
    ensure_checkpoint_dir(messages.sparkSession)
    nodes = messages.select("conv_id", "node", "parent", "role", "text", "score").checkpoint()
    jumps, summed = _jumps(nodes)
    parents = nodes.select(F.col("parent").alias("node")).where("node IS NOT NULL")
    leaves = (
        nodes.select("conv_id", F.col("node"))
        .join(parents, "node", "left_anti")
        .join(summed, "node")
        .withColumnRenamed("node", "leaf")
    )
    rank = Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")
    leaves = leaves.withColumn("branch", F.row_number().over(rank))
    if branches is not None:
        leaves = leaves.where(F.col("branch") <= branches)
    leaves = leaves.checkpoint()
    path = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))
    for k, jump in enumerate(jumps):
        higher = path.join(jump, "node").select("leaf", F.col("up").alias("node"), (F.col("above") + 2**k).alias("above"))
        path = path.unionByName(higher).checkpoint()
    turns = (
        path.join(nodes.select("node", "role", "text"), "node")
        .groupBy("leaf")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("above")).alias("at"), "role", "text"))).alias("turns"))
    )
    return leaves.join(turns, "leaf").select("conv_id", "leaf", "branch", "score", "turns")


def format_chats(paths: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``, the places {start, end} of the assistant's texts in it."""

    def heads(turns: Column) -> Column:
        return F.transform(
            turns,
            lambda t: F.struct(
                F.concat(F.lit(HEAD), escape(t["role"], _ROLE_ESCAPES), F.lit(SEP)).alias("head"),
                escape(t["text"]).alias("body"),
                (t["role"] == "assistant").alias("loss"),
            ),
        )

    def written(parts: Column) -> Column:
        tail = F.lit(END + "\n")
        sizes = F.transform(parts, lambda p: F.char_length(F.concat(p["head"], p["body"], tail)).cast("long"))
        return F.struct(
            F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], tail)), "").alias("formatted"),
            let(sizes, lambda s: let(prefix_sums(s), lambda ends: _spans(parts, ends))).alias("loss_spans"),
        )

    def _spans(parts: Column, ends: Column) -> Column:
        def span(p, i):
            end = F.get(ends, i) - len(END) - 1
            return F.struct(p["loss"].alias("loss"), (end - F.char_length(p["body"])).alias("start"), end.alias("end"))

        own = F.filter(F.transform(parts, span), lambda s: s["loss"])
        return F.transform(own, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    chats = paths.withColumn("_chat", let(heads(F.col("turns")), written))
    return chats.select(*paths.columns, "_chat.formatted", "_chat.loss_spans")


def read_chats(chats: DataFrame) -> DataFrame:
    """Reads ``formatted`` and ``loss_spans`` back: adds ``read_turns`` {role, text, loss}."""

    def turn(segment: Column, start: Column, spans: Column) -> Column:
        at = F.instr(segment, F.lit(SEP))
        head = F.substring(segment, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)
        body = F.substring(segment, at + len(SEP), F.char_length(segment))
        return F.struct(
            unescape(head, _ROLE_ESCAPES).alias("role"),
            unescape(body).alias("text"),
            F.array_contains(spans, start + at + len(SEP) - 1).alias("loss"),
        )

    def turns(segments: Column) -> Column:
        sizes = F.transform(segments, lambda s: (F.char_length(s) + len(END) + 1).cast("long"))
        starts = F.transform("loss_spans", lambda s: s["start"])
        return let(
            sizes,
            lambda n: let(
                prefix_sums(n),
                lambda ends: F.transform(
                    segments,
                    lambda s, i: turn(s, F.get(ends, i) - F.char_length(s) - len(END) - 1, starts),
                ),
            ),
        )

    parts = F.split("formatted", END + "\n")
    segments = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return chats.withColumn("read_turns", let(segments, turns))


def digests(chats: DataFrame) -> DataFrame:
    """Per chat, as read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    said = F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.transform(F.filter("read_turns", lambda t: t["loss"]), lambda t: t["text"])
    loss = F.array_join(learned, "")
    return read_chats(chats).select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
