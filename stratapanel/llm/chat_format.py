"""Reply trees formatted as conversations, in DataFrame functions alone.

A message names its parent.  Ancestors are joined to themselves with doubling
distance, so a thread of n messages takes log2(n) self-joins; every leaf then
has its root, depth and summed score, branches are ranked by mean score inside
their root's tree, and only the chosen leaves' paths are enumerated, again by
the doubled ancestors.  One chosen path is one conversation.

Template: each turn is ``### role: text</turn>`` and a line feed.  Inside roles
and texts a backslash, ``#``, ``<`` and (roles) ``:`` are written as a backslash and
a letter, so no control string can occur in them and plain replacement undoes
it.  ``mask`` lists the code-point spans of the assistants' texts in the output.

Defined results: null roles and texts are empty; a parent that is missing (or
null) makes its message a root; messages on a cycle have no root and are left
out; repeated rows of ``threads`` input follow each other as turns of their own;
ties between branches go to the smaller leaf; no rows give no conversations;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stratapanel.llm.store import written

#: Written forms; the backslash comes first here and last when undone.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
END = "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    for plain, safe in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def threads(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations: every row answers the one before it (by turn, then role and text)."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    out = conversations.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("bigint").alias("node"), "role", "text")
    return out.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, root, leaf, rank, node, position) of the ``branches`` best paths of every root.

    ``messages``: tree, node (unique in its tree), parent, score.  A path's
    score is the mean score of its messages.
    """
    key = ["tree", "node"]
    nodes = written(messages.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c == "score" else F.col(c) for c in ("tree", "node", "parent", "score")]), "messages")
    known = nodes.select(F.col("tree").alias("t2"), F.col("node").alias("n2"))
    linked = nodes.join(known, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("parent") == F.col("n2")), "left")
    step = linked.select("tree", "node", F.col("n2").alias("up"), F.lit(1).cast("bigint").alias("n"), F.col("score").alias("total"), F.col("node").alias("top"))
    step = written(step, "jumps")
    done, pending = step.where("up IS NULL"), step.where("up IS NOT NULL")
    jumps, limit = [pending], nodes.count().bit_length() + 1
    while len(jumps) <= limit and not pending.isEmpty():  # those left on a cycle never end
        # Only messages whose root is not reached yet are joined again.
        far = done.unionByName(pending).select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("n").alias("m2"), F.col("total").alias("s2"), F.col("top").alias("top2"))
        joined = pending.join(far, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("up") == F.col("n2")))
        step = written(joined.select(*key, F.col("up2").alias("up"), (F.col("n") + F.col("m2")).alias("n"), (F.col("total") + F.col("s2")).alias("total"), F.col("top2").alias("top")), "jumps")
        done, pending = done.unionByName(step.where("up IS NULL")), step.where("up IS NOT NULL")
        jumps.append(pending)
    answered = nodes.where("parent IS NOT NULL").select(F.col("tree").alias("t2"), F.col("parent").alias("n2")).distinct()
    leaves = done.join(answered, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")), "left_anti")
    rank = F.row_number().over(W.partitionBy("tree", "top").orderBy(F.desc(F.col("total") / F.col("n")), "node"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= branches)
    rows = chosen.select("tree", F.col("top").alias("root"), F.col("node").alias("leaf"), "rank", "node", F.col("n").alias("position"))
    for k in range(len(jumps) - 1, -1, -1):  # distances as sums of falling powers of two: each ancestor once
        far = jumps[k].select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "up")
        higher = rows.join(far, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")))
        rows = rows.unionByName(higher.select("tree", "root", "leaf", "rank", F.col("up").alias("node"), (F.col("position") - (1 << k)).alias("position")))
        rows = written(rows, "paths")
    return rows


def formatted(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, root, leaf, rank, formatted, mask) of every chosen path.

    ``mask``: (start, length) of each assistant text in code points of ``formatted``.
    """
    paths = best_paths(messages, branches)
    texts = messages.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(texts, F.col("tree").eqNullSafe(F.col("t2")) & (F.col("node") == F.col("n2")))
    head, body = F.concat(F.lit("### "), escaped(F.col("role"), role=True), F.lit(": ")), escaped(F.col("text"))
    turns = turns.select("tree", "root", "leaf", "rank", "position", (F.col("role") == "assistant").alias("taught"), head.alias("head"), body.alias("body"))
    size = F.length("head").cast("bigint") + F.length("body") + len(END)
    path = W.partitionBy("tree", "root", "leaf").orderBy("position")
    before = F.coalesce(F.sum(size).over(path.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    turns = turns.withColumn("start", before + F.length("head"))
    span = F.when(F.col("taught"), F.struct(F.col("start").alias("start"), F.length("body").cast("bigint").alias("length")))
    one = F.struct("position", F.concat("head", "body", F.lit(END)).alias("turn"), span.alias("span"))
    grouped = turns.groupBy("tree", "root", "leaf", "rank").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return grouped.select(
        "tree", "root", "leaf", "rank", F.array_join(F.transform("turns", lambda x: x["turn"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda x: x["span"]), lambda x: x.isNotNull()).alias("mask"))


def read_back(output: DataFrame) -> DataFrame:
    """(tree, turns, loss) from ``formatted`` and ``mask`` alone: the (role, text) turns and the taught texts joined."""
    pieces = F.split("formatted", END)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.struct(
        unescaped(F.substr(x, F.lit(5), F.instr(x, F.lit(":")) - 5)).alias("role"),
        unescaped(F.substr(x, F.instr(x, F.lit(":")) + 2)).alias("text")))
    taught = F.transform("mask", lambda m: unescaped(F.substr("formatted", (m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return output.select("*", turns.alias("turns"), F.array_join(taught, "").alias("loss"))
