"""Chat formatting: root-to-leaf paths of reply trees by repeated self-joins, the best branches
as conversations with a loss mask. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage

#: Replacements inside texts and roles, in this order; read back in reverse. No "<" or "[" is
#: left, so neither the marks of this template nor those of others occur in a text.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"), ("\n", "&#10;")]
IN_TEXT = ESCAPES[:3]
END = "<|end|>\n"


def escaped(c: Column, pairs=tuple(IN_TEXT)) -> Column:
    for raw, safe in pairs:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescaped(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def as_chain(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(tree, node, parent, role, text, score) of plain conversations: each row replies to the
    row before it by turn. Rows of one turn go by role, then text."""
    base = rows.select(F.col(f"`{conv_id}`").alias("tree"), F.col(f"`{turn}`").alias("turn"),
                       F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return base.withColumn("node", F.row_number().over(order).cast("long")).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def tree_paths(messages: DataFrame) -> DataFrame:
    """(tree, root, leaf, path, score) for each leaf of (tree, node, parent, score): the nodes
    from the root down, and the sum of their scores.

    A node starts with the path to its parent; each self-join puts the parent's path before
    it, so the known length doubles and a depth of n takes log2(n) joins. A parent that
    does not exist makes its node a root. Nodes on a reply cycle or under one have no root
    and no path.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")).where("node is not null")
    nodes = nodes.dropDuplicates(["tree", "node"])
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))  # noqa: E731  null is a tree of its own
    parts = nodes.join(known, same("tree", "t") & (F.col("parent") == F.col("p")), "left").select(
        "tree", "node", F.array("node").alias("path"), F.col("p").alias("up"), "score")
    parts = cut_lineage(parts, "paths")
    while not parts.where("up is not null").isEmpty():
        above = parts.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("path").alias("head"),
                             F.col("up").alias("next"), F.col("score").alias("more"))
        longer = parts.where("up is not null").join(above, same("tree", "t") & (F.col("up") == F.col("n"))).select(
            "tree", "node", F.concat("head", "path").alias("path"), F.col("next").alias("up"), (F.col("score") + F.col("more")).alias("score"))
        longer = longer.where(F.size(F.array_distinct("path")) == F.size("path"))
        parts = cut_lineage(parts.where("up is null").union(longer), "paths")
    inner = nodes.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("n")).distinct()
    leaves = parts.join(inner, same("tree", "t") & (F.col("node") == F.col("n")), "left_anti")
    return leaves.select("tree", F.col("path")[0].alias("root"), F.col("node").alias("leaf"), "path", "score")


def format_branches(messages: DataFrame, top: int = 1, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per chosen branch of (tree, node, parent, role, text, score): tree, root, branch,
    formatted, loss_spans.

    Branches of a root are ranked by their score, the highest first, then by their path, and
    the first ``top`` are kept. ``formatted`` marks each turn as ``<|role|>``, line feed, text,
    ``<|end|>``, line feed; control strings in texts are escaped (see ESCAPES). loss_spans are the
    code point ranges (end exclusive) of the texts of ``loss_roles`` in ``formatted``.

    Null roles and texts are empty, a null score is 0, a null tree is one tree. Repeated
    (tree, node) rows: one of them is used. Rows without a node are left out. No rows give
    no rows. A branch is one row, so it must fit in memory; its neighbours need not.
    """
    rank = Window.partitionBy("tree", "root").orderBy(F.desc("score"), "path")
    best = tree_paths(messages).withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= top)
    steps = best.select("tree", "root", "branch", F.posexplode("path").alias("pos", "node"))
    texts = messages.where("node is not null").dropDuplicates(["tree", "node"]).select(
        F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = steps.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(
        "tree", "root", "branch", "pos", F.col("role").isin(list(loss_roles)).alias("loss"),
        F.concat(F.lit("<|"), escaped(F.col("role"), tuple(ESCAPES)), F.lit("|>\n")).alias("head"), escaped(F.col("text")).alias("body"))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END))).withColumn("size", F.char_length("piece").cast("long"))
    so_far = Window.partitionBy("tree", "root", "branch").orderBy("pos")
    start = F.sum("size").over(so_far) - F.col("size") + F.char_length("head")
    placed = turns.withColumn("start", start).select(
        "tree", "root", "branch", F.struct("pos", "piece", "loss", "start", (F.col("start") + F.char_length("body")).alias("end")).alias("turn"))
    ordered = placed.groupBy("tree", "root", "branch").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return ordered.select(
        "tree", "root", "branch", F.array_join(F.transform("turns", lambda t: t.piece), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.loss), lambda t: F.struct(t.start.alias("start"), t.end.alias("end"))).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from the formatted text."""
    parts = F.split(formatted, r"<\|end\|>\n")
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.struct(
        unescaped(F.regexp_extract(p, r"^<\|([^|]*)\|>\n", 1)).alias("role"),
        unescaped(F.regexp_replace(p, r"^<\|[^|]*\|>\n", "")).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")


def conversation_digests(branches: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back
    from ``format_branches``."""
    read = branches.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))
