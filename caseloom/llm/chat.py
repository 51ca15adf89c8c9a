"""Reply trees as training conversations, with DataFrame functions only.

A tree's messages point to their parents. Root-to-leaf paths come from self-joins by pointer doubling: after k rounds
each leaf has its nearest 2**k ancestors, so a tree of depth d takes log2(d) rounds. Branches are ranked by the sum of
their messages' scores, and each chosen path is written as one conversation in this template:

    <|im_start|>role\\ntext<|im_end|>\\n   for each message

Inside texts, a backslash is doubled and a control string gets a backslash after its first character, so that no
control string is left; `unescaped` takes both back. A line break in a role becomes a backslash and n (or r). Loss spans
mark the texts of one role.

Cases: a null text or role is empty; a null tree id is a tree like any other; rows without a message id can't be placed
and are left out; a parent that is null, the message itself or
missing makes a root; messages on a cycle belong to no leaf and are left out; ties in score go to the smaller leaf;
rows that repeat a message's id count once (the smallest role and text); an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.text import let, running_sums
from caseloom.llm.common import saved

START, STOP = "<|im_start|>", "<|im_end|>"
#: Strings that chat models read as marks.
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<<SYS>>", "<</SYS>>", "</s>", "<s>", "[INST]", "[/INST]"]
_FIND = r"([<\[])(\|im_start\|>|\|im_end\|>|\|endoftext\|>|<SYS>>|</SYS>>|/s>|s>|INST\]|/INST\])"


def escaped(text: Column) -> Column:
    """The text without control strings; null becomes empty."""
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, _FIND, r"$1\\$2")


def escaped_role(role: Column) -> Column:
    """An escaped role in one line."""
    return F.regexp_replace(F.regexp_replace(escaped(role), "\n", r"\\n"), "\r", r"\\r")


def unescaped_role(role: Column) -> Column:
    for letter, sign in (("n", "\n"), ("r", "\r")):
        role = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\" + letter, "$1" + sign)
    return unescaped(role)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def paths(messages: DataFrame, tree: str = "tree_id", node: str = "msg_id", parent: str = "parent_id") -> DataFrame:
    """tree, leaf, node, hops: every message on the way from each leaf (hops 0) up to its root."""
    all_ = messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("up")).distinct()
    known = all_.select("tree", F.col("node").alias("up")).distinct()
    step = saved(all_.filter("up <> node").join(known, ["tree", "up"]).select("tree", "node", "up"), "chat-step")
    leaves = all_.select("tree", "node").distinct().join(step.select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    got = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("hops"))
    most = all_.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    reach = 1
    while reach < most and not step.isEmpty():
        far = got.join(step, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("hops") + reach).alias("hops"))
        got = saved(got.unionByName(far), "chat-paths")
        further = step.select("tree", F.col("node").alias("_from"), F.col("up").alias("node")).join(step, ["tree", "node"])
        step = saved(further.select("tree", F.col("_from").alias("node"), "up"), "chat-step")
        reach *= 2
    return got


def format_trees(messages: DataFrame, tree: str = "tree_id", node: str = "msg_id", parent: str = "parent_id", role: str = "role", text: str = "text", score: str | None = "score", best: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """tree, leaf, path_rank, path_score, n_turns, formatted, loss_spans (start, length in code points). best: paths a tree."""
    flat = messages.select(
        F.struct(F.col(tree).alias("id")).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("up"),  # a struct joins on null, too
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"),
    )
    once = flat.filter("node is not null").groupBy("tree", "node").agg(F.min(F.struct("role", "text", "up", "score")).alias("m")).select("tree", "node", "m.*")
    ways = paths(once, "tree", "node", "up")
    ranked = ways.join(once.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("path_score"))
    ranked = ranked.withColumn("path_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    if best is not None:
        ranked = ranked.filter(F.col("path_rank") <= best)
    chosen = ways.join(ranked.select("tree", "leaf"), ["tree", "leaf"])
    turns = chosen.join(once.select("tree", "node", "role", "text"), ["tree", "node"])
    written = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("at"), F.col("role").alias("role"), escaped(F.col("text")).alias("text")))).alias("t"))
    head = lambda x: F.concat(F.lit(START), escaped_role(x["role"]), F.lit("\n"))
    whole = lambda x: F.concat(head(x), x["text"], F.lit(STOP + "\n"))
    starts = running_sums(F.transform("t", lambda x: F.length(whole(x))))  # once a path, so the time grows with its turns
    spans = let(starts, lambda at: F.transform("t", lambda x, i: F.struct(x["role"].alias("role"), (F.get(at, i) + F.length(head(x))).alias("start"), F.length(x["text"]).alias("length"))))
    out = written.select(
        "tree", "leaf", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", whole), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["role"] == loss_role), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
    )
    return out.join(ranked, ["tree", "leaf"]).select(F.col("tree.id").alias(tree), F.col("leaf").alias("leaf"), "path_rank", "path_score", "n_turns", "formatted", "loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted conversation holds: array of (role, text), unescaped."""
    pieces = F.split(formatted, "<\\|im_end\\|>\n", -1)
    bodies = F.slice(pieces, 1, F.size(pieces) - 1)
    cut = F.transform(bodies, lambda p: F.struct(F.instr(p, "\n").alias("n"), p.alias("p")))
    return F.transform(cut, lambda x: F.struct(
        unescaped_role(F.substring(x["p"], F.lit(len(START) + 1), x["n"] - len(START) - 1)).alias("role"),
        unescaped(F.substring(x["p"], x["n"] + 1, F.length(x["p"]))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["length"]))), "")
