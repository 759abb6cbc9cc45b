"""Chat formatting of reply trees, read back without loss."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

#: Control strings of the template and of usual chat formats: a first character and what follows. In a text, any run of backslashes
#: between the two is made longer by one, and shorter again on reading, so no text holds a control string and none is lost.
CONTROL = r"([<\[])(\\*)(\||/?s>|/?SYS>>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?SYS>>|/?INST\])"
END = "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


#: What stands in a role for characters that could end it or begin a control string. The sign of the marks itself comes first.
MARKS = {"%": "%25", "|": "%7C", "\n": "%0A", "<": "%3C", "[": "%5B"}


def _role(role: Column) -> Column:
    """A role on one line, without the strings that end it and without control strings."""
    return reduce(lambda c, ab: F.replace(c, F.lit(ab[0]), F.lit(ab[1])), MARKS.items(), role)


def _unrole(role: Column) -> Column:
    # The sign itself comes last, so that what it brings back isn't read as a mark.
    return reduce(lambda c, ab: F.replace(c, F.lit(ab[1]), F.lit(ab[0])), reversed(MARKS.items()), role)


def root_to_leaf(messages: DataFrame, most_paths: int | None = None) -> DataFrame:
    """messages (tree, node, parent, score) to (tree, leaf, rank, node, depth), depth 0 at the root: the paths of the reply trees.

    Self-joins double the reach of every leaf: in round k each known ancestor of a leaf is joined with its own ancestor 2^k steps up, so a
    path of d messages takes log2(d) rounds. Paths are ranked within their tree by the sum of their scores, then by leaf. most_paths keeps
    the best of each tree (a top-k, the operator's feature); None keeps all. A parent that isn't in the tree makes a root. Null scores
    count as 0. Cycles have no root, so neither they nor what hangs below them have a path. Of rows that repeat a node one must be chosen
    before.

    The jumps come first: which node is 2^k steps above a node. If as many nodes have a jump of 2^(k+1) as have one of 2^k, none has a depth
    between, so none has a larger one, and all that are left are on or below cycles; so cycles never cost more rounds than paths do.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    inner = nodes.select("tree", F.col("parent").alias("node")).filter("node is not null").distinct()
    jumps = [cut(nodes.join(nodes.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up")))]
    counts, cyclic = [jumps[0].count()], None
    while counts[-1]:
        then = jumps[-1].select("tree", F.col("node").alias("up"), F.col("up").alias("upper"))
        jumps.append(cut(jumps[-1].join(then, ["tree", "up"]).select("tree", "node", F.col("upper").alias("up"))))
        counts.append(jumps[-1].count())
        if counts[-1] == counts[-2]:
            cyclic = jumps[-1].select("tree", "node")
            break
    # A hot tree is many (tree, node) keys, so its rows spread over the tasks.
    leaves = nodes.join(inner, ["tree", "node"], "left_anti")
    leaves = leaves if cyclic is None else leaves.join(cyclic, ["tree", "node"], "left_anti")
    reach = cut(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("height")))
    for k, (jump, n) in enumerate(zip(jumps, counts)):
        if n:
            higher = reach.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("height") + (1 << k)).alias("height"))
            reach = cut(reach.unionByName(higher))
    scored = reach.join(nodes.select("tree", "node", "score"), ["tree", "node"])
    paths = scored.groupBy("tree", "leaf").agg(F.max("height").alias("top"), F.sum("score").alias("path_score"))
    paths = paths.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    if most_paths is not None:
        paths = paths.filter(F.col("rank") <= most_paths)
    return reach.join(paths, ["tree", "leaf"]).select("tree", "leaf", "rank", "node", (F.col("top") - F.col("height")).alias("depth"))


def formatted(turns: DataFrame) -> DataFrame:
    """(path, depth, role, text) to one row per path: path, conversation, loss: array of (start, length) in code points, from 1.

    A conversation is one row, so its turns meet in one task by nature. The mask covers each assistant text and no mark of the template.
    """
    head = F.concat(F.lit("<|"), _role(F.coalesce(F.col("role"), F.lit(""))), F.lit("|>\n"))
    body = escape(F.coalesce(F.col("text"), F.lit("")))
    row = F.struct(F.col("depth"), head.alias("head"), body.alias("body"), (F.coalesce(F.col("role"), F.lit("")) == "assistant").alias("loss"))
    got = turns.select("path", row.alias("t")).groupBy("path").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    got = got.select("path", F.transform("ts", lambda t: F.concat(t.head, t.body, F.lit(END))).alias("parts"), F.transform("ts", lambda t: F.struct((F.length(t.head)).alias("h"), F.length(t.body).alias("b"), t.loss.alias("loss"))).alias("sizes"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate("sizes", start, lambda a, s: F.struct((a["at"] + s["h"] + s["b"] + len(END)).alias("at"), F.when(s["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + s["h"]).cast("int").alias("start"), s["b"].cast("int").alias("length"))))).otherwise(a["spans"]).alias("spans")), lambda a: a["spans"])
    return got.select("path", F.array_join("parts", "").alias("conversation"), spans.alias("loss"))


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds turns: array of (role, text) and loss_texts: array of text, both read from the formatted text and its mask alone."""
    parts = F.filter(F.split("conversation", r"<\|end\|>\n"), lambda p: p != "")
    turn = lambda p: F.struct(_unrole(F.regexp_extract(p, r"(?s)^<\|(.*?)\|>\n(.*)$", 1)).alias("role"), unescape(F.regexp_extract(p, r"(?s)^<\|(.*?)\|>\n(.*)$", 2)).alias("text"))
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("conversation"), s["start"], s["length"])))
    return conversations.withColumns({"turns": F.transform(parts, turn), "loss_texts": masked})


def chat_format(messages: DataFrame, most_paths: int | None = None) -> DataFrame:
    """messages (tree, node, parent, score, role, text), node unique within its tree, to one row per chosen root-to-leaf path.

    Columns: tree, leaf, rank, conversation, loss. Null role and null text are empty. Trees are independent; null trees are one tree.
    """
    messages = messages.withColumn("tree", F.struct(F.col("tree").alias("key")))
    paths = root_to_leaf(messages, most_paths)
    turns = paths.join(messages.select("tree", "node", "role", "text"), ["tree", "node"]).select(F.struct("tree", "leaf", "rank").alias("path"), "depth", "role", "text")
    return formatted(turns).select("path.tree.key", "path.leaf", "path.rank", "conversation", "loss").withColumnRenamed("key", "tree")


def as_chains(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as reply trees: each row answers the one before it, by turn, then role and text.

    A conversation's rows meet in one window, as they later do in its one formatted row.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    rows = conversations.select("conv_id", "role", "text", F.row_number().over(W.partitionBy("conv_id").orderBy(*order)).alias("node"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")
