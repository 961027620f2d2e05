"""Chat formatting from reply trees (operator 10): DataFrame operations only.

Messages are nodes with a parent. A frontier of path ends is joined again and again with the
children of its ends until no path grows, carrying ids and scores only; what has no children is
a leaf, and its path from the root is one candidate conversation. Branches of a tree are ranked
by score, and each chosen path is joined with its texts once and written as one string.

The template is ``<turn:ROLE>TEXT</turn>`` a message and a line feed behind it. Inside roles and
texts a backslash is written ``\\b`` and a less-than sign ``\\l``, so the only less-than signs of
an output are those of its marks: the output can be split and read back without loss, whatever
a text says.
"""

from pyspark.sql import DataFrame, Window, functions as F

from .shared import stored

OPEN, OPENED, CLOSE = "<turn:", ">", "</turn>\n"


def escaped(c):
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(c):
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escaped_role(c):
    """A role stands before the end of its mark, so that sign is escaped too."""
    return F.replace(escaped(c), F.lit(">"), F.lit("\\g"))


def unescaped_role(c):
    return F.replace(F.replace(F.replace(c, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def reply_chains(conversations: DataFrame) -> DataFrame:
    """Flat conversations as reply trees: every turn answers the one before it.

    Gives tree_id, node_id, parent_id, role, text and score (0). Rows of a conversation are
    ordered by turn (NULL first); ties by role, then text, so repeated turns keep their rows.
    A NULL conv_id is a conversation of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order)
    rows = conversations.select(F.col("conv_id").alias("tree_id"), node.cast("long").alias("node_id"), "role", "text")
    return rows.select("tree_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def same(left: str, right: str, node: str, other: str):
    return F.col(left).eqNullSafe(F.col(right)) & (F.col(node) == F.col(other))


def climbs(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of jumps up the trees, and every leaf with the score of its path.

    ``nodes`` has tree_id, node_id, parent_id, score, one row a node. Table k holds the nodes that
    have a reply 2^k above them, and that reply. Each round joins the nodes still on their way
    with all nodes, which doubles the way; nodes that reach their root leave with the score of
    their path, so a round costs the nodes deeper than 2^k, and no table carries whole paths.
    """
    up = nodes.select(F.col("tree_id").alias("t"), F.col("node_id").alias("p"))
    state = stored(nodes.join(up, same("tree_id", "t", "parent_id", "p"), "left").select("tree_id", "node_id", F.col("p").alias("above"), "score"), "reply-ways")
    n, levels, rooted = state.count(), [state.filter("above is not null")], state.filter("above is null")
    while 2 ** (len(levels) - 1) <= n and not levels[-1].isEmpty():
        known = levels[-1].unionByName(rooted).select(F.col("tree_id").alias("t"), F.col("node_id").alias("p"), F.col("above").alias("higher"), F.col("score").alias("more"))
        went = levels[-1].join(known, same("tree_id", "t", "above", "p")).select("tree_id", "node_id", F.col("higher").alias("above"), (F.col("score") + F.col("more")).alias("score"))
        went = stored(went, "reply-ways")
        levels.append(went.filter("above is not null"))
        rooted = rooted.unionByName(went.filter("above is null"))
    answered = levels[0].select(F.col("tree_id").alias("t"), F.col("above").alias("p")).distinct()
    leaves = rooted.join(answered, same("tree_id", "t", "node_id", "p"), "left_anti")
    return levels, leaves.select("tree_id", F.col("node_id").alias("leaf_id"), "score")


def path_nodes(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """The replies of each leaf's path: tree_id, leaf_id, node_id and ``up``, the replies below it.

    From the widest jump to the narrowest, whatever is marked also marks what its jump reaches:
    each reply of a path is reached by exactly one sum of distinct powers of two.
    """
    marked = leaves.select("tree_id", "leaf_id", F.col("leaf_id").alias("node_id"), F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(levels))):
        jump = levels[k].select(F.col("tree_id").alias("t"), F.col("node_id").alias("p"), "above")
        marked = marked.unionByName(marked.join(jump, same("tree_id", "t", "node_id", "p")).select("tree_id", "leaf_id", F.col("above").alias("node_id"), (F.col("up") + 2 ** k).alias("up")))
        marked = stored(marked, "reply-marks") if k % 3 == 0 else marked
    return marked


def formatted(messages: DataFrame, branches=1) -> DataFrame:
    """The best ``branches`` paths of each tree as strings: tree_id, leaf_id, rank, n_turns, output.

    ``messages`` has tree_id, node_id, parent_id, role, text, score. Branches rank by the sum of
    their scores, then by leaf id, the later first. A NULL text is empty, a NULL role has no
    name, a NULL score counts 0. A node id repeated in its tree is one node (the first in order of
    parent, role, text). A node whose parent is missing from its tree starts a path like a root;
    replies in a ring have no root and are in no path. An empty table gives an empty table. A
    conversation is one string, so it is the only thing gathered in one place.
    """
    at = [F.col(c).cast("long").alias(c) for c in ("node_id", "parent_id")]
    turn = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit(OPENED), escaped(F.col("text")), F.lit(CLOSE))
    single = messages.select("tree_id", *at, F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), turn.alias("turn"))
    ids = single.groupBy("tree_id", "node_id").agg(F.min_by("parent_id", "turn").alias("parent_id"), F.min_by("score", "turn").alias("score"))
    levels, leaves = climbs(ids)
    best = Window.partitionBy("tree_id").orderBy(F.col("score").desc(), F.col("leaf_id").desc())
    chosen = stored(leaves.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= branches), "reply-chosen")
    steps = path_nodes(chosen, levels).join(chosen.select(F.col("tree_id").alias("t"), F.col("leaf_id").alias("p"), "rank"), same("tree_id", "t", "leaf_id", "p")).drop("t", "p")
    texts = single.groupBy(F.col("tree_id").alias("t"), F.col("node_id").alias("p")).agg(F.min("turn").alias("turn"))
    rows = steps.join(texts, same("tree_id", "t", "node_id", "p")).select("tree_id", "leaf_id", "rank", F.struct((-F.col("up")).alias("place"), "turn").alias("step"))
    whole = rows.groupBy("tree_id", "leaf_id", "rank").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    return whole.select("tree_id", "leaf_id", "rank", F.size("steps").cast("long").alias("n_turns"), F.concat_ws("", F.transform("steps", lambda s: s["turn"])).alias("output"))


def _turns(output):
    marks = F.split(output, OPEN)
    return F.slice(marks, 2, F.greatest(F.lit(0), F.size(marks) - 1))


def _head(turn):
    """Characters of a split turn before its text."""
    return F.length(F.substring_index(turn, OPENED, 1)) + 1


def turns_of(output):
    """Read an output back: an array of (role, text)."""
    return F.transform(_turns(output), lambda m: F.struct(
        unescaped_role(F.substring_index(m, OPENED, 1)).alias("role"),
        unescaped(F.substring(m, _head(m) + 1, F.length(m) - _head(m) - len(CLOSE))).alias("text")))


def loss_spans(output, trained="assistant"):
    """The loss mask of an output: start (from 0) and length in code points of each trained text.

    The spans hold the texts as they stand in the output, escaped.
    """
    none = F.array().cast("array<struct<start:int,length:int,role:string>>")
    span = lambda at, m: F.struct((at + len(OPEN) + _head(m)).alias("start"), (F.length(m) - _head(m) - len(CLOSE)).alias("length"), F.substring_index(m, OPENED, 1).alias("role"))
    walked = F.aggregate(_turns(output), F.struct(F.lit(0).alias("at"), none.alias("spans")), lambda a, m: F.struct(
        (a["at"] + len(OPEN) + F.length(m)).alias("at"), F.concat(a["spans"], F.array(span(a["at"], m))).alias("spans")))
    return F.transform(F.filter(walked["spans"], lambda s: s["role"] == trained), lambda s: F.struct(s["start"], s["length"]))
