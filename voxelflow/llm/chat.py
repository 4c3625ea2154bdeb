"""Chat formatting of reply trees, in DataFrame functions only.

Messages point to their parents. Iterative self-joins double each node's jump to an ancestor, so a
path of n messages takes log2(n) rounds; on the way they sum the scores from the root. Leaves are
ranked by that sum (ties: the smaller node) and the chosen paths are listed by applying the jumps
again, each ancestor once. A path is formatted as one conversation:

    <|role|>\\n text </s>\\n        (no blanks around the text)

A backslash goes before every backslash of a role or text and inside every control string, so
control strings stand in the output only where the template put them, and removing the first
backslash of each pair gives the text back. The loss mask is the list of spans, in code points of
the output, of the assistants' texts.

Defined cases: null text and role are empty; null tree ids form one tree; a conversation's rows go
by turn (null first), ties by role and text, repeated rows stay; a message whose parent is absent
is a root; messages on a cycle have no root and don't appear; columns beside those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, table

#: Strings that steer chat templates.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")
_INSIDE = r"\\|(?<=<)(?=\||/?s>)|(?<=\|)(?=>)|(?<=\[)(?=/?INST\])"
_END = "</s>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _INSIDE, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, node, up) of the ancestor 1, 2, 4, ... steps up, and (tree, node, total) of all
    messages that have a root."""
    have = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    first = messages.join(have, messages["tree"].eqNullSafe(have["t"]) & (messages["parent"] == have["n"]), "left")
    now = materialize(first.select("tree", "node", F.col("n").alias("up"), "score"), "jump0")
    levels, limit, rooted = [], messages.count().bit_length(), now.where("up is null")  # longer paths are cycles
    while len(levels) < limit and (open_ := now.where("up is not null")).limit(1).count():
        levels.append(open_.select("tree", "node", "up"))
        known = rooted.union(open_)  # what has its root is settled: only the others jump on
        above = known.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("above"), F.col("score").alias("more"))
        now = open_.join(above, open_["tree"].eqNullSafe(above["t"]) & (open_["up"] == above["n"]))
        now = materialize(now.select("tree", "node", F.col("above").alias("up"), (F.col("score") + F.col("more")).alias("score")), f"jump{len(levels)}")
        rooted = rooted.union(now.where("up is null"))
    return levels, rooted.select("tree", "node", F.col("score").alias("total"))


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, rank, node, depth (steps above the leaf) of each tree's best root-to-leaf paths.
    messages: tree, node, parent (null: root), score."""
    levels, rooted = jumps(messages)
    parents = messages.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("n")).distinct()
    leaves = rooted.join(parents, rooted["tree"].eqNullSafe(parents["t"]) & (rooted["node"] == parents["n"]), "left_anti")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("total"), "node"))
    chosen = leaves.withColumn("rank", rank).where(F.col("rank") <= branches)
    paths = materialize(chosen.select("tree", F.col("node").alias("leaf"), "rank", "node", F.lit(0).cast("long").alias("depth")), "leaves")
    for k, level in enumerate(levels):
        up = level.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        higher = paths.join(up, paths["tree"].eqNullSafe(up["t"]) & (paths["node"] == up["n"])).select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") + (1 << k)).alias("depth"))
        paths = paths.union(materialize(higher, f"paths{k}"))
    return paths


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, rank, formatted, loss (array of struct(start, end)) of each chosen path.
    messages: tree, node, parent, role, text, score."""
    messages = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    paths = best_paths(messages.select("tree", "node", "parent", "score"), branches)
    said = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    rows = paths.join(said, paths["tree"].eqNullSafe(said["t"]) & (paths["node"] == said["n"]))
    rows = rows.select("tree", "rank", "depth", "role", F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")).alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(_END)
    before = F.sum(size).over(W.partitionBy("tree", "rank").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("at", F.coalesce(before, F.lit(0)) + F.length("head"))
    turn = F.struct((-F.col("depth")).alias("o"), F.concat("head", "body", F.lit(_END)).alias("turn"), F.when(F.col("role") == "assistant", F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end"))).alias("loss"))
    turns = rows.groupBy("tree", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return turns.select("tree", "rank", F.array_join("turns.turn", "").alias("formatted"), F.array_compact("turns.loss").alias("loss"))


def read_back(formatted: Column) -> Column:
    """array of struct(role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, _END, -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        at = F.locate("|>\n", x)
        return F.struct(unescape(F.substring(x, F.lit(3), at - 3)).alias("role"), unescape(F.substring(x, at + 3, F.length(x))).alias("text"))

    return F.transform(parts, turn)


def conversation_trees(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees with one branch."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).cast("long")
    numbered = rows.select("conv_id", "role", "text", place.alias("node"))
    return numbered.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    trees = materialize(conversation_trees(rows), "trees")
    done = format_trees(trees).withColumn("turns", read_back(F.col("formatted")))
    learned = F.array_join(F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))), "")
    done = done.withColumn("learned", learned)
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return done.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
