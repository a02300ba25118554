"""Chat formatting of reply trees, in DataFrame operations alone.

Iterative self-joins double the reach of every node's ancestor pointer, so that paths of any depth are enumerated in a
logarithmic number of joins; the same joins sum scores and lengths from the root, which ranks the leaves and gives every
turn's place in the output. The chosen leaves of a conversation then gather their ancestors by the stored jumps.

A turn is `<|im_start|>role LF text<|im_end|> LF`. Inside roles and texts `\\` is written `\\0` and `<|` is written `<\\1`
(and a line feed in a role `\\2`), so that no marker can occur there; it is undone in the opposite order.

Defined cases: null texts, roles and scores count as empty or 0; a node whose parent is missing is a root; nodes on or
below a cycle are on no path from a root and are left out; nodes of a null conversation form one; equal turns of one
conversation are nodes of their own, in the order of role and text; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyveil.llm.shared import checkpointed

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\0")), F.lit("<|"), F.lit("<\\1"))


def unescape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("<\\1"), F.lit("<|")), F.lit("\\0"), F.lit("\\"))


def escape_role(s: Column) -> Column:
    return F.replace(escape(s), F.lit("\n"), F.lit("\\2"))


def unescape_role(s: Column) -> Column:
    return unescape(F.replace(s, F.lit("\\2"), F.lit("\n")))


def linear_tree(turns: DataFrame) -> DataFrame:
    """Nodes of conversations stored by turn: each turn replies to the one before it."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def format_trees(nodes: DataFrame, top: int = 1) -> DataFrame:
    """The `top` best root-to-leaf paths of each conversation, by the sum of their scores, ties to the smaller leaf.

    nodes: conv_id, node, parent, role, text, score. Returns conv_id, path (its leaf), rank, score, formatted, and by turn
    the arrays turn_start, loss_start and loss_length (code points; the length is 0 where no loss is taken).
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    turns = nodes.select("conv_id", conv, "node", "parent", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"), role.alias("role"), head.alias("head"), escape(text).alias("body"))
    turns = checkpointed(turns.withColumn("chars", (F.char_length("head") + F.char_length("body") + len(END)).cast("long")))
    there = turns.select(F.col("conv").alias("p_conv"), F.col("node").alias("p_node"))
    step = turns.join(there, (F.col("conv") == F.col("p_conv")) & (F.col("parent") == F.col("p_node")), "left")
    state = checkpointed(step.select("conv", "node", F.col("p_node").alias("up"), F.lit(1).alias("depth"), "chars", "score"))
    leaves = state.join(state.select("conv", F.col("up").alias("node")).where("node is not null"), ["conv", "node"], "left_anti").select("conv", "node")
    jumps = []
    # only nodes whose pointer is still open are joined again, so one deep conversation is no work for the others
    going, done = state.where("up is not null"), state.where("up is null")
    rounds = 2 + math.ceil(math.log2(max(2, turns.count())))
    while len(jumps) < rounds and going.limit(1).count():
        jumps.append(going.select("conv", F.col("node").alias("from"), "up"))
        further = going.unionByName(done).select(F.col("conv").alias("u_conv"), F.col("node").alias("u_node"), F.col("up").alias("u_up"), F.col("depth").alias("u_depth"), F.col("chars").alias("u_chars"), F.col("score").alias("u_score"))
        both = going.join(further, (F.col("conv") == F.col("u_conv")) & (F.col("up") == F.col("u_node")))
        more = lambda c: (F.col(c) + F.col(f"u_{c}")).alias(c)
        moved = checkpointed(both.select("conv", "node", F.col("u_up").alias("up"), more("depth"), more("chars"), more("score")))
        going, done = moved.where("up is not null"), done.unionByName(moved.where("up is null"))
    whole = done.select("conv", "node", "depth", F.col("chars").alias("end"), F.col("score").alias("sum"))
    best = Window.partitionBy("conv").orderBy(F.col("sum").desc(), "node")
    chosen = leaves.join(whole, ["conv", "node"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    paths = chosen.select("conv", F.col("node").alias("path"), "rank", "sum", "node")
    for jump in reversed(jumps):
        on = (paths["conv"] == jump["conv"]) & (paths["node"] == jump["from"])
        paths = paths.join(jump, on, "left").select(paths["conv"], "path", "rank", "sum", F.explode(F.array_compact(F.array("node", "up"))).alias("node"))
    full = paths.join(whole.select("conv", "node", "depth", "end"), ["conv", "node"]).join(turns.select("conv", "node", "conv_id", "role", "head", "body", "chars"), ["conv", "node"])
    turn = F.struct("depth", "end", "chars", "head", "body", (F.col("role") == LOSS_ROLE).alias("loss"))
    one = full.groupBy("conv", "path").agg(F.first("conv_id").alias("conv_id"), F.first("rank").alias("rank"), F.first("sum").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    start = lambda t: t["end"] - t["chars"]
    return one.select(
        "conv_id", "path", "rank", "score", formatted.alias("formatted"), F.transform("turns", start).alias("turn_start"),
        F.transform("turns", lambda t: start(t) + F.char_length(t["head"])).alias("loss_start"),
        F.transform("turns", lambda t: F.when(t["loss"], F.char_length(t["body"])).otherwise(0)).alias("loss_length"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) parsed from the formatted text, and loss_text, cut out by the loss mask and unescaped.

    Turn starts are the markers' places, so each span is cut from its own turn and long conversations stay linear.
    """
    parts = formatted.withColumn("parts", F.slice(F.split("formatted", "<\\|im_start\\|>"), 2, 2_147_483_647))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.char_length(role) + 2, F.char_length(p) - F.char_length(role) - 1 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    spans = F.arrays_zip("turn_start", "loss_start", "loss_length")
    cut = F.zip_with("parts", spans, lambda p, s: unescape(F.substr(p, (s["loss_start"] - s["turn_start"] - len(START) + 1).cast("int"), s["loss_length"].cast("int"))))
    return parts.select("conv_id", "formatted", F.transform("parts", turn).alias("turns"), F.array_join(cut, "").alias("loss_text"))


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    back = read_back(format_trees(linear_tree(table.unionByName(extra))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
