"""Chat formatting of reply trees.

Messages name the message that they answer. Self-joins that double their reach find for every message
its root, its depth and the score of its path, in as many rounds as the depth has binary digits. The
leaves of a tree stand for its root-to-leaf paths; they are ranked by the mean score of their messages.
The same pointers, taken from the longest jump to the shortest, collect the messages of the chosen
paths. Only then are texts joined in, and every path becomes one conversation.

The template is ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line break. In texts
and roles, ``<`` followed by any number of backslashes and ``|`` gets one backslash more, which no text
can undo, so a control string inside a text is never one; a line break in a role is ``<|nl|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import saved

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
LEARNT_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role_out(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit(BREAK))


def _role_in(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(BREAK), F.lit("\n")))


def _pointers(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The jumps (id, up) of 1, 2, 4 ... steps, and for every message under a root: id, root, depth, total.

    Messages in a cycle, or below one, have no root and are on no root-to-leaf path.
    """
    ids = nodes.select(F.col("id").alias("known"))
    active = saved(
        nodes.join(ids, F.col("parent") == F.col("known"), "left").select(
            "id", F.col("known").alias("up"), F.col("id").alias("root"), F.lit(1).cast("bigint").alias("depth"),
            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total")), "jump")
    # messages whose jump has reached the root take no part in further rounds, but others jump to them
    placed = active.where("up IS NULL")
    active = active.where("up IS NOT NULL")
    jumps, rounds = [], max(1, nodes.count()).bit_length()
    while len(jumps) <= rounds and not active.isEmpty():
        jumps.append(active.select("id", "up"))
        above = placed.unionByName(active).select(
            F.col("id").alias("at"), F.col("up").alias("next"), F.col("root").alias("top"),
            F.col("depth").alias("more"), F.col("total").alias("plus"))
        moved = saved(active.join(above, F.col("up") == F.col("at")).select(
            "id", F.col("next").alias("up"), F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth"),
            (F.col("total") + F.col("plus")).alias("total")), "jump")
        placed = placed.unionByName(moved.where("up IS NULL"))
        active = moved.where("up IS NOT NULL")
    return jumps, placed.drop("up")


def chosen_paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """leaf, rank, path_score, id, depth: the messages of the best ``per_tree`` paths of every tree.

    ``messages`` has id (unique), parent (null, or unknown, for a root) and score. Paths rank by the mean
    score of their messages, null counting as 0; equal ones by the id of their leaf.
    """
    nodes = saved(messages.select("id", "parent", "score"), "messages")
    jumps, placed = _pointers(nodes)
    parents = nodes.select(F.col("parent").alias("id")).where("id IS NOT NULL").distinct()
    best = Window.partitionBy("root").orderBy(F.desc("path_score"), "leaf")
    leaves = placed.join(parents, "id", "left_anti").select(
        F.col("id").alias("leaf"), "root", (F.col("total") / F.col("depth")).alias("path_score"))
    leaves = saved(leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_tree), "leaves")
    on_path = leaves.select("leaf", F.col("leaf").alias("id"))
    for jump in reversed(jumps):
        on_path = saved(on_path.unionByName(on_path.join(jump, "id").select("leaf", F.col("up").alias("id"))), "path")
    return on_path.join(leaves.drop("root"), "leaf").join(placed.select("id", "depth"), "id")


def conversations(messages: DataFrame, per_tree: int = 1, learnt_role: str = LEARNT_ROLE) -> DataFrame:
    """A row per chosen path: tree, leaf, rank, path_score, n_turns, formatted, loss.

    ``messages`` has tree, id, parent, score, role and text; null texts and roles count as empty. ``loss``
    lists the spans (start from 0 and length, in code points of ``formatted``) to learn from: the texts
    of ``learnt_role``. No messages give no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(START), _role_out(role), F.lit("\n"))
    turns = chosen_paths(messages, per_tree).join(
        messages.select("id", "tree", head.alias("head"), escaped(text).alias("body"), (role == learnt_role).alias("learnt")), "id")
    turns = turns.withColumn("turn", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("span", F.when(F.col("learnt"), F.struct(
        start.alias("start"), F.length("body").cast("bigint").alias("length"))))
    in_order = turns.groupBy("tree", "leaf", "rank", "path_score").agg(
        F.array_sort(F.collect_list(F.struct("depth", "turn", "span"))).alias("turns"))
    return in_order.select(
        "tree", "leaf", "rank", "path_score", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["span"].isNotNull()), lambda t: t["span"]).alias("loss"))


def from_turns(rows: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each turn answers the one before.

    Rows of one conversation are ordered by turn, then role, then text, nulls first; repeated rows are
    turns of their own. Rows without conv_id are one conversation. Other columns are ignored.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order))
    name = F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.col("n").cast("string"))
    above = F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), (F.col("n") - 1).cast("string"))
    return numbered.select(
        F.col("conv_id").alias("tree"), name.alias("id"), F.when(F.col("n") > 1, above).alias("parent"),
        F.lit(0.0).alias("score"), "role", "text")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    parts = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(_role_in(role).alias("role"), unescaped(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(parts, turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(
        F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def formatted_digests(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the formatted text."""
    made = conversations(saved(from_turns(rows), "turns"))
    back = made.select("tree", "formatted", read_back(F.col("formatted")).alias("turns"),
                       masked_text(F.col("formatted"), F.col("loss")).alias("masked"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.encode(spoken, "utf-8"), 256).alias("turns_sha256"),
        F.length("masked").cast("bigint").alias("loss_chars"),
        F.sha2(F.encode("masked", "utf-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
