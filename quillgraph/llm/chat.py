r"""Chat formatting of reply trees, with DataFrame functions only.

A reply tree is rows (conv_id, node, parent, role, text, score). Root-to-leaf paths come from iterative self-joins by
pointer doubling: after k joins every node knows its ancestor 2**k steps up, its depth so far and the score summed on
the way, so a conversation of n turns takes log2(n) joins, not n. The leaves of each tree are ranked by their path's
total score (ties: the smallest leaf), the best `top` are chosen, and only the chosen paths are expanded, by the same
jump tables, into their rows. Each chosen path becomes one text.

Template: a turn is `<s>[INST] text</s>` for a user, `<s>[SYS] text</s>` for a system, `<s>[OUT] text</s>` for an
assistant, and `<s>[ROLE hex] text</s>` for any other role, hex being its UTF-8 in hexadecimal. Where a text holds a
control string (`<s>`, `</s>`, `[INST]`, `[/INST]`, `[SYS]`, `[OUT]`, `[ROLE`, ...), with n backslashes after its first
character, one more backslash goes there; reading takes one away, so every text comes back as it was. loss_spans are
the [from, to) code points of the assistants' texts in the formatted text.

Defined cases: null text is empty; a null role is the role ''; a null conv_id is a conversation of its own. Rows with
the same turn are ordered by role, then text; repeated rows each are turns. A row whose parent isn't in its tree is a
root. Rows on a cycle have no root and thus no path. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut

_CONTROL = r"/?(?:s>|INST\]|SYS\]|OUT\]|ROLE)"
_HEADS = {"user": "[INST] ", "system": "[SYS] ", "assistant": "[OUT] "}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(" + _CONTROL + ")", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\(" + _CONTROL + ")", r"$1$2$3")


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations of rows by turn as reply trees without branches."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    node = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", role, text)).cast("long")
    return conversations.select("conv_id", node.alias("node"), role.alias("role"), text.alias("text")).select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chosen_paths(tree: DataFrame, top: int = 1) -> DataFrame:
    """conv_id, rank, node, depth: the rows of the best `top` root-to-leaf paths of each tree; the root has depth 1."""
    ids = tree.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
    edges = tree.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    known = edges.join(ids, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("n")), "left")
    now = cut(known.select("conv_id", "node", F.col("n").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "chat-up")
    n, ended, jumps = now.count(), [now.where("up is null")], []
    # only nodes that haven't reached their root yet are joined again
    active = now.where("up is not null")
    while (1 << len(jumps)) <= 2 * max(n, 1) and not active.isEmpty():
        jumps.append(active)
        all_ = active
        for x in ended:
            all_ = all_.unionByName(x)
        above = all_.select(F.col("conv_id").alias("c"), F.col("node").alias("a"), F.col("up").alias("next"), F.col("depth").alias("d"), F.col("total").alias("t"))
        far = active.join(above, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("a"))).select("conv_id", "node", F.col("next").alias("up"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("t")).alias("total"))
        far = cut(far, "chat-up")
        ended.append(far.where("up is null"))
        active = far.where("up is not null")
    rooted = ended[0]
    for x in ended[1:]:
        rooted = rooted.unionByName(x)
    parents = now.where("up is not null").select(F.col("conv_id").alias("c"), F.col("up").alias("a")).distinct()
    leaves = rooted.join(parents, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("a")), "left_anti")
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("total"), "node"))
    best = leaves.withColumn("rank", rank).where(F.col("rank") <= top)
    rows = best.select("conv_id", "rank", "node")
    for jump in jumps:
        up = jump.select(F.col("conv_id").alias("c"), F.col("node").alias("a"), "up")
        more = rows.join(up, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("a"))).select("conv_id", "rank", F.col("up").alias("node"))
        rows = cut(rows.unionByName(more), "chat-path")
    depth = rooted.select(F.col("conv_id").alias("c"), F.col("node").alias("a"), "depth")
    return rows.join(depth, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("a"))).select("conv_id", "rank", "node", "depth")


def format_paths(tree: DataFrame, top: int = 1) -> DataFrame:
    """conv_id, rank, n_turns, text, loss_spans: each chosen path as one conversation."""
    tree = cut(tree, "chat-tree")
    paths = chosen_paths(tree.select("conv_id", "node", "parent", "score"), top)
    role, body = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit("[ROLE "), F.hex(F.encode(role, "utf-8")), F.lit("] "))
    for name, tag in _HEADS.items():
        head = F.when(role == name, F.lit(tag)).otherwise(head)
    turns = tree.select(F.col("conv_id").alias("c"), F.col("node").alias("a"), F.concat(F.lit("<s>"), head).alias("head"), body.alias("body"), (role == "assistant").alias("loss"))
    rows = paths.join(turns, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("a")))
    piece = F.concat("head", "body", F.lit("</s>"))
    before = W.partitionBy("conv_id", "rank").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.select("conv_id", "rank", "depth", "loss", piece.alias("piece"), F.length("head").alias("h"), F.length("body").alias("b"))
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("h"))
    span = F.when(F.col("loss"), F.struct(F.col("at").alias("from"), (F.col("at") + F.col("b")).alias("to")))
    made = rows.groupBy("conv_id", "rank").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("depth", "piece"))).alias("pieces"), F.sort_array(F.collect_list(span)).alias("loss_spans"))
    return made.select("conv_id", "rank", "n_turns", F.concat_ws("", F.col("pieces.piece")).alias("text"), "loss_spans")


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    pieces = F.filter(F.split(text, "</s>", -1), lambda x: x != "")
    tag = lambda x: F.regexp_extract(x, r"^<s>\[(INST|SYS|OUT|ROLE [0-9A-F]*)\] ", 1)

    def turn(x: Column) -> Column:
        t = tag(x)
        role = F.decode(F.unhex(F.substr(t, F.lit(6))), "utf-8")
        for name, head in _HEADS.items():
            role = F.when(t == head[1:-2], F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(F.substr(x, F.length(t) + 7)).alias("text"))

    return F.transform(pieces, turn)


def read_loss(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substr(text, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id and what reading the formatted texts gives back."""
    turns = F.concat_ws("", F.transform(read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    read = formatted.select("conv_id", "n_turns", turns.alias("turns"), read_loss(F.col("text"), F.col("loss_spans")).alias("loss"), F.length("text").cast("long").alias("formatted_chars"))
    return read.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(F.encode("turns", "utf-8"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.encode("loss", "utf-8"), 256).alias("loss_sha256"), "formatted_chars")
