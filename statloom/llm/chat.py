"""Conversations as a forest of shared turns: template with reversible escapes, depth-first layout, loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.store import keep

# fixed control strings of the template, and others of common chat templates that a text must not bring in either
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
FOREIGN = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
LEARNED = "assistant"


def escape(text: Column) -> Column:
    """Every backslash is doubled, and a control string gets one behind its first character; a null is empty."""
    parts = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(parts, r"(<(?=\|)|<(?=/?s>)|\[(?=/?INST\])|<(?=</?SYS>>))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_nodes(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """One row a turn with the key of its node: (conv_id, depth, path, role, text).

    ``path`` lists the node keys from the first turn on; a key is the hash of the turn and all before it, so turns are one
    node exactly if their conversations agree so far.  Turns are ordered by number, then role and text.  A conversation
    is one row while its keys are chained, as it is one sequence in the end.
    """
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    convs = rows.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def link(path, t):
        last = F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit(""))
        size = F.length(t["role"]).cast("string")
        return F.concat(path, F.array(F.md5(F.concat(last, size, F.lit(":"), t["role"], t["text"]))))

    path = F.aggregate("turns", F.expr("cast(array() as array<string>)"), link)
    return convs.select("conv_id", path.alias("path"), F.posexplode("turns").alias("at", "t")).select(
        "conv_id", (F.col("at") + 1).alias("depth"), F.slice("path", F.lit(1), F.col("at") + 1).alias("path"),
        F.col("t.role").alias("role"), F.col("t.text").alias("text"))


def layout(turns: DataFrame) -> DataFrame:
    """The packed forest: one row a node, in depth-first order by ``seq_start``.

    node, parent, root, depth, formatted, n_chars, seq_start (offset of its first character in the stream of all trees),
    position (id of its first character: the characters of its ancestors), loss_low and loss_high (range inside
    ``formatted`` that is learned, empty for other roles) and attends: the [start, end) ranges of the
    stream its characters see, the ancestors from the first turn on and then the node itself (causally).

    Depth-first order is the order of the paths.  Offsets are running sums: nodes are range-partitioned by path into
    stored parts, summed inside a part and moved by the sums of the parts before, so a tree of any width is
    spread over many tasks and each shared turn stands in the stream once.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    body = escape(F.col("text"))
    nodes = turns.groupBy("path").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.count("*").alias("n_convs"))
    nodes = nodes.select("path", "role", "n_convs", F.size("path").alias("depth"), head.alias("head"), body.alias("body"))
    nodes = nodes.withColumn("formatted", F.concat("head", "body", F.lit(CLOSE))).withColumn("n_chars", F.length("formatted").cast("long"))
    parts = keep(nodes.repartitionByRange("path").withColumn("part", F.spark_partition_id()), "nodes")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    before = parts.groupBy("part").agg(F.sum("n_chars").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("low", F.coalesce(F.sum("n_chars").over(inside), F.lit(0))).join(before, "part")
    learned = F.col("role") == LEARNED
    placed = keep(placed.select(
        F.element_at("path", -1).alias("node"), "path", "depth", "role", "n_convs", "formatted", "n_chars",
        (F.col("base") + F.col("low")).alias("seq_start"),
        F.when(learned, F.length("head")).otherwise(0).cast("long").alias("loss_low"),
        F.when(learned, F.length("head") + F.length("body")).otherwise(0).cast("long").alias("loss_high")), "placed")
    # ancestors: one row for each step of a path, joined with the place of that step
    steps = placed.select("node", F.posexplode("path").alias("step", "above"))
    where = placed.select(F.col("node").alias("above"), "seq_start", "n_chars")
    spans = steps.join(where, "above").groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("step", F.col("seq_start").alias("low"), (F.col("seq_start") + F.col("n_chars")).alias("high")))).alias("s"))
    seen = spans.select("node", F.transform("s", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))).alias("attends"))
    out = placed.join(seen, "node")
    position = F.aggregate(F.slice("attends", 1, F.size("attends") - 1), F.lit(0).cast("long"), lambda n, x: n + x["high"] - x["low"])
    return out.select("node", F.try_element_at("path", F.lit(-2)).alias("parent"), F.element_at("path", 1).alias("root"), "depth", "n_convs",
                      "formatted", "n_chars", "seq_start", position.alias("position"), "loss_low", "loss_high", "attends")


def read_back(members: DataFrame, packed: DataFrame) -> DataFrame:
    """Conversations from the packed nodes alone: conv_id and its turns (role, text, learned text) in order.

    ``members(conv_id, node, depth)`` says which nodes a conversation runs through.  Roles and texts are parsed from the
    formatted strings, the learned texts cut out by the mask.
    """
    body = F.substring(F.col("formatted"), F.col("loss_low").cast("int") + F.lit(1), (F.col("loss_high") - F.col("loss_low")).cast("int"))
    inner = F.expr(f"substring(formatted, {len(OPEN) + 1}, length(formatted) - {len(OPEN) + len(CLOSE)})")
    cut = F.instr(inner, MIDDLE)
    parsed = packed.select(
        "node", "n_chars", "position", unescape(F.substring(inner, F.lit(1), cut - 1)).alias("role"),
        unescape(F.substring(inner, cut + len(MIDDLE), F.length(inner))).alias("text"),
        unescape(body).alias("learned"))
    rows = members.join(parsed, "node")
    turn = F.struct("depth", "role", "text", "learned", "n_chars")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def format_conversations(rows: DataFrame, **columns) -> tuple[DataFrame, DataFrame]:
    """(members, packed nodes) of a table of turns; see ``turn_nodes`` and ``layout``.

    Null roles and texts are empty strings, a null conversation id is an id of its own, equal turn numbers are ordered
    by role and text, other columns are not read.  An empty table gives two empty tables.
    """
    turns = keep(turn_nodes(rows, **columns), "turns")
    members = turns.select("conv_id", F.element_at("path", -1).alias("node"), "depth")
    return members, layout(turns)


def digests(members: DataFrame, packed: DataFrame) -> DataFrame:
    """What a reader of the packed nodes gets for each conversation, as sizes and hashes."""
    turns = read_back(members, packed)
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join(F.transform("turns", lambda t: t["learned"]), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["n_chars"]).alias("formatted_chars"))
