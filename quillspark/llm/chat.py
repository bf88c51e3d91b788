"""Chat formatting of reply trees, with DataFrame operations only.

Messages point to the message they answer. Self-joins that double their reach carry, for every message, the sum of the
scores up to its root (log2 of the depth joins). Leaves are ranked by these sums, and the messages of the chosen paths
are listed by the same jumps, since every distance has one binary form. Each chosen path is one conversation.

Template: each turn is OPEN + role + CLOSE + text + END. In roles and texts the ESCAPE character and the three marks'
first characters are written as ESCAPE + letter, so marks never occur inside a turn and unescaping is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, table

#: Marks of the template. Texts can't hold them: "<" and "[" are escaped along with the escape character itself.
OPEN, CLOSE, END = "[INST ", "]", "</s>"
ESCAPES = (("~", "~t"), ("<", "~l"), ("[", "~b"), ("]", "~e"))


def escape(text: Column) -> Column:
    for raw, coded in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for raw, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def climbs(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Ancestors at doubling distances, and the way to the root of each message.

    The first result holds tables (id, to) of the ancestor 1, 2, 4, ... replies up; the second is (id, total, size), the
    summed score and the number of messages from a message to its root. Prefix sums are carried along the jumps, so no
    path is written out. After as many doublings as the number of messages has binary digits, a message that still
    climbs is part of a cycle or hangs below one: it has no root and is left out.
    """
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total")
    one = F.lit(1).cast("long").alias("size")
    known = messages.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    replies = messages.where("parent is not null").join(known, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("to"), score, one)
    roots = messages.where("parent is null").select("id", F.lit(None).cast(messages.schema["parent"].dataType).alias("to"), score, one)
    here = materialize(replies.unionByName(roots), "replies")
    rounds, ways = here.count().bit_length(), []
    while len(ways) <= rounds:
        climbing = here.where("to is not null")
        if climbing.isEmpty():
            break
        ways.append(climbing.select("id", "to"))
        above = here.select(F.col("id").alias("to"), F.col("to").alias("on"), F.col("total").alias("more"), F.col("size").alias("longer"))
        moved = climbing.join(above, "to").select("id", F.col("on").alias("to"), (F.col("total") + F.col("more")).alias("total"), (F.col("size") + F.col("longer")).alias("size"))
        here = materialize(moved.unionByName(here.where("to is null")), "replies")
    return ways, here.where("to is null").select("id", "total", "size")


def chosen(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, rank, id, up) of the `branches` best paths of each tree (all: None); up counts from the leaf.

    messages: (tree, id, parent, score), parent null for roots; ids are unique. Messages whose parent is missing are
    roots. Rank 1 has the highest summed score (null counts as 0); ties go to the longer path, then to the smaller leaf.
    Messages of a cycle, and those below one, are on no path. Leaves are ranked by their sums first, and only the
    chosen ones are followed up to their roots.
    """
    ways, sums = climbs(messages)
    parents = messages.select(F.col("parent").alias("id")).where("id is not null")
    leaves = messages.select("tree", "id").join(parents, "id", "left_anti").join(sums, "id")
    order = Window.partitionBy("tree").orderBy(F.col("total").desc(), F.col("size").desc(), "id")
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    way = ranked.select("tree", F.col("id").alias("leaf"), "rank", "id", F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(ways):
        step = way.join(jump, "id").select("tree", "leaf", "rank", F.col("to").alias("id"), (F.col("up") + (1 << k)).alias("up"))
        way = materialize(way.unionByName(step), "paths")
    return way


def format_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, rank, formatted, loss_spans): each chosen path as one text, and the half-open code point ranges of the
    assistant texts in it, which carry the loss.

    messages: (id, tree, parent, role, text, score), ids unique; null role or text counts as empty. An empty table
    gives an empty result.
    """
    rows = chosen(messages, branches).join(messages.select("id", "role", "text"), "id")
    turn = F.struct((-F.col("up")).alias("place"), F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("role", F.lit(""))).alias("who"), escape(F.coalesce("text", F.lit(""))).alias("what"))
    whole = rows.groupBy("tree", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = whole.withColumn("parts", F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["who"], F.lit(CLOSE), t["what"], F.lit(END))))
    # where each text starts: lengths of the turns before, and of its own head
    sizes = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def walk(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["who"]) + len(OPEN) + len(CLOSE)
        end = start + F.length(t["what"])
        span = F.struct(start.alias("start"), end.alias("end"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    return whole.select("tree", "rank", F.array_join("parts", "").alias("formatted"), F.aggregate("turns", sizes, walk)["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.filter(F.split(formatted, END), lambda p: F.length(p) > 0)

    def turn(p: Column) -> Column:
        cut = F.instr(p, CLOSE)
        return F.struct(unescape(F.substring(p, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)).alias("role"), unescape(F.substring(p, cut + len(CLOSE), F.length(p))).alias("text"))

    return F.transform(parts, turn)


def conversations_as_trees(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages, each answering the one before it by turn.

    Ties of a turn, repeated rows and a null turn (first) are ordered by role and text, so each row is one message.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long") - 1
    one = rows.withColumn("place", place)
    name = lambda place: F.struct(F.col("conv_id").alias("c"), place.alias("p"))
    return one.select(name(F.col("place")).alias("id"), F.col("conv_id").alias("tree"), F.when(F.col("place") > 0, name(F.col("place") - 1)).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from formatted conversations (tree, formatted, loss_spans)."""
    turns = formatted.withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    return turns.withColumn("loss", loss).select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    messages = materialize(conversations_as_trees(given.unionByName(probe)), "messages")
    return digest(format_paths(messages))


OP9_SQL = """
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(replace(text, '~', ''), '<', ''), '[', ''), ']', '')) AS coded FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(coded + length(role) + 11) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
