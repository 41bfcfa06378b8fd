"""Chat formatting of reply trees: enumerate root-to-leaf paths, rank the branches, format the chosen paths.

Paths come from iterative self-joins with doubling: after k joins every message knows its 2**k-th ancestor, so a chain
of n messages takes log2(n) joins. Formatting streams over sorted rows and holds one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle

TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of this and of other common templates, which no text may carry as they are.
CONTROL_STRINGS = ("<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_SPECIAL = re.compile(r"\\|" + "|".join(re.escape(x) for x in CONTROL_STRINGS))
_TURN = re.compile(re.escape(TURN_OPEN) + r"((?:[^\\\n]|\\[\s\S])*)\n([\s\S]*?)" + re.escape(TURN_CLOSE) + r"\n")


def escape(text: str) -> str:
    """Double each backslash and put one behind the first character of each control string."""
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """A turn and the place in it where its text begins. A line feed in a role is escaped too."""
    head = TURN_OPEN + escape(role).replace("\n", "\\\n") + "\n"
    return head + escape(text) + TURN_CLOSE + "\n", len(head)


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def reply_paths(messages: DataFrame, tree: str, node: str, parent: str, score: str, branches: int = 1) -> DataFrame:
    """(tree, leaf, branch, node, pos): the best ``branches`` root-to-leaf paths of each tree, pos 0 at the root.

    A path's rank is by the sum of its scores (null: 0), then by its length, then by the smaller leaf. A message whose
    parent is null or not in its tree is a root. Messages on a reply cycle, or below one, are on no path. A node must
    occur once in its tree. Trees with a null id are one tree. An empty table gives no paths.
    """
    base = settle(messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("up"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("total")))
    there = base.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    jump = base.join(there, base["tree"].eqNullSafe(there["t"]) & (base["up"] == there["n"]), "left")
    jump = settle(jump.select("tree", "node", F.col("n").alias("up"), F.lit(1).cast("long").alias("depth"), "total"))
    leaves = jump.join(jump.select(F.col("tree").alias("t"), F.col("up").alias("n")).where("n is not null"), F.expr("tree <=> t and node = n"), "left_anti").select("tree", "node")
    levels, rounds = [], max(1, jump.count()).bit_length() + 1
    while len(levels) < rounds and jump.where("up is not null").limit(1).count():
        levels.append(jump.where("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("far")))
        far = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("far"), F.col("depth").alias("far_depth"), F.col("total").alias("far_total"))
        step = jump.where("up is not null").join(far, F.expr("tree <=> t and up = n"))  # those at a root are done
        step = step.select("tree", "node", F.col("far").alias("up"), (F.col("depth") + F.col("far_depth")).alias("depth"), (F.col("total") + F.col("far_total")).alias("total"))
        jump = settle(jump.where("up is null").unionByName(step))
    ends = jump.where("up is null").join(leaves.select(F.col("tree").alias("t"), F.col("node").alias("n")), F.expr("tree <=> t and node = n"), "left_semi")
    order = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "node")
    best = ends.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches)
    path = best.select("tree", F.col("node").alias("leaf"), "branch", "node", (F.col("depth") - 1).alias("pos"))
    reach = 1
    for level in levels:  # a level's pointers reach twice as far as those of the one before
        above = path.join(level, F.expr("tree <=> t and node = n")).select("tree", "leaf", "branch", F.col("far").alias("node"), (F.col("pos") - reach).alias("pos"))
        path, reach = settle(path.unionByName(above)), reach * 2
    return path


def format_paths(paths: DataFrame, messages: DataFrame, tree: str, node: str, role: str, text: str) -> DataFrame:
    """One row per path: tree, leaf, branch, formatted, loss (code point spans of the assistant texts in ``formatted``).

    Null roles and texts count as empty. Rows are dealt by path and sorted; one conversation is held at a time.
    """
    body = messages.select(F.col(tree).alias("t"), F.col(node).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = paths.join(body, F.expr("tree <=> t and node = n")).select("tree", "leaf", "branch", "pos", "role", "text")
    rows = rows.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "pos")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*(rows.schema[x] for x in ("tree", "leaf", "branch")), T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(span))])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def write(batches):
        now, parts, loss, size = None, [], [], 0

        def done(types):
            cells = [pa.array([x], t) for x, t in zip(now, types, strict=True)]
            return pa.RecordBatch.from_arrays([*cells, pa.array(["".join(parts)]), pa.array([loss], spans)], names=schema.names)

        types = None
        for batch in batches:
            types = [batch.schema.field(x).type for x in ("tree", "leaf", "branch")]
            for r in batch.to_pylist():
                path = (r["tree"], r["leaf"], r["branch"])
                if now is not None and path != now:
                    yield done(types)
                    parts, loss, size = [], [], 0
                now = path
                turn, begin = format_turn(r["role"], r["text"])
                if r["role"] == "assistant":
                    loss.append({"start": size + begin, "end": size + len(turn) - len(TURN_CLOSE) - 1})
                parts.append(turn)
                size += len(turn)
        if now is not None:
            yield done(types)

    return rows.mapInArrow(write, schema)


def _digests(formatted: pa.Array, loss: pa.Array) -> pa.Array:
    """Digests of the turns and of the text under the loss mask, parsed from the formatted conversation."""
    out = []
    for text, spans in zip(formatted.to_pylist(), loss.to_pylist(), strict=True):
        turns, under = parse(text), "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
        whole = hashlib.sha256("".join(f"{role}\n{body}\n" for role, body in turns).encode()).hexdigest()
        out.append((len(turns), whole, len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
    kinds = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    return pa.StructArray.from_arrays([pa.array([x[i] for x in out], t) for i, (_, t) in enumerate(kinds)], fields=[pa.field(n, t) for n, t in kinds])


def read_back(formatted: str, loss: str) -> Column:
    kind = "struct<n_turns: bigint, turns_sha256: string, loss_chars: bigint, loss_sha256: string, formatted_chars: bigint>"
    return F.arrow_udf(_digests, kind)(F.col(formatted), F.col(loss))


def format_trees(messages: DataFrame, tree: str, node: str, parent: str, score: str, role: str, text: str, branches: int = 1) -> DataFrame:
    """The best ``branches`` paths of each reply tree as conversations (tree, leaf, branch, formatted, loss)."""
    return format_paths(reply_paths(messages, tree, node, parent, score, branches), messages, tree, node, role, text)


def as_chains(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turn tables as reply trees: each row answers the one before it by (turn, role, text); nulls come first."""
    order = Window.partitionBy(conv).orderBy(turn, role, text)
    rows = turns.select(conv, turn, role, text).withColumn("node", F.row_number().over(order))
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(1.0))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7; rows of the table that have this number already are turns of it too."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], table.schema)
    messages = settle(as_chains(table.unionByName(extra)))
    done = format_trees(messages, "conv_id", "node", "parent", "score", "role", "text")
    return done.select(F.col("tree").alias("conv_id"), read_back("formatted", "loss").alias("r")).select("conv_id", "r.*")
