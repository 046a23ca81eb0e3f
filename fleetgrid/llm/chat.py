"""Chat formatting of reply trees.

Self-joins that double the reach of each message's link to its ancestors enumerate root-to-leaf paths; the branches
of a tree are ranked by score, and each chosen path is formatted as one conversation whose training mask covers the
assistant's words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

#: A turn is START role newline text END newline.
START, END = "<|turn|>", "<|end|>"
#: Where a backslash goes into a text: before each backslash, and inside each opening of a control string.
_OPENINGS = re.compile(r"\\|(?<=<)(?=\|)|(?<=<)(?=/?s>)|(?<=\[)(?=/?INST\])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|end\|>\n", re.DOTALL)
LEARNED = "assistant"


def escape(text: str) -> str:
    r"""No control string stands in the result: ``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]`` are broken up by a
    backslash, and backslashes are doubled, so that dropping one backslash of each pair gives the text back."""
    return _OPENINGS.sub(lambda m: "\\\\" if m[0] else "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], learned: str = LEARNED) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask: spans of code points, one for each learned text."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role).replace('\n', '\\\n')}\n", escape(text)
        if role == learned:
            mask.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}{END}\n")
        at += len(out[-1])
    return "".join(out), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """``tree_id, leaf, rank, depth, id`` for the messages on the ``best`` highest-scored root-to-leaf paths of a tree.

    ``messages`` has ``id`` (unique), ``parent`` (null at a root), ``tree_id`` and ``score`` (null: 0). A path's score is
    the mean over its messages; ties go to the smaller leaf. Messages whose parent is missing start a tree of their own.
    Each round joins the table with itself and doubles how far a message sees, so a chain of n messages takes log2(n) rounds.
    """
    rows = messages.select("id", "tree_id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = rows.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    rows = rows.join(known, "parent", "left").withColumn("parent", F.when(F.col("known"), F.col("parent"))).drop("known")
    # seen: messages from here up to, and without, the ancestor that far points to
    hops = [durable(rows.select("id", "tree_id", F.col("parent").alias("far"), F.lit(1).cast("long").alias("seen"), F.col("score").alias("total")))]
    while not hops[-1].filter("far is not null").isEmpty():
        here = hops[-1]
        above = here.select(F.col("id").alias("far"), F.col("far").alias("next"), F.col("seen").alias("more"), F.col("total").alias("add"))
        open_, done = here.filter("far is not null"), here.filter("far is null")
        joined = open_.join(above, "far").select("id", "tree_id", F.col("next").alias("far"), (F.col("seen") + F.col("more")).alias("seen"), (F.col("total") + F.col("add")).alias("total"))
        hops.append(durable(joined.unionByName(done)))
    whole = hops[-1].select("id", "tree_id", F.col("seen").alias("depth"), (F.col("total") / F.col("seen")).alias("mean"))
    parents = hops[0].filter("far is not null").select(F.col("far").alias("id")).distinct()
    leaves = whole.join(parents, "id", "left_anti")
    order = Window.partitionBy("tree_id").orderBy(F.desc("mean"), "id")
    chosen = durable(leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select(F.col("id").alias("leaf"), "rank"))
    # every distance is a sum of distinct powers of two: going through the hops once reaches every ancestor
    marked = chosen.select("leaf", "rank", F.col("leaf").alias("id"))
    for hop in reversed(hops[:-1]):
        up = hop.filter("far is not null").select("id", "far")
        marked = durable(marked.unionByName(marked.join(up, "id").select("leaf", "rank", F.col("far").alias("id"))))
    return marked.join(whole, "id").select("tree_id", "leaf", "rank", "depth", "id")


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """``tree_id, leaf, rank, formatted, mask``: each chosen path as one conversation, its mask as spans of code points.

    ``messages`` has ``id, tree_id, parent, score, role, text``; null texts and roles count as empty. A conversation is one
    string, so its turns meet in one row; nothing else is gathered.
    """
    texts = messages.select("id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths(messages, best).join(texts, "id").groupBy("tree_id", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType())])
    schema = T.StructType([*turns.schema.fields[:3], T.StructField("formatted", T.StringType()), T.StructField("mask", T.ArrayType(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [format_turns([(t["role"], t["text"]) for t in turns.as_py()]) for turns in batch.column(3)]
            masks = pa.array([[{"first": a, "after": b} for a, b in m] for _, m in done], pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([f for f, _ in done], pa.string()), masks], names=["tree_id", "leaf", "rank", "formatted", "mask"])

    return turns.mapInArrow(run, schema)


def linear_messages(df: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as reply trees of one branch: each row answers the row before.

    Rows of a conversation go by turn, then role and text, so repeated turns each stay. Rows with a null conv_id are one
    conversation. Ids are given by conversation, so that links stay inside it.
    """
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return durable(rows.withColumn("at", F.row_number().over(order))).select(
        F.struct("conv_id", "at").alias("id"),
        F.col("conv_id").alias("tree_id"),
        F.when(F.col("at") > 1, F.struct("conv_id", (F.col("at") - 1).alias("at"))).alias("parent"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of conversations, read from the formatted strings and their masks alone."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, mask in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[m["first"] : m["after"]]) for m in mask)
                whole = "".join(f"{role}\n{words}\n" for role, words in turns)
                out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return formatted.select(F.col("tree_id").alias("conv_id"), "formatted", "mask").mapInArrow(run, schema)


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """The digests of all conversations, and of one more (-7) whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_trees(linear_messages(rows)))


#: op3 in DuckDB: the same escapes by patterns, turns and mask taken from the table.
ORACLE = r"""
WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
    17 + length(role) + length(regexp_replace(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<\|', '<\\|', 'g'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')) AS n
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
