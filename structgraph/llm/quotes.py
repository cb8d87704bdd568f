"""Chat formatting by quotation linking.

A line's quote level is the number of leading ``>`` marks.  Runs of lines of
one level (a blank line or another level ends a run) are passages; they are
normalised (lower case, single blanks, no marks) and hashed.  Quoted passages
are joined to the messages that first said them as own text, in the same
conversation before any other: as a whole passage, a line or a sentence of one
(a sentence ends with ``.``, ``!`` or ``?`` before a blank).  Each message then
has a parent: the latest earlier message of its conversation that it quotes at
the lowest level, or the one before it.  Following quotes gives the message
that a thread starts with; ``(thread_turn, turn)`` orders a conversation so that
replies follow what they quote, thread by thread.  Texts come back without
quotes and without the line that announces one (``On … wrote:``, ``… said:``
right before a quote).

Null texts are empty.  Null ids link to nothing and stay.  Rows with equal
(conv_id, turn) are messages of their own that share parent and thread.  Of
several first sayings the smallest (conv_id, turn) counts, of the quote's own
conversation only an earlier one.  Passages without a word link to nothing.
No conversation, passage or thread is gathered in one task: sayings are reduced
to one per conversation and passage, and to the two least conversations of a
passage, before quotes are joined to them, so one side of that join has a row a
passage and the engine splits a passage with many quotes (adaptive skew joins);
turns are chained through blocks of ``BLOCK``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from structgraph.llm.common import map_texts, materialize, table

BLOCK = 256
_MARKS = re.compile(r"(?:[ \t]?>)+")
_ANNOUNCED = re.compile(r"(?:on\b.{0,200}\bwrote|.{1,80}\b(?:wrote|said)) ?:", re.I)


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _hash(text: str) -> int | None:
    """Of the normalised text (null: no word)."""
    words = text.lower().split()
    if not words:
        return None
    h = xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def passages(text: str | None) -> tuple[str, list[tuple[int, int]]]:
    """The text without quotes, and level and hash of every passage (level 0: own, and its lines and sentences)."""
    own: list[str] = []
    found: list[tuple[int, int]] = []
    run: list[str] = []
    at = 0

    def close() -> None:
        whole = " ".join(run)
        parts = [whole] if at else [whole, *run, *_SENTENCE.split(whole)]
        found.extend((at, h) for h in dict.fromkeys(map(_hash, parts)) if h is not None)
        run.clear()

    for line in (text or "").split("\n"):
        marks = _MARKS.match(line)
        level, rest = (marks[0].count(">"), line[marks.end() :]) if marks else (0, line)
        if level != at or not rest.strip():
            close()
            at = level
        if level and own and _ANNOUNCED.fullmatch(own[-1].strip()):
            own.pop()
        if not level:
            own.append(line)
        if rest.strip():
            run.append(rest)
    close()
    return "\n".join(own).strip("\n"), found


def parse(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` (no quotes) and ``passages`` of every message."""
    schema = "conv_id long, turn long, role string, text string, passages array<struct<level: int, hash: long>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            done = [passages(t) for t in x["text"]]
            out = pd.DataFrame({"conv_id": x["conv_id"], "turn": x["turn"], "role": x["role"], "text": [t for t, _ in done], "passages": [[{"level": a, "hash": h} for a, h in p] for _, p in done]})
            yield out.astype({"conv_id": "Int64", "turn": "Int64"})

    return map_texts(messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"), run, schema)


def quote_links(parsed: DataFrame) -> DataFrame:
    """Every quoted passage with the message that first said it: ``conv_id``, ``turn``, ``level``, ``hash``, ``from_conv``, ``from_turn`` (null: unknown)."""
    known = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("passages").alias("p")).select("conv_id", "turn", "p.level", "p.hash")
    quoted = known.where("level > 0").distinct()
    # only passages that somebody quotes can be an original
    asked = quoted.select("hash").distinct()
    said = known.where("level = 0").join(asked, "hash", "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("from_turn"))
    first = said.groupBy("hash").agg(F.min(F.struct("conv_id", "from_turn")).alias("first"))
    # the least conversation may be the quote's own, which said it later
    second = said.join(first, "hash").where("conv_id <> first.conv_id").groupBy("hash").agg(F.min(F.struct("conv_id", "from_turn")).alias("second"))
    both = first.join(second, "hash", "left")
    here = quoted.join(said, ["conv_id", "hash"], "left").withColumn("from_turn", F.when(F.col("from_turn") < F.col("turn"), F.col("from_turn")))
    there = here.join(both, "hash", "left")
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).otherwise(F.col("second"))
    origin = F.when(F.col("from_turn").isNotNull(), F.struct("conv_id", "from_turn")).otherwise(other)
    return there.select("conv_id", "turn", "level", "hash", origin.alias("o")).select("conv_id", "turn", "level", "hash", F.col("o.conv_id").alias("from_conv"), "o.from_turn")


def turns_before(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``before``: the turn before it, over blocks so that no conversation is one group."""
    blocks = turns.withColumn("block", F.expr(f"cast(floor(turn / {BLOCK}) as bigint)"))
    inside = F.lag("turn").over(W.partitionBy("conv_id", "block").orderBy("turn"))
    ends = blocks.groupBy("conv_id", "block").agg(F.max("turn").alias("last"))
    ends = ends.select("conv_id", "block", F.lag("last").over(W.partitionBy("conv_id").orderBy("block")).alias("earlier"))
    return blocks.withColumn("inside", inside).join(ends, ["conv_id", "block"]).select("conv_id", "turn", F.coalesce("inside", "earlier").alias("before"))


def thread_roots(links: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``root``: where following ``parent`` ends, by pointer doubling."""
    roots = materialize(links.select("conv_id", "turn", F.col("parent").alias("root")))
    while True:
        up = roots.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"))
        moved = materialize(roots.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        roots = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return roots


def link_conversations(messages: DataFrame) -> DataFrame:
    """Every message with ``parent_turn``, ``thread_turn``, ``quote_levels``, ``n_quoted`` and ``n_linked``; see the module."""
    parsed = materialize(parse(messages))
    links = quote_links(parsed)
    per = materialize(links.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quoted"), F.count("from_turn").alias("n_linked"),
        F.max(F.when(F.col("from_conv") == F.col("conv_id"), F.struct((-F.col("level")).alias("level"), F.col("from_turn").alias("parent")))).alias("best"),
    ))
    linked = per.where("best is not null").select("conv_id", "turn", F.col("best.parent").alias("parent"))
    roots = thread_roots(linked)
    turns = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    about = turns_before(turns).join(per, ["conv_id", "turn"], "left").join(roots, ["conv_id", "turn"], "left")
    about = about.select("conv_id", "turn", F.coalesce("best.parent", "before").alias("parent_turn"), F.coalesce("root", "turn").alias("thread_turn"), F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    out = parsed.join(about, ["conv_id", "turn"], "left")
    levels = F.coalesce(F.array_max("passages.level"), F.lit(0))
    return out.select("conv_id", "turn", "role", "text", "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), levels.alias("quote_levels"), F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))


def op7_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_conversations(table(spark, sf_dir, "conversations"))
