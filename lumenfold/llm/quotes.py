"""Quotation linking: conversations in reply order, with quoted passages resolved to the messages they come from."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import written
from lumenfold.operators.ordering import with_ordinal

#: Rows of a conversation that are numbered in one window; longer conversations are numbered slice by slice.
NUMBERED = 100_000
_MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_ATTRIBUTION = re.compile(r"^[^\n]{0,300}\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$", re.I)


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The message without its quotations, and the quoted passages as (level, text), level 1 being the outermost.

    A passage is a run of lines of one level. An attribution line right before a quotation goes with it.
    """
    if ">" not in text:
        return text, []
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    last = 0
    for line in text.split("\n"):
        mark = _MARK.match(line)
        level = mark[1].count(">") if mark else 0
        if not level:
            own.append(line)
        else:
            if last != level:
                if not last:
                    while own and not own[-1].strip():
                        own.pop()
                    if own and _ATTRIBUTION.match(own[-1]):
                        own.pop()
                quoted.append((level, []))
            quoted[-1][1].append(line[mark.end():])
        last = level
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n"), [(k, "\n".join(x)) for k, x in quoted]


def normal(text: str) -> str:
    """Lower-case words with single spaces."""
    return " ".join(text.casefold().split())


def passages(text: str) -> list[str]:
    """What others may quote of a message: the whole, its paragraphs and its lines, normalised."""
    parts = [text, *re.split(r"\n\s*\n", text), *text.split("\n")]
    return list(dict.fromkeys(x for x in map(normal, parts) if x))


_PARSED = "conv_id long, turn long, role string, text string, own array<string>, levels array<int>, quotes array<string>, lines array<array<string>>"


def _parsed(messages: DataFrame) -> DataFrame:
    texts, numbers = pa.list_(pa.string()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x or "") for x in batch.column("text").to_pylist()]
            quotes = [[(k, normal(x), [n for n in map(normal, x.split("\n")) if n]) for k, x in q] for _, q in found]
            quotes = [[x for x in q if x[1]] for q in quotes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array([x for x, _ in found], pa.string()),
                 pa.array([passages(x) for x, _ in found], texts), pa.array([[x[0] for x in q] for q in quotes], numbers),
                 pa.array([[x[1] for x in q] for q in quotes], texts), pa.array([[x[2] for x in q] for q in quotes], pa.list_(texts))],
                ["conv_id", "turn", "role", "text", "own", "levels", "quotes", "lines"])

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                           F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PARSED)


def _parents(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, linked): the earlier message that each quoting one answers, and how many passages linked.

    A passage comes from the first message of the conversation that has it, if that is an earlier one: as a whole,
    or else line by line. The answered message is the origin of the passage of the lowest level, then of the most
    characters, then the latest. Originals are one row for each conversation and hash, so a common line joins once.
    """
    named = rows.where("conv_id is not null and turn is not null")
    quoted = named.where("size(quotes) > 0").select("conv_id", "turn", F.posexplode(F.arrays_zip("levels", "quotes", "lines")).alias("at", "q"))
    quoted = quoted.select("conv_id", "turn", "at", F.col("q.levels").alias("level"),
                           F.explode(F.array_distinct(F.concat(F.array("q.quotes"), "q.lines"))).alias("piece"))
    quoted = quoted.select("conv_id", "turn", "at", "level", F.xxhash64("piece").alias("h"), F.hash("piece").alias("g"), F.length("piece").alias("size"))
    wanted = quoted.select("conv_id", "h", "g").distinct()
    origin = named.select("conv_id", F.col("turn").alias("origin"), F.explode("own").alias("piece"))
    origin = origin.select("conv_id", "origin", F.xxhash64("piece").alias("h"), F.hash("piece").alias("g"))
    origin = origin.join(wanted, ["conv_id", "h", "g"], "left_semi").groupBy("conv_id", "h", "g").agg(F.min("origin").alias("origin"))
    found = quoted.join(origin, ["conv_id", "h", "g"]).where("origin < turn")
    best = found.groupBy("conv_id", "turn", "at").agg(F.min(F.struct("level", -F.col("size"), -F.col("origin"))).alias("best"))
    return best.groupBy("conv_id", "turn").agg((-F.min("best")["col3"]).alias("parent"), F.count("*").alias("linked"))


def _roots(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, linked, root, depth): pointers are doubled until every one ends, log(depth) rounds."""
    now = written(parents.withColumns({"root": F.col("parent"), "depth": F.lit(1).cast("long"), "open": F.lit(True)}), "replies")
    while now.where("open").limit(1).count():
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("_up"), F.col("depth").alias("_more"))
        joined = now.join(up, ["conv_id", "root"], "left")
        now = written(joined.select("conv_id", "turn", "parent", "linked", F.coalesce("_up", "root").alias("root"),
                                    (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_up").isNotNull().alias("open")), "replies")
    return now.drop("open")


def link_quotations(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) without quotations, each with its place in the order of replies.

    Returns conv_id, turn, role, text (quotations and their attribution lines removed), n_quotes and n_linked passages,
    max_level, parent_turn (the message that is answered; null without a linked quotation), root_turn, depth and
    position, from 0. Positions go thread by thread in order of the threads' first turns, and by turn in a thread, so an
    answer follows what it answers.

    Passages are compared lower-cased with single spaces, by 96 bits of hashes, within the conversation. Null text is
    empty; rows without conv_id or turn are not linked, and rows without conv_id share one sequence of positions; rows
    of one turn share their links and are ordered by role and text; an empty table gives no rows; other columns are
    ignored.
    """
    rows = written(_parsed(messages), "messages")
    links = _roots(_parents(rows)).select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), "parent", "linked", "root", "depth")
    joined = rows.join(links, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    joined = joined.select(
        "conv_id", "turn", "role", "text", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce(F.array_max("levels"), F.lit(0)).cast("long").alias("max_level"), F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))
    out = joined.withColumn("_key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    first = F.coalesce("root_turn", F.lit(0))
    return with_ordinal(out, "_key", first, ["turn", "role", "text"], "position", NUMBERED).drop("_key")
