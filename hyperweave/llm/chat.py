"""Chat formatting as a prefix tree.

Conversations are formatted turn by turn with marks around each turn. Control strings inside a text are
escaped by a backslash, reversibly. Conversations that start with the same turns share the tree's nodes: a node
is a turn after a given sequence of turns, known by a digest chained over them, so equal nodes of different
conversations meet in one row by grouping, never in one task's memory.

Conversations are ranked by the sequence of their nodes' names; a node belongs to the first conversation that
has it, and the order by that rank and the depth is the depth-first order of the tree. Each node's characters
are emitted once; running sums over ranges of that order give its place in the whole sequence. Every character
carries its position in its conversation (the position id: the node's position plus its own in the piece), and
each node the intervals of its ancestors in the sequence, which its characters may attend to. Units are characters,
so that any tokenizer can follow.

The sequence itself is a table of blocks of characters. A conversation is read back from it alone: the intervals of
its last node and that node's own are cut at the blocks' ends and fetched from them.

Templates: ``<s>`` and ``</s>`` around a conversation, ``[INST] `` and `` [/INST]`` around a user's turn,
``<<SYS>>`` and ``<</SYS>>`` around a system's turn, ``<<AST>>`` and ``<</AST>>`` around an assistant's, and
``<<ROLE name>>`` and ``<</ROLE>>`` around any other's.

Defined results: null texts are empty, null roles are the empty role; turns with equal numbers are ordered by
role and text; a repeated turn counts each time; each row without conv_id is a conversation of its own, of id null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from hyperweave.functions.state import hot_keys, look_up

from .common import cut

# Fixed values of the template.
BEGIN, END = "<s>", "</s>"
OPEN = {"user": "[INST] ", "system": "<<SYS>>", "assistant": "<<AST>>"}
CLOSE = {"user": " [/INST]", "system": "<</SYS>>", "assistant": "<</AST>>"}
OTHER_OPEN, OTHER_NAME_END, OTHER_CLOSE = "<<ROLE ", ">>", "<</ROLE>>"
#: What a text may not hold bare: the escape itself and the first letter of every mark.
ESCAPED = re.compile(r"[\\<\[]")
UNESCAPED = re.compile(r"\\(.)", re.S)
#: Hexadecimal digits of a node's name, and characters of a block of the sequence.
NAME_CHARS, BLOCK = 32, 4096


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and end of its escaped text in it)."""
    if role in OPEN:
        head, tail = OPEN[role], CLOSE[role]
    else:
        name = escape(role).replace(">", "\\>")
        head, tail = OTHER_OPEN + name + OTHER_NAME_END, OTHER_CLOSE
    body = escape(text)
    return head + body + tail, len(head), len(head) + len(body)


TURN = re.compile(
    r"\[INST\] (?P<user>[^\\\[<]*(?:\\.[^\\\[<]*)*) \[/INST\]"
    r"|<<SYS>>(?P<system>[^\\\[<]*(?:\\.[^\\\[<]*)*)<</SYS>>"
    r"|<<AST>>(?P<assistant>[^\\\[<]*(?:\\.[^\\\[<]*)*)<</AST>>"
    r"|<<ROLE (?P<name>(?:[^\\>]|\\.)*)>>(?P<other>[^\\\[<]*(?:\\.[^\\\[<]*)*)<</ROLE>>",
    re.S,
)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns of a formatted conversation; start and end are those of the escaped text."""
    out, at = [], len(BEGIN)
    if not formatted.startswith(BEGIN) or not formatted.endswith(END):
        raise ValueError("not a formatted conversation")
    while at < len(formatted) - len(END):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        if m["other"] is not None:
            role, group = unescape(m["name"]), "other"
        else:
            role = group = next(r for r in OPEN if m[r] is not None)
        out.append((role, unescape(m[group]), m.start(group), m.end(group)))
        at = m.end()
    return out


def conversations_of(rows: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, key (its nodes' names, joined) and its turns as nodes.

    A node's name is a digest chained over the turns, so it tells the whole prefix. Sorted by key,
    conversations that share a prefix are neighbours.
    """
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("one"),
    )
    whole = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    whole = whole.union(turns.where("conv_id is null").select("conv_id", F.array("one")))

    def shape(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys, nodes = [], []
            for turns in f["turns"]:
                name, position, own = "", 0, []
                for t in turns:
                    piece, start, end = format_turn(t["role"], t["text"])
                    if not own:
                        piece, start, end = BEGIN + piece, start + len(BEGIN), end + len(BEGIN)
                    name = _sha(f"{name}\n{len(t['role'])}\n{t['role']}\n{t['text']}")[:NAME_CHARS]
                    own.append((name, t["role"], piece, start, end, position))
                    position += len(piece)
                keys.append("".join(n[0] for n in own))
                nodes.append(own)
            yield pd.DataFrame({"conv_id": f["conv_id"], "key": keys, "nodes": nodes})

    return whole.mapInPandas(shape, f"conv_id long, key string, nodes array<struct<{NODE}>>")


NODE = "node:string,role:string,piece:string,text_from:int,text_to:int,position:long"


def ranked(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, k, node, role, piece, ...): the nodes of all conversations, ranked in the order of their keys."""
    ordered = conversations.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    rank = F.monotonically_increasing_id()  # grows from range to range and within each
    ordered = cut(ordered.select("conv_id", rank.alias("rank"), "nodes"))
    return ordered.select("conv_id", "rank", F.posexplode("nodes").alias("k", "n")).select("conv_id", "rank", "k", "n.*")


def tree(rows: DataFrame) -> DataFrame:
    """The prefix tree in depth-first order, one row for each node, from the rows of ``ranked``.

    Columns: node, rank and k (the first conversation with it, and its depth), role, piece (its characters),
    text_from and text_to (its escaped text in the piece), position (id of its first character in a
    conversation), place (of its first character in the whole sequence), size, conversations (that pass
    through it) and ancestors (intervals of the sequence that it may attend to, root first).
    """
    owners = cut(rows.groupBy("node").agg(F.min("rank").alias("owner"), F.count("*").alias("conversations")))
    first = owners.select(F.col("node").alias("own"), "owner", "conversations")
    emitted = rows.join(first, (rows.node == first.own) & (rows["rank"] == first.owner)).drop("own", "owner", "conv_id")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, total = TaskContext.get().partitionId(), 0
        for f in frames:
            f["size"] = f["piece"].str.len()
            f["within"] = total + f["size"].cumsum() - f["size"]
            total += int(f["size"].sum())
            yield f.assign(part=part)

    kinds = "rank long, k int, node string, role string, piece string, text_from int, text_to int, position long"
    cols = [c.split()[0] for c in kinds.split(", ")]
    ranged = emitted.select(*cols, "conversations").repartitionByRange("rank", "k").sortWithinPartitions("rank", "k")
    laid = cut(ranged.mapInPandas(place, f"{kinds}, conversations long, size long, within long, part int"))
    # One row for each range.
    sums = laid.groupBy("part").agg(F.sum("size").alias("sum"))
    before = F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    placed = laid.join(offsets, "part").withColumn("place", F.col("offset") + F.col("within")).drop("offset", "within", "part")
    placed = cut(placed)
    return placed.join(_ancestors(rows, placed), "node")


def _ancestors(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """(node, ancestors): a conversation's nodes lie in the sequence in runs, each owned by one conversation.

    Each run is one interval; a node attends to the runs before its own and to its own up to itself.
    """
    known = placed.select(F.col("node").alias("of"), F.col("rank").alias("owner"), "place", "size")
    path = rows.select("rank", "k", F.col("node").alias("of"))
    path = look_up(path, ["of"], known, hot_keys(path, ["of"])).withColumnRenamed("of", "node")
    path = path.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("k", "node", "owner", "place", "size"))).alias("path"))

    def spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for rank, path in zip(f["rank"], f["path"]):
                runs: list[tuple[int, int]] = []
                owner = None
                for n in path:
                    if n["owner"] == rank:
                        out.append((n["node"], list(runs)))
                    span = (int(n["place"]), int(n["place"] + n["size"]))
                    if runs and n["owner"] == owner and runs[-1][1] == span[0]:
                        runs[-1] = (runs[-1][0], span[1])
                    else:
                        runs.append(span)
                    owner = n["owner"]
            yield pd.DataFrame(out, columns=["node", "ancestors"])

    return path.mapInPandas(spans, "node string, ancestors array<struct<start:long,end:long>>")


def sequence(nodes: DataFrame) -> DataFrame:
    """(block, text): the characters of the tree in depth-first order, BLOCK in each row but the last."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for place, piece in zip(f["place"], f["piece"]):
                at = 0
                while at < len(piece):
                    block, within = divmod(int(place) + at, BLOCK)
                    to = at + BLOCK - within
                    out.append((block, within, piece[at:to]))
                    at = to
            yield pd.DataFrame(out, columns=["block", "within", "part"])

    parts = nodes.select("place", "piece").mapInPandas(split, "block long, within int, part string")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("within", "part"))), lambda x: x["part"]), "")
    return parts.groupBy("block").agg(text.alias("text"))


def read_back(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, from the sequence.

    A conversation is known by its last node: what that attends to, in order, and its own piece are fetched from the
    sequence's blocks and parsed again. The loss mask covers the text of the assistant's turns.
    """
    last = rows.groupBy("rank", "conv_id").agg(F.max_by("node", "k").alias("node"))
    known = nodes.select("node", F.concat("ancestors", F.array(F.struct(F.col("place").alias("start"), (F.col("place") + F.col("size")).alias("end")))).alias("spans"))
    spans = look_up(last, ["node"], known, hot_keys(last, ["node"])).select("rank", "conv_id", F.explode("spans").alias("s"))
    blocks = F.explode(F.sequence(F.floor(F.col("s.start") / BLOCK), F.floor((F.col("s.end") - 1) / BLOCK)))
    # Intervals come in the order of the sequence: a node stands behind all its ancestors.
    cuts = spans.select("rank", "conv_id", "s", blocks.alias("block")).select(
        "rank", "conv_id", "block", F.greatest("s.start", F.col("block") * BLOCK).alias("from"), F.least("s.end", (F.col("block") + 1) * BLOCK).alias("to")
    )
    cuts = cut(cuts)
    found = look_up(cuts, ["block"], cut(sequence(nodes)), hot_keys(cuts, ["block"]))
    part = F.substring("text", F.col("from") - F.col("block") * BLOCK + 1, F.col("to") - F.col("from"))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("from", part.alias("part")))), lambda x: x["part"])
    whole = found.groupBy("rank", "conv_id").agg(F.concat(F.array_join(pieces, ""), F.lit(END)).alias("formatted"))

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text in f["formatted"]:
                turns = parse(text)
                named = "".join(f"{role}\n{said}\n" for role, said, _, _ in turns)
                loss = "".join(unescape(text[a:b]) for role, _, a, b in turns if role == "assistant")
                out.append((len(turns), _sha(named), len(loss), _sha(loss), len(text)))
            frame = pd.DataFrame(out, columns=COLUMNS[1:])
            frame.insert(0, "conv_id", f["conv_id"].to_numpy())
            yield frame

    return whole.select("conv_id", "formatted").mapInPandas(digest, KINDS)


def formatted(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): every conversation's nodes in order, and the emitted tree."""
    rows = ranked(conversations_of(conversations))
    return rows, cut(tree(rows))


COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
KINDS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
