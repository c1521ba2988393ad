"""Chat formatting as prefix trees: conversations that share their first turns share those turns' tokens.

A turn is a node whose identity is a chain of hashes from the first turn on. Conversations with one first turn make a
tree; a tree is laid out depth first, each shared turn once, and every node gets its tokens' ids, its position along its own
path, and the intervals of its ancestors, which is what it may attend to besides itself.

A turn whose conversations have more than ``max_chars`` together (the first turn of a third of all conversations, say) stands
alone in a layout, and what comes behind it in layouts of their own, which refer to it by its name: so every shared turn
is emitted once whatever the tree's size, and a task holds about ``max_chars`` and one conversation at most.

Tokens are a byte-level BPE's ids (by ranks, see ``bpe``) and two more behind the vocabulary for the marks of a turn. A text is
encoded apart from what stands around it, so the loss mask is an interval of whole tokens.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lumenfold.llm.bpe import Codec, codec
from lumenfold.llm.common import broadcast_file, lean, release, ship, stored

START, END = "<|im_start|>", "<|im_end|>\n"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_BACK = re.compile(r"<\\\||\\\\|\\n")
_MEANS = {"<\\|": "<|", "\\\\": "\\", "\\n": "\n"}
#: Up to so many large turns, and bytes of their ids, are broadcast (both are counted first); more are joined by a shuffle.
FEW, FEW_BYTES = 200_000, 16 << 20


def escape(text: str) -> str:
    """No control string is left: they all begin with ``<|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: _MEANS[m[0]], text)


def render(role: str, text: str) -> tuple[str, int]:
    """A turn in the template, and where its text begins in it. A role's line breaks are escaped too."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    return head + escape(text) + END, len(head)


class Formatter:
    """Turns to ids and back. The marks are two ids behind the vocabulary."""

    def __init__(self, own: Codec) -> None:
        self.own = own
        self.start = max(own.ranks.values()) + 1
        self.end = self.start + 1
        self.before, self.after = array("I", [self.start]).tobytes(), array("I", [self.end]).tobytes() + own.encode("\n")

    def ids(self, role: str, text: str) -> tuple[bytes, int, int]:
        """A turn's ids, and where those of its text begin and end in them."""
        head = self.before + self.own.encode(escape(role).replace("\n", "\\n") + "\n")
        body = self.own.encode(escape(text))
        return head + body + self.after, len(head) // 4, (len(head) + len(body)) // 4

    def text(self, ids: bytes) -> str:
        marks = np.flatnonzero(np.frombuffer(ids, np.uint32) >= self.start).tolist()
        out, done = [], 0
        for i in marks:
            out += [self.own.decode(ids[done : 4 * i]), b"<|im_start|>" if ids[4 * i : 4 * i + 4] == self.before else b"<|im_end|>"]
            done = 4 * i + 4
        return b"".join([*out, self.own.decode(ids[done:])]).decode()


def formatter(file: bytes, pattern: str) -> Formatter:
    return Formatter(codec(file, pattern))


TURNS = "conv_id {}, depth int, node binary, parent binary, role string, text string, chars long, total long, is_last boolean"


def turns(conversations: DataFrame) -> DataFrame:
    """Each conversation's turns in order as nodes of chained hashes, with the conversation's characters. Rows come sorted, so a task
    holds one conversation at a time."""
    kind = dict(conversations.dtypes)["conv_id"]
    names = [c.split()[0] for c in TURNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, rows = None, [], []
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

        def close() -> None:
            total = sum(r[6] for r in held)
            rows.extend((*r, total, i == len(held) - 1) for i, r in enumerate(held))
            held.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for b in batches:
            types[0] = b.column(0).type
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and conv != key:
                    close()
                    if len(rows) >= 2000:
                        yield batch()
                key, role, text = conv, role or "", text or ""
                node = held[-1][2] if held else b""
                name = hashlib.blake2b(node + len(role).to_bytes(4, "big") + role.encode() + text.encode(), digest_size=16).digest()
                held.append((conv, len(held), name, node, role, text, len(render(role, text)[0])))
        if held:
            close()
        if rows:
            yield batch()

    ordered = conversations.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(lean(run), TURNS.format(kind))


def lengths(rows: DataFrame, file, pattern: str) -> DataFrame:
    """(node, length): the number of a turn's tokens, from (node, role, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = formatter(file.value, pattern)
        for b in batches:
            n = [len(made.ids(role, text)[0]) // 4 for role, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["node", "length"])

    return rows.select("node", "role", "text").mapInArrow(lean(run), "node binary, length long")


INTERVALS = "array<struct<layout:string,start:bigint,stop:bigint>>"
NODES = f"layout string, node binary, parent binary, depth int, role string, ids binary, offset long, position long, ancestors {INTERVALS}, loss_start long, loss_stop long, ends boolean"


def layouts(conversations: DataFrame, ranks_path: str, pattern: str, max_chars: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """(nodes, members). Nodes, a row a turn of the trees: its ``ids`` (unsigned 32-bit) at ``offset`` of its ``layout``, ``position``
    on its path, the ``ancestors``' intervals (layout, start, stop; adjacent ones of a layout merged), and the interval under the
    loss mask (assistants' texts), all in tokens. ``ends``: a conversation ends there. Members: conv_id and its layout and last node.

    Null texts and roles count as empty; a null conv_id is a conversation of its own; equal (conv_id, turn) rows are
    turns of their own, ordered by role and text. Other columns are not carried. Conversations without rows don't exist.
    """
    ship(conversations.sparkSession)
    file = broadcast_file(conversations.sparkSession, ranks_path)
    flat = stored(turns(conversations), "chat-turns", "zstd")
    large = stored(flat.groupBy("node").agg(F.sum("total").alias("w")).where(F.col("w") > max_chars).select("node"), "chat-large")
    few = large.count() <= FEW
    # Only of large turns the number of tokens is needed before they are laid out; every turn is encoded once there.
    texts = flat.join(F.broadcast(large) if few else large, "node", "left_semi").groupBy("node").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    marked = stored(lengths(texts, file, pattern).withColumn("large", F.lit(True)), "chat-large")
    slim = flat.select("conv_id", "depth", "node", "is_last").join(F.broadcast(marked) if few else marked, "node", "left")
    # Large turns are the first ones of a conversation: whoever has them all has the ones before them.
    path = Window.partitionBy("conv_id")
    trunk = F.collect_list(F.when(F.col("large"), F.struct("depth", F.hex("node").alias("layout"), "length"))).over(path)
    first_small = F.min(F.when(F.col("large").isNull(), F.struct("depth", F.hex("node").alias("layout")))).over(path)
    placed = slim.select("node", "is_last", F.when(F.col("large"), F.hex("node")).otherwise(first_small["layout"]).alias("layout"), F.transform(F.array_sort(F.filter(trunk, lambda x: x["depth"] < F.col("depth"))), lambda x: F.struct(x["layout"].alias("layout"), F.lit(0).cast("long").alias("start"), x["length"].alias("stop"))).alias("above"))
    info = stored(placed.groupBy("node").agg(F.min("layout").alias("layout"), F.first("above").alias("above"), F.max("is_last").alias("ends")), "chat-places")
    own = flat.groupBy("node").agg(*(F.first(c).alias(c) for c in ("parent", "depth", "role", "text")))
    rows = own.join(info, "node").select("layout", "node", "parent", "depth", "role", "text", "above", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _lay_out(batches, formatter(file.value, pattern))

    nodes = stored(rows.repartition("layout").sortWithinPartitions("layout", "depth", "node").mapInArrow(lean(run), NODES), "chat-nodes", "zstd")
    leaves = flat.where("is_last").select("conv_id", F.col("node").alias("leaf"))
    members = stored(leaves.join(info.select(F.col("node").alias("leaf"), "layout"), "leaf").select("conv_id", "layout", "leaf"), "chat-members")
    release(flat, large, marked, info)
    return nodes, members


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one value of the first column after another."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and row["layout"] != held[0]["layout"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _lay_out(batches: Iterator[pa.RecordBatch], made: Formatter) -> Iterator[pa.RecordBatch]:
    names = ["layout", "node", "parent", "depth", "role", "ids", "offset", "position", "ancestors", "loss_start", "loss_stop", "ends"]
    interval = pa.struct([("layout", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
    types = [pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.list_(interval), pa.int64(), pa.int64(), pa.bool_()]
    for rows in _groups(batches):
        layout = rows[0]["layout"]
        nodes = {r["node"]: r for r in rows}
        children: dict[bytes, list[bytes]] = {}
        for r in rows:
            children.setdefault(r["parent"] if r["parent"] in nodes else b"", []).append(r["node"])
        offset, out = 0, []
        stack = [(x, sum(a["stop"] for a in nodes[x]["above"]), [(a["layout"], a["start"], a["stop"]) for a in nodes[x]["above"]]) for x in reversed(children.get(b"", []))]
        while stack:
            node, position, above = stack.pop()
            r = nodes[node]
            ids, start, stop = made.ids(r["role"], r["text"])
            end = offset + len(ids) // 4
            loss = (offset + start, offset + stop) if r["role"] == "assistant" else (None, None)
            out.append((layout, node, r["parent"], r["depth"], r["role"], ids, offset, position, [{"layout": n, "start": a, "stop": z} for n, a, z in above], *loss, r["ends"]))
            last = above[-1] if above else None
            seen = [*above[:-1], (layout, last[1], end)] if last and last[0] == layout and last[2] == offset else [*above, (layout, offset, end)]
            stack.extend((x, position + end - offset, seen) for x in reversed(children.get(node, [])))
            offset = end
        for i in range(0, len(out), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 2000], strict=True), types, strict=True)], names)


READ = "layout string, leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(nodes: DataFrame, members: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """For each conversation, from the layouts alone: its ids are what its last node attends to, and that node's. Their text is
    parsed by the template and unescaped; the loss text is what the mask covers."""
    file = broadcast_file(nodes.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = formatter(file.value, pattern)
        names = [c.split()[0] for c in READ.split(", ")]
        for rows in _groups(batches):
            layout = rows[0]["layout"]
            held = {r["other"]: r for r in rows if r["other"] is not None}
            rows = [r for r in rows if r["other"] is None]
            sequence = b"".join(r["ids"] for r in rows)
            masks = {r["offset"]: (r["loss_start"], r["loss_stop"]) for r in rows if r["loss_start"] is not None}
            starts = sorted(masks)
            out = []
            for r in rows:
                if not r["ends"]:
                    continue
                ids, said = [], []
                for a in [*r["ancestors"], {"layout": layout, "start": r["offset"], "stop": r["offset"] + len(r["ids"]) // 4}]:
                    if a["layout"] == layout:
                        ids.append(sequence[4 * a["start"] : 4 * a["stop"]])
                        said += [sequence[4 * masks[s][0] : 4 * masks[s][1]] for s in _within(starts, a["start"], a["stop"])]
                    else:
                        o = held[a["layout"]]
                        ids.append(o["ids"])
                        said += [o["ids"][4 * o["loss_start"] : 4 * o["loss_stop"]]] if o["loss_start"] is not None else []
                text = made.text(b"".join(ids))
                found = [(unescape(role), unescape(said)) for role, said in TURN.findall(text)]
                digest = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in found).encode())
                loss = "".join(unescape(made.text(x)) for x in said)
                out.append((layout, r["node"], len(found), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if out:
                types = [pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    columns = ["layout", "node", "offset", "ids", "ancestors", "loss_start", "loss_stop", "ends", "other"]
    # Turns that stand alone in a layout go to the layouts that refer to them.
    refers = nodes.select("layout", F.explode("ancestors.layout").alias("other")).where("layout <> other").distinct()
    alone = nodes.join(refers.select(F.col("other").alias("layout")).distinct(), "layout", "left_semi").select(F.col("layout").alias("other"), "node", "offset", "ids", "ancestors", "loss_start", "loss_stop", F.lit(False).alias("ends"))
    size = alone.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("ids")), F.lit(0)).alias("bytes")).first()
    few = size.n <= FEW and size.bytes <= FEW_BYTES
    sent = refers.join(F.broadcast(alone) if few else alone, "other").select(*columns)
    every = nodes.withColumn("other", F.lit(None).cast("string")).select(*columns).unionByName(sent)
    ordered = every.repartition("layout").sortWithinPartitions("layout", F.col("other").isNull(), "offset")
    return members.join(ordered.mapInArrow(lean(run), READ), ["layout", "leaf"]).drop("layout", "leaf")


def _within(starts: list[int], a: int, z: int) -> Iterator[int]:
    for i in range(bisect_left(starts, a), len(starts)):
        if starts[i] >= z:
            break
        yield starts[i]
