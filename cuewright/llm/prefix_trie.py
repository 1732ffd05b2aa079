"""The trie of all conversations' beginnings, from their globally sorted arrays of turns.

A conversation is an array of turn digests, 16 bytes each. Arrays are range partitioned and sorted over the whole table,
so conversations that begin alike are neighbours, and one sweep over neighbours makes the trie: the common prefix of two
neighbours says which open nodes end and a stack holds the rest. A node that closes hands its counts to the one below.

A partition cannot know how the one before it ends. The nodes on the path of its first row and those that are open
behind its last row are not given out but summarised, a few numbers for each level, and one more sweep over the
summaries, a row for each partition, closes them: the stacks are stitched where partitions meet.

Ids that end at one node are hashed at once where they are few. Where they are many, or may reach over the border of a partition,
they are written in pieces and hashed piece by piece afterwards, so that a conversation that a third of all are copies of is held
nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm._shared import small_batches, written

TURN = 16  # bytes of a turn's digest
PIECE_IDS = 4096
BATCH_ROWS = 4096
NOBODY = hashlib.sha256(b"").hexdigest()

_TURNS = "array<struct<digest:string,chars:int>>"
_SPINE = "array<struct<side:int,depth:int,first:bigint,least:bigint,n:bigint,children:bigint,leaves:bigint,saved:bigint,tokens:bigint,ends:string,mark:string>>"
_SWEPT = (
    "kind string, first long, depth int, parent long, least long, n long, children long, leaves long, saved long, ends string, mark string, "
    f"ids string, first_key binary, last_key binary, shared int, spine {_SPINE}"
)
_NUMBERS = ("first", "parent", "least", "n", "children", "leaves", "saved")
_ARROW = pa.schema(
    [
        ("kind", pa.string()), *((c, pa.int64()) for c in _NUMBERS[:1]), ("depth", pa.int32()), *((c, pa.int64()) for c in _NUMBERS[1:]), ("ends", pa.string()), ("mark", pa.string()),
        ("ids", pa.string()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("shared", pa.int32()),
        ("spine", pa.list_(pa.struct([("side", pa.int32()), ("depth", pa.int32()), *((c, pa.int64()) for c in ("first", "least", "n", "children", "leaves", "saved", "tokens")), ("ends", pa.string()), ("mark", pa.string())]))),
    ]
)


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` of ``turns(conv_id, turn, role, text)``: each conversation's turns in order, a missing number
    first and equal numbers by digest, as digests of role and text and the text's length in code points.

    A missing role or text is empty. Rows without an id are no conversation. A conversation is one row: 20 bytes
    a turn, whatever the texts hold."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN)
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.length(text).alias("chars")).alias("x"))
    return own.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["digest"].alias("digest"), x["chars"].alias("chars"))).alias("turns"))


def with_shared_starts(convs: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """``convs`` rebuilt: the first turns of the conversation whose id is the next lower multiple of ``every``, then the own
    turns behind as many. How many is the id's CRC-32 modulo ``most``; a shorter or absent conversation gives what it has."""
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("__base"), F.slice("turns", 1, most).alias("__head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    head = F.slice(F.coalesce("__head", F.array().cast(_TURNS)), F.lit(1), h)
    return convs.join(heads, base == F.col("__base"), "left").select("conv_id", F.concat(head, own).alias("turns"))


@dataclass
class _Ends:
    """The ids that end at a node; ``PIECE_IDS`` or more are put out in pieces."""

    mark: str
    put: Callable[[dict], None]
    held: list[int] = field(default_factory=list)
    begun: bool = False
    pieces: bool = False

    def add(self, conv_id: int) -> None:
        self.held.append(conv_id)
        if len(self.held) >= PIECE_IDS:
            self.flush()

    def flush(self) -> None:
        self.pieces = True
        if self.held:
            self.put({"kind": "ends", "mark": self.mark, "first": self.held[0], "ids": ",".join(map(str, self.held))})
            self.held.clear()

    def result(self, at_border: bool) -> dict:
        if self.pieces or at_border:
            self.flush()
            return {"ends": None, "mark": self.mark}
        return {"ends": hashlib.sha256(",".join(map(str, self.held)).encode()).hexdigest(), "mark": None}


@dataclass
class _Node:
    """An open node: what its closed children and the conversations that end at it have brought so far."""

    first: int
    tokens: int
    least: int | None = None
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: _Ends | None = None
    digest: dict = field(default_factory=dict)  # once known
    others: list[int] = field(default_factory=list)  # what it is called in later partitions

    def take(self, least: int | None, n: int, children: int, leaves: int, saved: int) -> None:
        self.least = least if self.least is None else self.least if least is None else min(self.least, least)
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved

    def closed(self, below: _Node | None) -> dict:
        """The finished node's numbers; ``below`` gets them added."""
        leaves = self.leaves if self.children else 1
        saved = self.saved + (self.n - 1) * self.tokens
        if below is not None:
            below.take(self.least, self.n, 1, leaves, saved)
        return {"first": self.first, "parent": below and below.first, "least": self.least, "n": self.n, "children": self.children, "leaves": leaves, "saved": saved}


def common(a: bytes, b: bytes) -> int:
    """How many turns two arrays of digests begin with together."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // TURN
    low, high = 0, most // TURN  # the first ``low`` turns are the same, not all of the first ``high``
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[TURN * low : TURN * mid] == b[TURN * low : TURN * mid] else (low, mid)
    return low


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that begin and end within a partition of sorted ``conv_id, key, chars``, pieces of ids, and the summary."""
    out: list[dict] = []
    stack: list[_Node] = []
    border: list[dict] = []
    start = last = None  # the first row, the last key

    def spine(side: int, depth: int, node: _Node) -> dict:
        if node.ends is not None:
            on_edge = TURN * depth == len(start[1] if side == 0 else last) or TURN * depth == len(last)
            node.digest = node.ends.result(on_edge)
        numbers = {"first": node.first, "least": node.least, "n": node.n, "children": node.children, "leaves": node.leaves, "saved": node.saved, "tokens": node.tokens}
        return {"side": side, "depth": depth, **numbers, "ends": node.digest.get("ends"), "mark": node.digest.get("mark")}

    def close(depth: int) -> None:
        while len(stack) > depth + 1:
            node = stack.pop()
            if node.first == start[0]:
                border.append(spine(0, len(stack), node))
                continue
            digest = node.ends.result(False) if node.ends else {"ends": NOBODY, "mark": None}
            out.append({"kind": "node", "depth": len(stack), **node.closed(stack[-1]), **digest})

    for batch in batches:
        for conv_id, key, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "chars")), strict=True):
            if start is None:
                start, last = (conv_id, key), b""
                stack.append(_Node(conv_id, 0))
            shared = common(last, key)
            close(shared)
            stack += [_Node(conv_id, chars[d]) for d in range(shared, len(chars))]
            last, node = key, stack[-1]
            if node.ends is None:
                node.ends = _Ends(hashlib.sha256(key).hexdigest(), out.append)
            node.ends.add(conv_id)
            node.take(conv_id, 1, 0, 0, 0)
            if len(out) >= BATCH_ROWS or (out and "ids" in out[-1]):
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                out.clear()
    if start is None:
        return
    open_from_start = sum(node.first == start[0] for node in stack)
    for depth, node in enumerate(stack):
        border.append(spine(0 if depth < open_from_start else 1, depth, node))
    border.sort(key=lambda x: (x["side"], x["depth"]))
    out.append({"kind": "part", "first": start[0], "first_key": start[1], "last_key": last, "shared": open_from_start - 1, "spine": border})
    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes on the borders, and ``alias`` rows with what they are called in other partitions, from all summaries in order."""
    out: list[dict] = []
    stack: list[_Node] = []
    last = None

    def close(depth: int) -> None:
        while len(stack) > depth + 1:
            node = stack.pop()
            digest = {"ends": node.digest.get("ends") or (None if node.digest.get("mark") else NOBODY), "mark": node.digest.get("mark")}
            out.append({"kind": "node", "depth": len(stack), **node.closed(stack[-1] if stack else None), **digest})
            out.extend({"kind": "alias", "first": x, "depth": len(stack), "least": node.least} for x in node.others)

    for batch in batches:
        for part in batch.select(["first_key", "last_key", "shared", "spine"]).to_pylist():
            if last is not None:
                close(common(last, part["first_key"]))
            for x in part["spine"]:
                if x["side"] == 1:
                    close(x["depth"] - 1)
                if x["depth"] == len(stack):
                    stack.append(_Node(x["first"], x["tokens"]))
                elif x["first"] != stack[x["depth"]].first:
                    stack[x["depth"]].others.append(x["first"])
                node = stack[x["depth"]]
                node.take(x["least"], x["n"], x["children"], x["leaves"], x["saved"])
                node.digest |= {k: x[k] for k in ("ends", "mark") if x[k]}
            close(part["shared"] + sum(x["side"] for x in part["spine"]))
            last = part["last_key"]
            if len(out) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                out.clear()
    close(-1)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mark, hashed`` of pieces ``mark, ids`` in order."""
    at, held = None, None
    for batch in batches:
        for mark, ids in zip(batch.column("mark").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if mark != at:
                if held is not None:
                    yield pa.RecordBatch.from_pydict({"mark": [at], "hashed": [held.hexdigest()]})
                at, held = mark, hashlib.sha256()
            else:
                held.update(b",")
            held.update(ids.encode())
    if held is not None:
        yield pa.RecordBatch.from_pydict({"mark": [at], "hashed": [held.hexdigest()]})


def nodes(convs: DataFrame) -> DataFrame:
    """Every node of the trie of ``convs(conv_id, turns)``: each distinct beginning of ``depth`` turns, the root's being 0.

    ``conv_id``: the smallest conversation that begins so, a member; ``parent_conv_id``: that of the beginning shorter by a turn,
    null for the root; ``n_convs``: members; ``n_children``: beginnings longer by a turn; ``n_leaves``: childless nodes from
    here on; ``saved_tokens``: over the nodes from here on, the code points of their last turn times the members beyond the
    first; ``ends_sha256``: SHA-256 of the ids, ascending, of members without further turns.

    Ids are distinct. Conversations without turns are members of the root. Texts are told apart by 128 bits of SHA-256.
    No conversations, no rows.
    """
    small_batches(convs.sparkSession, BATCH_ROWS)
    key = F.unhex(F.array_join(F.transform("turns", lambda x: x["digest"]), ""))
    arrays = written(convs.select("conv_id", key.alias("key"), F.transform("turns", lambda x: x["chars"]).alias("chars")), "turn-arrays")
    ordered = arrays.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = written(ordered.mapInArrow(_sweep, _SWEPT), "swept")
    parts = swept.where("kind = 'part'").repartition(1).sortWithinPartitions("first_key", "first")
    joints = written(parts.mapInArrow(_stitch, _SWEPT), "stitched")
    made = swept.where("kind = 'node'").unionAll(joints.where("kind = 'node'")).select("first", "depth", "parent", "least", "n", "children", "leaves", "saved", "ends", "mark")
    pieces = swept.where("kind = 'ends'").select("mark", "first", "ids").repartition("mark").sortWithinPartitions("mark", "first")
    hashed = pieces.select("mark", "ids").mapInArrow(_hashed, "mark string, hashed string")
    whole = made.where("mark is null").unionAll(made.where("mark is not null").join(hashed, "mark").withColumn("ends", F.col("hashed")).select(*made.columns))
    called = made.select("first", "depth", "least").unionAll(joints.where("kind = 'alias'").select("first", "depth", "least"))
    up = called.select(F.col("first").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("parent_conv_id"))
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return whole.join(up, ["parent", "depth"], "left").select(
        long("least", "conv_id"), long("depth", "depth"), "parent_conv_id", long("n", "n_convs"), long("children", "n_children"),
        long("leaves", "n_leaves"), long("saved", "saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
