"""The trie of conversation prefixes, built as adaptive radix trees over ranges of sorted conversations.

A turn is a fixed-width number, the first 16 bytes of a SHA-256 of its role and text, big-endian; a conversation is the
string of its turns' numbers. Conversations are dealt to ranges of these strings, and within a string by conv_id, so that
copies of one conversation are spread too. Each range builds one adaptive radix tree and emits the nodes at whole turns.
Only nodes on the first and last string of a range can also be in other ranges: these are summed afterwards.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, ship, trimmed, written

#: Bytes of a turn's number.
WIDTH = 16
#: Turns of a range of conversations, about.
RANGE_TURNS = 200_000


class Few:
    """Up to 4, then up to 16 children: sorted bytes beside their nodes."""

    __slots__ = ("keys", "nodes")

    def __init__(self):
        self.keys, self.nodes = bytearray(), []

    def get(self, byte: int):
        at = self.keys.find(byte)
        return None if at < 0 else self.nodes[at]

    def put(self, byte: int, node) -> Few | Indexed:
        """The layout that holds the node: this one, or a larger one where this one is full."""
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.nodes[at] = node
        elif len(self.keys) == 16:
            larger = Indexed()
            for b, x in zip(self.keys, self.nodes):
                larger.put(b, x)
            return larger.put(byte, node)
        else:
            self.keys.insert(at, byte)
            self.nodes.insert(at, node)
        return self

    def children(self) -> list:
        return self.nodes


class Indexed:
    """Up to 48 children: a table from byte to place."""

    __slots__ = ("nodes", "places")

    def __init__(self):
        self.places, self.nodes = bytearray(b"\xff" * 256), []

    def get(self, byte: int):
        at = self.places[byte]
        return None if at == 255 else self.nodes[at]

    def put(self, byte: int, node) -> Indexed | Direct:
        if self.places[byte] != 255:
            self.nodes[self.places[byte]] = node
        elif len(self.nodes) == 48:
            larger = Direct()
            for b, at in enumerate(self.places):
                if at != 255:
                    larger.put(b, self.nodes[at])
            return larger.put(byte, node)
        else:
            self.places[byte] = len(self.nodes)
            self.nodes.append(node)
        return self

    def children(self) -> list:
        return [self.nodes[at] for at in self.places if at != 255]


class Direct:
    """Up to 256 children: a node or nothing for each byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> Direct:
        self.nodes[byte] = node
        return self

    def children(self) -> list:
        return [x for x in self.nodes if x is not None]


class Node:
    """path: the bytes from the node above to this one (path compression); ends: what was put at exactly this place."""

    __slots__ = ("ends", "layout", "path")

    def __init__(self, path: bytes):
        self.path, self.layout, self.ends = path, None, []

    def child(self, byte: int) -> Node | None:
        return self.layout and self.layout.get(byte)

    def put(self, node: Node) -> None:
        self.layout = (self.layout or Few()).put(node.path[0], node)

    def children(self) -> list[Node]:
        return self.layout.children() if self.layout else []


def shared_bytes(a: bytes, b: bytes) -> int:
    """Length of the longest common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class Radix:
    """An adaptive radix tree from byte strings to lists of what was put there."""

    def __init__(self):
        self.root = Node(b"")

    def put(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while at < len(key):
            below = node.child(key[at])
            if below is None:
                below = Node(key[at:])
                node.put(below)
                at = len(key)
            else:
                n = shared_bytes(below.path, key[at : at + len(below.path)])
                if n < len(below.path):
                    upper = Node(below.path[:n])
                    below.path = below.path[n:]
                    upper.put(below)
                    node.put(upper)
                    below = upper
                at += n
            node = below
        node.ends.append(value)


NODES = "pid int, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends binary"


def joined(ids: list[int]) -> bytes:
    return ",".join(map(str, sorted(ids))).encode()


def nodes_of_range(pid: int, rows: Iterator[tuple[int, bytes, list[int]]], before: bytes | None, after: bytes | None) -> dict[str, list]:
    """The nodes at whole turns of one range, as columns of NODES.

    before, after: the last string of the range before and the first of the range after. A node that one of these has
    too is shared; node is its digest, parent that of a shared parent. Sums count a shared child and its text in the
    first of its ranges, a shared leaf in the last.
    """
    tree, chars, low, high = Radix(), {}, None, None
    for conv, key, sizes in rows:
        tree.put(key, conv)
        for i, n in enumerate(sizes):
            chars[key[WIDTH * i : WIDTH * (i + 1)]] = n
        low, high = key if low is None else min(low, key), key if high is None else max(high, key)
    with_before = -1 if before is None else shared_bytes(before, low) // WIDTH
    with_after = -1 if after is None else shared_bytes(high, after) // WIDTH
    out: dict[str, list] = {c.split()[0]: [] for c in NODES.split(", ")}
    # on the way down: the node, the bytes above it, the length of its string; on the way up: what its children gave
    stack: list = [(tree.root, b"", None)]
    gave: list[list] = [[]]
    while stack:
        node, above, mine = stack.pop()
        if mine is None:
            full = above + node.path
            stack.append((node, above, full))
            gave.append([])
            stack.extend((x, full, None) for x in reversed(node.children()))
            continue
        below = gave.pop()
        pending = [i for x in below for i in x[0]]
        own, n, leaves, saved = (sum(x[k] for x in below) for k in (2, 3, 4, 5))
        least = min([*node.ends, *(x[1] for x in below)])
        n += len(node.ends)
        top = len(above) // WIDTH + 1 if node is not tree.root else 0
        for d in range(len(mine) // WIDTH, top - 1, -1):
            key = mine[: d * WIDTH]
            first, last = d <= with_before and low.startswith(key), d <= with_after and high.startswith(key)
            ends = node.ends if len(mine) == d * WIDTH else []
            if not pending and not last:
                leaves += 1
            if d:
                size = chars[key[-WIDTH:]]
                saved += n * size - (0 if first else size)
            name = hashlib.md5(key).digest() if first or last else None
            for i in pending:
                out["parent_conv_id"][i], out["parent"][i] = least, name
            text = joined(ends)
            row = pid, name, None, least, d, None, n, own, leaves, saved, None if name else hashlib.sha256(text).hexdigest(), text if name and ends else None
            for column, value in zip(out.values(), row):
                column.append(value)
            pending, own = [len(out["pid"]) - 1], 0 if first else 1
        gave[-1].append((pending, least, own, n, leaves, saved))
    return out


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, each its number in hex and the code points of its text.

    Turns without a number come first; turns of one number are in the order of theirs. Null roles and texts are empty;
    rows without conv_id belong to no conversation. Repeated rows are turns each. Texts do not leave their tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    number = F.substring(F.sha2(F.concat(F.hex(role), F.lit(":"), text), 256), 1, 2 * WIDTH)
    rows = conversations.where("conv_id is not null").select("conv_id", F.struct(F.col("turn").isNotNull().alias("known"), "turn", number.alias("id"), F.length(text).alias("n")).alias("t"))
    made = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return made.select(F.col("conv_id").cast("long"), F.transform("t", lambda x: F.struct(x["id"].alias("id"), x["n"].alias("n"))).alias("turns"))


def with_borrowed_heads(convs: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation behind the first h turns of its group's first one, without its own first h.

    h is the CRC-32 of the decimal conv_id modulo ``most``; the group's first conversation may be shorter or missing.
    """
    h, empty = F.crc32(F.col("conv_id").cast("string")) % most, F.slice("turns", 1, 0)
    heads = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, most - 1).alias("head"))
    both = convs.withColumn("first", F.col("conv_id") - F.col("conv_id") % group).join(heads, "first", "left")
    taken: Column = F.slice(F.coalesce("head", empty), F.lit(1), h.cast("int"))
    return both.select("conv_id", F.concat(taken, F.slice("turns", (h + 1).cast("int"), F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def prefix_nodes(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv_id, turns), one row each.

    conv_id: smallest member; depth; parent_conv_id: that of the parent; n_convs: members, conversations that begin with
    the node's turns; n_children; n_leaves: childless nodes of the subtree; saved_tokens: over the subtree, (n_convs - 1)
    times the code points of the last text; ends_sha256: of the decimal conv_ids that end here, ascending, with commas.
    The root has every conversation, those without turns too; an empty table has no node. A conversation is one string
    of 16 bytes a turn, the only thing of it that one task must hold.
    """
    spark = convs.sparkSession
    strings = written(convs.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("key"), F.col("turns.n").alias("chars")), "strings")
    turns = strings.agg(F.sum(F.size("chars") + 1)).first()[0] or 0
    ranged = written(strings.repartitionByRange(max(parts(spark), -(-turns // RANGE_TURNS)), "key", "conv_id").withColumn("pid", F.spark_partition_id()), "ranges")
    edges = ranged.groupBy("pid").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    first, last, count = edges.agg(F.min("pid"), F.max("pid"), F.count("pid")).first()
    if count and last - first + 1 != count:
        raise RuntimeError("a range between others is empty")
    near = edges.select("pid").join(edges.select((F.col("pid") + 1).alias("pid"), F.col("high").alias("before")), "pid", "left").join(edges.select((F.col("pid") - 1).alias("pid"), F.col("low").alias("after")), "pid", "left")

    def build(rows: pa.Table, beside: pa.Table) -> pa.Table:
        columns = [rows.column(c).to_pylist() for c in ("conv_id", "key", "chars")]
        made = nodes_of_range(rows.column("pid")[0].as_py(), zip(*columns), beside.column("before")[0].as_py(), beside.column("after")[0].as_py())
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        return pa.table([pa.array(made[name], kinds[kind]) for name, kind in (x.split() for x in NODES.split(", "))], names=list(made))

    made = written(ship(ranged).groupBy("pid").cogroup(near.withColumnRenamed("pid", "of").groupBy("of")).applyInArrow(trimmed(build), NODES), "nodes")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    common = made.where("node is not null").groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"), F.max("depth").alias("depth"), *sums).join(folded(made), "node", "left")
    common = written(common.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "common")
    all_rows = made.where("node is null").select("parent", *columns).unionByName(common.select("parent", F.lit(None).cast("long").alias("parent_conv_id"), *(c for c in columns if c != "parent_conv_id")))
    parents = common.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    # few nodes have parents in several ranges, but these may be most children of the root
    parents = F.broadcast(parents) if parents.count() <= RANGE_TURNS else parents
    below = all_rows.where("parent is not null").join(parents, "parent").withColumn("parent_conv_id", F.col("above"))
    return all_rows.where("parent is null").select(*columns).unionByName(below.select(*columns))


def folded(made: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes in several ranges: their ids come range by range, each range's in one row.

    The digest of a node reads its ids one behind the other and keeps none of them.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            for node, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist()):
                if node == now:
                    state.update(b"," + ends)
                    continue
                if now is not None:
                    yield pa.record_batch([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])
                now, state = node, hashlib.sha256(ends)
        if now is not None:
            yield pa.record_batch([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    ordered = made.where("ends is not null").select("node", "pid", "ends").repartition("node").sortWithinPartitions("node", "pid")
    return ordered.mapInArrow(fold, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of ``conversations`` with borrowed heads; odd rows as in ``turns_of`` and ``prefix_nodes``."""
    return prefix_nodes(with_borrowed_heads(turns_of(conversations)))
