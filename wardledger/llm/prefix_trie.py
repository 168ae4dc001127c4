"""The trie of conversations that share their first turns: a splitter skeleton over sorted shards.

A conversation is the path of its turns; a turn is 24 bytes, a digest of role and text and the text's length. Paths are
range-partitioned by (path, conversation), so copies of one conversation spread over many shards. The prefixes of the
splitters are the skeleton: a node that is none of them has all its members in one shard. The skeleton is broadcast;
each shard walks its sorted paths once with a stack, finishes every other node, and gives partial counts for the
skeleton's nodes, which are added up by a reduction. What depends on whole subtrees is then rolled up inside the
skeleton, whose size is bounded by ``skeleton_turns`` whatever the input: beyond it every second splitter is dropped.

Ids of conversations that end at a skeleton node are joined in pieces of 64 KB by the shards, in order, and hashed as
a stream; one SHA-256 over one node's ids can't be cut further. A shard holds the open nodes and their finished
children; a conversation's path (24 bytes a turn, no texts) has to fit in memory.

Results of each case: turns are ordered by number, null first, equal numbers by their digest; null role or text is
empty; repeated rows are repeated turns. Rows without a conversation id belong to none and are left out. A
conversation without turns is a member of the root. An empty table has no node, not even the root. Columns other than
the named ones are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardledger.session import Workspace

#: Bytes of a turn in a path: digest and length of the text.
DIGEST, TURN = 16, 24
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_WALKED = "kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, skeleton long, ends binary"
_PIECE = 1 << 16
_ROWS = 4096
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_code(role: Column, text: Column) -> Column:
    """A turn as hexadecimal text: digest of role and text, length of the text in code points."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.hex(F.length(text)), 2 * (TURN - DIGEST), "0"))


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and the codes of its turns in order."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", F.struct(F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"), turn_code(F.col("role"), F.col("text")).alias("code")).alias("turn")
    )
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["code"]).alias("turns"))


def rebuilt(turns: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """Every conversation with its first turns taken from the first conversation of its block of ids.

    That is crc32 of the id modulo ``most`` + 1 turns, all if there are fewer, none if that conversation is absent.
    """
    heads = turns.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), taken)
    own = F.slice("turns", taken + 1, F.size("turns"))
    joined = turns.join(heads, F.col("conv_id") - F.col("conv_id") % block == F.col("head_id"), "left")
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


class Skeleton:
    """The trie of the splitters' paths; nodes are numbered in the order of their paths, so parents come first."""

    def __init__(self, splitters: list[tuple[bytes, int]], limit: int):
        while sum(len(path) // TURN for path, _ in splitters) > limit:
            splitters = splitters[1::2]
        self.splitters = splitters
        self.children: list[dict[bytes, int]] = [{}]
        self.parent, self.depth, self.length = [-1], [0], [0]
        for path, _ in splitters:
            node = 0
            for at in range(0, len(path), TURN):
                turn = path[at : at + TURN]
                if turn not in self.children[node]:
                    self.children[node][turn] = len(self.children)
                    self.children.append({})
                    self.parent.append(node)
                    self.depth.append(at // TURN + 1)
                    self.length.append(text_length(turn))
                node = self.children[node][turn]


def text_length(turn: bytes) -> int:
    return int.from_bytes(turn[DIGEST:], "big")


def common_turns(a: bytes, b: bytes) -> int:
    """How many first turns two paths share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax()) // TURN


class _Open:
    """A node on the way to the present path."""

    __slots__ = ("children", "conv", "ends", "first", "hasher", "leaves", "length", "n", "saved", "skeleton", "waiting")

    def __init__(self, length: int, skeleton: int):
        self.length, self.skeleton = length, skeleton
        self.n = self.children = self.leaves = self.saved = 0
        self.conv = self.hasher = self.first = None
        self.waiting: list[list] = []  # finished children, which lack this node's smallest member
        self.ends: list[bytes] = []

    def member(self, conv: int, n: int = 1) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)


class Walk:
    """Walks the sorted paths of one shard; rows of finished nodes gather in ``rows``."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton, self.rows = skeleton, []
        self.path, self.open = b"", [_Open(0, 0)]

    def add(self, path: bytes, conv: int) -> None:
        shared = common_turns(self.path, path)
        while len(self.open) > shared + 1:
            self._close()
        for at in range(shared * TURN, len(path), TURN):
            turn, top = path[at : at + TURN], self.open[-1].skeleton
            self.open.append(_Open(text_length(turn), self.skeleton.children[top].get(turn, -1) if top >= 0 else -1))
        self.path = path
        node = self.open[-1]
        node.member(conv)
        text = str(conv).encode()
        if node.skeleton >= 0:
            if not node.ends:
                node.first = conv
            node.ends.append(text)
            if len(node.ends) >= _PIECE // 8:
                self._piece(node)
        elif node.hasher is None:
            node.hasher = hashlib.sha256(text)
        else:
            node.hasher.update(b"," + text)

    def end(self) -> None:
        while self.open:
            self._close()

    def _piece(self, node: _Open) -> None:
        self.rows.append(["ends", node.first, None, None, None, None, None, None, None, node.skeleton, b",".join(node.ends)])
        node.ends = []

    def _close(self) -> None:
        node, depth = self.open.pop(), len(self.open)
        if node.skeleton >= 0:
            if node.ends:
                self._piece(node)
            if node.n:
                self.rows.append(["part", node.conv, depth, None, node.n, node.children, node.leaves, node.saved, None, node.skeleton, None])
            return
        saved, leaves = node.saved + (node.n - 1) * node.length, node.leaves or 1
        for row in node.waiting:
            row[3] = node.conv
        self.rows += node.waiting
        sha = node.hasher.hexdigest() if node.hasher else _NO_ENDS
        row = ["node", node.conv, depth, None, node.n, node.children, leaves, saved, sha, None, None]
        above = self.open[-1]
        above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
        above.member(node.conv, node.n)
        if above.skeleton >= 0:
            row[9] = above.skeleton
            self.rows.append(row)
        else:
            above.waiting.append(row)


def _paths(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.unhex(F.array_join("turns", "")).alias("path"))


def _splitters(paths: DataFrame, shards: int, sample_bytes: int) -> list[tuple[bytes, int]]:
    """Borders of about equal shards, from a sample of bounded size."""
    n, size = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("path") + 16), F.lit(0))).first()
    if shards < 2 or not n:
        return []
    share = min(1.0, 8 * shards / n, sample_bytes / size)
    sample = sorted((bytes(r.path), r.conv_id) for r in (paths if share == 1 else paths.sample(share, seed=1)).collect())
    places = sorted({len(sample) * i // shards for i in range(1, shards)})
    return sorted({sample[i] for i in places if i < len(sample)})


def prefix_trie(
    turns: DataFrame, shards: int | None = None, skeleton_turns: int = 1 << 17, sample_bytes: int = 32 << 20, rows_per_shard: int = 1 << 17
) -> DataFrame:
    """The nodes of the trie of (conv_id, turns) rows, one row per conversation.

    conv_id: smallest member; depth; parent_conv_id: the parent's; n_convs; n_children; n_leaves and saved_tokens of
    the subtree; ends_sha256: of the ids that end here. ``shards`` follows the session's shuffle partitions and the
    number of rows unless it is given; no result depends on it.
    """
    spark = turns.sparkSession
    space = Workspace(spark)
    paths = space.keep(_paths(turns), "paths")
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-paths.count() // rows_per_shard))
    skeleton = Skeleton(_splitters(paths, shards, sample_bytes), skeleton_turns)
    shared = spark.sparkContext.broadcast(skeleton)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = shared.value.splitters
        for batch in batches:
            rows = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            shard = pa.array([bisect_right(borders, row) for row in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("path"), shard], ["conv_id", "path", "shard"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.string()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("skeleton", pa.int64()), ("ends", pa.binary())])

        def taken(walk: Walk) -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*walk.rows, strict=True), schema, strict=True)]
            walk.rows = []
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        walk = Walk(shared.value)
        for batch in batches:
            for path, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                walk.add(path, conv)
                if len(walk.rows) >= _ROWS:
                    yield taken(walk)
        walk.end()
        if walk.rows:
            yield taken(walk)

    dealt = paths.mapInArrow(numbered, "conv_id long, path binary, shard int")
    in_order = dealt.repartitionById(len(skeleton.splitters) + 1, F.col("shard")).sortWithinPartitions("path", "conv_id")
    found = space.keep(in_order.mapInArrow(walked, _WALKED), "walked")

    parts = found.filter("kind = 'part'").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    )
    upper = spark.createDataFrame(rolled_up(skeleton, parts.collect()), "skeleton long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    ends = found.filter("kind = 'ends'").select("skeleton", "conv_id", "ends").repartition("skeleton").sortWithinPartitions("skeleton", "conv_id").mapInArrow(_hashed, "skeleton long, ends_sha256 string")
    top = upper.join(ends, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NO_ENDS)))
    above = F.broadcast(upper.select("skeleton", F.col("conv_id").alias("above")))  # skeleton_turns rows at most
    rest = found.filter("kind = 'node'").join(above, "skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return top.select(*_NODE).unionByName(rest.select(*_NODE))


def rolled_up(skeleton: Skeleton, parts: list) -> list[tuple]:
    """The skeleton's nodes with whole subtrees, from what belongs to each node itself."""
    size = len(skeleton.parent)
    conv: list[int | None] = [None] * size
    n, children, leaves, saved = ([0] * size for _ in range(4))
    for p in parts:
        conv[p.skeleton], n[p.skeleton], children[p.skeleton] = p.conv_id, p.n_convs, p.n_children
        leaves[p.skeleton], saved[p.skeleton] = p.n_leaves, p.saved_tokens
    for i in range(size - 1, -1, -1):
        if not n[i]:
            continue
        leaves[i] = leaves[i] or 1
        saved[i] += (n[i] - 1) * skeleton.length[i]
        up = skeleton.parent[i]
        if up >= 0:
            n[up], children[up], leaves[up], saved[up] = n[up] + n[i], children[up] + 1, leaves[up] + leaves[i], saved[up] + saved[i]
            conv[up] = conv[i] if conv[up] is None else min(conv[up], conv[i])
    return [
        (i, conv[i], skeleton.depth[i], conv[skeleton.parent[i]] if i else None, n[i], children[i], leaves[i], saved[i])
        for i in range(size)
        if n[i]
    ]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's joined pieces, which arrive in order."""
    last, hasher = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([hasher.hexdigest()])], ["skeleton", "ends_sha256"])

    for batch in batches:
        for node, piece in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if node == last:
                hasher.update(b"," + piece)
                continue
            if hasher is not None:
                yield row()
            last, hasher = node, hashlib.sha256(piece)
    if hasher is not None:
        yield row()


def trie_report(conversations: DataFrame) -> DataFrame:
    """The nodes of all rebuilt conversations."""
    turns = Workspace(conversations.sparkSession).keep(conversation_turns(conversations), "turns")
    return prefix_trie(rebuilt(turns))
