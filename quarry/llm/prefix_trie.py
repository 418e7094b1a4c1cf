"""The trie of all conversations' prefixes by the splitter-skeleton method.

A conversation is a path of tokens, one a turn (digest of role and text, number of words), so that the byte order of
paths is an order of the trie in depth.  Paths are range-partitioned and sorted.  A node whose members lie in more than
one shard is a prefix of a path at which the range was split: these nodes are the skeleton.  The trie of the
split paths is broadcast (for each shard, what its first and its last path share with the neighbours); every shard finishes its
other nodes alone in one pass over its sorted paths, and hands out partial figures of its skeleton nodes, which are added up.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD, cut, partitions

TOKEN = 20                # bytes of a turn's token: 16 of its digest, 4 of its number of words
ENDS = 1 << 14            # ids in a piece of a skeleton node's list of ends
SKELETON = 1_000_000      # skeleton nodes (of some 60 bytes) that are broadcast to their children; more are joined by a salted key
SALT = 64
EMPTY = hashlib.sha256(b"").hexdigest()


def token(role: Column, text: Column) -> Column:
    """A turn's token: equal for equal (role, text); null is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    n = F.regexp_count(text, F.lit(WORD))
    return F.concat(F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))),
                    F.unhex(F.lpad(F.hex(n), 2 * (TOKEN - 16), "0")))


def turn_paths(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``member, path``: each conversation's tokens in the order of ``turn`` (null first; ties by role, null first, then token).

    Rows with a null key belong to no conversation and are left out.  A conversation is one row, of ``TOKEN`` bytes a turn.
    """
    slim = turns.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("member"),
        F.struct(F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.hex(token(F.col(role), F.col(text))).alias("token")).alias("at"))
    # sort_array puts nulls first, also within structs
    paths = slim.groupBy("member").agg(F.sort_array(F.collect_list("at")).alias("at"))
    return paths.select("member", F.unhex(F.array_join(F.col("at.token"), "")).alias("path"))


def _common(a: bytes, b: bytes) -> int:
    """How many tokens two paths begin with in common."""
    low, high = 0, min(len(a), len(b)) // TOKEN
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid * TOKEN] == b[:mid * TOKEN]:
            low = mid
        else:
            high = mid - 1
    return low


def splitter_paths(placed: DataFrame) -> dict[int, tuple[bytes | None, bytes | None]]:
    """For each shard with rows: the longest path that it shares with the shard before and with the next (null: there is none).

    One row a shard is gathered, whatever the input; a path has ``TOKEN`` bytes for each turn that two neighbours have in common.
    """
    ends = placed.groupBy("_p").agg(F.min("path").alias("first"), F.max("path").alias("last")).orderBy("_p").collect()
    out = {r["_p"]: [None, None] for r in ends}
    for a, b in zip(ends, ends[1:]):
        shared = bytes(b["first"][:TOKEN * _common(a["last"], b["first"])])
        out[a["_p"]][1] = out[b["_p"]][0] = shared
    return {p: tuple(x) for p, x in out.items()}


class _Node:
    __slots__ = ("depth", "words", "low", "n", "children", "new_children", "leaves", "saved", "ends", "hash", "held", "skeleton", "new", "goes_on", "seq")

    def __init__(self, depth, words, skeleton, new, goes_on):
        self.depth, self.words, self.skeleton, self.new, self.goes_on = depth, words, skeleton, new, goes_on
        self.low, self.n, self.children, self.new_children, self.leaves, self.saved, self.seq = None, 0, 0, 0, 0, 0, 0
        self.ends, self.hash, self.held = [], None, []


NODE = "node string, parent string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PART = f"kind string, {NODE}, shard int, seq long, ends binary"
_FIELDS = pa.schema([("kind", pa.string()), ("node", pa.string()), ("parent", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()),
                     ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                     ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("shard", pa.int32()), ("seq", pa.int64()), ("ends", pa.binary())])


class _Shard:
    """One pass over a shard's sorted paths; ``out`` gathers rows of three kinds.

    ``done``: a node that lies in this shard alone; ``part``: this shard's share of a skeleton node; ``ends``: a
    piece of the list of members that end there.  A node is counted by the first shard that has it (``new``), as a leaf by
    the last, so shares only need adding.  Finished nodes wait at their parent for its smallest member, unless that is of the skeleton.
    """

    def __init__(self, shard: int, shared: tuple[bytes | None, bytes | None]):
        self.shard, (self.left, self.right) = shard, shared
        self.stack: list[_Node] = []
        self.path, self.out = b"", []

    def _name(self, depth: int) -> str:
        return hashlib.md5(self.path[:depth * TOKEN]).hexdigest()

    def add(self, member: int, path: bytes) -> None:
        if not self.stack or path != self.path:
            same = _common(self.path, path) if self.stack else -1
            while len(self.stack) > same + 1:
                self._close()
            self.path = path
            before = -1 if self.left is None else _common(self.left, path)
            after = -1 if self.right is None else _common(self.right, path)
            for d in range(len(self.stack), len(path) // TOKEN + 1):
                words = int.from_bytes(path[d * TOKEN - 4:d * TOKEN], "big") if d else 0
                self.stack.append(_Node(d, words, d <= max(before, after), d > before, d <= after))
        top = self.stack[-1]
        top.n += 1
        top.low = member if top.low is None else min(top.low, member)
        if top.skeleton:
            top.ends.append(member)
            if len(top.ends) >= ENDS:
                self._ends(top)
        elif top.hash is None:
            top.hash = hashlib.sha256(b"%d" % member)
        else:
            top.hash.update(b",%d" % member)

    def _ends(self, node: _Node) -> None:
        self.out.append(("ends", self._name(node.depth), None, None, None, None, None, None, None, None, None, self.shard, node.seq,
                         b",".join(b"%d" % m for m in node.ends)))
        node.ends, node.seq = [], node.seq + 1

    def _close(self) -> None:
        node = self.stack.pop()
        up = self.stack[-1] if self.stack else None
        node.saved += node.n * node.words - (node.words if node.new else 0)
        node.leaves += not node.children and not node.goes_on
        if up is not None:
            up.n += node.n
            up.low = node.low if up.low is None else min(up.low, node.low)
            up.children += 1
            up.new_children += node.new
            up.leaves += node.leaves
            up.saved += node.saved
        for row in node.held:
            self.out.append((*row[:5], node.low, *row[6:]))
        name = self._name(node.depth) if node.skeleton else None
        # a child of a skeleton node gets its parent's smallest member later, by the parent's name
        above = self._name(up.depth) if up is not None and up.skeleton else None
        row = ("part" if node.skeleton else "done", name, above, node.low, node.depth, None, node.n, node.new_children, node.leaves, node.saved,
               None if node.skeleton else node.hash.hexdigest() if node.hash else EMPTY, self.shard, None, None)
        if node.skeleton and node.ends:
            self._ends(node)
        (up.held if up is not None and not up.skeleton else self.out).append(row)

    def end(self) -> None:
        while self.stack:
            self._close()

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_FIELDS), _FIELDS)], schema=_FIELDS)


def _shard_job(shared: dict):
    def run(batches):
        shard = None
        for batch in batches:
            for p, member, path in zip(*(c.to_pylist() for c in batch.columns)):
                if shard is None or shard.shard != p:
                    if shard is not None:
                        shard.end()
                        yield shard.take()
                    shard = _Shard(p, shared[p])
                shard.add(member, path)
                if len(shard.out) >= 1 << 14:
                    yield shard.take()
        if shard is not None:
            shard.end()
            yield shard.take()
    return run


def _digest_job(batches):
    """SHA-256 of each node's pieces, which arrive one after the other in order; no list is ever held."""
    node, state = None, None
    for batch in batches:
        done = []
        for name, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if name != node:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256(piece)
            else:
                state.update(b"," + piece)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["node", "digest"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "digest"])


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the ``(member, path)`` rows, the empty one included.

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the prefix one turn shorter (null at the root),
    ``n_convs`` the members, ``n_children`` the prefixes one turn longer, ``n_leaves`` the childless prefixes below or at it,
    ``saved_tokens`` the sum over these of (members - 1) x words of the last turn, ``ends_sha256`` the SHA-256 of
    the comma-joined ascending ids of the members that end there.  An empty table has no node.  Members are expected to be distinct.

    Members of one path are split over shards by their id, so a path that a third of all conversations share is no hot task;
    the digest of its ends is one task's pass over the bare ids, since SHA-256 is a chain.
    """
    n = partitions(paths.sparkSession)
    # the ranges are sampled from the written rows, so the grouping into paths runs once
    placed = cut(cut(paths).repartitionByRange(n, "path", "member").sortWithinPartitions("path", "member")
                 .select(F.spark_partition_id().alias("_p"), "member", "path"))
    rows = cut(placed.mapInArrow(_shard_job(splitter_paths(placed)), _PART))
    pieces = rows.where("kind = 'ends'").select("node", "shard", "seq", "ends")
    digests = (pieces.repartition(n, "node").sortWithinPartitions("node", "shard", "seq").select("node", "ends")
               .mapInArrow(_digest_job, "node string, digest string"))
    skeleton = cut(rows.where("kind = 'part'").groupBy("node").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        .join(digests, "node", "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(EMPTY))).drop("digest"))
    done = rows.where("kind = 'done'")
    figures = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = (done.select("parent", "parent_conv_id", *figures)
             .unionByName(skeleton.select("parent", F.lit(None).cast("long").alias("parent_conv_id"), *figures)))
    above = skeleton.select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    if skeleton.count() <= SKELETON:
        joined = nodes.join(F.broadcast(above), "parent", "left")
    else:
        copies = above.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = nodes.withColumn("_salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALT)).cast("int")).join(copies, ["parent", "_salt"], "left")
    return joined.select("conv_id", "depth", F.coalesce("parent_conv_id", "_above").alias("parent_conv_id"),
                         "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def with_heads(paths: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c begins with the first h turns of conversation c - c % every; h = crc32(decimal c) % most.

    Its own turns follow from the (h + 1)-th on.  All of the head's turns are taken if they are fewer, none if there is no such
    conversation.  Moduli are never negative.
    """
    heads = paths.where(F.pmod("member", F.lit(every)) == 0).select(
        F.col("member").alias("_head"), F.expr(f"substring(path, 1, {TOKEN * (most - 1)})").alias("_begin"))
    h = F.pmod(F.crc32(F.col("member").cast("string").cast("binary")), F.lit(most)).cast("int")
    own = paths.select("member", "path", h.alias("_h"), (F.col("member") - F.pmod("member", F.lit(every))).alias("_head"))
    empty = F.lit(b"")
    return own.join(heads, "_head", "left").select("member", F.concat(
        F.coalesce(F.expr(f"substring(_begin, 1, _h * {TOKEN})"), empty), F.expr(f"substring(path, _h * {TOKEN} + 1)")).alias("path"))
