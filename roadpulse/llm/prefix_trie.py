"""Z-fast trie of conversations: every distinct prefix of their turns is a node.

A turn becomes 24 octets, the MD5 of role and text and the code points of the
text, before anything is shuffled; a conversation is the *path* of its turns.
Paths of more than ``SEGMENT`` turns are cut into levels: a level's trie hangs
on the node that the level before ends at, so no row holds more than a segment,
and turns are numbered over range partitions (``operators.ordered``): also one
conversation with a third of all turns meets in no task.

Equal paths are counted first; a path that a third of the conversations share
is one row.  The distinct paths are range-partitioned in lexical order, each
task builds the compacted trie of its range, and a trie's edges are expanded
to one node for each depth.  Inside a task the trie is a z-fast one: a
compacted node is an edge (lo, hi] and lies in a hash table under its handle,
the prefix whose length is the two-fattest number in (lo, hi] (the one that the
largest power of two divides).  For each batch of paths, the exit nodes are
located first by fat binary search (of the depths (l, r] the two-fattest is
looked up; a handle found moves l to the node's extent if that is a prefix too,
one that is absent moves r below it), then the paths are inserted there, each
splitting at most one edge.

A node lies in several ranges only if it is a prefix of the first or last path
of a range.  These nodes, as many as the path lengths of the ranges' ends, are
merged by key; all others are complete in their task, whatever their number.

Conversation ids that end at one node are hashed as a stream: ranges of sorted
ids are joined to pieces of text in parallel, and one task hashes the pieces in
order, since SHA-256 has no other way.

Rows and columns: a null role or text is empty; turns are ordered by (turn,
null first, then MD5 of the turn) and repeated rows are repeated turns; rows
without conv_id belong to no conversation; an empty table has no nodes.  Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import give_back, materialize
from roadpulse.operators.ordered import running

#: Turns of a path's segment; octets of a turn; distinct paths of a range; octets of a piece of joined ids.
SEGMENT, STEP, RANGE_PATHS, PIECE = 256, 24, 50_000, 1 << 20


# ---- sequences --------------------------------------------------------------------

def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos from 1, step): the turns in order; a step is 16 octets of MD5 and 8 of code points."""
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tok = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    step = F.unhex(F.concat(tok, F.lpad(F.hex(F.length("text").cast("long")), 16, "0")))
    placed = running(rows.select("conv_id", "turn", step.alias("step")), ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("step").asc()],
                     {"pos": F.lit(1)})
    return materialize(placed.select("conv_id", "pos", "step"), "trie-turns")


def rebuilt(placed: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(sequences, conv_ids): conversation c is the first h turns of conversation c - c % every and then its own turns
    after the first h, where h = crc32(decimal c) % heads."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    ids = placed.select("conv_id").distinct().withColumn("h", h).withColumn("anchor", F.col("conv_id") - F.col("conv_id") % every)
    ids = materialize(ids, "trie-conversations")
    first = placed.where((F.col("conv_id") % every == 0) & (F.col("pos") < heads)).withColumnRenamed("conv_id", "anchor")
    first = materialize(first, "trie-heads")
    lent = ids.join(first, "anchor").where(F.col("pos") <= F.col("h")).select("conv_id", F.col("pos").alias("d"), "step")
    n_first = materialize(first.groupBy("anchor").agg(F.max("pos").alias("n_first")), "trie-head-sizes")
    own = placed.withColumn("h", h).where(F.col("pos") > F.col("h")).withColumn("anchor", F.col("conv_id") - F.col("conv_id") % every)
    own = own.join(n_first, "anchor", "left")
    at = F.least("h", F.coalesce("n_first", F.lit(0))) + F.col("pos") - F.col("h")
    return lent.unionByName(own.select("conv_id", at.alias("d"), "step")), ids.select("conv_id")


def segments(sequences: DataFrame, conv_ids: DataFrame, size: int) -> DataFrame:
    """(conv_id, level, path): each conversation's turns, ``size`` to a row; an empty path for one without turns."""
    rows = sequences.select("conv_id", F.floor((F.col("d") - 1) / size).cast("int").alias("level"), "d", F.hex("step").alias("step"))
    empty = conv_ids.select("conv_id", F.lit(0).alias("level"), F.lit(0).cast("long").alias("d"), F.lit("").alias("step"))
    cut = rows.unionByName(empty).groupBy("conv_id", "level").agg(F.sort_array(F.collect_list(F.struct("d", "step"))).alias("s"))
    return materialize(cut.select("conv_id", "level", F.unhex(F.array_join("s.step", "")).alias("path")), "trie-segments")


# ---- the trie of one range --------------------------------------------------------

def fattest(low: int, high: int) -> int:
    """The number in (low, high] that the largest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


def shared_steps(a: bytes, b: bytes, start: int = 0) -> int:
    """Steps in which two paths agree, known to be ``start`` at least."""
    n, at = min(len(a), len(b)) // STEP, start
    while at < n and a[at * STEP:(at + 1) * STEP] == b[at * STEP:(at + 1) * STEP]:
        at += 1
    return at


class Node:
    """An edge (lo, hi] on the way of ``path``; ``ends`` and ``more`` are what ends at its extent or hangs on it from the next level."""

    __slots__ = ("path", "lo", "hi", "children", "count", "least", "more")

    def __init__(self, path: bytes, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi
        self.children: dict[bytes, Node] = {}
        self.count, self.least, self.more = 0, None, (0, 0, 0)

    def prefix(self, depth: int) -> bytes:
        return self.path[:depth * STEP]

    def first(self) -> bytes:
        return self.path[self.lo * STEP:(self.lo + 1) * STEP]


class ZFastTrie:
    """The compacted trie of the paths of one root, its nodes in a hash table by their handles."""

    def __init__(self) -> None:
        self.root = Node(b"", 0, 0)
        self.handles: dict[bytes, Node] = {}

    def locate(self, path: bytes, start: Node) -> tuple[Node, Node | None]:
        """(deepest node whose extent is a prefix of the path, the node below it whose edge the path enters)."""
        node, low, high = start, start.hi, len(path) // STEP
        while low < high:
            depth = fattest(low, high)
            hit = self.handles.get(path[:depth * STEP])
            if hit is None:
                high = depth - 1
            elif path.startswith(hit.prefix(hit.hi)):
                node, low = hit, hit.hi
            else:
                return self.parent_of(hit, node), hit
        return node, node.children.get(path[node.hi * STEP:(node.hi + 1) * STEP])

    def parent_of(self, node: Node, above: Node) -> Node:
        """The parent of a node whose handle is known, from an ancestor on: also a descent by extents."""
        while above.hi < node.lo:
            above = above.children[node.path[above.hi * STEP:(above.hi + 1) * STEP]]
        return above

    def hang(self, node: Node, parent: Node) -> Node:
        parent.children[node.first()] = node
        self.handles[node.prefix(fattest(node.lo, node.hi))] = node
        return node

    def insert(self, path: bytes, start: Node) -> Node:
        """The node that ends at ``path``; ``start`` is a node known to be on its way."""
        n = len(path) // STEP
        node, exit_node = self.locate(path, start)
        if exit_node is not None:
            at = shared_steps(path, exit_node.path[:exit_node.hi * STEP], node.hi)
            del self.handles[exit_node.prefix(fattest(exit_node.lo, exit_node.hi))]
            upper = self.hang(Node(exit_node.path, exit_node.lo, at), node)
            exit_node.lo = at
            self.hang(exit_node, upper)
            node = upper
        return node if node.hi == n else self.hang(Node(path, node.hi, n), node)

    def insert_batch(self, paths: list[bytes]) -> list[Node]:
        """Locate all paths of a batch in the trie so far, then insert each from the node found (its extent stays a node)."""
        found = [self.locate(path, self.root)[0] for path in paths]
        return [self.insert(path, node) for path, node in zip(paths, found)]


NODE = ("id binary, parent binary, parent_conv long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, shared boolean, chars long, prefix binary, root binary")
_TYPES = {"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
NODE_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in NODE.split(", "))])


#: Key of the whole trie's root; a node's key is that of its level's root, hashed with the steps from there (if any).
TOP = hashlib.md5(b"").digest()


def key_of(root: bytes, prefix: bytes) -> bytes:
    return hashlib.md5(root + prefix).digest() if prefix else root


def key_column(root: Column, prefix: Column) -> Column:
    return F.when(F.octet_length(prefix) > 0, F.unhex(F.md5(F.concat(root, prefix)))).otherwise(root)


def expanded(trie: ZFastTrie, root: bytes, ends: tuple[bytes, bytes], base: int) -> Iterator[tuple]:
    """One row of ``NODE`` for each depth of each edge.

    Nodes on the way of ``ends``, the first and last path of the range, may be in other ranges too: they are ``shared``,
    and their children, leaves and savings are those of the parts below that are complete here."""
    order, stack = [], [(trie.root, None)]
    while stack:
        node, parent = stack.pop()
        order.append((node, parent))
        stack.extend((child, node) for child in node.children.values())
    for node, _ in reversed(order):  # children before parents
        for child in node.children.values():
            node.count += child.count
            node.least = child.least if node.least is None else min(node.least, child.least)
    sums: dict[int, list] = {}
    for node, parent in reversed(order):
        chars = [int.from_bytes(node.path[d * STEP - 8:d * STEP], "big") for d in range(node.lo + 1, node.hi + 1)]
        open_to = max(shared_steps(node.path[:node.hi * STEP], x) for x in ends)
        kids, leaves, saved = node.more
        for child in node.children.values():
            of = sums.pop(id(child))
            if of[3] <= node.hi:  # the child's first node is complete
                kids, leaves, saved = kids + 1, leaves + of[1], saved + of[2]
        whole = open_to < node.hi
        leaves += 1 if whole and not kids else 0
        for d in range(node.hi, node.lo, -1):
            key, up = key_of(root, node.prefix(d)), key_of(root, node.prefix(d - 1))
            size = chars[d - node.lo - 1]
            if d > open_to:
                saved += (node.count - 1) * size
                # the least member of the node above is looked up by key where that node is shared or of another level
                above = None if d - 1 <= open_to else node.least if d - 1 > node.lo else parent.least
                yield (key, up, above, node.least, base + d, node.count, kids, leaves, saved, False, size, None, None)
                kids = 1
            else:
                yield (key, up, None, node.least, base + d, node.count, kids, leaves, saved, True, size, node.prefix(d), root)
                kids, leaves, saved = 0, 0, 0
        sums[id(node)] = [kids, leaves, saved, open_to]
        if node is trie.root:
            yield (root, None, None, node.least, base, node.count, kids, leaves, saved, True, 0, b"", root)


def nodes_of_ranges(paths: DataFrame, base: int) -> DataFrame:
    """Nodes of the distinct ``paths`` (root, path, n, least, kids, leaves, saved), by range of (root, path)."""

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, root, first, last = None, None, None, None

        def laid() -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for row in expanded(trie, root, (first, last), base):
                rows.append(row)
                if len(rows) >= 5_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(NODE_SCHEMA.names, r)) for r in rows], NODE_SCHEMA)
                    rows = []
            yield pa.RecordBatch.from_pylist([dict(zip(NODE_SCHEMA.names, r)) for r in rows], NODE_SCHEMA)

        for batch in batches:
            roots, found, *counts = (batch.column(c).to_pylist() for c in ("root", "path", "n", "least", "kids", "leaves", "saved"))
            at = 0
            while at < len(roots):
                if roots[at] != root or trie is None:
                    if trie is not None:
                        yield from laid()
                    trie, root, first = ZFastTrie(), roots[at], found[at]
                end = next((i for i in range(at, len(roots)) if roots[i] != root), len(roots))
                for i, node in enumerate(trie.insert_batch(found[at:end]), at):
                    node.count, node.least, node.more = counts[0][i], counts[1][i], (counts[2][i], counts[3][i], counts[4][i])
                last, at = found[end - 1], end
        if trie is not None:
            yield from laid()
        give_back()

    ranges = max(1, -(-paths.count() // RANGE_PATHS), int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = paths.repartitionByRange(ranges, "root", "path").sortWithinPartitions("root", "path")
    return materialize(dealt.mapInArrow(build, NODE), "trie-nodes")


def merged(found: DataFrame) -> DataFrame:
    """The shared nodes of all ranges, one row each, with whole sums.

    A node's leaves and savings are those of its shared descendants' complete parts: each shared node adds its own to
    all nodes on its way, whose keys follow from its prefix."""
    same = ["id", "parent", "depth", "chars", "prefix", "root"]
    rows = found.where("shared").groupBy(*same).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
                                                    F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    rows = materialize(rows, "trie-shared")
    kids = rows.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("more"))
    rows = rows.join(kids, "id", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    rows = materialize(rows.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn(
        "saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")), "trie-shared-own")
    up = F.explode(F.sequence(F.lit(0), (F.octet_length("prefix") / STEP).cast("int"))).alias("a")
    ways = rows.select("root", "prefix", "n_leaves", "saved_tokens", up)
    key = key_column(F.col("root"), F.substring(F.col("prefix"), F.lit(1), F.col("a") * STEP))
    sums = ways.groupBy(key.alias("id")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return materialize(rows.drop("n_leaves", "saved_tokens").join(sums, "id"), "trie-merged")


# ---- output -----------------------------------------------------------------------

def end_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256): SHA-256 of the comma-joined conv_ids of ``ends`` (id, conv_id), in ascending order."""

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, ids, first, size, waiting = None, [], None, 0, 0
        for batch in batches:
            for k, c in zip(batch.column("id").to_pylist(), batch.column("conv_id").to_pylist()):
                if k != key or size > PIECE:
                    if ids:
                        held.append((key, first, ",".join(ids)))
                        waiting += size
                    key, ids, first, size = k, [], c, 0
                    if len(held) >= 10_000 or waiting > 4 * PIECE:
                        yield rows(held)
                        held, waiting = [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            held.append((key, first, ",".join(ids)))
        yield rows(held)

    def rows(held: list[tuple]) -> pa.RecordBatch:
        schema = pa.schema([("id", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
                if k == key:
                    sha.update(b"," + ids.encode())
                    continue
                if sha:
                    out.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(ids.encode())
            yield results(out)
        yield results([(key, sha.hexdigest())] if sha else [])

    def results(out: list[tuple]) -> pa.RecordBatch:
        schema = pa.schema([("id", pa.binary()), ("ends_sha256", pa.string())])
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    dealt = ends.select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    pieces = dealt.mapInArrow(join, "id binary, first long, ids string")
    gathered = pieces.repartition("id").sortWithinPartitions("id", "first").select("id", "ids")
    return gathered.mapInArrow(digest, "id binary, ends_sha256 string")


def nodes_of(sequences: DataFrame, conv_ids: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row per distinct prefix of the ``sequences`` (conv_id, d, step) of ``conv_ids`` (with or without turns)."""
    cut = segments(sequences, conv_ids, size)
    deepest = cut.agg(F.max("level")).first()[0]
    if deepest is None:
        return _columns(sequences.sparkSession.createDataFrame([], NODE).withColumn("ends_sha256", F.lit(None).cast("string")))
    end = key_column(F.col("root"), F.col("path"))
    levels: list[DataFrame] = []
    for level in range(deepest + 1):
        rows = cut.where(F.col("level") == level).select("conv_id", "path")
        if level == 0:
            rows = rows.withColumn("root", F.lit(TOP))
        else:
            rows = rows.join(levels[-1].select("conv_id", F.col("id").alias("root")), "conv_id")
        rows = rows.withColumn("id", end)
        levels.append(materialize(rows, "trie-level") if deepest else rows)

    found: list[DataFrame] = []
    joints: list[DataFrame] = []  # nodes that a later level hangs on
    below = None
    zero = F.lit(0).cast("long")
    for level in range(deepest, -1, -1):
        paths = levels[level].groupBy("root", "path", "id").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
        if below is None:
            paths = paths.select("root", "path", "n", "least", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"))
        else:
            paths = paths.join(below, "id", "left").select("root", "path", "n", "least", *[F.coalesce(c, zero).alias(c) for c in ("kids", "leaves", "saved")])
        nodes = nodes_of_ranges(materialize(paths, "trie-paths"), level * size)
        common = merged(nodes)
        tops = common.where(F.col("parent").isNull())
        below = tops.select("id", F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        names = [n for n in NODE_SCHEMA.names if n not in ("shared", "chars", "prefix", "root")]
        own = common if level == 0 else common.where(F.col("parent").isNotNull())
        found += [nodes.where(~F.col("shared")).select(names), own.withColumn("parent_conv", F.lit(None).cast("long")).select(names)]
        joints.append(own.select("id", "conv_id"))
        if level < deepest:
            joints.append(nodes.where(~F.col("shared") & (F.col("depth") == (level + 1) * size)).select("id", "conv_id"))

    over = materialize(reduce(DataFrame.unionByName, joints).withColumnsRenamed({"id": "parent", "conv_id": "over"}), "trie-joints")
    every = reduce(DataFrame.unionByName, found)
    open_parent = F.when(F.col("parent_conv").isNull(), F.col("parent"))
    every = every.withColumn("ask", open_parent).join(over.withColumnRenamed("parent", "ask"), "ask", "left")
    last = [levels[i].join(levels[i + 1].select("conv_id"), "conv_id", "left_anti") if i < deepest else levels[i] for i in range(deepest + 1)]
    digests = end_digests(reduce(DataFrame.unionByName, [x.select("id", "conv_id") for x in last]))
    return _columns(every.withColumn("parent_conv", F.coalesce("parent_conv", "over")).join(digests, "id", "left"))


def _columns(rows: DataFrame) -> DataFrame:
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select("conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def trie_of(conversations: DataFrame, every: int = 100, heads: int = 6, size: int = SEGMENT) -> DataFrame:
    """The nodes of the rebuilt ``conversations``."""
    return nodes_of(*rebuilt(turns(conversations), every, heads), size)
