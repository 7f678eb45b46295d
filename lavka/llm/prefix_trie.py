"""Prefix trie of conversations from sorted paths, their LCPs and range minima; no stack.

A conversation is a path: its turns in order, each known by 128 bits made of role, text and
place. Paths are sorted; the LCP of a path is the number of turns it shares with the one
before. A node (the first d turns of some conversations) is a stretch of sorted paths
between LCPs below d. Every candidate prefix finds its stretch on its own: over a
sparse table of LCP minima it binary-searches its left and its right end. What the stretch says
is then read off without walking: the smallest member from a sparse table over the
ids, members, leaves and tokens from running totals. For those, each path counts what is
new in it (the turns beyond its LCP), and a path that the next one doesn't go on
with ends in a leaf.

Spread. Sorted paths are range-partitioned and stored; the sort key ends with the
conversation's id, so any number of equal conversations is spread over tasks. Only the LCPs between
one range's last path and the next one's first go to all tasks, two numbers a range. Each
block of some thousand paths has its own sparse tables. A stretch that reaches a
block's edge goes on in the next one as another piece of the same node; pieces add up.

Long paths are cut into cells of 256 turns. A cell sorts after its number and what comes
before it, so it is a path of its own that begins at the node where the last cell ended;
what is new in later cells is summed up per conversation first. Nothing holds a whole
conversation, a node's members or a tree.

The conversations that end at a node are hashed in order of their ids: pieces of text of at
most 64 KB are made in ranges, the pieces of one node are then streamed by one task, as SHA-256 asks for.

Turns are ordered by turn (null first), then role, then the SHA-256 of the text; null role and
text are empty. Turns without a conversation id belong to none and take no part. Repeated rows
are turns of their own. An empty table has no nodes, not even a root. Other columns don't matter.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lavka.llm.tables import running_start, shuffle_tasks
from lavka.operators.sizing import lookup_side
from lavka.session import cut

CELL = 256
TEXT = 65_536
NODE = ["depth", "a", "b"]


def turn_rows(turns):
    """One narrow row per turn: conv, depth (from 0), a and b (128 bits of role and text), size (code points of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"),
        F.sha2(text, 256).alias("_text"), F.length(text).cast("long").alias("size"))
    digest = F.sha2(F.concat_ws(":", F.length("role"), "role", "_text"), 256)
    # 60 bits each, so that they fit a signed number.
    rows = rows.withColumn("_digest", digest).withColumn("_one", F.lit(1)).withColumns({
        c: F.conv(F.substring("_digest", i, 15), 16, 10).cast("long") for c, i in (("a", 1), ("b", 16))}).drop("_digest")
    return running_start(rows, ["conv"], ["turn", "role", "_text"], "_one", "depth").select(
        "conv", "depth", "a", "b", "size")


# ---- sorted paths -----------------------------------------------------------

def paths(rows, convs, cell=CELL):
    """One row per cell of a conversation: cell, sa, sb, path, more, conv, sizes, before, total, n.

    ``path`` has the digests of the cell's turns, ``sa`` and ``sb`` are those of all turns before it, ``before``
    their code points, ``total`` all of the conversation's, ``more`` whether cells follow.
    """
    placed = rows.select("conv", "depth", "size", *[
        F.xxhash64("a", "b", "depth", F.lit(i)).alias(c) for i, c in enumerate(("a", "b"))])
    turn = F.array_sort(F.collect_list(F.struct("depth", "a", "b", "size")))
    cells = placed.groupBy("conv", F.expr(f"cast(depth div {cell} as long)").alias("cell")).agg(
        turn.alias("_turns"), F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"),
        F.sum("size").alias("sum"), F.count(F.lit(1)).alias("n"))
    cells = cut(cells.select(
        "conv", "cell", F.transform("_turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"))).alias("path"),
        F.transform("_turns", lambda t: t["size"]).alias("sizes"), "xa", "xb", "sum", "n"))
    # Conversations of several cells: what comes before each.
    long = cells.where("cell > 0").select(F.col("conv").alias("_conv")).distinct()
    parts = cells.select("conv", "cell", "xa", "xb", "sum").join(lookup_side(long, "_conv"), F.col("conv") == F.col("_conv"))
    earlier = Window.partitionBy("conv").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("conv").alias("_conv"), F.col("cell").alias("_cell"),
        F.bit_xor("xa").over(earlier).alias("_sa"), F.bit_xor("xb").over(earlier).alias("_sb"),
        F.sum("sum").over(earlier).alias("_before"), F.sum("sum").over(Window.partitionBy("conv")).alias("_total"),
        (F.max("cell").over(Window.partitionBy("conv")) > F.col("cell")).alias("_more"))
    cells = cells.join(parts, (F.col("conv") == F.col("_conv")) & (F.col("cell") == F.col("_cell")), "left")
    none = F.lit(0).cast("long")
    cells = cells.select(
        F.col("conv").alias("_own"), "cell", "path", "sizes", F.coalesce("_sa", none).alias("sa"),
        F.coalesce("_sb", none).alias("sb"), F.coalesce("_before", none).alias("before"),
        F.coalesce("_total", "sum").alias("total"), F.coalesce("_more", F.lit(False)).alias("more"), "xa", "xb", "n")
    # Conversations without turns are paths too.
    every = lookup_side(convs, "conv").join(cells, F.col("conv") == F.col("_own"), "left")
    empty = {c: F.array().cast(cells.schema[c].dataType) for c in ("path", "sizes")}
    return every.select("conv", *[
        F.coalesce(F.col(c), empty.get(c, F.lit(False) if c == "more" else none)).alias(c)
        for c in cells.columns if c != "_own"])


ORDER = ["cell", "sa", "sb", "path", "more", "conv"]


def in_ranges(rows):
    """Stored in sorted ranges, with ``range`` and the LCPs of its first path (``first``) and the next range's (``next``)."""
    spark = rows.sparkSession
    tasks = shuffle_tasks(spark)
    stored = cut(rows.repartitionByRange(tasks, *ORDER).withColumn("range", F.spark_partition_id()))
    key = F.struct(*ORDER)
    edges = stored.groupBy("range").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    # One row per range, as many as there are shuffle tasks.
    by_range = Window.orderBy("range")
    edges = edges.withColumn("_last", F.lag("high").over(by_range))
    same = F.zip_with("_last.path", "low.path", lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, False)
    shared = F.when(differs == 0, F.size("low.path")).otherwise(differs - 1)
    group = F.lit(True)
    for c in ("cell", "sa", "sb"):
        group = group & (F.col(f"_last.{c}") == F.col(f"low.{c}"))
    edges = edges.withColumn("first", F.when(F.coalesce(group, F.lit(False)), shared).otherwise(-1).cast("long"))
    edges = edges.select("range", "first", F.coalesce(F.lead("first").over(by_range), F.lit(-1)).cast("long").alias("next"))
    return stored.join(F.broadcast(cut(edges)), "range")


def in_order(ranged):
    """Whole ranges per task, in order."""
    return ranged.repartitionByRange(shuffle_tasks(ranged.sparkSession), "range").sortWithinPartitions("range", *ORDER)


# ---- blocks of sorted paths -------------------------------------------------

FIELDS = ["range", "first", "next", "cell", "sa", "sb", "before", "total", "more", "conv", "later_new", "later_leaf"]


class Block:
    """Some sorted paths of one range, as arrays."""

    def __init__(self, batch):
        for name in FIELDS:
            setattr(self, name, batch.column(name).to_numpy(zero_copy_only=False))
        path, sizes = batch.column("path"), batch.column("sizes")
        flat = path.flatten()
        self.a, self.b = (c.to_numpy(zero_copy_only=False) for c in flat.flatten())
        self.sizes = sizes.flatten().to_numpy(zero_copy_only=False)
        self.length = path.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.lcp = np.empty(len(self.length), np.int64)
        self.lcp[1:] = shared_turns(self, np.arange(len(self.length) - 1), self, np.arange(1, len(self.length)))

    def finish(self, first, after):
        self.lcp[0] = first
        self.after = np.append(self.lcp[1:], after)
        self.running = _sums(self.sizes)
        every = np.arange(len(self.lcp))
        self.own = self.first_sizes(every, self.length)
        self.new = self.own - self.first_sizes(every, np.maximum(self.lcp, 0))
        self.leaf = np.where(self.more, 0, self.after < self.length)
        return self

    def first_sizes(self, row, turns):
        """Code points of the first ``turns`` turns of the cell."""
        return self.running[self.offset[row] + turns] - self.running[self.offset[row]]


def shared_turns(one, at, other, there):
    """LCPs of paths ``at`` of one block and paths ``there`` of another; -1 if their cells differ."""
    most = np.minimum(one.length[at], other.length[there])
    pair = np.repeat(np.arange(len(at)), most)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(most) - most, most)
    left, right = one.offset[at][pair] + place, other.offset[there][pair] + place
    differs = np.flatnonzero((one.a[left] != other.a[right]) | (one.b[left] != other.b[right]))
    shared = most.copy()
    rows, first = np.unique(pair[differs], return_index=True)
    shared[rows] = place[differs][first]
    same = np.ones(len(at), bool)
    for c in ("cell", "sa", "sb"):
        same &= getattr(one, c)[at] == getattr(other, c)[there]
    return np.where(same, shared, -1)


def blocks(batches):
    """Blocks in order, each with the LCPs at its edges."""
    waiting = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ranges = batch.column("range").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])).tolist()
        for start, end in zip(starts, [*starts[1:], len(ranges)], strict=True):
            block = Block(batch.slice(start, end - start))
            first = block.first[0]
            if waiting is not None:
                if waiting[0].range[0] == block.range[0]:
                    first = shared_turns(waiting[0], np.array([len(waiting[0].length) - 1]), block, np.array([0]))[0]
                    yield waiting[0].finish(waiting[1], first)
                else:
                    yield waiting[0].finish(waiting[1], waiting[0].next[0])
            waiting = (block, first)
    if waiting is not None:
        yield waiting[0].finish(waiting[1], waiting[0].next[0])


class SparseTable:
    """Minima of any stretch of an array, from those of its stretches of powers of two."""

    def __init__(self, values):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-width], below[width:]))
            width *= 2

    def least(self, low, high):
        """Minima of the places low to high, both included."""
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << k) + 1])
        return out

    def right(self, at, bound):
        """Last place up to which all values after ``at`` are ``bound`` or more."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            values = self.levels[k]
            place = np.minimum(at + 1, len(values) - 1)
            at = np.where((at + 1 < len(values)) & (values[place] >= bound), at + (1 << k), at)
        return at

    def left(self, at, bound):
        """First place from which all values after it up to ``at`` are ``bound`` or more."""
        at = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            place = at - (1 << k) + 1
            at = np.where((place >= 1) & (self.levels[k][np.maximum(place, 0)] >= bound), at - (1 << k), at)
        return at


def _sums(values):
    return np.concatenate([[0], np.cumsum(values)])


PIECE = "depth long, a long, b long, pa long, pb long, is_new boolean, conv long, n long, leaves long, saved long"


def _pieces(block, cell):
    """The nodes seen in a block, one row each, as columns of PIECE."""
    # Candidates: per path the depths that the path before it in the block doesn't share.
    top = np.where(block.cell == 0, 0, 1)
    known = block.lcp.copy()
    known[0] = -1
    known = np.maximum(known, top - 1)
    count = np.maximum(block.length - known, 0)
    row = np.repeat(np.arange(len(count)), count)
    turns = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + known[row] + 1
    table = SparseTable(block.lcp)
    left, right = table.left(row, turns), table.right(row, turns)
    members = right - left + 1
    is_new = block.lcp[left] < turns
    earlier = block.first_sizes(left, np.maximum(turns - 1, 0))  # code points before the node's own text, in the cell
    total, fresh, leaves = (_sums(v) for v in (
        block.total, block.new + block.later_new, block.leaf + np.where(block.more, block.later_leaf, 0)))
    # What is new in the stretch; its first path counts from the node on if the node begins there.
    distinct = fresh[right + 1] - fresh[left + 1] + block.later_new[left] + np.where(
        is_new, block.own[left] - earlier, block.new[left])
    saved = total[right + 1] - total[left] - members * (block.before[left] + earlier) - distinct

    def digest(values, start, turns):
        running = np.concatenate([[0], np.bitwise_xor.accumulate(values)]) if len(values) else np.zeros(1, np.int64)
        return start[left] ^ running[block.offset[left] + turns] ^ running[block.offset[left]]

    above = np.maximum(turns - 1, 0)
    return [
        block.cell[left] * cell + turns, digest(block.a, block.sa, turns), digest(block.b, block.sb, turns),
        digest(block.a, block.sa, above), digest(block.b, block.sb, above), is_new,
        SparseTable(block.conv).least(left, right), members, leaves[right + 1] - leaves[left], saved]


def node_pieces(ordered, cell=CELL):
    def run(batches):
        names = [c.split()[0] for c in PIECE.split(", ")]
        for block in blocks(batches):
            columns = _pieces(block, cell)
            for i in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i:i + 100_000]) for c in columns], names)

    return ordered.select(*FIELDS, "path", "sizes").mapInArrow(run, PIECE)


def new_in_cells(ordered):
    """Rows (conv, cell, new, leaf): code points of turns that come first with this path, and whether it ends in a leaf."""

    def run(batches):
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(v.astype(np.int64)) for v in (block.conv, block.cell, block.new, block.leaf)],
                ["conv", "cell", "new", "leaf"])

    return ordered.select(*FIELDS, "path", "sizes").mapInArrow(run, "conv long, cell long, new long, leaf long")


def ends_digests(ends):
    """Rows (depth, a, b, ends_sha256) from (depth, a, b, conv): the hash of each node's ids in order, joined by commas."""
    tasks = shuffle_tasks(ends.sparkSession)

    def join(batches):
        at, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for *node, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != at or size > TEXT - 32:
                    if ids:
                        out.append((*at, first, ",".join(ids)))
                    at, first, ids, size = node, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield _batch(out, TEXTS)
        if ids:
            yield _batch([(*at, first, ",".join(ids))], TEXTS)

    def chain(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for *node, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != at:
                    if state is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = node, hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
            if out:
                yield _batch(out, HASHES)
        if state is not None:
            yield _batch([(*at, state.hexdigest())], HASHES)

    texts = ends.select(*NODE, "conv").repartitionByRange(tasks, *NODE, "conv").sortWithinPartitions(
        *NODE, "conv").mapInArrow(join, TEXTS)
    return texts.repartition(tasks, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(chain, HASHES)


TEXTS = "depth long, a long, b long, first long, text string"
HASHES = "depth long, a long, b long, ends_sha256 string"


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays(
        [pa.array(c) for c in zip(*rows, strict=True)], [c.split()[0] for c in schema.split(", ")])


# ---- nodes ------------------------------------------------------------------

def trie(rows, convs, cell=CELL):
    """The nodes of the trie of ``rows`` (conv, depth from 0, a, b, size); ``convs`` (conv) also has those without turns.

    Per node: conv_id (smallest member), depth, parent_conv_id (the parent's; null for the root), n_convs,
    n_children, n_leaves (childless nodes in its subtree), saved_tokens (over its subtree, each node's members but
    one times the code points of its last text), ends_sha256 (of the ids of members that end here).
    """
    path = cut(paths(rows, convs, cell))
    ranged = in_ranges(path)
    none = F.lit(0).cast("long")
    plain = ranged.withColumn("later_new", none).withColumn("later_leaf", none)
    if path.where("more").isEmpty():
        ranged = plain
    else:
        # Ranges from the first one on that has later cells.
        since = ranged.where("cell > 0").agg(F.min("range")).first()[0]
        found = cut(new_in_cells(in_order(plain.where(F.col("range") >= since))).where("cell > 0"))
        later = Window.partitionBy("conv").orderBy(F.col("cell").desc())
        # A leaf is counted where the conversation ends, what is new in all its later cells.
        found = found.select(
            F.col("conv").alias("_conv"), (F.col("cell") - 1).alias("_cell"), F.sum("new").over(later).alias("later_new"),
            F.sum("leaf").over(later).alias("later_leaf"))
        ranged = ranged.join(found, (F.col("conv") == F.col("_conv")) & (F.col("cell") == F.col("_cell")), "left").drop(
            "_conv", "_cell").fillna(0, ["later_new", "later_leaf"])
    pieces = cut(node_pieces(in_order(ranged), cell))
    child = pieces.where("is_new and depth > 0").select(
        (F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"), F.lit(1).cast("long").alias("child"))
    whole = pieces.unionByName(child, allowMissingColumns=True).groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"), F.coalesce(F.sum("child"), none).alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
        F.max("pa").alias("_pa"), F.max("pb").alias("_pb"))
    whole = cut(whole)
    ends = path.where("not more").select(
        F.expr(f"cell * {cell} + n").alias("depth"), F.expr("sa ^ xa").alias("a"), F.expr("sb ^ xb").alias("b"), "conv")
    digest = ends_digests(ends).select(*[F.col(c).alias(f"_e{c}") for c in NODE], "ends_sha256")
    rows = whole.join(lookup_side(digest, "_edepth", "_ea", "_eb"), _same(NODE, "_e"), "left")
    parent = whole.select((F.col("depth") + 1).alias("_udepth"), F.col("a").alias("_upa"), F.col("b").alias("_upb"),
                          F.col("conv_id").alias("parent_conv_id"))
    above = (F.col("depth") == F.col("_udepth")) & (F.col("_pa") == F.col("_upa")) & (F.col("_pb") == F.col("_upb"))
    rows = rows.join(lookup_side(parent, "_udepth", "_upa", "_upb"), above, "left")
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _same(columns, prefix):
    same = F.lit(True)
    for c in columns:
        same = same & (F.col(c) == F.col(f"{prefix}{c}"))
    return same


def conversation_trie(turns, cell=CELL):
    """The trie of ``turns`` (conv_id, turn, role, text) as they are."""
    rows = cut(turn_rows(turns))
    return trie(rows, rows.select("conv").distinct(), cell)
