"""Chat formatting as prefix trees: conversations that begin alike share their first turns.

A turn is written as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line
feed. Control strings inside roles and texts are escaped, reversibly: a backslash
becomes two, ``<|`` becomes ``<\\|``, and a line feed in a role becomes ``\\n``. A token is
a code point of the written form; loss is on the text of assistant turns.

Conversations with the same first turns are paths from the root of one tree. A node (a
turn after certain turns) is emitted once, by its owner, the smallest conversation
that has it. What a conversation owns is the end of its path, so it is emitted in one
stretch, and the stretches come in depth-first order: after a stretch those
that leave it, from its deep end upwards, smaller conversations first. The key of
this order is the list of places where a path changes owner, as long as the path has
branches. Every node has its place in its tree's sequence, the position ids it covers
(what precedes it on its path) and the intervals of its ancestors, which with the
node itself are all that its tokens may attend to.

Nodes are recognised by 128 bits: the exclusive or, over the turns so far, of the
SHA-256 of each turn with its place. A hot first turn or a hot tree is combined before
shuffles and range-partitioned by the order; nothing is gathered but the branches of
one path. A conversation's turns are sorted, not collected, and may be any number.

Turns are ordered by turn (null first), then role and text, where null counts as
empty. Turns without a conversation id form one conversation with a null id.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lavka.llm.tables import running_start
from lavka.operators.sizing import lookup_side
from lavka.session import cut

START, END = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
NO_ID = -2 ** 63  # stands for a null conversation id


# ---- the written form -------------------------------------------------------

def escaped(text):
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(role):
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescape(text):
    """Takes back ``escaped`` and ``escaped_role``."""
    if "\\" not in text:
        return text
    return "\\".join(part.replace("\\|", "|").replace("\\n", "\n") for part in text.split("\\\\"))


def written_turns(turns):
    """Adds role and text without nulls, ``formatted`` and where the loss is in it (from, to)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv"), "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumn("_head", F.length(head)).withColumn(
        "formatted", F.concat(head, escaped(F.col("text")), F.lit(END)))
    rows = rows.withColumn("n", F.length("formatted").cast("long"))
    learned = F.col("role") == LOSS_ROLE
    return rows.withColumn("loss_from", F.when(learned, F.col("_head"))).withColumn(
        "loss_to", F.when(learned, F.col("n").cast("int") - len(END))).drop("_head")


# ---- the tree ---------------------------------------------------------------

NODE = ["depth", "_a", "_b"]


def paths(turns):
    """One row per turn: conv, depth, position, n, formatted, loss span and the node's 128 bits."""
    rows = written_turns(turns)
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    rows = rows.withColumn("depth", F.row_number().over(order) - 1)
    digest = F.sha2(F.concat_ws(":", "depth", F.length("role"), "role", "text"), 256)
    rows = rows.withColumn("_digest", digest)
    for name, start in (("_a", 1), ("_b", 16)):
        # 60 bits each, so that they fit a signed number; xor over the turns so far.
        part = F.conv(F.substring("_digest", start, 15), 16, 10).cast("long")
        rows = rows.withColumn(f"{name}_turn", part)
    so_far = Window.partitionBy("conv").orderBy("depth")
    return rows.withColumns({
        "_a": F.bit_xor("_a_turn").over(so_far), "_b": F.bit_xor("_b_turn").over(so_far),
        "position": F.sum("n").over(so_far) - F.col("n"),
    }).drop("_digest", "_a_turn", "_b_turn", "turn", "role", "text")


def trees(turns):
    """(nodes, paths): the packed trees, and each conversation's way through them.

    ``nodes``, one row per node: tree (its smallest conversation), owner, depth, start (place in
    the tree's sequence), position (of its first token), n, formatted, loss_from and
    loss_to (from the node's start), ancestors (array of from, to in the sequence).
    ``paths``, one row per turn of a conversation: conv, depth, tree, start.
    """
    turn = cut(paths(turns))
    owners = turn.groupBy(*NODE).agg(F.min("conv").alias("owner"))
    owned = cut(_with_owner(turn.select("conv", *NODE, "position", "n"), owners))

    # Where the owner changes on a path: a stretch begins, for its owner or for one who shares it.
    by_depth = Window.partitionBy("conv").orderBy("depth")
    changes = owned.withColumn("_before", F.lag("owner").over(by_depth)).where(
        "_before is null or _before <> owner").withColumn("_to", F.lead("position").over(by_depth))
    changes = changes.select("conv", "depth", "owner", "position", "_to")
    key = changes.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "owner"))).alias("_path")).select(
        F.col("conv").alias("_conv"), F.col("_path")[0]["owner"].alias("tree"),
        # Deeper branches come first, then smaller conversations.
        F.transform("_path", lambda p: F.struct((-p["depth"]).alias("up"), p["owner"].alias("owner"))).alias("_order"))
    stretch = owned.where("conv = owner").groupBy("conv").agg(
        F.sum("n").alias("n"), F.min("position").alias("_first"))
    stretch = stretch.join(key, F.col("conv") == F.col("_conv")).drop("_conv")
    stretch = cut(running_start(stretch, ["tree"], ["_order"], "n", "_start").drop("_order"))

    # Place of a node: its stretch's start and what precedes it in the stretch.
    place = stretch.select(F.col("conv").alias("_owner"), "tree", (F.col("_start") - F.col("_first")).alias("_shift"))
    placed = owned.join(lookup_side(place, "_owner"), F.col("owner") == F.col("_owner")).withColumn(
        "start", F.col("position") + F.col("_shift"))

    # Ancestors: one interval per earlier stretch of the path, and the own stretch so far.
    shared = changes.where("_to is not null").join(lookup_side(place, "_owner"), F.col("owner") == F.col("_owner"))
    shared = shared.select("conv", "depth", F.struct(
        (F.col("position") + F.col("_shift")).alias("from"), (F.col("_to") + F.col("_shift")).alias("to")).alias("_interval"))
    above = shared.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "_interval"))).alias("_above")).select(
        F.col("conv").alias("_conv"), F.transform("_above", lambda p: p["_interval"]).alias("_above"))
    own = placed.where("conv = owner").join(
        stretch.select(F.col("conv").alias("_c"), "_start"), F.col("conv") == F.col("_c"))
    own = own.join(above, F.col("conv") == F.col("_conv"), "left")
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    before = F.when(F.col("start") > F.col("_start"), F.array(F.struct(
        F.col("_start").alias("from"), F.col("start").alias("to")))).otherwise(none)
    # The own path's last interval above is complete; the stretch's own beginning joins it.
    own = own.select("tree", F.col("conv").alias("_oc"), F.col("depth").alias("_od"), "start",
                     F.concat(F.coalesce("_above", none), before).alias("ancestors"))
    nodes = turn.join(own, (F.col("conv") == F.col("_oc")) & (F.col("depth") == F.col("_od"))).select(
        "tree", F.col("conv").alias("owner"), "depth", "start", "position", "n", "formatted", "loss_from", "loss_to",
        "ancestors")
    return nodes, placed.select("conv", "depth", "tree", "start")


def _with_owner(rows, owners):
    named = owners.select(*[F.col(c).alias(f"_n{c}") for c in NODE], "owner")
    same = F.lit(True)
    for c in NODE:
        same = same & (F.col(c) == F.col(f"_n{c}"))
    return rows.join(lookup_side(named, *[f"_n{c}" for c in NODE]), same).drop(*[f"_n{c}" for c in NODE])


# ---- reading back -----------------------------------------------------------

def read_back(nodes, ways, width=4096):
    """Per conversation, from the emitted nodes: conv, depth, formatted, loss_from, loss_to.

    A conversation is what its last node may attend to: the intervals of that node's ancestors
    and the node itself, read from its tree's sequence. Intervals and nodes meet by stretches of
    ``width`` tokens, so an interval of any length is found without comparing it to all nodes.
    """
    last = ways.groupBy("conv").agg(F.max(F.struct("depth", "tree", "start")).alias("_last")).select(
        "conv", F.col("_last.tree").alias("_tree"), F.col("_last.start").alias("_at"))
    ends = last.join(
        lookup_side(nodes.select("tree", "start", "n", "ancestors"), "tree", "start"),
        (F.col("_tree") == F.col("tree")) & (F.col("_at") == F.col("start")))
    own = F.array(F.struct(F.col("start").alias("from"), (F.col("start") + F.col("n")).alias("to")))
    seen = ends.select("conv", "_tree", F.explode(F.concat("ancestors", own)).alias("_seen"))
    stretch = lambda place: F.floor(place / width).cast("long")
    seen = seen.select("conv", "_tree", "_seen", F.explode(F.sequence(
        stretch(F.col("_seen.from")), stretch(F.col("_seen.to") - 1))).alias("_stretch"))
    place = nodes.select(
        "tree", stretch(F.col("start")).alias("stretch"), "start", "depth", "formatted", "loss_from", "loss_to")
    met = (F.col("_tree") == F.col("tree")) & (F.col("_stretch") == F.col("stretch"))
    inside = (F.col("start") >= F.col("_seen.from")) & (F.col("start") < F.col("_seen.to"))
    return seen.join(place, met & inside).select("conv", "depth", "formatted", "loss_from", "loss_to")


def parse(formatted):
    """(role, text) of a written turn."""
    head, text = formatted[len(START):-len(END)].split("\n", 1)
    return unescape(head), unescape(text)


RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(rows):
    """Digests of each conversation's turns and of its loss text, from ``read_back``.

    A conversation's turns come to one task in order, since SHA-256 is a chain; the
    task keeps one turn at a time.
    """

    def run(batches):
        conv, state = None, None

        def done():
            return (None if conv == NO_ID else conv, state["turns"], state["all"].hexdigest(), state["chars"],
                    state["loss"].hexdigest(), state["formatted"])

        for batch in batches:
            out = []
            for at, formatted, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or at != conv:
                    if state is not None:
                        out.append(done())
                    conv = at
                    state = {"turns": 0, "chars": 0, "formatted": 0, "all": hashlib.sha256(), "loss": hashlib.sha256()}
                role, text = parse(formatted)
                state["turns"] += 1
                state["formatted"] += len(formatted)
                state["all"].update(f"{role}\n{text}\n".encode())
                if low is not None:
                    learned = unescape(formatted[low:high])
                    state["chars"] += len(learned)
                    state["loss"].update(learned.encode())
            if out:
                yield _records(out)
        if state is not None:
            yield _records([done()])

    spread = rows.repartition("conv").sortWithinPartitions("conv", "depth")
    return spread.select("conv", "formatted", "loss_from", "loss_to").mapInArrow(run, RESULT)


def _records(rows):
    names = [c.split()[0] for c in RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def formatted_digests(turns):
    """Formats ``turns`` (conv_id, turn, role, text) into trees and reads every conversation back."""
    nodes, ways = trees(turns)
    return digests(read_back(nodes, ways))
