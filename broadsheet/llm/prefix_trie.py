"""The trie of conversation prefixes, built as a burst trie.

A turn is known by a digest of its role and text.  Conversations are cut into
segments of ``SEGMENT`` turns, so that no row and no group holds a whole long
one; equal segments under the same beginning become one entry with a weight.
Entries lie in containers under a head of the trie, at first one container for
all beginnings (and one for each beginning that goes on in a further segment).
A container with more than ``CAPACITY`` turns bursts by the next turn where
its entries first differ, and its entries go on, shortened, in a container for
each such turn; what they share is kept as a chain of nodes of the head.  The
containers that remain are dealt out to tasks, sorted and swept into nodes
with one stack.  Totals of burst heads are summed from below, one round of
bursts and one segment after the other.

Copies of a conversation never meet as rows: they are counted before they are
moved.  The ids of those that end at one node are hashed in numeric order,
from one list up to ``LIST_IDS``, and beyond from sorted blocks of that many,
of which only one is in memory at a time.

Defined results: turns are taken by number, NULL first, those with the same
number by role and then by the digest; NULL roles and texts are empty.  Rows
without ``conv_id`` belong to no conversation and are left out.  Repeated rows
are repeated turns.  An empty table has no node, not even the root.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from ..operators.sizing import broadcast_if_small, is_small
from .common import map_batches, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Turns of one row, and of the containers that one task holds one at a time.
SEGMENT, CAPACITY = 1_024, 50_000
#: Ids that are one list.
LIST_IDS = 10_000

HEAD = ("head1", "head2")
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE_COLUMNS = [c.split()[0] for c in NODE.split(", ")]
NO_IDS = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, position, id, size`` of every turn; positions run 1, 2, 3... in a conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").isNotNull().alias("_numbered"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("_turn"),
        role.alias("_role"),
        F.unhex(F.md5(named.cast("binary"))).alias("id"),
        F.length(text).cast("long").alias("size"),
    )
    # Equal rows are equal turns, so any order of them is the same.
    turns = turns.withColumn("_row", F.monotonically_increasing_id())
    numbered = number_rows(turns, ["_numbered", "_turn", "_role", "id", "_row"], "position", ["conv_id"])
    return numbered.select("conv_id", "position", "id", "size")


def with_shared_start(turns: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """Conversations that start with turns of the first one of their block.

    ``turns`` must be a written table.  The first ``h`` turns of conversation c
    give way to those of ``c - c % block``, where ``h`` is the CRC of the id by
    ``heads``.  Gives ``conv_id, depth, id, size``, and one row of depth 0 for
    each conversation.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    first = (
        turns.where((F.col("conv_id") % block == 0) & (F.col("position") < heads))
        .groupBy(F.col("conv_id").alias("_base"))
        .agg(F.sort_array(F.collect_list(F.struct("position", "id", "size"))).alias("_first"))
    )
    convs = (
        turns.where("position = 1")
        .select("conv_id", h.cast("int").alias("_h"), (F.col("conv_id") - F.col("conv_id") % block).alias("_base"))
        .join(first, "_base", "left")
        .withColumn("_start", F.when(F.col("_h") > 0, F.expr("slice(_first, 1, _h)")))
        .select("conv_id", "_h", "_start", F.greatest(F.size(F.coalesce("_start", F.array())), F.lit(0)).alias("_taken"))
    )
    convs = written(convs, "trie-starts")
    own = (
        turns.join(convs.drop("_start"), "conv_id")
        .where("position > _h")
        .select("conv_id", (F.col("position") - F.col("_h") + F.col("_taken")).alias("depth"), "id", "size")
    )
    given = convs.select("conv_id", F.explode("_start").alias("_t")).select(
        "conv_id", F.col("_t.position").alias("depth"), "_t.id", "_t.size"
    )
    none = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("size"))
    return own.union(given).union(none)


def _pair(kind: str, *columns: str | Column) -> list[Column]:
    """Two independent hashes."""
    return [F.xxhash64(F.lit(f"{kind}{i}"), *columns) for i in (1, 2)]


def segments(turns: DataFrame, size: int) -> DataFrame:
    """One row per conversation and ``size`` turns, of which only the last holds fewer.

    ``head1, head2`` name the turns before the segment, ``next1, next2`` those
    before the next one.  ``turns`` are ``conv_id, depth, id, size`` and must
    have a row of depth 0 for each conversation.
    """
    here = F.when(F.col("depth") > 0, F.struct("depth", "id", "size"))
    level = F.greatest(F.floor((F.col("depth") - 1) / size), F.lit(0))
    places = F.array(F.struct(level.alias("level"), here.alias("turn")))
    # A full segment is followed by another one, which may be empty.
    after = F.array(F.struct((level + 1).alias("level"), F.when(F.lit(False), here).alias("turn")))
    full = (F.col("depth") > 0) & (F.col("depth") % size == 0)
    listed = (
        turns.select("conv_id", F.explode(F.when(full, F.concat(places, after)).otherwise(places)).alias("_place"))
        .groupBy("conv_id", F.col("_place.level").alias("level"))
        .agg(F.sort_array(F.collect_list("_place.turn")).alias("_turns"))
    )
    named = listed.select(
        "conv_id", "level", F.col("_turns.id").alias("ids"), F.col("_turns.size").alias("sizes")
    )
    one, two = _pair("segment", "level", "ids")
    before = Window.partitionBy("conv_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    hashed = named.withColumn("entry1", one).withColumn("entry2", two)
    for i in (1, 2):
        hashed = hashed.withColumn(f"head{i}", F.coalesce(F.bit_xor(f"entry{i}").over(before), F.lit(0)))
    for i in (1, 2):
        hashed = hashed.withColumn(f"next{i}", F.col(f"head{i}").bitwiseXOR(F.col(f"entry{i}")))
    return hashed


def id_digests(members: DataFrame, keys: list[str], list_ids: int = LIST_IDS) -> DataFrame:
    """``keys`` and ``ends_sha256``, the digest of all ``conv_id`` of a group in numeric order.

    ``members`` must be a written table.
    """
    counts = members.groupBy(*keys).agg(F.count("*").alias("_n"))
    large = written(counts.where(F.col("_n") > list_ids).select(*keys), "trie-large-ends")
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    listed = lambda rows: rows.groupBy(*keys).agg(F.sha2(F.array_join(ids, ","), 256).alias("ends_sha256"))
    if large.isEmpty():
        return listed(members)
    few = F.broadcast(large) if is_small(large, keys[0]) else large
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.select(*keys).schema)

    def grouped(batches: Iterator[pa.RecordBatch], value: str) -> Iterator[tuple[tuple, Iterator]]:
        rows = (
            row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in [*keys, value]))
        )
        return groupby(rows, key=lambda row: row[:-1])

    def batch(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names=names)

    def arrow(schema: str) -> pa.Schema:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        return to_arrow_schema(_parse_datatype_string(schema))

    block_schema = arrow(f"{kinds}, _from long, _ids string")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in grouped(batches, "conv_id"):
            ids: list[int] = []
            for row in rows:
                ids.append(row[-1])
                if len(ids) == list_ids:
                    yield batch([(*key, ids[0], ",".join(map(str, ids)))], [*keys, "_from", "_ids"], block_schema)
                    ids = []
            if ids:
                yield batch([(*key, ids[0], ",".join(map(str, ids)))], [*keys, "_from", "_ids"], block_schema)

    digest_schema = arrow(f"{kinds}, ends_sha256 string")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in grouped(batches, "_ids"):
            hashed, comma = hashlib.sha256(), b""
            for row in rows:
                hashed.update(comma + row[-1].encode())
                comma = b","
            yield batch([(*key, hashed.hexdigest())], [*keys, "ends_sha256"], digest_schema)

    order = [*keys, "conv_id"]
    sorted_blocks = written(
        members.join(few, keys)
        .select(*order)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(blocks, f"{kinds}, _from long, _ids string"),
        "trie-id-blocks",
    )
    streamed = (
        sorted_blocks.repartition(*keys).sortWithinPartitions(*keys, "_from").mapInArrow(digests, f"{kinds}, ends_sha256 string")
    )
    return listed(members.join(few, keys, "left_anti")).union(streamed)


def shared_length(low: Column, high: Column) -> Column:
    """Length of the common prefix of two arrays that differ."""
    differs = F.zip_with(low, high, lambda x, y: ~x.eqNullSafe(y))
    return (F.array_position(differs, True) - 1).cast("int")


def swept(container: list[dict]) -> list[list]:
    """Nodes of one container from its sorted entries; the head comes last, its parent open.

    A row is first member, depth, parent's first member, members, children,
    leaves, saved tokens and digest of ends.
    """
    depth, head_size = container[0]["depth"], container[0]["head_size"]
    rows: list[list] = []
    stack: list[list] = []
    path: list[bytes] = []

    def opened(size: int) -> None:
        # size, members, first member, children, leaves, saved, ends, rows of the children
        stack.append([size, 0, None, 0, 0, 0, NO_IDS, []])

    def closed() -> None:
        size, members, first, children, leaves, saved, ends, below = stack.pop()
        leaves = leaves if children else 1
        saved += (members - 1) * size
        for row in below:
            rows[row][2] = first
        rows.append([first, depth + len(stack), None, members, children, leaves, saved, ends])
        if stack:
            top = stack[-1]
            top[1] += members
            top[2] = first if top[2] is None else min(top[2], first)
            top[3] += 1
            top[4] += leaves
            top[5] += saved
            top[7].append(len(rows) - 1)

    opened(head_size)
    for entry in container:
        ids = entry["ids"]
        same = 0
        while same < len(path) and same < len(ids) and path[same] == ids[same]:
            same += 1
        while len(stack) > same + 1:
            closed()
        for size in entry["sizes"][same:]:
            opened(size)
        path = ids
        top = stack[-1]
        top[1] += entry["n"]
        top[2] = entry["first"] if top[2] is None else min(top[2], entry["first"])
        top[6] = entry["ends_sha256"] or NO_IDS
        if entry["tail_children"]:
            top[3] += entry["tail_children"]
            top[4] += entry["tail_leaves"]
            top[5] += entry["tail_saved"]
    while stack:
        closed()
    return rows


ENTRY = ["depth", "head_size", "ids", "sizes", "n", "first", "ends_sha256", "tail_children", "tail_leaves", "tail_saved"]


def sweep(entries: DataFrame) -> DataFrame:
    """Nodes of all containers with ``head1, head2, up1, up2`` and whether a node is the head."""
    names = [*HEAD, "up1", "up2"]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        rows = (
            dict(zip(columns, row)) for columns in batches for row in zip(*columns.values())
        )
        for key, group in groupby(rows, key=lambda row: tuple(row[c] for c in names)):
            nodes = swept(list(group))
            out = dict(zip(NODE_COLUMNS, map(list, zip(*nodes))))
            for name, value in zip(names, key):
                out[name] = [value] * len(nodes)
            out["is_head"] = [False] * (len(nodes) - 1) + [True]
            yield out

    dealt = entries.select(*names, *ENTRY).repartition(*HEAD).sortWithinPartitions(*HEAD, "ids")
    return map_batches(dealt, run, f"{NODE}, head1 long, head2 long, up1 long, up2 long, is_head boolean")


def burst(entries: DataFrame, capacity: int) -> tuple[DataFrame, list[DataFrame]]:
    """Entries in containers that are small enough, and the heads that burst, round by round.

    A head has the chain of nodes that all its entries share, as ``sizes``.
    """
    settled: list[DataFrame] = []
    rounds: list[DataFrame] = []
    while True:
        heads = entries.groupBy(*HEAD).agg(
            F.sum(F.size("ids") + 1).alias("_turns"),
            F.count("*").alias("_entries"),
            shared_length(F.min("ids"), F.max("ids")).alias("_shared"),
        )
        over = written(heads.where((F.col("_turns") > capacity) & (F.col("_entries") > 1)).select(*HEAD, "_shared"), "trie-over")
        if over.isEmpty():
            settled.append(entries)
            break
        few = F.broadcast(over) if is_small(over, "head1") else over
        settled.append(entries.join(few, list(HEAD), "left_anti"))
        opened = entries.join(few, list(HEAD)).withColumn("_out", F.size("ids") == F.col("_shared"))
        ended = lambda c: F.max(F.when(F.col("_out"), F.col(c))).alias(c)
        rounds.append(
            written(
                opened.groupBy(*HEAD, "up1", "up2", "depth").agg(
                    F.first(F.concat(F.array("head_size"), F.expr("slice(sizes, 1, _shared)"))).alias("sizes"),
                    F.sum("n").alias("n"),
                    F.min("first").alias("first"),
                    *[ended(c) for c in ("ends_sha256", "tail_children", "tail_leaves", "tail_saved")],
                ),
                "trie-burst",
            )
        )
        one, two = _pair("burst", *HEAD, F.expr("slice(ids, 1, _shared + 1)"))
        entries = written(
            opened.where(~F.col("_out")).select(
                one.alias("head1"),
                two.alias("head2"),
                F.col("head1").alias("up1"),
                F.col("head2").alias("up2"),
                (F.col("depth") + F.col("_shared") + 1).alias("depth"),
                F.get("sizes", F.col("_shared")).alias("head_size"),
                F.expr("slice(ids, _shared + 2, size(ids))").alias("ids"),
                F.expr("slice(sizes, _shared + 2, size(sizes))").alias("sizes"),
                *ENTRY[4:],
            ),
            "trie-entries",
        )
    whole = settled[0]
    for part in settled[1:]:
        whole = whole.unionByName(part)
    return whole, rounds


def nodes_of(entries: DataFrame, capacity: int) -> DataFrame:
    """All nodes of the containers of ``entries``; ``is_head`` marks the first heads, whose parent is open.

    ``head1, head2`` name the first head.
    """
    containers, rounds = burst(entries, capacity)
    found = written(sweep(containers), "trie-nodes")
    if not rounds:
        return found.select(*NODE_COLUMNS, *HEAD, "is_head")
    inner = found.where(~F.col("is_head"))
    heads = found.where("is_head")
    parts = [inner.select(*NODE_COLUMNS, *HEAD, F.lit(False).alias("is_head"))]
    for heads_above in reversed(rounds):
        # The heads under this round's are swept containers, and heads of the round after.
        below = heads.groupBy(F.col("up1").alias("head1"), F.col("up2").alias("head2")).agg(
            F.count("*").alias("_children"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved")
        )
        none = F.lit(0).cast("long")
        summed = heads_above.join(below, list(HEAD)).select(
            *HEAD,
            "up1",
            "up2",
            "depth",
            "sizes",
            "n",
            "first",
            "ends_sha256",
            (F.col("_children") + F.coalesce("tail_children", none)).alias("_children"),
            (F.col("_leaves") + F.coalesce("tail_leaves", none)).alias("n_leaves"),
            (F.col("_saved") + F.coalesce("tail_saved", none)).alias("_saved"),
        )
        # Along the chain only the last node branches, and only there conversations end.
        last = F.size("sizes") - 1
        chain = written(
            summed.select("*", F.posexplode("sizes").alias("_at", "_size")).select(
                F.col("first").alias("conv_id"),
                (F.col("depth") + F.col("_at")).alias("depth"),
                F.when(F.col("_at") > 0, F.col("first")).alias("parent_conv_id"),
                F.col("n").alias("n_convs"),
                F.when(F.col("_at") == last, F.col("_children")).otherwise(1).cast("long").alias("n_children"),
                "n_leaves",
                (
                    F.col("_saved")
                    + (F.col("n") - 1) * F.aggregate(F.expr("slice(sizes, _at + 1, size(sizes))"), none, lambda s, x: s + x)
                ).alias("saved_tokens"),
                F.when(F.col("_at") == last, F.coalesce("ends_sha256", F.lit(NO_IDS))).otherwise(NO_IDS).alias("ends_sha256"),
                *HEAD,
                "up1",
                "up2",
                (F.col("_at") == 0).alias("is_head"),
            ),
            "trie-chain",
        )
        parts.append(chain.where(~F.col("is_head")).select(*NODE_COLUMNS, *HEAD, "is_head"))
        firsts = heads_above.select(F.col("head1").alias("up1"), F.col("head2").alias("up2"), F.col("first").alias("_parent"))
        # Heads below get their parent here; those of other rounds wait.
        given = heads.join(broadcast_if_small(firsts, "up1"), ["up1", "up2"], "left")
        parts.append(
            given.where("_parent IS NOT NULL")
            .withColumn("parent_conv_id", F.col("_parent"))
            .select(*NODE_COLUMNS, *HEAD, F.lit(False).alias("is_head"))
        )
        waiting = given.where("_parent IS NULL").drop("_parent").select(*heads.columns)
        heads = written(waiting.unionByName(chain.where("is_head").select(*heads.columns)), "trie-heads")
    parts.append(heads.select(*NODE_COLUMNS, *HEAD, "is_head"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def prefix_trie(turns: DataFrame, segment: int = SEGMENT, capacity: int = CAPACITY, list_ids: int = LIST_IDS) -> DataFrame:
    """Every node of the trie of ``turns`` (``conv_id, depth, id, size``, and a row of depth 0 for each conversation)."""
    cut = written(segments(turns, segment), "trie-segments")
    levels = cut.agg(F.max("level")).first()[0]
    if levels is None:
        return turns.sparkSession.createDataFrame([], NODE)
    key = ["level", *HEAD, "entry1", "entry2"]
    ends = written(id_digests(cut.where(F.size("ids") < segment).select(*key, "conv_id"), key, list_ids), "trie-ends")
    entries = written(
        cut.groupBy(*key, "next1", "next2")
        .agg(F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("first"))
        .join(ends, key, "left")
        .select(
            *key[:3],
            "next1",
            "next2",
            F.lit(None).cast("long").alias("up1"),
            F.lit(None).cast("long").alias("up2"),
            (F.col("level") * segment).alias("depth"),
            F.lit(0).cast("long").alias("head_size"),
            "ids",
            "sizes",
            "n",
            "first",
            "ends_sha256",
        ),
        "trie-first-entries",
    )
    tails = ["tail_children", "tail_leaves", "tail_saved"]
    parts: list[DataFrame] = []
    totals: DataFrame | None = None
    for level in range(levels, -1, -1):
        own = entries.where(F.col("level") == level)
        if totals is None:
            own = own.select("*", *[F.lit(None).cast("long").alias(t) for t in tails])
        else:
            # Where a full segment ends, conversations end as the empty segment after it tells.
            own = own.join(totals.withColumnRenamed("ends_sha256", "_after"), ["next1", "next2"], "left").withColumn(
                "ends_sha256", F.coalesce("ends_sha256", "_after")
            )
        found = nodes_of(own.select(*HEAD, "up1", "up2", *ENTRY), capacity)
        if level == 0:
            parts.append(found.select(*NODE_COLUMNS))
            continue
        found = written(found, "trie-level")
        # The first head of a later segment is the last node of the segment before, where it is given out.
        parts.append(found.where(~F.col("is_head")).select(*NODE_COLUMNS))
        totals = found.where("is_head").select(
            F.col("head1").alias("next1"),
            F.col("head2").alias("next2"),
            *[F.when(F.col("n_children") > 0, F.col(c)).alias(t) for c, t in zip(NODE_COLUMNS[4:7], tails)],
            "ends_sha256",
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
