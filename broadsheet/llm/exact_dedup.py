"""Exact duplicates by Patricia tries that own a length-and-hash partition.

Texts are equal when they are identical without white space.  A text whose
(length, content hash) no other row has is unique and needs no trie.  The
full byte strings of the others go into compressed radix tries: first one
per input partition, which leaves one entry per distinct text and so takes
hot groups apart before the shuffle, then one per (length, hash) bucket.  A
terminal node keeps the best row and the number of rows.  A trie that
outgrows its memory bound emits its largest subtree and forgets it; entries
that were emitted twice meet again in the next trie.

Defined results: a NULL text counts as empty, and empty texts are equal.
The row with the most code points stays, then the smallest id; a NULL id
loses to every other id.  Rows with the same id and text are copies like any
others and each gets its row.  An empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sizing import is_small
from .common import map_batches, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text that one trie holds before it emits a subtree.
TRIE_BYTES = 48 * 1024 * 1024
#: Entries in one emitted Arrow batch.
BATCH_ROWS = 2_000
#: Spark orders NULL ids last here.
NO_ID = 2**63 - 1

Best = tuple[int, int, bool, int]  # code points negated, id, id is NULL, rows


class Node:
    """A compressed edge to here, the children by first byte, and the owner of a whole text."""

    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes, owner: Best | None = None):
        self.label = label
        self.children: dict[int, Node] = {}
        self.owner = owner


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common start, found by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def merge(a: Best | None, b: Best) -> Best:
    """The better owner with both counts."""
    if a is None:
        return b
    return (*min(a[:3], b[:3], key=lambda o: (o[0], o[2], o[1])), a[3] + b[3])


class PatriciaTrie:
    """A radix tree over byte strings with bounded memory."""

    def __init__(self) -> None:
        self.root = Node(b"")
        self.bytes = 0

    def insert(self, text: bytes, owner: Best) -> None:
        node, rest = self.root, text
        while rest:
            child = node.children.get(rest[0])
            if child is None:
                node.children[rest[0]] = Node(rest, owner)
                self.bytes += len(rest) + 200
                return
            common = shared_prefix(child.label, rest)
            if common < len(child.label):
                upper = Node(child.label[:common])
                child.label = child.label[common:]
                upper.children[child.label[0]] = child
                node.children[rest[0]] = upper
                self.bytes += 200
                child = upper
            node, rest = child, rest[common:]
        node.owner = merge(node.owner, owner)

    @staticmethod
    def entries(top: Node, start: bytes) -> Iterator[tuple[bytes, Best]]:
        """All texts below a node, without recursion."""
        stack = [(top, start + top.label)]
        while stack:
            node, text = stack.pop()
            if node.owner is not None:
                yield text, node.owner
            stack.extend((child, text + child.label) for child in node.children.values())

    @staticmethod
    def weight(top: Node) -> int:
        total, stack = 0, [top]
        while stack:
            node = stack.pop()
            total += len(node.label) + 200
            stack.extend(node.children.values())
        return total

    def spill(self) -> Iterator[tuple[bytes, Best]]:
        """Take out the largest subtree below the first fork and yield its texts."""
        node, start = self.root, b""
        while len(node.children) == 1:
            if node.owner is not None:
                yield start, node.owner
                node.owner = None
            node = next(iter(node.children.values()))
            start += node.label
        weights = {key: self.weight(child) for key, child in node.children.items()}
        if not weights:
            yield from self.drain()
            return
        key = max(weights, key=weights.get)
        yield from self.entries(node.children.pop(key), start)
        self.bytes -= weights[key]

    def drain(self) -> Iterator[tuple[bytes, Best]]:
        yield from self.entries(self.root, b"")
        self.__init__()


ENTRY = "text_length long, text_hash long, content binary, points long, id long, no_id boolean, copies long"


def own(rows: DataFrame, by_bucket: bool) -> DataFrame:
    """One entry per distinct content of each partition, or of each bucket.

    ``rows`` has the columns of ``ENTRY``.  With ``by_bucket`` they must come
    sorted by length and hash, and a trie is drained when its bucket ends, so
    it holds the distinct texts of one bucket.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        trie = PatriciaTrie()
        out: list[tuple] = []
        bucket = None

        def keep(entries: Iterator[tuple[bytes, Best]]) -> None:
            for string, best in entries:
                length, code = int.from_bytes(string[:8], "big"), int.from_bytes(string[8:16], "big", signed=True)
                out.append((length, code, string[16:], -best[0], best[1], best[2], best[3]))

        def batch() -> dict:
            columns = dict(zip(("text_length", "text_hash", "content", "points", "id", "no_id", "copies"), zip(*out)))
            out.clear()
            return columns

        for columns in batches:
            for length, code, content, points, row_id, no_id, copies in zip(*(columns[c] for c in columns)):
                key = length.to_bytes(8, "big") + code.to_bytes(8, "big", signed=True)
                if by_bucket and key != bucket:
                    keep(trie.drain())
                    bucket = key
                # Length and hash lead every string, so each bucket is a subtree of its own.
                trie.insert(key + content, (-points, row_id, no_id, copies))
                while trie.bytes > TRIE_BYTES and not by_bucket:
                    keep(trie.spill())
                if len(out) >= BATCH_ROWS:
                    yield batch()
        keep(trie.drain())
        if out:
            yield batch()

    return map_batches(rows, run, ENTRY)


def normalised(text: Column) -> Column:
    """The text without white space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Two scans of the texts.  The first writes lengths and digests, the second
    brings only texts with a partner to the tries.
    """
    bare = normalised(F.col(text))
    points = F.coalesce(F.length(F.col(text)), F.lit(0)).cast("long")
    facts = written(
        docs.select(F.col(doc_id).alias("doc_id"), bare.alias("_bare"), points.alias("points")).select(
            "doc_id",
            "points",
            F.length("_bare").cast("long").alias("text_length"),
            F.xxhash64("_bare").alias("text_hash"),
            F.sha2(F.col("_bare").cast("binary"), 256).alias("text_sha256"),
        ),
        "exact-facts",
    )
    shared = written(
        facts.groupBy("text_length", "text_hash").count().where("count > 1").drop("count"), "exact-shared"
    )
    wanted = F.broadcast(shared) if is_small(shared, "text_hash") else shared
    contents = (
        docs.select(F.col(doc_id).alias("doc_id"), bare.alias("_bare"), points.alias("points"))
        .select(
            F.length("_bare").cast("long").alias("text_length"),
            F.xxhash64("_bare").alias("text_hash"),
            F.col("_bare").cast("binary").alias("content"),
            "points",
            F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
            F.col("doc_id").isNull().alias("no_id"),
            F.lit(1).cast("long").alias("copies"),
        )
        .join(wanted, ["text_length", "text_hash"], "left_semi")
    )
    dealt = (
        own(contents, by_bucket=False)
        .repartition("text_length", "text_hash")
        .sortWithinPartitions("text_length", "text_hash")
    )
    groups = own(dealt, by_bucket=True).select(
        F.sha2("content", 256).alias("_sha"),
        F.when(~F.col("no_id"), F.col("id")).alias("_keep"),
        F.col("points").alias("_points"),
        F.col("copies").alias("_copies"),
    )
    return (
        facts.join(groups, F.col("text_sha256") == F.col("_sha"), "left")
        .select(
            "doc_id",
            F.when(F.col("_sha").isNull(), F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
            F.coalesce("_copies", F.lit(1)).cast("long").alias("group_size"),
            (F.col("_sha").isNull() | F.col("doc_id").eqNullSafe(F.col("_keep"))).alias("kept"),
            "text_sha256",
        )
    )
