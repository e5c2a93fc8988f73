"""Best-fit packing by bin completion with branch and bound.

Documents become token counts in one Arrow pass.  Only the number of pieces
of each length, at most ``capacity`` numbers, decides how sequences are
filled: the largest length left opens a sequence, undominated fillings of the
rest are enumerated around it, branches are cut by the waste they cannot get
below, and the best-fit filling is the first incumbent.  A filling is used as
often as its lengths last.  Pieces then find their place by their rank within
their length, which comes from ranks inside each written part and the sizes
of the parts before, so no length is ever gathered in one task.

Defined results: a NULL text is empty; every document ends with the end
token, so an empty one has one token.  Repeated rows, equal or NULL ids are
packed as documents of their own.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import sys
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property

from pyspark import cloudpickle
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
END_TOKEN = 0
#: Bytes of chunks, their ids and what holds them that one worker remembers.
CACHE_BYTES = 16 * 1024 * 1024
CACHE_ENTRY = 200
#: Fillings looked at around one largest piece before the incumbent stands.
#: Best fit over all pieces is planned beside it, and the better plan taken.
MAX_NODES = 5_000
#: The one special token of the vocabulary, taken as such inside texts.
SPECIAL = "<|endoftext|>"


class ChunkEncoder:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    Tokens never cross the place before a single space or around a single
    line break, when no other white space touches it.  Texts are cut there and
    ids remembered by chunk; a text with other white space there, or with the
    special token, is encoded as one.  With the same vocabulary as ranks, and
    its split pattern, chunks are encoded from those, which is quicker; the
    tokenizer itself is then read once a text has the special token.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None):
        self.tokenizer_path = tokenizer_path
        self.by_ranks = None
        if ranks_path is not None:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.by_ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.starts: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}
        self.line_break = self._ids("\n")
        self.marks = {mark: self._ids(mark) for mark in ".,"}
        self.size = 0

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.tokenizer_path)

    def _ids(self, text: str) -> bytes:
        if self.by_ranks is not None and SPECIAL not in text:
            return array("I", self.by_ranks.encode_ordinary(text)).tobytes()
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, table: dict[str, bytes], chunk: str, text: str) -> bytes:
        """Ids of a chunk not seen before; a mark after letters is a token of its own."""
        if chunk[-1] in self.marks and chunk[:-1].isalpha():
            word = chunk[:-1]
            ids = table.get(word)
            return (self._chunk(table, word, text[:-1]) if ids is None else ids) + self.marks[chunk[-1]]
        ids = self._ids(text)
        if len(chunk) < 64 and self.size < CACHE_BYTES:
            table[chunk] = ids
            self.size += CACHE_ENTRY + 4 * len(chunk) + len(ids)
        return ids

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return self._ids(text)
        parts: list[bytes] = []
        for line in text.split("\n"):
            chunks = line.split(" ")
            if chunks != line.split():
                return self._ids(text)  # empty line, runs of white space, or other white space
            first = self.starts.get(chunks[0])
            parts.append(self._chunk(self.starts, chunks[0], chunks[0]) if first is None else first)
            for chunk in chunks[1:]:
                ids = self.inner.get(chunk)
                parts.append(self._chunk(self.inner, chunk, " " + chunk) if ids is None else ids)
            parts.append(self.line_break)
        parts.pop()
        return b"".join(parts)


#: The one encoder that a worker keeps, by its paths.
_encoders: dict[tuple[str | None, ...], ChunkEncoder] = {}


def _encoder(*paths: str | None) -> ChunkEncoder:
    if paths not in _encoders:
        _encoders.clear()
        _encoders[paths] = ChunkEncoder(*paths)
    return _encoders[paths]


PIECES = (
    "row long, doc_id {id}, piece int, start long, length long, ids_crc32 long, part int, place long"
)


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces; the first takes what full ones leave."""
    head = total % capacity or min(total, capacity)
    starts = [0, *range(head, total, capacity)]
    return [(s, (head if s == 0 else capacity)) for s in starts]


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    ranks_path: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """One row per piece of each document; ``part, place`` rank it within its length.

    The paths are read where the tasks run, so the files must be installed there.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = _encoder(tokenizer_path, ranks_path, pattern)
        part = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        end = np.asarray([END_TOKEN], "<u4").tobytes()
        row = part << 33
        names = ("row", "doc_id", "piece", "start", "length", "ids_crc32", "part", "place")
        for columns in batches:
            out: list[tuple] = []
            for key, content in zip(columns["doc_id"], columns["text"]):
                ids = (encoder.encode(content) if content else b"") + end
                row += 1
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    out.append((row, key, piece, start, length, crc, part, seen[length]))
                    seen[length] += 1
            if out:
                yield dict(zip(names, zip(*out)))

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_batches(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), run, PIECES.format(id=kind)
    )


def best_fit(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Fill ``room`` with the largest piece that fits, again and again."""
    filling: list[int] = []
    for length in lengths:
        if length > room:
            continue
        n = min(counts[length], room // length)
        filling += [length] * n
        room -= n * length
        if room == 0:
            break
    return filling


def complete(
    largest: int, counts: dict[int, int], lengths: list[int], capacity: int, most_nodes: int = MAX_NODES
) -> list[int]:
    """The filling around ``largest`` with least waste; of equals, the one with larger pieces.

    ``lengths`` come largest first.  Depth-first over undominated fillings: a
    piece is left out only if what follows can still beat the incumbent, and
    as many copies are taken as fit before fewer are tried, since a filling
    whose pieces could be swapped for one larger fitting piece is dominated.
    """
    room = capacity - largest
    best = best_fit(lengths, counts, room)
    waste = room - sum(best)
    if waste == 0 or not lengths:
        return best
    # What pieces from here on hold at most: the bound on the waste of a branch.
    tail = [0] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        tail[i] = min(capacity, tail[i + 1] + lengths[i] * counts[lengths[i]])
    nodes = 0
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack and waste and nodes < most_nodes:
        i, left, taken = stack.pop()
        nodes += 1
        if left < waste:
            best, waste = list(taken), left
            if waste == 0:
                break
        while i < len(lengths) and lengths[i] > left:
            i += 1
        if i == len(lengths) or left - tail[i] >= waste:
            continue
        length = lengths[i]
        most = min(counts[length], left // length)
        for n in range(0, most + 1):  # the last pushed, most copies, is looked at first
            stack.append((i + 1, left - n * length, taken + (length,) * n))
    return best


Filling = tuple[tuple[int, ...], int, int]  # lengths in order of their offsets, first sequence, sequences


def _planned(histogram: dict[int, int], capacity: int, most_nodes: int) -> list[Filling]:
    counts = {length: n for length, n in histogram.items() if n > 0}
    lengths = sorted(counts, reverse=True)
    plan: list[Filling] = []
    sequence = 0
    while lengths:
        largest = lengths[0]
        counts[largest] -= 1
        rest = [n for n in lengths if counts[n] > 0]
        filling = [largest, *complete(largest, counts, rest, capacity, most_nodes)]
        counts[largest] += 1
        need = Counter(filling)
        times = min(counts[length] // n for length, n in need.items())
        for length, n in need.items():
            counts[length] -= n * times
        plan.append((tuple(filling), sequence, times))
        sequence += times
        lengths = [n for n in lengths if counts[n] > 0]
    return plan


def plan_fillings(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Filling]:
    """Fillings with the sequences that use them, for a count of pieces per length.

    Every step uses up at least one length or lowers it below what the same
    filling needs, so the plan has a few entries per length whatever the
    counts are.  A filling with less waste now may leave worse ones for later;
    the plan of incumbents alone is made too, and wins where it is shorter.
    """
    searched = _planned(histogram, capacity, MAX_NODES)
    plain = _planned(histogram, capacity, 0)
    return min(searched, plain, key=lambda plan: sum(times for _, _, times in plan))


def slots(plan: list[Filling]) -> dict[int, dict[str, np.ndarray]]:
    """For each length, the runs of ranks that a place in a filling takes.

    A run covers ``times`` ranks from ``rank`` on; its first piece lies in
    sequence ``first`` at ``offset``, the next in the sequence after.
    """
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter[int] = Counter()
    for filling, first, times in plan:
        offset = 0
        for length in filling:
            runs[length].append((used[length], first, offset))
            used[length] += times
            offset += length
    return {
        length: dict(zip(("rank", "first", "offset"), (np.asarray(v, np.int64) for v in zip(*found))))
        for length, found in runs.items()
    }


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``part, place`` are replaced.

    ``pieces`` must be a written table.  At most ``capacity`` counts come to
    the driver.
    """
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("_here"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per length and part of the table.
    shifts = written(
        by_part.select(
            "length", "part", "_here", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_shift")
        ),
        "packing-shifts",
    )
    histogram = {r["length"]: r["n"] for r in shifts.groupBy("length").agg(F.sum("_here").alias("n")).collect()}
    table = slots(plan_fillings(histogram, capacity))
    ranked = pieces.join(shifts.drop("_here"), ["length", "part"]).withColumn("_rank", F.col("place") + F.col("_shift"))
    kept = [c for c in pieces.columns if c not in ("part", "place")]
    ranked = ranked.select(*kept, "_rank")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema[: len(kept)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                here = np.flatnonzero(lengths == length)
                run = table[int(length)]
                at = np.searchsorted(run["rank"], ranks[here], "right") - 1
                sequence[here] = run["first"][at] + ranks[here] - run["rank"][at]
                offset[here] = run["offset"][at]
            columns = [batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, **options) -> DataFrame:
    """Pieces of all documents with their places: ``row, doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``row`` tells documents with equal ids apart.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity=capacity, **options)
    return pack(written(pieces, "packing-pieces"), capacity)
