"""The prefix trie against one built turn by turn."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from broadsheet.llm import prefix_trie
from broadsheet.llm.common import written


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, size string")


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    base = lambda c: c - int(math.fmod(c, 100))  # noqa: E731  the sign of a remainder is that of the id, as in SQL
    return {c: own.get(base(c), [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


def expected(conversations):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, inside in members.items():
        own = (len(inside) - 1) * len(path[-1][1]) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += own
    return sorted(
        (
            min(inside),
            len(path),
            min(members[path[:-1]]) if path else None,
            len(inside),
            children[path],
            leaves[path],
            saved[path],
            hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
        )
        for path, inside in members.items()
    )


def result(nodes):
    return sorted(((tuple(r)) for r in nodes.collect()), key=lambda r: tuple((v is not None, v) for v in r))


def built(spark, rows, **options):
    turns = written(prefix_trie.ordered_turns(table(spark, rows)), "test-turns")
    return prefix_trie.prefix_trie(prefix_trie.with_shared_start(turns), **options)


def random_rows(rng, conversations, longest, words):
    rows = []
    for c in conversations:
        for turn in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", None, ""]), rng.choice(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    "seed, options",
    [
        (0, {}),
        (1, {"segment": 3}),
        (2, {"capacity": 5}),
        (3, {"segment": 2, "capacity": 4, "list_ids": 3}),
        (4, {"segment": 1, "capacity": 1, "list_ids": 1}),
    ],
)
def test_nodes_of_random_conversations(spark, seed, options):
    rng = random.Random(seed)
    ids = rng.sample(range(0, 450), 120) + [0, 100, 10**12, 10**12 + 7, -100, -130]
    rows = random_rows(rng, sorted(set(ids)), 9, ["", "a", "bé", None, "c" * 300])
    rows += [(None, 0, "user", "left out"), (101, 0, "user", "again"), (101, 0, "user", "again")]
    assert result(built(spark, rows, **options)) == result_of(expected(rebuilt(rows)))


def result_of(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("options", [{}, {"segment": 4, "capacity": 10, "list_ids": 7}])
def test_copies_common_starts_and_long_conversations(spark, options):
    rows = []
    for c in range(300, 330):  # copies
        rows += [(c, t, "user", f"same {t}") for t in range(7)]
    for c in range(400, 440):  # one common start, other ends
        rows += [(c, t, "user", f"start {t}") for t in range(9)] + [(c, 9, "user", f"end {c % 7}")]
    rows += [(500, t, "user", "x") for t in range(150)] + [(600, t, "user", "x") for t in range(149)]
    rows += [(701, 0, "user", "gone")]  # no base: what is left may have no turn
    assert result(built(spark, rows, **options)) == result_of(expected(rebuilt(rows)))


def test_empty_and_turnless(spark):
    assert built(spark, [(None, 1, "a", "b")]).count() == 0
    empty = [c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1][:3]
    rows = [(c, 0, "user", "only") for c in empty]
    assert result(built(spark, rows)) == result_of(expected(rebuilt(rows)))


def test_digests_of_blocks_equal_those_of_lists(spark):
    rows = [(k, i) for k in (1, 2) for i in random.Random(k).sample(range(10**6), 500 * k)]
    members = written(spark.createDataFrame(rows, "k long, conv_id long"), "test-members")
    one = sorted(map(tuple, prefix_trie.id_digests(members, ["k"]).collect()))
    assert one == sorted(map(tuple, prefix_trie.id_digests(members, ["k"], 7).collect()))
    text = ",".join(map(str, sorted(i for k, i in rows if k == 1)))
    assert one[0] == (1, hashlib.sha256(text.encode()).hexdigest())
