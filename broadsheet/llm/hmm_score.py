"""Hidden Markov language model: Baum-Welch over all training texts, exact scores by forward recursion.

The alphabet is the same at any size of the corpus: a word's symbol is made of
its last letters (``ENDINGS`` of them) and a hash of the word (``KINDS`` for each
ending), so that most words of a language have a symbol of their own and a word
never seen still tells by its ending.  Hidden states emit symbols; within a
symbol a word has the probability of its own count, one place kept for words
never seen.  So every text has a proper probability, and

    log10 P(text) = log10 P(symbols) + sum over words of log10 P(word | symbol).

The first term is the scaled forward recursion over the whole text.  For the
second, counts of words that make up at least one in ``HEAD_SHARE`` training
tokens (there cannot be more than ``HEAD_SHARE`` of them) go with the tasks, all
others come by a join, which no hot word enters.  Texts are split once: their
symbols are written as integers, and all Baum-Welch passes and the scores read
those.  Every partition adds up its expected counts, and Spark adds up the
partitions.  Only where the states start from is drawn from a bounded sample of
texts, as counts of the ``SEED_SYMBOLS`` most frequent symbols.

Defined results: a NULL text is empty and scored as the end token alone.  Rows
without an id are scored, not learned from and not held out.  Repeated rows
count and are scored each.  With no training rows every word is unseen.  An
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_words, map_batches, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATES = 8
PASSES = 2
HEAD_SHARE = 500_000
ENDINGS, ENDING_BYTES = 1024, 3
KINDS = 128
#: Symbol 0 is the end of a text, the others follow by ending and kind.
ALPHABET = 1 + ENDINGS * KINDS
#: The end of a text; no word can be this.
END = b"\n"
#: Texts the starting point is made from, about; and symbols it looks at.
SEED_TEXTS, SEED_SYMBOLS, SEED_ROUNDS = 1_500, 1_024, 20
#: Weight of the overall symbol shares in each state: in tokens, and as a share of the state's own.
PRIOR, MIXED_IN = 200.0, 0.03
STAY = 0.97
#: Distinct words a partition counts before it passes them on.
COUNT_WORDS = 300_000
#: Rows handled together; texts beyond LONG tokens go in lanes of their own.
ROWS, LONG = 2_000, 1_024
#: Symbols that a worker remembers by word.
KNOWN_WORDS = 200_000


def symbol(word: bytes) -> int:
    if word == END:
        return 0
    return 1 + zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS * KINDS + zlib.crc32(word) % KINDS


class Symbols(dict):
    """Symbols of words, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = symbol(word)
        return found


def symbol_of(word: str) -> Column:
    """``symbol`` as a column."""
    tail = F.substring(word, -ENDING_BYTES, ENDING_BYTES)
    of_word = 1 + F.crc32(tail) % ENDINGS * KINDS + F.crc32(word) % KINDS
    return F.when(F.col(word) == F.lit(END), 0).otherwise(of_word).cast("int")


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """``word, c`` over all texts, ends included."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        counts: Counter[bytes] = Counter()
        for columns in batches:
            for content in columns[text]:
                counts.update(lower_words(content))
                counts[END] += 1
            if len(counts) > COUNT_WORDS:
                yield {"word": list(counts), "c": list(counts.values())}
                counts = Counter()
        if counts:
            yield {"word": list(counts), "c": list(counts.values())}

    parts = map_batches(docs.select(text), run, "word binary, c long")
    return written(parts.groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")


@dataclass
class Vocabulary:
    """Counts of the training texts: of frequent words, of all tokens, and by symbol."""

    frequent: dict[bytes, int]
    tokens: int
    words: int
    symbol_tokens: np.ndarray
    symbol_words: np.ndarray


def is_frequent(tokens: int) -> Column:
    """Whether a row of the word counts goes with the tasks."""
    return F.col("c") * HEAD_SHARE >= F.lit(tokens)


def read_vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals by symbol and the frequent words: all of bounded size."""
    tokens, words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    rows = counts.where(is_frequent(tokens)).collect()  # at most HEAD_SHARE words
    totals = np.zeros((2, ALPHABET), np.int64)
    by_symbol = counts.groupBy(symbol_of("word").alias("at")).agg(F.sum("c").alias("c"), F.count("*").alias("n"))
    for r in by_symbol.collect():  # at most ALPHABET rows
        totals[:, r["at"]] = r["c"], r["n"]
    return Vocabulary({bytes(r["word"]): r["c"] for r in rows}, tokens, words, *totals)


def write_symbols(docs: DataFrame, learn_from: Column, text: str, vocabulary) -> DataFrame:
    """Every row with its symbols, what is known of its frequent words, and its other words with their counts.

    ``vocabulary`` is a broadcast variable.  Symbols are little-endian 32-bit
    integers, the end of the text among them; ``text`` is left out.
    """
    names = ("learn", "symbols", "n_tokens", "n_known", "log_known", "row", "rare")
    kept = [c for c in docs.columns if c != text and c not in names]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        frequent = vocabulary.value.frequent
        logs = {w: float(np.log10(c + 1.0)) for w, c in frequent.items()}
        known = Symbols()
        row = TaskContext.get().partitionId() << 33
        for columns in batches:
            out: dict[str, list] = {name: [] for name in names[1:-1]}
            rare_words, rare_counts, offsets = [], [], [0]
            for content in columns[text]:
                words = lower_words(content)
                words.append(END)
                sure, parts = 0, []
                for word, n in Counter(words).items():
                    log = logs.get(word)
                    if log is None:
                        rare_words.append(word)
                        rare_counts.append(n)
                    else:
                        sure += n
                        parts.append(log * n)
                row += 1
                out["symbols"].append(np.fromiter(map(known.__getitem__, words), "<i4", len(words)).tobytes())
                out["n_tokens"].append(len(words))
                out["n_known"].append(sure)
                # Rounded once, so that equal texts get equal sums.
                out["log_known"].append(math.fsum(parts))
                out["row"].append(row)
                offsets.append(len(rare_words))
                if len(known) > KNOWN_WORDS:
                    known.clear()
            rare_column = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()),
                pa.StructArray.from_arrays(
                    [pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int32())], names=["word", "n"]
                ),
            )
            yield {**{c: columns[c] for c in kept}, "learn": columns["learn"], **out, "rare": rare_column}

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    flagged = docs.select(*kept, F.coalesce(learn_from, F.lit(False)).alias("learn"), text)
    return written(
        map_batches(
            flagged,
            run,
            f"{schema}learn boolean, symbols binary, n_tokens long, n_known long, log_known double, row long, "
            "rare array<struct<word: binary, n: int>>",
            ROWS,
        ),
        "lm-symbols",
    )


def unpacked(symbols: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(s, "<i4") for s in symbols]


@dataclass
class Model:
    """Start, transition and emission probabilities; ``emit`` has a row per symbol."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def overall_shares(vocabulary: Vocabulary) -> np.ndarray:
    """Shares of the symbols when every word, and one unseen word per symbol, counts once more."""
    counts = vocabulary.symbol_tokens + vocabulary.symbol_words + 1.0
    return counts / counts.sum()


def endings_of(values: np.ndarray) -> np.ndarray:
    """Sums by ending of one row per symbol, repeated for every kind; the end of a text is an ending of its own."""
    sums = values[1:].reshape(ENDINGS, KINDS, -1).sum(axis=1)
    return np.vstack([values[:1], np.repeat(sums, KINDS, axis=0)])


def seed_model(texts: np.ndarray, top: np.ndarray, shares: np.ndarray, states: int = STATES) -> Model:
    """States that start as a mixture of whole texts, given as counts of the symbols ``top``."""
    base = shares[top]
    emit = np.repeat(base[None, :], states, axis=0)
    weight = np.full(states, 1.0 / states)
    if len(texts) >= states:
        # Seeds far from one another: each next one is the text least explained so far.
        unit = np.sqrt(texts / np.maximum(1.0, texts.sum(axis=1, keepdims=True)))
        chosen = [int(np.argmax(texts.sum(axis=1)))]
        for _ in range(1, states):
            closeness = (unit @ unit[chosen].T).max(axis=1)
            long_enough = texts.sum(axis=1) >= np.median(texts.sum(axis=1))
            chosen.append(int(np.argmin(np.where(long_enough, closeness, np.inf))))
        emit = (texts[chosen] + 20.0 * base * 10) / (texts[chosen].sum(axis=1, keepdims=True) + 200.0 * base.sum())
        for _ in range(SEED_ROUNDS):
            scores = texts @ np.log(emit).T + np.log(weight)
            scores = np.exp(np.minimum(0.0, scores - scores.max(axis=1, keepdims=True)))
            belong = scores / scores.sum(axis=1, keepdims=True)
            weight = (belong.sum(axis=0) + 1.0) / (len(texts) + states)
            counts = belong.T @ texts + PRIOR * base
            emit = counts / counts.sum(axis=1, keepdims=True)
    full = np.repeat(shares[:, None], states, axis=1)
    full[top] = emit.T * base.sum()
    move = np.full((states, states), (1.0 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Model(weight, move, full / full.sum(axis=0))


class Lanes:
    """Texts laid one after the other in lanes, so that a step moves all lanes at once."""

    def __init__(self, texts: list[np.ndarray], pad: int):
        lengths = np.array([len(t) for t in texts])
        width = max(1, min(len(texts), int(lengths.sum() // lengths.max())))
        ends = [(0, lane) for lane in range(width)]
        place = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for i in np.argsort(-lengths, kind="stable"):
            at, lane = heapq.heappop(ends)
            place[0][i], place[1][i] = at, lane
            heapq.heappush(ends, (at + int(lengths[i]), lane))
        steps = max(at for at, _ in ends)
        self.symbols = np.full((steps, width), pad, np.int64)
        self.text = np.full((steps, width), len(texts), np.int64)
        self.begins = np.zeros((steps, width), bool)
        for i, symbols in enumerate(texts):
            at, lane = place[0][i], place[1][i]
            self.symbols[at : at + len(symbols), lane] = symbols
            self.text[at : at + len(symbols), lane] = i
            self.begins[at, lane] = True
        self.inside = self.text < len(texts)


def forward(lanes: Lanes, model: Model, emit: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Scale factors of every step, and the scaled forward vectors if asked for."""
    steps, width = lanes.symbols.shape
    scale = np.empty((steps, width))
    kept = np.empty((steps, width, len(model.start)), np.float32) if keep else None
    start, move = model.start.astype(emit.dtype), model.move.astype(emit.dtype)
    state = np.repeat(start[None, :], width, axis=0)
    any_begin = lanes.begins.any(axis=1)
    for t in range(steps):
        state = state @ move
        if any_begin[t]:
            state[lanes.begins[t]] = start
        state *= emit[lanes.symbols[t]]
        total = state.sum(axis=1)
        state /= total[:, None]
        scale[t] = total
        if keep:
            kept[t] = state
    return scale, kept


def log10_of_texts(texts: list[np.ndarray], model: Model, emit: np.ndarray) -> np.ndarray:
    """log10 P(symbols) of each text."""
    result = np.zeros(len(texts))
    for long_ones in (False, True):
        chosen = [i for i, t in enumerate(texts) if (len(t) > LONG) == long_ones]
        if chosen:
            lanes = Lanes([texts[i] for i in chosen], len(emit) - 1)
            scale, _ = forward(lanes, model, emit, keep=False)
            sums = np.bincount(lanes.text[lanes.inside], np.log10(scale[lanes.inside]), minlength=len(chosen))
            result[chosen] = sums
    return result


def expected_counts(texts: list[np.ndarray], model: Model, emit: np.ndarray, out: dict[str, np.ndarray]) -> None:
    """Add the expected starts, moves and emissions of the texts to ``out``."""
    states = len(model.start)
    for long_ones in (False, True):
        chosen = [t for t in texts if (len(t) > LONG) == long_ones]
        if not chosen:
            continue
        lanes = Lanes(chosen, len(emit) - 1)
        scale, kept = forward(lanes, model, emit, keep=True)
        out["log"] += np.log10(scale[lanes.inside], dtype=np.float64).sum()
        steps, width = lanes.symbols.shape
        after = np.ones((width, states), emit.dtype)
        moved = np.zeros((states, states))
        ends_here = ~lanes.inside | lanes.begins
        back = np.ascontiguousarray(model.move.T.astype(emit.dtype))
        for t in range(steps - 1, -1, -1):
            incoming = emit[lanes.symbols[t]]
            incoming *= after
            incoming /= scale[t][:, None]
            kept[t] *= after
            incoming[ends_here[t]] = 0.0
            if t:
                moved += kept[t - 1].T @ incoming
            after = incoming @ back
            after[ends_here[t]] = 1.0
        out["move"] += moved * model.move
        out["start"] += kept[lanes.begins].sum(axis=0)
        symbols = lanes.symbols[lanes.inside]
        gamma = kept[lanes.inside]
        for k in range(states):
            out["emit"][:, k] += np.bincount(symbols, gamma[:, k], minlength=len(emit) - 1)


def padded(model: Model) -> np.ndarray:
    """Emissions with a last row for unfilled lane places."""
    return np.vstack([model.emit, np.ones((1, model.emit.shape[1]))])


def baum_welch_pass(coded: DataFrame, model: Model, shares: np.ndarray) -> tuple[Model, float]:
    """One re-estimation over all rows of ``coded``, and log10 P of their symbols under ``model``."""
    states, size = len(model.start), len(model.emit)
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        now = shared.value
        emit = padded(now).astype(np.float32)
        out = {
            "start": np.zeros(states), "move": np.zeros((states, states)), "emit": np.zeros((size, states)), "log": np.zeros(1),
        }
        for columns in batches:
            expected_counts(unpacked(columns["symbols"]), now, emit, out)
        seen = np.flatnonzero(out["emit"].sum(axis=1))
        rows = np.vstack([np.repeat(out["log"], states), out["start"], out["move"], out["emit"][seen]])
        names = np.concatenate([np.arange(-2 - states, 0), seen])
        if out["start"].sum():
            yield {"symbol": names.tolist()} | {f"s{k}": rows[:, k].tolist() for k in range(states)}

    columns = [f"s{k}" for k in range(states)]
    parts = map_batches(coded.select("symbols"), run, "symbol int, " + ", ".join(f"{c} double" for c in columns), ROWS)
    # One row per symbol: the alphabet is bounded.
    summed = parts.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    start, move, emit, log = np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), 0.0
    for row in summed:
        values, at = row[1:], row["symbol"]
        if at >= 0:
            emit[at] = values
        elif at == -2 - states:
            log = values[0]
        elif at == -1 - states:
            start[:] = values
        else:
            move[at + states] = values
    # A state is smoothed by the shares of all texts, half of it in the way of its own endings.
    weight = PRIOR + MIXED_IN * emit.sum(axis=0)
    own = endings_of(emit + PRIOR * shares[:, None]) * (shares / endings_of(shares[:, None])[:, 0])[:, None]
    emit += weight * 0.5 * (shares[:, None] + own / own.sum(axis=0))
    stay = PRIOR * model.move / len(move)
    better = Model(
        (start + 1.0) / (start.sum() + states),
        (move + stay) / (move + stay).sum(axis=1, keepdims=True),
        emit / emit.sum(axis=0),
    )
    return better, log


def seed_counts(coded: DataFrame, order: str, top: np.ndarray, texts: int) -> np.ndarray:
    """Counts of the symbols ``top`` in about ``SEED_TEXTS`` of the rows, in the order of column ``order``."""
    draw = F.pmod(F.xxhash64(order, F.lit("seed texts")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    size = len(top)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        place = np.full(ALPHABET, size)
        place[top] = np.arange(size)
        for columns in batches:
            counts = [np.bincount(place[s], minlength=size + 1)[:size] for s in unpacked(columns["symbols"])]
            yield {"at": columns[order], "counts": [c.astype("<i4").tobytes() for c in counts]}

    kind = coded.schema[order].dataType.simpleString()
    chosen = coded.where(draw < SEED_TEXTS / max(1, texts)).select(order, "symbols")
    rows = map_batches(chosen, run, f"at {kind}, counts binary").collect()  # about SEED_TEXTS rows of 4 KB
    rows.sort(key=lambda r: (str(r["at"]), bytes(r["counts"])))
    return np.array([np.frombuffer(r["counts"], "<i4") for r in rows], float).reshape(len(rows), size)


def train(coded: DataFrame, vocabulary: Vocabulary, doc_id: str, states: int = STATES, passes: int = PASSES):
    """The model of the rows to learn from, and log10 P of their symbols before each pass."""
    learned = coded.where("learn")
    shares = overall_shares(vocabulary)
    texts = int(vocabulary.symbol_tokens[0])
    top = np.argsort(-vocabulary.symbol_tokens, kind="stable")[:SEED_SYMBOLS]
    model = seed_model(seed_counts(learned, doc_id, top, texts), top, shares, states)
    logs = []
    for _ in range(passes if texts else 0):
        model, log = baum_welch_pass(learned, model, shares)
        logs.append(log)
    return model, logs


def score(
    docs: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", states: int = STATES, passes: int = PASSES
) -> DataFrame:
    """Scores of all ``docs`` by a model of those where ``learn_from`` holds.

    Returns ``doc_id, n_tokens, n_known, train_tokens, base_score, score``
    and the columns of ``docs`` besides ``text``.
    """
    context = docs.sparkSession.sparkContext
    counts = count_words(docs.where(F.coalesce(learn_from, F.lit(False))), text)
    vocabulary = read_vocabulary(counts)
    coded = write_symbols(docs, learn_from, text, context.broadcast(vocabulary))
    model, _ = train(coded, vocabulary, doc_id, states, passes)
    tokens, words = vocabulary.tokens, vocabulary.words
    # P(word | symbol) is its count and one over this; the end of a text is all of its symbol.
    within = np.log10(vocabulary.symbol_tokens + vocabulary.symbol_words + 1.0)
    within[0] = np.log10(vocabulary.symbol_tokens[0] + 1.0)
    shared = context.broadcast((model, within))
    mine = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = [c for c in docs.columns if c != text and c not in mine]
    passed = [*kept, "n_tokens", "n_known", "log_known", "row", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = shared.value
        emit = padded(now)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                texts = unpacked(rows.column("symbols").to_pylist())
                scores = log10_of_texts(texts, now, emit) - np.array([parts[s].sum() for s in texts])
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in passed], pa.array(scores)], names=[*passed, "log_symbols"]
                )

    schema = ", ".join(f"`{c}` {coded.schema[c].dataType.simpleString()}" for c in passed)
    scored = written(
        coded.select(*passed, "symbols").mapInArrow(run, f"{schema}, log_symbols double"), "lm-scored"
    )
    # No rare word is a hot key: it makes up less than one in HEAD_SHARE tokens.
    rare = scored.select("row", F.explode("rare").alias("_rare")).select("row", "_rare.word", "_rare.n")
    added = (
        rare.join(counts.where(~is_frequent(tokens)), "word")
        .groupBy("row")
        .agg(F.sum("n").alias("_n"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("_log"))
    )
    logs = F.col("log_known") + F.coalesce("_log", F.lit(0.0))
    return scored.drop("rare").join(added, "row", "left").select(
        *kept,
        "n_tokens",
        (F.col("n_known") + F.coalesce("_n", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(float(tokens + words + 1)))).alias("base_score"),
        (F.col("log_symbols") + logs).alias("score"),
    )
