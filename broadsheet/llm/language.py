"""Language identification in two steps: the family, then one-versus-one linear SVMs within it.

Features are character n-grams (lengths 1 to 3) of the whole text in lower
case, hashed to a vector of ``DIMENSIONS`` square-rooted shares of length 1.
A classifier is trained for every pair of families and for every pair of
languages of a family, each in a Spark task of its own, on a sample bounded by
``SAMPLE_PER_LANGUAGE`` rows a language (a binomial draw by the hash of the id).
A text goes to the family, then to the language, that wins most of its
pairs; margins decide between equal wins.

Defined results: rows without a language, or without an id, are not learned
from.  A text that is NULL or has no letter is ``und`` with score 0, and so
is every text when nothing was learned.  With one learned language every other
text is of that language, with score 1.  Repeated rows get equal results.  An
empty table gives no rows.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS = 2048
#: Rows a language is learned from, about.
SAMPLE_PER_LANGUAGE = 1_000
#: Code points of one text that are turned into n-grams at a time; the sums of all pieces count.
PIECE_CHARS = 1 << 18
#: Rows of a classifier's sample that are turned into 64-bit numbers at a time.
BLOCK_ROWS = 64
UNDETERMINED = "und"
#: Texts of a lower score count as unidentified when rows are filtered.
LEAST_SCORE = 0.2
#: Families by language code.  Languages that are not listed form one family, "other".
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
_LETTER = re.compile(r"[^\W\d_]")


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), "other")


def ngram_vector(text: str) -> np.ndarray:
    """The hashed n-gram shares of a whole text."""
    total = np.zeros(DIMENSIONS, np.float64)
    lowered = text.lower()
    for start in range(0, max(1, len(lowered)), PIECE_CHARS):
        # Two code points more, so that every n-gram is in some piece.
        codes = np.frombuffer(
            lowered[start : start + PIECE_CHARS + 2].encode("utf-32-le", "surrogatepass"), np.uint32
        ).astype(np.uint32)
        inside = min(PIECE_CHARS, len(lowered) - start)
        with np.errstate(over="ignore"):
            grams = codes * np.uint32(0x9E3779B1)
            total += np.bincount((grams[:inside] >> np.uint32(21)) % DIMENSIONS, minlength=DIMENSIONS)
            for n in (1, 2):
                if len(codes) <= n:
                    break
                grams = (grams[:-1] * np.uint32(0x85EBCA6B)) ^ (codes[n:] * np.uint32(0xC2B2AE35) + np.uint32(n))
                mixed = grams ^ (grams >> np.uint32(15))
                total += np.bincount(
                    ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(21))[:inside] % DIMENSIONS, minlength=DIMENSIONS
                )
    vector = np.sqrt(total)
    norm = np.linalg.norm(vector)
    return (vector / norm if norm else vector).astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights and bias of a linear SVM (squared hinge loss), by accelerated gradient steps.

    ``x`` stays as it is; each step goes over it in blocks, so that only one
    block at a time is there in 64 bits.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    rate = 1.0 / (4.0 + penalty)  # rows with their bias have squared length 2, shares sum to 1
    buffer = np.empty((min(BLOCK_ROWS, len(x)), x.shape[1]), np.float64)
    weights, ahead, t = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), 1.0
    for _ in range(steps):
        gradient = penalty * ahead
        for start in range(0, len(x), BLOCK_ROWS):
            at = slice(start, start + BLOCK_ROWS)
            rows = buffer[: len(x[at])]
            rows[:] = x[at]
            slack = np.maximum(0.0, 1.0 - y[at] * (rows @ ahead[:-1] + ahead[-1]))
            pull = 2.0 * share[at] * slack * y[at]
            gradient[:-1] -= pull @ rows
            gradient[-1] -= pull.sum()
        new = ahead - rate * gradient
        t_new = (1.0 + np.sqrt(1.0 + 4.0 * t * t)) / 2.0
        ahead = new + (t - 1.0) / t_new * (new - weights)
        weights, t = new, t_new
    return weights


def tasks_of(langs: Sequence[str]) -> list[tuple[str, str, str]]:
    """``(kind, negative, positive)`` for all pairs of families, and of languages of one family."""
    families = sorted({family_of(lang) for lang in langs})
    pairs = [("family", a, b) for a, b in combinations(families, 2)]
    for family in families:
        members = sorted(lang for lang in langs if family_of(lang) == family)
        pairs += [("language", a, b) for a, b in combinations(members, 2)]
    return pairs


Model = dict[tuple[str, str, str], np.ndarray]


def train(
    docs: DataFrame,
    learn_from: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_per_language: int = SAMPLE_PER_LANGUAGE,
) -> tuple[list[str], Model]:
    """The learned languages and a weight vector per pair."""
    known = docs.where(F.col(lang).isNotNull() & learn_from & F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    langs = sorted(counts)
    pairs = tasks_of(langs)
    if not pairs:
        return langs, {}
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, min(1.0, sample_per_language / counts[k]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.where(draw < F.element_at(share, F.col("lang")))

    def features(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            out = []
            for content, code in zip(columns["text"], columns["lang"]):
                if not _LETTER.search(content):
                    continue
                vector = ngram_vector(content).astype(np.float16).tobytes()
                for task, (kind, a, b) in enumerate(pairs):
                    label = family_of(code) if kind == "family" else code
                    if label in (a, b):
                        out.append((task, 1 if label == b else -1, vector))
            if out:
                yield dict(zip(("task", "label", "vector"), zip(*out)))

    def fit(rows: pa.Table) -> pa.Table:
        # A fixed order of rows gives the same sums in every run.
        order = pc.sort_indices(rows, [("label", "ascending"), ("vector", "ascending")]).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        x = np.empty((len(order), DIMENSIONS), np.float32)
        for at, vector in zip(place, rows["vector"]):
            x[at] = np.frombuffer(vector.as_buffer(), np.float16)
        weights = fit_svm(x, rows["label"].to_numpy()[order].astype(np.float64))
        return pa.table({"task": rows["task"][:1], "weights": pa.array([weights], pa.list_(pa.float64()))})

    fitted = (
        map_batches(sample, features, "task int, label int, vector binary")
        .groupBy("task")
        .applyInArrow(fit, "task int, weights array<double>")
        .collect()  # one vector per pair of labels
    )
    return langs, {pairs[r["task"]]: np.asarray(r["weights"], np.float64) for r in fitted}


def vote(labels: Sequence[str], kind: str, model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the label with most pair wins for each row, and a confidence from 0 to 1."""
    rows = len(x)
    if len(labels) == 1:
        return np.zeros(rows, int), np.ones(rows)
    wins, margins = np.zeros((rows, len(labels))), np.zeros((rows, len(labels)))
    least = np.full((rows, len(labels)), np.inf)
    for i, j in combinations(range(len(labels)), 2):
        weights = model.get((kind, labels[i], labels[j]))
        margin = x @ weights[:-1] + weights[-1] if weights is not None else np.zeros(rows)
        wins[:, j] += margin > 0
        wins[:, i] += margin <= 0
        margins[:, j] += np.tanh(margin)
        margins[:, i] -= np.tanh(margin)
        least[:, j] = np.minimum(least[:, j], margin)
        least[:, i] = np.minimum(least[:, i], -margin)
    best = np.argmax(wins + margins / (4.0 * len(labels)), axis=1)
    return best, 1.0 / (1.0 + np.exp(-3.0 * least[np.arange(rows), best]))


def predict(docs: DataFrame, langs: list[str], model: Model, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of that name are replaced.

    The text comes back only with ``keep_text``.  The work is done in the scan
    stage; nothing is shuffled.
    """
    families = sorted({family_of(lang) for lang in langs})
    members = [sorted(lang for lang in langs if family_of(lang) == family) for family in families]
    kept = [c for c in docs.columns if c not in ("lang_pred", "score") and (keep_text or c != text)]
    # The model goes out once for each executor.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for columns in batches:
            texts = columns[text]
            there = [i for i, t in enumerate(texts) if langs and t is not None and _LETTER.search(t)]
            predicted, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if there:
                x = np.stack([ngram_vector(texts[i]) for i in there]).astype(np.float64)
                family, sure = vote(families, "family", shared.value, x)
                for f, labels in enumerate(members):
                    here = np.flatnonzero(family == f)
                    if len(here):
                        best, within = vote(labels, "language", shared.value, x[here])
                        for at, label, p, q in zip(here, best, sure[here], within):
                            predicted[there[at]] = labels[label]
                            scores[there[at]] = float(p * q)
            yield {**{c: columns[c] for c in kept}, "lang_pred": predicted, "score": scores}

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    needed = kept if keep_text else [*kept, text]
    return map_batches(docs.select(*needed), run, f"{schema}lang_pred string, score double")


def keep_identified(
    docs: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` whose language was found: not ``und``, and not below ``LEAST_SCORE``."""
    langs, model = train(docs, learn_from, doc_id, text, lang)
    judged = predict(docs, langs, model, text, keep_text=True)
    return judged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)
