"""The pipeline against a plain version, and odd tables through every stage."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from test_native import plain_line_dedup, water_level
from test_tasks import invented, plain_near

import corpus_pipeline
from broadsheet.llm import mixing
from broadsheet.llm.queries import tokenizer_files
from broadsheet.session import ARROW_BYTES

LANGS = ["en", "de", "fr", "es"]


def corpus():
    rng = random.Random(9)
    rows = []
    shared = [invented("en", rng, 60) for _ in range(3)]
    for i in range(120):
        lang = LANGS[i % 4]
        lines = [invented(lang, rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 6))]
        if i % 6 == 0:
            lines.insert(rng.randrange(len(lines) + 1), shared[i % 3])
        rows.append((i, "\n".join(lines), lang, f"src{i % 5}" if i % 11 else None))
    for i in range(120, 150):
        # Near copies on one line each, with one word changed, and exact ones.
        words = rows[i - 120][1].replace("\n", " ").split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words) if i % 3 else rows[i - 120][1], rows[i - 120][2], "src1"))
    rows += [(900, None, "en", "src2"), (901, "", "fr", "src2"), (902, "12 34", None, "src3"), (903, "a", "en", "src3")]
    return rows


def plain_copies(rows):
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(text.encode().split())
    targets = water_level(sizes)
    copies = Counter()
    for doc_id, text, _, source in rows:
        rate = targets[source] / sizes[source] if sizes[source] else 0.0
        draw = int(hashlib.md5(f"{mixing.SEED}:{doc_id}".encode()).hexdigest()[:13], 16) / 16**13
        copies[doc_id] += int(rate) + (draw < rate - int(rate))
    return copies


def test_pipeline_against_plain_stages(spark, docs_of, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    docs_of(rows).drop("size").write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()

    identified = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    cut = dict(plain_line_dedup([(r[0], r[1]) for r in identified]))
    lined = [(r[0], cut[r[0]], *r[2:]) for r in identified if cut[r[0]].split() or not r[1].split()]
    kept = {r[0] for r in plain_near([(r[0], r[1]) for r in lined]) if r[3]}
    assert len(identified) > len(lined) > len(kept) > 100
    distinct = [r for r in lined if r[0] in kept]
    copies = plain_copies(distinct)

    whole = Tokenizer.from_file(tokenizer_files()["tokenizer_path"])
    wanted = Counter()
    for doc_id, text, *_ in distinct:
        ids = [*whole.encode(text, add_special_tokens=False).ids, 0]
        assert len(ids) <= 2048
        wanted[doc_id, 0, 0, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())] += copies[doc_id]
    found = Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces)
    assert found == +wanted
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for places in sequences.values():
        ends = [0, *(o + n for o, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 2048
    assert len(sequences) <= -(-sum(p["length"] for p in pieces) // 2048) + 1


def test_stages_keep_columns_and_take_empty_tables(spark, docs_of, tmp_path):
    empty = docs_of([])
    odd = docs_of([(None, "some words of a text here now", None, None), (1, None), (1, None), (2, "x y z"), (2, "x y z")])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
        result = stage(spark, odd, str(tmp_path))
        assert result.count() >= 0
        if name != "pack":
            assert result.columns == odd.columns


def test_near_duplicates_go_by_row_not_by_id(spark, docs_of, tmp_path):
    a, b, c, d = (" ".join(f"{name}{i}" for i in range(30)) for name in "abcd")
    made = [(3, a), (5, a), (5, b), (6, b), (7, b), (None, a), (None, c), (None, c), (8, d), (8, d), (9, None), (9, None), (None, "")]
    left = corpus_pipeline.drop_near_duplicates(spark, docs_of(made), str(tmp_path))
    found = Counter((r["doc_id"], r["text"]) for r in left.collect())
    assert found == Counter([(3, a), (5, b), (None, c), (8, d), (9, None), (9, None), (None, "")])


def test_texts_go_to_python_in_bounded_batches(spark, docs_of, tmp_path):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    texts = spark.range(0, 6_000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 4000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    try:
        for stage in (corpus_pipeline.identify_language, corpus_pipeline.drop_near_duplicates, corpus_pipeline.pack_sequences):
            spark.conf.unset(name)
            stage(spark, docs_of([(1, "a few words")]), str(tmp_path))
            found = [r["size"] for r in texts.mapInArrow(sizes, "size long").collect()]
            assert len(found) > 1 and max(found) < ARROW_BYTES + 100_000 and sum(found) > 24_000_000
            spark.conf.set(name, 1_000)  # a lower bound of the session's own stays
            stage(spark, docs_of([(1, "a few words")]), str(tmp_path))
            assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, before)
