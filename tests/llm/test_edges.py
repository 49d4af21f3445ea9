"""Nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import time
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import chat, edits, jaccard, leaks, licenses, lines, merkle, mixing, periods, privacy, store, tokens, toxicity, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
ROWS = [
    (1, "one two three four five six\nseven\neight\nnine", "en", "a", 1),
    (1, "one two three four five six\nseven\neight\nnine", "en", "a", 1),
    (2, "one two three four five six\nseven\neight\nnine", None, None, None),
    (3, None, "en", "a", 1),
    (4, "", "en", "b", 1),
    (5, " \n\t ", "en", "b", 1),
    (None, "nobody wrote this text at all", "en", "b", 1),
    (None, None, None, None, None),
    (6, LONG, "en", "b", 1),
    (7, "x" * 100_000, "en", None, 1),
]
CLASHING = ["n_lines", "key", "node", "at", "size", "_text_hash", "spans", "n_words", "target", "toxic", "score", "part", "chunk", "item_id", "tree", "i", "block", "place", "path", "leaf", "root", "tie", "lent", "fingerprint", "comp", "h", "g", "runs", "best"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 0, 1), (6, 1, None), (7, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "seven eight nine"), (2, None), (None, "one two three four five six seven eight nine")], "item_id long, text string")


OPERATORS = {
    "jaccard": lambda d, labels, bench: jaccard.jaccard_components(d),
    "toxicity": lambda d, labels, bench: toxicity.toxicity_scores(d, labels),
    "tokens": lambda d, labels, bench: tokens.token_counts(d),
    "licenses": lambda d, labels, bench: licenses.license_summary(d),
    "lines": lambda d, labels, bench: lines.dedup_lines(d),
    "mixing": lambda d, labels, bench: mixing.taken_words(d),
    "privacy": lambda d, labels, bench: privacy.personal_data_summary(d),
    "merkle": lambda d, labels, bench: merkle.manifest_check(d),
    "edits": lambda d, labels, bench: edits.edit_summary(d),
    "near_copies": lambda d, labels, bench: edits.near_copies(d),
    "periods": lambda d, labels, bench: periods.run_summary(d),
    "sanitised": lambda d, labels, bench: privacy.sanitised(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edges(spark, labels, bench, name):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASHING:
        df = df.withColumn(c, F.lit("clash"))
    got = OPERATORS[name](df, labels, bench).collect()
    assert len(got) == len(ROWS)
    twice = [tuple(r) for r in got if r.doc_id == 1]
    assert len(twice) == 2 and (name in ("mixing", "merkle", "edits") or twice[0] == twice[1])
    empty = OPERATORS[name](spark.createDataFrame([], SCHEMA), labels, bench)
    assert empty.collect() == [] and empty.columns


def test_values_at_the_edges(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()]
    assert sorted(found, key=str) == sorted([(1, 5, 1), (1, 5, 1), (2, 5, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (None, 2, None), (None, 0, None), (6, 997, 6), (7, 1, 7)], key=str)
    cleaned = {(r.doc_id, r.n_lines): (r.n_removed, r.text) for r in lines.dedup_lines(df).collect()}
    assert cleaned[2, 4] == (4, "") and cleaned[1, 4][0] == 0 and cleaned[3, 0] == (0, None) and cleaned[4, 1] == (0, "")
    assert {r.doc_id for r in jaccard.jaccard_join(df).collect()} == {1, 3, 4, 5, 6, 7, None}


def test_leaks_at_the_edges(spark, bench):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("item_id", F.lit(5))
    found = sorted(((r.doc_id, r.item_id) for r in leaks.leaks(df, bench.withColumn("doc_id", F.lit(1))).collect()), key=str)
    assert found == sorted([(i, k) for i in (1, 1, 2) for k in (1, None)], key=str)
    assert leaks.leaks(df, bench.limit(0)).collect() == [] and leaks.leaks(df.limit(0), bench).collect() == []
    kept = leaks.decontaminate(df, bench)
    assert kept.columns == df.columns and kept.count() == len(ROWS) - 3


def test_vectors_at_the_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, node string"
    rows = [(1, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"), (None, [1.0, 0.01], 1, "x"), (None, None, None, None), (5, [0.0, 1.0], None, "x"), (None, [5.0, -3.0], 2, "x")]
    got = sorted((tuple(r) for r in vectors.vector_components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 0, None, False), (5, 0, 5, True), (None, 0, None, False)], key=str)
    assert vectors.vector_components(spark.createDataFrame([], schema)).collect() == []


def test_chat_at_the_edges(spark):
    schema = "conv_id long, turn long, role string, text string, key string, place long"
    rows = [(1, None, None, None, "k", 1), (1, None, None, None, "k", 1), (None, 1, "system", "s", "k", 1), (2, 5, "assistant", "", "k", 1)]
    got = chat.repaired(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.conv_id or 0, r.new_role, r.action, r.inserted) for r in got) == [
        (0, "system", "keep", ""),
        # Both repairs cost two names; the one with the lowest last state is taken.
        (1, "system", "relabel", ""),
        (1, "user", "relabel", ""),
        (2, "assistant", "keep", "user"),
    ]
    assert [r.rendered for r in got if r.conv_id is None] == ["<|system|>\ns\n<|end|>\n<|user|>\n<|end|>\n"]
    assert chat.repaired(spark.createDataFrame([], schema)).collect() == []


def test_pipeline_stages(spark, tmp_path, labels, bench):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns and out.count() <= docs.count()
    assert corpus_pipeline.STAGES[0][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages_pass_clashing_columns_through(spark, tmp_path, labels, bench):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("n_lines", "n_removed", "score", "predicted", "item_id", "component_id", "toxic"):
        docs = docs.withColumn(c, F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert {v for r in out.select(*docs.columns[5:]).collect() for v in r} == {"clash"}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(ROWS)


def test_pipeline_keeps_one_of_a_group_and_clean_documents(spark, tmp_path):
    clean = [(i, " ".join(f"c{i}w{k}" for k in range(40)), "en", "ab"[i % 2], 1) for i in range(20)]
    passage = " ".join(f"p{k}" for k in range(30))
    copies = [(100 + i, " ".join(f"g{k}" if (k + i) % 50 else "edit" for k in range(60)), "en", "a", 1) for i in range(5)]
    leaked = [(200, "before it " + passage + " after it", "en", "b", 1)]
    spark.createDataFrame(clean + copies + leaked, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {r[0] for r in clean} | {100}


def test_a_long_item_costs_short_ones_nothing():
    # Term 0 is the text's and no item's; 100 items of 10 words lie in its direction, the first passage of one of 4,000 in the other.
    own = [[k] * 10 for k in range(1, 101)] + [list(range(101, 4101))]
    terms = np.arange(1, 4102, dtype=np.uint64)
    vectors = np.zeros((len(terms), 2), np.float32)
    vectors[:101, 0] = vectors[101 : 101 + leaks.PASSAGE, 1] = 1
    queries = np.array([[1, 0]] * 100 + [[0, 1]], np.float32)
    items = leaks.Items(terms, list(range(101)), [terms[x] for x in own], np.ones(len(terms)), vectors, queries, list(range(101)), [0] * 101)
    words = np.append(np.ones(1000 * leaks.STRIDE, items.code), np.arange(102, 4102).astype(items.code))
    batch = pa.record_batch([pa.array([7]), pa.array([words.tobytes()], pa.binary())], names=["doc_id", "terms"])
    begin = time.process_time()
    found = [r for out in leaks._searcher(SimpleNamespace(value=vars(items)))(iter([batch])) for r in out.to_pylist()]
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in found] == [(7, 100, 1.0)]
    assert time.process_time() - begin < 2


def test_counting_words_holds_one_joined_column_at_a_time():
    words = np.random.default_rng(3).integers(0, 1 << 20, 1_200_000)
    texts = [" ".join(map("w{:x}".format, part.tolist())) for part in np.split(words, 400)]
    batches = pa.table({"text": texts, "toxic": pa.array([1, 0] * 200, pa.int32())}).to_batches(max_chunksize=50)
    tracemalloc.start()
    rows = list(toxicity._counter(8)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(r.num_rows for r in rows) and peak < 200 << 20, peak


def test_toxicity_tasks_find_words_and_add_them_up_in_small_parts():
    words = np.random.default_rng(3).integers(0, 1 << 20, 1_200_000)
    texts = [" ".join(map("w{:x}".format, part.tolist())) for part in np.split(words, 400)]
    batches = pa.table({"text": texts, "toxic": pa.array([1, 0] * 200, pa.int32())}).to_batches()
    tracemalloc.start()
    held = [Counter() for _ in range(2)]
    for out in toxicity._counter(8)(iter(batches)):
        for row in out.to_pylist():
            for k, (keys, counts) in enumerate((("words", "word_counts"), ("after", "pair_counts"))):
                n = len(row[keys]) // 8
                held[k].update(total=int(toxicity._unpacked(row[counts], np.uint32, 2 * n).sum()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [h["total"] for h in held] == [1_200_000, 1_200_000 - 400]
    assert peak < 100 << 20, peak


def test_leaks_tasks_find_words_in_small_parts():
    texts = [" ".join(f"w{(i * 7919 + k) % 30011}" for k in range(400)) for i in range(1500)]
    batch = pa.record_batch([pa.array(range(1500), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    items = leaks.read_items([SimpleNamespace(item_id=1, text="w5 w6 w7 and some others"), SimpleNamespace(item_id=2, text=None)])
    tracemalloc.start()
    got = 0
    for out in leaks._encoder(SimpleNamespace(value=vars(items)))(iter([batch])):
        for row in out.to_pylist():
            codes = np.frombuffer(row["terms"], items.code)
            assert len(codes) == 400
            got += int((codes > 0).sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == sum(t.split().count(f"w{k}") for t in texts for k in (5, 6, 7))
    assert peak < 50 << 20, peak


def test_texts_go_to_python_in_small_batches(spark, bench, monkeypatch):
    """Steps that hand out whole texts or sets do so in small batches, and no Python list takes part in what they return."""
    asked, before = {}, spark.conf.get(store.BATCH_CONF)
    for operator in (leaks, jaccard, toxicity):
        def keep(df, name, kept=operator.kept):
            asked[name] = int(spark.conf.get(store.BATCH_CONF))
            return kept(df, name)

        monkeypatch.setattr(operator, "kept", keep)
    docs = spark.createDataFrame([(i, f"{LONG[: 300 + i % 7]} bad{i % 2}") for i in range(200)], "doc_id long, text string")
    docs = store.kept(docs, "few")
    found = leaks.leaks(docs, store.kept(bench, "bench"))
    sets = jaccard.jaccard_components(docs)
    toxicity.toxicity_scores(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    assert {n for n, size in asked.items() if size <= 4 << 20} >= {"benchmark-terms", "ngram-sets", "verified", "toxic-counts", "toxic-entries", "toxic-features"}
    assert spark.conf.get(store.BATCH_CONF) == before
    for df in (found, sets):
        assert "ExistingRDD" not in df._jdf.queryExecution().toString()


def test_few_files_for_features_of_texts(spark, monkeypatch):
    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    files, kept = [], toxicity.kept

    def keep(df, name):
        out = kept(df, name)
        if name == "toxic-features":
            files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(toxicity, "kept", keep)
    docs = spark.createDataFrame([(i, f"{'bad' if i % 2 else 'good'} word{i % 9} and{i % 5}") for i in range(800)], "doc_id long, text string").repartition(16)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = toxicity.toxicity_scores(store.kept(docs, "docs"), spark.createDataFrame([(i, i % 2) for i in range(800)], "doc_id long, toxic int")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.doc_id for r in got) == list(range(800)) and all(r.predicted == r.doc_id % 2 for r in got)
    assert len(files) == toxicity.SLICES and max(files) <= 3, files
