"""Merkle manifests, edit fingerprints and periodic runs against plain versions."""

import random
import zlib

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from threadloom.llm import edits, merkle, periods
from threadloom.llm.words import _fmix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["one\ntwo\n", "", None, "é\nü", "no line end", "\n"]


def documents(sizes, seed=0):
    rng = random.Random(seed)
    rows = [(0, rng.choice(TEXTS), rng.choice(["en", None]), s, rng.choice([3, None])) for s, n in sizes.items() for _ in range(n)]
    ids = rng.sample(range(-5, 10 * len(rows)), len(rows))
    return [(i, *row[1:]) for i, row in zip(ids, rows)]


@pytest.mark.parametrize(
    "sizes",
    [{"a": 1}, {"a": 2}, {None: 1, "": 1}, {"a": 3, "b": 4, None: 1}, {"a": 81, "b": 82, "ä": 83, "B": 80}, {"a": 250, "b": 1, None: 9, "z" * 50: 28}, {f"s{k}": 1 + k % 5 for k in range(90)}],
    ids=str,
)
def test_manifest(spark, sizes):
    rows = documents(sizes)
    got = merkle.manifest_check(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain.manifest(rows), key=str)
    assert {r.verified for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2} <= {True}


def test_manifest_of_repeated_rows_and_null_ids(spark):
    rows = documents({"a": 30, None: 5}) + [(None, "x\ny", "en", "a", 1)] * 3 + [(None, None, None, None, None)] * 2 + [(7, "x\ny", "en", "a", 1)] * 4
    got = merkle.manifest_check(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain.manifest(rows), key=str)


def test_proofs_fold_to_the_root_and_other_leaves_do_not(spark):
    df = spark.createDataFrame(documents({"a": 100, "b": 7}), SCHEMA)
    proofs = merkle.proofs(df.select("doc_id", "source", merkle.leaf_hash().alias("leaf"), F.lit(1).alias("extra")))
    assert proofs.columns.count("extra") == 1 and proofs.select("root").distinct().count() == 1
    assert proofs.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert proofs.where(merkle.fold(F.sha2("leaf", 256), F.col("path")) == F.col("root")).count() == 0


def test_runs_by_trying_every_period():
    rng = random.Random(5)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 7)):
            words = [rng.randrange(rng.choice([1, 2, 3, 10])) for _ in range(rng.choice([0, 1, 2, 5, 30, 80, 150, 300]))]
            for _ in range(rng.randrange(3) if len(words) > 10 else 0):
                a, p = rng.randrange(len(words)), rng.randrange(1, 40)
                for i in range(a, min(len(words), a + rng.randrange(p * 6))):
                    words[i] = words[a + (i - a) % p]
            texts.append(words)
        least = rng.choice([24, 3, 10])
        bounds = np.cumsum([0] + [len(t) for t in texts])
        hashes = _fmix(np.array(sum(texts, []), np.uint64) + np.uint64(77))
        text, start, length, period = (x.tolist() for x in periods.runs_of(hashes, bounds, least))
        assert list(zip(text, start, length, period)) == [(t, *r) for t, words in enumerate(texts) for r in plain.runs(words, least)]


def test_run_query(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(f"w{rng.randrange(rng.choice([2, 50]))}" for _ in range(rng.randrange(200)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "a " * 5000), (304, "a b c " * 9 + "a b"), (None, "x y " * 30), (None, None), (305, "ab " * 23), (306, "ab " * 24)]
    got = periods.run_summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain.run_row(*r) for r in rows), key=str)
    assert sum(r.n_runs > 0 for r in got) > 20


def test_a_very_long_text_of_one_word_and_its_collapse(spark):
    df = spark.createDataFrame([(1, "a " * 300_000 + "b c d " * 50_000)], "doc_id long, text string")
    row = periods.periodic_runs(df).first()
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (450_000, [(0, 300_000, 1), (300_000, 150_000, 3)], "a b c d")


def test_walks_one_character_at_a_time(monkeypatch):
    monkeypatch.setattr(edits, "SIDE_BY_SIDE", 3)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab cé\U0001f600") for _ in range(rng.choice([0, 1, 5, 300, 700]))) for _ in range(20)]
    codes, classes, offsets = edits._classed(texts)
    assert [chr(c) for c in codes] == list("".join(texts))
    reached, at, ends = edits._walk(classes, offsets[:-1], np.diff(offsets), np.zeros(20, np.int64), 1)
    for k, text in enumerate(texts):
        steps, end = plain.walked(text, classes[offsets[k] : offsets[k + 1]], edits._jumps(1), edits.CYCLE)
        assert (reached[at[k] : at[k + 1]].tolist(), ends[k]) == (steps, end)


def test_fingerprints_of_edited_texts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 9)))
    texts = {i: " ".join(word() for _ in range(rng.randrange(600))) for i in range(120)} | {120: "", 121: "x", 122: "\U0001f600é", 123: "a" * 30_000}
    rows = list(texts.items()) + [(500, None)]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in edits.edit_summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts[500] = ""
    order = sorted(texts, reverse=True)
    alone = {r.doc_id: r.fingerprint for r in edits.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, following in zip(order, order[1:] + order[:1]):
        text, half = texts[i], len(texts[i]) // 2
        changed = text[: len(text) - half] + texts[following][:half]
        row = got[i]
        assert (row.n_chars, row.edited_sha256, row.fingerprint) == (len(text), plain.sha(changed), alone[i])
        assert row.edited_fingerprint == edits._of_texts([changed])[0][0]
        assert row.near_edited == edits.likeness(row.fingerprint, row.edited_fingerprint)
        assert row.near_next == edits.likeness(row.fingerprint, alone[following])
        if 300 < len(text) < 20_000:
            assert row.near_edited > 0.3 > row.near_next
    assert got[500].fingerprint == got[120].fingerprint and len(got) == len(rows)


def test_likeness_follows_edit_distance():
    rng = random.Random(6)
    means = []
    for share in (0.0, 0.005, 0.02, 0.1, 1.0):
        found = []
        for _ in range(40):
            text = [rng.choice("etaoin shrdlu") for _ in range(1500)]
            changed = list(text)
            for _ in range(int(share * 1500)):
                at = rng.randrange(len(changed))
                changed[at : at + rng.randrange(2)] = rng.choice(["", "q", "zz"])
            if share == 1:
                changed = [rng.choice("etaoin shrdlu") for _ in range(1500)]
            a, b = edits._of_texts(["".join(text), "".join(changed)])[0]
            found.append(edits.likeness(a, b))
        means.append(np.mean(found))
    assert means[0] == 1 and means == sorted(means, reverse=True) and means[1] > 0.8 and means[-1] < 0.15


def test_near_copies_against_all_edit_distances(spark):
    rng = random.Random(9)
    rows, groups = [], 6
    for g in range(groups):
        text = [rng.choice("etaoin shrdlu") for _ in range(400)]
        for _ in range(5):
            changed = list(text)
            for _ in range(rng.randrange(5)):
                changed[rng.randrange(len(changed))] = rng.choice("xyz")
            rows.append((len(rows), "".join(changed)))
    rows += [(100, rows[7][1]), (101, "short"), (102, "short"), (103, ""), (104, None), (None, "alone in the world")]
    got = {r.doc_id: r.component_id for r in edits.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = [t for t in rows if t[0] is not None and t[1]]
    pairs = [(a[0], b[0]) for k, a in enumerate(texts) for b in texts[:k] if a[1][:3] and plain.edit_distance(a[1], b[1]) <= 0.1 * max(len(a[1]), len(b[1]))]
    expected = plain.smallest_by_group([t[0] for t in texts], pairs) | {103: 103, 104: 104, None: None}
    assert got == expected
