"""Corpus operators against plain versions and check SQL."""

import math
import os
import random
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import chat, graph, jaccard, leaks, licenses, lines, mixing, privacy, tokens, toxicity, vectors
from threadloom.llm.queries import LLM_ORACLE, LLM_QUERIES
from threadloom.llm.words import BY_SPACE, Words, pieces

SF_DIR = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string"


def words(rng, n, vocabulary):
    return [rng.choice(vocabulary) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for file in SF_DIR.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = LLM_QUERIES[name](spark, str(SF_DIR))
    columns = sorted(df.columns)
    found = con.execute(LLM_ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in found.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(expected, key=str)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(500, i) for i in range(501, 560)]
    ids = sorted({i for pair in links for i in pair if pair[0] != pair[1]})
    found = {r.node: r.comp for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = plain.smallest_by_group(ids, [p for p in links if p[0] != p[1]])
    assert sorted(found) == ids
    pairs = {(found[i], expected[i]) for i in ids}
    assert len(pairs) == len(set(found.values())) == len(set(expected.values()))


@pytest.mark.parametrize("cell_rows,cell_aim", [(4096, 200), (16, 10_000), (16, 8)])
def test_vectors(spark, monkeypatch, cell_rows, cell_aim):
    monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(vectors, "CELL_AIM", cell_aim)
    rng = np.random.default_rng(2)
    rows = []
    for label in (0, 1):
        for _ in range(8):
            centre = rng.standard_normal(24)
            for _ in range(rng.integers(1, 9)):
                rows.append((len(rows), (centre + rng.standard_normal(24) * 0.13).tolist(), label))
    rows += [(len(rows) + i, rows[3][1], 0) for i in range(40)]
    rows += [(len(rows) + i, x, label) for i, (x, label) in enumerate([(None, 0), ([], 0), ([0.0] * 24, 0), ([1.0] * 23 + [None], 0), ([1.0] * 23 + [float("nan")], 0), (rows[0][1], None), ([1e300] * 24, 1), ([2e300] * 24, 1), ([1e-300] * 24, 1), ([1.0, 2.0], 0), ([2.0, 4.0], 0)])]
    found = vectors.vector_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    with np.errstate(all="ignore"):
        expected = plain.vectors([(i, [v / max(map(abs, x)) if v is not None and any(x) and None not in x else v for v in x] if x else x, label) for i, x, label in rows])
    assert sum(n for n, _ in expected.values()) > 200
    got = {r.vec_id: (r.n_links, r.component_id) for r in found.collect()}
    assert got == expected
    assert {r.vec_id for r in found.where("kept").collect()} == {i for i, (_, c) in expected.items() if i == c}


@pytest.mark.parametrize("passes,grams", [(2, 500_000), (0, 500_000), (0, 40)])
def test_jaccard(spark, monkeypatch, passes, grams):
    monkeypatch.setattr(jaccard, "LEADER_PASSES", passes)
    monkeypatch.setattr(jaccard, "MATCH_GRAMS", grams)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "été", "Word", "word"]
    rows = []
    for _ in range(14):
        text = words(rng, rng.choice([1, 3, 5, 6, 30, 80]), vocabulary)
        for _ in range(rng.randint(1, 7)):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(copy)))
    rows += [(len(rows), ""), (len(rows) + 1, None), (len(rows) + 2, " \n ")]
    found = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == plain.jaccard(rows)


def test_word_hashes_do_not_depend_on_place():
    texts = ["a bb a", "", "bb", " a", "x" * 70 + " a"]
    seen = {}
    for _, _, data, offsets in pieces(pa.array([*texts, None])):
        found = Words(data, offsets, BY_SPACE)
        assert np.diff(found.bounds).tolist() == [3, 0, 1, 1, 2, 0]
        for a, b, h in zip(found.starts, found.ends, found.hashes, strict=True):
            assert seen.setdefault(bytes(data[a:b]), h) == h
    assert len(set(seen.values())) == len(seen) == 3


def test_toxicity(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(400):
        text = words(rng, rng.randint(20, 120), vocabulary)
        toxic = i % 5 == 1
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["vile", "Rotten", "scum"])
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    docs += [(1000, None), (1001, "")]
    scored = toxicity.toxicity_scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {r.doc_id: r for r in scored}
    assert len(scored) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    right = [got[i].predicted == (i % 5 == 1) for i in range(400) if got[i].held_out]
    assert sum(right) >= 0.95 * len(right)
    assert got[1000].predicted == got[1001].predicted == 0


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    docs = spark.createDataFrame([(i, f"a b c {'x' if i % 2 else 'y'} {i % 7}") for i in range(120)], DOCS)
    labels = [(i, i % 2) for i in range(120)]
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    runs = [sorted(map(tuple, toxicity.toxicity_scores(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, turned)]
    assert runs[0] == runs[1]


def test_discounts_follow_counts_of_counts():
    share = 40 / (40 + 2 * 10)
    assert toxicity.discounts([40, 10, 6, 3]) == pytest.approx([0, 1 - 2 * share * 10 / 40, 2 - 3 * share * 6 / 10, 3 - 4 * share * 3 / 6])
    assert all(0.1 <= d <= 0.98 * k for times in ([1, 50, 1, 50], [50, 1, 50, 1]) for k, d in enumerate(toxicity.discounts(times)) if k)
    assert toxicity.discounts([5, 0, 2, 1]) == [0, 0.5, 1, 1.5]


def test_toxicity_on_held_out_documents(spark):
    """Rare toxic words, most of them seen a few times only, and texts that no model has seen."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no such tables")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.toxicity_scores(spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id"), labels)
    rows = scored.where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 5


def test_token_counts(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path(tokens.TOKENIZER))
    rng = random.Random(5)
    parts = ["a", "s", "t", "re", "'", "'ll", "'s", " ", "  ", "\n", "\t", "12", "é", "漢", "!", "...", "<|endoftext|>", "<|endof", "the", " the", "ing", "😀", "\x1c", "́", "Ⅷ", "\x00", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["", None, "x" * 3000, " " * 500, "ab" * 40_000]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in tokens.token_counts(spark.createDataFrame(rows, DOCS).repartition(2)).collect()}
    for i, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 512), text


def test_license_base_places(spark):
    rng = random.Random(6)
    vocabulary = ["MIT", "license", "Apache", "general", "public", "the", "é", "2", "under", "released"]
    rows = [(i, rng.choice([" ", "-", "\n"]).join(words(rng, rng.randint(0, 40), vocabulary))) for i in range(200)] + [(900, None), (901, "")]
    for r in licenses.license_summary(spark.createDataFrame(rows, DOCS)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain.license_base(dict(rows)[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_license_markup():
    automaton = licenses.Automaton([("x", "alpha [beta [gamma]] (one|two three) <1-2> end"), ("y", "alpha")])
    match = lambda text: [(t, n) for t, _, n in licenses.scan(automaton, text.encode())[1] if t == 0]
    assert match("Alpha one any END") == [(0, 4)] and match("alpha beta two three a b end") == [(0, 7)]
    assert match("alpha beta gamma one q end") == [(0, 6)]
    assert not match("alpha gamma one q end") and not match("alpha one end") and not match("alpha two q end") and not match("alpha one a b c end")
    with pytest.raises(ValueError):
        licenses.Automaton([("x", "<1-2> word")])
    with pytest.raises(ValueError):
        licenses.Automaton([("x", "word [maybe")])


def test_line_dedup(spark):
    rng = random.Random(7)
    rows = [(i, "\n".join(words(rng, rng.randint(0, 14), ["a", "b", "c", "", " "]))) for i in range(120)] + [(500, None), (501, ""), (502, "\n\n\n")]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    expected = plain.line_dedup(rows)
    assert {i: r.text for i, r in got.items()} == expected
    assert all(r.n_lines == (0 if t is None else t.count("\n") + 1) for t, r in ((dict(rows)[i], r) for i, r in got.items()))


def test_leaks(spark):
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(3000)]
    common = ["the", "of", "and"]
    item = lambda n: words(rng, n, vocabulary + common * 300)
    items = [item(n) for n in (15, 25, 40, 70, 3, 12)]
    docs = [item(rng.randint(30, 300)) for _ in range(120)]
    planted = set()
    for d in range(0, 40):
        k = d % len(items)
        passage = list(items[k])
        if d % 3 == 0 and len(passage) > 20:
            for at in rng.sample(range(len(passage) - len(passage) // 4), len(passage) // 6):
                passage[at] = rng.choice(vocabulary)
        at = rng.randrange(len(docs[d]))
        docs[d][at:at] = passage
        planted.add((d, k))
    rows = [(d, rng.choice([" ", ", "]).join(x).upper() if d % 2 else " ".join(x)) for d, x in enumerate(docs)] + [(900, None), (901, ""), (902, "the of and the")]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    found = leaks.leaks(spark.createDataFrame(rows, DOCS), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == planted
    clean = leaks.decontaminate(spark.createDataFrame(rows, DOCS), bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in planted}


def test_common_subsequence():
    rng = random.Random(9)
    for _ in range(200):
        a, b = words(rng, rng.randint(0, 12), "abcd"), words(rng, rng.randint(0, 12), "abcd")
        assert leaks.common_subsequence(a, b) == plain.common_subsequence(a, b)


def test_role_repair(spark, monkeypatch):
    monkeypatch.setattr(chat, "_BITS", 3)
    rng = random.Random(10)
    rows = []
    for c in range(25):
        for k in range(rng.randint(1, 12) if c else 200):
            rows.append((c if c != 7 else None, k, rng.choice(["user", "assistant", "system", "human", None, "x", " User "]), rng.choice(["a", "b", None, ""])))
    got = chat.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    for c in {r[0] for r in rows}:
        found = sorted((r for r in got if r.conv_id == c), key=lambda r: r.place)
        roles = [{"system": 1, "user": 2, "human": 2, "assistant": 3}.get((r.role or "").strip().lower(), 0) for r in found]
        costs = chat._forward([0] + [chat.NEVER] * 3, roles)
        end = min(range(4), key=lambda s: (costs[-1][s] + chat.END_COST[s], s))
        assert [chat.ROLES.index(r.new_role) for r in found] == chat.back(costs, roles, end)[1:]
        whole = "".join(r.rendered for r in found)
        order = [chat.ROLES.index(x.split("|>")[0]) for x in whole.split("<|")[1:] if not x.startswith("end")]
        assert all(b in chat.LEGAL[a] for a, b in zip([chat.START, *order[:-1]], order, strict=True)) and order[-1] in chat.ENDS
        assert whole.count(chat.CLOSE) == len(order)


def test_cheapest_repair_is_found_by_trying_all():
    rng = random.Random(11)
    for _ in range(60):
        roles = [rng.randrange(4) for _ in range(rng.randint(1, 5))]
        best = min(
            sum(chat.MOVES[r][s][g][0] for r, s, g in zip(roles, path[:-1], path[1:], strict=True)) + chat.END_COST[path[-1]]
            for path in ([0, *p] for p in np.ndindex(*[4] * len(roles)))
        )
        costs = chat._forward([0] + [chat.NEVER] * 3, roles)[-1]
        assert min(c + e for c, e in zip(costs, chat.END_COST, strict=True)) == best


def test_mix_meets_targets(spark):
    rng = random.Random(12)
    rows = []
    for s, (source, n) in enumerate([("a", 400), ("b", 150), (None, 60), ("c", 30)]):
        rows += [(1000 * s + i, " ".join(["w"] * rng.randint(0, 120)), source) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken_words(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken_words(df.repartition(5)).collect()))
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    total = sum(r.size for r in got)
    sources = {r.source: (r.source_size, r.target) for r in got}
    assert sum(t for _, t in sources.values()) == pytest.approx(1.5 * total)
    for source, (size, target) in sources.items():
        taken = sum(r.taken for r in got if r.source == source)
        assert target <= 2 * size and abs(taken - target) <= max(0.02 * target, 4 * mixing.BLOCK_WORDS)
    # By code point and null last: a, b, c, null weigh 5, 2, 1, 5. Those below their cap share by weight.
    free = [(t, w) for (s, w) in (("a", 5), ("b", 2), ("c", 1), (None, 5)) for size, t in [sources[s]] if t < 2 * size]
    assert len({round(t / w, 6) for t, w in free}) <= 1


def test_mix_pieces_cover_what_is_taken(spark):
    df = spark.createDataFrame([(i, " ".join(["w"] * (i % 90)), "ab"[i % 2]) for i in range(100)], "doc_id long, text string, source string")
    mixed, dealt = mixing.mix(df)
    assert mixed.where("n_words <= 0 or first_word < 0").isEmpty()
    joined = mixed.join(dealt, ["s", "bucket", "nth"])
    assert joined.where("first_word + n_words > size").isEmpty()
    assert joined.groupBy("slot").agg(F.sum("n_words").alias("n")).where(F.col("n") > mixing.BLOCK_WORDS).isEmpty()


def test_personal_data_base(spark):
    rng = random.Random(13)
    parts = ["a@b.co", "x.y@z", "@", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (202) 555-0100", "+1", "é", " ", "-", "12", "7", "_", "😀", "\n", "mail me"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(400)] + [(900, None), (901, ""), (902, "1" * 20_000), (903, "a." * 20_000), (904, "1 " * 20_000)]
    for r in privacy.personal_data_summary(spark.createDataFrame(rows, DOCS)).collect():
        expected = plain.personal(dict(rows)[r.doc_id])
        assert [s for s in r.spans.split(",") if s and not s.startswith(("term", "secret"))] == expected
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in expected) for k, _, _ in plain.KINDS]


def test_disclosing_terms(spark):
    rows = [(i, f"common words here\nzorro lives by a{i % 2}@b.co common\nother words") for i in range(8)] + [(100 + i, "common words other lives by") for i in range(40)]
    rows += [(200 + i, "zorro alone") for i in range(1)]
    got = {r.doc_id: r for r in privacy.personal_data_summary(spark.createDataFrame(rows, DOCS)).collect()}
    text = rows[0][1]
    terms = [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[0].spans.split(",")) if k == "term"]
    assert "zorro" not in terms and "common" not in terms and terms == []
    one = [(i, f"common words here\nzorro lives by a@b.co common\nother words") for i in range(8)] + rows[8:48]
    got = {r.doc_id: r for r in privacy.personal_data_summary(spark.createDataFrame(one, DOCS)).collect()}
    terms = [one[0][1][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[0].spans.split(",")) if k == "term"]
    assert terms == ["zorro"]
    cleaned = {r.doc_id: r.text for r in privacy.sanitised(spark.createDataFrame(one, DOCS)).collect()}
    assert cleaned[0] == "common words here\n lives by [EMAIL] common\nother words" and cleaned[100] == dict(one)[100]


def test_secrets_by_the_words_before_them(spark):
    """Runs behind a word that hardly ever stands without one are secrets; alike runs behind ordinary words are not."""
    rng = random.Random(33)
    run = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(36)) + "a1"
    rows = [(i, f'é first\nsome words Token = "{run()}" and more') for i in range(30)]
    rows += [(100 + i, f"the commit {run()} is old") for i in range(30)]
    rows += [(200 + i, f"the commit of the words and more some\ncommit {i}") for i in range(300)]
    rows += [(600, f"token {run()}\n{run()} token " + "x" * 60 + "1"), (601, "token " + "é " * 70 + run()), (602, f"rare {run()}")]
    docs = spark.createDataFrame(rows, DOCS)
    texts = dict(rows)
    for r in privacy.personal_data_summary(docs).collect():
        found = [s.split(":") for s in r.spans.split(",") if s.startswith("secret:")]
        values = [texts[r.doc_id][int(a) : int(b)] for _, a, b in found]
        want = []
        if r.doc_id < 100:
            want = [texts[r.doc_id].split('"')[1]]
        elif r.doc_id == 600:
            want = [texts[600].split()[1], texts[600].split()[4]]
        assert values == want, r.doc_id
    cleaned = {r.doc_id: r.text for r in privacy.sanitised(docs).collect()}
    assert cleaned[3] == 'é first\nsome words Token = "[SECRET]" and more' and cleaned[100] == texts[100]
    # The same secret in many copies is one value: its neighbours give nothing away.
    copies = spark.createDataFrame([(i, f"odd words {'a1' * 20}") for i in range(9)] + rows[60:], DOCS)
    assert privacy.personal_data_summary(copies).where("spans LIKE '%secret%' AND doc_id < 100").isEmpty()


def test_disclosing_terms_with_capitals(spark):
    line = "İl Contact Alice MCDONALD éva Éric at a@b.co Xray"
    rows = [(i, f"First\n{line}\nlast") for i in range(8)] + [(50, "ray of a@b.co"), (51, "ray of a@b.co"), (52, "ray of a@b.co")]
    rows += [(100 + i, "Contact at of İl Xray first last") for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in privacy.personal_data_summary(docs).collect()}
    text = rows[0][1]
    terms = [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[0].spans.split(",")) if k == "term"]
    assert terms == ["Alice", "MCDONALD", "éva", "Éric"]
    assert got[50].spans == "email:7:13,term:0:3"
    cleaned = {r.doc_id: r.text for r in privacy.sanitised(docs).collect()}
    assert cleaned[0] == "First\nİl Contact     at [EMAIL] Xray\nlast" and cleaned[100] == dict(rows)[100]


def test_personal_data_of_long_texts_and_clashing_names(spark):
    """Very many matches in one text, overlapping kinds among them, and columns with the names of what is found."""
    n = 20_000
    parts = [f"u{i}@x.de" if i % 3 else f"+49 30 {1000000 + i} 10.0.{i % 256}.1" for i in range(n)]
    text = " é ".join(parts)
    names = ["email", "ip", "card", "phone", "term", "secret", "_id", "__spans"]
    docs = spark.createDataFrame([(1, text, *names), (2, None, *names)], f"{DOCS}, " + ", ".join(f"`{c}` string" for c in names))
    row = docs.select("doc_id", *(privacy.base_spans(F.col("text"), k).alias(f"{k}_") for k in privacy.KINDS)).where("doc_id = 1").first()
    want = plain.personal(text)
    for kind in privacy.KINDS:
        assert [f"{kind}:{s.start}:{s.stop}" for s in row[f"{kind}_"]] == [x for x in want if x.startswith(f"{kind}:")]
    got = {r.doc_id: r for r in privacy.sanitised(docs).collect()}
    assert got[1].text.count("[EMAIL]") == sum(i % 3 > 0 for i in range(n)) and "@" not in got[1].text
    assert got[2].text is None and all(r[c] == c for r in got.values() for c in names)


def test_disclosing_terms_against_counts(spark):
    rng = random.Random(21)
    lines = []
    for _ in range(400):
        near = rng.choice(["a@x.de", "b@x.de", "10.1.2.3", None])
        bound = {"a@x.de": "alpha", "b@x.de": "beta", "10.1.2.3": "gamma"}.get(near, "none")
        line = words(rng, 5, [f"w{i}" for i in range(12)]) + ([bound] if rng.random() < 0.7 else []) + ([near] if near else [])
        lines.append(" ".join(line))
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 4])) for i in range(0, 400, 4)], DOCS)
    held = privacy.kept(privacy._entity_lines(docs), "test-lines")
    got = {(r.entity, r.term): r.disclosed for r in privacy.disclosing_terms(docs, held, 0.3, 3).collect()}
    one, term, both = Counter(), Counter(), Counter()
    for line in lines:
        found = {w for w in line.split() if "." in w}
        rest = {w for w in line.split() if "." not in w}
        kinds = [("email:" if "@" in e else "ip:") + e for e in found]
        one.update(kinds)
        term.update(rest)
        both.update((e, w) for e in kinds for w in rest)
    want = {}
    for (e, w), n in both.items():
        told = math.log(n * len(lines) / (one[e] * term[w])) / -math.log(one[e] / len(lines))
        if n >= 3 and told >= 0.3:
            want[e, w] = told
    assert want and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_toxicity_models_grow_with_the_texts(spark):
    """More words and bigrams that occur often enough than 2 ** 18, each rare in the whole: all have their own probability."""
    n = 270_000
    docs = [(i, " ".join(f"{'bad' if i % 2 else 'good'}{i // 8 * 450 + k} x" for k in range(450))) for i in range(8 * n // 450)]
    labelled = spark.createDataFrame([(text, i % 2) for i, text in docs], "text string, toxic int").repartition(8)
    model = toxicity.fit_tables(labelled, 100 << 20)
    assert model.entries.where("toxic + other = 4").count() > 2 * 2 * n
    odd = [(1, "x bad0 x"), (2, "x good7 x"), (3, f"x bad{n - 1} x"), (4, "x new x"), (None, None)]
    got = {r.doc_id: r.per_word for r in toxicity._with_features(spark.createDataFrame(odd, DOCS), model).collect()}
    ratio = plain.kneser_ney([(text, i % 2) for i, text in docs])
    for i, text in odd:
        assert got[i] == pytest.approx(sum(ratio(text or "")) / 3, abs=1e-9)
    assert min(got[1], got[3]) > 0.5 and got[2] < -0.5 and abs(got[4]) < 0.5 and got[None] == 0


def test_toxicity_counts_stay_packed_by_bucket(spark, monkeypatch):
    """A bucket's bigrams meet the texts as one row, and no bigram's word is written beside its key."""
    kept, written = toxicity.kept, {}

    def keep(df, name):
        out = kept(df, name)
        written[name] = sum(Path(f.removeprefix("file://")).stat().st_size for f in out.inputFiles())
        return out

    monkeypatch.setattr(toxicity, "kept", keep)
    before = spark.conf.get(toxicity._BATCH_CONF)
    rng = random.Random(8)
    texts = [(" ".join(words(rng, 2000, [f"w{k}" for k in range(1000)])), i % 2) for i in range(150)]
    model = toxicity.fit_tables(spark.createDataFrame(texts, "text string, toxic int"), 1)
    want = [Counter(), Counter()]
    for text, toxic in texts:
        w = text.split()
        for k, things in enumerate((w, list(zip(w, w[1:], strict=False)))):
            for x in things:
                want[k][x, toxic] += 1
    pairs = [Counter((c[x, 1], c[x, 0]) for x in {x for x, _ in c}) for c in want]
    got = [Counter(), Counter()]
    for r in model.entries.collect():
        got[r.kind][int(r.toxic), int(r.other)] += 1
    assert got == pairs
    assert spark.conf.get(toxicity._BATCH_CONF) == before
    assert model.packed.count() <= 2 * model.buckets
    assert written["toxic-counts"] < 14 * pairs[1].total(), written


def test_toxicity_of_texts_of_one_word(spark):
    model = toxicity.fit_tables(spark.createDataFrame([("vile", 1), ("vile", 1), ("kind", 0), ("", 0)], "text string, toxic int"), 1)
    got = {r.doc_id: r.per_word for r in toxicity._with_features(spark.createDataFrame([(1, "vile"), (2, "kind"), (3, "vile kind"), (4, "new")], DOCS), model).collect()}
    ratio = plain.kneser_ney([("vile", True), ("vile", True), ("kind", False), ("", False)])
    assert all(got[i] == pytest.approx(sum(ratio(t)) / len(t.split()), abs=1e-9) for i, t in ((1, "vile"), (2, "kind"), (3, "vile kind"), (4, "new")))


def test_toxicity_against_plain_models(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "_CHUNK", 500)
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(60)]
    docs = [(i, " ".join(words(rng, rng.randint(0, 60), vocabulary + [f"once{i}"] + (["vile"] * 9 if i % 3 == 0 else [])))) for i in range(150)]
    model = toxicity.fit_tables(spark.createDataFrame([(t, int(i % 3 == 0)) for i, t in docs if i < 100], "text string, toxic int"), 1)
    ratio = plain.kneser_ney([(t, i % 3 == 0) for i, t in docs if i < 100])
    got = {r.doc_id: tuple(r)[1:] for r in toxicity._with_features(spark.createDataFrame(docs, DOCS), model).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        r = ratio(text)
        want = (0, 0, 0, 0)
        if r:
            peak = max((r[k] + (r[k + 1] if k + 1 < len(r) else 0)) / 2 for k in range(len(r)))
            want = (sum(r) / len(r), sum(r) / len(r) ** 0.5, peak, sum(max(x - 2, 0) for x in r) / len(r) ** 0.5)
        assert got[i] == pytest.approx(want, abs=1e-9)



def test_leaks_finds_paraphrases(spark):
    """Items of which 62 % of the words are left, all of the answer among them, others replaced or put between."""
    rng = random.Random(13)
    vocabulary = [f"t{i}" for i in range(4000)]
    draw = lambda n: words(rng, n, vocabulary)
    items = [draw(rng.randint(20, 70)) for _ in range(1500)]
    docs = []
    for i, item in enumerate(items):
        part = list(item)
        body = len(part) - max(3, len(part) // 4)
        for at in rng.sample(range(body), int(0.38 * len(part))):
            part[at] = f"other{rng.randrange(10**6)}"
        if i % 3 == 0:
            part.insert(rng.randrange(len(part)), "between")
        docs.append((i, " ".join(draw(rng.randint(0, 60)) + part + draw(rng.randint(0, 60)))))
    bench = spark.createDataFrame([(k, " ".join(item)) for k, item in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in leaks.leaks(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert sum((i, i) in found for i in range(len(items))) >= 0.99 * len(items)
