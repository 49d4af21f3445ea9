from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadloom.sources import generations, store, tables
from threadloom.streaming import ingest

from test_assemble import fallback, page

AUTHOR = "named_struct('username', 'u', 'uid', '1', 'avatar', '', 'post_count', 0, 'register_date', '', 'last_login', '', 'signature', '')"


def thread_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "tid string, n bigint, title string").selectExpr(
        "tid", "title", "'' AS url", "'' AS forum", "n AS total_floors", "n - 1 AS last_position", "timestamp'2024-01-01' AS created_at"
    )


def post_rows(threads, text):
    return threads.selectExpr("tid", "explode(sequence(0L, last_position)) AS position").selectExpr(
        "tid", "position", "1L AS page", "'' AS floor", "string(position) AS post_id", "timestamp'2024-01-01' AS post_time", f"{AUTHOR} AS author",
        "'' AS content_html", f"'{text}' AS content_md",
    )


def asset_rows(spark, *rows):
    return spark.createDataFrame([(t, u, l, "", 1, d, i) for i, (t, u, l, d) in enumerate(rows)], "tid string, url string, local string, alt string, file_size bigint, downloaded boolean, seq bigint")


@pytest.fixture
def path(spark, tmp_path):
    where = str(tmp_path / "store")
    first = thread_rows(spark, ("1", 3, "one"), ("2", 2, "two"))
    store.store_threads(where, 0, first, post_rows(first, "old"), asset_rows(spark, ("1", "u", "a.png", True), ("2", "u", "b.png", True)))
    again = thread_rows(spark, ("1", 1, "one again"), ("3", 1, "three"))
    store.store_threads(where, 1, again, post_rows(again, "new"), asset_rows(spark, ("1", "v", "c.png", True)))
    return where


def test_body_is_replaced_and_records_carried(spark, path):
    heads = {r.tid: (r.title, r.total_floors) for r in store.stored_threads(spark, path).collect()}
    assert heads == {"1": ("one again", 1), "2": ("two", 2), "3": ("three", 1)}
    texts = sorted((r.tid, r.position, r.content_md) for r in store.stored_posts(spark, path).collect())
    assert texts == [("1", 0, "new"), ("2", 0, "old"), ("2", 1, "old"), ("3", 0, "new")]
    kept = [(r.tid, r.url, r.local) for r in store.stored_assets(spark, path).orderBy("tid", "seq").collect()]
    assert kept == [("1", "u", "a.png"), ("1", "v", "c.png"), ("2", "u", "b.png")]


def test_load_and_missing(spark, path):
    wanted = spark.createDataFrame([("1",), ("missing",), ("",), ("2",)], "tid string")
    found, missing = store.load_threads(spark, path, wanted)
    assert sorted(r.tid for r in found.collect()) == ["1", "2"]
    assert {r.tid: r.error for r in missing.collect()} == {"missing": "thread not found in store", "": "tid is empty"}
    some = spark.createDataFrame([("3",), ("3",), ("missing",)], "tid string")
    assert [r.title for r in store.stored_threads(spark, path, some).collect()] == ["three"]
    assert [r.content_md for r in store.stored_posts(spark, path, some).collect()] == ["new"]
    assert store.stored_assets(spark, path, some).collect() == []


def test_compaction_keeps_the_state(spark, path, tmp_path):
    packed = str(tmp_path / "packed")
    store.compact_store(spark, path, packed)
    for read in (store.stored_posts, store.stored_assets):
        fields = [c for c in read(spark, path).columns if c != "seq"]
        assert sorted(map(str, read(spark, path).select(fields).collect())) == sorted(map(str, read(spark, packed).select(fields).collect()))


def test_a_generation_can_be_repeated(spark, path):
    again = thread_rows(spark, ("1", 1, "one again"), ("3", 1, "three"))
    store.store_threads(path, 1, again, post_rows(again, "new"))
    assert store.stored_posts(spark, path).count() == 4


def test_merge_and_carry_without_a_store(spark):
    merged = store.merge_threads(thread_rows(spark, ("1", 1, "a"), ("2", 1, "b")), thread_rows(spark, ("2", 1, "c")))
    assert sorted(r.title for r in merged.collect()) == ["a", "c"]
    old = asset_rows(spark, ("1", "u", "a", True), ("1", "v", "", True))
    new = asset_rows(spark, ("1", "u", "z", True), ("1", "v", "w", True))
    assert sorted((r.url, r.local) for r in store.carry_records(old, new).collect()) == [("u", "a"), ("v", ""), ("v", "w")]


@pytest.mark.parametrize("layout", ["files", "shards"])
def test_export_round_trip(spark, tmp_path, layout):
    df = spark.createDataFrame([("1", 0, "# a\n\nb\n"), ("1", 1, "tail\n"), ("007", 0, "x\n\n")], "tid string, part bigint, markdown string")
    out = str(tmp_path / "out")
    store.export_threads(df, out, layout)
    assert sorted(store.read_export(spark, out, layout).collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        store.export_threads(df, out, "pages")


def test_files_are_laid_out_as_by_the_text_sink_without_a_process_each(spark, tmp_path):
    odd = ["a/b", "é %x", "k=v:w?", "[{^}]'\"#*\\", "\n\t\x7f", "", None, " 1 "]
    rows = [(t, p, f"{i} {p}\n\u00fc" if p else None) for i, t in enumerate(odd) for p in (0, 1, -2, None)]
    df = spark.createDataFrame([*rows, *rows[:3]], "tid string, part bigint, markdown string").repartition(3)
    out, plain = tmp_path / "out", tmp_path / "plain"
    store.export_threads(df.limit(1), str(out), "files")
    store.export_threads(df, f"file://{out}", "files")  # in place of the first
    df.select(F.regexp_replace("markdown", r"\n\z", "").alias("value"), "tid", "part").repartition("tid", "part").write.partitionBy("tid", "part").text(str(plain))

    def held(root):
        return sorted((str(f.parent.relative_to(root)), f.read_bytes()) for f in root.rglob("part-*.txt"))

    assert held(out) == held(plain) and (out / "_SUCCESS").exists()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out", "plain"]
    # Hadoop's local file system would have left a checksum beside each.
    assert not [f for f in out.rglob(".*") if f.name.startswith(".part")]
    assert sorted(map(str, store.read_export(spark, str(out), "files").collect())) == sorted(map(str, store.read_export(spark, str(plain), "files").collect()))


def arrivals(spark, source, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "tid string, page bigint, html string").coalesce(1).write.mode("append").parquet(f"{source}")


def state(spark, path):
    posts = store.stored_posts(spark, path).orderBy("tid", "position").collect()
    return [(r.tid, r.position, r.post_id) for r in posts]


def test_stream_equals_batch(spark, tmp_path):
    source, path, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    arrivals(spark, source, [("a", 2, page(["m", 3], 2)), ("b", 1, page(["m"], 1))], [("a", 1, page(["m", 1, 2], 2))])
    ingest.ingest_pages_stream(spark, source, path, progress, max_files_per_trigger=1).awaitTermination()
    ingest.publish(spark, path, 0, fallback())
    assert state(spark, path) == [("a", 0, "m"), ("a", 1, "1"), ("a", 2, "2"), ("a", 3, "3"), ("b", 0, "m")]
    # A page comes again with one reply less; only its thread is touched, and the newer page counts.
    arrivals(spark, source, [("a", 1, page(["m", 1], 2))])
    ingest.ingest_pages_stream(spark, source, path, progress).awaitTermination()
    last = ingest.last_page_generation(spark, path)
    assert last == 2
    assert {r.tid for r in ingest.newest_pages(spark, path, last).collect()} == {"a"}
    ingest.publish(spark, path, last, fallback())
    assert state(spark, path) == [("a", 0, "m"), ("a", 1, "1"), ("a", 2, "3"), ("b", 0, "m")]


def test_a_batch_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "store")
    batch = spark.createDataFrame([("a", 1, page(["m", 1], 1))], "tid string, page bigint, html string")
    for _ in range(2):
        ingest.ingest_batch(batch, 0, path)
    assert ingest.newest_pages(spark, path).count() == 1


def test_a_batch_of_one_file_is_parsed_by_all_cores(spark, tmp_path, monkeypatch):
    source, path = str(tmp_path / "pages"), str(tmp_path / "store")
    rows = [(str(i), 1, page([f"post {i}"], 1)) for i in range(40)]
    spark.createDataFrame(rows, "tid string, page bigint, html string").coalesce(1).write.parquet(source)
    parse, tasks = ingest.parse_pages, []

    def counted(pages, *args, **options):
        tasks.append(pages.rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect())
        return parse(pages, *args, **options)

    monkeypatch.setattr(ingest, "parse_pages", counted)
    ingest.ingest_batch(spark.read.parquet(source), 0, path)
    monkeypatch.undo()
    assert len(tasks[0]) >= 4 and max(tasks[0]) <= 20 and sum(tasks[0]) == 40
    assert ingest.newest_pages(spark, path).count() == 40


def commit_files(where):
    return sorted(p.name for p in Path(where).glob("commits/version=*"))


def snapshot(spark, path):
    """All that readers can see."""
    reads = (store.stored_threads, store.stored_posts, store.stored_assets, store.stored_shares, store.stored_share_files)
    return [sorted(str(r.asDict() | {"gen": 0}) for r in read(spark, path).collect()) for read in reads]


def share_rows(spark, *rows):
    return spark.createDataFrame([(t, u, "c", "shares/c", n, ok, "" if ok else "download_failed", i) for i, (t, u, n, ok) in enumerate(rows)], tables.SHARES)


def file_rows(spark, *rows):
    return spark.createDataFrame(list(rows), tables.SHARE_FILES)


@pytest.fixture
def grown(spark, tmp_path):
    """Nine generations of three threads in turn."""
    where = str(tmp_path / "grown")
    for gen in range(9):
        heads = thread_rows(spark, (str(gen % 3), 1 + gen % 2, f"title {gen}"))
        assets = asset_rows(spark, (str(gen % 3), f"u{gen}", f"{gen}.png", True), (str(gen % 3), "again", f"{gen}", True))
        shares = share_rows(spark, (str(gen % 3), "s", gen, gen != 7), ("0", f"only{gen}", 1, True))
        store.store_threads(where, gen, heads, post_rows(heads, f"text {gen}"), assets, shares, file_rows(spark, (str(gen % 3), "s", 0, [f"f{gen}"]), ("0", f"only{gen}", 0, ["x"])) if gen != 7 else None)
    return where


def test_compaction_in_tiers_changes_nothing_that_is_read(spark, grown):
    before = snapshot(spark, grown)
    assert [f[0] for f in before if not f] == [] and "f4" not in str(before[4]) and "f8" in str(before[4])
    made = store.compact_tiers(spark, grown, fanout=2)
    assert [p.name for p in generations.live_parts(spark, grown)] == ["0-7", "8-8"] and len(made) == 7
    assert snapshot(spark, grown) == before
    # Readers that began before go on with their own list.
    assert len(commit_files(grown)) == 9 + 7
    gone = store.expire_store(spark, grown)
    assert "threads/part=0-0" in gone and len(commit_files(grown)) == 1
    assert {p.name for p in Path(grown).glob("posts/part=*")} == {"part=0-7", "part=8-8"}
    assert snapshot(spark, grown) == before
    heads = thread_rows(spark, ("0", 1, "later"))
    store.store_threads(grown, store.next_generation(spark, grown), heads, post_rows(heads, "later"))
    assert {r.tid: r.title for r in store.stored_threads(spark, grown).collect()} == {"0": "later", "1": "title 7", "2": "title 8"}
    with pytest.raises(ValueError, match="merged"):
        store.store_threads(grown, 3, heads, post_rows(heads, "late"))


def test_a_failed_compaction_leaves_the_store_as_it_was(spark, grown, monkeypatch):
    before, lists = snapshot(spark, grown), commit_files(grown)
    write = store._write

    def failing(df, spark, path, name, part):
        if name == "threads":
            raise OSError("disk full")
        write(df, spark, path, name, part)

    monkeypatch.setattr(store, "_write", failing)
    with pytest.raises(OSError):
        store.compact_tiers(spark, grown, fanout=3)
    assert commit_files(grown) == lists and snapshot(spark, grown) == before
    monkeypatch.undo()
    store.compact_tiers(spark, grown, fanout=3)
    assert [p.name for p in generations.live_parts(spark, grown)] == ["0-8"] and snapshot(spark, grown) == before


def test_live_parts_stay_logarithmic(spark, tmp_path):
    where, merged = str(tmp_path / "parts"), []
    for gen in range(40):
        generations.add(spark, where, generations.new_part(spark, where, gen))
        generations.compact(spark, where, lambda parts, into: merged.append(into), fanout=3)
        parts = generations.live_parts(spark, where)
        assert len(parts) <= 2 * 4 and [p.first for p in parts] == [0, *[p.last + 1 for p in parts[:-1]]] and parts[-1].last == gen


def test_share_lists_are_replaced_by_url(spark, tmp_path):
    where = str(tmp_path / "shares")
    heads = thread_rows(spark, ("1", 1, "one"))
    store.store_threads(where, 0, heads, post_rows(heads, "t"), None, share_rows(spark, ("1", "a", 2, True), ("1", "b", 1, True)), file_rows(spark, ("1", "a", 0, ["x", "y"]), ("1", "b", 0, ["z"])))
    store.store_threads(where, 1, thread_rows(spark), post_rows(heads, "t").limit(0), None, share_rows(spark, ("1", "c", 0, False), ("1", "a", 1, True)), file_rows(spark, ("1", "a", 0, ["w"])))
    assert [(r.url, r.n_files, r.downloaded) for r in store.stored_shares(spark, where).orderBy("seq").collect()] == [("a", 1, True), ("b", 1, True), ("c", 0, False)]
    assert sorted((r.url, r.files) for r in store.stored_share_files(spark, where).collect()) == [("a", ["w"]), ("b", ["z"])]


def test_export_of_wanted_threads(spark, tmp_path):
    where, out = str(tmp_path / "store"), str(tmp_path / "out")
    heads = thread_rows(spark, ("1", 2, "one"), ("2", 1, "two"), ("3", 0, "empty"))
    body = "![p](https://img.example.com/p.png) https://gofile.io/d/k"
    images = asset_rows(spark, ("1", "https://img.example.com/p.png", "p.png", True), ("2", "https://img.example.com/p.png", "", True))
    shares = share_rows(spark, ("1", "https://gofile.io/d/k", 1, True))
    store.store_threads(where, 0, heads, post_rows(heads, body), images, shares, file_rows(spark, ("1", "https://gofile.io/d/k", 0, ["f"])))
    wanted = spark.createDataFrame([("1",), ("3",), ("9",)], "tid string")
    lacking = store.export_stored(spark, where, out, wanted, fallback())
    assert [(r.tid, r.error) for r in lacking.collect()] == [("9", "thread not found in store")]
    docs = {r.tid: r.markdown for r in store.read_export(spark, f"{out}/documents").collect()}
    assert set(docs) == {"1", "3"} and docs["1"].count("![p](images/p.png) https://gofile.io/d/k (local: shares/c)") == 2
    assert docs["3"].startswith("## empty") and docs["3"].endswith("*\n")
    assert [spark.read.parquet(f"{out}/{t}").count() for t in ("threads", "assets", "shares", "share_files")] == [2, 1, 1, 1]


def test_pages_are_merged_and_published_with_records(spark, tmp_path):
    source, path, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    arrivals(spark, source, *[[("a", 1, page(["m", 1], 2)), ("b", 1, page(["m"], 1))], [("a", 2, page(["m", 2], 2))], [("a", 1, page(["m", 3], 2))], [("c", 1, page(["m"], 1))]])
    ingest.ingest_pages_stream(spark, source, path, progress, max_files_per_trigger=1).awaitTermination()
    before = sorted(map(str, ingest.newest_pages(spark, path).drop("gen").collect()))
    assert [p.name for p in ingest.compact_pages(spark, path, fanout=2)] == ["0-1", "2-3", "0-3"]
    assert sorted(map(str, ingest.newest_pages(spark, path).drop("gen").collect())) == before
    assert ingest.page_state(spark, path).count() == 4 and ingest.expire_pages(spark, path)
    shares = share_rows(spark, ("a", "https://gofile.io/d/k", 1, True))
    ingest.publish(spark, path, 0, fallback(), assets=asset_rows(spark, ("a", "u", "l.png", True)), shares=shares, share_files=file_rows(spark, ("a", "https://gofile.io/d/k", 0, ["f"])))
    assert state(spark, path) == [("a", 0, "m"), ("a", 1, "3"), ("a", 2, "2"), ("b", 0, "m"), ("c", 0, "m")]
    assert [r.local for r in store.stored_assets(spark, path).collect()] == ["l.png"]
    assert [r.files for r in store.stored_share_files(spark, path).collect()] == [["f"]]


def test_publishing_reads_the_buckets_of_touched_threads_only(spark, tmp_path, capsys):
    path = str(tmp_path / "store")
    for gen, tids in enumerate((["a", "b", "c", "d"], ["b"])):
        ingest.ingest_batch(spark.createDataFrame([(t, 1, page(["m", gen], 1)) for t in tids], "tid string, page bigint, html string"), gen, path)
    touched = ingest.touched_threads(spark, path, 1)
    bucket = spark.sql(f"SELECT pmod(xxhash64('b'), {ingest.PAGE_BUCKETS})").first()[0]
    assert [r.tid for r in touched[0].collect()] == ["b"] and touched[1] == [bucket]
    capsys.readouterr()
    ingest.page_state(spark, path, buckets=touched[1]).explain("formatted")
    filters = [line for line in capsys.readouterr().out.splitlines() if "PartitionFilters" in line]
    assert len(filters) == 1 and f"(bucket#" in filters[0] and f"= {bucket})" in filters[0]
    files = ingest.page_state(spark, path, buckets=touched[1]).select(F.input_file_name()).distinct().collect()
    assert len(files) == 2 and all(f"bucket={bucket}/" in f[0] for f in files)
