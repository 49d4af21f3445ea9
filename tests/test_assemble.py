import pytest
from pyspark.sql import functions as F

from threadloom.operators import assemble
from threadloom.operators.markdown import render_posts, render_threads
from threadloom.operators.pages import page_plan, parse_pages, with_page_fields
from threadloom.session import written

def fallback():
    return F.lit("2001-02-03 04:05:06").cast("timestamp")



def post(pid):
    return f"<table class=js-post><tr><th id=td_{pid}><strong>u</strong><td><p class=tiptop><i class=gray>2024-1-1 1:00</i><div id=read_{pid}>c {pid}</div></table>"


def page(ids, n, title="T"):
    return f"<h1 id=subject_tpc>{title}</h1><p class=pagesone>Pages: 1/{n}</p>" + "".join(map(post, ids))


def pages_of(spark, rows):
    df = spark.createDataFrame(rows, "tid string, page bigint, html string")
    return written(with_page_fields(parse_pages(df, with_markdown=True)), "test-pages")


@pytest.fixture(scope="module")
def threads(spark):
    rows = [
        ("a", 1, page(["m", 1, 2], 3)), ("a", 2, page(["m", 3], 3)), ("a", 3, page(["m", 4, 5], 3)),
        ("b", 1, page(["m", 1], 3)), ("b", 3, page(["m", 2], 3)),
        ("c", 2, page(["m", 1], 2)),
        ("d", 1, "<p>hello"), ("d", 2, page(["m", 1], 2)),
        ("e", 1, page(["m"], 2)), ("e", 2, "<p>no posts"), ("e", 3, page(["m", 9], 2)),
    ]
    return pages_of(spark, rows)


def ids(posts):
    out = {}
    for r in posts.orderBy("tid", "position").collect():
        out.setdefault(r.tid, []).append((r.position, r.floor, r.post_id))
    return out


def test_checks(threads):
    got = {r.tid: tuple(r)[1:] for r in assemble.thread_checks(threads).collect()}
    assert got == {
        "a": (3, 3, 0, True, True), "b": (3, 2, 1, True, True), "c": (2, 1, 1, False, False), "d": (1, 1, 0, False, True), "e": (2, 2, 0, True, True)
    }


def test_rejected_threads(threads):
    checks = assemble.thread_checks(threads)
    reasons = lambda strict: {r.tid: r.reason for r in assemble.rejected_threads(checks, strict).collect()}
    assert reasons(False) == {"c": "first page absent", "d": "first page in error"}
    assert reasons(True) == reasons(False) | {"b": "pages missing"}


def test_strict_and_lenient(threads):
    checks = assemble.thread_checks(threads)
    accepted = lambda strict: {r.tid for r in assemble.page_completeness(checks, strict).where("accepted").collect()}
    assert accepted(True) == {"a", "e"}
    assert accepted(False) == {"a", "b", "e"}


def test_reference_mode(threads):
    heads, posts = assemble.assemble(threads, fallback(), strict=False)
    assert ids(posts) == {
        "a": [(0, "GF", "m"), (1, "B1F", "1"), (2, "B2F", "2"), (3, "B1F", "3"), (4, "B1F", "4"), (5, "B2F", "5")],
        "b": [(0, "GF", "m"), (1, "B1F", "1"), (2, "B1F", "2")],
        "e": [(0, "GF", "m")],
    }
    assert [(r.tid, r.title, r.total_floors) for r in heads.orderBy("tid").collect()] == [("a", "T", 6), ("b", "T", 3), ("e", "T", 1)]


def test_continuous_mode(spark):
    pages = pages_of(spark, [("a", 1, page(["m", 1], 2)), ("a", 2, page([2, 3], 2))])
    _, posts = assemble.assemble(pages, fallback(), mode="continuous", repeats_main_post=False)
    assert ids(posts) == {"a": [(0, "GF", "m"), (1, "B1F", "1"), (2, "B2F", "2"), (3, "B3F", "3")]}
    _, lossy = assemble.assemble(pages, fallback())
    assert ids(lossy) == {"a": [(0, "GF", "m"), (1, "B1F", "1"), (2, "B1F", "3")]}


def test_missing_pages(threads):
    plan = page_plan(threads.where("page = 1").select("tid", "total_pages"), "https://f.org")
    missing = assemble.missing_pages(plan, threads)
    assert [(r.tid, r.page) for r in missing.collect()] == [("b", 2)]
    lists = assemble.missing_page_lists(spark_range(threads, 25), block=10).orderBy("block").collect()
    assert [r.missing for r in lists] == [list(range(1, 11)), list(range(11, 21)), list(range(21, 26))]


def spark_range(df, n):
    return df.sparkSession.range(1, n + 1).select(F.lit("t").alias("tid"), F.col("id").alias("page"))


def test_a_huge_thread_is_cut_into_parts(spark):
    """One thread of 400 pages among small ones: positions run on, parts join to the whole text."""
    rows = [("hot", p, page(["m", f"{p}x", f"{p}y"], 400)) for p in range(1, 401)] + [(str(t), 1, page(["m"], 1)) for t in range(50)]
    pages = pages_of(spark, rows)
    threads, posts = assemble.assemble(pages, fallback())
    hot = posts.where("tid = 'hot'").orderBy("position").select("position", "post_id").collect()
    assert [r.position for r in hot] == list(range(801))
    assert [r.post_id for r in hot[:4]] == ["m", "1x", "1y", "2x"] and hot[-1].post_id == "400y"
    made = F.lit("2024-05-06 07:08:09").cast("timestamp")
    whole = {r.tid: r.markdown for r in render_threads(threads, render_posts(posts), made, part_posts=10**6).collect()}
    parts = render_threads(threads, render_posts(posts), made, part_posts=37).orderBy("tid", "part").collect()
    joined = {}
    for r in parts:
        joined[r.tid] = joined.get(r.tid, "") + r.markdown
    assert joined == whole
    assert sum(r.tid == "hot" for r in parts) == 22
    assert whole["3"] == (
        "## T\n\n----\n\n##### <span id=\"pidm\">0.[0] \\<pid:m\\> 2024-01-01 01:00:00 by UID:(u)</span>\n\nc m\n\n\n"
        "---\n\n*本文档由 threadloom 自动生成*\n\n*生成时间: 2024-05-06 07:08:09*\n"
    )


def test_reply_blocks(threads):
    _, posts = assemble.assemble(threads, fallback())
    blocks = assemble.reply_blocks(posts, block=2).where("tid = 'a'").orderBy("block").collect()
    assert [[r.post_id for r in b.replies] for b in blocks] == [["1", "2"], ["3", "4"], ["5"]]
