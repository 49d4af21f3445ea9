import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.functions import dom
from threadloom.functions.text import escape_markdown, post_time, unicode_trim
from threadloom.operators import pages as pages_module
from threadloom.operators.pages import page_plan, parse_pages, register_select_nodes, select_nodes, with_page_fields
from threadloom.operators.posts import extract_posts
from threadloom.page_profile import FORUM
from threadloom.sources.readers import dealt_out, list_assets, read_pages

FALLBACK = "2001-02-03 04:05:06"

# An invented thread about a garden: floor, post id, author, uid, avatar, posts, registered, signature, clock, body.
THREAD = [
    ("GF", "tpc", "Marta 園丁", "41", "https://pics.garden.test/m.png", 12, "2021-03-02", "Compost is patience.", "08:30",
     'Which beans grow in shade?<img src="pics/bean.png" loading="lazy"/>\n  <br/>\n <img src="//pics.garden.test/bed.jpg" onclick="show(&#39;bed&#39;)"/>'),
    ("B1F", "7001", "oleander", "42", "pics/none.png", 0, "2022-11-30", "", "08:45", 'Try runner beans <img src="pics/smile.png"/>'),
    ("B2F", "7002", "Élodie", "43", "pics/e.png", 310, "2019-01-15", "", "09:02", "3 hours of sun are enough, 5 are better"),
    ("B3F", "7005", "Marta 園丁", "41", "https://pics.garden.test/m.png", 12, "2021-03-02", "Compost is patience.", "21:10",
     'Thanks &amp; good night <img src="pics/moon.gif" loading="lazy"/>'),
]


def thread_page():
    posts = "".join(
        f'<table class="js-post"><tr><th class="r_two" id="td_{pid}"><div><a href="u.php?action-show-uid-{uid}.html"><strong> {name} </strong></a></div>'
        f'<img loading="lazy" src="{avatar}"><div class="user-info">发帖: {count}<br>注册时间: {registered}</div><div class="user-info">最后登录: 2024-06-07</div>'
        f'{f"<div class=bianji>（{sign}）</div>" if sign else ""}</th><td><div class="tiptop"><span class="gray">2024-6-7 {clock}</span></div>'
        f'<div id="read_{pid}">\n {html}\t</div></td></tr></table>'
        for _, pid, name, uid, avatar, count, registered, sign, clock, html in THREAD
    )
    return (
        '<html><head><title>Beans for a shady bed</title><base href="//board.garden.test/"></head><body><div id="breadcrumbs"><a class="crumbs-item">home</a>'
        '<a class="crumbs-item gray3">growing</a><a class="crumbs-item gray3">论坛 » Vegetables </a></div><h1 id="subject_tpc"> Beans for a shady bed </h1>'
        f'<a href="read.php?tid-908-ds-1.html">first author only</a><span class="pagesone">Pages: 1/1 &nbsp;</span>{posts}</body></html>'
    )


def parsed(spark, *htmls, **options):
    rows = [("1", i + 1, html) for i, html in enumerate(htmls)]
    return with_page_fields(parse_pages(spark.createDataFrame(rows, "tid string, page bigint, html string"), **options))


def test_whole_thread(spark):
    pages = parsed(spark, thread_page())
    head = pages.select("title", "forum", "base_url", "page_tid", "total_pages", "error").first()
    assert head == ("Beans for a shady bed", "Vegetables", "https://board.garden.test/", "908", 1, None)
    posts = extract_posts(pages, F.lit(FALLBACK).cast("timestamp")).orderBy("ord").collect()
    for post, (floor, pid, name, uid, avatar, count, registered, sign, clock, html) in zip(posts, THREAD, strict=True):
        assert (post.floor, post.post_id, post.content_html) == (floor, pid, html)
        assert post.author == (name, uid, avatar, count, registered, "2024-06-07", sign)
        assert post.post_time == dt.datetime.strptime(f"2024-06-07 {clock}", "%Y-%m-%d %H:%M")


@pytest.mark.parametrize(
    "html, kind, message",
    [
        ("<title>Just a moment...</title><p>We check that you are a person.</p>", "auth_error", "challenge page"),
        ("<html><title>Attention Required! | x</title><body>y</body></html>", "auth_error", "challenge page"),
        ("<body>a <script>CF_CLEARANCE</script></body>", "auth_error", "challenge page"),
        ("<body>Please LOG IN first</body>", "auth_error", "not logged in"),
        ("<body>请先登录</body>", "auth_error", "not logged in"),
        ("<title>Opening hours</title><p>Mondays from nine.</p>", "validation_error", "no post table"),
        ("<table class=js-post><tr><td>log in</table>", "validation_error", "no post content"),
        ("", "validation_error", "no post table"),
    ],
)
def test_page_errors(spark, html, kind, message):
    error = parsed(spark, html).select("error.*").first()
    assert (error.type, error.message) == (kind, message)


@pytest.mark.parametrize(
    "html, tid",
    [
        ("<title>read.php?tid-12-x read.php?tid-9</title><base href='/tid-5'>", "12"),
        ("<title>read.php?tid-x</title><base href='/tid-5'>", "5"),
        ("<title>tid-7</title><a href='tid-x'>a</a><a href='tid-tid-4'>b</a><a href='a-tid-33-tid-4'>b</a>", "33"),
        ("<p>nothing</p>", ""),
    ],
)
def test_thread_id(spark, html, tid):
    assert parsed(spark, html).first().page_tid == tid


@pytest.mark.parametrize(
    "html, n",
    [
        ("<p class=pagesone>Pages: 2/8</p><a href='x-page-99'>", 8),
        ("<p class=pagesone>Pages:\n3/12 x</p>", 12),
        ("<p class=pagesone>none</p><a href='tid-1-page-3.html'>a</a><a href='page-x'>b</a><a href='fpage-11'>c</a>", 11),
        ("<p class=pagesone>Pages: 1/0</p>", 1),
        ("<p>x</p>", 1),
    ],
)
def test_total_pages(spark, html, n):
    assert parsed(spark, html).first().total_pages == n


def test_author_fallbacks(spark):
    html = (
        "<table class=js-post><tr><th id='x'><strong>a</strong><strong>b</strong><p class='user-info'>发帖: 0</p>"
        "<p class='user-info'>UID: 77 发帖:\n 12</p><p class='user-info'>UID: 88 发帖: 99</p><td><a href='p#1#z9'>k</a></table>"
    )
    post = extract_posts(parsed(spark, html), F.lit(FALLBACK).cast("timestamp")).first()
    assert (post.author.username, post.author.uid, post.author.post_count) == ("ab", "77", 12)
    assert (post.post_id, post.post_time, post.content_html) == ("z9", None, "")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2025-8-5 1:02:03", "2025-08-05 01:02:03"),
        (" 2025-08-05 11:02 ", "2025-08-05 11:02:00"),
        ("2025-8-5 1:02:03.250", "2025-08-05 01:02:03"),
        ("0000-3-4 5:06", "2001-03-04 05:06:00"),
        ("2025-02-30 1:00", FALLBACK),
        ("2025-8-5 1:2", FALLBACK),
        ("", FALLBACK),
        (None, None),
    ],
)
def test_post_time(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(
        F.date_format(post_time(F.col("t"), F.lit(FALLBACK).cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("p")
    )
    assert row.first().p == expected


def test_text_functions(spark):
    row = spark.range(1).select(
        unicode_trim(F.lit("　 \t a b\u0085\n")).alias("t"), escape_markdown(F.lit("a\\`*_{}[]()#+-.!|<>b")).alias("e")
    ).first()
    assert row.t == "a b"
    assert row.e == "a\\\\\\`\\*\\_\\{\\}\\[\\]\\(\\)\\#\\+\\-\\.\\!\\|<>b"


def test_page_plan(spark):
    plan = page_plan(spark.createDataFrame([("7", 3), ("8", 1), ("9", 25)], "tid string, total_pages bigint"), "https://f.org//", block=10)
    rows = {(r.tid, r.page): r.url for r in plan.collect()}
    assert len(rows) == 29
    assert rows["7", 1] == "https://f.org/read.php?tid-7.html"
    assert rows["9", 25] == "https://f.org/read.php?tid-9-page-25.html"


def test_select_nodes_and_sql_form(spark):
    df = spark.createDataFrame([(1, "<nav><a href=x>A</a><a href=y>B<i>c</i></a></nav>"), (2, "<a>z</a>")], "id int, html string")
    rows = select_nodes(df, "nav a").orderBy("ord").collect()
    assert [(r.id, r.ord, r.tag, r.attrs, r.text, r.inner_html) for r in rows] == [
        (1, 0, "a", {"href": "x"}, "A", "A"), (1, 1, "a", {"href": "y"}, "Bc", "B<i>c</i>"),
    ]
    register_select_nodes(spark)
    df.createOrReplaceTempView("node_pages")
    assert spark.sql("SELECT id, n.text FROM node_pages, LATERAL select_nodes(html, 'nav a') n ORDER BY n.ord").collect() == [(1, "A"), (1, "Bc")]
    assert select_nodes(df, "a[").count() == 0


def test_read_pages_from_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.html").write_text("<title>1</title>\n")
    (tmp_path / "d" / "b.html").write_text("<title>2</title>")
    read = read_pages(spark, str(tmp_path))
    assert sorted(r.html for r in read.collect()) == ["<title>1</title>\n", "<title>2</title>"]
    assert dealt_out(read, "page_id").count() == 2
    listed = {(r.path, r["size"]) for r in list_assets(spark, str(tmp_path)).collect()}
    assert listed == {("a.html", 17), ("d/b.html", 16)}


def test_a_page_that_fails_is_an_error_row(spark, monkeypatch):
    real = dom.parse

    def breaking(text):
        if "boom" in text:
            raise ValueError("broken")
        return real(text)

    monkeypatch.setattr(dom, "parse", breaking)
    reader = pages_module._page_reader(FORUM, ["page"], True, True, False)
    batch = pa.RecordBatch.from_pydict({"page": [1, 2], "html": ["<p>boom", "<title>fine</title>"]})
    rows = next(reader(iter([batch]))).to_pylist()
    assert rows[0]["parse_error"] == "ValueError: broken" and rows[1]["parse_error"] is None
    assert rows[1]["page_title_text"] == "fine"
