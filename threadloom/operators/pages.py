"""Pages to parsed pages, and the page-level fields that follow from them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from threadloom.functions import dom, markdown_text
from threadloom.functions.text import unicode_trim
from threadloom.page_profile import FORUM, PageProfile
from threadloom.sources.tables import POST_NODES

PARSED_FIELDS = T.StructType(
    [
        T.StructField("title_text", T.StringType()),
        T.StructField("page_title_text", T.StringType()),
        T.StructField("body_text", T.StringType()),
        T.StructField("base_href", T.StringType()),
        T.StructField("forum_text", T.StringType()),
        T.StructField("pages_text", T.StringType()),
        T.StructField("tid_links", T.ArrayType(T.StringType())),
        T.StructField("page_links", T.ArrayType(T.StringType())),
        # Kept beside the posts, so that checks and positions can be worked out without reading them.
        T.StructField("n_posts", T.IntegerType()),
        T.StructField("first_has_content", T.BooleanType()),
        T.StructField("first_time_text", T.StringType()),
        T.StructField("parse_error", T.StringType()),
        T.StructField("posts", T.ArrayType(POST_NODES)),
    ]
)


def _with_carried(batch: pa.RecordBatch, names: list[str], fields: pa.RecordBatch) -> pa.RecordBatch:
    """Carried columns as they came, followed by the new ones."""
    return pa.RecordBatch.from_arrays(
        [batch.column(name) for name in names] + fields.columns, names=names + fields.schema.names
    )


def _page_reader(profile: PageProfile, keep: list[str], with_posts: bool, with_html: bool, with_markdown: bool):
    """Function over Arrow batches that turns the html column into the fields above."""
    schema = to_arrow_schema(PARSED_FIELDS)

    def first_attr(scope, selector, attr):
        found = scope.select(selector)
        return found[0].attrs.get(attr, "") if found else ""

    def joined_text(scope, selector):
        return "".join(node.text() for node in scope.select(selector))

    def first_text(scope, selector):
        found = scope.select(selector)
        return found[0].text() if found else None

    def post_of(ord_, table):
        scope = dom.Scope(table)
        content = scope.select(profile.post_content)
        linked = scope.select('a[href*="u.php"] strong')
        # Where the author block keeps its fields.
        return {
            "ord": ord_,
            "user_link_strong": "".join(node.text() for node in linked),
            "has_user_link_strong": bool(linked),
            "any_strong": joined_text(scope, "strong"),
            "user_href": first_attr(scope, 'a[href*="u.php"]', "href"),
            "avatar_src": first_attr(scope, 'img[loading="lazy"]', "src"),
            "infos": [node.text() for node in scope.select(".user-info")],
            "sign_text": joined_text(scope, ".bianji"),
            "time_text": first_text(scope, profile.post_time),
            "has_content": bool(content),
            "content_html": content[0].inner_html() if content and with_html else "",
            "content_md": markdown_text.to_markdown(content[0], profile.site_root) if content and with_markdown else "",
            "td_id": first_attr(scope, 'th[id^="td_"]', "id"),
            "read_id": first_attr(scope, '[id^="read_"]', "id"),
            "hash_href": first_attr(scope, 'a[href*="#"]', "href"),
        }

    def page_of(html):
        scope = dom.Scope(dom.parse(html))
        tables = scope.select(profile.post_table)
        posts = [post_of(i, table) for i, table in enumerate(tables if with_posts else tables[:1])]
        return {
            "title_text": first_text(scope, profile.title),
            "page_title_text": first_text(scope, "title") or "",
            # Only needed to tell why a page has no post table.
            "body_text": "" if tables else joined_text(scope, "body"),
            "base_href": first_attr(scope, "base", "href"),
            "forum_text": first_text(scope, profile.forum),
            "pages_text": first_text(scope, ".pagesone") or "",
            "tid_links": [node.attrs["href"] for node in scope.select("a[href*='tid-']")],
            "page_links": [node.attrs["href"] for node in scope.select("a[href*='page-']")],
            "n_posts": len(tables),
            "first_has_content": bool(posts) and posts[0]["has_content"],
            "first_time_text": posts[0]["time_text"] if posts else None,
            "posts": posts if with_posts else None,
        }

    def safe_page_of(html):
        """One page that cannot be read is an error row, not the end of the job."""
        try:
            return page_of(html)
        except Exception as error:  # noqa: BLE001
            return {"tid_links": [], "page_links": [], "n_posts": 0, "first_has_content": False, "parse_error": f"{type(error).__name__}: {error}"}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [safe_page_of(html) for html in batch.column("html").to_pylist()]
            yield _with_carried(batch, keep, pa.RecordBatch.from_pylist(pages, schema))

    return read


def parse_pages(
    df: DataFrame, profile: PageProfile = FORUM, with_html: bool = True, with_markdown: bool = False, with_posts: bool = True
) -> DataFrame:
    """Parse the ``html`` column once per page. Other columns are carried along; keep them few and small.

    Spark cannot see into the parser, so what is not needed is switched off here: post bodies as HTML or Markdown, or
    the posts altogether when only page-level fields are wanted.
    """
    keep = [field for field in df.schema.fields if field.name != "html"]
    schema = T.StructType(keep + PARSED_FIELDS.fields)
    reader = _page_reader(profile, [field.name for field in keep], with_posts, with_html, with_markdown)
    return df.mapInArrow(reader, schema)


NODE_FIELDS = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("inner_html", T.StringType()),
    ]
)


def select_nodes(df: DataFrame, selector: str) -> DataFrame:
    """One row per matching element, in document order; replaces the ``html`` column by the node fields."""
    keep = [field for field in df.schema.fields if field.name != "html"]
    names = [field.name for field in keep]

    schema = to_arrow_schema(NODE_FIELDS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, source = [], []
            for at, html in enumerate(batch.column("html").to_pylist()):
                for i, node in enumerate(dom.Scope(dom.parse(html)).select(selector)):
                    source.append(at)
                    rows.append(
                        {"ord": i, "tag": node.tag, "attrs": list(node.attrs.items()), "text": node.text(), "inner_html": node.inner_html()}
                    )
            taken = batch.take(pa.array(source, pa.int64()))
            yield _with_carried(taken, names, pa.RecordBatch.from_pylist(rows, schema))

    return df.mapInArrow(find, T.StructType(keep + NODE_FIELDS.fields))


def register_select_nodes(spark) -> None:
    """Make ``LATERAL select_nodes(html, selector)`` available in SQL."""

    @F.udtf(useArrow=True, returnType="ord int, tag string, attrs map<string,string>, text string, inner_html string")
    class SelectNodes:
        def eval(self, html: str, selector: str):
            for i, node in enumerate(dom.Scope(dom.parse(html)).select(selector)):
                yield i, node.tag, node.attrs, node.text(), node.inner_html()

    spark.udtf.register("select_nodes", SelectNodes)


# Page-level expressions over the parsed columns.


def page_title() -> Column:
    return unicode_trim(F.coalesce("title_text", F.lit("")))


def forum_name() -> Column:
    """Last part of the breadcrumb."""
    return unicode_trim(F.expr("element_at(split(coalesce(forum_text, ''), '»'), -1)"))


def base_url() -> Column:
    return F.expr("CASE WHEN startswith(base_href, '//') THEN 'https:' || base_href ELSE base_href END")


def thread_id() -> Column:
    """From the page title, else the base URL, else the first link that has one.

    In each it is the first run of digits between the first and the second marker.
    """
    digits = "regexp_extract(split_part({}, '{}', 2), '([0-9]+)', 1)".format
    return F.expr(
        f"""coalesce(nullif({digits("page_title_text", "read.php?tid-")}, ''), nullif({digits("base_href", "tid-")}, ''),
          get(filter(transform(tid_links, href -> {digits("href", "tid-")}), d -> d <> ''), 0), '')"""
    )


def total_pages() -> Column:
    """Stated page count, else the highest linked page; at least 1."""
    return F.expr(
        r"""greatest(1L, coalesce(try_cast(regexp_extract(pages_text, r'Pages:[\t\n\f\r ]*[0-9]+/([0-9]+)', 1) AS BIGINT),
          array_max(transform(page_links, href -> try_cast(regexp_extract(href, 'page-([0-9]+)', 1) AS BIGINT))), 0L))"""
    )


# Words by which a page without posts is told apart.
CHALLENGE_TITLES = ("just a moment", "attention required")
CHALLENGE_BODY = ("cloudflare", "cf-challenge", "cf-browser-verification", "cf_clearance")
LOGIN_BODY = ("登录", "log in", "please login", "winduser")


def page_error() -> Column:
    """NULL for a page with a usable first post, else struct(type, code, message)."""

    def any_of(text: str, words: tuple[str, ...]) -> str:
        return "(" + " OR ".join(f"contains(lower({text}), '{word}')" for word in words) + ")"

    def error(kind: str, code: str, message: str) -> str:
        return f"named_struct('type', '{kind}', 'code', '{code}', 'message', '{message}')"

    return F.expr(
        f"""CASE WHEN parse_error IS NOT NULL THEN {error("validation_error", "VALID001", "page not readable")}
          WHEN first_has_content THEN NULL
          WHEN n_posts > 0 THEN {error("validation_error", "VALID001", "no post content")}
          WHEN {any_of("page_title_text", CHALLENGE_TITLES)} OR {any_of("body_text", CHALLENGE_BODY)}
            THEN {error("auth_error", "AUTH001", "challenge page")}
          WHEN {any_of("body_text", LOGIN_BODY)} THEN {error("auth_error", "AUTH001", "not logged in")}
          ELSE {error("validation_error", "VALID001", "no post table")} END"""
    )


def with_page_fields(parsed: DataFrame) -> DataFrame:
    """Parsed pages plus title, forum, base_url, page_tid, total_pages and error."""
    return parsed.select(
        "*",
        page_title().alias("title"),
        forum_name().alias("forum"),
        base_url().alias("base_url"),
        thread_id().alias("page_tid"),
        total_pages().alias("total_pages"),
        page_error().alias("error"),
    )


def resolve_thread_id(pages: DataFrame) -> DataFrame:
    """with_page_fields() rows with ``tid`` as the page itself states it, else as given; ``tid_error`` is set where neither does.

    A page stays one row in either case, so that what cannot be assigned to a thread is seen and not lost.
    """
    tid = F.coalesce(F.nullif(F.col("page_tid"), F.lit("")), F.nullif(F.col("tid"), F.lit("")), F.lit(""))
    rows = pages.withColumn("tid", tid)
    return rows.withColumn("tid_error", F.when(F.col("tid") == "", "thread id unknown").otherwise(""))


def page_plan(threads: DataFrame, base: Column | str, block: int = 10_000) -> DataFrame:
    """Rows (tid, page, url) for pages 1..total_pages of each thread.

    Page numbers unfold in two steps with a shuffle between them, so one huge thread neither builds one huge array nor
    stays in one task.
    """
    root = F.rtrim(F.lit(base) if isinstance(base, str) else base, F.lit("/"))
    blocks = threads.select(
        "tid",
        "total_pages",
        root.alias("_root"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total_pages") - 1) / block))).alias("_b"),
    ).repartition("tid", "_b")
    pages = blocks.select(
        "tid",
        "_root",
        F.explode(
            F.sequence(F.col("_b") * block + 1, F.least((F.col("_b") + 1) * block, F.col("total_pages")))
        ).alias("page"),
    )
    first = F.concat("_root", F.lit("/read.php?tid-"), "tid", F.lit(".html"))
    later = F.concat("_root", F.lit("/read.php?tid-"), "tid", F.lit("-page-"), "page", F.lit(".html"))
    return pages.select("tid", "page", F.when(F.col("page") <= 1, first).otherwise(later).alias("url"))
