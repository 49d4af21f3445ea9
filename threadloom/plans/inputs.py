"""Inputs of the registered queries, derived by Spark from the given tables.

Every table goes in whole. Where records are left out by a rule (an asset never fetched, a page lost), the operator under
test is the one that has to find that out.

Forum markup is written from ``conversations`` and read back by the operators; the check SQL works on ``conversations``
directly and never sees HTML.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.urls import host_port
from threadloom.operators.spread import lookup
from threadloom.session import configure

START = 1704067200  # 2024-01-01 00:00:00 UTC
NOW = "2025-06-01 00:00:00"
GENERATED_AT = "2025-06-01 12:00:00"
FALLBACK = "2001-02-03 04:05:06"
REPLIES_PER_PAGE = 3
# Pages of one thread that share a block when page counts are looked up.
THREAD_BLOCK = 3000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def timestamp(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations with thread fields: tid, post_id, uid, ts, page."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id",
        "turn",
        "role",
        "text",
        "string(conv_id) AS tid",
        "CASE WHEN turn = 0 THEN 'tpc' ELSE string(conv_id * 100000 + turn) END AS post_id",
        "string(conv_id * 10 + length(role)) AS uid",
        f"timestamp_seconds({START} + conv_id * 3600 + turn * 60) AS ts",
        f"CASE WHEN turn = 0 THEN 1L ELSE (turn - 1) div {REPLIES_PER_PAGE} + 1 END AS page",
    )


# A post as forum markup. Some posts have no content, no time, no cell id or an unreadable time.
_NO_CONTENT = "((conv_id % 20 = 18 AND turn = 0) OR (conv_id % 20 = 8 AND turn = 2))"
_USER = """CASE role WHEN 'system' THEN '<strong>system</strong>'
  WHEN 'assistant' THEN '<a href="u.php?action-show.html"><strong>assistant</strong></a>'
  ELSE '<a href="u.php?uid-' || uid || '.html"><strong>' || role || '</strong></a>' END"""
_INFO = """'<div class="user-info">UID: ' || uid || '</div><div class="user-info">发帖: ' || turn * 37 % 500
  || ' 注册时间: 2020-01-' || lpad(conv_id % 28 + 1, 2, '0') || ' 最后登录: 2024-02-' || lpad(conv_id % 28 + 1, 2, '0') || '</div>'"""
_SIGN = """CASE WHEN turn % 2 = 0 THEN '<div class="bianji"> （by ' || role || '） </div>' ELSE '' END"""
_TIME = """CASE WHEN conv_id % 10 = 8 AND turn = 1 THEN '' ELSE '<div class="tiptop"><span class="gray"> '
  || CASE WHEN conv_id % 10 = 7 AND turn = 1 THEN 'yesterday' WHEN turn % 2 = 0 THEN date_format(ts, 'yyyy-M-d H:mm:ss')
    ELSE date_format(ts, 'yyyy-M-d H:mm') END || '</span></div>' END"""
_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '\\'', '&#39;')"
_BODY = f"""replace({_ESCAPED}, '\\n', '<br>')
  || CASE WHEN turn % 3 = 1 THEN '<br><img src="//img.example.com/' || conv_id % 20 || '.png" alt="pic" loading="lazy">' ELSE '' END
  || CASE WHEN turn % 4 = 2 THEN '<br>https://gofile.io/d/s' || conv_id % 20 ELSE '' END"""
_POST_TABLE = f"""'<table class="t5 js-post"><tr>'
  || CASE WHEN {_NO_CONTENT} OR conv_id % 3 = 1 THEN '<th>' ELSE '<th class="r_two" id="td_' || post_id || '">' END
  || {_USER} || '<img src="face/' || uid || '.png" loading="lazy">' || {_INFO} || {_SIGN} || '</th><td>' || {_TIME}
  || CASE WHEN {_NO_CONTENT} THEN '<a href="read.php?tid-0.html#' || post_id || '">link</a>'
    ELSE '<div id="read_' || post_id || '">\\n' || {_BODY} || ' </div>' END || '</td></tr></table>'"""

# A page around its post tables.
_GOOD_PAGE = """'<!DOCTYPE html><html><head><meta charset="utf-8"><title>'
  || CASE WHEN conv_id % 3 = 0 THEN 'Topic read.php?tid-' || tid || '.html - Board' ELSE 'Topic' END || '</title><base href="'
  || CASE WHEN conv_id % 3 = 1 THEN '//forum.example.org/read.php?tid-' || tid || '.html' ELSE 'https://forum.example.org/' END
  || '"></head><body><div id="breadcrumbs"><a class="crumbs-item">Home</a><a class="crumbs-item gray3">All</a><a class="crumbs-item gray3"> '
  || CASE WHEN conv_id % 4 = 0 THEN '' ELSE 'Home » ' END || 'Board ' || conv_id % 7 || ' </a></div><h1 id="subject_tpc">&nbsp; Topic #' || tid
  || ' (a_b) &amp; more!\\n</h1><a href="index.php">i</a><a href="read.php?tid-x.html">x</a><a href="read.php?tid-' || tid || '-fpage-1.html">t</a>'
  || CASE WHEN conv_id % 2 = 0 THEN '<span class="pagesone">Pages: ' || page || '/' || n_pages || '</span>'
    ELSE '<a href="read.php?tid-' || tid || '-page-' || page || '.html">this</a><a href="read.php?tid-' || tid || '-page-' || n_pages || '.html">last</a>' END
  || tables || '</body></html>'"""
_BAD_PAGE = """CASE conv_id div 10 % 3
  WHEN 0 THEN '<html><head><title>Just a moment...</title></head><body><p>Checking</p></body></html>'
  WHEN 1 THEN '<html><head><title>Notice</title></head><body><div>请先登录</div></body></html>'
  ELSE '<html><head><title>Notice</title></head><body>nothing here</body></html>' END"""


def forum_pages(spark: SparkSession, sf_dir: str, repeats: bool = True) -> DataFrame:
    """Forum pages (tid, page, url, html), three replies each.

    With ``repeats``, later pages show the main post first as well. Threads with conv_id % 10 = 9 have no posts on their
    pages: a challenge, a login notice or a plain text instead.
    """
    posts = turns(spark, sf_dir)
    heads = posts.groupBy("conv_id").agg(F.expr(f"greatest((max(turn) - 1) div {REPLIES_PER_PAGE} + 1, 1L)").alias("n_pages"))
    rows = lookup(
        posts.selectExpr("conv_id", "tid", "page", "turn", f"{_POST_TABLE} AS post_html"), heads, ["conv_id"], F.expr(f"turn div {THREAD_BLOCK}")
    )
    pages = rows.groupBy("conv_id", "tid", "page", "n_pages").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(turn, post_html))), r -> r.post_html), '\\n')").alias("tables")
    )
    if repeats:
        mains = posts.where("turn = 0").selectExpr("conv_id", f"{_POST_TABLE} AS main_html")
        pages = lookup(pages, mains, ["conv_id"], F.expr(f"page div {THREAD_BLOCK}"), "left").selectExpr(
            "conv_id", "tid", "page", "n_pages", "CASE WHEN page > 1 THEN main_html || tables ELSE tables END AS tables"
        )
    return pages.selectExpr(
        "tid", "page", "'https://forum.example.org/read.php?tid-' || tid || '-page-' || page AS url",
        f"CASE WHEN conv_id % 10 = 9 THEN {_BAD_PAGE} ELSE {_GOOD_PAGE} END AS html",
    )


def kept_pages(pages: DataFrame) -> DataFrame:
    """Pages that arrived: some later ones are lost."""
    return pages.where("NOT (page > 1 AND (bigint(tid) * 7 + page) % 11 = 0)")


def linked_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with image and share links added: (doc_id, tid, position, md)."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "string(doc_id div 5) AS tid",
        "doc_id % 5 AS position",
        """text || '\\n\\n![a](https://cdn.example.com/' || doc_id % 50 || '.jpg)\\n[plain](https://cdn.example.com/' || doc_id % 50
          || '.jpg) ![rel](pics/' || doc_id % 9 || '.png "t")'
          || CASE WHEN doc_id % 2 = 0 THEN '\\n![b]( <https://cdn.example.com/b/' || doc_id % 30 || '.gif?x=1> "title")\\nsee https://gofile.io/d/c'
            || doc_id % 20 ELSE '' END
          || CASE WHEN doc_id % 3 = 0 THEN ' and http://www.gofile.io/d/c' || doc_id % 20 || ' again https://gofile.io/d/c' || doc_id % 20
            || ' ![a](https://cdn.example.com/' || doc_id % 50 || '.jpg)' ELSE '' END AS md""",
    )


def asset_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset records for some of those images; some unusable, some superseded."""
    docs = table(spark, sf_dir, "documents").select("doc_id")

    def records(where: str, url: str, local: str, downloaded: str, seq: str) -> DataFrame:
        return docs.where(where).selectExpr(
            "string(doc_id div 5) AS tid", f"{url} AS url", f"{local} AS local", "'' AS alt", "doc_id * 3 AS file_size",
            f"{downloaded} AS downloaded", f"{seq} AS seq",
        )

    a = "'https://cdn.example.com/' || doc_id % 50 || '.jpg'"
    b = "'https://cdn.example.com/b/' || doc_id % 30 || '.gif?x=1'"
    return (
        records("doc_id % 3 <> 2", a, "CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'a' || doc_id % 50 || '.jpg' END", "doc_id % 7 <> 0", "doc_id")
        .unionByName(records("doc_id % 4 = 0", b, "'b' || doc_id % 30 || '.gif'", "true", "doc_id"))
        .unionByName(records("doc_id % 6 = 0", a, "'late' || doc_id % 50 || '.jpg'", "doc_id % 12 = 0", "doc_id + 1000000000000"))
    )


def linked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An asset record for the first image of each post, as a new run would make it."""
    return table(spark, sf_dir, "documents").selectExpr(
        "string(doc_id div 5) AS tid", "'https://cdn.example.com/' || doc_id % 50 || '.jpg' AS url", "md5(text) || '.jpg' AS local", "'' AS alt",
        "bigint(octet_length(text)) AS file_size", "true AS downloaded", "doc_id AS seq",
    )


def share_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(old, new) share records for some of those share links."""
    docs = table(spark, sf_dir, "documents").select("doc_id")

    def records(where: str, downloaded: str, folder: str) -> DataFrame:
        return docs.where(where).selectExpr(
            "string(doc_id div 5) AS tid",
            "'https://gofile.io/d/c' || doc_id % 20 AS url",
            "'c' || doc_id % 20 AS content_id",
            f"'{folder}/c' || doc_id % 20 AS local_dir",
            f"CASE WHEN {downloaded} THEN doc_id % 4 + 1 ELSE 0L END AS n_files",
            f"{downloaded} AS downloaded",
            f"CASE WHEN {downloaded} THEN '' ELSE 'download_failed' END AS error",
            "doc_id AS seq",
        )

    return records("doc_id % 2 = 0", "doc_id % 5 <> 0", "shares"), records("doc_id % 4 = 0", "doc_id % 8 = 0", "new")


def share_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local files of shared content: (tid, content_id, path); partial files among them."""
    return table(spark, sf_dir, "documents").selectExpr(
        "source AS tid",
        "'c' || doc_id % 20 AS content_id",
        "lang || '/' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '.part' ELSE '.txt' END AS path",
    )


def share_wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share links per source: (tid, url, seq); some content was never fetched."""
    d = F.col("doc_id")
    return (
        table(spark, sf_dir, "documents")
        .groupBy(F.col("source").alias("tid"), F.concat(F.lit("https://gofile.io/d/c"), (d % 25).cast("string")).alias("url"))
        .agg(F.min("doc_id").alias("seq"))
    )


def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule file line for each page: (seq, line), of every kind the format knows."""
    p = F.col("page_id")
    host = host_port(F.col("url"))
    name = F.concat(F.lit("n"), (p % 5).cast("string"))
    value = F.concat(F.lit("v"), p.cast("string"))
    segment = F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]*)", 1))
    parent = F.regexp_replace(host, r"^[^.]*\.", "")

    def line(*fields) -> Column:
        return F.concat_ws("\t", *[F.lit(f) if isinstance(f, str) else f for f in fields])

    kinds = [
        line(host, "FALSE", "/", "FALSE", "0", name, value),
        line(F.concat(F.lit("."), host), "TRUE", "/", "TRUE", "2147483647", name, value),
        line(host, "true", segment, "FALSE", "1801598486", name, value),
        line(F.concat(F.lit("#HttpOnly_"), host), "FALSE", segment, "TRUE", "0", name, value),
        F.concat(F.lit("# comment "), host),
        line(host, "FALSE", "/", "FALSE", "1000000000", name, value),
        line(host, "TRUE", "/"),
        line(host, "FALSE", "/", "FALSE", "-5", name, value, "more"),
        line(host, "FALSE", "/", "FALSE", "0", name, ""),
        F.concat(F.lit("  "), F.concat_ws(" ", host, F.lit("TRUE"), F.lit("/"), F.lit("FALSE"), F.lit("soon"), name, value), F.lit(" ")),
        line(parent, "TRUE", F.substr(segment, F.lit(2)), "FALSE", "0", name, value),
        line(F.concat(F.lit("."), parent), "FALSE", "/", "FALSE", "0", name, value),
        F.lit("   "),
    ]
    text = kinds[-1]
    for i, kind in enumerate(kinds[:-1]):
        text = F.when(p % 13 == i, kind).otherwise(text)
    return table(spark, sf_dir, "pages").select(p.alias("seq"), text.alias("line"))


def observed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as responses would set them, one per page."""
    p = F.col("page_id")
    host = host_port(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        p.alias("seq"),
        F.concat(F.lit("s"), (p % 4).cast("string")).alias("name"),
        F.concat(F.lit("v"), p.cast("string")).alias("value"),
        F.when(p % 3 == 0, F.concat(F.lit("."), host)).otherwise("").alias("domain"),
        F.when(p % 2 == 0, "/en").otherwise("").alias("path"),
        F.lit(None).cast("timestamp").alias("expires"),
        (p % 3 * 60).cast("int").alias("max_age"),
        (p % 7 == 0).alias("secure"),
        (p % 5 == 0).alias("http_only"),
        (p % 6).cast("int").alias("same_site_code"),
        host.alias("response_host"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a request log: url, seq (order of tries), status, error_kind."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", 200).when(kind == "click", 503).when(kind == "signup", 404).when(kind == "purchase", 301).otherwise(0)
    )
    failed = F.when(F.col("event_id") % 2 == 0, "timeout").otherwise("reset")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"),
        F.struct("ts", "event_id").alias("seq"),
        status.cast("bigint").alias("status"),
        F.when(kind == "error", failed).otherwise("").alias("error_kind"),
    )


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a transfer log; every header form occurs."""
    e = F.col("event_id")
    s = lambda x: x.cast("string")
    size = e % 1000 + 10
    part = F.when(e % 4 == 0, e % 7).otherwise(0).cast("bigint")
    status = F.get(F.array(*[F.lit(x) for x in (200, 206, 200, 404, 206, 500, 200, 302)]), (e % 8).cast("int"))
    content_type = F.when(e % 17 == 0, "Text/HTML; charset=utf-8").otherwise("application/octet-stream")
    prefix = F.when(e % 19 == 0, "\n <!DOCTYPE HTML><html>").when(e % 23 == 0, "<HTML>").otherwise(F.concat(F.lit("data "), "props"))
    length = (
        F.when(e % 5 == 0, "").when(e % 31 == 0, "many").when(e % 29 == 0, F.concat(F.lit(" +"), s(size), F.lit(" bytes"))).otherwise(s(size))
    )
    ranged = (
        F.when(e % 12 == 0, F.concat(F.lit("bytes 0-1/"), s(size))).when(e % 12 == 4, F.concat(F.lit("bytes 0-1/"), s(size), F.lit("/2")))
        .when(e % 60 == 8, "bytes 0-1/*").otherwise("")
    )
    on_disk = F.when(e % 3 == 0, size).when(e % 3 == 1, size + part).otherwise(size - 1)
    return table(spark, sf_dir, "events").select(
        "event_id", status.alias("status"), content_type.alias("content_type"), prefix.alias("body_prefix"),
        length.alias("content_length"), ranged.alias("content_range"), part.alias("part_size"), on_disk.alias("bytes_on_disk"),
    )


@F.pandas_udf(T.BinaryType())
def _gzipped(texts: pd.Series) -> pd.Series:
    def pack(text):
        stream = zlib.compressobj(wbits=31)
        return stream.compress(text.encode()) + stream.flush()

    return texts.map(pack, na_action="ignore")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as API bodies: half gzipped, with and without saying so; some with an error status, some damaged."""
    e = F.col("event_id")
    text = F.concat(F.lit('{"status":"'), F.when(e % 10 == 0, "error").otherwise("ok"), F.lit('","data":'), "props", F.lit("}"))
    text = F.when(e % 45 == 1, F.substring(text, 1, 12)).when(e % 45 == 7, F.lit('{"status":"ok","data":[1,2]}')).otherwise(text)
    packed = _gzipped(F.when(e % 2 == 0, text))
    packed = F.when(e % 50 == 2, F.substring(packed, 1, 15)).otherwise(packed)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(e % 2 == 0, packed)
        .when(e % 45 == 3, F.concat(F.lit('{"note":"').cast("binary"), F.unhex(F.lit("FFC328")), F.encode(F.concat(F.lit('",'), F.substr(text, F.lit(2))), "UTF-8")))
        .otherwise(F.encode(text, "UTF-8"))
        .alias("body"),
        F.when(e % 4 == 0, "br, X-GZIP").otherwise("").alias("content_encoding"),
    )


def broken_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content_tree with two folders in ten in a cycle of two and one whose parent is gone."""
    k = F.substring("id", 2, 20).cast("bigint")
    inner = (F.col("type") == "folder") & (F.col("parent_id") != "")
    parent = (
        F.when(inner & (k % 10 == 3), F.concat(F.lit("n"), k + 1)).when(inner & (k % 10 == 4), F.concat(F.lit("n"), k - 1))
        .when(inner & (k % 10 == 5), "gone").otherwise(F.col("parent_id"))
    )
    return content_tree(spark, sf_dir).withColumn("parent_id", parent)


def clashing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of their brand's folder, named by type; some have a name that is numbered already."""
    k = F.col("p_partkey")
    name = F.concat("p_type", F.when(k % 40 == 7, "(1)").when(k % 40 == 9, "(2)").otherwise(""), F.lit(".bin"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("parent_id"), F.lpad(k.cast("string"), 12, "0").alias("key"), F.lit("file").alias("type"), name.alias("name"))


def content_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, nation and customer as folders and files; names repeat within folders, one region is protected."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit("")
    locked = F.col("r_regionkey") == 2

    def rows(df, id_, parent, key, kind, name, link, size, md5, password, state):
        return df.select(
            id_.alias("id"), parent.alias("parent_id"), key.alias("key"), F.lit(kind).alias("type"), name.alias("name"),
            link.alias("link"), size.cast("bigint").alias("size"), md5.alias("md5"), password.alias("password"), state.alias("password_status"),
        )

    zero = F.lit(0)
    k = F.col("n_nationkey")
    c = F.col("c_custkey")
    return (
        rows(region, text("r", F.col("r_regionkey")), none, none, "folder", F.col("r_name"), none, zero, none,
             F.when(locked, "secret").otherwise("open"), F.when(locked, "passwordRequired").otherwise("passwordOk"))
        .unionByName(
            rows(nation, text("n", k), text("r", F.col("n_regionkey")), F.col("n_name"), "folder",
                 F.when(k % 10 == 0, F.col("r_name")).otherwise(text("Nation ", k % 2)), none, zero, none, none, none)
        )
        .unionByName(
            rows(table(spark, sf_dir, "customer"), text("c", c), text("n", F.col("c_nationkey")), c.cast("string"), "file",
                 text(F.col("c_mktsegment"), ".txt"), text("https://files.example.com/", c), c % 900 + 1, F.md5("c_name"),
                 F.lit("ignored"), F.lit("passwordRequired"))
        )
    )


def manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remote, local, sidecars) digests of documents, with every kind of disagreement."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    path = d.cast("string").alias("path")
    size, md5 = F.octet_length("text").cast("bigint"), F.md5("text")
    remote = docs.select(
        path,
        F.col("source").alias("tid"),
        (d % 60).alias("position"),
        F.concat(F.lit("c"), (d % 20).cast("string")).alias("content_id"),
        F.when(d % 40 == 7, "").otherwise(F.col("lang")).alias("dir"),
        F.concat(d.cast("string"), F.lit(".txt")).alias("name"),
        F.when(d % 40 == 9, "").otherwise(F.concat(F.lit("https://files.example.com/"), d.cast("string"))).alias("link"),
        F.when(d % 7 == 1, size + 1).when(d % 7 == 2, 0).otherwise(size).cast("bigint").alias("size"),
        F.when(d % 7 == 3, F.md5(F.concat("text", F.lit("x")))).when(d % 7 == 4, "  ").when(d % 7 == 5, F.concat(F.lit(" "), F.upper(md5)))
        .otherwise(md5).alias("md5"),
    )
    local = docs.where(d % 5 != 4).select(path, F.when(d % 35 == 0, 0).otherwise(size).cast("bigint").alias("size"), md5.alias("md5"))
    sidecars = docs.where(d % 3 == 0).select(
        path, F.when(d % 9 == 0, size + 2).otherwise(size).alias("size"), F.upper(md5).alias("md5"), (d % 12 != 0).alias("readable")
    )
    return remote, local, sidecars


def named_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as files in brand folders; a brand holds many parts of the same name."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("parent_id"),
        k.cast("string").alias("key"),
        F.when(k % 4 == 0, "folder").otherwise("file").alias("type"),
        F.concat("p_name", F.when(k % 8 == 1, ".tar.gz").otherwise(".bin")).alias("name"),
    )


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event times as pages write them, some unreadable."""
    e = F.col("event_id")
    text = (
        F.when(e % 7 == 0, F.date_format("ts", "yyyy-M-d H:mm:ss"))
        .when(e % 7 == 1, F.date_format("ts", "yyyy-MM-dd HH:mm"))
        .when(e % 7 == 2, F.concat(F.lit("\u00a0 "), F.date_format("ts", "yyyy-M-d H:mm"), F.lit("\t\n")))
        .when(e % 7 == 3, F.date_format("ts", "yyyy/M/d H:mm"))
        .when(e % 7 == 4, F.concat(F.date_format("ts", "yyyy-M"), F.lit("-31 1:02:03")))
        .when(e % 7 == 5, F.concat(F.lit("0000-"), F.date_format("ts", "M-d H:mm")))
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("time_text"))
