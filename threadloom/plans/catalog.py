"""The registered queries: name -> function of (spark, sf_dir).

Results are flat: arrays are joined into text and times are written out, so that any engine compares them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as text_fn
from threadloom.operators import assemble, links, manifest, markdown, pages, posts, rules, tree
from threadloom.operators.documents import render_localised
from threadloom.page_profile import ARTICLE
from threadloom.plans import inputs
from threadloom.session import fresh_path, written
from threadloom.sources import readers, store
from threadloom.streaming import ingest

REQUIRED_RULE = "n3"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _clock(column):
    return text_fn.clock(F.col(column))


def _joined(column, sep="\n"):
    return F.array_join(column, sep)


# Pages


@query
def read_pages(spark, sf_dir):
    inputs.configure(spark)
    read = readers.read_pages(spark, f"{sf_dir}/pages.parquet")
    return read.select(
        "page_id", "url", F.length("html").cast("bigint").alias("html_chars"), F.md5("html").alias("html_md5")
    )


def _stored_pages(spark, sf_dir):
    """The pages table, dealt out before it is parsed, as a table may come in few files."""
    return readers.dealt_out(inputs.table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")


@query
def select_nodes(spark, sf_dir):
    found = pages.select_nodes(_stored_pages(spark, sf_dir), "nav a")
    return found.select("page_id", F.col("ord").cast("bigint").alias("ord"), F.col("attrs")["href"].alias("href"), "text")


def _article_pages(spark, sf_dir, **options):
    return pages.parse_pages(_stored_pages(spark, sf_dir), ARTICLE, **options)


@query
def select_nodes_sql(spark, sf_dir):
    """The same from SQL, through the table function."""
    pages.register_select_nodes(spark)
    _stored_pages(spark, sf_dir).createOrReplaceTempView("threadloom_pages")
    return spark.sql(
        "SELECT page_id, CAST(n.ord AS BIGINT) AS ord, n.attrs['href'] AS href, n.text FROM threadloom_pages, LATERAL select_nodes(html, 'nav a') n"
    )


@query
def page_title(spark, sf_dir):
    return _article_pages(spark, sf_dir, with_posts=False).select("page_id", pages.page_title().alias("title"))


@query
def html_to_markdown_pages(spark, sf_dir):
    parsed = _article_pages(spark, sf_dir, with_html=False, with_markdown=True)
    return parsed.select("page_id", _joined(F.transform("posts", lambda post: post["content_md"]), "\n\n").alias("markdown"))


def _forum(spark, sf_dir, repeats=True, kept=False, **options):
    """Forum pages, parsed and with page-level fields."""
    source = inputs.forum_pages(spark, sf_dir, repeats).select("tid", "page", "html")
    if kept:
        source = inputs.kept_pages(source)
    parsed = pages.parse_pages(readers.dealt_out(source, "tid", "page"), **options)
    return pages.with_page_fields(parsed)


def _written_forum(spark, sf_dir, **options):
    """The same, parsed once and written, for plans that read it more than once."""
    return written(_forum(spark, sf_dir, **options), "parsed-pages")


@query
def forum_name(spark, sf_dir):
    return _forum(spark, sf_dir, with_posts=False).select("tid", "page", "forum", "title")


@query
def page_ids(spark, sf_dir):
    return _forum(spark, sf_dir, with_posts=False).select("tid", "page", "base_url", F.col("page_tid").alias("thread_id"))


@query
def resolve_thread_ids(spark, sf_dir):
    """Pages whose given thread id is missing or wrong."""
    c = F.col("tid").cast("bigint")
    given = F.when(c % 4 == 1, "").when(c % 4 == 3, F.concat(F.lit("x"), "tid")).otherwise(F.col("tid"))
    found = _forum(spark, sf_dir, with_posts=False).select("page", "page_tid", F.col("tid").alias("asked"), given.alias("tid"))
    return pages.resolve_thread_id(found).select("asked", "page", "tid", "tid_error")


@query
def total_pages(spark, sf_dir):
    return _forum(spark, sf_dir, with_posts=False).select("tid", "page", "total_pages")


@query
def classify_page(spark, sf_dir):
    return _forum(spark, sf_dir, with_posts=False).select(
        "tid", "page", F.coalesce("error.type", F.lit("")).alias("error_type"), F.coalesce("error.code", F.lit("")).alias("error_code"),
        F.coalesce("error.message", F.lit("")).alias("message"),
    )


@query
def page_error_report(spark, sf_dir):
    errors = _forum(spark, sf_dir, with_posts=False).where("error IS NOT NULL")
    return errors.groupBy(F.col("error.type").alias("error_type")).agg(F.count(F.lit(1)).alias("n_pages"))


# Posts


def _extracted(spark, sf_dir, **options):
    return posts.extract_posts(_forum(spark, sf_dir, **options), inputs.timestamp(inputs.FALLBACK))


@query
def extract_posts(spark, sf_dir):
    return _extracted(spark, sf_dir).select(
        "tid", "page", "ord", "floor", "post_id", _clock("post_time").alias("post_time"),
        F.col("author.username").alias("username"), "content_html",
    )


@query
def extract_authors(spark, sf_dir):
    return _extracted(spark, sf_dir, with_html=False).select("tid", "page", "ord", "author.*")


@query
def html_to_markdown(spark, sf_dir):
    return _extracted(spark, sf_dir, with_html=False, with_markdown=True).select("tid", "page", "ord", "content_md")


@query
def parse_post_time(spark, sf_dir):
    times = inputs.time_texts(spark, sf_dir)
    parsed = text_fn.post_time(F.col("time_text"), inputs.timestamp(inputs.FALLBACK))
    return times.select("event_id", text_fn.clock(parsed).alias("post_time"))


# Threads


@query
def page_plan(spark, sf_dir):
    firsts = _forum(spark, sf_dir, with_posts=False).where("page = 1 AND error IS NULL")
    return pages.page_plan(firsts.select("tid", "total_pages"), "https://forum.example.org/")


def _lossy(spark, sf_dir):
    return _written_forum(spark, sf_dir, with_posts=False, kept=True)


@query
def missing_pages(spark, sf_dir):
    present = _lossy(spark, sf_dir)
    plan = pages.page_plan(present.where("page = 1").select("tid", "total_pages"), "https://forum.example.org/")
    return assemble.missing_pages(plan, present)


@query
def missing_page_lists(spark, sf_dir):
    lists = assemble.missing_page_lists(missing_pages(spark, sf_dir), block=2)
    return lists.select("tid", "block", _joined("missing", ",").alias("missing"))


@query
def page_completeness_strict(spark, sf_dir):
    return assemble.page_completeness(assemble.thread_checks(_lossy(spark, sf_dir)), strict=True)


@query
def page_completeness_lenient(spark, sf_dir):
    return assemble.page_completeness(assemble.thread_checks(_lossy(spark, sf_dir)), strict=False)


@query
def rejected_threads(spark, sf_dir):
    """Some threads have lost their first page, others later ones."""
    source = inputs.kept_pages(inputs.forum_pages(spark, sf_dir)).select("tid", "page", "html")
    source = source.where("NOT (page = 1 AND bigint(tid) % 11 = 5)")
    parsed = pages.with_page_fields(pages.parse_pages(readers.dealt_out(source, "tid", "page"), with_posts=False))
    return assemble.rejected_threads(assemble.thread_checks(written(parsed, "parsed-pages")))


def _assembled(spark, sf_dir, mode="reference", repeats=True, kept=False, strict=True, **options):
    """(threads, posts) of the forum pages."""
    source = _written_forum(spark, sf_dir, repeats=repeats, kept=kept, **options)
    return assemble.assemble(source, inputs.timestamp(inputs.FALLBACK), strict, mode, repeats)


def _thread_rows(threads):
    return threads.select("tid", "title", "url", "forum", "total_floors", _clock("created_at").alias("created_at"))


@query
def assemble_threads(spark, sf_dir):
    return _thread_rows(_assembled(spark, sf_dir, with_html=False)[0])


@query
def assemble_threads_lenient(spark, sf_dir):
    return _thread_rows(_assembled(spark, sf_dir, kept=True, strict=False, with_html=False)[0])


def _post_rows(placed):
    return placed.select(
        "tid", "position", "page", "floor", "post_id", _clock("post_time").alias("post_time"),
        F.col("author.username").alias("username"), "content_html",
    )


@query
def assemble_posts(spark, sf_dir):
    return _post_rows(_assembled(spark, sf_dir, "reference", False)[1])


@query
def assemble_posts_continuous(spark, sf_dir):
    return _post_rows(_assembled(spark, sf_dir, "continuous", False)[1])


@query
def reply_blocks(spark, sf_dir):
    blocks = assemble.reply_blocks(_assembled(spark, sf_dir, with_html=False)[1], block=2)
    ids = F.transform("replies", lambda r: F.concat(r["position"].cast("string"), F.lit(":"), r["post_id"]))
    return blocks.select("tid", "block", F.array_join(ids, ",").alias("replies"))


# Markdown


def _flagship_posts(spark, sf_dir):
    """Conversation turns as posts; no HTML on the way."""
    turns = inputs.turns(spark, sf_dir)
    return turns.select(
        "tid", F.col("turn").alias("position"), posts.floor_label(F.col("turn")).alias("floor"), "post_id",
        F.col("ts").alias("post_time"), F.struct(F.col("role").alias("username"), "uid").alias("author"),
        F.col("text").alias("content_md"),
    )


@query
def render_threads(spark, sf_dir):
    entries = _flagship_posts(spark, sf_dir)
    threads = entries.groupBy("tid").agg(F.max("position").alias("last_position"))
    titled = threads.withColumn("title", F.concat(F.lit("Topic #"), "tid", F.lit(" (a_b)")))
    return markdown.render_threads(titled, markdown.render_posts(entries), inputs.timestamp(inputs.GENERATED_AT))


@query
def render_entry_headers(spark, sf_dir):
    header = markdown.entry_header(
        F.col("post_id"), F.col("floor"), F.col("position"), F.col("post_time"), F.col("author.uid"), F.col("author.username")
    )
    return _flagship_posts(spark, sf_dir).select("tid", "position", header.alias("header"))


@query
def escape_markdown(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text_fn.escape_markdown(F.col("text")).alias("escaped"))


def _forum_records(threads):
    """Asset and share records for every other thread."""
    even = threads.select("tid").where("CAST(tid AS BIGINT) % 2 = 0")
    number = (F.col("tid").cast("bigint") % 20).cast("string")
    zero = F.lit(0).cast("bigint").alias("seq")
    assets = even.select(
        "tid", F.concat(F.lit("https://img.example.com/"), number, F.lit(".png")).alias("url"),
        F.concat(F.lit("i"), number, F.lit(".png")).alias("local"), F.lit(True).alias("downloaded"), zero,
    )
    shares = even.select(
        "tid", F.concat(F.lit("https://gofile.io/d/s"), number).alias("url"),
        F.concat(F.lit("shares/s"), number).alias("local_dir"), F.lit(True).alias("downloaded"), zero,
    )
    return assets, shares


def _rendered_forum(spark, sf_dir):
    """The whole way: pages, parse, assembly, links, Markdown."""
    threads, placed = _assembled(spark, sf_dir, with_html=False, with_markdown=True)
    placed = written(placed, "posts")
    assets, shares = _forum_records(threads)
    only = F.lit(0).cast("bigint").alias("gen")
    return render_localised(
        threads.select("tid", "title", "last_position", only), placed.select("*", only), links.usable_assets(assets), links.usable_shares(shares),
        inputs.timestamp(inputs.GENERATED_AT),
    )


@query
def render_forum_threads(spark, sf_dir):
    return _rendered_forum(spark, sf_dir)


@query
def export_threads(spark, sf_dir):
    """Written as files and read back."""
    inputs.configure(spark)
    out = fresh_path(spark, "export")
    store.export_threads(render_threads(spark, sf_dir), out, layout="files")
    return store.read_export(spark, out, layout="files")


@query
def export_shards(spark, sf_dir):
    out = fresh_path(spark, "export")
    store.export_threads(render_threads(spark, sf_dir), out, layout="shards")
    return store.read_export(spark, out, layout="shards")


@query
def list_assets(spark, sf_dir):
    """Files of an export, listed without reading them: document part and size."""
    inputs.configure(spark)
    out = fresh_path(spark, "export")
    store.export_threads(render_threads(spark, sf_dir), out, layout="files")
    return readers.list_assets(spark, out).select(
        F.regexp_extract("path", "tid=([^/]*)/", 1).alias("tid"), F.regexp_extract("path", "part=([0-9]+)/", 1).cast("bigint").alias("part"), "size"
    )


# Links


@query
def extract_image_links(spark, sf_dir):
    found = inputs.linked_posts(spark, sf_dir).select("doc_id", links.image_links(F.col("md")).alias("urls"))
    return found.select("doc_id", F.size("urls").cast("bigint").alias("n_urls"), _joined("urls").alias("urls"))


@query
def extract_share_links(spark, sf_dir):
    found = inputs.linked_posts(spark, sf_dir).select("doc_id", links.share_links(F.col("md")).alias("urls"))
    ids = F.transform("urls", links.share_content_id)
    return found.select("doc_id", _joined("urls").alias("urls"), F.array_join(ids, ",").alias("content_ids"))


def _image_rows(spark, sf_dir):
    """Image links as a table of their own, so that texts are searched once."""
    found = links.link_rows(inputs.linked_posts(spark, sf_dir), links.image_links(F.col("md")))
    return written(found, "image-links")


@query
def resolve_assets(spark, sf_dir):
    known = links.usable_assets(inputs.asset_records(spark, sf_dir))
    resolved = links.resolve_links(_image_rows(spark, sf_dir), known)
    return resolved.select("tid", "position", "url", F.coalesce("local", F.lit("")).alias("local"))


@query
def pending_assets(spark, sf_dir):
    return links.pending_assets(_image_rows(spark, sf_dir), inputs.asset_records(spark, sf_dir))


@query
def resolve_shares(spark, sf_dir):
    wanted = written(links.link_rows(inputs.linked_posts(spark, sf_dir), links.share_links(F.col("md"))), "share-links")
    known = links.usable_shares(links.share_upsert(*inputs.share_records(spark, sf_dir)))
    return links.resolve_links(wanted, known).select("tid", "position", "url", F.coalesce("local_dir", F.lit("")).alias("local_dir"))


@query
def share_upsert(spark, sf_dir):
    return links.share_upsert(*inputs.share_records(spark, sf_dir))


def _localised(spark, sf_dir, with_assets, with_shares):
    assets = inputs.asset_records(spark, sf_dir)
    shares = links.share_upsert(*inputs.share_records(spark, sf_dir))
    local = links.localise_posts(
        inputs.linked_posts(spark, sf_dir), assets if with_assets else assets.where("false"),
        shares if with_shares else shares.where("false"), body="md",
    )
    return local.select("doc_id", "md")


@query
def rewrite_image_links(spark, sf_dir):
    return _localised(spark, sf_dir, True, False)


@query
def annotate_share_links(spark, sf_dir):
    return _localised(spark, sf_dir, False, True)


def _addressed(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    url = F.concat(F.lit("https://cdn.example.com/x.y/"), d.cast("string"), F.when(d % 4 == 0, "").otherwise(F.concat(F.lit(".txt?v="), (d % 3).cast("string"))))
    return links.content_address(docs.select(F.col("source").alias("tid"), url.alias("url"), F.col("text").alias("content"), d.alias("seq")))


@query
def content_address(spark, sf_dir):
    return _addressed(spark, sf_dir)


@query
def append_assets(spark, sf_dir):
    return links.append_assets(inputs.asset_records(spark, sf_dir), _addressed(spark, sf_dir))


@query
def carry_records(spark, sf_dir):
    """Stored asset records stay; records of a new run follow where no usable one was there."""
    old = inputs.asset_records(spark, sf_dir)
    new = inputs.linked_images(spark, sf_dir)
    return store.carry_records(old, new)


@query
def asset_files(spark, sf_dir):
    return links.asset_files(_addressed(spark, sf_dir))


@query
def share_manifest(spark, sf_dir):
    return links.share_manifest(inputs.share_wishes(spark, sf_dir), inputs.share_files(spark, sf_dir))


@query
def share_manifest_complete_files(spark, sf_dir):
    return links.share_manifest(inputs.share_wishes(spark, sf_dir), inputs.share_files(spark, sf_dir), exclude_aux=True)


@query
def share_file_lists(spark, sf_dir):
    lists = links.share_file_lists(inputs.share_files(spark, sf_dir), block=5)
    return lists.select("tid", "content_id", "block", _joined("files").alias("files"))


# Rules


def _rule_rows(df):
    return df.withColumn("expires", F.coalesce(text_fn.clock(F.col("expires")), F.lit("")))


def _rules(spark, sf_dir):
    return rules.parse_scope_rules(inputs.rule_lines(spark, sf_dir))


@query
def parse_scope_rules(spark, sf_dir):
    return _rule_rows(_rules(spark, sf_dir))


@query
def rule_defaults(spark, sf_dir):
    return _rule_rows(rules.latest_rules(rules.rule_defaults(inputs.observed_rules(spark, sf_dir))))


@query
def latest_rules(spark, sf_dir):
    return _rule_rows(rules.latest_rules(_rules(spark, sf_dir)))


@query
def live_rules(spark, sf_dir):
    return _rule_rows(rules.live_rules(_rules(spark, sf_dir), inputs.timestamp(inputs.NOW)))


def _matches(spark, sf_dir):
    urls = inputs.table(spark, sf_dir, "pages").select("page_id", "url")
    return rules.match_rules(urls, rules.latest_rules(_rules(spark, sf_dir)), inputs.timestamp(inputs.NOW))


@query
def match_rules(spark, sf_dir):
    return _matches(spark, sf_dir).select("page_id", "seq", "name", "value")


@query
def rule_headers(spark, sf_dir):
    return rules.rule_headers(_matches(spark, sf_dir), ["page_id"]).select(
        "page_id", "header", _joined("names", ",").alias("names")
    )


@query
def required_rule(spark, sf_dir):
    return rules.required_rule(_rules(spark, sf_dir), ["domain"], REQUIRED_RULE, inputs.timestamp(inputs.NOW))


# Manifests


@query
def file_digest(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", manifest.file_digest(F.col("text")).alias("d")).select("doc_id", "d.*")


def _verified(spark, sf_dir):
    return manifest.verify_manifest(*inputs.manifest(spark, sf_dir))


@query
def verify_manifest(spark, sf_dir):
    return _verified(spark, sf_dir).select("path", "status")


def _planned(spark, sf_dir, skip_existing):
    remote, local, _ = inputs.manifest(spark, sf_dir)
    there = remote.select("path", "tid", "content_id").join(local.select("path"), "path").select("tid", "content_id")
    present = manifest.batches_present(remote, there.where("tid <> 'src1' OR content_id <> 'c3'"))
    return manifest.sync_plan(_verified(spark, sf_dir), present, skip_existing).select("path", "tid", "action")


@query
def sync_plan(spark, sf_dir):
    return _planned(spark, sf_dir, True)


@query
def sync_plan_always_check(spark, sf_dir):
    return _planned(spark, sf_dir, False)


@query
def decode_payloads(spark, sf_dir):
    decoded = manifest.decode_payloads(inputs.payloads(spark, sf_dir), "k bigint")
    return decoded.select("event_id", "status", "error", F.coalesce("data.k", F.lit(-1).cast("bigint")).alias("k"))


@query
def audit_transfers(spark, sf_dir):
    return manifest.audit_transfers(inputs.transfers(spark, sf_dir)).select(
        "event_id", F.coalesce("expected_size", F.lit(-1).cast("bigint")).alias("expected_size"), "accepted", "reason"
    )


@query
def transfer_report(spark, sf_dir):
    return manifest.transfer_report(manifest.audit_transfers(inputs.transfers(spark, sf_dir)))


@query
def resolve_attempts(spark, sf_dir):
    return manifest.resolve_attempts(inputs.attempts(spark, sf_dir))


@query
def resolve_attempts_timeout_only(spark, sf_dir):
    return manifest.resolve_attempts_timeout_only(inputs.attempts(spark, sf_dir))


@query
def dedupe_names(spark, sf_dir):
    return tree.dedupe_names(inputs.named_parts(spark, sf_dir)).select("parent_id", "key", "final_name", "repeat")


@query
def flatten_tree(spark, sf_dir):
    return tree.flatten_tree(inputs.content_tree(spark, sf_dir)).select(
        "root_id", "id", "path", "filename", "link", "size", "md5", _joined("walk_key", "/").alias("walk_key")
    )


@query
def tree_faults(spark, sf_dir):
    """Nodes in cycles, below them, or without a parent."""
    return tree.tree_faults(inputs.broken_tree(spark, sf_dir))


@query
def flatten_broken_tree(spark, sf_dir):
    """What can be reached of a tree with faults."""
    return tree.flatten_tree(inputs.broken_tree(spark, sf_dir)).select("root_id", "id", _joined("walk_key", "/").alias("walk_key"))


@query
def name_clashes(spark, sf_dir):
    return tree.name_clashes(inputs.clashing_parts(spark, sf_dir))


# Store


def _store_fixture(spark, sf_dir):
    """Two generations: all threads, then every third one again with the posts of one page less."""
    inputs.configure(spark)
    path = fresh_path(spark, "store")
    everything = _flagship_posts(spark, sf_dir).withColumn("page", F.lit(1).cast("bigint")).withColumn("content_html", F.lit(""))
    author = F.struct(
        "author.username", "author.uid", F.lit("").alias("avatar"), F.lit(0).alias("post_count"), F.lit("").alias("register_date"),
        F.lit("").alias("last_login"), F.lit("").alias("signature"),
    )
    full = everything.withColumn("author", author)

    def heads(rows, title):
        return rows.groupBy("tid").agg(
            F.count(F.lit(1)).alias("total_floors"), F.max("position").alias("last_position"),
            F.min("post_time").alias("created_at"),
        ).select("*", F.concat(F.lit(title), "tid").alias("title"), F.lit("").alias("url"), F.lit("").alias("forum"))

    def assets(rows, name):
        return rows.where("position = 0").select(
            "tid", F.lit("https://img.example.com/a.png").alias("url"), F.lit(name).alias("local"), F.lit("").alias("alt"),
            F.lit(1).cast("bigint").alias("file_size"), F.lit(True).alias("downloaded"), F.lit(0).cast("bigint").alias("seq"),
        )

    store.store_threads(path, 0, heads(full, "old "), full, assets(full, "first.png"))
    again = full.where("CAST(tid AS BIGINT) % 3 = 0 AND position < 3")
    store.store_threads(path, 1, heads(again, "new "), again)
    return path


@query
def upsert_threads(spark, sf_dir):
    """Headers, post counts and carried-over assets after the second generation."""
    path = _store_fixture(spark, sf_dir)
    kept = store.stored_posts(spark, path).groupBy("tid").agg(F.count(F.lit(1)).alias("n_posts"))
    assets = links.usable_assets(store.stored_assets(spark, path))
    return (
        store.stored_threads(spark, path).join(kept, "tid").join(assets.select("tid", "local"), "tid", "left")
        .select("tid", "title", "total_floors", _clock("created_at").alias("created_at"), "n_posts", "local")
    )


@query
def merge_threads(spark, sf_dir):
    """Header rows of an upsert, without a store."""
    turns = inputs.turns(spark, sf_dir)

    def heads(rows, title):
        return rows.groupBy("tid").agg(F.count(F.lit(1)).alias("total_floors")).select("tid", F.lit(title).alias("title"), "total_floors")

    return store.merge_threads(heads(turns, "old"), heads(turns.where("role <> 'system' AND conv_id % 3 = 0"), "new"))


def _forum_store(spark, sf_dir):
    """Assembled forum threads in two generations: first their main posts only, with all records; then whole, some shares once more."""
    path = fresh_path(spark, "store")
    threads, placed = _assembled(spark, sf_dir, with_html=False, with_markdown=True)
    threads, placed = written(threads, "threads"), written(placed, "posts")
    assets, shares = _forum_records(threads)
    nothing = F.lit("").alias
    assets = assets.select("tid", "url", "local", nothing("alt"), F.lit(7).cast("bigint").alias("file_size"), "downloaded", "seq")
    content = links.share_content_id(F.col("url"))
    shares = shares.select("tid", "url", content.alias("content_id"), "local_dir", F.lit(2).cast("bigint").alias("n_files"), "downloaded", nothing("error"), "seq")
    files = lambda rows, names: links.files_of_shares(
        rows, links.share_file_lists(rows.select("tid", "content_id", F.explode(F.array(*map(F.lit, names))).alias("path")), block=1)
    )
    early = threads.withColumns({"title": F.concat(F.lit("old "), "title"), "last_position": F.lit(0).cast("bigint")})
    store.store_threads(path, 0, early, placed.where("position = 0"), assets, shares, files(shares, ["b.txt", "a.txt"]))
    again = shares.where("CAST(tid AS BIGINT) % 4 = 0").withColumn("n_files", F.lit(1).cast("bigint"))
    store.store_threads(path, 1, threads, placed, None, again, files(again, ["c.txt"]))
    return path


@query
def export_stored_threads(spark, sf_dir):
    """Stored threads with their cached links, exported as documents and read back; nothing but the store is read."""
    inputs.configure(spark)
    path, out = _forum_store(spark, sf_dir), fresh_path(spark, "export")
    store.export_stored(spark, path, out, generated_at=inputs.timestamp(inputs.GENERATED_AT))
    return store.read_export(spark, f"{out}/documents")


@query
def export_stored_metadata(spark, sf_dir):
    """What the export holds beside its documents."""
    inputs.configure(spark)
    path, out = _forum_store(spark, sf_dir), fresh_path(spark, "export")
    store.export_stored(spark, path, out)
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    names = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "files"))), lambda b: b["files"])), ",")
    files = read("share_files").groupBy("tid", "url").agg(names.alias("files"))
    shares = read("shares").select("tid", "url", "n_files").join(files, ["tid", "url"], "left")
    assets = read("assets").select("tid", F.col("local").alias("image"))
    return read("threads").select("tid", "title", "total_floors").join(assets, "tid", "left").join(shares, "tid", "left").select(
        "tid", "title", "total_floors", F.coalesce("image", F.lit("")).alias("image"), F.coalesce("url", F.lit("")).alias("share"),
        F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("files", F.lit("")).alias("files"),
    )


@query
def compacted_store(spark, sf_dir):
    """Six generations, each of a sixth of the threads and of those of the first sixth again, merged in tiers of two."""
    inputs.configure(spark)
    path = fresh_path(spark, "store")
    turns = _flagship_posts(spark, sf_dir).withColumns({"page": F.lit(1).cast("bigint"), "content_html": F.lit("")})
    author = F.struct("author.username", "author.uid", *[F.lit(v).alias(n) for n, v in (("avatar", ""), ("post_count", 0), ("register_date", ""), ("last_login", ""), ("signature", ""))])
    everything = written(turns.withColumn("author", author), "posts")
    c = F.col("tid").cast("bigint")
    for gen in range(6):
        some = everything.where((c % 6 == gen) | ((c % 6 == 0) & (F.col("position") <= gen)))
        heads = some.groupBy("tid").agg(
            F.count(F.lit(1)).alias("total_floors"), F.max("position").alias("last_position"), F.min("post_time").alias("created_at")
        ).select("*", F.lit(f"generation {gen}").alias("title"), F.lit("").alias("url"), F.lit("").alias("forum"))
        assets = heads.select(
            "tid", F.lit(f"https://img.example.com/{gen}.png").alias("url"), F.lit(f"{gen}.png").alias("local"), F.lit("").alias("alt"),
            F.lit(1).cast("bigint").alias("file_size"), F.lit(True).alias("downloaded"), F.lit(0).cast("bigint").alias("seq"),
        )
        store.store_threads(path, gen, heads, some, assets)
        store.compact_tiers(spark, path, fanout=2)
    kept = store.stored_posts(spark, path).groupBy("tid").agg(F.count(F.lit(1)).alias("n_posts"))
    images = store.stored_assets(spark, path).groupBy("tid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "local"))), lambda a: a["local"]), ",").alias("images"))
    return store.stored_threads(spark, path).select("tid", "title").join(kept, "tid").join(images, "tid")


@query
def load_threads(spark, sf_dir):
    """Stored threads asked for by id, with those not found."""
    path = _store_fixture(spark, sf_dir)
    turns = inputs.turns(spark, sf_dir)
    wanted = turns.where("turn = 0").select(
        F.when(F.col("conv_id") % 5 == 4, F.concat(F.lit("x"), "tid")).when(F.col("conv_id") % 50 == 10, "").otherwise(F.col("tid")).alias("tid")
    )
    found, missing = store.load_threads(spark, path, wanted)
    rows = found.select("tid", "title", "total_floors", F.lit("").alias("error"))
    return rows.unionByName(missing.select("tid", F.lit("").alias("title"), F.lit(0).cast("bigint").alias("total_floors"), "error"))


@query
def ingest_pages_stream(spark, sf_dir):
    """Pages arriving in several files; the store then holds what a batch run would give."""
    inputs.configure(spark)
    arriving, path, progress = (fresh_path(spark, name) for name in ("arriving", "store", "progress"))
    source = inputs.forum_pages(spark, sf_dir).select("tid", "page", "html")
    readers.dealt_out(source, "page", "tid").write.parquet(arriving)
    # Two batches: two thirds of the files, then the rest.
    files = len(spark.read.parquet(arriving).inputFiles())
    run = ingest.ingest_pages_stream(spark, arriving, path, progress, max_files_per_trigger=max(1, -(-2 * files // 3)))
    run.awaitTermination()
    ingest.publish(spark, path, 0, inputs.timestamp(inputs.FALLBACK))
    return _published(spark, path)


def _published(spark, path):
    heads = store.stored_threads(spark, path).select("tid", "title", "total_floors")
    ids = store.stored_posts(spark, path).groupBy("tid").agg(F.count(F.lit(1)).alias("n_posts"), F.min("post_id").alias("min_post_id"))
    return heads.join(ids, "tid")


@query
def publish_twice(spark, sf_dir):
    """Pages from two sources with checkpoints of their own, published after each and once more; no thread is lost."""
    inputs.configure(spark)
    path = fresh_path(spark, "store")
    source = inputs.forum_pages(spark, sf_dir).select("tid", "page", "html")
    since = 0
    for half in ("page % 2 = 1", "page % 2 = 0"):
        arriving, progress = fresh_path(spark, "arriving"), fresh_path(spark, "progress")
        source.where(half).write.parquet(arriving)
        ingest.ingest_pages_stream(spark, arriving, path, progress).awaitTermination()
        ingest.publish(spark, path, since, inputs.timestamp(inputs.FALLBACK))
        since = ingest.last_page_generation(spark, path)
    ingest.publish(spark, path, since, inputs.timestamp(inputs.FALLBACK))
    return _published(spark, path)
