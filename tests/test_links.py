import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.functions.urls import is_remote
from threadloom.operators import links

# The link patterns, as a plain regular expression engine sees them.
IMAGE = re.compile(r"!\[[^\]]*\]\([\t\n\f\r ]*(<)?([^)\t\n\f\r >]+)(>)?([^)]*)\)")
SHARE = re.compile(r"https?://(?:www\.)?gofile\.io/d/([A-Za-z0-9]+)")


def posts(spark, *texts, tid="100"):
    return spark.createDataFrame([(tid, i, t) for i, t in enumerate(texts)], "tid string, position bigint, content_md string")


def assets(spark, *rows):
    full = [(tid, url, local, "", 1, downloaded, i) for i, (tid, url, local, downloaded) in enumerate(rows)]
    return spark.createDataFrame(full, "tid string, url string, local string, alt string, file_size bigint, downloaded boolean, seq bigint")


def shares(spark, *rows):
    full = [(tid, url, url[-1], folder, 1, downloaded, "", i) for i, (tid, url, folder, downloaded) in enumerate(rows)]
    return spark.createDataFrame(
        full, "tid string, url string, content_id string, local_dir string, n_files bigint, downloaded boolean, error string, seq bigint"
    )


def localised(posts_, assets_, shares_):
    return [r.content_md for r in links.localise_posts(posts_, assets_, shares_).orderBy("tid", "position").collect()]


def test_only_image_urls_are_replaced(spark):
    url = "http://maps.test/north/ridge.webp?v=2"
    got = localised(
        posts(spark, f"See [the map]({url}), then ![ridge]({url} \"walk\") twice ![]({url})"), assets(spark, ("100", url, "7f.webp", True)), shares(spark)
    )
    assert got == [f'See [the map]({url}), then ![ridge](images/7f.webp "walk") twice ![](images/7f.webp)']


def test_mapping_stays_in_its_thread(spark):
    east, west = "http://maps.test/east.gif", "http://maps.test/west.gif"
    both = posts(spark, f"![]({east})![]({west})", tid="north").unionByName(posts(spark, f"![]({east})![]({west})", tid="south"))
    known = assets(spark, ("north", east, "e1", True), ("south", west, "w2", True))
    assert localised(both, known, shares(spark)) == [f"![](images/e1)![]({west})", f"![]({east})![](images/w2)"]


def test_unusable_records_and_last_one_wins(spark):
    u = "https://i.example/a.png"
    known = assets(spark, ("1", u, "old.png", True), ("1", u, "new.png", True), ("1", u, "", True), ("1", u, "no.png", False))
    assert [tuple(r) for r in links.usable_assets(known).collect()] == [("1", u, "new.png")]
    pending = links.pending_assets(links.link_rows(posts(spark, f"![a]({u}) ![b](http://j/k.png)", tid="1"), links.image_links(F.col("content_md"))), known)
    assert [tuple(r) for r in pending.collect()] == [("1", "http://j/k.png")]


def test_shares_are_annotated_everywhere(spark):
    u = "https://gofile.io/d/Ab1"
    got = localised(
        posts(spark, f"{u} and ![p]({u}) and http://www.gofile.io/d/Ab1 {u}-x", "no link", tid="1"),
        assets(spark, ("1", u, "f.bin", True)), shares(spark, ("1", u, "shares/Ab1", True)),
    )
    noted = f"{u} (local: shares/Ab1)"
    assert got == [f"{noted} and ![p](images/f.bin) and http://www.gofile.io/d/Ab1 {noted}-x", "no link"]


def test_link_functions_against_plain_regex(spark):
    """Random texts made of link pieces: extraction, rewriting and annotation agree with a loop over matches."""
    rng = random.Random(3)
    pieces = ["![", "]", "(", ")", "<", ">", " ", "\n", "alt", "http://h/a.png", "HTTPS://h/b?x=1", "rel/c.png", '"t"', "https://gofile.io/d/",
              "http://www.gofile.io/d/", "Ab9", "é", "$1", "\\", "![k](http://h/a.png)", "![](<https://h/d>)"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(600)]
    images = {"http://h/a.png": "a$1.png", "https://h/d": "d\\1", "rel/c.png": "c"}
    folders = {"https://gofile.io/d/Ab9": "shares/$0"}

    def to_map(mapping):
        return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])

    md = F.col("content_md")
    rows = posts(spark, *texts).select(
        md, links.image_links(md).alias("i"), links.share_links(md).alias("s"),
        links.rewrite_image_links(md, to_map(images)).alias("ri"), links.annotate_share_links(md, to_map(folders)).alias("rs"),
        links.rewrite_image_links(md, F.lit(None).cast("map<string,string>")).alias("same"),
    )
    assert rows.count() == 600
    for r in rows.collect():
        found = [m[2] for m in IMAGE.finditer(r.content_md) if re.match("http", m[2], re.I)]
        assert r.i == list(dict.fromkeys(found))
        assert r.s == sorted({m[0] for m in SHARE.finditer(r.content_md)})
        moved = IMAGE.sub(lambda m: r.content_md[m.start():m.start(2)] + (f"images/{images[m[2]]}" if m[2] in images else m[2]) + r.content_md[m.end(2):m.end()], r.content_md)
        assert r.ri == moved
        assert r.rs == SHARE.sub(lambda m: f"{m[0]} (local: {folders[m[0]]})" if m[0] in folders else m[0], r.content_md)
        assert r.same == r.content_md


@pytest.mark.parametrize(
    "url, remote",
    [("http://a", True), ("HTTPS://a/b", True), ("httpx:a", True), ("//a/b", False), ("ftp://a", False), ("a/http://b", False), ("http", False),
     ("http://a/%zz", False), ("http://a/%41?q=%zz", True), ("http://a/\x01", False)],
)
def test_remote_urls(spark, url, remote):
    assert spark.range(1).select(is_remote(F.lit(url)).alias("r")).first().r is remote


def test_content_address(spark):
    df = spark.createDataFrame(
        [("1", "https://x.y/a.jpg?v=1", b"abc", 0), ("1", "https://x.y/b.jpg?v=1", b"abc", 1), ("1", "https://x.y/noext", b"", 2), ("1", "https://x.y/c.d/e", b"q", 3)],
        "tid string, url string, content binary, seq bigint",
    )
    rows = links.content_address(df)
    md5 = lambda b: hashlib.md5(b).hexdigest()
    assert [(r.local, r.file_size, r.downloaded) for r in rows.orderBy("seq").collect()] == [
        (md5(b"abc") + ".jpg?v=1", 3, True), (md5(b"abc") + ".jpg?v=1", 3, True), (md5(b""), 0, True), (md5(b"q"), 1, True),
    ]
    assert links.asset_files(rows).count() == 3


def test_share_upsert_keeps_place(spark):
    old = shares(spark, ("1", "u/a", "x", True), ("1", "u/b", "y", True))
    new = shares(spark, ("1", "u/c", "n", True), ("1", "u/a", "z", False))
    got = {r.url: (r.local_dir, r.downloaded, r.seq) for r in links.share_upsert(old, new).collect()}
    assert got == {"u/a": ("z", False, 0), "u/b": ("y", True, 1), "u/c": ("n", True, 2)}
    assert {r.url for r in links.usable_shares(links.share_upsert(old, new)).collect()} == {"u/b", "u/c"}


def test_share_manifest(spark):
    wanted = spark.createDataFrame([("1", "https://gofile.io/d/aa", 0), ("1", "https://gofile.io/d/bb", 1), ("2", "https://gofile.io/d/aa", 2), ("2", "https://x/y", 3)], "tid string, url string, seq bigint")
    files = spark.createDataFrame([("1", "aa", "d/z.txt"), ("1", "aa", "b.txt"), ("1", "bb", "p.part")], "tid string, content_id string, path string")
    got = {(r.tid, r.content_id): (r.local_dir, r.n_files, r.downloaded, r.error) for r in links.share_manifest(wanted, files).collect()}
    assert got == {("1", "aa"): ("shares/aa", 2, True, ""), ("1", "bb"): ("shares/bb", 1, True, ""), ("2", "aa"): ("shares/aa", 0, False, "download_failed")}
    fixed = {(r.tid, r.content_id): r.downloaded for r in links.share_manifest(wanted, files, exclude_aux=True).collect()}
    assert fixed["1", "bb"] is False
    lists = {(r.content_id, r.block): r.files for r in links.share_file_lists(files, block=1).collect()}
    assert lists == {("aa", 0): ["shares/aa/b.txt"], ("aa", 1): ["shares/aa/d/z.txt"], ("bb", 0): ["shares/bb/p.part"]}


def test_appended_records_come_after_old_ones(spark):
    """The new record has the lower place of its own, and still wins."""
    old = assets(spark, ("1", "u/a", "x", True), ("2", "u/a", "q", True)).withColumn("seq", F.col("seq") + 100)
    new = assets(spark, ("1", "u/a", "y", True), ("3", "u/a", "z", True))
    both = links.append_assets(old, new)
    assert sorted((r.tid, r.local, r.seq) for r in both.collect()) == [("1", "x", 100), ("1", "y", 101), ("2", "q", 101), ("3", "z", 1)]
    assert sorted(tuple(r) for r in links.usable_assets(both).collect()) == [("1", "u/a", "y"), ("2", "u/a", "q"), ("3", "u/a", "z")]
