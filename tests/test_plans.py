"""What the physical plans must and must not contain."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadloom.plans import inputs
from threadloom.plans.catalog import QUERIES
from threadloom.operators import manifest
from threadloom.sources import store, tables

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="needs the test tables")


def plan(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_compares_all_pairs(spark, capsys, name):
    text = plan(QUERIES[name](spark, SF_DIR), capsys)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["verify_manifest", "audit_transfers", "render_threads", "resolve_assets", "match_rules", "flatten_tree", "dedupe_names"])
def test_no_python_in_relational_queries(spark, capsys, name):
    text = plan(QUERIES[name](spark, SF_DIR), capsys)
    assert not re.search(r"(MapInArrow|ArrowEvalPython|BatchEvalPython)", text)


def test_scans_read_only_the_columns_they_need(spark, capsys):
    assert "ReadSchema: struct<doc_id:bigint>" in plan(QUERIES["pending_assets"](spark, SF_DIR), capsys)
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan(QUERIES["page_title"](spark, SF_DIR), capsys)


def test_filters_reach_the_scan(spark, capsys):
    text = plan(QUERIES["verify_manifest"](spark, SF_DIR), capsys)
    assert "PushedFilters: [IsNotNull(doc_id)]" in text


def test_attempts_are_cut_before_the_shuffle(spark, capsys):
    text = plan(manifest.resolve_attempts(inputs.attempts(spark, SF_DIR)), capsys)
    tree = text.split("\n\n")[0]
    limits = [i for i, line in enumerate(tree.splitlines()) if "WindowGroupLimit" in line]
    shuffle = next(i for i, line in enumerate(tree.splitlines()) if "Exchange" in line)
    assert limits and limits[-1] > shuffle


def test_rendering_moves_post_text_once(spark, capsys):
    """Text is shuffled by (tid, part) only; the other shuffle carries thread ids and counts."""
    text = plan(QUERIES["render_threads"](spark, SF_DIR), capsys)
    moves = [line for line in text.splitlines() if re.match(r"Arguments: hashpartitioning\(", line)]
    assert len([m for m in moves if "part#" in m]) == 1


def test_stored_threads_are_rendered_where_their_posts_meet_their_links(spark, capsys, tmp_path):
    """Post text is shuffled by (tid, part) only, once: the join and the render aggregate share it."""
    wide = "tid string, title string, url string, forum string, total_floors bigint, last_position bigint, created_at timestamp"
    threads = spark.createDataFrame([], wide)
    store.store_threads(str(tmp_path), 0, threads, spark.createDataFrame([], tables.POSTS))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(store.render_stored(spark, str(tmp_path)), capsys)
        forum = plan(QUERIES["render_forum_threads"](spark, SF_DIR), capsys)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for found in (text, forum):
        moves = re.findall(r"Exchange\s*\nInput \[\d+\]: \[(.*?)\]\nArguments: (.*)", found)
        texts = [arguments for columns, arguments in moves if "content_md" in columns]
        assert len(texts) == 1 and re.match(r"hashpartitioning\(tid#\d+, part#\d+L", texts[0])


def test_parsing_is_not_repeated(spark, capsys):
    """Assembly reads the written parse; its plan has no parser in it."""
    text = plan(QUERIES["assemble_threads"](spark, SF_DIR), capsys)
    assert "MapInArrow" not in text


def test_written_tables_go_to_the_shared_folder(spark):
    from threadloom.session import fresh_path, written

    shared = spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x").startswith(shared + "/x-")
    files = written(spark.range(3).toDF("n"), "numbers").inputFiles()
    assert files and all(shared in file for file in files)
