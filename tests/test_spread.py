import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.operators import spread


@pytest.fixture(scope="module")
def skewed(spark):
    """One key owns a third of 9,000 rows."""
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(400)}", f"{rng.getrandbits(40):x}-{i}") for i in range(9000)]
    return spark.createDataFrame(rows, "key string, item string")


def test_number_within_equals_row_number(skewed):
    numbered = spread.number_within(skewed, ["key"], "item", "n")
    plain = skewed.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("item")) - 1)
    assert sorted(numbered.collect()) == sorted(plain.select("key", "item", "n").collect())


def test_number_within_cuts_hot_and_narrow_groups(spark, monkeypatch):
    """A group that owns a third of all rows and one with few rows in a narrow range: no cut holds much more than its share."""
    rows = [("hot" if i % 3 == 0 else "narrow" if i % 100 == 1 else f"k{i % 97}", f"{i:06d}" if i % 100 != 1 else f"zz{i:06d}") for i in range(6000)]
    df = spark.createDataFrame(rows, "key string, item string")
    seen = []
    real = spread.written
    monkeypatch.setattr(spread, "written", lambda d, n: seen.append(real(d, n)) or seen[-1])
    got = spread.number_within(df, ["key"], "item", "n").collect()
    largest = max(r["count"] for r in seen[0].groupBy("key", "_cut").count().collect())
    assert largest <= 1.5 * len(rows) / 4
    assert sorted(r.n for r in got if r.key == "hot") == list(range(2000))
    empty = spread.number_within(df.where("false"), ["key"], "item", "n")
    assert empty.collect() == []


def test_running_offsets(spark):
    rng = random.Random(2)
    rows = [("hot", p, rng.randrange(5)) for p in range(0, 500)] + [(f"t{i}", p, i % 3) for i in range(50) for p in range(1, 1 + i % 7)]
    df = spark.createDataFrame(rows, "tid string, page bigint, n bigint")
    expected, sums = {}, {}
    for tid, page, n in sorted(rows):
        expected[tid, page] = sums.get(tid, 0)
        sums[tid] = sums.get(tid, 0) + n
    got = spread.running_offsets(df, "tid", "page", "n", block=7).collect()
    assert {(r.tid, r.page): r.offset for r in got} == expected
    assert len(got) == len(rows)


@pytest.mark.parametrize("least", [1, 10**6])
@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_lookup_equals_plain_join(spark, skewed, how, least):
    """Salted and unsalted, with null keys and blocks, and more than one table row of a key."""
    rows = skewed.union(spark.createDataFrame([(None, "x"), ("hot", None)], skewed.schema))
    table = spark.createDataFrame([("hot", 1), ("hot", 5), ("k1", 2), ("k2", 3), ("none", 4), (None, 6)], "key string, v int")
    block = F.when(F.col("item").isNotNull(), spread.hash_block("item"))
    got = spread.lookup(rows, table, ["key"], block, how, least)
    want = rows.join(table, "key", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_heavy_keys(spark, skewed):
    hot = spark.range(1).select(F.xxhash64(F.lit("hot"))).first()[0]
    assert spread.heavy_keys(skewed, ["key"], 1000) == [hot]
    assert spread.heavy_keys(skewed, ["key"], 3001) == []
    assert spread.heavy_keys(skewed.where("false"), ["key"], 1) == []
    # 50,000 keys of one row each do not hide a key that owns 1 % of all rows, wherever its rows stand.
    many = spark.range(50_000).selectExpr("IF(id % 100 = 7, 'warm', concat('k', id)) AS key")
    warm = spark.range(1).select(F.xxhash64(F.lit("warm"))).first()[0]
    assert warm in spread.heavy_keys(many, ["key"], 400)


def test_lookup_reads_its_rows_once_and_spreads_a_hot_key(spark, skewed, tmp_path, capsys):
    skewed.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    table = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, v int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for least in (1000, 10**6):
            got = spread.lookup(rows, table, ["key"], spread.hash_block("item"), "left", least)
            capsys.readouterr()
            got.explain()
            assert capsys.readouterr().out.count("FileScan parquet") == 1
            sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
            if least == 1000:
                spark.conf.set("spark.sql.adaptive.enabled", "false")
                sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
                spark.conf.set("spark.sql.adaptive.enabled", "true")
                assert len(sizes) == 4 and max(sizes) < 1.3 * 9000 / 4
            assert sum(sizes) == 9000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
