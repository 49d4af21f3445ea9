import random

from pyspark.sql import functions as F

from threadloom.operators import rules
from threadloom.sources import readers

SCHEMA = "seq bigint, name string, value string, domain string, path string, expires timestamp, max_age int, secure boolean, http_only boolean, same_site string"


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq bigint, line string")


def rule_rows(spark, rows):
    full = [(i, n, v, d, p, None, 0, s, False, "") for i, (n, v, d, p, s) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def test_rule_file(spark):
    got = rules.parse_scope_rules(lines(
        spark, "# Netscape HTTP Cookie File", ".shop.test\tTRUE\t/\tTRUE\t4000000000\tbasket\t12",
        "#HttpOnly_api.shop.test\tFALSE\t/v1\tFALSE\t0\tkey\tk-9\r", "", "shop.test\tTRUE\t/\tFALSE\tsoon\tseen\tone\ttwo", ".news.test\tFALSE\t/a\tfalse\t+5\tlang\tde",
        "w.test TRUE / FALSE 0 spaced v", "w.test\tTRUE\t/\tFALSE\t0\tempty\t", "too short",
    )).orderBy("seq").collect()
    assert [(r.name, r.value, r.domain, r.path, r.secure, r.http_only, r.expires and int(r.expires.timestamp())) for r in got] == [
        ("basket", "12", ".shop.test", "/", True, False, 4000000000), ("key", "k-9", "api.shop.test", "/v1", False, True, None),
        ("seen", "one\ttwo", ".shop.test", "/", False, False, None), ("lang", "de", "news.test", "/a", False, False, 5),
        ("spaced", "v", ".w.test", "/", False, False, None),
    ]


def test_rule_files_are_sets_of_their_own(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(f"# x\ne.com\tFALSE\t/\tFALSE\t0\tn\t{name}\n")
    parsed = rules.parse_scope_rules(readers.read_rule_lines(spark, str(tmp_path)))
    assert sorted(r.value for r in rules.latest_rules(parsed, ["source"]).collect()) == ["a.txt", "b.txt"]
    assert rules.latest_rules(parsed.drop("source")).count() == 1
    assert {r.present for r in rules.required_rule(parsed, ["source"], "login", F.expr("timestamp'2020-01-01'")).collect()} == {False}


def test_latest_keeps_the_first_place(spark):
    got = rules.latest_rules(rule_rows(spark, [("a", "1", "d", "/", False), ("b", "2", "d", "/", False), ("a", "3", "d", "/", True), ("a", "4", "d", "/x", False)]))
    assert sorted((r.seq, r.name, r.value, r.secure) for r in got.collect()) == [(0, "a", "3", True), (1, "b", "2", False), (3, "a", "4", False)]


def test_live_rules(spark):
    df = rule_rows(spark, [("a", "", "", "", False)] * 3).withColumn("expires", F.expr("CASE seq WHEN 0 THEN NULL WHEN 1 THEN timestamp'2020-01-01' ELSE timestamp'2020-01-02' END"))
    assert sorted(r.seq for r in rules.live_rules(df, F.expr("timestamp'2020-01-02'")).collect()) == [0, 2]


def test_defaults(spark):
    df = spark.createDataFrame(
        [(0, "a", "1", "", "", None, 0, False, False, 3, "h:80"), (1, "b", "2", ".x", "/p", None, 5, True, True, 0, "h")],
        "seq bigint, name string, value string, domain string, path string, expires timestamp, max_age int, secure boolean, http_only boolean, same_site_code int, response_host string",
    )
    assert [(r.domain, r.path, r.same_site) for r in rules.rule_defaults(df).orderBy("seq").collect()] == [("h:80", "/", "Strict"), (".x", "/p", "")]


def expected_matches(urls, rows):
    """The rules as a double loop."""
    hits = set()
    for page, (scheme, host, path) in urls.items():
        for i, (_, _, domain, rule_path, secure) in enumerate(rows):
            host_ok = not domain or domain == host or (domain[0] == "." and (host.endswith(domain) or host == domain[1:]))
            path_ok = rule_path in ("", "/") or path.startswith(rule_path if rule_path[0] == "/" else "/" + rule_path)
            if host_ok and path_ok and (not secure or scheme == "https"):
                hits.add((page, i))
    return hits


def matching_case(seed, n_urls=120, n_rules=80):
    rng = random.Random(seed)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "ba.com", "a.com:8080", "com", "h", ".a.com", "a..com"]
    paths = ["", "/", "/en", "/en/1", "/english", "/fr/x y", "/a+b"]
    urls = {i: (rng.choice(["http", "https"]), rng.choice(hosts), rng.choice(paths)) for i in range(n_urls)}
    domains = ["", "a.com", ".a.com", ".com", "x.a.com", ".x.a.com", "a.com:8080", ".h", "..com", "."]
    rows = [(f"n{i}", "v", rng.choice(domains), rng.choice(["", "/", "en", "/en", "/fr/x", "a+b"]), rng.random() < 0.3) for i in range(n_rules)]
    return urls, rows


def matched(spark, urls, rows, **options):
    df = spark.createDataFrame([(i, f"{s}://u:p@{h}{p}?q=1#f" if i % 2 else f"{s}://{h}{p}") for i, (s, h, p) in urls.items()], "page_id bigint, url string")
    found = rules.match_rules(df, rule_rows(spark, rows), F.expr("timestamp'2025-01-01'"), **options)
    pairs = [(r.page_id, r.seq) for r in found.collect()]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


def test_matching_equals_the_double_loop(spark):
    urls, rows = matching_case(5)
    assert matched(spark, urls, rows) == expected_matches(urls, rows)


def test_matching_with_many_rules_for_any_host(spark, capsys):
    urls, rows = matching_case(6, n_rules=150)
    rows = [(n, v, "" if i % 2 else d, p, s) for i, (n, v, d, p, s) in enumerate(rows)]
    assert matched(spark, urls, rows) == expected_matches(urls, rows)
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    rules.match_rules(df, rule_rows(spark, rows), F.expr("timestamp'2025-01-01'")).explain()
    assert "NestedLoop" not in capsys.readouterr().out


def test_required_rule_is_live_and_latest(spark):
    df = rule_rows(spark, [("login", "1", "d", "/", False), ("login", "2", "d", "/", False), ("x", "3", "e", "/", False), ("login", "4", "f", "/", False)])
    df = df.withColumn("expires", F.expr("CASE seq WHEN 1 THEN timestamp'2019-01-01' END"))
    got = rules.required_rule(df, ["domain"], "login", F.expr("timestamp'2020-01-01'"))
    assert {r.domain: r.present for r in got.collect()} == {"d": False, "e": False, "f": True}


def test_escaped_paths(spark):
    df = spark.createDataFrame([(1, "http://h/%65n+x"), (2, "http://h/%zz")], "page_id bigint, url string")
    found = rules.match_rules(df, rule_rows(spark, [("n", "v", "h", "/en+", False), ("m", "v", "h", "/", False)]), F.expr("timestamp'2025-01-01'"))
    assert sorted((r.page_id, r.name) for r in found.collect()) == [(1, "m"), (1, "n")]


def test_headers(spark):
    df = spark.createDataFrame([(1, 3, "b", "2"), (1, 1, "a", "x%20y"), (1, 2, "", "x"), (1, 5000, "c", ""), (2, 0, "", "y")], "page_id int, seq bigint, name string, value string")
    got = [tuple(r) for r in rules.rule_headers(df, ["page_id"]).collect()]
    assert got == [(1, "a=x%20y; b=2; c=", ["a", "b", "c"])]


def test_lines_of_a_file_in_splits_are_numbered_as_in_the_file(spark, tmp_path):
    one = [f"host{i}.example\tFALSE\t/\tFALSE\t0\tn{i}\t{'v' * (i % 90)}" if i % 7 else "" for i in range(6000)]
    (tmp_path / "a.txt").write_bytes(("\n".join(one) + "\n").encode())
    (tmp_path / "b.txt").write_bytes(b"first\r\nsecond")
    (tmp_path / "empty.txt").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        lines = readers.read_rule_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 5
        got = {(r.source.rsplit("/", 1)[1], r.seq): r.line for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {("a.txt", i): line for i, line in enumerate(one)} | {("b.txt", 0): "first\r", ("b.txt", 1): "second"}
