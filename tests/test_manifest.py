import gzip
import hashlib

import pytest

from threadloom.operators import manifest, tree


def transfer(spark, **fields):
    row = {"status": 200, "content_type": "", "body_prefix": "abc", "content_length": "", "content_range": "", "part_size": 0, "bytes_on_disk": 6, **fields}
    schema = "status int, content_type string, body_prefix string, content_length string, content_range string, part_size bigint, bytes_on_disk bigint"
    r = manifest.audit_transfers(spark.createDataFrame([tuple(row.values())], schema)).first()
    return r.reason, r.expected_size


@pytest.mark.parametrize(
    "fields, expected",
    [
        ({}, ("ok", None)),
        ({"content_length": "6"}, ("ok", 6)),
        ({"content_length": " +6 x"}, ("ok", 6)),
        ({"content_length": "7"}, ("incomplete", 7)),
        ({"content_length": "x"}, ("bad_length", None)),
        ({"content_length": "99999999999999999999"}, ("bad_length", None)),
        ({"status": 206}, ("ok", None)),
        ({"status": 500}, ("bad_status", None)),
        ({"status": 204}, ("bad_status", None)),
        ({"status": 200, "part_size": 3, "content_length": "6"}, ("ok", 6)),
        ({"status": 206, "part_size": 3, "content_length": "3"}, ("ok", 6)),
        ({"status": 206, "part_size": 3, "content_length": "1", "content_range": "bytes 3-5/6"}, ("ok", 6)),
        ({"status": 206, "part_size": 3, "content_range": "bytes 3-5"}, ("bad_length", None)),
        ({"status": 206, "part_size": 3, "content_range": "bytes 3/5/6"}, ("bad_length", None)),
        ({"status": 206, "part_size": 3, "content_range": "bytes 3-5/*"}, ("bad_length", None)),
        ({"status": 206, "part_size": 0, "content_range": "bytes 3-5/*"}, ("ok", None)),
        ({"content_type": "Text/HTML; x"}, ("html_body", None)),
        ({"body_prefix": "\n <!DocType HTML>"}, ("html_body", None)),
        ({"body_prefix": "<HTML>"}, ("html_body", None)),
        ({"body_prefix": "x<html>"}, ("ok", None)),
    ],
)
def test_transfers(spark, fields, expected):
    assert transfer(spark, **fields) == expected


def test_verification_order(spark):
    md5 = hashlib.md5(b"abcdef").hexdigest()
    cases = {  # path: (remote size, remote md5), local, sidecar, status
        "ok": ((6, md5), (6, md5), None, "ok"),
        "no-claims": ((0, "  "), (6, md5), None, "ok"),
        "null-md5": ((0, None), (6, md5), None, "ok"),
        "case": ((6, f" {md5.upper()} "), (6, md5), (6, md5.upper(), True), "ok"),
        "absent": ((6, md5), None, (6, md5, True), "absent"),
        "empty": ((0, ""), (0, md5), None, "absent"),
        "size": ((7, "bad"), (6, md5), (1, "bad", False), "size_mismatch"),
        "md5": ((6, "bad"), (6, md5), (1, "bad", False), "md5_mismatch"),
        "sidecar": ((6, md5), (6, md5), (6, "bad", True), "sidecar_mismatch"),
        "sidecar-size": ((6, md5), (6, md5), (5, md5, True), "sidecar_mismatch"),
        "unreadable": ((6, md5), (6, md5), (None, None, False), "sidecar_mismatch"),
    }
    remote = spark.createDataFrame([(p, *c[0]) for p, c in cases.items()], "path string, size bigint, md5 string")
    local = spark.createDataFrame([(p, *c[1]) for p, c in cases.items() if c[1]], "path string, size bigint, md5 string")
    side = spark.createDataFrame([(p, *c[2]) for p, c in cases.items() if c[2]], "path string, size bigint, md5 string, readable boolean")
    got = {r.path: r.status for r in manifest.verify_manifest(remote, local, side).collect()}
    assert got == {p: c[3] for p, c in cases.items()}


def test_sync_plan(spark):
    verified = spark.createDataFrame(
        [("p1", "t", 0, "d", "n", "l", "md5_mismatch"), ("p2", "t", 1, "d", "n", "l", "ok"), ("p3", "t", 1, "d", "n", "l", "absent"), ("p4", "t", 1, "", "n", "l", "ok")],
        "path string, tid string, position int, dir string, name string, link string, status string",
    )
    contents = spark.createDataFrame([("t", 0, "a"), ("t", 1, "a"), ("t", 1, "b")], "tid string, position int, content_id string")
    files = spark.createDataFrame([("t", "a"), ("t", "a"), ("u", "b")], "tid string, content_id string")
    present = manifest.batches_present(contents, files)
    assert {r.position: r.present for r in present.collect()} == {0: True, 1: False}
    plan = lambda skip: {r.path: r.action for r in manifest.sync_plan(verified, present, skip).collect()}
    assert plan(True) == {"p1": "skip_batch", "p2": "skip_verified", "p3": "fetch", "p4": "reject"}
    assert plan(False)["p1"] == "fetch"


def test_payloads(spark):
    ok = b'{"status":"ok","data":{"id":"abc","children":{}}}'
    cases = [
        (ok, "", "ok", "", "abc"), (gzip.compress(ok), "gzip", "ok", "", "abc"), (gzip.compress(ok), "", "ok", "", "abc"),
        (gzip.compress(ok), "br, X-Gzip ", "ok", "", "abc"), (gzip.compress(ok[:20]) + gzip.compress(ok[20:]), "", "ok", "", "abc"),
        (ok, "gzip", "", "bad_gzip", None), (gzip.compress(ok)[:20], "", "", "bad_gzip", None), (b"{", "", "", "bad_json", None),
        (b'{"status":"no","data":{"id":"x"}}', "", "no", "bad_status", None), (b"[]", "", "", "bad_json", None), (b"{}", "", "", "bad_status", None),
        (b'{"status":"ok","data":[1]}', "", "ok", "bad_data", None), (b'{"status":"ok","data":"x"}', "", "ok", "bad_data", None),
        (b'{"status":"ok","data":{"id":"a\xff"}}', "", "ok", "", "a\ufffd"), (b'{"status":"ok"}', "", "ok", "", None),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, body binary, content_encoding string")
    got = manifest.decode_payloads(df, "id string").orderBy("i").collect()
    assert [(r.status, r.error, r.data and r.data.id) for r in got] == [c[2:] for c in cases]


def tries(spark, *rows):
    return spark.createDataFrame([("u", i, s, e) for i, (s, e) in enumerate(rows)], "url string, seq int, status bigint, error_kind string")


@pytest.mark.parametrize(
    "rows, retrying, timeouts_only",
    [
        ([(200, "")], ("ok", 1, 200), ("answered", 1, 200)),
        ([(503, ""), (0, "reset"), (301, ""), (204, "")], ("ok", 4, 204), ("answered", 1, 503)),
        ([(503, ""), (404, ""), (200, "")], ("refused", 2, 404), ("answered", 1, 503)),
        ([(500, "")] * 4 + [(200, "")], ("exhausted", 4, 500), ("answered", 1, 500)),
        ([(0, "timeout"), (0, "reset"), (200, "")], ("ok", 3, 200), ("error", 2, 0)),
        ([(0, "timeout")] * 3 + [(200, "")], ("ok", 4, 200), ("exhausted", 3, 0)),
        ([(0, "timeout")], ("unfinished", 1, 0), ("unfinished", 1, 0)),
    ],
)
def test_attempts(spark, rows, retrying, timeouts_only):
    log = tries(spark, *rows)
    assert tuple(manifest.resolve_attempts(log).first())[1:] == retrying
    assert tuple(manifest.resolve_attempts_timeout_only(log).first())[1:] == timeouts_only


TREE = "id string, parent_id string, key string, type string, name string, link string, size bigint, md5 string, password string, password_status string"


def node(id_, parent, key, kind, name, password="", state=""):
    return (id_, parent, key, kind, name, "link-" + id_, 1, "", password, state)


def test_flatten_tree(spark):
    rows = [
        node("R", "", "", "folder", "root"),
        node("f1", "R", "a", "file", "x.tar.gz"), node("f2", "R", "c", "file", "x.tar.gz"), node("d1", "R", "b", "folder", "sub"),
        node("d2", "R", "d", "folder", "sub"), node("f3", "R", "e", "file", "root"), node("d3", "R", "f", "folder", "root"),
        node("f4", "d1", "k", "file", "y"), node("f5", "d2", "k", "file", "y"), node("d4", "d2", "z", "folder", "deep"),
        node("f6", "d4", "q", "file", ".rc"), node("f7", "d4", "r", "file", ".rc"), node("f8", "d3", "k", "file", "locked", "p", "passwordRequired"),
        node("P", "", "", "folder", "open", "p", "passwordOk"), node("p1", "P", "a", "folder", "in"), node("p2", "p1", "a", "folder", "in", "p", "passwordWrong"),
        node("p3", "P", "b", "file", "lost"),
        node("S", "", "", "file", "single"), node("Q", "", "", "file", "single", "p", "passwordRequired"),
        node("C", "", "", "folder", "c"), node("C2", "C", "a", "folder", "C2"), node("c3", "C2", "a", "file", "z"),
    ]
    got = tree.flatten_tree(spark.createDataFrame(rows, TREE)).collect()
    files = [(r.root_id, r.path, r.filename, r.id) for r in sorted(got, key=lambda r: (r.root_id, r.walk_key))]
    assert files == [
        ("C", "C/C2", "z", "c3"),
        ("R", "R", "x.tar.gz", "f1"), ("R", "R/sub", "y", "f4"), ("R", "R", "x.tar(1).gz", "f2"), ("R", "R/sub(1)", "y", "f5"),
        ("R", "R/sub(1)/deep", ".rc", "f6"), ("R", "R/sub(1)/deep", "(1).rc", "f7"), ("R", "R", "root(1)", "f3"), ("R", "R/root(2)", "locked", "f8"),
        ("S", "S", "single", "S"),
    ]


def test_a_folder_that_carries_its_id_twice_in_a_row(spark):
    """B stays in the directory named B; C, named and placed alike, then sees that directory and not its own name."""
    rows = [
        node("A", "", "", "folder", "a"), node("x", "A", "k", "folder", "B"), node("B", "x", "k", "folder", "C"), node("C", "B", "k", "folder", "D"),
        node("D", "C", "k", "folder", "D"), node("f", "C", "m", "file", "f"), node("g", "D", "m", "file", "g"),
    ]
    got = {r.id: r.path for r in tree.flatten_tree(spark.createDataFrame(rows, TREE)).collect()}
    assert got == {"f": "A/B/D", "g": "A/B/D"}


def test_a_tree_of_very_many_levels(spark):
    depth = 5000
    rows = [node("0", "", "", "folder", "top")] + [node(str(i), str(i - 1), "k", "folder", "n") for i in range(1, depth)]
    rows += [node("f", str(depth - 1), "z", "file", "deep"), node("g", "2", "z", "file", "up")]
    got = {r.id: (r.root_id, r.path, len(r.walk_key)) for r in tree.flatten_tree(spark.createDataFrame(rows, TREE)).collect()}
    assert got == {"f": ("0", "/".join(["0"] + ["n"] * (depth - 1)), depth), "g": ("0", "0/n/n", 3)}


def test_nodes_that_hang_on_no_root(spark):
    rows = [node("R", "", "", "folder", "r"), node("ok", "R", "a", "file", "f"), node("in", "R", "b", "folder", "d"), node("ok2", "in", "a", "file", "f")]
    rows += [node(f"c{i}", f"c{(i + 1) % 5}", "k", "folder", "n") for i in range(5)] + [node("self", "self", "k", "folder", "n")]
    rows += [node("below", "c2", "a", "folder", "n"), node("file", "below", "a", "file", "n")]
    rows += [node("lost", "gone", "a", "folder", "n"), node("lost2", "lost", "a", "folder", "n"), node("f2", "lost2", "a", "file", "n"), node("f3", "ok", "a", "file", "n")]
    df = spark.createDataFrame(rows, TREE)
    assert {r.id: r.reason for r in tree.tree_faults(df).collect()} == {n: "cycle" for n in ["c0", "c1", "c2", "c3", "c4", "self", "below", "file"]} | {n: "no parent" for n in ["lost", "lost2", "f2", "f3"]}
    assert {r.id for r in tree.flatten_tree(df).collect()} == {"ok", "ok2"}
    assert tree.tree_faults(df.limit(0)).collect() == [] and tree.flatten_tree(df.limit(0)).collect() == []


def test_name_clashes(spark):
    rows = [node(str(i), "p", str(i), "file", n) for i, n in enumerate(["a", "a", "a(1)", "b", "b"])] + [node("9", "q", "0", "file", "a")]
    got = [tuple(r) for r in tree.name_clashes(spark.createDataFrame(rows, TREE)).collect()]
    assert got == [("p", "a(1)", 2, "1")]
