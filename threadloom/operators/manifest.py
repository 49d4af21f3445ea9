"""Payloads, file digests, manifests and transfer logs."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


MAX_RETRIES = 3


@F.pandas_udf(T.BinaryType())
def _gunzip(bodies: pd.Series) -> pd.Series:
    """Unpacked bytes; NULL where the data is damaged."""

    def unpack(data):
        out = b""
        try:
            while data:
                stream = zlib.decompressobj(wbits=31)
                out += stream.decompress(data) + stream.flush()
                if not stream.eof:
                    return None
                data = stream.unused_data
        except zlib.error:
            return None
        return out

    return bodies.map(unpack, na_action="ignore")


def has_gzip_encoding(encoding: Column) -> Column:
    tokens = F.transform(F.split(F.lower(encoding), ","), lambda token: F.regexp_replace(token, r"^\s+|\s+\z", ""))
    return F.arrays_overlap(tokens, F.array(F.lit("gzip"), F.lit("x-gzip")))


def decode_payloads(payloads: DataFrame, data_schema: str) -> DataFrame:
    """(body binary, content_encoding) to status, data and error; unpacks gzip by header or by its first two bytes.

    Only packed bodies pass through Python. ``error`` is '', 'bad_gzip', 'bad_json', 'bad_status' or 'bad_data' (not of the
    given shape). Bytes that are no UTF-8 read as replacement characters.
    """
    packed = has_gzip_encoding(F.coalesce("content_encoding", F.lit(""))) | (
        F.hex(F.substring("body", 1, 2)) == "1F8B"
    )
    plain = payloads.withColumn("_packed", packed)
    opened = plain.withColumn("_raw", F.when(F.col("_packed"), _gunzip(F.when(F.col("_packed"), F.col("body")))).otherwise(F.col("body")))
    text = F.make_valid_utf8(F.col("_raw").cast("string"))
    parsed = opened.withColumn("_e", F.from_json(text, "status string, data string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    shaped = F.from_json(text, f"data struct<{data_schema}>, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = parsed.withColumn("_d", shaped)
    error = (
        F.when(F.col("_raw").isNull(), "bad_gzip")
        .when(F.col("_e").isNull() | F.col("_e._bad").isNotNull(), "bad_json")
        .when(F.coalesce("_e.status", F.lit("")) != "ok", "bad_status")
        .when(F.col("_d._bad").isNotNull(), "bad_data")
        .otherwise("")
    )
    return parsed.select(
        *[c for c in payloads.columns if c not in ("body", "content_encoding")],
        F.when(error.isin("", "bad_status", "bad_data"), F.coalesce("_e.status", F.lit(""))).otherwise("").alias("status"),
        error.alias("error"),
        F.when(error == "", F.col("_d.data")).alias("data"),
    )


def file_digest(content: Column) -> Column:
    """struct(size, md5) of text or bytes."""
    return F.struct(F.octet_length(content).cast("bigint").alias("size"), F.md5(content).alias("md5"))


def verify_manifest(remote: DataFrame, local: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Status of each remote file (path, size, md5) against local digests (path, size, md5) and sidecars.

    Sidecars are (path, size, md5, readable). Remote size counts only if positive, remote md5 only if not blank.
    Checks run in this order and the first failure names the status: absent, size_mismatch, md5_mismatch,
    sidecar_mismatch, else ok.
    """
    joined = (
        remote.join(local.select("path", F.col("size").alias("_ls"), F.col("md5").alias("_lm")), "path", "left")
        .join(
            sidecars.select(
                "path", F.col("size").alias("_ss"), F.col("md5").alias("_sm"), F.col("readable").alias("_ok"),
                F.lit(True).alias("_has"),
            ),
            "path",
            "left",
        )
    )
    wanted = F.lower(F.regexp_replace(F.coalesce("md5", F.lit("")), r"^\s+|\s+\z", ""))
    differs = ~F.col("_ok") | (F.col("_ss") != F.col("_ls")) | (F.lower("_sm") != F.lower("_lm"))
    status = (
        F.when(F.col("_ls").isNull() | (F.col("_ls") <= 0), "absent")
        .when((F.col("size") > 0) & (F.col("_ls") != F.col("size")), "size_mismatch")
        .when((wanted != "") & (wanted != F.lower("_lm")), "md5_mismatch")
        .when(F.col("_has") & F.coalesce(differs, F.lit(True)), "sidecar_mismatch")
        .otherwise("ok")
    )
    return joined.withColumn("status", status).drop("_ls", "_lm", "_ss", "_sm", "_ok", "_has")


def batches_present(contents: DataFrame, files: DataFrame) -> DataFrame:
    """(tid, position, present): does every content id that a post (tid, position, content_id) asks for have a local file?

    ``files`` is (tid, content_id): content is kept by thread, and asked for by post.
    """
    counts = files.groupBy("tid", "content_id").agg(F.count(F.lit(1)).alias("n_files"))
    return (
        contents.select("tid", "position", "content_id").distinct()
        .join(counts, ["tid", "content_id"], "left")
        .groupBy("tid", "position")
        .agg(F.bool_and((F.coalesce("n_files", F.lit(0)) > 0) & (F.col("content_id") != "")).alias("present"))
    )


def sync_plan(verified: DataFrame, present: DataFrame, skip_existing: bool = True) -> DataFrame:
    """What to do with each remote file: skip_batch, skip_verified, reject or fetch.

    ``verified`` has tid, position, path, name, link and verify_manifest()'s status. A post with all its content in place is
    left alone when ``skip_existing`` is set; files without path, name or link are refused. A post's files are few, so no
    key is hot and ``verified`` is read once.
    """
    done = present.where(F.col("present") & F.lit(skip_existing)).select("tid", "position", F.lit(True).alias("_done"))
    rows = verified.join(done, ["tid", "position"], "left")
    lacks = (F.col("dir") == "") | (F.col("name") == "") | (F.col("link") == "")
    action = (
        F.when(F.col("_done"), "skip_batch")
        .when(lacks, "reject")
        .when(F.col("status") == "ok", "skip_verified")
        .otherwise("fetch")
    )
    return rows.withColumn("action", action).drop("_done")


def _whole_number(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint")


def is_html_payload(content_type: Column, prefix: Column) -> Column:
    start = F.lower(F.regexp_replace(F.substring(prefix, 1, 512), r"^\s+", ""))
    return F.lower(content_type).contains("text/html") | start.startswith("<!doctype html") | start.startswith("<html")


def audit_transfers(log: DataFrame) -> DataFrame:
    """Add expected_size, accepted and reason to transfers.

    Needs status, content_type, body_prefix, content_length, content_range ('' when absent), part_size, bytes_on_disk.
    Reasons in order: bad_status, html_body, bad_length, incomplete, ok.
    """
    status = F.col("status")
    good = ~status.isin(403, 404, 405, 500) & status.isin(200, 206)
    # A 200 answer to a resumed transfer starts over.
    part = F.when((F.col("part_size") > 0) & (status == 200), 0).otherwise(F.col("part_size"))
    length, ranged = F.col("content_length"), F.col("content_range")
    pieces = F.split(ranged, "/", -1)
    total = F.when(F.size(pieces) == 2, _whole_number(F.get(pieces, F.lit(1))))
    from_range = (part != 0) & (ranged != "")
    known = from_range | (length != "")
    size = F.when(from_range, total).when(length != "", part + _whole_number(length))
    rows = log.withColumn("expected_size", size.cast("bigint")).withColumn("_known", known)
    reason = (
        F.when(~good, "bad_status")
        .when(is_html_payload(F.col("content_type"), F.col("body_prefix")), "html_body")
        .when(F.col("_known") & F.col("expected_size").isNull(), "bad_length")
        .when(F.col("_known") & (F.col("bytes_on_disk") != F.col("expected_size")), "incomplete")
        .otherwise("ok")
    )
    return rows.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "ok").drop("_known")


def transfer_report(audited: DataFrame) -> DataFrame:
    return audited.groupBy("reason").agg(F.count(F.lit(1)).alias("n_transfers"))


def _first_tries(attempts: DataFrame, tries: int) -> DataFrame:
    """The first tries of each URL. Spark keeps only ``tries`` rows per URL in each task before it shuffles them."""
    order = Window.partitionBy("url").orderBy("seq")
    return attempts.withColumn("try", F.row_number().over(order)).where(F.col("try") <= tries)


def _settle(tried: DataFrame, ends: Column, outcome: Column, tries: int) -> DataFrame:
    end = F.min(F.when(ends, F.col("try")))
    last = F.max("try")
    return (
        tried.groupBy("url")
        .agg(
            end.alias("_end"),
            last.alias("_last"),
            F.min_by(F.struct(outcome.alias("outcome"), "status"), F.when(ends, F.col("try"))).alias("_e"),
            F.max_by("status", "try").alias("_ls"),
        )
        .select(
            "url",
            F.coalesce("_e.outcome", F.when(F.col("_last") >= tries, "exhausted").otherwise("unfinished")).alias("outcome"),
            F.coalesce("_end", "_last").cast("bigint").alias("tries"),
            F.when(F.col("_end").isNotNull(), F.col("_e.status")).otherwise(F.col("_ls")).cast("bigint").alias("status"),
        )
    )


def resolve_attempts(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Outcome per URL of tries (url, seq, status, error_kind) in order: the first 2xx wins, a 4xx fails for good,
    anything else (no answer, 5xx, other codes) is tried again, ``max_retries`` + 1 times in all. ``status`` 0 is no answer.
    """
    status = F.col("status")
    answered = F.col("error_kind") == ""
    success = answered & (status >= 200) & (status < 300)
    refused = answered & (status >= 400) & (status < 500)
    outcome = F.when(success, "ok").otherwise("refused")
    return _settle(_first_tries(attempts, max_retries + 1), success | refused, outcome, max_retries + 1)


def resolve_attempts_timeout_only(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """As above under the other policy: any answer settles it, a timeout is tried again, any other error ends it;
    ``max_retries`` tries in all, at least one.
    """
    tries = max(1, max_retries)
    answered = F.col("error_kind") == ""
    outcome = F.when(answered, "answered").otherwise("error")
    return _settle(_first_tries(attempts, tries), answered | (F.col("error_kind") != "timeout"), outcome, tries)
