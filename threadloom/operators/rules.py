"""Host and path scoped rules: reading, upserting, and matching them against URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import unicode_fields, unicode_trim
from threadloom.functions.urls import decoded_path, host_port, scheme
from threadloom.operators.spread import hash_block, lookup
from threadloom.session import written

SAME_SITE = {1: "Default", 2: "Lax", 3: "Strict", 4: "None"}


def parse_scope_rules(lines: DataFrame) -> DataFrame:
    """Lines (seq, line) of seven tab-separated fields to rules; other columns are carried along.

    Fields: domain, include subdomains, path, secure, expiry, name, value. Blank lines, comments and lines that stay
    short after splitting on white space are skipped; ``#HttpOnly_`` in front sets the flag.
    """
    carried = [c for c in lines.columns if c not in ("seq", "line")]
    trimmed = lines.withColumn("_l", unicode_trim(F.col("line")))
    kept = trimmed.where(
        (F.col("_l") != "") & (F.col("_l").startswith("#HttpOnly_") | ~F.col("_l").startswith("#"))
    ).select(
        "*",
        F.col("_l").startswith("#HttpOnly_").alias("http_only"),
        F.regexp_replace("_l", "^#HttpOnly_", "").alias("_b"),
    )
    tabbed = F.split("_b", "\t", -1)
    fields = kept.withColumn(
        "_f", F.when(F.size(tabbed) >= 7, tabbed).otherwise(unicode_fields(F.col("_b")))
    ).where(F.size("_f") >= 7)
    f = [F.get("_f", F.lit(i)) for i in range(7)]
    subdomains = F.lower(f[1]) == "true"
    bare = f[0]
    domain = (
        F.when(subdomains & (bare != "") & ~bare.startswith("."), F.concat(F.lit("."), bare))
        .when(~subdomains & bare.startswith("."), F.regexp_replace(bare, r"^\.", ""))
        .otherwise(bare)
    )
    epoch = F.when(f[4].rlike(r"^[+-]?[0-9]+\z"), f[4].try_cast("bigint"))
    return fields.select(
        *carried,
        "seq",
        f[5].alias("name"),
        F.array_join(F.slice("_f", F.lit(7), F.size("_f")), "\t").alias("value"),
        domain.alias("domain"),
        f[2].alias("path"),
        F.when(epoch > 0, F.timestamp_seconds(epoch)).alias("expires"),
        F.lit(0).alias("max_age"),
        (F.lower(f[3]) == "true").alias("secure"),
        "http_only",
        F.lit("").alias("same_site"),
    )


def rule_defaults(observed: DataFrame) -> DataFrame:
    """Rules seen in responses: missing domain becomes ``response_host``, missing path '/', and codes become names."""
    names = F.lit("")
    for code, name in SAME_SITE.items():
        names = F.when(F.col("same_site_code") == code, name).otherwise(names)
    return observed.select(
        "seq",
        "name",
        "value",
        F.coalesce(F.nullif("domain", F.lit("")), "response_host").alias("domain"),
        F.coalesce(F.nullif("path", F.lit("")), F.lit("/")).alias("path"),
        "expires",
        "max_age",
        "secure",
        "http_only",
        names.alias("same_site"),
    )


def latest_rules(rules: DataFrame, within: list[str] | None = None) -> DataFrame:
    """One rule per (name, domain, path): the last one's fields at the first one's place.

    A partial aggregate, so a key that makes up much of the input is reduced before it is shuffled. ``within`` names
    columns of separate rule sets.
    """
    key = [*(within or []), "name", "domain", "path"]
    rest = [c for c in rules.columns if c not in (*key, "seq")]
    return (
        rules.groupBy(*key)
        .agg(F.min("seq").alias("seq"), F.max_by(F.struct(*rest), "seq").alias("_last"))
        .select(*key, "seq", "_last.*")
        .select(*rules.columns)
    )


def live_rules(rules: DataFrame, now: Column) -> DataFrame:
    """Without an expiry, or not expired at ``now``."""
    return rules.where(F.col("expires").isNull() | (F.col("expires") >= now))


def host_matches(domain: Column, host: Column) -> Column:
    suffix = domain.startswith(".") & (host.endswith(domain) | (F.concat(F.lit("."), host) == domain))
    return (domain == "") | (domain == host) | suffix


def path_matches(rule_path: Column, path: Column) -> Column:
    rooted = F.when(rule_path.startswith("/"), rule_path).otherwise(F.concat(F.lit("/"), rule_path))
    return rule_path.isin("", "/") | path.startswith(rooted)


def host_keys(host: Column) -> Column:
    """Every non-empty domain that matches ``host``: itself, and each suffix that starts at a dot.

    ``a.b.c`` gives ``a.b.c``, ``.a.b.c``, ``.b.c`` and ``.c``.
    """
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("."), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    return F.array_distinct(F.concat(F.array(host), suffixes))


def url_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Add scheme, host and path; URLs with a malformed path match no rule and are left out."""
    return urls.select(
        "*", scheme(F.col(url)).alias("_scheme"), host_port(F.col(url)).alias("_host"),
        decoded_path(F.col(url)).alias("_path"),
    ).where(F.col("_path").isNotNull())


def _rooted(path: Column) -> Column:
    """The beginning that a rule's path asks for; '' for any path."""
    return F.when(path.isin("", "/"), F.lit("")).when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def match_rules(urls: DataFrame, rules: DataFrame, now: Column, url: str = "url") -> DataFrame:
    """Rows of ``urls`` with the fields of each rule that applies, one row per match.

    A rule is met by equality on two keys: its domain, '' like any other, and the beginning of the path that it asks for. Each distinct
    host unfolds into the domains that can match it and the lengths of beginnings that rules of these domains ask for; a URL then
    unfolds into the beginnings of its path of those lengths only. So only the secure flag is left to check, and a domain that owns many
    URLs and many rules gives no candidates beyond its matches. Hot hosts and keys are spread over blocks of URLs, and rules are rows
    of their own on the way: no list of them is built, however many share a domain and path.
    """
    block = hash_block(*urls.columns)
    applicable = live_rules(rules, now).withColumn("_start", _rooted(F.col("path"))).withColumnRenamed("domain", "_domain")
    lengths = applicable.groupBy("_domain").agg(F.collect_set(F.length("_start")).alias("_lengths"))
    parts = url_parts(urls, url)
    hosts = parts.select("_host").distinct()
    asked = hosts.withColumn("_domain", F.explode(F.array_union(host_keys(F.col("_host")), F.array(F.lit("")))))
    # As many entries as a host has labels and their rules have lengths.
    fitting = lookup(asked, lengths, ["_domain"], hash_block("_host")).groupBy("_host").agg(F.collect_list(F.struct("_domain", "_lengths")).alias("_fits"))
    beginnings = F.flatten(
        F.transform(
            "_fits",
            lambda fit: F.transform(
                F.filter(fit["_lengths"], lambda n: n <= F.length("_path")),
                lambda n: F.struct(fit["_domain"].alias("_domain"), F.substr("_path", F.lit(1), n).alias("_start")),
            ),
        )
    )
    met = lookup(parts, written(fitting, "host-domains"), ["_host"], block).withColumn("_key", F.explode(beginnings))
    started = met.select(*urls.columns, "_scheme", F.col("_key._domain").alias("_domain"), F.col("_key._start").alias("_start"))
    fields = [F.col(c if c != "domain" else "_domain").alias(c) for c in rules.columns]
    rows = applicable.select("_domain", "_start", F.struct(*fields).alias("_rule"))
    found = lookup(started, rows, ["_domain", "_start"], block)
    secure = ~F.col("_rule.secure") | (F.col("_scheme") == "https")
    return found.where(secure).select(*urls.columns, *[F.col(f"_rule.{c}").alias(c) for c in rules.columns])


def rule_headers(matches: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: ``name=value`` pairs joined by '; ' in rule order, with the list of names; nameless rules are left out."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "name", "value")))
    return (
        matches.where(F.col("name") != "")
        .groupBy(*key)
        .agg(ordered.alias("_r"))
        .select(
            *key,
            F.array_join(F.transform("_r", lambda r: F.concat(r["name"], F.lit("="), r["value"])), "; ").alias("header"),
            F.transform("_r", lambda r: r["name"]).alias("names"),
        )
    )


def required_rule(rules: DataFrame, key: list[str], required: str, now: Column) -> DataFrame:
    """Does each rule set hold a rule of this name, once later rules have replaced earlier ones and expired ones are gone?"""
    latest = latest_rules(rules, [c for c in key if c not in ("name", "domain", "path")])
    live = F.col("expires").isNull() | (F.col("expires") >= now)
    return latest.groupBy(*key).agg(F.bool_or((F.col("name") == required) & live).alias("present"))
