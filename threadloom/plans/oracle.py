"""Check SQL for the registered queries: the same results stated over the given tables, without HTML or rule files."""

from __future__ import annotations

from threadloom.plans.inputs import FALLBACK, GENERATED_AT, NOW, START

NL = "chr(10)"
FORUM = "https://forum.example.org/"


def _text(value: str) -> str:
    """A format string with {column} holes as SQL concatenation."""
    out, rest = [], value
    while rest:
        before, brace, rest = rest.partition("{")
        if before:
            pieces = [f"'{piece}'" if piece else "" for piece in before.replace("'", "''").split("\n")]
            out.append(f" || {NL} || ".join(piece or "''" for piece in pieces))
        if brace:
            hole, _, rest = rest.partition("}")
            out.append(f"CAST({hole} AS VARCHAR)")
    return "(" + " || ".join(out) + ")"


def _clock(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def _escape_markdown(text: str) -> str:
    return rf"regexp_replace({text}, '([\\`*_{{}}\[\]()#+\-.!|])', '\\\1', 'g')"


def _escape_html(text: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("''", "&#39;")):
        text = f"replace({text}, '{char}', '{entity}')"
    return text


# Turns with their thread fields, and pages.
_EMPTY = "((c % 20 = 18 AND t = 0) OR (c % 20 = 8 AND t = 2))"
_KEPT = "NOT (page > 1 AND (c * 7 + page) % 11 = 0)"
_GOOD = "c % 10 <> 9"
_ASSEMBLED = "c % 10 <> 9 AND c % 20 <> 18"
_TITLE = _text("Topic #{c} (a_b) & more!")
_URL = f"CASE WHEN c % 3 = 1 THEN {_text(FORUM + 'read.php?tid-{c}.html')} ELSE '{FORUM}' END"
_IMG = "CASE WHEN t % 3 = 1 THEN {} ELSE '' END"
_SHARE = "CASE WHEN t % 4 = 2 THEN {} ELSE '' END"
_BASE = f"""
WITH f AS (
  SELECT conv_id AS c, turn AS t, role, text, CAST(conv_id AS VARCHAR) AS tid,
    CASE WHEN turn = 0 THEN 'tpc' ELSE CAST(conv_id * 100000 + turn AS VARCHAR) END AS post_id,
    CAST(conv_id * 10 + length(role) AS VARCHAR) AS uid,
    make_timestamp(({START} + conv_id * 3600 + turn * 60) * 1000000) AS ts,
    CASE WHEN turn = 0 THEN 1 ELSE (turn - 1) // 3 + 1 END AS page,
    max(turn) OVER (PARTITION BY conv_id) AS mx
  FROM conversations
), own AS (
  SELECT *, CASE WHEN mx = 0 THEN 1 ELSE (mx - 1) // 3 + 1 END AS n_pages,
    CASE WHEN page = 1 THEN t ELSE (t - 1) % 3 + 1 END AS ord,
    CASE WHEN c % 10 = 8 AND t = 1 THEN NULL WHEN c % 10 = 7 AND t = 1 THEN '{FALLBACK}' ELSE {_clock("ts")} END AS post_time,
    CASE WHEN {_EMPTY} THEN '' ELSE replace({_escape_html("text")}, {NL}, '<br/>')
      || {_IMG.format(_text('<br/><img src="//img.example.com/{c % 20}.png" alt="pic" loading="lazy"/>'))}
      || {_SHARE.format(_text("<br/>https://gofile.io/d/s{c % 20}"))} END AS content_html,
    CASE WHEN {_EMPTY} THEN '' ELSE replace(regexp_replace(text, '([\\\\`*_\\[\\]])', '\\\\\\1', 'g'), {NL}, '  ' || {NL})
      || {_IMG.format(_text("  " + chr(10) + "![pic](https://img.example.com/{c % 20}.png)"))}
      || {_SHARE.format(_text("  " + chr(10) + "https://gofile.io/d/s{c % 20}"))} END AS content_md
  FROM f
), pg AS (SELECT DISTINCT c, tid, page, n_pages FROM own),
shown AS (
  SELECT * FROM own WHERE {_GOOD}
  UNION ALL
  SELECT o.* REPLACE (pg.page AS page, 0 AS ord) FROM own o JOIN pg ON o.c = pg.c AND pg.page > 1
  WHERE o.t = 0 AND o.c % 10 <> 9
)
"""

_FLOOR = "CASE WHEN {0} = 0 THEN 'GF' ELSE 'B' || {0} || 'F' END"


def _header(floor: str, position: str, time: str) -> str:
    return (
        """'##### <span id="pid' || post_id || '">' || """ + floor + " || '.[' || " + position
        + r""" || '] \<pid:' || post_id || '\> ' || """ + time + " || ' by UID:' || uid || '(' || role || ')</span>'"
    )


_FOOTER = _text(f"---\n\n*本文档由 threadloom 自动生成*\n\n*生成时间: {GENERATED_AT}*\n")


def _document(entries: str, title: str) -> str:
    """Whole documents in parts of 1000 posts from entries (tid, c, position, md)."""
    return f"""
, entry AS ({entries})
, line AS (
  SELECT tid, position // 1000 AS part, position AS pos, md || {NL} AS md FROM entry
  UNION ALL
  SELECT tid, 0, -1, '## ' || {_escape_markdown(title)} || {_text(chr(10) * 2 + "----" + chr(10) * 2)} FROM (SELECT DISTINCT tid, c FROM entry)
  UNION ALL
  SELECT tid, max(position) // 1000, max(position) + 1, {_FOOTER} FROM entry GROUP BY tid
)
SELECT tid, part, string_agg(md, '' ORDER BY pos) AS markdown FROM line GROUP BY tid, part
"""


def _entry(header: str, body: str) -> str:
    return f"{header} || {NL} || {NL} || CASE WHEN {body} <> '' THEN {body} || {NL} || {NL} ELSE '' END"


_PLAIN_HEADER = _header("CASE WHEN t = 0 THEN '0' ELSE 'B' || t || 'F' END", "t", _clock("ts"))
_RENDER = _BASE + _document(f"SELECT tid, c, t AS position, {_entry(_PLAIN_HEADER, 'text')} AS md FROM f", "'Topic #' || tid || ' (a_b)'")
_LOCAL_MD = (
    "CASE WHEN c % 2 = 1 THEN content_md ELSE replace(replace(content_md, "
    + _text("(https://img.example.com/{c % 20}.png)") + ", " + _text("(images/i{c % 20}.png)") + "), "
    + _text("https://gofile.io/d/s{c % 20}") + ", " + _text("https://gofile.io/d/s{c % 20} (local: shares/s{c % 20})") + ") END"
)
_FORUM_HEADER = _header("CASE WHEN t = 0 THEN '0' ELSE 'B' || ord || 'F' END", "t", "coalesce(post_time, '0001-01-01 00:00:00')")

_POSTS = "tid, {position} AS position, page, {floor} AS floor, post_id, post_time, role AS username, content_html"
_CHECKS = _BASE + f"""
, checks AS (
  SELECT tid, CASE WHEN {_GOOD} THEN max(n_pages) ELSE 1 END AS total_pages,
    CASE WHEN {_GOOD} THEN count(*) FILTER ({_KEPT}) ELSE 1 END AS n_present, {_ASSEMBLED} AS has_first
  FROM pg GROUP BY tid, c
)
SELECT tid, total_pages, n_present, total_pages - n_present AS n_missing,
  has_first AND {{}} AS accepted FROM checks
"""
_REJECTED = _BASE + f"""
, there AS (SELECT * FROM pg WHERE {_KEPT} AND NOT (page = 1 AND c % 11 = 5)),
checks AS (
  SELECT tid, c % 11 <> 5 AS first_present, {_ASSEMBLED} AS has_first,
    CASE WHEN c % 11 = 5 THEN max(page) WHEN {_GOOD} THEN max(n_pages) ELSE 1 END AS total_pages,
    CASE WHEN c % 11 = 5 OR {_GOOD} THEN count(*) ELSE 1 END AS n_present
  FROM there GROUP BY tid, c
), judged AS (
  SELECT *, CASE WHEN NOT first_present THEN 'first page absent' WHEN NOT has_first THEN 'first page in error'
    WHEN total_pages > n_present THEN 'pages missing' END AS reason FROM checks
)
SELECT tid, reason, total_pages, total_pages - n_present AS n_missing FROM judged WHERE reason IS NOT NULL
"""
_MISSING = f"""
SELECT tid, page, CASE WHEN page = 1 THEN '{FORUM}read.php?tid-' || tid || '.html'
  ELSE '{FORUM}read.php?tid-' || tid || '-page-' || page || '.html' END AS url
FROM pg WHERE """
_THREADS = f"SELECT tid, {_TITLE} AS title, {_URL} AS url, 'Board ' || c % 7 AS forum, count(*) AS total_floors, {_clock('min(ts)')} AS created_at"

# Documents with links.
_LINKED = """
WITH d AS (
  SELECT doc_id, doc_id AS d, text, CAST(doc_id // 5 AS VARCHAR) AS tid, doc_id % 5 AS position,
    'https://cdn.example.com/' || doc_id % 50 || '.jpg' AS image,
    'https://cdn.example.com/b/' || doc_id % 30 || '.gif?x=1' AS image2,
    'https://gofile.io/d/c' || doc_id % 20 AS share, 'http://www.gofile.io/d/c' || doc_id % 20 AS share2
  FROM documents
)
"""
_IMAGES = """
, img AS (
  SELECT tid, position, image AS url FROM d
  UNION ALL SELECT tid, position, image2 FROM d WHERE d % 2 = 0
)
"""
_ASSETS = """
, asset AS (
  SELECT tid, image AS url, CASE WHEN d % 11 = 0 THEN '' ELSE 'a' || d % 50 || '.jpg' END AS local, d % 7 <> 0 AS downloaded, d AS seq FROM d WHERE d % 3 <> 2
  UNION ALL SELECT tid, image2, 'b' || d % 30 || '.gif', true, d FROM d WHERE d % 4 = 0
  UNION ALL SELECT tid, image, 'late' || d % 50 || '.jpg', d % 12 = 0, d + 1000000000000 FROM d WHERE d % 6 = 0
), usable AS (
  SELECT tid, url, arg_max(local, seq) AS local FROM asset WHERE downloaded AND local <> '' GROUP BY tid, url
)
"""
_SHARES = """
, rec AS (
  SELECT 0 AS gen, tid, share AS url, 'c' || d % 20 AS content_id, 'shares/c' || d % 20 AS local_dir,
    CASE WHEN d % 5 <> 0 THEN d % 4 + 1 ELSE 0 END AS n_files, d % 5 <> 0 AS downloaded, d AS seq FROM d WHERE d % 2 = 0
  UNION ALL
  SELECT 1, tid, share, 'c' || d % 20, 'new/c' || d % 20, CASE WHEN d % 8 = 0 THEN d % 4 + 1 ELSE 0 END, d % 8 = 0, d FROM d WHERE d % 4 = 0
), kept AS (
  SELECT tid, url, arg_max(content_id, gen) AS content_id, arg_max(local_dir, gen) AS local_dir,
    arg_max(n_files, gen) AS n_files, arg_max(downloaded, gen) AS downloaded,
    min(CASE WHEN gen = 0 THEN seq ELSE seq + 1 + coalesce(last, -1) END) AS seq
  FROM rec LEFT JOIN (SELECT tid, max(seq) AS last FROM rec WHERE gen = 0 GROUP BY tid) USING (tid) GROUP BY tid, url
)
"""


def _md(image: str, image2: str, share: str, share2: str) -> str:
    return f"""text || {NL} || {NL} || '![a](' || {image} || ')' || {NL} || '[plain](' || image || ') ![rel](pics/' || d % 9 || '.png "t")'
  || CASE WHEN d % 2 = 0 THEN {NL} || '![b]( <' || {image2} || '> "title")' || {NL} || 'see ' || {share} ELSE '' END
  || CASE WHEN d % 3 = 0 THEN ' and ' || {share2} || ' again ' || {share} || ' ![a](' || {image} || ')' ELSE '' END"""


# Rules.
_RULES = """
WITH u AS (
  SELECT page_id AS p, page_id % 13 AS kind, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
    '/' || regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS segment
  FROM pages
), r AS (
  SELECT p AS seq, 'n' || p % 5 AS name, 'v' || p || CASE WHEN kind = 7 THEN chr(9) || 'more' ELSE '' END AS value,
    CASE WHEN kind IN (1, 2, 9) THEN '.' || host WHEN kind = 10 THEN '.' || regexp_replace(host, '^[^.]*\\.', '')
      WHEN kind = 11 THEN regexp_replace(host, '^[^.]*\\.', '') ELSE host END AS domain,
    CASE WHEN kind IN (2, 3) THEN segment WHEN kind = 10 THEN substr(segment, 2) ELSE '/' END AS path,
    CASE kind WHEN 1 THEN CAST(2147483647 AS BIGINT) WHEN 2 THEN 1801598486 WHEN 5 THEN 1000000000 END AS epoch,
    kind IN (1, 3) AS secure, kind = 3 AS http_only
  FROM u WHERE kind IN (0, 1, 2, 3, 5, 7, 9, 10, 11)
), latest AS (
  SELECT min(seq) AS seq, name, arg_max(value, seq) AS value, domain, path, arg_max(coalesce(epoch, 0), seq) AS e0,
    arg_max(secure, seq) AS secure, arg_max(http_only, seq) AS http_only
  FROM r GROUP BY name, domain, path
)
"""
_RULE_COLUMNS = (
    "seq, name, value, domain, path, coalesce(strftime(make_timestamp({e} * 1000000), '%Y-%m-%d %H:%M:%S'), '') AS expires, "
    "CAST(0 AS INTEGER) AS max_age, secure, http_only, '' AS same_site"
)
_NOW_EPOCH = f"epoch(TIMESTAMP '{NOW}')"
_MATCHES = rf"""
, parts AS (
  SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages
), hit AS (
  SELECT page_id, seq, name, value FROM parts, latest
  WHERE (e0 = 0 OR e0 >= {_NOW_EPOCH})
    AND (domain = '' OR domain = host OR (domain LIKE '.%' AND (ends_with(host, domain) OR host = substr(domain, 2))))
    AND (latest.path IN ('', '/') OR starts_with(parts.path, CASE WHEN latest.path LIKE '/%' THEN latest.path ELSE '/' || latest.path END))
    AND (NOT secure OR scheme = 'https')
)
"""

# Manifests.
_MANIFEST = """
WITH m AS (
  SELECT doc_id AS d, CAST(doc_id AS VARCHAR) AS path, source AS tid, 'c' || doc_id % 20 AS content_id, doc_id % 5 <> 4 AS here,
    strlen(text) AS n, md5(text) AS h
  FROM documents
), v AS (
  SELECT *, CASE WHEN NOT here OR d % 35 = 0 OR n = 0 THEN 'absent' WHEN d % 7 = 1 THEN 'size_mismatch'
    WHEN d % 7 = 3 THEN 'md5_mismatch' WHEN d % 9 = 0 OR d % 12 = 0 THEN 'sidecar_mismatch' ELSE 'ok' END AS status FROM m
), ready AS (
  SELECT m.tid, m.d % 60 AS position, bool_and(n_files > 0) AS present FROM m JOIN (
    SELECT tid, content_id, count(*) FILTER (here AND (tid <> 'src1' OR content_id <> 'c3')) AS n_files FROM m GROUP BY tid, content_id
  ) n ON m.tid = n.tid AND m.content_id = n.content_id GROUP BY ALL
)
SELECT path, v.tid, CASE WHEN {skip} AND present THEN 'skip_batch' WHEN d % 40 IN (7, 9) THEN 'reject'
  WHEN status = 'ok' THEN 'skip_verified' ELSE 'fetch' END AS action FROM v JOIN ready ON v.tid = ready.tid AND v.d % 60 = ready.position
"""
_TRANSFERS = """
WITH e AS (
  SELECT event_id, event_id AS e, props, event_id % 1000 + 10 AS size,
    CASE WHEN event_id % 4 = 0 THEN event_id % 7 ELSE 0 END AS part,
    [200, 206, 200, 404, 206, 500, 200, 302][event_id % 8 + 1] AS status FROM events
), x AS (
  SELECT *, CASE WHEN status = 200 THEN 0 ELSE part END AS p,
    CASE WHEN e % 3 = 0 THEN size WHEN e % 3 = 1 THEN size + part ELSE size - 1 END AS disk,
    e % 12 = 0 OR e % 12 = 4 OR e % 60 = 8 AS has_range,
    e % 17 = 0 OR e % 19 = 0 OR e % 23 = 0 AS html FROM e
), y AS (
  SELECT *, CASE WHEN p <> 0 AND has_range THEN CASE WHEN e % 12 = 0 THEN size END
      WHEN e % 5 = 0 OR e % 31 = 0 THEN NULL ELSE p + size END AS expected,
    (p <> 0 AND has_range) OR e % 5 <> 0 AS known FROM x
), z AS (
  SELECT *, CASE WHEN status NOT IN (200, 206) THEN 'bad_status' WHEN html THEN 'html_body'
    WHEN known AND expected IS NULL THEN 'bad_length' WHEN known AND disk <> expected THEN 'incomplete' ELSE 'ok' END AS reason FROM y
)
"""
_ATTEMPTS = """
WITH a AS (
  SELECT 'u' || user_id AS url, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS try,
    CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 503 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 301 ELSE 0 END AS status,
    CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'reset' END AS kind FROM events
), b AS (SELECT *, {ends} AS ends FROM a WHERE try <= {tries}),
c AS (SELECT url, min(try) FILTER (ends) AS e, max(try) AS l FROM b GROUP BY url)
SELECT c.url, CASE WHEN e IS NULL THEN CASE WHEN l >= {tries} THEN 'exhausted' ELSE 'unfinished' END
  WHEN {won} THEN '{win}' ELSE '{loss}' END AS outcome, coalesce(e, l) AS tries, CAST(b.status AS BIGINT) AS status
FROM c JOIN b ON b.url = c.url AND b.try = coalesce(e, l)
"""
_STORE = _BASE + f"""
, gen AS (
  SELECT tid, CASE WHEN c % 3 = 0 THEN 'new ' ELSE 'old ' END || tid AS title, count(*) AS total_floors, {_clock("min(ts)")} AS created_at
  FROM f WHERE c % 3 <> 0 OR t < 3 GROUP BY tid, c
)
"""
_FILES = """
WITH s AS (
  SELECT source AS tid, 'c' || doc_id % 20 AS content_id,
    lang || '/' || doc_id || CASE WHEN doc_id % 9 = 0 THEN '.part' ELSE '.txt' END AS path
  FROM documents
), w AS (
  SELECT source AS tid, 'c' || doc_id % 25 AS content_id, min(doc_id) AS seq FROM documents GROUP BY ALL
), n AS (SELECT tid, content_id, count(*) AS k FROM s WHERE {keep} GROUP BY ALL)
"""
_SHARE_MANIFEST = _FILES + """
SELECT w.tid, 'https://gofile.io/d/' || w.content_id AS url, w.content_id, 'shares/' || w.content_id AS local_dir,
  coalesce(k, 0) AS n_files, coalesce(k, 0) > 0 AS downloaded,
  CASE WHEN coalesce(k, 0) > 0 THEN '' ELSE 'download_failed' END AS error, seq
FROM w LEFT JOIN n ON w.tid = n.tid AND w.content_id = n.content_id
"""
_ADDRESSED = """
WITH a AS (
  SELECT source AS tid, 'https://cdn.example.com/x.y/' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '.txt?v=' || doc_id % 3 END AS url,
    md5(text) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '.txt?v=' || doc_id % 3 END AS local, '' AS alt,
    CAST(strlen(text) AS BIGINT) AS file_size, true AS downloaded, doc_id AS seq
  FROM documents
)
"""
_ENTITIES = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"

ORACLE: dict[str, str] = {
    "read_pages": "SELECT page_id, url, length(html) AS html_chars, md5(html) AS html_md5 FROM pages",
    "select_nodes": f"""
WITH n AS (SELECT page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav FROM pages),
x AS (SELECT page_id, unnest(regexp_extract_all(nav, '<a href="[^"]*">[^<]*</a>')) AS a,
  generate_subscripts(regexp_extract_all(nav, '<a href="[^"]*">[^<]*</a>'), 1) - 1 AS ord FROM n)
SELECT page_id, ord, {_ENTITIES.format("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href,
  {_ENTITIES.format("regexp_extract(a, '>([^<]*)<', 1)")} AS text FROM x""",
    "page_title": f"SELECT page_id, trim({_ENTITIES.format('regexp_extract(html, ' + chr(39) + '<h1>(.*?)</h1>' + chr(39) + ', 1)')}) AS title FROM pages",
    "forum_name": _BASE + f"SELECT tid, page, CASE WHEN {_GOOD} THEN 'Board ' || c % 7 ELSE '' END AS forum, CASE WHEN {_GOOD} THEN {_TITLE} ELSE '' END AS title FROM pg",
    "page_ids": _BASE + f"SELECT tid, page, CASE WHEN {_GOOD} THEN {_URL} ELSE '' END AS base_url, CASE WHEN {_GOOD} THEN tid ELSE '' END AS thread_id FROM pg",
    "resolve_thread_ids": _BASE + f"""
SELECT tid AS asked, page, CASE WHEN {_GOOD} THEN tid WHEN c % 4 = 1 THEN '' WHEN c % 4 = 3 THEN 'x' || tid ELSE tid END AS tid,
  CASE WHEN NOT ({_GOOD}) AND c % 4 = 1 THEN 'thread id unknown' ELSE '' END AS tid_error FROM pg""",
    "total_pages": _BASE + f"SELECT tid, page, CASE WHEN {_GOOD} THEN n_pages ELSE 1 END AS total_pages FROM pg",
    "classify_page": _BASE + """
SELECT tid, page, CASE WHEN c % 20 = 18 THEN 'validation_error' WHEN c % 10 <> 9 THEN '' WHEN c // 10 % 3 = 2 THEN 'validation_error' ELSE 'auth_error' END AS error_type,
  CASE WHEN c % 20 = 18 THEN 'VALID001' WHEN c % 10 <> 9 THEN '' WHEN c // 10 % 3 = 2 THEN 'VALID001' ELSE 'AUTH001' END AS error_code,
  CASE WHEN c % 20 = 18 THEN 'no post content' WHEN c % 10 <> 9 THEN '' WHEN c // 10 % 3 = 0 THEN 'challenge page' WHEN c // 10 % 3 = 1 THEN 'not logged in'
    ELSE 'no post table' END AS message FROM pg""",
    "page_error_report": _BASE + """
SELECT CASE WHEN c % 20 = 18 OR c // 10 % 3 = 2 THEN 'validation_error' ELSE 'auth_error' END AS error_type, count(*) AS n_pages
FROM pg WHERE c % 20 = 18 OR c % 10 = 9 GROUP BY 1""",
    "extract_posts": _BASE + f"SELECT tid, page, ord, {_FLOOR.format('ord')} AS floor, post_id, post_time, role AS username, content_html FROM shown",
    "extract_authors": _BASE + """
SELECT tid, page, ord, role AS username, uid, 'face/' || uid || '.png' AS avatar, CAST(t * 37 % 500 AS INTEGER) AS post_count,
  '2020-01-' || lpad(CAST(c % 28 + 1 AS VARCHAR), 2, '0') AS register_date, '2024-02-' || lpad(CAST(c % 28 + 1 AS VARCHAR), 2, '0') AS last_login,
  CASE WHEN t % 2 = 0 THEN 'by ' || role ELSE '' END AS signature FROM shown""",
    "html_to_markdown": _BASE + "SELECT tid, page, ord, content_md FROM shown",
    "parse_post_time": f"""
SELECT event_id, CASE event_id % 7
  WHEN 0 THEN {_clock("ts")} WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:00') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:00')
  WHEN 3 THEN '{FALLBACK}' WHEN 4 THEN coalesce({_clock("try_strptime(strftime(ts, '%Y-%m') || '-31 01:02:03', '%Y-%m-%d %H:%M:%S')")}, '{FALLBACK}')
  WHEN 5 THEN '{FALLBACK[:4]}-' || strftime(ts, '%m-%d %H:%M:00') END AS post_time FROM events""",
    "page_plan": _BASE + _MISSING + _ASSEMBLED,
    "missing_pages": _BASE + _MISSING + f"{_GOOD} AND NOT ({_KEPT})",
    "missing_page_lists": _BASE + f"""
SELECT tid, (page - 1) // 2 AS block, string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) AS missing FROM pg
WHERE {_GOOD} AND NOT ({_KEPT}) GROUP BY 1, 2""",
    "page_completeness_strict": _CHECKS.format("total_pages = n_present"),
    "page_completeness_lenient": _CHECKS.format("true"),
    "rejected_threads": _REJECTED,
    "assemble_threads": _BASE + f"{_THREADS} FROM own WHERE {_ASSEMBLED} GROUP BY tid, c",
    "assemble_threads_lenient": _BASE + f"{_THREADS} FROM own WHERE {_ASSEMBLED} AND {_KEPT} GROUP BY tid, c",
    "assemble_posts": _BASE + "SELECT " + _POSTS.format(
        position="row_number() OVER (PARTITION BY c ORDER BY t) - 1",
        floor=_FLOOR.format("CASE WHEN page = 1 THEN t ELSE (t - 1) % 3 END"),
    ) + f" FROM own WHERE {_ASSEMBLED} AND NOT (page > 1 AND (t - 1) % 3 = 0)",
    "assemble_posts_continuous": _BASE + "SELECT " + _POSTS.format(position="t", floor=_FLOOR.format("t")) + f" FROM own WHERE {_ASSEMBLED}",
    "reply_blocks": _BASE + f"""
SELECT tid, (t - 1) // 2 AS block, string_agg(t || ':' || post_id, ',' ORDER BY t) AS replies FROM own
WHERE t > 0 AND {_ASSEMBLED} GROUP BY 1, 2""",
    "render_threads": _RENDER,
    "list_assets": "SELECT tid, part, CAST(strlen(markdown) AS BIGINT) AS size FROM (" + _RENDER + ")",
    "render_entry_headers": _BASE + f"SELECT tid, t AS position, {_PLAIN_HEADER} AS header FROM f",
    "escape_markdown": f"SELECT doc_id, {_escape_markdown('text')} AS escaped FROM documents",
    "render_forum_threads": _BASE + _document(
        f"SELECT tid, c, t AS position, {_entry(_FORUM_HEADER, _LOCAL_MD)} AS md FROM own WHERE {_ASSEMBLED}", _TITLE
    ),
    "export_threads": _RENDER,
    "export_shards": _RENDER,
    "extract_image_links": _LINKED + f"""
SELECT doc_id, CAST(CASE WHEN d % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_urls, image || CASE WHEN d % 2 = 0 THEN {NL} || image2 ELSE '' END AS urls FROM d""",
    "extract_share_links": _LINKED + f"""
, l AS (SELECT doc_id, 'c' || d % 20 AS cid, CASE WHEN d % 3 = 0 THEN [share2, share] WHEN d % 2 = 0 THEN [share] ELSE [] END AS urls FROM d)
SELECT doc_id, array_to_string(urls, {NL}) AS urls, array_to_string(list_transform(urls, lambda u: cid), ',') AS content_ids FROM l""",
    "resolve_assets": _LINKED + _IMAGES + _ASSETS + "SELECT img.tid, position, img.url, coalesce(local, '') AS local FROM img LEFT JOIN usable ON img.tid = usable.tid AND img.url = usable.url",
    "pending_assets": _LINKED + _IMAGES + _ASSETS + "SELECT DISTINCT tid, url FROM img WHERE (tid, url) NOT IN (SELECT (tid, url) FROM usable)",
    "resolve_shares": _LINKED + _SHARES + """
, l AS (
  SELECT tid, position, share AS url FROM d WHERE d % 2 = 0 OR d % 3 = 0
  UNION ALL SELECT tid, position, share2 FROM d WHERE d % 3 = 0
)
SELECT l.tid, position, l.url, coalesce(local_dir, '') AS local_dir FROM l LEFT JOIN kept ON l.tid = kept.tid AND l.url = kept.url AND downloaded""",
    "share_upsert": _LINKED + _SHARES + "SELECT tid, url, content_id, local_dir, CAST(n_files AS BIGINT) AS n_files, downloaded, CASE WHEN downloaded THEN '' ELSE 'download_failed' END AS error, seq FROM kept",
    "rewrite_image_links": _LINKED + _ASSETS + f"""
SELECT doc_id, {_md("coalesce('images/' || a.local, image)", "coalesce('images/' || b.local, image2)", "share", "share2")} AS md
FROM d LEFT JOIN usable a ON d.tid = a.tid AND image = a.url LEFT JOIN usable b ON d.tid = b.tid AND image2 = b.url""",
    "annotate_share_links": _LINKED + _SHARES + f"""
SELECT doc_id, {_md("image", "image2", "share || coalesce(' (local: ' || local_dir || ')', '')", "share2")} AS md
FROM d LEFT JOIN kept ON d.tid = kept.tid AND share = kept.url AND downloaded""",
    "append_assets": _LINKED.rstrip() + _ASSETS.rstrip() + _ADDRESSED.replace("WITH a AS", ", a AS").rstrip() + """
SELECT tid, url, local, '' AS alt, (seq % 1000000000000) * 3 AS file_size, downloaded, seq FROM asset
UNION ALL SELECT tid, url, local, alt, file_size, downloaded, seq + 1 + coalesce((SELECT max(x.seq) FROM asset x WHERE x.tid = a.tid), -1) FROM a""",
    "carry_records": _LINKED.rstrip() + _ASSETS + """
SELECT tid, url, local, '' AS alt, (seq % 1000000000000) * 3 AS file_size, downloaded, seq FROM asset
UNION ALL
SELECT tid, image, md5(text) || '.jpg', '', CAST(strlen(text) AS BIGINT), true, d + 1 + coalesce((SELECT max(x.seq) FROM asset x WHERE x.tid = d.tid), -1)
FROM d WHERE (tid, image) NOT IN (SELECT (tid, url) FROM usable) QUALIFY row_number() OVER (PARTITION BY tid, image ORDER BY d) = 1""",
    "content_address": _ADDRESSED + "SELECT * FROM a",
    "asset_files": _ADDRESSED + "SELECT tid, local, min(file_size) AS file_size, count(*) AS n_records FROM a GROUP BY tid, local",
    "share_manifest": _SHARE_MANIFEST.format(keep="true"),
    "share_manifest_complete_files": _SHARE_MANIFEST.format(keep="path NOT LIKE '%.part'"),
    "share_file_lists": _FILES.format(keep="true") + f"""
, o AS (SELECT tid, content_id, 'shares/' || content_id || '/' || path AS path, row_number() OVER (PARTITION BY tid, content_id ORDER BY path) - 1 AS i FROM s)
SELECT tid, content_id, i // 5 AS block, string_agg(path, {NL} ORDER BY path) AS files FROM o GROUP BY 1, 2, 3""",
    "parse_scope_rules": _RULES + f"SELECT {_RULE_COLUMNS.format(e='epoch')} FROM r",
    "rule_defaults": """
WITH o AS (
  SELECT page_id AS seq, page_id AS p, 's' || page_id % 4 AS name, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages
), q AS (
  SELECT *, CASE WHEN p % 3 = 0 THEN '.' ELSE '' END || host AS domain, CASE WHEN p % 2 = 0 THEN '/en' ELSE '/' END AS path FROM o
), k AS (SELECT name, domain, path, min(seq) AS seq, max(seq) AS l FROM q GROUP BY ALL)
SELECT seq, name, 'v' || l AS value, domain, path, '' AS expires, CAST(l % 3 * 60 AS INTEGER) AS max_age, l % 7 = 0 AS secure, l % 5 = 0 AS http_only,
  ['', 'Default', 'Lax', 'Strict', 'None', ''][l % 6 + 1] AS same_site FROM k""",
    "latest_rules": _RULES + f"SELECT {_RULE_COLUMNS.format(e='nullif(e0, 0)')} FROM latest",
    "live_rules": _RULES + f"SELECT {_RULE_COLUMNS.format(e='epoch')} FROM r WHERE epoch IS NULL OR epoch >= {_NOW_EPOCH}",
    "match_rules": _RULES + _MATCHES + "SELECT page_id, seq, name, value FROM hit",
    "rule_headers": _RULES + _MATCHES + """
SELECT page_id, string_agg(name || '=' || value, '; ' ORDER BY seq) AS header,
  string_agg(name, ',' ORDER BY seq) AS names FROM hit GROUP BY 1""",
    "required_rule": _RULES + f"SELECT domain, bool_or(name = 'n3' AND (e0 = 0 OR e0 >= {_NOW_EPOCH})) AS present FROM latest GROUP BY domain",
    "file_digest": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS md5 FROM documents",
    "verify_manifest": _MANIFEST.split("SELECT path, v.tid, CASE")[0] + "SELECT path, status FROM v",
    "sync_plan": _MANIFEST.format(skip="true"),
    "sync_plan_always_check": _MANIFEST.format(skip="false"),
    "decode_payloads": """
WITH b AS (
  SELECT event_id, props, CASE WHEN event_id % 50 = 2 THEN 'bad_gzip' WHEN event_id % 45 = 1 THEN 'bad_json'
    WHEN event_id % 45 = 7 THEN 'bad_data' WHEN event_id % 10 = 0 THEN 'bad_status' ELSE '' END AS error FROM events
)
SELECT event_id, CASE error WHEN '' THEN 'ok' WHEN 'bad_data' THEN 'ok' WHEN 'bad_status' THEN 'error' ELSE '' END AS status, error,
  CASE WHEN error = '' THEN CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) ELSE -1 END AS k FROM b""",
    "audit_transfers": _TRANSFERS + "SELECT event_id, coalesce(expected, -1) AS expected_size, reason = 'ok' AS accepted, reason FROM z",
    "transfer_report": _TRANSFERS + "SELECT reason, count(*) AS n_transfers FROM z GROUP BY reason",
    "resolve_attempts": _ATTEMPTS.format(
        ends="kind = '' AND (status BETWEEN 200 AND 299 OR status BETWEEN 400 AND 499)", tries=4, won="b.status = 200", win="ok", loss="refused"
    ),
    "resolve_attempts_timeout_only": _ATTEMPTS.format(ends="kind <> 'timeout'", tries=3, won="b.kind = ''", win="answered", loss="error"),
    "dedupe_names": """
WITH q AS (
  SELECT p_brand AS parent_id, CAST(p_partkey AS VARCHAR) AS key, p_partkey AS k, p_name AS n, CASE WHEN p_partkey % 8 = 1 THEN '.tar.gz' ELSE '.bin' END AS x FROM part
), o AS (SELECT *, row_number() OVER (PARTITION BY parent_id, n || x ORDER BY key) - 1 AS repeat FROM q)
SELECT parent_id, key, CASE WHEN repeat = 0 THEN n || x WHEN k % 4 = 0 THEN n || x || '(' || repeat || ')'
  WHEN x = '.bin' THEN n || '(' || repeat || ').bin' ELSE n || '.tar(' || repeat || ').gz' END AS final_name, repeat FROM o""",
    "flatten_tree": """
WITH g AS (
  SELECT n_nationkey AS k, n_name, r_regionkey AS r, CASE WHEN n_nationkey % 10 = 0 THEN r_name ELSE 'Nation ' || n_nationkey % 2 END AS name, r_name
  FROM nation JOIN region ON n_regionkey = r_regionkey
), h AS (
  SELECT *, row_number() OVER (PARTITION BY r, name ORDER BY n_name) - CASE WHEN name = r_name THEN 0 ELSE 1 END AS rep FROM g
), c AS (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY CAST(c_custkey AS VARCHAR)) - 1 AS rep FROM customer
)
SELECT 'r' || r AS root_id, 'c' || c_custkey AS id, 'r' || r || '/' || name || CASE WHEN h.rep > 0 THEN '(' || h.rep || ')' ELSE '' END AS path,
  c_mktsegment || CASE WHEN c.rep > 0 THEN '(' || c.rep || ')' ELSE '' END || '.txt' AS filename, 'https://files.example.com/' || c_custkey AS link,
  c_custkey % 900 + 1 AS size, md5(c_name) AS md5, n_name || '/' || c_custkey AS walk_key
FROM c JOIN h ON c_nationkey = k WHERE r <> 2""",
    "tree_faults": """
WITH f AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 10 = 5 THEN 'no parent' ELSE 'cycle' END AS reason FROM nation WHERE n_nationkey % 10 IN (3, 4, 5))
SELECT 'n' || k AS id, reason FROM f UNION ALL SELECT 'c' || c_custkey, reason FROM customer JOIN f ON c_nationkey = k""",
    "flatten_broken_tree": """
SELECT 'r' || n_regionkey AS root_id, 'c' || c_custkey AS id, n_name || '/' || c_custkey AS walk_key
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2 AND n_nationkey % 10 NOT IN (3, 4, 5)""",
    "name_clashes": """
WITH q AS (
  SELECT p_brand AS parent_id, p_partkey AS k, p_type || CASE p_partkey % 40 WHEN 7 THEN '(1)' WHEN 9 THEN '(2)' ELSE '' END AS base FROM part
), o AS (SELECT *, row_number() OVER (PARTITION BY parent_id, base ORDER BY k) - 1 AS repeat FROM q)
SELECT parent_id, base || CASE WHEN repeat = 0 THEN '' ELSE '(' || repeat || ')' END || '.bin' AS final_name, count(*) AS n_nodes, min(lpad(CAST(k AS VARCHAR), 12, '0')) AS first_key
FROM o GROUP BY ALL HAVING count(*) > 1""",
    "upsert_threads": _STORE + "SELECT tid, title, total_floors, created_at, total_floors AS n_posts, 'first.png' AS local FROM gen",
    "merge_threads": """
WITH n AS (
  SELECT CAST(conv_id AS VARCHAR) AS tid, count(*) AS a, count(*) FILTER (role <> 'system' AND conv_id % 3 = 0) AS b FROM conversations GROUP BY conv_id
)
SELECT tid, CASE WHEN b > 0 THEN 'new' ELSE 'old' END AS title, CASE WHEN b > 0 THEN b ELSE a END AS total_floors FROM n""",
    "export_stored_metadata": _BASE + f"""
SELECT tid, {_TITLE} AS title, count(*) AS total_floors, CASE WHEN c % 2 = 0 THEN 'i' || c % 20 || '.png' ELSE '' END AS image,
  CASE WHEN c % 2 = 0 THEN 'https://gofile.io/d/s' || c % 20 ELSE '' END AS share, CASE WHEN c % 4 = 0 THEN 1 WHEN c % 2 = 0 THEN 2 ELSE 0 END AS n_files,
  CASE WHEN c % 4 = 0 THEN 'shares/s' || c % 20 || '/c.txt' WHEN c % 2 = 0 THEN 'shares/s' || c % 20 || '/a.txt,shares/s' || c % 20 || '/b.txt' ELSE '' END AS files
FROM own WHERE {_ASSEMBLED} GROUP BY tid, c""",
    "compacted_store": _BASE + """
SELECT tid, 'generation ' || CASE WHEN c % 6 = 0 THEN 5 ELSE c % 6 END AS title, count(*) FILTER (c % 6 <> 0 OR t <= 5) AS n_posts,
  CASE WHEN c % 6 = 0 THEN '0.png,1.png,2.png,3.png,4.png,5.png' ELSE (c % 6) || '.png' END AS images
FROM f GROUP BY tid, c""",
    "load_threads": _STORE + """
, w AS (SELECT DISTINCT CASE WHEN c % 5 = 4 THEN 'x' || tid WHEN c % 50 = 10 THEN '' ELSE tid END AS tid FROM f)
SELECT w.tid, coalesce(title, '') AS title, coalesce(total_floors, 0) AS total_floors,
  CASE WHEN title IS NOT NULL THEN '' WHEN w.tid = '' THEN 'tid is empty' ELSE 'thread not found in store' END AS error FROM w LEFT JOIN gen ON w.tid = gen.tid""",
    "ingest_pages_stream": _BASE + f"""
SELECT tid, {_TITLE} AS title, count(*) AS total_floors, count(*) AS n_posts, min(post_id) AS min_post_id FROM own
WHERE {_ASSEMBLED} GROUP BY tid, c""",
}

ORACLE["select_nodes_sql"] = ORACLE["select_nodes"]
ORACLE["publish_twice"] = ORACLE["ingest_pages_stream"]
ORACLE["export_stored_threads"] = ORACLE["render_forum_threads"]
