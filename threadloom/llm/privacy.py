"""Personal data by patterns, and terms that give it away by information-theoretic sanitisation.

Patterns find the protected entities: mail addresses, IP addresses, card and phone numbers. A term that stands by an entity tells
the more about it the more it is bound to it. With probabilities taken from how many contexts (lines) of the whole corpus hold
the term, the entity, and both, the pointwise mutual information of the two is compared with the information of the entity itself:
PMI = log p(e, t) / (p(e) p(t)) >= DISCLOSURE * -log p(e) means that the term gives away at least that part of the entity.
Such terms, seen with the entity in SUPPORT contexts or more, are spans too, wherever they stand in a context of that entity.

Secrets have no pattern of their own: keys, hashes and ids look alike. Every long run of letters and digits is a candidate, and "a candidate
stands here" is one entity whose terms are the words just before it. A candidate is a secret where one of these words, seen before SUPPORT
different candidates or more, gives away that a candidate follows, by the same measure.

DataFrame operations only. Counts are added up in tasks before they are shuffled; entities and terms that very many contexts hold
cost a row per task. Texts are not shuffled: spans found by join come back to rows of ids and offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.store import kept
from threadloom.operators.spread import hash_block, lookup

KINDS = ("email", "ip", "card", "phone")
TERM, SECRET = "term", "secret"
DISCLOSURE, SUPPORT = 0.8, 3
# Words before a candidate that may give it away, within that many code points of its line.
CUES, CUE_REACH = 3, 64

# What the base kinds look like. A search does not begin inside a run that it has just failed on, unless the last
# match ended there, and runs are not given back; both change no match, only the time that long runs take.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Texts without these hold no match that counts.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"(?:[0-9][\x20-]?){16}", "phone": r"\+[0-9]"}
# Words of text as it is; they are lower-cased one by one, so that both searches agree and offsets stay those of the text.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Whole runs of at least 20 characters that hold a digit and a letter.
_CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{20})(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]++"
_SPANS = "array<struct<start:int,stop:int,value:string>>"
# Elements of an array that are gone through one by one; blocks of them are gone through likewise.
_BLOCK = 128


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d < 5, 2 * d).otherwise(2 * d - 9)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(16, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also where lambdas use it again and again."""
    return F.transform(F.array(value), use)[0]


def _blocks(values: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(_BLOCK))
    return F.transform(starts, lambda at: F.slice(values, at, F.lit(_BLOCK)))


def _before(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each integer what ``add`` (associative, 0 neutral) makes of all before it, block by block: growing an array by one element
    copies it, so arrays that grow are short ones."""

    def scan(items: Column, first: Column) -> Column:
        state = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        grow = lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(items, state, grow)["out"]

    def join(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda items: F.aggregate(items, F.lit(0), add))
        return F.flatten(F.zip_with(blocks, scan(whole, F.lit(0)), scan))

    return _once(values, lambda v: _once(_blocks(v), join))


def _cut(text: Column, parts: Column) -> Column:
    """The substrings from ``b`` to ``e`` of ascending ``parts``. A block's stretch of text is taken out first, as finding a place in a
    string means going through it from its begin."""

    def block(items: Column) -> Column:
        low = items[0]["b"]
        high = F.array_max(F.transform(items, lambda p: p["e"]))
        return _once(
            F.struct(low.alias("low"), F.substring(text, low + 1, high - low).alias("text")),
            lambda t: F.transform(items, lambda p: F.substring(t["text"], p["b"] - t["low"] + 1, p["e"] - p["b"])),
        )

    return _once(parts, lambda v: F.flatten(F.transform(_blocks(v), lambda items: F.when(F.size(items) > 0, block(items)).otherwise(F.array().cast("array<string>")))))


def _all_matches(text: Column, pattern: str) -> Column:
    """Matches with their offsets: what is between matches and the matches themselves, laid end to end."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(p: Column) -> Column:
        widths = F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["hit"]))

        def span(x: Column, at: Column) -> Column:
            start = at + F.length(x["gap"])
            return F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("stop"), x["hit"].alias("value"))

        return F.zip_with(p, _before(widths, lambda a, b: a + b), span)

    return _once(_once(hits, lambda h: F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(h)).alias("gap"), h.alias("hit"))), placed)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one kind in code points, end exclusive, leftmost and not overlapping; matches that fail are dropped."""
    found = F.filter(_all_matches(text, _PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    return F.when(text.rlike(_HINTS[kind]), found).otherwise(F.array().cast(_SPANS))


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")))


def _names(kind: str) -> Column:
    """What the entities of a kind are counted by."""
    return F.transform(kind, lambda s: F.concat(F.lit(f"{kind}:"), F.lower(s["value"])))


def _replaced(kind: str) -> Column:
    name = "" if kind == TERM else f"[{kind.upper()}]"
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(name).alias("name")))


def _masked(line: Column, spans: Column) -> Column:
    """The line with spans blanked, as long as before. Spans are of one kind and so do not overlap."""
    starts = F.transform(spans, lambda s: s["start"])
    stops = F.transform(spans, lambda s: s["stop"])
    kept_parts = F.arrays_zip(F.concat(F.array(F.lit(0)), stops).alias("b"), F.concat(starts, F.array(F.length(line))).alias("e"))
    blanks = F.concat(F.transform(spans, lambda s: F.repeat(F.lit(" "), s["stop"] - s["start"])), F.array(F.lit("")))
    parts = F.zip_with(_cut(line, kept_parts), blanks, lambda text, blank: F.concat(text, blank))
    return F.when(F.size(spans) == 0, line).otherwise(F.array_join(parts, ""))


def _entity_lines(documents: DataFrame) -> DataFrame:
    """Lines that hold entities: key, place of the line's first character, the line without its entities, these (kind:value),
    ``copies``, how often the document is there, and a number of their own, which holds once they are written.

    Only texts that may hold entities are looked at; they meet their copies, and a line's place is a running sum over its text.
    """
    may_hold = "|".join(_HINTS.values())
    texts = documents.where(F.col("text").rlike(may_hold)).groupBy("doc_id", F.xxhash64("text").alias("text_hash"))
    texts = texts.agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    lines = texts.select("doc_id", "text_hash", "copies", F.posexplode(F.split("text", "\n", -1)).alias("nth", "line"))
    upto = Window.partitionBy("doc_id", "text_hash").orderBy("nth")
    lines = lines.withColumn("offset", F.sum(F.length("line") + 1).over(upto) - F.length("line") - 1)
    possible = lines.where(F.col("line").rlike(may_hold))
    for kind in KINDS:
        possible = possible.withColumn(kind, base_spans(F.col("line"), kind))
    possible = possible.withColumn("entities", F.array_distinct(F.concat(*map(_names, KINDS)))).where(F.size("entities") > 0)
    for kind in KINDS:
        possible = possible.withColumn("line", _masked(F.col("line"), F.col(kind)))
    return possible.select(F.monotonically_increasing_id().alias("line_id"), "doc_id", "text_hash", "copies", "offset", "line", "entities")


def _distinct_words(line: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(_WORD), F.lit(0)), F.lower))


def _pairs(entity_lines: DataFrame, support: int) -> DataFrame:
    """(entity, term, n_both, n_entity): entities and the terms that share ``support`` contexts with them."""
    entities = entity_lines.select("copies", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    # An entity in fewer contexts than ``support`` has no term in that many: it meets no words.
    often = kept(entities.where(F.col("n_entity") >= support), "entities")
    named = entity_lines.select("line_id", "copies", F.explode("entities").alias("entity")).join(often.select("entity"), "entity")
    words = entity_lines.select("line_id", F.explode(_distinct_words(F.col("line"))).alias("term"))
    both = named.join(words, "line_id").groupBy("entity", "term").agg(F.sum("copies").alias("n_both")).where(F.col("n_both") >= support)
    return both.join(often, "entity").select("entity", "term", "n_both", "n_entity")


def _candidates(documents: DataFrame) -> DataFrame:
    """Runs that may be secrets: ``doc_id``, ``text_hash``, ``start``, ``stop``, a hash of the run, and the words before it (``cues``)."""
    runs = _all_matches(F.col("text"), _CANDIDATE)
    reach = lambda s: F.struct(F.greatest(s["start"] - CUE_REACH, F.lit(0)).alias("b"), s["start"].alias("e"))
    both = _once(runs, lambda r: F.arrays_zip(r.alias("run"), _cut(F.col("text"), F.transform(r, reach)).alias("before")))
    rows = documents.where(F.col("text").rlike(_CANDIDATE)).select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(both).alias("found"))
    words = F.transform(F.regexp_extract_all(F.substring_index("found.before", "\n", -1), F.lit(_WORD), F.lit(0)), F.lower)
    last = F.array_distinct(F.slice(F.reverse(words), 1, CUES))
    return rows.select("doc_id", "text_hash", "found.run.start", "found.run.stop", F.xxhash64("found.run.value").alias("value"), last.alias("cues"))


def _cue_pairs(candidates: DataFrame, support: int) -> DataFrame:
    """As _pairs(), of the one entity SECRET and the words before candidates; ``support`` counts different candidates."""
    n = candidates.count()
    seen = candidates.select("value", F.explode("cues").alias("term")).groupBy("term", "value").agg(F.count(F.lit(1)).alias("n"))
    terms = seen.groupBy("term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("n_values")).where(F.col("n_values") >= support)
    return terms.select(F.lit(SECRET).alias("entity"), "term", "n_both", F.lit(n).cast("bigint").alias("n_entity"))


def _disclosed(documents: DataFrame, pairs: DataFrame, disclosure: float) -> DataFrame:
    """``entity``, ``term`` and ``disclosed`` of written ``pairs``; all lines of ``documents`` are counted, once."""
    lines = documents.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    total = lines.count()
    terms = lines.select(F.explode(_distinct_words(F.col("line"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    information = -F.log(F.col("n_entity") / total)
    # A line may hold more than one candidate.
    shared = F.log(F.least("n_both", "n_term") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    return (
        # All terms are added up in their tasks first; a semi-join would be moved below that and shuffle every occurrence.
        pairs.join(terms.join(pairs.select("term").distinct(), "term"), "term")
        .where(information > 0)
        .select("entity", "term", (shared / information).alias("disclosed"))
        .where(F.col("disclosed") >= disclosure)
    )


def disclosing_terms(documents: DataFrame, entity_lines: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``entity``, ``term``, and ``disclosed``: the part of the entity's information that the term gives away."""
    return _disclosed(documents, kept(_pairs(entity_lines, support), "terms-by-entities"), disclosure)


def secret_spans(candidates: DataFrame, disclosing: DataFrame) -> DataFrame:
    """The candidates that stand behind a term that discloses SECRET: ``doc_id``, ``text_hash``, ``start``, ``stop``."""
    cues = candidates.select("doc_id", "text_hash", "start", "stop", F.explode("cues").alias("term"))
    found = lookup(cues, disclosing.where(F.col("entity") == SECRET).select("term"), ["term"], hash_block("text_hash", "start"))
    return found.select("doc_id", "text_hash", "start", "stop").distinct()


def term_spans(entity_lines: DataFrame, disclosing: DataFrame) -> DataFrame:
    """Where disclosing terms stand in contexts of their entity: ``doc_id``, ``text_hash``, ``start``, ``stop``."""
    asked = entity_lines.select("line_id", F.explode("entities").alias("entity")).join(disclosing, "entity").select("line_id", "term").distinct()
    words = F.regexp_extract_all(F.col("line"), F.lit(_WORD), F.lit(0))
    parts = F.arrays_zip(F.slice(F.split("line", _WORD, -1), 1, F.size(words)).alias("gap"), words.alias("word"))
    rows = entity_lines.join(asked.select("line_id").distinct(), "line_id", "left_semi")
    rows = rows.select("line_id", "doc_id", "text_hash", "offset", F.posexplode(parts).alias("i", "part"))
    upto = Window.partitionBy("line_id").orderBy("i")
    rows = rows.withColumn("stop", F.col("offset") + F.sum(F.length("part.gap") + F.length("part.word")).over(upto))
    rows = rows.select("line_id", "doc_id", "text_hash", "stop", F.length("part.word").alias("size"), F.lower("part.word").alias("term"))
    found = rows.join(asked, ["line_id", "term"], "left_semi")
    return found.select("doc_id", "text_hash", (F.col("stop") - F.col("size")).cast("int").alias("start"), F.col("stop").cast("int").alias("stop")).distinct()


def personal_data(documents: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """Per document: ``doc_id``, ``text_hash``, a list of spans for each base kind, and ``term`` and ``secret`` for what the method adds.

    Null texts read as empty and have no spans. Rows that agree in id and text are one document in the counts' contexts as often
    as they occur, and get the same spans. Null ids are ids like others. An empty table gives an empty table; further columns are
    ignored.
    """
    base = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = kept(base.select("doc_id", F.xxhash64("text").alias("text_hash"), *(base_spans(F.col("text"), k).alias(k) for k in KINDS)), "pii-base")
    lines = kept(_entity_lines(base), "pii-lines")
    candidates = kept(_candidates(base), "pii-candidates")
    pairs = kept(_pairs(lines, support).unionByName(_cue_pairs(candidates, support)), "terms-by-entities")
    disclosing = kept(_disclosed(base, pairs, disclosure), "pii-disclosing")
    spans = term_spans(lines, disclosing).withColumn("kind", F.lit(TERM)).unionByName(secret_spans(candidates, disclosing).withColumn("kind", F.lit(SECRET)))
    of_kind = lambda k: F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("start", "stop"))))
    listed = spans.groupBy("doc_id", "text_hash").agg(of_kind(TERM).alias(TERM), of_kind(SECRET).alias(SECRET))
    listed = listed.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    joined = found.join(listed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return joined.select("doc_id", "text_hash", *KINDS, *(F.coalesce(k, none).alias(k) for k in (TERM, SECRET)))


def personal_data_summary(documents: DataFrame) -> DataFrame:
    """Per document: counts of base kinds, a digest of their spans, and all spans as text."""
    found = personal_data(documents)
    base = F.array_join(F.concat(*(_listed(k, F.col(k)) for k in KINDS)), ",")
    every = F.array_join(F.concat(*(_listed(k, F.col(k)) for k in (*KINDS, TERM, SECRET))), ",")
    return found.select("doc_id", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def sanitised(documents: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``documents`` with spans taken out of ``text``: base kinds and secrets are generalised to their kind, terms are removed.

    Spans that overlap go as one, under the name of the first. All other columns pass through.
    """
    prefix = "_" * (1 + max([0, *(len(c) - len(c.lstrip("_")) for c in documents.columns)]))
    of_id, of_hash, of_spans, own_hash = (prefix + n for n in ("id", "hash", "spans", "own"))
    found = personal_data(documents, disclosure, support).dropDuplicates(["doc_id", "text_hash"])
    found = found.select(F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_hash), F.array_sort(F.concat(*map(_replaced, (*KINDS, TERM, SECRET)))).alias(of_spans))
    rows = documents.withColumn(own_hash, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.col(own_hash) == F.col(of_hash)), "left")
    spans = F.col(of_spans)

    def cleaned(all_spans: Column) -> Column:
        upto = _before(F.transform(all_spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b))
        # Of spans that overlap the first one starts at or behind the end of all before it.
        fresh = F.filter(F.zip_with(all_spans, upto, lambda s, at: F.struct(at.alias("b"), s["start"].alias("e"), s["name"].alias("name"))), lambda p: p["e"] >= p["b"])
        last = F.array_max(F.transform(all_spans, lambda s: s["stop"]))
        end = F.struct(last.alias("b"), F.length("text").alias("e"), F.lit("").alias("name"))
        return _once(F.concat(fresh, F.array(end)), lambda parts: F.array_join(F.zip_with(_cut(F.col("text"), parts), parts, lambda text, p: F.concat(text, p["name"])), ""))

    text = _once(spans, cleaned)
    return joined.withColumn("text", F.when(F.size(spans) > 0, text).otherwise(F.col("text"))).select(*documents.columns)
