"""Document fingerprints by a randomised edit embedding.

All texts are walked over with the same random choices: at step t a walk writes the character it stands on, and a shared random bit for
(t, character) says whether it goes on to the next character. Two walks that an edit has put out of step meet again by chance, so the
Hamming distance of what they write follows the edit distance of the texts. A fingerprint keeps a random bit of what was written at
sampled steps: the first 64, and 64 in each doubling after them, so that it covers the whole text, grows by its logarithm only, and its
steps are the same for all texts. Two walks with choices of their own make a fingerprint.

Near copies are found by bands: bits sampled from short stretches of the two longest doublings that a text fills. In a short stretch two
walks are either in step or not, so its bits agree all at once or hardly ever. Texts with a band in common are verified by their exact
edit distance.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.graph import components
from threadloom.llm.store import kept
from threadloom.llm.words import _fmix

WALKS, SAMPLES = 2, 64
# Bands of each doubling, the steps they stretch over, and the bits sampled from these.
BANDS, STRETCH, BAND_BITS = 24, 64, 32
# Characters share choices by class, and choices repeat after so many steps.
CLASSES, CYCLE = 128, 1 << 14
# Bytes of text walked over at a time, and texts side by side from which on numpy pays.
PIECE, SIDE_BY_SIDE = 1 << 23, 48

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _draws(walk: int, use: int, n: int) -> np.ndarray:
    """``n`` random numbers, the same at every time and place."""
    return _fmix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64((walk * 256 + use + 1) << 40))


@functools.cache
def _jumps(walk: int) -> np.ndarray:
    """By class and step: how many steps the walk stays on a character of that class that it reaches at that step."""
    moves = (_draws(walk, 0, CLASSES * CYCLE).reshape(CLASSES, CYCLE) >> np.uint64(40)) & np.uint64(1)
    out = np.empty((CLASSES, CYCLE), np.uint8)
    for c in range(CLASSES):
        on = np.flatnonzero(moves[c])
        on = np.append(on, on[0] + CYCLE)
        steps = np.arange(CYCLE)
        out[c] = on[np.searchsorted(on, steps)] - steps + 1
    return out.ravel()


@functools.cache
def _sampled(walk: int, blocks: int) -> np.ndarray:
    """Sampled steps: all of block 0, which has SAMPLES steps, then SAMPLES of each block, which is as long as all before it."""
    steps = [np.arange(SAMPLES)]
    for b in range(1, blocks):
        width = SAMPLES << (b - 1)
        steps.append(np.sort(width + (_draws(walk, b, SAMPLES) % np.uint64(width)).astype(np.int64)))
    return np.concatenate(steps)


@functools.cache
def _band_steps(walk: int, block: int) -> np.ndarray:
    """Sampled steps of the bands of a block, a row for each band."""
    low, width = (0, SAMPLES) if block == 0 else (SAMPLES << (block - 1), SAMPLES << (block - 1))
    starts = low + (_draws(walk, 64 + block, BANDS) % np.uint64(max(width - STRETCH, 0) + 1)).astype(np.int64)
    inside = np.sort(np.argsort(_draws(walk, 128 + block, min(STRETCH, width)))[:BAND_BITS])
    return starts[:, None] + inside


def _blocks(end: int) -> int:
    """Blocks that ``end`` steps reach into."""
    return 0 if end == 0 else 1 + max((end - 1) // SAMPLES, 0).bit_length()


def _walk(classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, begin: np.ndarray, walk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Walk over many stretches of characters side by side, each from its own step ``begin``.

    Gives the step at which each character is reached, one stretch after the other, where each stretch begins there, and the steps after
    the last characters.
    """
    jumps = _jumps(walk)
    at = np.concatenate(([0], np.cumsum(lengths)))
    reached = np.empty(int(at[-1]), np.int64)
    order = np.argsort(-lengths, kind="stable")
    side = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0)) + 1), "left")
    step, source, target = begin[order].astype(np.int64), starts[order].astype(np.int64), at[:-1][order].copy()
    rows = classes.astype(np.int32) * CYCLE
    i = 0
    while i < len(side) - 1 and side[i] >= SIDE_BY_SIDE:
        n = side[i]
        now = step[:n]
        reached[target[:n]] = now
        now += jumps[rows[source[:n]] + (now & (CYCLE - 1))]
        source[:n] += 1
        target[:n] += 1
        i += 1
    table = jumps.tobytes()
    for lane in range(side[i] if i < len(side) else 0):
        left = int(lengths[order[lane]]) - i
        t, steps = int(step[lane]), []
        for row in rows[source[lane] : source[lane] + left].tolist():
            steps.append(t)
            t += table[row + (t & (CYCLE - 1))]
        reached[target[lane] : target[lane] + left] = steps
        step[lane] = t
    ends = np.empty(len(lengths), np.int64)
    ends[order] = step
    return reached, at, ends


def _bits(codes: np.ndarray, reached: np.ndarray, steps: np.ndarray, walk: int) -> np.ndarray:
    """The random bits of what a walk writes at the given steps."""
    here = codes[np.searchsorted(reached, steps, "right") - 1].astype(np.uint64)
    return (_fmix(here * _ODD + (steps.astype(np.uint64) << np.uint64(3)) + np.uint64(walk)) >> np.uint64(63)).astype(np.uint8)


def _written(codes: np.ndarray, reached: np.ndarray, end: int, walk: int) -> str:
    """One walk's part of a fingerprint: its steps and the sampled bits, both hexadecimal."""
    steps = _sampled(walk, _blocks(end))
    real = steps[: np.searchsorted(steps, end)]
    bits = np.zeros(len(steps), np.uint8)
    if len(real):
        bits[: len(real)] = _bits(codes, reached, real, walk)
    return f"{end:x}:{np.packbits(bits).tobytes().hex()}"


def _banded(codes: np.ndarray, reached: np.ndarray, end: int, walk: int) -> list[str]:
    """One walk's bands: of the two longest blocks that it fills; a shorter one's is all that it writes."""
    full = (end // SAMPLES).bit_length()
    if full == 0:
        return [f"{walk}-{hashlib.sha256(codes.tobytes()).hexdigest()}"]
    out = []
    for block in range(max(full - 2, 0), full):
        packed = np.packbits(_bits(codes, reached, _band_steps(walk, block), walk), axis=1)
        out += [f"{walk}-{block}-{k}-{row.tobytes().hex()}" for k, row in enumerate(packed)]
    return out


def _read(part: str) -> tuple[int, np.ndarray]:
    end, bits = part.split(":")
    return int(end, 16), np.unpackbits(np.frombuffer(bytes.fromhex(bits), np.uint8))


def likeness(a: str, b: str) -> float:
    """1 less the estimated share of steps at which the walks of two fingerprints write something else, 0 to 1.

    Sampled bits of unlike characters differ half of the time, and a step that only one walk makes differs.
    """
    if a == b:
        return 1.0
    total = 0.0
    for walk, (x, y) in enumerate(zip(a.split("."), b.split("."))):
        (end_x, bits_x), (end_y, bits_y) = _read(x), _read(y)
        shared, all_steps = min(end_x, end_y), max(end_x, end_y)
        if not all_steps:
            total += 1
            continue
        steps, n = _sampled(walk, _blocks(shared)), min(len(bits_x), len(bits_y))
        differs = np.where(steps < shared, bits_x[:n] != bits_y[:n], False).reshape(-1, SAMPLES).sum(1)
        counted = (steps < shared).reshape(-1, SAMPLES).sum(1)
        edges = np.minimum(np.concatenate(([0], SAMPLES << np.arange(len(counted)))), shared)
        unlike = 2 * np.sum(np.diff(edges) * differs / np.maximum(counted, 1)) + all_steps - shared
        total += max(0.0, 1 - unlike / all_steps)
    return total / WALKS


def _classed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    return codes, ((codes * np.uint32(2654435769)) >> np.uint32(25)).astype(np.uint8), offsets


def _of_texts(texts: list[str], cuts: bool = False) -> tuple[list[str], list[list[str]], list[str]]:
    """Fingerprints and bands of ``texts``; with ``cuts`` the fingerprints also of each text (but the last) with its second half
    overwritten from the next one's beginning, and no bands."""
    codes, classes, offsets = _classed(texts)
    starts, lengths = offsets[:-1], np.diff(offsets)
    whole: list[list[str]] = [[] for _ in texts]
    bands: list[list[str]] = [[] for _ in texts]
    edited: list[list[str]] = [[] for _ in texts[1:]]
    for walk in range(WALKS):
        reached, at, ends = _walk(classes, starts, lengths, np.zeros(len(texts), np.int64), walk)
        for k in range(len(texts)):
            mine = slice(at[k], at[k + 1])
            whole[k].append(_written(codes[mine], reached[mine], int(ends[k]), walk))
            if not cuts:
                bands[k] += _banded(codes[mine], reached[mine], int(ends[k]), walk)
        if not cuts or len(texts) < 2:
            continue
        # The kept half is walked over already; the walk goes on from there over the next text.
        half = lengths[:-1] // 2
        stay = lengths[:-1] - half
        begin = np.where(half > 0, reached[np.minimum(at[:-2] + stay, max(len(reached) - 1, 0))] if len(reached) else 0, ends[:-1])
        over = np.minimum(half, lengths[1:])
        late, late_at, late_ends = _walk(classes, starts[1:], over, begin, walk)
        for k in range(len(edited)):
            kept_part, new = slice(at[k], at[k] + stay[k]), slice(starts[k + 1], starts[k + 1] + over[k])
            steps = np.concatenate((reached[kept_part], late[late_at[k] : late_at[k + 1]]))
            edited[k].append(_written(np.concatenate((codes[kept_part], codes[new])), steps, int(late_ends[k]), walk))
    return [".".join(w) for w in whole], bands, [".".join(e) for e in edited]


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about PIECE bytes; a longer text is alone."""
    upto = np.concatenate(([0], np.cumsum(sizes)))
    at = 0
    while at < len(sizes):
        stop = max(int(np.searchsorted(upto, upto[at] + PIECE, "right")) - 1, at + 1)
        yield at, stop
        at = stop


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for first, last in _pieces(np.array([len(t or "") for t in texts])):
            mine = [t or "" for t in texts[first:last]]
            whole, bands, _ = _of_texts(mine)
            columns = [batch.column(0).slice(first, last - first), pa.array([len(t) for t in mine], pa.int64()), pa.array(whole), pa.array(bands, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "fingerprint", "bands"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``n_chars`` (code points), ``fingerprint`` and ``bands`` of each row of ``documents``; nothing is shuffled.

    Null texts count as empty; the empty text's fingerprint has no steps. Equal texts have equal fingerprints. Null ids and repeated rows
    pass through, an empty table gives an empty one, further columns are ignored. Texts are walked over whole, at about 20 bytes a
    character while they are.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(_fingerprint, f"doc_id {kind}, n_chars long, fingerprint string, bands array<string>")


def near_copies(documents: DataFrame, least: float = 0.9) -> DataFrame:
    """``doc_id`` and ``component_id``, the smallest id reachable by links, itself included.

    Texts link when they share a band and their edit distance is at most 1 - ``least`` of the longer one's characters; equal texts
    always do, empty and null ones link with nothing. Equal texts are one node. In each band every text is verified against the band's
    leader, its smallest text by hash; those that the leader does not accept go on among themselves under the next leader until none is
    left, so no link that banding offers is lost and no group is paired with itself. Banding is by chance: of 600 texts
    with random edits in 1, 2, 5 and 10 of 100 characters, 99.7, 97, 90 and 68 in 100 met their original. Null ids are nodes like others and come last. Equal rows get equal results.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.sha2("text", 256))
    texts = kept(rows.where("text != ''").groupBy("node").agg(F.first("text").alias("text")), "edit-texts")
    found = fingerprints(texts.select(F.col("node").alias("doc_id"), "text"))
    left = kept(found.select(F.col("doc_id").alias("node"), F.explode("bands").alias("band")), "edit-bands")
    one, two = (texts.select(F.col("node").alias(n), F.col("text").alias(f"{n}_text")) for n in ("node", "leader"))
    most = F.floor(F.greatest(F.length("node_text"), F.length("leader_text")) * F.lit(1 - least)).cast("int")
    links = None
    while True:
        leaders = left.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        asked = kept(left.join(leaders, "band").where("node != leader"), "edit-asked")
        if asked.isEmpty():
            break
        pairs = asked.select("node", "leader").distinct().join(one, "node").join(two, "leader")
        # levenshtein with a bound gives -1 beyond it.
        close = F.abs(F.length("node_text") - F.length("leader_text")) <= F.col("most")
        near = F.when(close, F.expr("levenshtein(node_text, leader_text, most)") >= 0)
        accepted = kept(pairs.withColumn("most", most).where(near).select("node", "leader"), "edit-links")
        links = accepted if links is None else links.union(accepted)
        left = kept(asked.join(accepted, ["node", "leader"], "left_anti").select("node", "band"), "edit-bands")
    named = rows.select("doc_id", "node", (F.col("text") == "").alias("empty"))
    if links is None:
        grouped = named.withColumn("comp", F.col("node"))
    else:
        number = lambda c: F.conv(F.substring(c, 1, 15), 16, 10).cast("bigint")
        comps = components(links.select(number(F.col("node")).alias("a"), number(F.col("leader")).alias("b")))
        key = comps.select(F.col("node").alias("number"), F.col("comp").cast("string").alias("linked"))
        grouped = named.withColumn("number", number(F.col("node"))).join(key, "number", "left").withColumn("comp", F.coalesce("linked", "node"))
    smallest = kept(grouped.where("not empty").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "edit-components")
    return grouped.join(smallest, "comp", "left").select("doc_id", F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, lent, doc_id, text) in order; each part ends with the text that follows it, lent by another part."""
    before = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if before is None else [before, batch]).combine_chunks()
        texts = [t or "" for t in rows.column("text").to_pylist()]
        part, lent = rows.column("part").to_numpy(), rows.column("lent").to_numpy()
        for first, last in _pieces(np.array([len(t) for t in texts[:-1]])):
            mine = texts[first : last + 1]
            whole, _, edited = _of_texts(mine, cuts=True)
            taken = [k for k in range(last - first) if not lent[first + k] and part[first + k] == part[first + k + 1]]
            hashes = []
            for k in taken:
                half = len(mine[k]) // 2
                hashes.append(hashlib.sha256((mine[k][: len(mine[k]) - half] + mine[k + 1][:half]).encode()).hexdigest())
            ids = rows.column("doc_id").take(pa.array([first + k for k in taken], pa.int64())).combine_chunks()
            columns = [
                ids,
                pa.array([len(mine[k]) for k in taken], pa.int64()),
                pa.array(hashes, pa.string()),
                pa.array([whole[k] for k in taken], pa.string()),
                pa.array([edited[k] for k in taken], pa.string()),
                pa.array([likeness(whole[k], edited[k]) for k in taken], pa.float64()),
                pa.array([likeness(whole[k], whole[k + 1]) for k in taken], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        tail = rows.slice(len(texts) - 1).to_batches()
        before = tail[0] if tail else before


def edit_summary(documents: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of an edited text of each, whose last floor(n / 2) characters are overwritten by as many (or all)
    of the beginning of the next document in descending order of doc_id; after the last comes the first.

    ``near_edited`` and ``near_next`` are the likeness of the fingerprint to the edited text's and to the next document's. Null texts are
    empty, null ids come last, equal ids are in order of a hash of the text, equal rows follow each other. A single document is its own next.

    Texts move once, to parts by range of id; the first document of each part is lent to the part before it. What the driver holds is a
    bound and an id for each part, as range partitioning does.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    shares = [k / parts for k in range(1, parts)]
    bounds = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), F.lit(100 * parts))).first()[0] if shares else []
    rows = rows.withColumn("part", _part(F.col("doc_id"), sorted(set(bounds or []), reverse=True)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), "tie"))
    firsts = rows.groupBy("part").agg(first.alias("first")).select("part", "first.*").orderBy("part").collect()
    heads = [(h.none, h.down, h.tie, p.part) for p, h in zip(firsts, firsts[1:] + firsts[:1])]
    lent = F.broadcast(spark.createDataFrame(heads, "none boolean, down long, head_tie long, lent_to int"))
    is_head = (F.col("doc_id").isNull() == F.col("none")) & F.bitwise_not("doc_id").eqNullSafe(F.col("down")) & (F.col("tie") == F.col("head_tie"))
    own, borrowed = F.struct("part", F.lit(False).alias("lent")), F.struct(F.col("lent_to").alias("part"), F.lit(True).alias("lent"))
    spots = F.array_compact(F.array(own, F.when(F.col("lent_to").isNotNull(), borrowed)))
    dealt = rows.join(lent, is_head, "left").select("doc_id", "text", "tie", F.explode(spots).alias("spot"))
    dealt = dealt.select("spot.part", "spot.lent", "doc_id", "text", "tie").repartitionById(parts, F.col("part"))
    ordered = dealt.sortWithinPartitions("part", "lent", F.col("doc_id").desc_nulls_last(), "tie").drop("tie")
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(_edits, schema)


def _part(doc_id: Column, bounds: list[int]) -> Column:
    """How many of ``bounds`` (descending) an id lies below, found in two steps of about the root of their number; a null id lies below all."""
    if not bounds:
        return F.lit(0)
    step = max(int(len(bounds) ** 0.5), 1)
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda b: doc_id < b))
    group = below(F.array(*[F.lit(g[-1]) for g in groups]))
    inside = F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), group)
    return F.when(doc_id.isNull(), len(bounds)).otherwise(group * step + F.coalesce(below(inside), F.lit(0)))
