"""Chat formatting by minimum-cost role repair.

A conversation must follow an automaton of legal turns: maybe a system turn, then user and assistant in turn. Every turn of the input
is kept, relabelled, or merged into the turn before it, and empty turns are put in where one is missing; dynamic programming over
the automaton's states finds the cheapest repair. Of equally cheap repairs, the one with the lowest last state is taken, then the
lowest last but one, and so on.

A conversation may hold a third of all turns, so none is ever in one task. Turns are range-partitioned by conversation and place, and
cut into segments of SEGMENT rows. A segment is first boiled down to the costs from any state to any other; these matrices compose
(minimum of sums), so that a scan gives the costs at each segment's entry. From there each segment knows, for any state it may
end in, in which one it began; these maps compose backwards and give each segment its end. Scans run over groups of SEGMENT
segments, then over groups of groups, as long as a conversation has more than one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.store import kept

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = (None, "system", "user", "assistant")
# Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
# Where a conversation may end; from elsewhere, empty turns follow.
ENDS = (START, USER, ASSISTANT)
MERGE, INSERT, RELABEL, NAME_UNKNOWN = 10, 20, 30, 12
NEVER = 1 << 40
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"

_BITS = 10
SEGMENT = 1 << _BITS
_SHARE_ROWS = 20_000


def _fillers(state: int, target: int) -> list[int] | None:
    """Shortest run of empty turns after which ``target`` is legal; None if there is none."""
    runs: list[tuple[int, list[int]]] = [(state, [])]
    seen = {state}
    for at, run in runs:
        if target in LEGAL[at]:
            return run
        runs.extend((n, [*run, n]) for n in LEGAL[at] if n not in seen)
        seen.update(LEGAL[at])
    return None


def moves() -> list[list[list[tuple[int, str, list[int]]]]]:
    """For each role of the input (0 unknown) and states before and after: cost, action, empty turns put in before."""
    table = []
    for role in range(4):
        rows = []
        for before in range(4):
            row = [(NEVER, "", [])]
            for after in (SYSTEM, USER, ASSISTANT):
                named = 0 if after == role else NAME_UNKNOWN if role == 0 else RELABEL
                word = "keep" if after == role else "relabel"
                options = []
                run = _fillers(before, after)
                if run is not None:
                    options.append((named + INSERT * len(run), word, run))
                if before == after:
                    options.append((named + MERGE, "merge" if word == "keep" else "relabel+merge", []))
                row.append(min(options, default=(NEVER, "", []), key=lambda o: o[0]))
            rows.append(row)
        table.append(rows)
    return table


MOVES = moves()
_COST = [[[MOVES[r][s][g][0] for g in range(4)] for s in range(4)] for r in range(4)]
_END_RUNS = [min(((_fillers(s, e) or []) + [e] for e in ENDS if e != START and _fillers(s, e) is not None), key=len) if s not in ENDS else [] for s in range(4)]
END_COST = [INSERT * len(run) for run in _END_RUNS]
_IDENTITY = [0 if i == j else NEVER for i in range(4) for j in range(4)]


def advance(costs: list[int], role: int) -> list[int]:
    """Costs of the states after one more turn."""
    table = _COST[role]
    return [min(NEVER, min(costs[s] + table[s][g] for s in range(4))) for g in range(4)]


def _compose(left: list[int], right: list[int]) -> list[int]:
    return [min(NEVER, min(left[4 * i + m] + right[4 * m + j] for m in range(4))) for i in range(4) for j in range(4)]


def _through(costs: list[int], matrix: list[int]) -> list[int]:
    return [min(NEVER, min(costs[m] + matrix[4 * m + j] for m in range(4))) for j in range(4)]


def back(costs: list[list[int]], roles: list[int], end: int) -> list[int]:
    """States at and before each turn, last first reversed: the lowest state before, of those that cost no more."""
    path = [end]
    for i in range(len(roles) - 1, -1, -1):
        goal = costs[i + 1][path[-1]]
        table = _COST[roles[i]]
        path.append(next((s for s in range(4) if min(NEVER, costs[i][s] + table[s][path[-1]]) == goal), START))
    return path[::-1]


def _forward(costs: list[int], roles: list[int]) -> list[list[int]]:
    out = [costs]
    for role in roles:
        out.append(advance(out[-1], role))
    return out


def _groups(table: pa.Table, order: str) -> Iterator[tuple[tuple[str, int], pa.Table]]:
    """Rows of each (key, seg), in order."""
    table = table.sort_by([("key", "ascending"), ("seg", "ascending"), (order, "ascending")])
    keys = list(zip(table.column("key").to_pylist(), table.column("seg").to_pylist(), strict=True))
    at = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[at]:
            yield keys[at], table.slice(at, i - at)
            at = i


def _in_groups(rows: DataFrame, columns: list[str], order: str, each: Callable, schema: str) -> DataFrame:
    """Apply ``each`` to the rows of every (key, seg), many small groups to a task."""
    n = rows.count()
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // _SHARE_ROWS)
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for key, group in _groups(table, order):
            out.extend(each(key, group.to_pydict()))
        kinds = [pa.list_(pa.int64()) if "array<long>" in p else pa.string() if p.endswith(" string") else pa.int64() for p in schema.split(", ")]
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    dealt = rows.select(F.pmod(F.xxhash64("key", "seg"), F.lit(parts)).alias("part"), "key", "seg", *columns)
    return dealt.groupBy("part").applyInArrow(run, schema)


def _carried(rows: DataFrame, first: DataFrame, join: Callable, step: Callable, backwards: bool, name: str) -> DataFrame:
    """What is carried into each segment: ``first`` (key, carry) taken through all segments before it (after it, if backwards).

    ``rows`` has key, seg and m. ``join`` makes one m of two neighbours, ``step`` takes a carried value through an m.
    """
    rows = kept(rows, name)
    if rows.groupBy("key").count().where("count > 1").isEmpty():
        return rows.join(first, "key").select("key", "seg", "carry")
    grouped = rows.select("key", F.shiftright("seg", _BITS).alias("seg"), F.col("seg").alias("low"), "m")

    def merge(key, group):
        total = group["m"][0]
        for m in group["m"][1:]:
            total = join(total, m)
        return [(*key, total)]

    def deal(key, group):
        carry, out = group["carry"][0], []
        pairs = list(zip(group["low"], group["m"], strict=True))
        for low, m in reversed(pairs) if backwards else pairs:
            out.append((key[0], low, carry))
            carry = step(carry, m)
        return out

    above = _carried(_in_groups(grouped, ["low", "m"], "low", merge, "key string, seg long, m array<long>"), first, join, step, backwards, name)
    with_carry = grouped.join(above, ["key", "seg"])
    return kept(_in_groups(with_carry, ["low", "m", "carry"], "low", deal, "key string, seg long, carry array<long>"), name)


def _role_number(role: Column) -> Column:
    name = F.lower(F.trim(role))
    for alias, of in ALIASES.items():
        name = F.when(name == alias, of).otherwise(name)
    return F.coalesce(*(F.when(name == ROLES[i], i) for i in (SYSTEM, USER, ASSISTANT)), F.lit(0)).cast("long")


def repaired(conversations: DataFrame) -> DataFrame:
    """A row per turn of the input: ``conv_id``, ``turn``, ``role``, ``text``, and the repair.

    ``place`` orders the rows of a conversation, ``new_role`` is the turn's role, ``action`` one of keep, relabel, merge and
    relabel+merge, ``inserted`` the roles of empty turns put in before, ``rendered`` the turn's part of the rendered conversation:
    the parts in order of place, laid end to end, are the whole.

    Turns are in order of ``turn`` (null first), then role and text, whatever gaps there are. Unknown, empty or null roles get a name; a
    null text reads as empty; a null ``conv_id`` is a conversation of its own; turns that repeat are turns. A conversation that
    would end after its system turn gets an empty user turn. An empty table gives an empty table; further columns are ignored.
    """
    spark = conversations.sparkSession
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n"))
    rows = conversations.select(key.alias("key"), "conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["key", "turn", "role", "text"]
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    turns = kept(sorted_rows.withColumn("seg", F.shiftright("place", _BITS)).withColumn("r", _role_number(F.col("role"))), "turns")

    def matrix(key, group):
        lines = [_IDENTITY[4 * i : 4 * i + 4] for i in range(4)]
        for role in group["r"]:
            lines = [advance(line, role) for line in lines]
        return [(*key, [c for line in lines for c in line])]

    matrices = kept(_in_groups(turns, ["place", "r"], "place", matrix, "key string, seg long, m array<long>"), "turn-costs")
    keys = matrices.select("key").distinct()
    begin = keys.withColumn("carry", F.array(*(F.lit(0 if s == START else NEVER).cast("long") for s in range(4))))
    entry = kept(_carried(matrices, begin, _compose, _through, False, "turn-costs"), "turn-entries")

    def ends(key, group):
        out = _through(group["carry"][0], group["m"][0])
        final = min(range(4), key=lambda s: (out[s] + END_COST[s], s))
        return [(*key, [final])]

    last = matrices.groupBy("key").agg(F.max("seg").alias("seg"))
    final = kept(_in_groups(matrices.join(entry, ["key", "seg"]).join(last, ["key", "seg"], "left_semi"), ["m", "carry"], "seg", ends, "key string, seg long, carry array<long>"), "turn-ends")

    def origins(key, group):
        costs = _forward(group["carry"][0], group["r"])
        return [(*key, [back(costs, group["r"], end)[0] for end in range(4)])]

    came = _in_groups(turns.join(entry, ["key", "seg"]), ["place", "r", "carry"], "place", origins, "key string, seg long, m array<long>")
    exits = _carried(came, final.select("key", "carry"), lambda x, y: [x[y[s]] for s in range(4)], lambda carry, m: [m[carry[0]]], True, "turn-exits")

    def paths(key, group):
        costs = _forward(group["carry"][0], group["r"])
        path = back(costs, group["r"], group["exit"][0][0])
        return [(key[0], place, before, after) for place, before, after in zip(group["place"], path[:-1], path[1:], strict=True)]

    known = turns.join(entry, ["key", "seg"]).join(exits.withColumnRenamed("carry", "exit"), ["key", "seg"])
    states = _in_groups(known, ["place", "r", "carry", "exit"], "place", paths, "key string, place long, before long, after long")
    done = turns.groupBy("key").agg(F.max("place").alias("last"))
    joined = turns.join(states, ["key", "place"]).join(done, "key")
    # What a move means, and what it writes, depends on the role and the two states alone: a fixed table of 4 * 4 * 4 rows.
    meaning = [
        (r, s, g, action, ",".join(ROLES[i] for i in run), ROLES[g], "".join(OPEN.format(ROLES[i]) + CLOSE for i in run), "merge" in action)
        for r in range(4)
        for s in range(4)
        for g, (cost, action, run) in enumerate(MOVES[r][s])
        if cost < NEVER
    ]
    meaning = spark.createDataFrame(meaning, "r long, before long, after long, action string, inserted string, new_role string, filler string, merged boolean")
    joined = joined.join(F.broadcast(meaning), ["r", "before", "after"])
    text = F.coalesce("text", F.lit(""))
    opened = F.concat(F.when(F.col("before") == START, "").otherwise(CLOSE), "filler", F.concat(F.lit("<|"), "new_role", F.lit("|>\n")), text, F.lit("\n"))
    part = F.when(F.col("merged"), F.concat(text, F.lit("\n"))).otherwise(opened)
    tail = F.concat(F.lit(CLOSE), F.element_at(F.array(*(F.lit("".join(OPEN.format(ROLES[i]) + CLOSE for i in run)) for run in _END_RUNS)), (F.col("after") + 1).cast("int")))
    rendered = F.concat(part, F.when(F.col("place") == F.col("last"), tail).otherwise(""))
    return joined.select("conv_id", "turn", "role", "text", "place", "new_role", "action", "inserted", rendered.alias("rendered"))
