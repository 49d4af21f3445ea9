"""License scans by template markup, compiled to token automata.

A template is a license notice as words with markup: ``[...]`` may be left out, ``<m-n>`` stands for m to n replaceable words,
``(a|b)`` for either wording. All other words are mandatory and must match exactly, in order, with nothing between them.
Templates are compiled to one automaton over words, made deterministic as it is used. A text is read once, word by
word; a run begins where a template's first word stands, and ends when no template can go on, so memory does not depend on the
length of a text. Phrases that name a license without a notice around them are templates without markup.

Texts stay where they are read; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of common public license notices, lower-cased, punctuation left out.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [the software] to deal in the software without restriction"),
    ("mit", "(released|licensed|distributed|available) under [the terms of] the mit license"),
    ("apache", "licensed under the apache license version 2 0 [the license [you may not use this file except in compliance with the license]]"),
    ("gpl", "licensed under [the terms of] the gnu general public license version <1-1> [or [at your option] any later version]"),
    ("gpl", "under the terms of the gnu [lesser] general public license as published by the free software foundation"),
    ("cc-by", "licensed under [a] [the] [creative commons] cc by (3|4) 0 [international] [license]"),
    ("cc-by-sa", "licensed under [a] [the] [creative commons] cc by sa (3|4) 0 [international] [license]"),
    ("cc-by-nc", "licensed under [a] [the] [creative commons] cc by nc (3|4) 0 [international] [license]"),
    ("cc-by", "creative commons attribution (3|4) 0 [international] [public] license"),
    ("cc-by-nc", "creative commons attribution noncommercial (3|4) 0 [international] [public] license"),
    ("cc0", "creative commons (zero|cc0) [1 0 universal]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "(released|licensed|distributed|available) under the [<1-1>] bsd license"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "copyright [c] <1-8> all rights reserved"),
)

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARKUP = re.compile(r"<(\d+)-(\d+)>|[\[\]()|]|[^\s\[\]()|<>]+")
_PIECE = 1 << 20


class Automaton:
    """Templates over words. States are sets of positions; ``step`` makes the transitions when they are first needed."""

    def __init__(self, templates):
        self.moves: list[list[tuple[bytes | None, int]]] = []
        self.free: list[list[int]] = []
        self.final: dict[int, int] = {}
        self.labels = [label for label, _ in templates]
        self.mandatory: list[int] = []
        starts = []
        for number, (_, text) in enumerate(templates):
            tokens = [m for m in _MARKUP.finditer(text)]
            begin = self._position()
            end, rest = self._sequence(tokens, 0, begin)
            if rest != len(tokens):
                raise ValueError(f"unmatched markup in template: {text}")
            self.final[end] = number
            starts.append(begin)
        self.alphabet = {w for moves in self.moves for w, _ in moves if w is not None}
        self.sets: list[frozenset[int]] = []
        self.number: dict[frozenset[int], int] = {}
        self.table: list[dict[bytes | None, int]] = []
        self.accepts: list[list[int]] = []
        self.start = self._state(self._closure(starts))
        self.first = {w for p in self.sets[self.start] for w, _ in self.moves[p] if w is not None}
        if any(w is None for p in self.sets[self.start] for w, _ in self.moves[p]) or self.accepts[self.start]:
            raise ValueError("a template must begin with a mandatory word")

    def _position(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _sequence(self, tokens, at: int, here: int) -> tuple[int, int]:
        """Add elements until a closing mark; returns the last position and the next token."""
        while at < len(tokens) and tokens[at].group() not in ("]", ")", "|"):
            token = tokens[at]
            after = self._position()
            if token.group() == "[":
                inner, at = self._sequence(tokens, at + 1, here)
                self.free[inner].append(after)
                self.free[here].append(after)
            elif token.group() == "(":
                while True:
                    branch = self._position()
                    self.free[here].append(branch)
                    inner, at = self._sequence(tokens, at + 1, branch)
                    self.free[inner].append(after)
                    if tokens[at].group() == ")":
                        break
            elif token.group(1):
                low, high = int(token.group(1)), int(token.group(2))
                for i in range(high):
                    if i >= low:
                        self.free[here].append(after)
                    step = self._position()
                    self.moves[here].append((None, step))
                    here = step
                self.free[here].append(after)
            else:
                self.moves[here].append((token.group().encode(), after))
            here = after
            at += 1
        return here, at

    def _closure(self, positions) -> frozenset[int]:
        seen, open_ = set(positions), list(positions)
        while open_:
            for p in self.free[open_.pop()]:
                if p not in seen:
                    seen.add(p)
                    open_.append(p)
        return frozenset(seen)

    def _state(self, positions: frozenset[int]) -> int:
        if positions not in self.number:
            self.number[positions] = len(self.sets)
            self.sets.append(positions)
            self.table.append({})
            self.accepts.append(sorted(self.final[p] for p in positions if p in self.final))
        return self.number[positions]

    def step(self, state: int, word: bytes) -> int:
        """Next state, -1 if no template goes on."""
        key = word if word in self.alphabet else None
        row = self.table[state]
        if key not in row:
            reached = self._closure({to for p in self.sets[state] for w, to in self.moves[p] if w is None or w == key})
            row[key] = self._state(reached) if reached else -1
        return row[key]


def words_of(raw: bytes) -> Iterator[bytes]:
    """Lower-cased words of UTF-8 text, in pieces cut between words."""
    at = 0
    while at < len(raw):
        stop = min(at + _PIECE, len(raw))
        while stop < len(raw) and _WORD.match(raw[stop : stop + 1].lower()):
            stop += 1
        yield from _WORD.findall(raw[at:stop].lower())
        at = stop


def scan(automaton: Automaton, raw: bytes) -> tuple[int, list[tuple[int, int, int]]]:
    """Number of words, and (template, first word, words) of every match; of one template and begin, the longest."""
    found: dict[tuple[int, int], int] = {}
    runs: list[tuple[int, int]] = []
    first, step, accepts = automaton.first, automaton.step, automaton.accepts
    n = 0
    for n, word in enumerate(words_of(raw), 1):
        if runs or word in first:
            if word in first:
                runs.append((automaton.start, n - 1))
            after = []
            for state, begin in runs:
                state = step(state, word)
                if state >= 0:
                    after.append((state, begin))
                    for template in accepts[state]:
                        found[template, begin] = n - begin
            runs = after
    return n, [(t, b, size) for (t, b), size in sorted(found.items(), key=lambda x: (x[0][1], x[0][0]))]


_FOUND_SQL = "n_words long, spans array<struct<label: string, base: boolean, first: long, words: long, sure: double>>"


def license_spans(documents: DataFrame, templates=TEMPLATES, phrases=None) -> DataFrame:
    """All columns of ``documents`` but ``text``, with ``n_words`` and ``spans``: every match of a phrase (``base``) or template.

    A span has its label, first word (from 0), number of words, and how sure it is: the share of its words that the template
    fixes, half for a phrase alone. Null texts read as empty, and a text without words has no spans. Rows that repeat are
    scanned each; columns named ``n_words`` or ``spans`` are replaced, others pass through.
    """
    named = dict(PHRASES if phrases is None else phrases)
    every = [*((label, phrase) for phrase, label in named.items()), *templates]
    n_base = len(named)
    rows = documents.drop("n_words", "spans").withColumn("text", F.col("text").cast("string"))
    others = [f for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(every)
        widest = [sum(int(m.group(2)) for m in _MARKUP.finditer(t) if m.group(2)) for _, t in every]
        kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("words", pa.int64()), ("sure", pa.float64())]))
        for batch in batches:
            counts, spans = [], []
            for text in batch.column("text"):
                n, found = scan(automaton, (text.as_py() or "").encode("utf-8", "surrogatepass"))
                counts.append(n)
                spans.append(
                    [
                        {"label": every[t][0], "base": t < n_base, "first": b, "words": size, "sure": 0.5 if t < n_base else max(size - widest[t], 1) / size}
                        for t, b, size in found
                    ]
                )
            columns = [batch.column(f.name) for f in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(spans, kind)], names=[*(f.name for f in others), "n_words", "spans"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), _FOUND_SQL])
    return rows.mapInArrow(run, schema)


def license_summary(documents: DataFrame) -> DataFrame:
    """Per document: words, base places, labels and a score: how sure the surest span is, 0 without spans."""

    def labels(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    found = license_spans(documents.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["sure"])), F.lit(0.0)).alias("score"),
    )
