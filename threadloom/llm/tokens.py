"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE tokenizer is two transducers in a row, both deterministic, both with counts on their transitions.

* The splitter reads character classes and tells where words of the tokenizer begin. A text is cut into chunks; for every chunk
  and every state it may be entered in, the state it is left in is worked out in step for all chunks. These state maps compose, so
  that a parallel prefix scan gives each chunk its true entry state, and a second reading gives the places.
* The word transducer reads the bytes of a word. BPE has exactly one encoding of a byte string in which all neighbouring tokens
  are stable (encoding the two of them together gives the two again), so the tokens of all prefixes are known by one look back.
  Its states are, for each place where a token may still be open, that token's node in the vocabulary's tree and the token
  before it. A transition carries how many tokens more the best-known prefix has. States are made when first reached and kept
  in a table per worker; all distinct words of a batch run through it in step.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.words import _fmix, pieces

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
# Characters of a chunk in the splitter, and states kept before the word transducer is started afresh.
CHUNK, MOST_STATES = 128, 200_000

# Character classes of the splitter. Letters that may end a contraction have classes of their own.
_CLASSES = ("space", "white", "letter", "number", "other", "quote", "stmd", "r", "v", "l", "e")
_SPACE, _WHITE, _LETTER, _NUMBER, _OTHER, _QUOTE, _STMD, _R, _V, _L, _E = range(len(_CLASSES))
_LETTERS = (_LETTER, _STMD, _R, _V, _L, _E)


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Transitions [state, class] -> state, and cuts: 1 a word begins at this character, 2 at the one before, 3 at both.

    Fixed rules of the tokenizer's pattern, in its order of precedence: 's 't 're 've 'm 'll 'd; letters, numbers or other
    characters, each with a space before them if there is one; white space, of which the last character is left over when more
    text follows.
    """
    states = ("begin", "letters", "numbers", "others", "space", "white", "run+space", "run+white", "quote", "quote r/v", "quote l", "done")
    number = {name: i for i, name in enumerate(states)}
    to, cut = np.zeros((len(states), len(_CLASSES)), np.int8), np.zeros((len(states), len(_CLASSES)), np.int8)

    def fresh(c: int) -> str:
        if c in _LETTERS:
            return "letters"
        return {_SPACE: "space", _WHITE: "white", _NUMBER: "numbers", _OTHER: "others", _QUOTE: "quote"}[c]

    def inside(kind: str, c: int) -> tuple[str, int]:
        """After a run of letters, numbers or others: it goes on, or a word begins."""
        goes_on = {"letters": c in _LETTERS, "numbers": c == _NUMBER, "others": c in (_OTHER, _QUOTE)}[kind]
        return (kind, 0) if goes_on else (fresh(c), 1)

    for name in states:
        for c in range(len(_CLASSES)):
            if name in ("begin", "done"):
                result = (fresh(c), 1)
            elif name in ("letters", "numbers", "others"):
                result = inside(name, c)
            elif name in ("space", "white", "run+space", "run+white"):
                if c in (_SPACE, _WHITE):
                    result = ("run+space" if c == _SPACE else "run+white", 0)
                else:
                    # The last white character is a word of its own after a run; a space joins what follows.
                    before = 2 if name.startswith("run") else 0
                    if name.endswith("space"):
                        result = ("others" if fresh(c) == "quote" else fresh(c), before)
                    else:
                        result = (fresh(c), before | 1)
            elif name == "quote":
                if c == _STMD:
                    result = ("done", 0)
                elif c in (_R, _V):
                    result = ("quote r/v", 0)
                elif c == _L:
                    result = ("quote l", 0)
                else:
                    result = inside("others", c)
            else:
                whole = c == _E if name == "quote r/v" else c == _L
                if whole:
                    result = ("done", 0)
                else:
                    # The letter after the quote was the beginning of letters after all.
                    goes_on, begins = inside("letters", c)
                    result = (goes_on, begins | 2)
            to[number[name], c], cut[number[name], c] = number[result[0]], result[1]
    return to, cut


# States in which the text may end with a word's beginning still undecided: the letter after a quote.
_OPEN = (9, 10)


def _class_table() -> np.ndarray:
    """Class of every code point, by the Unicode properties that the pattern names."""
    table = np.full(0x110000, _OTHER, np.int8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\p{White_Space}+", _WHITE)):
        for found in regex.finditer(pattern, every):
            low, high = (i if i < 0xD800 else i + 0x800 for i in (found.start(), found.end()))
            table[low:high] = kind
    for characters, kind in ((" ", _SPACE), ("'", _QUOTE), ("stmd", _STMD), ("r", _R), ("v", _V), ("l", _L), ("e", _E)):
        for character in characters:
            table[ord(character)] = kind
    return table


def _word_begins(kinds: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where words begin in a run of texts, given as classes; ``text_starts`` are the first characters of non-empty texts."""
    to, cut = _splitter()
    # A text starts in state 0 whatever was before: its first class is moved to a second set of columns.
    symbols = len(_CLASSES)
    to = np.concatenate([to, np.repeat(to[:1], len(to), 0), np.arange(len(to), dtype=np.int8)[:, None]], axis=1)
    cut = np.concatenate([cut, np.repeat(cut[:1], len(cut), 0), np.zeros((len(cut), 1), np.int8)], axis=1)
    for state in _OPEN:
        cut[state, symbols : 2 * symbols] |= 2
    symbol = kinds.copy()
    symbol[text_starts] += symbols
    chunks = -(-(len(symbol) + 1) // CHUNK)
    # The end of the last text closes like the start of another one; beyond it, nothing changes.
    symbol = np.append(symbol, np.array([symbols], np.int8))
    symbol = np.append(symbol, np.full(chunks * CHUNK - len(symbol), 2 * symbols, np.int8)).reshape(chunks, CHUNK)
    flat, width = to.ravel().astype(np.int16), to.shape[1]
    maps = np.repeat(np.arange(len(to), dtype=np.int16)[None, :], chunks, 0)
    for i in range(CHUNK):
        maps = flat[maps * np.int16(width) + symbol[:, i, None]]
    # Prefix scan: after step s, maps[i] leads through 2^s chunks up to i.
    span = 1
    while span < chunks:
        later = np.take_along_axis(maps[span:], maps[:-span], axis=1)
        maps = np.concatenate([maps[:span], later])
        span *= 2
    state = np.append(np.int16(0), maps[:-1, 0])
    flags = np.empty((chunks, CHUNK), np.int8)
    flat_cut = cut.ravel()
    for i in range(CHUNK):
        at = state * np.int16(width) + symbol[:, i]
        flags[:, i] = flat_cut[at]
        state = flat[at]
    flags = flags.ravel()
    begins = (flags & 1).astype(bool)
    begins[:-1] |= (flags[1:] & 2).astype(bool)
    return begins[: len(kinds)]


class WordTransducer:
    """Counts BPE tokens of byte strings; states are sets of open tokens, made when first reached."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        alphabet = self._alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        vocabulary = {as_bytes(t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[as_bytes(left), as_bytes(right)] = i
        # The tree of all tokens that are their own encoding; the others never come up.
        self.child: list[dict[int, int]] = [{}]
        self.token: list[bytes | None] = [None]
        for token in vocabulary:
            if len(self.merged(token)) == 1:
                node = 0
                for byte in token:
                    if byte not in self.child[node]:
                        self.child[node][byte] = len(self.child)
                        self.child.append({})
                        self.token.append(None)
                    node = self.child[node][byte]
                self.token[node] = token
        self.stable: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    @staticmethod
    def _alphabet() -> dict[str, int]:
        """The printable character that stands for each byte: itself where it is printable, else the next from 256 on."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {chr(b): b for b in plain}
        shown.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
        return shown

    def merged(self, text: bytes) -> list[bytes]:
        """BPE by its definition: merge the pair of lowest rank, leftmost first, until none is left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            ranks = [self.rank.get(pair, 1 << 60) for pair in zip(parts[:-1], parts[1:], strict=True)]
            least = min(ranks)
            if least == 1 << 60:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: bytes, right: bytes) -> bool:
        key = (left, right)
        if key not in self.stable:
            self.stable[key] = self.merged(left + right) == [left, right]
        return self.stable[key]

    def reset(self) -> None:
        start = ((0, b"", 0),)
        self.states: list[tuple] = [start]
        self.number: dict[tuple, int] = {start: 0}
        self.keys, self.next, self.add = (np.empty(0, t) for t in (np.int64, np.int32, np.int32))
        self.fresh: dict[int, tuple[int, int]] = {}

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Next state and tokens added. A state lists open tokens: (node, token before, tokens before it, less the base).

        The base is the number of tokens of the prefix read so far; the open token that ends here is the prefix's last one.
        """
        moved, last = [], None
        for node, before, count in self.states[state]:
            node = self.child[node].get(byte)
            if node is not None:
                moved.append((node, before, count))
                token = self.token[node]
                if token is not None and (not before or self.follows(before, token)):
                    last = (token, count + 1)
        token, added = last
        after = tuple(sorted([*((n, b, c - added) for n, b, c in moved), (0, token, 0)]))
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
        return self.number[after], added

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Transitions for state * 256 + byte, made where they are new."""
        for attempt in (0, 1):
            at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), bool)
            if not new.any():
                return self.next[at], self.add[at]
            made = np.unique(keys[new])
            results = [self.step(k >> 8, k & 255) for k in made.tolist()]
            place = np.searchsorted(self.keys, made)
            self.keys = np.insert(self.keys, place, made)
            self.next = np.insert(self.next, place, [r[0] for r in results])
            self.add = np.insert(self.add, place, [r[1] for r in results])
        raise AssertionError("unreachable")

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each word, all words in step, longest first."""
        if len(self.states) > MOST_STATES:
            self.reset()
        order = np.argsort(-lengths, kind="stable")
        starts, left = starts[order], lengths[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        active = np.searchsorted(-left, 0, "left")
        i = 0
        while active:
            key = (state[:active] << 8) | data[starts[:active] + i]
            state[:active], added = self._look(key)
            total[:active] += added
            i += 1
            active = np.searchsorted(-left, -i, "left")
        out = np.empty_like(total)
        out[order] = total
        return out


class TokenCounter:
    """Token counts of texts: specials, splitter, then each distinct word once through the word transducer."""

    def __init__(self, path: str):
        self.words = WordTransducer(path)
        self.classes = _class_table()
        with open(path, encoding="utf-8") as file:
            self.specials = [t["content"].encode() for t in json.load(file)["added_tokens"]]
        # Counts of words seen, by hash; a first-level memory before the transducer.
        self.known, self.known_count = np.empty(0, np.uint64), np.empty(0, np.int64)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a run."""
        raw = data.tobytes()
        extra = np.zeros(len(offsets) - 1, np.int64)
        starts = offsets[:-1]
        if any(s in raw for s in self.specials):
            # A special string is one token and splits its text in two.
            found = [(m.start(), m.end()) for m in regex.finditer(b"|".join(map(regex.escape, self.specials)), raw)]
            owner = np.searchsorted(offsets, [a for a, _ in found], "right") - 1
            whole = [(a, b, o) for (a, b), o in zip(found, owner.tolist(), strict=True) if b <= offsets[o + 1]]
            np.add.at(extra, [o for _, _, o in whole], 1)
            inside = np.zeros(len(data) + 1, np.int8)
            for a, b, _ in whole:
                inside[a:b] = 1
            kept_bytes = np.flatnonzero(inside[:-1] == 0)
            new_place = np.append(0, np.cumsum(inside[:-1] == 0))
            cuts = np.unique(new_place[np.concatenate([starts, [b for _, b, _ in whole], [a for a, _, _ in whole]]).astype(np.int64)])
            data, offsets, starts = data[kept_bytes], new_place[offsets], cuts
        if len(data) == 0:
            return extra
        first_byte = (data & 0xC0) != 0x80
        place = np.flatnonzero(first_byte)
        code = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        character = np.cumsum(first_byte) - 1
        text_starts = np.unique(starts[starts < len(data)])
        begins = place[_word_begins(self.classes[code], character[text_starts])]
        lengths = np.diff(np.append(begins, len(data)))
        tokens = self._word_counts(data, begins, lengths)
        summed = np.append(0, np.cumsum(tokens))
        at = np.searchsorted(begins, offsets)
        return summed[at[1:]] - summed[at[:-1]] + extra

    def _word_counts(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        nth = np.arange(len(data)) - np.repeat(begins, lengths)
        power = np.full(int(lengths.max()), np.uint64(0x9E3779B97F4A7C15))
        power[0] = 1
        value = (data.astype(np.uint64) + np.uint64(1)) * np.cumprod(power, dtype=np.uint64)[nth]
        hashes = _fmix(np.add.reduceat(value, begins) + lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        counts = self.known_count[at] if len(self.known) else np.zeros(len(distinct), np.int64)
        if new.any():
            counts[new] = self.words.counts(data, begins[first[new]], lengths[first[new]])
            if len(self.known) > 4_000_000:
                self.known, self.known_count = self.known[:0], self.known_count[:0]
            every = np.append(self.known, distinct[new])
            order = np.argsort(every)
            self.known, self.known_count = every[order], np.append(self.known_count, counts[new])[order]
        return counts[back]


def _counting(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for batch in batches:
            for at, stop, data, offsets in pieces(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, stop - at), pa.array(np.diff(offsets)), pa.array(counter.count(data, offsets))], names=["doc_id", "n_bytes", "n_tokens"]
                )

    return run


def token_counts(documents: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    ``path`` is the tokenizer file, by default the public one named TOKENIZER, which every worker opens where it is installed.
    Null texts read as empty and have no tokens; a special string in a text is one token. Documents that repeat are counted each; an
    empty table gives an empty table; further columns are ignored.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = rows.mapInArrow(_counting(path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
