"""Token counts by finite-state transducers compiled from a tokenizer file.

Two machines are compiled. The word machine is a deterministic transducer over
classes of characters whose transitions say where words start; the texts of a
batch are one long run of characters, cut into chunks of equal length, each
chunk's map from state to state is computed for all chunks at once, and the maps
are composed by a parallel prefix scan, so that every chunk then runs from its
true state. The merge machine reads a word's bytes; its transitions are
annotated with the number of tokens that they add to (or, where a merge joins
earlier tokens, take from) the encoding of what was read. Its states are made
when they are first reached, as in a lazy regular-expression automaton.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches

#: The parts of a tokenizer file that the machines are written for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SUFFIX = "</w>"

# Classes of characters.
SPACE, LETTER, NUMBER, OTHER, QUOTE, STMD, RV, EL, E = range(9)
# States: outside of a word; in letters; in other signs; after a word's first quote; after quote and r or v; after quote and l.
OUT, IN_LETTERS, IN_OTHER, QUOTED, QUOTED_RV, QUOTED_L = range(6)
#: A word starts here; a word has started one character before.
STARTS, STARTED = 1, 2
CHUNK, PIECE = 2048, 2_000_000


def word_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next states and flags by state * 9 + class."""
    step, flag = np.zeros((6, 9), dtype=np.int64), np.zeros((6, 9), dtype=np.uint8)
    letters = (LETTER, STMD, RV, EL, E)
    for state in range(6):
        late = STARTED if state in (QUOTED_RV, QUOTED_L) else 0
        for c in range(9):
            if c == SPACE:
                to, f = OUT, late
            elif c == NUMBER:
                to, f = OUT, STARTS | late
            elif c == OTHER:
                to, f = IN_OTHER, (0 if state in (IN_OTHER, QUOTED) else STARTS) | late
            elif c == QUOTE:
                to, f = (IN_OTHER, 0) if state in (IN_OTHER, QUOTED) else (QUOTED, STARTS | late)
            elif state == QUOTED and c in (STMD, RV, EL):
                to, f = {STMD: OUT, RV: QUOTED_RV, EL: QUOTED_L}[c], 0
            elif (state, c) in ((QUOTED_RV, E), (QUOTED_L, EL)):
                to, f = OUT, 0
            else:
                assert c in letters
                to, f = IN_LETTERS, (0 if state == IN_LETTERS or late else STARTS) | late
            step[state, c], flag[state, c] = to, f
    return step.ravel(), flag.ravel()


def word_starts(classes: np.ndarray, step: np.ndarray, flag: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions at which words start. The state before the first character is OUT; the last class must be SPACE."""
    n = len(classes)
    lanes = -(-n // chunk)
    grid = np.full(lanes * chunk, SPACE, dtype=np.int64)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(lanes, chunk).T)
    maps = np.repeat(np.arange(6)[:, None], lanes, axis=1)
    for row in grid:
        maps = step[maps * 9 + row]
    ahead = 1
    while ahead < lanes:  # after the round, maps[:, i] leads over the chunks i - 2 * ahead + 1 to i
        maps = np.concatenate([maps[:, :ahead], np.take_along_axis(maps[:, ahead:], maps[:, :-ahead], axis=0)], axis=1)
        ahead *= 2
    state = np.concatenate([[OUT], maps[OUT, :-1]])
    flags = np.empty((chunk, lanes), dtype=np.uint8)
    for i, row in enumerate(grid):
        at = state * 9 + row
        flags[i], state = flag[at], step[at]
    flags = flags.T.ravel()[:n]
    return np.sort(np.concatenate([np.flatnonzero(flags & STARTS), np.flatnonzero(flags & STARTED) - 1]))


class MergeMachine:
    """Counts the tokens of a word: byte-pair merges as a transducer over bytes, a word's last byte being a symbol of its own.

    That an encoding is right can be seen from its neighbouring pairs: a and b
    may stand side by side if merging their joint bytes gives a and b again. So
    the encoding of a prefix ends in the one token after which, at its start,
    the encoding of the shorter prefix ends in a token that may precede it. A
    state holds, for each start from which what follows may still become a token,
    the place in the tree of tokens, the token before that start, and the count
    there relative to the count now.
    """

    def __init__(self, symbols: list[int], merges: list[tuple[int, int, int]], bound: int = 1_500_000):
        self.symbols, self.bound = symbols, bound
        self.rank = {(a, b): (i, ab) for i, (a, b, ab) in reversed(list(enumerate(merges)))}
        self.spelled: dict[int, tuple[int, ...]] = {s: (s,) for s in symbols}
        for a, b, ab in merges:
            self.spelled.setdefault(ab, self.spelled[a] + self.spelled[b])
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, spelling in self.spelled.items():
            node = 0
            for s in spelling:
                if s not in self.child[node]:
                    self.child[node][s] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][s]
            self.token[node] = t
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number, self.moves = [start], {start: 0}, {}

    def merged(self, parts: list[int]) -> list[int]:
        """Plain merging, for the pairs of the tokens alone."""
        while len(parts) > 1:
            found = min(((self.rank[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.rank), default=None)
            if found is None:
                break
            i = found[1]
            parts[i : i + 2] = [self.rank[parts[i], parts[i + 1]][1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a; with a = -1, whether b is the encoding of its own bytes."""
        if (a, b) not in self.pairs:
            if a < 0:
                self.pairs[a, b] = self.merged(list(self.spelled[b])) == [b]
            else:
                self.pairs[a, b] = self.fits(-1, b) and self.merged([*self.spelled[a], *self.spelled[b]]) == [a, b]
        return self.pairs[a, b]

    def _move(self, state: int, symbol: int) -> tuple[int, int]:
        live, last, count = [], None, 0
        for node, before, at in self.states[state]:
            node = self.child[node].get(symbol, -1)
            if node < 0:
                continue
            t = self.token[node]
            if last is None and t >= 0 and self.fits(before, t):
                last, count = t, at + 1
            if self.child[node]:
                live.append((node, before, at))
        if last is None:
            raise ValueError("these merges aren't a byte-pair encoding that grows from left to right")
        to = (*((node, before, at - count) for node, before, at in live), (0, last, 0))
        if to not in self.number:
            self.number[to] = len(self.states)
            self.states.append(to)
        self.moves[state, symbol] = out = (self.number[to], count)
        return out

    def count(self, word: str) -> int:
        if word in self.words:
            return self.words[word]
        if len(self.moves) > self.bound:
            self.forget()
        data, symbols, moves = word.encode("utf-8", "surrogatepass"), self.symbols, self.moves
        state = total = 0
        for i, byte in enumerate(data, 1 - len(data)):
            symbol = symbols[byte if i else byte + 256]
            state, more = moves.get((state, symbol)) or self._move(state, symbol)
            total += more
        if len(word) <= 64:
            if len(self.words) > 600_000:
                self.words.clear()
            self.words[word] = total
        return total


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: itself if it is printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in printable else chr(free))
        free += b not in printable
    return out


def compiled(path: str) -> tuple:
    """What workers need, as plain data: classes of all characters, symbols, merges, special strings.

    The file's normalizer must be NFC, white space and lower case, its words
    SPLIT, its model byte pairs with a word-end suffix; another one is refused.
    The classes of characters are asked of the tokenizer library itself.
    """
    from tokenizers import Regex, pre_tokenizers

    spec = json.loads(Path(path).read_text())
    model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
    kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
    if kinds != ["NFC", "Replace", "Lowercase"] or steps[0].get("pattern") != {"Regex": SPLIT} or model["end_of_word_suffix"] != SUFFIX or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in spec["added_tokens"]):
        raise ValueError(f"{path}: no machine for this kind of tokenizer")
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    code = np.array([ord(c) for c in letters])
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str("".join(letters)):
            classes[code[a:b]] = kind
    for signs, kind in (("'", QUOTE), ("stmd", STMD), ("rv", RV), ("l", EL), ("e", E)):
        classes[[ord(c) for c in signs]] = kind
    vocab, signs = model["vocab"], _byte_signs()
    symbols = [vocab[c] for c in signs] + [vocab[c + SUFFIX] for c in signs]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return classes.tobytes(), symbols, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], [a["content"] for a in spec["added_tokens"]]


class Counter:
    """Counts tokens of texts with the two machines."""

    def __init__(self, data: tuple):
        classes, symbols, merges, special = data
        self.classes = np.frombuffer(classes, dtype=np.uint8)
        self.step, self.flag = word_machine()
        self.machine = MergeMachine(symbols, merges)
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def _normal(self, text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # character by character: no final sigma

    def _pieces(self, text: str) -> Iterator[str]:
        """The text in parts that end before white space, of about PIECE characters unless a word is longer."""
        at = 0
        while len(text) - at > PIECE:
            space = re.compile(r"[ \n]").search(text, at + PIECE)
            if not space:
                break
            yield text[at : space.start()]
            at = space.start()
        yield text[at:]

    def counts(self, texts: list[str | None]) -> list[int]:
        totals = [0] * len(texts)
        owners: list[int] = []
        parts: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if parts:
                for owner, n in zip(owners, self._run(parts)):
                    totals[owner] += n
            owners.clear()
            parts.clear()
            size = 0

        for i, text in enumerate(texts):
            for part in self.special.split(text or "") if self.special else [text or ""]:
                for piece in self._pieces(part):
                    owners.append(i)
                    parts.append(self._normal(piece))
                    size += len(piece)
                    if size >= PIECE:
                        flush()
            totals[i] += len(self.special.findall(text or "")) if self.special else 0
        flush()
        return totals

    def _run(self, parts: list[str]) -> list[int]:
        joined = "\n".join(parts) + "\n"
        classes = self.classes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        starts = word_starts(classes, self.step, self.flag)
        spaces = np.flatnonzero(classes == SPACE)
        ends = np.minimum(np.r_[starts[1:], len(joined)], spaces[np.searchsorted(spaces, starts)])
        count, known = self.machine.count, self.machine.words
        per_word = np.fromiter((known.get(w) or count(w) for w in (joined[a:b] for a, b in zip(starts.tolist(), ends.tolist()))), np.int64, len(starts))
        upto = np.cumsum([len(p) + 1 for p in parts])
        total = np.r_[0, np.cumsum(per_word)]
        return np.diff(total[np.r_[0, np.searchsorted(starts, upto)]]).tolist()


def count_tokens(docs: DataFrame, path: str, keys: list[str], text: str = "text", limit: int = 2048) -> DataFrame:
    """keys, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit): one row per row of docs.

    Counts are those of the tokenizer library for the file, without begin, end or
    padding; its special strings count as one token where they stand in a text.
    Null texts are empty ones, with 0 bytes and 0 tokens.
    """
    small_batches(docs.sparkSession)
    data = compiled(path)
    digest = hashlib.sha256(repr((path, data[1:])).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(data)
    own = docs.select(*[F.col(k) for k in keys], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("__t"))
    schema = own.drop("__t").schema.add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_counter = kept("tokens", digest, lambda: Counter(shared.value))
        for batch in batches:
            n = np.array(own_counter.counts(batch.column(len(keys) + 1).to_pylist()), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], pa.array(n), pa.array(n > limit)], names=schema.names)

    return own.mapInArrow(run, schema)
