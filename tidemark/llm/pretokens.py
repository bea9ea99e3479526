"""Pre-tokens of byte-level BPE without a regular expression.

Every code point is mapped to a class, and a little look-ahead turns classes into symbols.  An
automaton over those symbols says where a pre-token starts.  The automaton's transitions are
functions on a handful of states; functions compose associatively, so the state before every
character comes from a blocked prefix scan over function numbers and not from a loop over text.
"""

from __future__ import annotations

import numpy as np
import regex

from tidemark.llm.common import worker_store
from tidemark.runtime import ship_by_value

ship_by_value(__name__)

# Classes, which are also the symbols and states of the same number.
LETTER, DIGIT, OTHER, SPACE = range(4)
# More symbols: a run's last space before text (its own pre-token), the same if it is a blank (it
# joins what follows), and an apostrophe that may open a contraction of two or three characters.
LAST, JOIN, SHORT, LONG = range(4, 8)
FIRST = 8                      # added to the symbol of a text's first character
# More states: a blank waits to be joined, a contraction is complete, one or two characters of a
# contraction are still to come.
JOINING, DONE, ONE_LEFT, TWO_LEFT = range(4, 8)
STATES = 8

# --- fixed values: the contractions of the pattern ----------------------------------------------
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")

BLOCK = 512


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The automaton: next state, and whether a pre-token starts at the symbol's character."""
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return DONE, False
    if symbol in (LETTER, DIGIT, OTHER):
        return symbol, state not in (symbol, JOINING)
    if symbol == SPACE:
        return SPACE, state != SPACE
    if symbol == LAST:
        return SPACE, True
    if symbol == JOIN:
        return JOINING, True
    if state in (OTHER, JOINING):          # the apostrophe continues punctuation
        return OTHER, False
    return (ONE_LEFT if symbol == SHORT else TWO_LEFT), True


class Scanner:
    """Class table, transition functions and their composition table."""

    def __init__(self) -> None:
        points = "".join(map(chr, range(0x110000)))
        self.classes = np.full(0x110000, OTHER, np.uint8)
        for number, kind in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(kind, points):
                self.classes[m.start():m.end()] = number
        functions = [tuple(step(s, y)[0] for s in range(STATES)) for y in range(FIRST)]
        functions += [(step(DONE, y)[0],) * STATES for y in range(FIRST)]
        numbers = {f: i for i, f in enumerate(dict.fromkeys(functions))}
        self.of_symbol = np.array([numbers[f] for f in functions], np.int32)
        work = list(numbers)
        for f in work:                      # grows while it is read, until it is closed
            for g in functions:
                h = tuple(g[s] for s in f)
                if h not in numbers:
                    numbers[h] = len(numbers)
                    work.append(h)
        self.count = len(numbers)
        self.functions = list(numbers)
        self.apply = np.array(self.functions, np.uint8)
        self.compose = np.array([[numbers[tuple(g[s] for s in f)] for g in numbers]
                                 for f in numbers], np.int32).ravel()
        self.starts = np.array([[step(DONE if y >= FIRST else s, y % FIRST)[1]
                                 for y in range(2 * FIRST)] for s in range(STATES)], bool).ravel()

    def symbols(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Symbols of concatenated texts; ``begins`` has the place of each text's first character."""
        kinds = self.classes[points]
        last = np.append(begins[1:], len(points)) - 1
        following = np.append(kinds[1:], SPACE)
        following[last] = SPACE
        symbols = kinds.copy()
        before_text = np.flatnonzero((kinds == SPACE) & (following != SPACE))
        symbols[before_text] = np.where(points[before_text] == 0x20, JOIN, LAST)
        at = np.flatnonzero(points == 0x27)
        if len(at):
            one = np.append(points[1:], 0)
            one[last] = 0
            two = np.append(one[1:], 0)
            two[last] = 0
            first, second = one[at], two[at]
            symbols[at[np.isin(first, [ord(c) for c in SHORT_ENDINGS])]] = SHORT
            for a, b in LONG_ENDINGS:
                symbols[at[(first == ord(a)) & (second == ord(b))]] = LONG
        symbols[begins] += FIRST
        return symbols

    def boundaries(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Places at which a pre-token starts, ascending."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        symbols = self.symbols(points, begins)
        rows = -(-n // BLOCK)
        padded = np.zeros(rows * BLOCK, np.int32)
        padded[:n] = self.of_symbol[symbols]
        scan = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
        for i in range(1, BLOCK):
            scan[i] = self.compose[scan[i - 1] * self.count + scan[i]]
        functions = self.functions
        entry, state = np.empty(rows, np.int32), DONE
        for i, f in enumerate(scan[-1].tolist()):
            entry[i] = state
            state = functions[f][state]
        before = np.empty((BLOCK, rows), np.uint8)
        before[0] = entry
        scan *= STATES
        scan += entry
        np.take(self.apply.ravel(), scan[:-1], out=before[1:], mode="clip")
        flat = np.ascontiguousarray(before.T).ravel()[:n]
        flat <<= 4
        flat |= symbols
        return np.flatnonzero(self.starts[flat])


def scanner() -> Scanner:
    store = worker_store()
    if "scanner" not in store:
        store["scanner"] = Scanner()
    return store["scanner"]


def split_texts(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined texts, the boundaries with the end appended, and for every text the number of its
    first pre-token (one more entry than texts)."""
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    begins = ends - lengths
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    bounds = scanner().boundaries(points, begins[lengths > 0])
    firsts = np.searchsorted(bounds, np.append(begins, len(joined)))
    return joined, np.append(bounds, len(joined)), firsts


def pieces_of(joined: str, bounds: np.ndarray) -> list[str]:
    places = bounds.tolist()
    return [joined[a:b] for a, b in zip(places, places[1:])]
