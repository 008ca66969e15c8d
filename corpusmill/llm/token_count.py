"""Operator 1: token counts without token lists.

The vocabulary of a SentencePiece file is read as a unigram model: each ordinary piece with its
score. An Aho-Corasick automaton gives all pieces that end at a position; the dynamic programme
carries only the best score and its number of pieces. The tie rules are those of SentencePiece's
unigram encoder: at equal score the piece that starts first stays, a character without a piece of
its own costs the lowest score less 10 and counts as its UTF-8 bytes (byte fallback) or as one.
A run of such characters counts as one token without byte fallback.

Scores are summed in single precision. Where the best score at a position is beyond ``RESCALE``, it
is taken from all open paths, as that encoder does, so long texts keep their precision. Paths
that a step of single precision does not tell apart tie as they do there (the file's run of space
marks costs a thousand million, where a step is 64).

No piece holds a space mark behind another character and none holds a character outside the
vocabulary's alphabet, so a text falls into words: all paths meet between two, and only the score
there passes on. A worker keeps the words it has seen behind each score, in two generations of about ``MEMO``.

Null text: 0 tokens. Empty text: 0 tokens. Equal texts have equal counts. A text may have any length; words of
more than ``LONGEST`` characters are counted anew each time. An empty table gives an empty result. Other columns,
whatever their names, are dropped; repeated rows stay.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusmill.llm.batches import append
from corpusmill.session import spread

MARK = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: SentencePiece's penalty for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: The score beyond which SentencePiece takes the best score from all open paths (found by comparing counts).
RESCALE = 100_000.0
MEMO = 500_000
#: Characters of the longest word that is kept.
LONGEST = 64
#: Whole numbers below are exact in single precision.
WHOLE = 16_777_216.0


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    at, end = 0, len(raw)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield number, raw[at : at + size]
        at += size


def read_vocabulary(path: str) -> tuple[dict[str, float], bool]:
    """Ordinary pieces with their scores, and whether unknown characters fall back to bytes."""
    pieces, fallback = {}, False
    with open(path, "rb") as file:
        raw = file.read()
    for number, message in _fields(raw):
        if number == 1:
            piece = dict(_fields(message))
            kind = piece.get(3, NORMAL)
            if kind == NORMAL:
                pieces[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            fallback |= kind == BYTE
    return pieces, fallback


_FLOAT = struct.Struct("<f")


def _single(value: float) -> float:
    """``value`` rounded to single precision; sums of whole numbers this small are exact."""
    if -WHOLE < value < WHOLE and value.is_integer():
        return value
    return _FLOAT.unpack(_FLOAT.pack(value))[0]


#: Number of a place where all paths meet between two words: their score, and whether the best ends in an unknown run.
State = int
#: (end, score, pieces, ends unknown) of the best path to each open end.
Ends = tuple[tuple[int, float, int, bool], ...]
#: (last position, (length, score)) of a piece found in a chunk.
Match = tuple[int, tuple[int, float]]
Kept = tuple[dict[State, int], int, tuple[int, State], dict[int, tuple[int, State]] | None]


class Counter:
    """Counts the pieces of texts under a unigram vocabulary."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool):
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a space mark behind another character: words can't be counted apart")
        self.unknown = _single(min(pieces.values()) - UNKNOWN_PENALTY)
        self.bytes = byte_fallback
        self.single = {p for p in pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        alphabet = set("".join(pieces))
        self.chunks = CHUNKS if "\n" not in alphabet else WORDS
        self.whole = all(score.is_integer() for score in pieces.values())
        self.mark = self._far_mark(pieces) if self.whole and "\n" not in alphabet else None
        self.inner = self._inner(pieces) if self.mark is not None else None
        #: beginning of a word -> (length, score) of the pieces that begin it
        self.firsts: dict[str, tuple[tuple[int, float], ...]] = {}
        self.forget()

    def forget(self) -> None:
        """Drops the words seen. What repeats (states, open ends, results) is held once, by number."""
        #: chunk -> (state -> open ends behind its first character, first open ends met, what ``word`` gave, the same for others)
        self.words: dict[str, Kept] = {}
        #: the words of the generation before, which come back when they are met again
        self.old: dict[str, Kept] = {}
        #: the first part of ``words``, shared by chunks that start with the same pieces
        self.starts: dict[tuple, dict[State, int]] = {}
        self.open: dict[Ends, int] = {}
        #: by number: the open ends, and whether they are those of ``beyond_mark``
        self.ends: list[tuple[Ends, bool]] = []
        self.results: dict[tuple[int, State], tuple[int, State]] = {}
        #: whole score behind a word -> its state
        self.ahead: dict[float, State] = {}
        self.numbers: dict[tuple[float, bool], State] = {(0.0, False): 0}
        self.states = [(0.0, False)]
        self.seen = 0

    def turn(self) -> None:
        """Starts a new generation of words; those of the last but one go."""
        if len(self.states) + len(self.open) + len(self.starts) + len(self.results) + len(self.firsts) > MEMO:
            self.forget()
            self.firsts = {}
        self.old, self.words, self.seen = self.words, {}, 0

    @staticmethod
    def _far_mark(pieces: dict[str, float]) -> float | None:
        """The mark's score if it is so low that only a fraction of a state's score matters behind it."""
        mark = pieces.get(MARK, 0.0)
        near = all(score == mark or abs(score) < WHOLE / 2 for p, score in pieces.items() if p.startswith(MARK))
        return mark if near and mark < -WHOLE else None

    @staticmethod
    def _inner(pieces: dict[str, float]) -> ahocorasick.Automaton:
        """The pieces that a best path inside a word can hold, where sums are exact.

        A piece whose own characters other pieces cover with a higher sum is on no best path. At equal
        sums the longer piece stays, as the tie rule has it.
        """
        automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            if MARK in piece:
                continue
            size = len(piece)
            best = [0.0] + [-float("inf")] * size
            for end in range(1, size + 1):
                for start in range(end):
                    worth = pieces.get(piece[start:end])
                    if worth is not None and end - start < size:
                        best[end] = max(best[end], best[start] + worth)
            if not best[size] > score:
                automaton.add_word(piece, (size, score))
        automaton.make_automaton()
        return automaton

    def _begins(self, text: str) -> tuple[tuple[int, float], ...]:
        """(length, score) of the pieces that begin ``text``, shortest first."""
        head = text[: self.automaton.longest_prefix(text)]
        found = self.firsts.get(head)
        if found is None:
            pairs = (self.automaton.get(head[:size], None) for size in range(1, len(head) + 1))
            found = self.firsts[head] = tuple(pair for pair in pairs if pair is not None)
        return found

    def state(self, score: float, unknown: bool) -> State:
        """The state that goes on as this one does.

        A chunk starts with a mark or is a line end (or stands behind one, where the score is 0). Behind a
        far mark the other paths are held relative to its own, rounded: only what rounding took remains.
        """
        unknown = unknown and not self.bytes
        if abs(score) > RESCALE:
            score = 0.0
        elif self.mark is not None and score.is_integer():
            rest = score + self.mark - _single(score + self.mark)
            if _single(rest + self.mark) == self.mark:
                score = rest
        number = self.numbers.setdefault((score, unknown), len(self.states))
        if number == len(self.states):
            self.states.append((score, unknown))
        return number

    def _unknown(self, char: str, unknown: bool) -> int:
        """Pieces that an uncovered character adds."""
        return len(char.encode("utf-8", "surrogatepass")) if self.bytes else int(not unknown)

    def begin(self, char: str, pieces: list[tuple[int, float]], state: State, more: bool) -> Ends:
        """Open ends behind the first character, relative to the best path there if ``more`` characters follow."""
        score, unknown = self.states[state]
        ends = [(end, _single(score + worth), 1, False) for end, worth in pieces]
        if char not in self.single:
            ends.append((1, _single(score + self.unknown), self._unknown(char, unknown), True))
        here = next(total for end, total, _, _ in ends if end == 1)
        if more and abs(here) > RESCALE:
            ends = [(end, _single(total - here), n, u) for end, total, n, u in ends]
        return tuple(ends)

    def finish(self, chunk: str, matches: list[Match], ends: Ends) -> tuple[int, State]:
        """Pieces on the best path through ``chunk`` from the open ends, and the state behind it."""
        pieces: list[list[tuple[int, float]]] = [[] for _ in chunk]
        for last, (length, worth) in matches:
            pieces[last + 1 - length].append((last + 1, worth))
        size, whole, single = len(chunk), self.whole, self.single
        best: list[float | None] = [None] * (size + 1)
        count, runs, far = [0] * (size + 1), [False] * (size + 1), 1
        for end, total, n, u in ends:
            best[end], count[end], runs[end], far = total, n, u, max(far, end)
        for start in range(1, size):
            here, n = best[start], count[start] + 1
            if not -RESCALE <= here <= RESCALE:
                for end in range(start + 1, far + 1):
                    if best[end] is not None:
                        best[end] = _single(best[end] - here)
                here = 0.0
            for end, worth in pieces[start]:
                total = here + worth
                if not (whole and -WHOLE < total < WHOLE):
                    total = _single(total)
                if best[end] is None or total > best[end]:
                    best[end], count[end], runs[end] = total, n, False
                    if end > far:
                        far = end
            if chunk[start] not in single:
                total, end = _single(here + self.unknown), start + 1
                if best[end] is None or total > best[end]:
                    best[end], count[end], runs[end] = total, count[start] + self._unknown(chunk[start], runs[start]), True
                    far = max(far, end)
        return count[size], self.state(best[size], runs[size])

    def finish_behind_mark(self, text: str, ends: Ends) -> tuple[int, State]:
        """As ``finish``, where the path over the bare far mark loses to all others and sums are exact.

        ``ends`` are the others, relative to the nearest of them (``beyond_mark``). From there on, a position's
        best score needs no rounding; taking scores away from all open paths only moves the origin.
        """
        size = len(text)
        best: list[float | None] = [None] * (size + 1)
        count = [0] * (size + 1)
        near = at = ends[0][0]
        for end, total, n, _ in ends:
            best[end], count[end] = total, n
        origin = 0.0
        for last, (length, worth) in self.inner.iter(text, near):
            start = last + 1 - length
            if last > at:
                at = last
                if not -RESCALE <= best[at] - origin <= RESCALE:
                    origin = best[at]
            total = best[start] + worth
            known = best[last + 1]
            if known is None or total > known:
                best[last + 1] = total
                count[last + 1] = count[start] + 1
        score = best[size] - origin
        state = self.ahead.get(score)
        if state is None:
            state = self.ahead[score] = self.state(score, False)
        return count[size], state

    def beyond_mark(self, text: str, ends: Ends) -> Ends | None:
        """The ends but the bare far mark's, by place and relative to the first, if that mark's path loses to them.

        Only their differences matter behind it, so words are kept for few of them. None: ``finish`` must do it.
        """
        if len(ends) < 2:
            return None
        others = sorted(ends[1:])
        near, base, _, _ = others[0]
        if near == len(text) or min(total for _, total, _, _ in others) <= WHOLE:
            return None
        return tuple((end, total - base, n, u) for end, total, n, u in others)

    def word(self, chunk: str, state: State) -> tuple[int, State]:
        """Pieces on the best path through ``chunk`` and the state behind it; kept for the next time."""
        kept = self.words.get(chunk)
        if kept is None:
            kept = self.old.get(chunk)
            if kept is not None:
                self.words[chunk] = kept
                self.seen += 1
        if kept is not None:
            number = kept[0].get(state)
            if number is not None:
                if number == kept[1]:
                    return kept[2]
                if kept[3] and number in kept[3]:
                    return kept[3][number]
        text = chunk.replace(" ", MARK)
        size = len(text)
        first = self._begins(text)
        far = self.mark is not None and 2 < size <= LONGEST and text[0] == MARK != text[1] and self.single.issuperset(text)
        whole = far and first[-1][0] == size
        behind = kept[0] if kept is not None else self.starts.setdefault((text[0], first, size > 1, far, whole), {})
        number = behind.get(state)
        if number is None:
            ends = self.begin(text[0], first, state, size > 1)
            others = self.beyond_mark(text, ends) if far else None
            number = behind[state] = self.open.setdefault(others or ends, len(self.open))
            if number == len(self.ends):
                self.ends.append((others or ends, others is not None))
        self.seen += 1
        more = kept and (kept[3] or {kept[1]: kept[2]})
        if more and number in more:
            return more[number]
        ends, beyond = self.ends[number]
        result = self.finish_behind_mark(text, ends) if beyond else self.finish(text, list(self.automaton.iter(text)), ends)
        result = self.results.setdefault(result, result)
        if more:
            self.words[chunk] = kept[0], kept[1], kept[2], more | {number: result}
        elif size <= LONGEST:
            self.words[chunk] = behind, number, result, None
        return result

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if self.seen >= MEMO:
            self.turn()
        total, state, words = 0, 0, self.words
        for chunk in self.chunks.findall(f" {text.replace(MARK, ' ')}"):
            kept = words.get(chunk)
            if kept:
                behind, number, result, more = kept
                met = behind.get(state)
                if met != number:
                    result = more and more.get(met)
                if result:
                    n, state = result
                    total += n
                    continue
            n, state = self.word(chunk, state)
            total += n
        return total


WORDS = re.compile(" +[^ ]*")
#: For vocabularies without a piece that holds a line end.
CHUNKS = re.compile(" +[^ \n]*|[^ \n]+|\n")


#: The counter of the last query that a worker served, with the words it has seen.
_kept: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens: tokens of each whole text under the vocabulary file ``vocabulary``.

    The file is read on the driver and broadcast (its size is checked: 1,000,000 pieces at most).
    """
    pieces, fallback = read_vocabulary(vocabulary)
    if len(pieces) > 1_000_000:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast((pieces, fallback))

    name = uuid.uuid4().hex

    def setup():
        counter = _kept.get(name)
        if counter is None:
            _kept.clear()
            counter = _kept[name] = Counter(*shared.value)
        return lambda texts: ([counter.text(t) for t in texts],)

    rows = spread(docs.select(key, text))
    return append(rows, [text], [("n_tokens", T.LongType())], setup).select(key, "n_tokens")
