"""Sentence boundaries in many scripts: linear-chain taggers over characters."""

from __future__ import annotations

import pickle
import random
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.sources.tables import materialise, table

#: Context counts of all documents are kept in so many buckets, whatever their number.
BUCKETS = 1 << 19
#: The taggers' weights are fitted on about so many documents, on at most so many stretches
#: of so many candidates of theirs.
SAMPLE_DOCUMENTS, SAMPLE_WINDOWS, WINDOW = 3_000, 5_000, 8
#: Longer stretches of text have no part in fitting the tagger of text without stops.
WINDOW_CHARS = 4_096
#: Weights of that tagger.
WEIGHTS = 1 << 18

# Characters that can end a sentence, that close after it, and pairs.
WIDE = "。！？｡．⋯…"
STOPS = ".!?؟۔।॥።՜։။។៕།༎"
CLOSERS = "\"'”’»›」』）)]}】〉》"
GREEK_QUESTION = ";\u037e"
PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "„": "“”"}
#: Scripts written without stops: there a blank may be a boundary.
UNSTOPPED = r"\u0e00-\u0eff\u1000-\u109f"
DENSE = UNSTOPPED + r"\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"

_C = re.escape(CLOSERS)
STOPPED = (
    rf"(?:[{re.escape(STOPS)}…]+(?:[ \u00a0\u202f]?[»›]|[{_C}])*)+(?=\s)"
    rf"|(?:[{re.escape(STOPS + WIDE)}]*[{re.escape(WIDE)}][{re.escape(STOPS + WIDE)}]*[{_C}]*)+"
    rf"|(?<=[\w)\]`%])[.!?](?=[A-ZÀ-ÖØ-ÞΆ-Ω])"
    rf"|(?<=[\u0370-\u03ff\u1f00-\u1fff\d)\]`%»])[;\u037e][{_C}]*(?=\s)"
)
CANDIDATE, CANDIDATE_OR_BLANK = re.compile(STOPPED), re.compile(STOPPED + r"|(?<=\S)[ \t\r\n\u00a0\u3000]+(?=\S)")
_STOP = re.compile(f"[{re.escape(STOPS + WIDE + GREEK_QUESTION)}]")
_MARKS = re.compile(r"[“”«»「」『』（）()\[\]【】《》„\"]")
_BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_HEADING = re.compile(r"[^\S\n]{0,3}#{1,6}[^\S\n]+")
_BULLET = re.compile(r"[^\S\n]*(?:[-*+•‣▪]|\d{1,3}[.)])[^\S\n]+(?=\S)")
_ONE = re.compile(r"[^\S\n]*(?:[-*+•‣▪]|1[.)])[^\S\n]+(?=\S)")
_DIGITS = re.compile(r"\d+(?:[.,:/]\d+)*")
_LATIN = re.compile(r"`[^`]*`?|[A-Za-z_][A-Za-z_0-9.]*")
_UNSTOPPED = re.compile(f"[{UNSTOPPED}]")
_GREEK = re.compile(r"[\u0386-\u03ff\u1f00-\u1fff]")
_DENSE = re.compile(f"[{DENSE}]")
_FIRST = re.compile(r"[\s\"'“”«»„「『（(\[\]¿¡*_]*")


def units(body: str) -> Iterator[tuple[int, int, bool]]:
    """``(start, end, whole)`` of headings and list items (whole) and paragraphs of a cell."""
    at, size = 0, len(body)
    while at < size:
        m = _BLANK_LINE.search(body, at)
        end = m.start() if m else size
        yield from _block(body, at, end)
        at = m.end() if m else size


def _block(body: str, at: int, end: int) -> Iterator[tuple[int, int, bool]]:
    start, whole, listed = at, False, True
    while at < end:
        stop = body.find("\n", at, end)
        stop = end if stop < 0 else stop
        if m := _HEADING.match(body, at, stop):
            if start < at:
                yield start, at, whole
            yield m.end(), stop, True
            start, whole, listed = stop, False, True
        elif m := (_BULLET if listed else _ONE).match(body, at, stop):
            if start < at:
                yield start, at, whole
            start, whole, listed = m.end(), True, True
        elif not whole:
            listed = False
        at = stop + 1
    if start < end:
        yield start, end, whole


def _inside(text: str) -> tuple[list[int], list[int], dict[int, int]]:
    """Outermost matched pairs: their starts and ends; and all pairs by their end."""
    stack: list[tuple[str, int]] = []
    pairs: list[tuple[int, int]] = []
    for m in _MARKS.finditer(text):
        c, at = m.group(), m.start()
        if c == '"':
            closes = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
        else:
            closes = next((k for k in range(len(stack) - 1, -1, -1) if c in PAIRS.get(stack[k][0], "")), None)
        if closes is not None:
            pairs.append((stack[closes][1], at))
            del stack[closes:]
        elif c == '"' or c in PAIRS:
            stack.append((c, at))
    starts, ends = [], []
    for a, b in sorted(pairs):
        if not ends or a > ends[-1]:
            starts.append(a)
            ends.append(b)
    return starts, ends, {b: a for a, b in pairs}


def _shape(token: str) -> str:
    return _DIGITS.sub("#", token)


def _left(text: str, at: int) -> tuple[str, str]:
    """What stands before a place: one token and two, or characters where no blanks part words."""
    part = text[max(0, at - 48) : at].rstrip()
    if part and _DENSE.match(part[-1]):
        part = _LATIN.sub("w", _DIGITS.sub("#", part[-16:]))
        short = 3 if _UNSTOPPED.match(part[-1]) else 2
        return part[-short:], part[-2 * short :]
    tokens = part.split()[-2:]
    if not tokens:
        return "", ""
    last = _shape(tokens[-1].lstrip("\"'“«„「『（([¿¡").rstrip(CLOSERS))
    if last.startswith("`") or last.endswith("`"):
        last = "`"
    return last, (_shape(tokens[0]) if len(tokens) > 1 else "^") + " " + last


def _right(text: str, at: int) -> tuple[str, str]:
    """What follows a place, likewise."""
    part = text[at : at + 48].lstrip()
    core = part[_FIRST.match(part).end() :]
    if core and _DENSE.search(core[:24]):
        core = _LATIN.sub("w", _DIGITS.sub("#", core[:24]))
        mark = part[:1] if part[:1] in PAIRS or part[:1] == '"' else ""
        return mark + core[:2], mark + core[:5]
    tokens = core.split(None, 2)[:2]
    if not tokens:
        return "", ""
    if tokens[0].startswith("`"):
        return "`", "`"
    first = _shape(tokens[0])
    return first, first + " " + (_shape(tokens[1]) if len(tokens) > 1 else "$")


@lru_cache(1 << 16)
def bucket(kind: str, key: str) -> int:
    return zlib.crc32(f"{kind}\x1f{key}".encode("utf-8", "surrogatepass")) % BUCKETS


class Candidate(NamedTuple):
    end: int  # place after the last character of a sentence that would end here
    next: int  # place of the first character after it
    keys: tuple[int, ...]  # buckets of one and two tokens left, and right, and of the stop
    bits: int  # see ``flags_of``


@lru_cache(1 << 12)
def _kind(mark: str) -> str:
    stripped = "".join(c for c in mark if c not in CLOSERS and not c.isspace())
    if not stripped:
        return "_"
    if stripped.startswith(".."):
        return "..."
    if "…" in stripped:
        return "…"
    return stripped[-1] if len(set(stripped)) == 1 else stripped[-1] + "+"


def context(text: str, mark_at: int, end: int, mark: str) -> tuple[int, ...]:
    """Buckets of the contexts of a place."""
    kind = _kind(mark)
    l1, l2 = _left(text, mark_at)
    r1, r2 = _right(text, end)
    return bucket("l1" + kind, l1), bucket("l2" + kind, l2), bucket("r1", r1), bucket("r2", r2), bucket("k", kind)


# bits of a candidate, in the order of its flags; the last is the negative of LEAD
DEPTH, CLOSED, LEAD, LOWER, UPPER, DIGIT, OPENS, BLANK, DOT, ASKS, IS_WIDE, MORE, SEMICOLON, NEWLINE, INITIAL, TIGHT, LEAD_NOT = (1 << k for k in range(17))
FLAGS = 16
SIZE = 1 + 6 + FLAGS + 3


def flags_of(bits: np.ndarray) -> np.ndarray:
    flags = ((bits[:, None] >> np.arange(FLAGS)) & 1).astype(np.float32)
    flags[:, 2] -= (bits >> FLAGS) & 1
    return flags


def _before(text: str, at: int, end: int, mark: str, opening: dict[int, int]) -> int:
    """Bits of a stop and what stands before it."""
    bits = 0
    closed = opening.get(end - 1)
    if closed is not None:
        before = text[:closed].rstrip()
        bits = CLOSED | (LEAD if not before or before[-1] in STOPS or before[-1] in WIDE or before[-1] in CLOSERS else LEAD_NOT)
    if mark and not mark.isspace():
        bits |= (DOT if mark[0] == "." else 0) | (ASKS if "!" in mark or "?" in mark or "؟" in mark else 0) | (SEMICOLON if mark[0] in GREEK_QUESTION else 0)
        bits |= (IS_WIDE if any(c in WIDE for c in mark) else 0) | (MORE if "..." in mark or "…" in mark else 0)
    else:
        bits |= BLANK
    if len(mark) == 1 and at and text[at - 1].isalpha() and (at < 2 or not text[at - 2].isalnum()):
        bits |= INITIAL
    return bits


def _after(first: str) -> int:
    """Bits of the character that follows."""
    return (LOWER if first.islower() else 0) | (UPPER if first.isupper() else 0) | (DIGIT if first.isdigit() else 0) | (OPENS if first in PAIRS or first == '"' else 0)


def candidates(text: str) -> list[Candidate]:
    """Places in a paragraph where a sentence may end, but for its own end."""
    return _candidates(text, _inside(text))


def _candidates(text: str, inside: tuple[list[int], list[int], dict[int, int]]) -> list[Candidate]:
    out: list[Candidate] = []
    size = len(text.rstrip())
    starts, ends, opening = inside
    for m in (CANDIDATE_OR_BLANK if _UNSTOPPED.search(text) else CANDIDATE).finditer(text):
        at, end, mark = m.start(), m.end(), m.group()
        if not mark.strip():
            end = at
        if end >= size or (mark[0] in GREEK_QUESTION and not _GREEK.search(text, max(0, at - 24), at)):
            continue
        after = end
        while after < size and text[after].isspace():
            after += 1
        bits = _before(text, at, end, mark, opening) | _after(text[after]) | (NEWLINE if "\n" in text[end:after] else 0) | (TIGHT if after == end else 0)
        k = bisect_left(starts, end) - 1
        if k >= 0 and ends[k] >= end:
            bits |= DEPTH
        out.append(Candidate(end, after, context(text, at, after, mark), bits))
    return out


def _tail(text: str) -> tuple[int, str]:
    """The stop, with what closes it, at the end of a paragraph."""
    end = len(text.rstrip())
    at = end
    while at and (text[at - 1] in STOPS or text[at - 1] in WIDE or text[at - 1] in CLOSERS or text[at - 1] == ";" or (text[at - 1].isspace() and text[at:end].strip(CLOSERS + " ") == "")):
        at -= 1
    return at, text[at:end]


def rates(table: np.ndarray, general: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of contexts, how often they end or begin paragraphs: two tokens, backed off to one."""
    out = []
    stop = table[keys[:, 4]]
    for side, prior in ((0, (stop[:, 1] + 5 * general[0]) / (stop[:, 0] + 5)), (1, general[1])):
        one, two = table[keys[:, 2 * side]], table[keys[:, 2 * side + 1]]
        r1 = (one[:, 1] + 2 * prior) / (one[:, 0] + 2)
        r2 = (two[:, 1] + 4 * r1) / (two[:, 0] + 4)
        out += [r1, r2, two[:, 0], one[:, 0]]
    return tuple(out)


def features(table: np.ndarray, general: np.ndarray, keys: np.ndarray, flags: np.ndarray) -> np.ndarray:
    l1, l2, nl, _, r1, r2, nr, _ = rates(table, general, keys)
    logit = lambda p: np.log((p + 0.003) / (1.003 - p)) / 3
    a, b, c, d = logit(l1), logit(l2), logit(r1), logit(r2)
    return np.column_stack([np.ones(len(keys)), a, b, c, d, np.minimum(b, d), np.minimum(a, c), flags, flags[:, 7] * b, flags[:, 7] * d, flags[:, 10]]).astype(np.float32)


class Chain:
    """A linear-chain model of two tags, *inside* and *boundary*.

    Every character has a tag; places that are no candidates are inside, so the chain
    runs over the candidates of a paragraph. Fitting takes partly labelled sequences and
    raises the likelihood of what is labelled, summing over the rest.
    """

    def __init__(self):
        self.weights = np.zeros(SIZE)
        self.moves = np.zeros((2, 2))

    def fit(self, xs: list[np.ndarray], ys: list[np.ndarray], rounds: int = 100, rate: float = 0.15, ridge: float = 1e-3) -> Chain:
        """``ys`` holds 1, 0, or -1 where the tag is not known."""
        if not xs:
            self.weights[[2, 4]] = 1.0
            return self
        n, longest = len(xs), max(map(len, xs))
        x = np.zeros((n, longest, SIZE))
        y, there = np.full((n, longest), -1), np.zeros((n, longest), bool)
        for k, (a, b) in enumerate(zip(xs, ys)):
            x[k, : len(a)], y[k, : len(b)], there[k, : len(a)] = a, b, True
        flat, allowed = x.reshape(n * longest, SIZE), np.zeros((n, longest, 2))
        allowed[y == 0, 1] = allowed[y == 1, 0] = -50.0
        total = max(1, there.sum())
        state = [np.zeros(SIZE + 4), np.zeros(SIZE + 4)]
        for step in range(1, rounds + 1):
            emit = np.stack([np.zeros((n, longest)), (flat @ self.weights).reshape(n, longest)], 2)
            p1, m1 = self._marginals(emit + allowed, there)
            p0, m0 = self._marginals(emit, there)
            g = np.concatenate([flat.T @ (p1 - p0).ravel() / total - ridge * self.weights, ((m1 - m0) / total).ravel() - ridge * self.moves.ravel()])
            state[0] = 0.9 * state[0] + 0.1 * g
            state[1] = 0.99 * state[1] + 0.01 * g * g
            move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
            self.weights = self.weights + move[:SIZE]
            self.moves = self.moves + move[SIZE:].reshape(2, 2)
        return self

    def _marginals(self, emit: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, longest, _ = emit.shape
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = emit[:, 0]
        def add(v):  # log of the sum of two exponentials
            a, b = v[..., 0], v[..., 1]
            return np.maximum(a, b) + np.log1p(np.exp(-np.abs(a - b)))

        for t in range(1, longest):
            new = np.stack([add(forward[:, t - 1] + self.moves[:, j]) for j in (0, 1)], 1) + emit[:, t]
            forward[:, t] = np.where(there[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = emit[:, t + 1] + backward[:, t + 1]
            new = np.stack([add(ahead + self.moves[i]) for i in (0, 1)], 1)
            backward[:, t] = np.where(there[:, t + 1, None], new, 0)
        z = add(forward[:, -1])
        p = np.exp(forward[..., 1] + backward[..., 1] - z[:, None]) * there
        both = forward[:, :-1, :, None] + self.moves + (emit + backward)[:, 1:, None, :] - z[:, None, None, None]
        return p, (np.exp(both) * there[:, 1:, None, None]).sum((0, 1))

    def tags(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The most probable tags (Viterbi) of sequences that follow one another, all at once."""
        return viterbi(scores, sizes, self.moves)


def viterbi(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """For sequences of ``sizes`` scores of the second tag, whether a place has it; longer sequences go first, so a step takes all that reach so far."""
    order = np.argsort(-sizes, kind="stable")
    order = order[: int((sizes > 0).sum())]
    first = (np.cumsum(sizes) - sizes)[order]
    lengths = sizes[order]
    inside, boundary = np.zeros(len(order)), scores[first].astype(np.float64)
    back = np.zeros((2, len(scores)), bool)
    (ii, ib), (bi, bb) = moves
    reach = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")  # sequences longer than t at t
    for t in range(1, len(reach)):
        m = reach[t]
        at, a, b = first[:m] + t, inside[:m], boundary[:m]
        to_i, to_b = b + bi > a + ii, b + bb > a + ib
        back[0, at], back[1, at] = to_i, to_b
        inside[:m], boundary[:m] = np.where(to_i, b + bi, a + ii), np.where(to_b, b + bb, a + ib) + scores[at]
    out, tag = np.zeros(len(scores), bool), boundary > inside
    for t in range(len(reach) - 1, -1, -1):
        m = reach[t]
        at = first[:m] + t
        out[at] = tag[:m]
        tag[:m] = back[tag[:m].astype(int), at]
    return out


def weak_labels(table: np.ndarray, general: np.ndarray, keys: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Sure tags from paragraph ends and starts; -1 where neither side is sure."""
    l1, l2, nl, nl1, r1, r2, nr, nr1 = rates(table, general, keys)
    y = np.full(len(keys), -1)
    left_no = ((nl >= 8) & (l2 < 0.01)) | ((nl1 >= 20) & (l1 < 0.005))
    right_no = ((nr >= 8) & (r2 < 0.01)) | ((nr1 >= 20) & (r1 < 0.005))
    y[(l2 > 0.1) & (r2 > 0.1) & (flags[:, 0] == 0)] = 1
    y[left_no | right_no | (flags[:, 0] > 0)] = 0
    return y


def _script(text: str) -> int:
    """1 for scripts without stops, 2 for dense ones, else by the first letter's block; Latin is 0."""
    if _UNSTOPPED.search(text):
        return 1
    if _DENSE.search(text):
        return 2
    letter = next((c for c in text if c.isalpha()), "a")
    return 16 + (ord(letter) >> 7) if ord(letter) > 0x24F else 0


class Stretch(NamedTuple):
    """At most ``WINDOW`` candidates of a paragraph that follow one another, to fit on."""

    script: int
    text: str  # from the end of the stretch before
    found: list[Candidate]  # places count from there
    tail: tuple[tuple[int, ...], int] | None  # keys and bits of the paragraph's last stop, if the stretch ends there
    head: tuple[tuple[int, ...], int] | None  # of its first character, if it begins there


def stretches(part: str, found: list[Candidate], opening: dict[int, int]) -> Iterator[Stretch]:
    start, script = 0, _script(part)
    for at in range(0, max(len(found), 1), WINDOW):
        some, last = found[at : at + WINDOW], at + WINDOW >= len(found)
        stop = len(part) if last else some[-1].next
        tail = head = None
        if last:
            place, mark = _tail(part)
            if mark or script == 1:
                keys = context(part, place, len(part), mark)
                tail = (keys[0], keys[1], keys[4]), _before(part, place, len(part), mark, opening)
        if at == 0:
            head = context(part, 0, 0, "")[2:4], _after(part[0])
        text = part[start:stop] if stop - start <= WINDOW_CHARS else ""
        yield Stretch(script, text, [Candidate(c.end - start, c.next - start, c.keys, c.bits) for c in some], tail, head)
        start = stop


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str, list[tuple[int, str]]]]:
    """``(row, text, cells)`` of a batch of documents, a cell as its place and body."""
    texts, starts, sizes = (batch.column(c).to_pylist() for c in ("text", "at", "n"))
    for row, (text, at, size) in enumerate(zip(texts, starts, sizes)):
        yield row, text, [(a, text[a : a + n]) for a, n in zip(at, size) if a is not None and n is not None and a >= 0 and n > 0]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The one pass over texts: per document its units and their candidates as numbers.

    ``units`` holds start, end and number of candidates of each; ``found`` end, next,
    keys and bits of each candidate; ``edges`` the keys at the end and start of each
    paragraph; ``plain`` the paragraphs without any stop; ``train`` stretches of sampled documents.
    """
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        sampled = batch.column("sampled").to_pylist()
        for row, _, cells in _texts(batch):
            spans: list[int] = []
            numbers: list[int] = []
            edges: list[int] = []
            plain, train = [], []
            for at, body in cells:
                for a, b, whole in units(body):
                    part = body[a:b].rstrip()
                    lead = len(part) - len(part.lstrip())
                    if lead == len(part):
                        continue
                    part = part[lead:]
                    start = at + a + lead
                    if whole:
                        spans += (start, start + len(part), 0)
                        continue
                    inside = _inside(part)
                    found = _candidates(part, inside)
                    for end, after, keys, bits in found:
                        numbers += (start + end, start + after, *keys, bits)
                    place, mark = _tail(part)
                    keys = context(part, place, len(part), mark)
                    edges += (keys[0], keys[1], keys[4], *context(part, 0, 0, "")[2:4])
                    if not found and not _STOP.search(part) and not _UNSTOPPED.search(part):
                        plain.append({"unit": len(spans) // 3, "text": part})
                    spans += (start, start + len(part), len(found))
                    if sampled[row]:
                        train += map(pickle.dumps, stretches(part, found, inside[2]))
            for column, values in zip(columns, (np.array(spans, np.int32).tobytes(), np.array(numbers, np.int32).tobytes(), np.array(edges, np.int32).tobytes(), plain, train)):
                column.append(values)
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.struct([("unit", pa.int32()), ("text", pa.string())])), pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc", "units", "found", "edges", "plain", "train"])


def _numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What a column of ``_find`` holds, and how many rows each document has."""
    values = np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, width)
    return values, pc.binary_length(column).to_numpy(zero_copy_only=False) // (4 * width)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often contexts stand at candidates, and at paragraph ends and starts."""
    seen, edge = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    general, plain = np.zeros((2, 2), np.int64), 0
    for batch in batches:
        inner, edges = _numbers(batch.column("found"), 8)[0][:, 2:7], _numbers(batch.column("edges"), 5)[0]
        at_edge = np.bincount(edges.ravel(), minlength=BUCKETS)
        seen += np.bincount(inner.ravel(), minlength=BUCKETS) + at_edge
        edge += at_edge
        general += [len(inner) + len(edges), len(edges)]
        plain += int(pc.sum(pc.list_value_length(batch.column("plain"))).as_py() or 0)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.r_[at, [-1, -2, -3]]), pa.array(np.r_[seen[at], general[:, 0], plain]), pa.array(np.r_[edge[at], general[:, 1], 0])], ["bucket", "seen", "edge"]
    )


def train(table: np.ndarray, general: np.ndarray, sample: list[Stretch]) -> Chain:
    """Fit the chain to stretches of paragraphs and to pairs of them joined without a paragraph break.

    A join is a sure boundary; other candidates take their weak label. In scripts
    without stops the text is as if stripped of punctuation, so joins there teach the
    boundary at a bare blank.
    """
    xs, ys = [], []
    before: dict[int, Stretch] = {}
    for one in sample:
        keys, bits, join = [c.keys for c in one.found], [c.bits for c in one.found], -1
        if one.head and (other := before.get(one.script)):
            (l1, l2, kind), left = other.tail
            join = len(other.found)
            keys = [*(c.keys for c in other.found), (l1, l2, *one.head[0], kind), *keys]
            bits = [*(c.bits for c in other.found), left | one.head[1] | (TIGHT if one.script == 2 else 0), *bits]
        if one.tail:
            before[one.script] = one
        if not keys:
            continue
        flags = flags_of(np.array(bits))
        y = weak_labels(table, general, np.array(keys), flags)
        if join >= 0:
            y[join] = 1
        xs.append(features(table, general, np.array(keys), flags))
        ys.append(y)
    return Chain().fit(xs, ys)


class Tagger:
    """A linear-chain model of texts without stops, an averaged perceptron with Viterbi.

    It tags every blank or, where no blanks part words, every character. It is fitted on
    text stripped of its punctuation, whose sentences the other chain has parted.
    """

    def __init__(self, seed: int = 3, rounds: int = 6):
        self.weights, self.moves = np.zeros(WEIGHTS, np.float32), np.zeros((2, 2))
        self.scripts: set[int] = set()
        self.seed, self.rounds = seed, rounds

    def fit(self, sample: list[tuple[int, list[str]]]) -> Tagger:
        """``sample`` holds scripts and sentences that follow one another."""
        rows = []
        for script, parts in sample:
            text, ends = "", set()
            for part in filter(None, map(stripped, parts)):
                text += ("" if script == DENSE_SCRIPT else " ") * bool(text)
                text += part
                ends.add(len(text))
            found = places(text)
            if len(ends) > 1 and found:
                self.scripts.add(script)
                rows.append((np.array([keys for _, _, keys in found]), np.array([end in ends for end, _, _ in found])))
        totals, moves, step, rng = np.zeros(WEIGHTS), np.zeros((2, 2)), 1, random.Random(self.seed)
        weights, own = np.zeros(WEIGHTS), np.zeros((2, 2))
        for _ in range(self.rounds):
            rng.shuffle(rows)
            for keys, y in rows:
                got = viterbi(weights[keys].sum(1), np.array([len(y)]), own)
                wrong = np.flatnonzero(got != y)
                if len(wrong):
                    sign = np.repeat(np.where(y[wrong], 1.0, -1.0), keys.shape[1])
                    change = np.zeros((2, 2))
                    np.add.at(change, (y[:-1].astype(int), y[1:].astype(int)), 1)
                    np.add.at(change, (got[:-1].astype(int), got[1:].astype(int)), -1)
                    np.add.at(weights, keys[wrong].ravel(), sign)
                    np.add.at(totals, keys[wrong].ravel(), sign * step)
                    own, moves = own + change, moves + change * step
                step += 1
        self.weights, self.moves = (weights - totals / step).astype(np.float32), own - moves / step
        return self

    def boundaries(self, text: str) -> list[tuple[int, int]]:
        """``(end, next)`` of the sentences of a text but for its own end; none in a script that no text taught."""
        if _plain_script(text) not in self.scripts:
            return []
        found = places(text)
        if not found:
            return []
        tags = viterbi(self.weights[np.array([keys for _, _, keys in found])].sum(1), np.array([len(found)]), self.moves)
        return [(end, after) for (end, after, _), tag in zip(found, tags) if tag]


DENSE_SCRIPT = 2
_WRITTEN_TOGETHER = re.compile(f"[{DENSE}\u0f00-\u0fff\u1780-\u17ff]")


def _plain_script(text: str) -> int:
    return DENSE_SCRIPT if _WRITTEN_TOGETHER.search(text) else _script(text)


def stripped(text: str) -> str:
    """Without punctuation, but for what stands within a word or number."""
    out = []
    for at, c in enumerate(text):
        if unicodedata.category(c)[0] == "P" and not (c.isascii() and 0 < at < len(text) - 1 and text[at - 1].isalnum() and text[at + 1].isalnum() and text[at + 1].isascii()):
            c = " "
        out.append(c)
    return " ".join("".join(out).split())


@lru_cache(1 << 16)
def _weight(kind: str, key: str) -> int:
    return zlib.crc32(f"{kind}\x1f{key}".encode("utf-8", "surrogatepass")) % WEIGHTS


def places(text: str) -> list[tuple[int, int, tuple[int, ...]]]:
    """``(end, next, weights)`` of every place in a text without stops that may be a boundary."""
    out, script = [], _plain_script(text)
    if script == DENSE_SCRIPT:
        for at in range(1, len(text)):
            a, b = text[at - 1], text[at]
            if a.isspace() or unicodedata.category(b)[0] == "M" or (a.isascii() and b.isascii() and a.isalnum() and b.isalnum()):
                continue
            after = at + len(text[at:]) - len(text[at:].lstrip()) if b.isspace() else at
            left, right, gap = text[max(0, at - 4) : at], text[after : after + 4], "_" if after > at else ""
            marks = [("l" + str(k) + gap, left[-k:]) for k in (1, 2, 3, 4)] + [("r" + str(k) + gap, right[:k]) for k in (1, 2, 3, 4)] + [("c", left[-1:] + right[:1]), ("d", left[-2:] + right[:2]), ("g", gap)]
            out.append((at, after, tuple(_weight(*m) for m in marks)))
        return out
    words = list(re.finditer(r"\S+", text))
    for k in range(1, len(words)):
        left, right = words[k - 1].group(), words[k].group()
        two = words[k - 2].group() if k > 1 else "^"
        then = words[k + 1].group() if k + 1 < len(words) else "$"
        marks = [
            ("L1", _shape(left.lower())), ("L2", _shape(f"{two} {left}".lower())), ("R1", _shape(right.lower())), ("R2", _shape(f"{right} {then}".lower())),
            ("C", _shape(f"{left} {right}".lower())), ("U", f"{script} {left[:1].isupper()} {right[:1].isupper()}"), ("E", left[-3:].lower()), ("B", f"{script}"),
            ("X", f"{right.lower()} {right[:1].isupper()}"),
        ]
        out.append((words[k - 1].end(), words[k].start(), tuple(_weight(*m) for m in marks)))
    return out


def stripped_sample(table: np.ndarray, general: np.ndarray, chain: Chain, sample: list[Stretch], together: int = 3) -> list[tuple[int, list[str]]]:
    """Scripts and sentences, a few stretches in a row, as the chain parts texts with stops."""
    out: dict[int, list[list[str]]] = {}
    for one in sample:
        if not one.text or not _STOP.search(one.text):
            continue
        tags: list[bool] = []
        if one.found:
            scores = features(table, general, np.array([c.keys for c in one.found]), flags_of(np.array([c.bits for c in one.found]))) @ chain.weights
            tags = chain.tags(scores, np.array([len(one.found)])).tolist()
        parts, start = [], 0
        for c, tag in zip(one.found, tags):
            if tag:
                parts.append(one.text[start : c.end])
                start = c.next
        out.setdefault(_plain_script(one.text), []).append([*parts, one.text[start:]])
    return [(script, sum(rows[at : at + together], [])) for script, rows in out.items() for at in range(0, len(rows), together)]


def sentences(spark: SparkSession, df: DataFrame, key: str, text: str, cells: str, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """``key, start_pos, end_pos``: every sentence of every cell of kind ``text``.

    One pass over the texts writes, as numbers, all places where a stop or, in scripts
    without stops, a blank might end a sentence (see ``_find``). From these it is counted
    over all documents, in a table of ``BUCKETS`` buckets, which contexts end and begin
    paragraphs among all such places; the chain's few weights are fitted on about
    ``sample`` documents; and places are tagged by Viterbi. No text is shuffled; only
    counts are, of a fixed number of buckets.

    A paragraph without any stop, in a script that has stops, is tagged character by
    character, or blank by blank, by a chain fitted on the sample stripped of its
    punctuation; in a script of which the sample holds no text with stops, it is one sentence.

    Positions count code points from 0, the end excluded. Headings and list items are
    one sentence, without their marks; blank lines end sentences. A null or empty text,
    null cells, cells without place or length and null keys give no rows; places beyond
    the text are cut to it; repeated documents give their rows again; further columns
    are not read.
    """
    chosen = F.filter(F.col(cells), lambda c: c["kind"] == F.lit("text"))
    share = int(min(1.0, sample / max(df.count(), 1)) * (1 << 20))
    rows = df.select(F.col(key).alias("doc"), F.col(text).alias("text"), chosen.alias("cells")).where("doc IS NOT NULL AND text IS NOT NULL AND size(cells) > 0")
    sampled = F.pmod(F.xxhash64("doc", F.lit(13)), F.lit(1 << 20)) < share
    rows = rows.select("doc", "text", F.col("cells.start_pos").alias("at"), F.col("cells.n_chars").alias("n"), sampled.alias("sampled"))
    kind = dict(rows.dtypes)["doc"]
    found = materialise(spark, rows.mapInArrow(_find, f"doc {kind}, units binary, found binary, edges binary, plain array<struct<unit:int,text:string>>, train array<binary>"), "candidates")
    counts = found.select("found", "edges", "plain").mapInArrow(_count, "bucket long, seen long, edge long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("edge").alias("edge")).toArrow()  # BUCKETS + 3 rows at most
    table_, general = np.zeros((BUCKETS, 2), np.float32), np.full(2, 0.3)
    at, seen, edge = (counts.column(c).to_numpy() for c in ("bucket", "seen", "edge"))
    table_[at[at >= 0], 0], table_[at[at >= 0], 1] = seen[at >= 0], edge[at >= 0]
    for side in (-1, -2):
        if (seen[at == side] > 0).any():
            general[-side - 1] = float(edge[at == side][0]) / float(seen[at == side][0])
    some = found.where("size(train) > 0").select(F.explode("train").alias("w")).orderBy(F.xxhash64("w"), "w").limit(SAMPLE_WINDOWS).toArrow()  # bounded
    picked = [pickle.loads(w) for w in some.column(0).to_pylist()]
    chain = train(table_, general, picked)
    tagger = Tagger().fit(stripped_sample(table_, general, chain, picked)) if seen[at == -3].sum() else Tagger()
    model = spark.sparkContext.broadcast((table_, general, chain, tagger))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, general, chain, tagger = model.value
        for batch in batches:
            spans, per_doc = _numbers(batch.column("units"), 3)
            places_, _ = _numbers(batch.column("found"), 8)
            bounds = np.zeros(0, np.int64)
            unit = np.repeat(np.arange(len(spans)), spans[:, 2])
            if len(places_):
                scores = features(table_, general, places_[:, 2:7], flags_of(places_[:, 7])) @ chain.weights
                bounds = np.flatnonzero(chain.tags(scores, spans[:, 2]))
            of, end, after = unit[bounds], places_[bounds, 0], places_[bounds, 1]
            extra = []
            for first, plain in zip((np.cumsum(per_doc) - per_doc).tolist(), batch.column("plain").to_pylist()):
                for p in plain or ():
                    u = first + p["unit"]
                    extra += [(u, spans[u, 0] + e, spans[u, 0] + n) for e, n in tagger.boundaries(p["text"])]
            if extra:
                more = np.array(extra)
                of, end, after = np.r_[of, more[:, 0]], np.r_[end, more[:, 1]], np.r_[after, more[:, 2]]
            # a unit's last sentence ends with it
            of, end, after = np.r_[of, np.arange(len(spans))], np.r_[end, spans[:, 1]], np.r_[after, spans[:, 1]]
            order = np.lexsort((end, of))
            of, end, after = of[order], end[order], after[order]
            new = np.r_[True, of[1:] != of[:-1]] if len(of) else np.zeros(0, bool)
            start = np.where(new, spans[of, 0], np.r_[0, after[:-1]] if len(of) else after)
            doc = np.repeat(np.arange(len(batch)), per_doc)[of]
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc", "start_pos", "end_pos"])

    return found.select("doc", "units", "found", "plain").mapInArrow(tag, f"doc {kind}, start_pos int, end_pos int").withColumnRenamed("doc", key)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, table(spark, sf_dir, "documents"), "doc_id", "text", "cells")


QUERIES = {"p10_found": p10_found}
SQL: dict[str, str] = {}
