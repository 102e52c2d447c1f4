"""A quote-aware tokenizer for fields that hold several values."""

from __future__ import annotations

import re
from collections.abc import Callable, Container

# Separators seen between values. Symbols part values as they stand,
# words only between blanks.
SYMBOLS = (";", ",", "/", "|")
WORDS = ("&", "+", "x", "feat.", "ft.", "featuring")

OPENING = {"[": "]", "(": ")", "{": "}"}
QUOTES = "\"'"


def fold(value: str) -> str:
    """Letter case and runs of blanks aside."""
    return " ".join(value.lower().split())


def solid(value: str) -> int:
    """Characters that are no blanks."""
    return len("".join(value.split()))


class Tokenizer:
    """Finite-state splitter of packed fields.

    States are *value start*, *inside quotes*, *inside a plain value* and *after a
    value*; the nesting depth of brackets is carried along. At a value start the
    longest stretch up to a separator that is a ``known`` name is taken whole, so a
    name may contain separators, quotes or brackets. Otherwise a quote opens a quoted
    value, in which separators are text, a doubled or backslash-escaped quote stands
    for one, and the closing quote must be followed by a separator, a closing bracket
    or the end; a quote that never closes is text. Empty values are skipped. No stretch
    is looked up beyond ``max_known``, as ``measure`` counts; so it must not exceed what
    is left of a text by ``key``.
    """

    def __init__(
        self,
        known: Container[str] = (),
        max_known: int = 0,
        key: Callable[[str], str] = fold,
        symbols: tuple[str, ...] = SYMBOLS,
        words: tuple[str, ...] = WORDS,
        measure: Callable[[str], int] = solid,
    ):
        symbol = "[" + "".join(map(re.escape, symbols)) + "]"
        word = "|".join(map(re.escape, sorted(words, key=len, reverse=True)))
        self.known, self.key, self.max_known, self.measure = known, key, max_known, measure
        self.separator = re.compile(rf"{symbol}|\s(?:{word})(?=\s)", re.IGNORECASE)
        self.boundary = re.compile(rf"{symbol}|\s(?:{word})(?=\s)|[\])}}]", re.IGNORECASE)
        self.plain = re.compile(rf"{symbol}|\s(?:{word})(?=\s)|[\[({{\])}}]", re.IGNORECASE)

    def known_end(self, text: str, at: int) -> int:
        """The end of the longest known name that starts at ``at``, or -1."""
        best, length, last = -1, 0, at
        if not self.max_known:
            return best
        ends = (m.start() for m in self.boundary.finditer(text, at + 1))
        for end in [*ends, None] if len(text) - at < 4096 else self._far(ends):
            end = len(text) if end is None else end
            length += self.measure(text[last:end])
            last = end
            if self.key(text[at:end]) in self.known:
                best = end
            if length > self.max_known:
                break
        return best

    @staticmethod
    def _far(ends):
        yield from ends
        yield None

    def quoted(self, text: str, at: int) -> tuple[str, int] | None:
        """The value inside the quotes that open at ``at`` and the place after them."""
        quote, parts, start, k = text[at], [], at + 1, at + 1
        while (k := text.find(quote, k)) >= 0:
            if text[k - 1] == "\\" and k > start:
                parts += [text[start : k - 1], quote]
                start = k = k + 1
            elif text[k + 1 : k + 2] == quote:
                parts += [text[start:k], quote]
                start = k = k + 2
            else:
                after = k + 1
                while after < len(text) and text[after].isspace():
                    after += 1
                if after == len(text) or text[after] in "])}" or self.separator.match(text, after) or (after > k + 1 and self.separator.match(text, after - 1)):
                    return "".join([*parts, text[start:k]]), k + 1
                k += 1
        return None

    def split(self, text: str) -> list[str]:
        """The values in written order, without quotes, brackets and outer blanks."""
        values: list[str] = []
        at, depth, size = 0, 0, len(text)
        while at < size:
            ch = text[at]
            if ch.isspace():
                if m := self.separator.match(text, at):
                    at = m.end()
                else:
                    at += 1
                continue
            if (end := self.known_end(text, at)) >= 0:
                value, at = text[at:end], end
            elif m := self.separator.match(text, at):
                at = m.end()
                continue
            elif ch in QUOTES and (found := self.quoted(text, at)):
                value, at = found
            elif ch in OPENING:
                depth, at = depth + 1, at + 1
                continue
            elif ch in "])}" and depth:
                depth, at = depth - 1, at + 1
                continue
            else:
                value, at = self.unquoted(text, at, depth)
            if value := value.strip():
                values.append(value)
        return values

    def unquoted(self, text: str, at: int, depth: int) -> tuple[str, int]:
        """A plain value up to the next separator outside brackets opened within it."""
        inner, start = 0, at
        for m in self.plain.finditer(text, at + 1):
            c = m.group()
            if c in OPENING:
                inner += 1
            elif c in "])}":
                if inner:
                    inner -= 1
                elif depth:
                    return text[start : m.start()], m.start()
            elif not inner:
                return text[start : m.start()], m.start()
        if inner:  # a bracket that never closes is text
            m = self.separator.search(text, at + 1)
            if m:
                return text[start : m.start()], m.start()
        return text[start:], len(text)

    def spans(self, text: str) -> list[str]:
        """Keys of every stretch that may be a known name, to be looked up elsewhere."""
        starts = [0, *(m.end() for m in re.finditer(rf"{self.separator.pattern}|[\[({{\"']", text, re.IGNORECASE))]
        out: set[str] = set()
        for at in starts:
            while at < len(text) and text[at].isspace():
                at += 1
            length, last = 0, at
            for end in [*(m.start() for m in self.boundary.finditer(text, at + 1)), len(text)]:
                length += self.measure(text[last:end])
                last = end
                out.add(self.key(text[at:end]))
                if length > self.max_known:
                    break
        out.discard("")
        return sorted(out)
