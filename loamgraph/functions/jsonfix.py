"""Reading JSON that a model broke: a scan with a stack that closes what is open and mends what has one meaning."""

from __future__ import annotations

import json
import re

# Words that stand for values in other notations.
WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}
_NUMBER = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")
_BARE = re.compile(r"[^\s,:\[\]{}\"']+")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _string(text: str, at: int) -> tuple[str, int]:
    """(value, place after it) of a string that begins with a quote at `at`; an end of text ends it.

    A quote inside ends the string only where white space and one of `,:]}` or the end of the text follow; otherwise it is a letter.
    """
    quote, out, i = text[at], [], at + 1
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            e = text[i + 1]
            if e == "u" and re.match(r"[0-9a-fA-F]{4}", text[i + 2 : i + 6]):
                out.append(chr(int(text[i + 2 : i + 6], 16)))
                i += 6
                continue
            out.append(_ESCAPES.get(e, e))
            i += 2
            continue
        if c == quote:
            j = i + 1
            while j < len(text) and text[j].isspace():
                j += 1
            if j == len(text) or text[j] in ",:]}":
                return "".join(out), i + 1
        out.append(c)
        i += 1
    return "".join(out).rstrip("\\"), i


class _Open:
    """An array or object that isn't closed yet."""

    def __init__(self, kind: str):
        self.value = [] if kind == "[" else {}
        self.key: str | None = None

    def put(self, value) -> None:  # noqa: ANN001
        if isinstance(self.value, list):
            self.value.append(value)
        elif self.key is not None:
            self.value[self.key] = value
            self.key = None


def read_broken(text: str):  # noqa: ANN201
    """The first object or array of a text as Python's values; None where none begins.

    Strings and brackets that the text leaves open are closed, commas without a value and keys without one at the end are dropped, single
    quotes, bare keys and other notations' words are read, and what follows the value is ignored.
    """
    begin = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if begin < 0:
        return None
    stack, i = [_Open(text[begin])], begin + 1
    while i < len(text):
        c, top = text[i], stack[-1]
        waits = isinstance(top.value, dict) and top.key is None
        if c.isspace() or c in ",:":
            i += 1
        elif c in "[{":
            if waits:
                # A value without a key has no place.
                top.key = ""
            stack.append(_Open(c))
            i += 1
        elif c in "]}":
            i += 1
            # A bracket of the other kind closes what lies inside the nearest of its kind.
            kind = list if c == "]" else dict
            if not any(isinstance(s.value, kind) for s in stack):
                continue
            while True:
                closed = stack.pop()
                if not stack:
                    return closed.value
                stack[-1].put(closed.value)
                if isinstance(closed.value, kind):
                    break
        elif c in "\"'":
            value, i = _string(text, i)
            if waits:
                top.key = value
            else:
                top.put(value)
        elif waits:
            m = _BARE.match(text, i)
            top.key, i = m.group(), m.end()
        else:
            m = _BARE.match(text, i)
            word, i = m.group(), m.end()
            top.put(WORDS[word] if word in WORDS else json.loads(word) if _NUMBER.fullmatch(word) else word)
    while len(stack) > 1:
        closed = stack.pop()
        stack[-1].put(closed.value)
    return stack[0].value


def mend(text: str | None) -> str | None:
    """The JSON of read_broken(); valid JSON as it is, null where nothing begins."""
    if text is None:
        return None
    try:
        json.loads(text)
        return text
    except ValueError:
        value = read_broken(text)
        return None if value is None else json.dumps(value, ensure_ascii=False)
