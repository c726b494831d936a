"""The syntax of lexical questions: phrases, fields, boosts, AND, OR, NOT, + and -, parentheses."""

from __future__ import annotations

import re

AND, OR, NOT = -1, -2, -3
_TOKEN = re.compile(r'\s*(?:(?P<field>\w+):(?=[^\s:])|(?P<phrase>"[^"]*")|(?P<mark>[()+\-])|(?P<word>[^\s()"^:]+))(?:\^(?P<boost>\d+(?:\.\d+)?))?')
_END = re.compile(r"\s*$")
DEEPEST = 50


class Broken(ValueError):
    pass


def _tokens(text: str) -> list[tuple[str, str, float]]:
    out, at = [], 0
    while not _END.match(text, at):
        m = _TOKEN.match(text, at)
        if not m or (m["boost"] and (m["field"] or m["mark"] in ("(", "+", "-"))):
            raise Broken(text)
        kind = m.lastgroup if m.lastgroup != "boost" else next(k for k in ("phrase", "mark", "word") if m[k])
        value = m[kind]
        if kind == "word" and value in ("AND", "OR", "NOT"):
            kind = "mark"
        out.append((kind, value, float(m["boost"] or 1)))
        at = m.end()
    return out


class Reader:
    """leaves: (text, field or None, boost, whether it can add to a score); program: leaf numbers and operators, operands first."""

    def __init__(self, text: str):
        self.tokens, self.at, self.leaves = _tokens(text), 0, []
        self.program = self.either(0, None, 1.0, True)
        if self.at < len(self.tokens):
            raise Broken(text)

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "mark" else None

    def either(self, depth: int, field: str | None, boost: float, counts: bool) -> list[int]:
        """Parts that OR or nothing joins; with + and - among them, those are bound to be there or not, and others are free to be."""
        plus, minus, plain = [], [], []
        if depth > DEEPEST:
            raise Broken("too deep")
        while True:
            mark = self.peek()
            if mark in ("+", "-"):
                self.at += 1
                (plus if mark == "+" else minus).append(self.one(depth, field, boost, counts and mark == "+"))
            else:
                plain.append(self.both(depth, field, boost, counts))
            if self.peek() == "OR":
                self.at += 1
            elif self.at == len(self.tokens) or self.peek() == ")":
                break
        out = _join(plus, AND) if plus else _join(plain, OR) if plain else []
        if not out:
            raise Broken("nothing is asked for")
        for part in minus:
            out = [*out, *part, NOT, AND]
        return out

    def both(self, depth: int, field: str | None, boost: float, counts: bool) -> list[int]:
        parts = [self.one(depth, field, boost, counts)]
        while self.peek() == "AND":
            self.at += 1
            parts.append(self.one(depth, field, boost, counts))
        return _join(parts, AND)

    def one(self, depth: int, field: str | None, boost: float, counts: bool) -> list[int]:
        if self.at == len(self.tokens):
            raise Broken("an operand is missing")
        kind, value, own = self.tokens[self.at]
        self.at += 1
        if value == "NOT" and kind == "mark":
            return [*self.one(depth + 1, field, boost, False), NOT]
        if kind == "field":
            return self.one(depth + 1, value, boost, counts)
        if value == "(" and kind == "mark":
            first = len(self.leaves)
            out = self.either(depth + 1, field, boost, counts)
            if self.peek() != ")":
                raise Broken("a bracket is open")
            own = self.tokens[self.at][2]
            self.leaves[first:] = [(t, f, b * own, c) for t, f, b, c in self.leaves[first:]]
            self.at += 1
            return out
        if kind == "mark":
            raise Broken(value)
        self.leaves.append((value.strip('"'), field, boost * own, counts))
        return [len(self.leaves) - 1]


def _join(parts: list[list[int]], operator: int) -> list[int]:
    out = list(parts[0])
    for part in parts[1:]:
        out += [*part, operator]
    return out


def read(text: str | None) -> tuple[list[tuple[str, str | None, float, bool]], list[int]]:
    """(leaves, program) of a question; one whose syntax is broken is a phrase as it stands."""
    try:
        r = Reader(text or "")
        return r.leaves, r.program
    except Broken:
        return [((text or "").replace('"', " "), None, 1.0, True)], [0]
