"""Pipeline text ``db.<collection>.aggregate([...])`` to (collection, stages) and back.

The array may use the relaxed notation of JavaScript: bare keys, either quote, trailing commas,
comments, hexadecimal numbers. One recursive descent reads it, so brackets inside strings are text.
"""

from __future__ import annotations

import json
import re
from typing import Any

from quern.errors import PipelineError

HEAD = re.compile(r"\bdb\s*\.\s*([A-Za-z0-9_]+)\s*\.\s*aggregate\s*\(")
BLANK = re.compile(r"(?:\s|//[^\n]*|/\*.*?\*/)*", re.DOTALL)
NAME = re.compile(r"[A-Za-z_$][\w$]*")
NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|Infinity|NaN|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}


class _Reader:
    def __init__(self, text: str, at: int):
        self.text, self.at = text, at

    def fail(self, what: str) -> PipelineError:
        return PipelineError(f"{what} at character {self.at}: {self.text[self.at : self.at + 40]!r}")

    def peek(self) -> str:
        self.at = BLANK.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def value(self) -> Any:
        c = self.peek()
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c in "\"'" and c:
            return self.string()
        if m := NUMBER.match(self.text, self.at):
            self.at = m.end()
            return self.number(m[0])
        if m := NAME.match(self.text, self.at):
            words = {"true": True, "false": False, "null": None, "undefined": None}
            if m[0] in words:
                self.at = m.end()
                return words[m[0]]
        raise self.fail("no value")

    @staticmethod
    def number(raw: str) -> int | float:
        if re.search("x", raw, re.I):
            return int(raw, 16)
        if re.search("[.eE]|Inf|NaN", raw):
            return float(raw.replace("Infinity", "inf"))
        return int(raw)

    def string(self) -> str:
        quote, out = self.text[self.at], []
        self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == quote:
                return "".join(out)
            if c == "\\":
                c = self.text[self.at : self.at + 1]
                self.at += 1
                if c in "ux" and c:
                    n = 4 if c == "u" else 2
                    try:
                        out.append(chr(int(self.text[self.at : self.at + n], 16)))
                    except ValueError:
                        raise self.fail("bad escape") from None
                    self.at += n
                elif c != "\n":
                    out.append(ESCAPES.get(c, c))
            else:
                out.append(c)
        raise self.fail("string without end")

    def items(self, close: str):
        self.at += 1
        while self.peek() != close:
            if not self.peek():
                raise self.fail(f"{close} is missing")
            yield
            if self.peek() == ",":
                self.at += 1
            elif self.peek() != close:
                raise self.fail(f", or {close} is missing")
        self.at += 1

    def array(self) -> list:
        return [self.value() for _ in self.items("]")]

    def object(self) -> dict:
        out = {}
        for _ in self.items("}"):
            if self.peek() in "\"'":
                key = self.string()
            elif m := NAME.match(self.text, self.at):
                key, self.at = m[0], m.end()
            else:
                raise self.fail("no key")
            if self.peek() != ":":
                raise self.fail(": is missing")
            self.at += 1
            out[key] = self.value()
        return out


def parse(text: str) -> tuple[str, list[dict[str, Any]]]:
    head = HEAD.search(text or "")
    if not head:
        raise PipelineError("not db.<collection>.aggregate([...])")
    reader = _Reader(text, head.end())
    if reader.peek() != "[":
        raise PipelineError("aggregate() takes an array of stages")
    stages = reader.array()
    if not all(isinstance(s, dict) for s in stages):
        raise PipelineError("every stage is an object")
    return head[1], stages


def render(collection: str, stages: list[dict[str, Any]]) -> str:
    return f"db.{collection}.aggregate({json.dumps(stages, ensure_ascii=False, separators=(',', ':'))})"
