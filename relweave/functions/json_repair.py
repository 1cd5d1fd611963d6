"""Reading JSON that is nearly right.

A strict parse is tried first. Where it fails, a forgiving recursive parser reads the text as a person would: it takes comments,
single or curly quotes, bare keys and values, missing and spare commas, Python literals, raw line breaks and unescaped quotes inside strings,
ellipses, and brackets that are missing or of the wrong kind. JSON inside strings is unwrapped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from textwrap import dedent
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```[ \t]*([\w-]*)[^\n]*\n(.*?)```", re.S)
_THINK = re.compile(r"<think\b[^>]*>.*?(?:</think\s*>|\Z)", re.S | re.I)
_QUOTES = {'"': '"', "'": "'", "“": "”", "”": "”", "‘": "’", "`": "`", "«": "»"}
_WORDS = {"true": True, "false": False, "null": None, "none": None, "undefined": None, "nan": None}
_SKIP = re.compile(r"(?:\s|//[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_NUMBER = re.compile(r"[-+]?(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\Z")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "/": "/", "\\": "\\", '"': '"', "'": "'"}
_GONE = object()  # an ellipsis


class _Reader:
    def __init__(self, text: str, at: int = 0) -> None:
        self.text, self.at, self.open = text, at, []

    def skip(self) -> str:
        """Past white space and comments; the next character, empty at the end."""
        if m := _SKIP.match(self.text, self.at):
            self.at = m.end()
        return self.text[self.at : self.at + 1]

    def value(self, stop: str) -> Any:
        c = self.skip()
        if c == "{":
            return self.group("}", self.member, {})
        if c in ("[", "("):
            return self.group("]" if c == "[" else ")", self.element, [])
        if self.text.startswith(("...", "…"), self.at):
            self.at += 3 if c == "." else 1
            return _GONE
        if c == "\\" and self.text[self.at + 1 : self.at + 2] in _QUOTES:
            self.at += 1
            c = self.text[self.at]
        return self.string() if c in _QUOTES else self.bare(stop)

    def group(self, close: str, part: Any, into: Any) -> Any:
        self.at += 1
        self.open.append(close)
        while c := self.skip():
            if c in ",;":
                self.at += 1
            elif c in "}])":
                if c == close or c not in self.open:
                    self.at += 1
                if c == close or c in self.open:  # another group's end also ends this one, which was left open
                    break
            else:
                before = self.at
                part(into)
                self.at = max(self.at, before + (self.at == before))
        self.open.pop()
        return into

    def element(self, into: list) -> None:
        if (v := self.value(",]})")) is not _GONE:
            into.append(v)

    def member(self, into: dict) -> None:
        if self.text.startswith(("...", "…"), self.at):
            self.value(",}")
            return
        c = self.text[self.at]
        if c == "\\" and self.text[self.at + 1 : self.at + 2] in _QUOTES:
            self.at += 1
            c = self.text[self.at]
        quoted = c in _QUOTES
        key = self.string() if quoted else self.key()
        if self.skip() in (":", "="):
            self.at += 1 + (self.text[self.at : self.at + 2] == "=>")
            v = None if self.skip() in (",", "}", "") else self.value(",}])\n")
            if key and v is not _GONE:
                into[key] = v
        # a string without a value is stray

    def key(self) -> str:
        m = re.compile(r"[^:=,{}\[\]\n\"']*").match(self.text, self.at)
        self.at = m.end()
        return m.group().strip()

    def bare(self, stop: str) -> Any:
        begin = self.at
        while self.at < len(self.text) and self.text[self.at] not in stop and not self.text.startswith(("//", "/*"), self.at):
            if self.text[self.at] in _QUOTES and ((word := self.text[begin : self.at].strip()).lower() in _WORDS or _NUMBER.match(word)):
                break  # the comma after a number or literal is missing
            self.at += 1
        word = self.text[begin : self.at].strip()
        if word.lower() in _WORDS:
            return _WORDS[word.lower()]
        if _NUMBER.match(word):
            plain = word.replace("_", "")
            return float(plain) if re.search(r"[.eE]", plain) else int(plain)
        return word

    def ends(self, at: int, close: str) -> bool:
        """Whether a quote just before ``at`` closes its string, by what follows."""
        rest = _SKIP.match(self.text, at)
        after = rest.end() if rest else at
        c = self.text[after : after + 1]
        if c == "" or c in ",:}])=;":
            return True
        if "\n" in self.text[at:after]:
            return c in _QUOTES or c in "{[" or bool(re.match(r"[\w$-]+\s*:", self.text[after:]))
        if c in _QUOTES:  # a comma is missing, if what follows is a key or an element
            far = self.text.find(_QUOTES[c], after + 1)
            return far > 0 and bool(re.match(r"\s*[:,\]}]", self.text[far + 1 :]))
        return False

    def string(self) -> str:
        close = _QUOTES[self.text[self.at]]
        self.at += 1
        out: list[str] = []
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\":
                n = self.text[self.at + 1 : self.at + 2]
                if n == close and self.ends(self.at + 2, close) and not self.later(close):
                    self.at += 2
                    break
                if n == "u" and re.match(r"[0-9a-fA-F]{4}", self.text[self.at + 2 :]):
                    out.append(chr(int(self.text[self.at + 2 : self.at + 6], 16)))
                    self.at += 6
                    continue
                out.append(_ESCAPES.get(n, c + n))
                self.at += 2
                continue
            self.at += 1
            if c == close and self.ends(self.at, close):
                break
            out.append(c)
        text = "".join(out)
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if any("\ud800" <= c <= "\udfff" for c in text) else text

    def later(self, close: str) -> bool:
        """Whether the string has an end further on in its line."""
        line = self.text[self.at + 2 :].split("\n", 1)[0]
        return any(x == close and line[i - 1 : i] != "\\" for i, x in enumerate(line))


def _unwrap(value: Any, depth: int = 8) -> Any:
    if isinstance(value, dict):
        return {k: _unwrap(v, depth) for k, v in value.items()}
    if isinstance(value, list):
        return [_unwrap(v, depth) for v in value]
    if isinstance(value, str) and depth and (s := value.strip()) and (s[0] + s[-1]) in ("{}", "[]"):
        try:
            return _unwrap(json.loads(s), depth - 1)
        except ValueError:
            return value
    return value


def _strict(text: str) -> Any:
    """The value of right JSON; strings that hold JSON are opened."""
    for _ in range(6):
        value = json.loads(text)
        if not isinstance(value, str):
            return value
        text = value
    return value


def _candidates(raw: str) -> Iterator[str]:
    text = dedent(raw).strip().lstrip("﻿")
    fences = [(m.group(1).lower(), m.group(2).strip()) for m in _FENCE.finditer(text)]
    yield from (body for tag, body in sorted(fences, key=lambda f: f[0] not in ("json", "json5", "jsonc")) if "{" in body or "[" in body)
    yield (_THINK.sub("", text) or text).strip()


def repair(raw: str) -> Any:
    """The value that a text holds; `ValueError` if there is no object or list in it."""
    for text in _candidates(raw):
        try:
            value = _strict(text)
            if isinstance(value, (dict, list)):
                return _unwrap(value)
        except ValueError:
            pass
        for _ in range(4):
            found = _blocks(text)
            if found is not None:
                return _unwrap(found)
            if "\\" not in text:
                break
            text = text.strip().strip("\"'").replace('\\\\', "\\").replace('\\"', '"').replace("\\n", "\n").replace("\\t", "\t")
    raise ValueError("no JSON object or list found")


def _blocks(text: str) -> Any:
    """The first block that reads as something, else the first that is empty."""
    if re.search(r'[{\[,]\s*(?:\\n|\\t)*\s*\\+"', text) and not re.search(r'[{\[,]\s*"', text):
        return None  # the whole text is escaped
    empty = None
    at = 0
    while m := re.compile(r"[{\[]").search(text, at):
        reader = _Reader(text, m.start())
        try:
            value, end = json.JSONDecoder().raw_decode(text, m.start())
        except ValueError:
            value = reader.value("")
            end = reader.at
        likely = value and (isinstance(value, dict) or any(not isinstance(v, str) or '"' in text[m.start() : end] or "'" in text[m.start() : end] for v in value))
        if likely:
            return value
        if empty is None and value in ({}, []):
            empty = value
        at = max(end, m.start() + 1) if not value else m.start() + 1
    return empty


def repair_text(raw: str) -> str:
    return json.dumps(repair(raw), ensure_ascii=False, indent=2)


@F.pandas_udf(T.StringType())
def repaired(texts: pd.Series) -> pd.Series:
    """Right, compact JSON of a column of texts; null where there is none."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return json.dumps(repair(t), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return texts.map(one)
