"""Splitting texts by a tokenizer's pattern, fast where a text is Latin-1."""

from __future__ import annotations

import re
from collections.abc import Iterator

import regex

_CLASS = re.compile(r"\\p\{\w+\}|\\[sSdDwW]|\\.|\[\^?|\]|.", re.S)
_LATIN = [chr(i) for i in range(256)]


def _listed(name: str) -> str:
    """The Latin-1 characters of a class, as the inside of a character class."""
    return "".join(f"\\x{ord(c):02x}" for c in _LATIN if regex.match(name, c)) or "\\x00-\\xff"


def latin_pattern(pattern: str) -> re.Pattern[str]:
    """The same pattern for texts of Latin-1 characters, with its classes spelt out, in the standard library's engine."""
    out, inside = [], False
    for part in _CLASS.findall(pattern):
        if part.startswith("["):
            inside = True
            out.append(part)
        elif part == "]":
            inside = False
            out.append(part)
        elif part.startswith("\\p") or part in ("\\s", "\\S", "\\d", "\\w"):
            out.append(_listed(part) if inside else f"[{_listed(part)}]")
        else:
            out.append(part)
    return re.compile("".join(out))


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Splitter:
    """findall() of a pattern, in slices of bounded length for long texts."""

    def __init__(self, pattern: str, most: int = 1 << 18):
        self.plain, self.latin, self.most = regex.compile(pattern), latin_pattern(pattern), most

    def slices(self, text: str) -> Iterator[list[str]]:
        """The matches in order, in lists."""
        engine = self.latin if text.isascii() or is_latin(text) else self.plain
        if len(text) <= self.most:
            yield engine.findall(text)
            return
        held: list[str] = []
        for m in engine.finditer(text):
            held.append(m[0])
            if len(held) == self.most // 8:
                yield held
                held = []
        yield held


class Memory:
    """Ids of words seen before. Two generations of `most` words each: words in use move on to the young one."""

    def __init__(self, learn, most: int):
        self.learn, self.most = learn, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> bytes:
        """The ids of the words one after another; learn(words) gives those of words not known."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        parts = [*map(young.get, words)]
        if None in parts:
            holes = [i for i, p in enumerate(parts) if p is None]
            fresh = []
            for w in {words[i] for i in holes}:
                if (p := old.get(w)) is None:
                    fresh.append(w)
                else:
                    young[w] = p
            if fresh:
                young.update(zip(fresh, self.learn(fresh)))
            for i in holes:
                parts[i] = young[words[i]]
        return b"".join(parts)
