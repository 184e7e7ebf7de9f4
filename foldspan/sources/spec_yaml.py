"""YAML texts of design specs as values: block and flow mappings and sequences, plain and quoted scalars, comments.

What specs use and no more: no anchors, tags, block scalars or several documents; such texts raise ValueError.
"""

from __future__ import annotations

import re
from functools import lru_cache

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#\[\]{},"'&*!|>%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+|$)""")
#: A plain name as key, which _KEY would find too, and more slowly.
_NAME = re.compile(r"([A-Za-z_][A-Za-z0-9_]*):(?:\s+|$)")
_INT, _FLOAT = re.compile(r"[-+]?(0|[1-9][0-9]*)"), re.compile(r"[-+]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))([eE][-+]?[0-9]+)?")
_FLOW_PLAIN = re.compile(r"(?:[^,\[\]{}:]|:(?=[^\s,\]}]))*")
_COMMENT = re.compile(r"(^|\s)#.*$")
_QUOTED = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^']|'')*'""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " "}
_WORDS = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}


def load(text: str):
    """The value of a YAML text; None for one without content."""
    lines = []
    for k, raw in enumerate(text.replace("\r\n", "\n").split("\n"), 1):
        indent, line = _line(raw)
        if line and line != "---":
            lines.append((indent, line, k))
    if not lines:
        return None
    value, at = _block(lines, 0, lines[0][0])
    if at < len(lines):
        raise ValueError(f"line {lines[at][2]}: unexpected indentation")
    return value


# Specs share most of their lines, so what a line says is kept for the next one like it.
@lru_cache(maxsize=8192)
def _line(raw: str) -> tuple[int, str]:
    """Indentation and text of a line without its comment."""
    bare = _bare(raw)
    return len(bare) - len(bare.lstrip(" ")), bare.strip()


def _bare(line: str) -> str:
    """A line without its comment; a sign inside quotes is none."""
    if "\t" in line and "\t" in line[: len(line) - len(line.lstrip())]:
        raise ValueError("tabs cannot indent")
    if "#" not in line:
        return line.rstrip()
    hidden = _QUOTED.sub(lambda m: "x" * len(m[0]), line)
    found = _COMMENT.search(hidden)
    return (line[: found.start()] if found else line).rstrip()


@lru_cache(maxsize=8192)
def _key(text: str):
    """The key that begins a line, and the text after it; None if there is no key."""
    found = _NAME.match(text) or _KEY.match(text)
    return found and (found[1], text[found.end() :])


def _block(lines: list, at: int, indent: int):
    """The block that begins at a line, and the line after it."""
    if lines[at][1] == "-" or lines[at][1].startswith("- "):
        return _sequence(lines, at, indent)
    if _key(lines[at][1]):
        return _mapping(lines, at, indent)
    text, k = lines[at][1], at + 1
    while k < len(lines) and (lines[k][0] > indent or _open(text)):  # a flow value or scalar over several lines
        text, k = f"{text} {lines[k][1]}", k + 1
    return scalar(text), k


def _sequence(lines: list, at: int, indent: int):
    out = []
    while at < len(lines) and lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1].startswith("- ")):
        rest = lines[at][1][1:].lstrip()
        if rest:
            inner = indent + len(lines[at][1]) - len(rest)
            lines[at] = (inner, rest, lines[at][2])
            value, at = _block(lines, at, inner)
        elif at + 1 < len(lines) and lines[at + 1][0] > indent:
            value, at = _block(lines, at + 1, lines[at + 1][0])
        else:
            value, at = None, at + 1
        out.append(value)
    return out, at


def _mapping(lines: list, at: int, indent: int):
    out = {}
    while at < len(lines) and lines[at][0] == indent:
        found = _key(lines[at][1])
        if not found:
            raise ValueError(f"line {lines[at][2]}: a key is expected")
        key, rest = scalar(found[0]), found[1]
        if key in out:
            raise ValueError(f"line {lines[at][2]}: {key!r} is repeated")
        below = lines[at + 1] if at + 1 < len(lines) else (-1, "", 0)
        if rest:
            at += 1
            while at < len(lines) and (lines[at][0] > indent or _open(rest)):
                if not _open(rest) and _key(lines[at][1]):
                    raise ValueError(f"line {lines[at][2]}: a value and a mapping under one key")
                rest, at = f"{rest} {lines[at][1]}", at + 1
            value = scalar(rest)
        elif below[0] > indent or below[0] == indent and below[1].startswith("-"):
            value, at = _block(lines, at + 1, below[0])
        else:
            value, at = None, at + 1
        out[key] = value
    return out, at


def _open(text: str) -> bool:
    """Whether brackets of a flow value are still open."""
    if text[:1] not in ("[", "{", ""):
        return False
    plain = _QUOTED.sub("", text)
    return plain.count("[") + plain.count("{") > plain.count("]") + plain.count("}")


def scalar(text: str):
    """The value of a scalar or flow text."""
    if text[:1] in ("[", "{"):
        value, at = _flow(text, 0)
        if text[at:].strip():
            raise ValueError(f"text after {text[:at]!r}")
        return value
    if text[:1] in ("&", "*", "!", "|", ">", "%", "@", "`"):
        raise ValueError(f"{text[:1]!r} is not read here")
    if text[:1] in ("'", '"'):
        found = _QUOTED.match(text)
        if not found or found.end() < len(text):
            raise ValueError(f"a quote is not closed: {text!r}")
        return _unquoted(text)
    return _plain(text)


def _unquoted(text: str) -> str:
    if text[0] == "'":
        return text[1:-1].replace("''", "'")
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "ux" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text[1:-1])


def _plain(text: str):
    if text in _WORDS:
        return _WORDS[text]
    if text[0] not in "+-.0123456789":
        return text
    if _INT.fullmatch(text):
        return int(text)
    if _FLOAT.fullmatch(text):
        return float(text)
    return text


def _flow(text: str, at: int):
    """The flow value that begins at a place, and the place after it."""
    at = _skip(text, at)
    if at >= len(text):
        raise ValueError("a flow value is not closed")
    if text[at] in "[{":
        pairs, close, out, at = text[at] == "{", "}" if text[at] == "{" else "]", [], _skip(text, at + 1)
        while text[at : at + 1] != close:
            value, at = _flow(text, at)
            if pairs:
                at = _skip(text, at)
                inner = None
                if text[at : at + 1] == ":":
                    inner, at = _flow(text, at + 1) if text[_skip(text, at + 1) : _skip(text, at + 1) + 1] not in (",", "}") else (None, at + 1)
                value = (value, inner)
            out.append(value)
            at = _skip(text, at)
            if text[at : at + 1] == ",":
                at = _skip(text, at + 1)
            elif text[at : at + 1] != close:
                raise ValueError("a flow value is not closed")
        return dict(out) if pairs else out, at + 1
    if text[at] in "'\"":
        found = _QUOTED.match(text, at)
        if not found:
            raise ValueError("a quote is not closed")
        return _unquoted(found[0]), found.end()
    found = _FLOW_PLAIN.match(text, at)
    return _plain(found[0].strip()), found.end()


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at] == " ":
        at += 1
    return at
