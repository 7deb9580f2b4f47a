"""JSON of any depth and any number of quotations, read and written without recursion."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_NAMES = {"null": None, "true": True, "false": False, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
_START = "﻿ \t\r\n"


def _deep(text: str, number: Callable[[str], object] | None) -> object:
    """Read JSON with a stack of its own; raises ``ValueError`` as ``json.loads`` does."""
    stack: list[tuple[object, str | None]] = []  # open containers with the key they stand under
    at = 0
    holder: object = None  # the innermost open container
    key: str | None = None

    def skip(i: int) -> int:
        return _SPACE.match(text, i).end()

    def name_of_member(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError("a member has no name")
        name, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("a member has no value")
        return name, skip(i + 1)

    at = skip(at)
    while True:
        # a value begins here
        c = text[at : at + 1]
        opened = None
        if c == "{" or c == "[":
            opened = {} if c == "{" else []
            at = skip(at + 1)
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                value, at, opened = opened, at + 1, None
            else:
                stack.append((holder, key))
                holder, key = opened, None
                if c == "{":
                    key, at = name_of_member(at)
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            named = next((n for n in _NAMES if text.startswith(n, at)), None)
            if named is not None:
                value, at = _NAMES[named], at + len(named)
            else:
                found = _NUMBER.match(text, at)
                if not found:
                    raise ValueError("a value is missing")
                whole, at = found.group(), found.end()
                value = number(whole) if number else float(whole) if found.group(2) or found.group(3) else int(whole)
        # a value ended here; close what it ends
        while True:
            at = skip(at)
            if holder is None:
                if at != len(text):
                    raise ValueError("something follows the value")
                return value
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if isinstance(holder, dict):
                    key, at = name_of_member(at)
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError("a container is not closed")
            at += 1
            value = holder
            holder, key = stack.pop()


def loads(text: str, number: Callable[[str], object] | None = None) -> object:
    """The value of a JSON text, however deep; ``number`` is given the text of every number.

    Raises ``ValueError`` where the text is not complete JSON.
    """
    try:
        return json.loads(text, parse_float=number, parse_int=number)
    except RecursionError:
        return _deep(text, number)


def loads_quoted(text: str | None, number: Callable[[str], object] | None = None) -> object:
    """:func:`loads` past byte order marks, again for as long as the value is a text; None for what is not complete JSON."""
    value: object = text or None
    try:
        while type(value) is str:
            value = loads(value.lstrip(_START), number)
    except ValueError:
        return None
    return value


def dumps(value: object) -> str:
    """JSON text of a value without spaces, however deep."""
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]
    while todo:
        done, item = todo.pop()
        if done:
            out.append(item)
        elif isinstance(item, dict):
            todo.append((True, "}"))
            for n, (k, v) in reversed(list(enumerate(item.items()))):
                todo += [(False, v), (True, ("," if n else "") + json.dumps(k, ensure_ascii=False) + ":")]
            out.append("{")
        elif isinstance(item, list):
            todo.append((True, "]"))
            for n, v in reversed(list(enumerate(item))):
                todo.append((False, v))
                if n:
                    todo.append((True, ","))
            out.append("[")
        else:
            out.append(json.dumps(item, ensure_ascii=False))
    return "".join(out)
