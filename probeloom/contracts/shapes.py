"""A small grammar of document shapes. Every shape reports all it finds, as (path, message)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

Issue = tuple[str, str]


def is_number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def is_whole(v: object) -> bool:
    return is_number(v) and (isinstance(v, int) or (math.isfinite(v) and v == int(v)))


class Shape:
    def check(self, v: object, path: str) -> Iterator[Issue]:
        raise NotImplementedError


@dataclass(frozen=True)
class Text(Shape):
    least: int = 0
    most: int | None = None
    pattern: str | None = None  # of the whole text

    def check(self, v: object, path: str) -> Iterator[Issue]:
        if not isinstance(v, str):
            yield path, "is not of type text"
            return
        if len(v) < self.least:
            yield path, "is too short"
        if self.most is not None and len(v) > self.most:
            yield path, "is too long"
        if self.pattern is not None and not re.fullmatch(self.pattern, v, re.S):
            yield path, "does not match the required format"


@dataclass(frozen=True)
class Number(Shape):
    low: float | None = None
    high: float | None = None
    above: float | None = None
    whole: bool = False

    def check(self, v: object, path: str) -> Iterator[Issue]:
        if not (is_whole(v) if self.whole else is_number(v)):
            yield path, f"is not of type {'whole number' if self.whole else 'number'}"
            return
        if (self.low is not None and v < self.low) or (self.high is not None and v > self.high) or (self.above is not None and not v > self.above):
            yield path, "lies outside the allowed range"


@dataclass(frozen=True)
class Flag(Shape):
    def check(self, v: object, path: str) -> Iterator[Issue]:
        if not isinstance(v, bool):
            yield path, "is not of type boolean"


@dataclass(frozen=True)
class Choice(Shape):
    values: tuple

    def check(self, v: object, path: str) -> Iterator[Issue]:
        if not any(v == x and type(v) is type(x) for x in self.values):
            yield path, "is not one of the allowed values"


@dataclass(frozen=True)
class Maybe(Shape):
    """Null or the shape."""

    of: Shape

    def check(self, v: object, path: str) -> Iterator[Issue]:
        if v is not None:
            yield from self.of.check(v, path)


@dataclass(frozen=True)
class Items(Shape):
    of: Shape
    least: int = 0
    most: int | None = None
    unique: bool = False

    def check(self, v: object, path: str) -> Iterator[Issue]:
        if not isinstance(v, list):
            yield path, "is not of type array"
            return
        if len(v) < self.least:
            yield path, "is too short"
        if self.most is not None and len(v) > self.most:
            yield path, "is too long"
        if self.unique and len({repr(x) for x in v}) < len(v):
            yield path, "has repeated entries"
        for i, x in enumerate(v):
            yield from self.of.check(x, f"{path}[{i}]")


@dataclass(frozen=True)
class Record(Shape):
    """An object of exactly the named fields."""

    required: dict[str, Shape]
    optional: dict[str, Shape] = field(default_factory=dict)
    one_of: tuple[str, ...] = ()  # exactly one of these optional fields

    def check(self, v: object, path: str) -> Iterator[Issue]:
        if not isinstance(v, dict):
            yield path, "is not of type object"
            return
        for name in self.required:
            if name not in v:
                yield path, f"'{name}' is a required property"
        for name, x in v.items():
            shape = self.required.get(name) or self.optional.get(name)
            if shape is None:
                yield path, f"additional properties are not allowed ('{name}')"
            else:
                yield from shape.check(x, f"{path}.{name}")
        if self.one_of and sum(n in v for n in self.one_of) != 1:
            yield path, f"must hold exactly one of {', '.join(self.one_of)}"


@dataclass(frozen=True)
class Table(Shape):
    """An object of any keys with values of one shape."""

    of: Shape
    least: int = 0
    most: int | None = None
    keys: Shape | None = None

    def check(self, v: object, path: str) -> Iterator[Issue]:
        if not isinstance(v, dict):
            yield path, "is not of type object"
            return
        if len(v) < self.least:
            yield path, "is too short"
        if self.most is not None and len(v) > self.most:
            yield path, "is too long"
        for name, x in v.items():
            if self.keys is not None:
                yield from self.keys.check(name, f"{path}.{name}")
            yield from self.of.check(x, f"{path}.{name}")


@dataclass(frozen=True)
class Json(Shape):
    """Any JSON value."""

    def check(self, v: object, path: str) -> Iterator[Issue]:
        if isinstance(v, dict):
            for k, x in v.items():
                yield from self.check(x, f"{path}.{k}")
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from self.check(x, f"{path}[{i}]")
        elif v is not None and not isinstance(v, (bool, int, float, str)):
            yield path, "is no JSON value"


def non_finite(v: object, path: str = "$") -> Iterator[Issue]:
    """Every number in a value that is not finite."""
    if isinstance(v, float) and not math.isfinite(v):
        yield path, "must be a finite number"
    elif isinstance(v, dict):
        for k, x in v.items():
            yield from non_finite(x, f"{path}.{k}")
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from non_finite(x, f"{path}[{i}]")
