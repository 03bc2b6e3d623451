"""The filter language: nested dictionaries to an expression tree.

A filter is a dictionary of conditions that must all hold. `$and` and `$or` take lists of filters. A field's condition is a
literal (equality) or a dictionary of operators: $eq, $gt, $gte, $lt, $lte, $exists, and $regex with $options.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

from larkspur.errors import InvalidQuery


@dataclass(frozen=True)
class ObjectId:
    """A 12-byte identifier, written as 24 hexadecimal digits."""

    hex: str

    def __post_init__(self) -> None:
        if not re.fullmatch("[0-9a-f]{24}", self.hex):
            raise InvalidQuery(f"not an object id: {self.hex!r}")


@dataclass(frozen=True)
class All:
    """Every part holds; without parts, always."""

    parts: tuple[Any, ...]


@dataclass(frozen=True)
class Any_:
    """Some part holds."""

    parts: tuple[Any, ...]


@dataclass(frozen=True)
class Compare:
    """The value at path stands in the relation op (eq, gt, gte, lt, lte) to a literal."""

    op: str
    path: str
    value: Any


@dataclass(frozen=True)
class Matches:
    """The string at path has a match of pattern; flags are among i, s, m, x."""

    path: str
    pattern: str
    flags: str = ""


@dataclass(frozen=True)
class Exists:
    """Whether there is something at path."""

    path: str
    there: bool


Expression = All | Any_ | Compare | Matches | Exists

_COMPARISONS = ("eq", "gt", "gte", "lt", "lte")
_GROUPS = {"$and": All, "$or": Any_}
_LITERALS = (type(None), bool, int, float, str, dt.datetime, ObjectId)


def literal(value: Any) -> Any:
    """value, if it can stand in a filter."""
    if isinstance(value, Mapping):
        return {str(k): literal(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [literal(v) for v in value]
    if not isinstance(value, _LITERALS):
        raise InvalidQuery(f"a filter can't hold a {type(value).__name__}")
    if isinstance(value, int) and not isinstance(value, bool) and not -(1 << 63) <= value < 1 << 63:
        raise InvalidQuery(f"{value} needs more than 64 bits")
    return value


def parse_filter(said: Mapping[str, Any] | None, required: bool = False) -> Expression:
    """The expression of a filter; nothing said holds always, unless a filter is required."""
    if said is not None and not isinstance(said, Mapping):
        raise InvalidQuery("a filter is a dictionary")
    if not said:
        if required:
            raise InvalidQuery("the filter is empty")
        return All(())
    parts = [part for key, value in said.items() for part in _entry(key, value)]
    return parts[0] if len(parts) == 1 else All(tuple(parts))


def _entry(key: str, value: Any) -> Iterator[Expression]:
    if key in _GROUPS:
        if not isinstance(value, (list, tuple)) or not value:
            raise InvalidQuery(f"{key} takes a list with at least one filter")
        if not all(isinstance(x, Mapping) for x in value):
            raise InvalidQuery(f"{key} takes filters only")
        yield _GROUPS[key](tuple(parse_filter(x, required=True) for x in value))
    elif key.startswith("$"):
        raise InvalidQuery(f"no operator {key} at this place")
    elif isinstance(value, Mapping) and str(next(iter(value), "")).startswith("$"):
        yield _operators(key, value)
    else:
        yield Compare("eq", key, literal(value))


def _operators(path: str, said: Mapping[str, Any]) -> Expression:
    if "$regex" in said:
        return _regex(path, said)
    parts: list[Expression] = []
    for key, value in said.items():
        if key == "$exists":
            if not isinstance(value, bool):
                raise InvalidQuery("$exists takes true or false")
            parts.append(Exists(path, value))
        elif key == "$options":
            raise InvalidQuery("$options needs $regex beside it")
        elif key[:1] == "$" and key[1:] in _COMPARISONS:
            parts.append(Compare(key[1:], path, literal(value)))
        else:
            raise InvalidQuery(f"no operator {key} for a field")
    return parts[0] if len(parts) == 1 else All(tuple(parts))


def _regex(path: str, said: Mapping[str, Any]) -> Matches:
    if other := [k for k in said if k not in ("$regex", "$options")]:
        raise InvalidQuery(f"{other[0]} can't stand beside $regex")
    if not all(isinstance(v, str) for v in said.values()):
        raise InvalidQuery("$regex and $options take strings")
    pattern, flags = said["$regex"], said.get("$options", "")
    if strange := set(flags) - set("ismx"):
        raise InvalidQuery(f"no regex option {min(strange)}")
    java_pattern(pattern, flags)
    return Matches(path, pattern, flags)


def java_pattern(pattern: str, flags: str = "") -> str:
    """The pattern as Java reads it the way that linear-time engines do.

    Case and classes are Unicode's, only a line feed ends a line, and $ without the m flag is the very end. Look-around
    and back-references aren't regular and are refused.
    """
    if re.search(r"\(\?(<?[=!])|\\[1-9]|\\k<", re.sub(r"\\\\", "", pattern)):
        raise InvalidQuery("look-around and back-references aren't supported")
    try:
        re.compile(re.sub(r"\\[pP]\{?\w+\}?|\\[zZ]", "x", pattern.replace("(?P<", "(?P<g")) if "\\p" in pattern else pattern.replace(r"\z", r"\Z"))
    except re.error as e:
        raise InvalidQuery(f"not a regular expression: {e}") from e
    out, inside, escaped = [], False, False
    for c in pattern:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "$" and "m" not in flags:
            out.append(r"\z")
            continue
        out.append(c)
    return f"(?dU{'u' if 'i' in flags else ''}{flags})" + "".join(out).replace("(?P<", "(?<")
