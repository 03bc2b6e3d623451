"""Hooks: validators and triggers as Python callables over the documents a statement touches.

A validator gets a document and returns True, or False or a reason to reject it. A trigger gets a context and an event
{"action": ..., "doc": ...}; the context reads and writes documents of the same namespace within the transaction, without
validators and triggers. Triggers run on the driver over the affected rows, which are streamed to it, since they write; validators
only look at a document, and run on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.errors import HookError

Validator = Callable[[dict[str, Any]], bool | str | None]
Trigger = Callable[["Context", dict[str, Any]], Any]


@dataclass
class Hooks:
    """A collection's hooks, by name; they run in the order of their names."""

    validators: dict[str, Validator] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return bool(self.validators or self.triggers)

    def copy(self) -> Hooks:
        return Hooks(dict(self.validators), dict(self.triggers))


class Context:
    """What a trigger can do: get, put and delete documents by primary key, seeing its own writes."""

    def __init__(self, read: Callable[[str, Any], dict[str, Any] | None]) -> None:
        self._read = read
        self.pending: dict[str, dict[Any, dict[str, Any] | None]] = {}

    def get(self, collection: str, key: Any) -> dict[str, Any] | None:
        mine = self.pending.get(collection, {})
        return mine[key] if key in mine else self._read(collection, key)

    def put(self, collection: str, doc: Mapping[str, Any], pk: str = "_id") -> None:
        self.pending.setdefault(collection, {})[doc[pk]] = dict(doc)

    def delete(self, collection: str, key: Any) -> None:
        self.pending.setdefault(collection, {})[key] = None


def rows_of(df: DataFrame) -> Iterable[dict[str, Any]]:
    for row in df.toLocalIterator():
        yield row.asDict(recursive=True)


def _rejection(validators: list[tuple[str, Validator]], doc: dict[str, Any]) -> str | None:
    for name, check in validators:
        try:
            said = check(doc)
        except Exception as e:  # noqa: BLE001
            return f"validator {name} failed: {e}"
        if said is False or isinstance(said, str):
            return f"validator {name} rejects a document" + (f": {said}" if isinstance(said, str) else "")
    return None


def validate(hooks: Hooks, docs: DataFrame) -> None:
    """Raise HookError for a document of docs that a validator rejects; only one rejection comes to the driver."""
    validators = sorted(hooks.validators.items())
    if any(t in kind for _, kind in docs.dtypes for t in ("variant", "map<", "void")):
        found = next((r for r in (_rejection(validators, doc) for doc in rows_of(docs)) if r), None)
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                said = next((r for r in (_rejection(validators, doc) for doc in batch.to_pylist()) if r), None)
                if said:
                    yield pa.record_batch([pa.array([said])], names=["said"])
                    return

        first = docs.mapInArrow(run, "said string").first()
        found = first["said"] if first else None
    if found:
        raise HookError(found)


def fire(hooks: Hooks, context: Context, action: str, docs: Iterable[dict[str, Any]]) -> None:
    for doc in docs:
        for name, trigger in sorted(hooks.triggers.items()):
            try:
                trigger(context, {"action": action, "doc": doc})
            except HookError:
                raise
            except Exception as e:
                raise HookError(f"trigger {name} failed: {e}") from e
