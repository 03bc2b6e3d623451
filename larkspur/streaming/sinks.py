"""Streams into collections: every micro-batch is one transaction, and late batches of a restarted query are passed over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from larkspur.sources.store import DEFAULT, Database


def keyed_sink(db: Database, collection: str, merge: bool = False, cf: str = DEFAULT, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: upserts (or merges) each batch. The last batch's number is kept beside the data.

    order is a column by which the last of several rows of a key counts; it isn't stored. Without it a batch with two rows of a key fails.
    """
    mark = f"{collection}__progress"

    def write(batch: DataFrame, number: int) -> None:
        with db.begin() as txn:
            txn.create_collection(mark, cf)
            done = txn.find_one(mark, {"_id": "batch"}, cf)
            if done is not None and done["number"] >= number:
                return
            (txn.merge_many if merge else txn.upsert_many)(collection, batch, cf, order).drain()
            txn.upsert_many(mark, [{"_id": "batch", "number": number}], cf).drain()

    return write
