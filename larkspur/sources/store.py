"""A document database over Parquet snapshots: catalog, transactions, hooks, expiry, backup.

Every commit is a manifest, a numbered JSON file that names each collection's files. A transaction reads the manifest it began
with. An insert adds files; other statements write only those files anew that hold a document they touch, which the scan of
the matches tells. Commit creates the next manifest; if another writer was faster, it is put on top of theirs if they
changed none of its collections, and fails otherwise. So commits are atomic over collections, and readers never see a part of one.
"""

from __future__ import annotations

import copy
import datetime as dt
import json
import threading
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import CollectionNotFound, DuplicateKey, FunctionExists, IndexExists, InvalidKey, ReadOnly, StoreError
from larkspur.functions.compile import quoted
from larkspur.functions.filters import parse_filter
from larkspur.operators import find as R
from larkspur.operators import mutate as M
from larkspur.operators.hooks import Context, Hooks, Trigger, Validator, fire, rows_of, validate
from larkspur.session import ensure_checkpoint_dir
from larkspur.sources.files import Folder
from larkspur.sources.ttl import expired, visible

DEFAULT = "default_cf"
Documents = Mapping[str, Any] | str | Sequence[Mapping[str, Any] | str] | DataFrame
#: Commits that are put on top of others' before one gives up.
TURNS = 20
_FILE = "__file"


class Cursor:
    """A prepared statement; nothing runs until iter(), drain() or docs()."""

    def __init__(self, run: Callable[[], tuple[DataFrame, int | None]]) -> None:
        self._run, self._done = run, None

    def _result(self) -> tuple[DataFrame, int | None]:
        if self._done is None:
            self._done = self._run()
        return self._done

    def docs(self) -> DataFrame:
        """The documents found, or affected by the write."""
        return self._result()[0]

    def iter(self) -> Iterator[dict[str, Any]]:
        return iter(rows_of(self.docs()))

    def drain(self) -> int:
        """How many documents were found, or matched by the write."""
        rows, n = self._result()
        return rows.count() if n is None else n


class Database:
    """A store below a root path. clock gives the time that expiry is measured by; sweep_seconds purges in the background.

    Without a root the store lives in the checkpoint folder until shutdown(). The statements of a transaction can be called on the
    database too: each is then a transaction of its own.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, clock: Callable[[], dt.datetime] | None = None, sweep_seconds: float | None = None, scripting: bool = True) -> None:
        self.passing = root is None
        if root is None:
            ensure_checkpoint_dir(spark)
            root = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/store-{uuid.uuid4().hex}"
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(spark, self.root)
        self.clock = clock or (lambda: dt.datetime.now(dt.timezone.utc))
        self.scripting = scripting
        self.hooks: dict[str, Hooks] = {}
        self._stop = threading.Event()
        if sweep_seconds is not None:
            threading.Thread(target=self._sweep, args=(sweep_seconds,), daemon=True).start()

    def _versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.folder.names("manifests") if n.startswith("m") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, Any]]:
        versions = self._versions()
        if version is None:
            version = versions[-1] if versions else 0
        return version, json.loads(self.folder.read(f"manifests/m{version:010d}.json")) if version else {"collections": {}}

    def begin(self, read_only: bool = False) -> Transaction:
        return Transaction(self, read_only)

    def list_collections(self) -> list[tuple[str, str]]:
        return self.begin(True).list_collections()

    def purge_expired(self, cf: str = DEFAULT, collection: str | None = None) -> int:
        txn = self.begin()
        n = sum(txn.purge_expired(f, c) for f, c in txn.list_collections() if collection is None or (f, c) == (cf, collection))
        txn.commit()
        return n

    def backup(self, root: str) -> None:
        """Copy the latest snapshot and its manifest; opening root restores it."""
        version, manifest = self.manifest()
        other = Folder(self.spark, root)
        if other.names("manifests"):
            raise StoreError(f"{root} has a store already")
        for meta in manifest["collections"].values():
            for name in meta["files"]:
                self.folder.copy_to(name, other)
        if version:
            other.create(f"manifests/m{version:010d}.json", json.dumps(manifest))

    def vacuum(self) -> None:
        """Delete the folders and manifests that only past snapshots need; running readers of those fail."""
        version, manifest = self.manifest()
        kept = {f for m in manifest["collections"].values() for f in m["files"]}
        folders = {f.rsplit("/", 1)[0] for f in kept}
        for cf in self.folder.names("data"):
            for name in self.folder.names(f"data/{cf}"):
                here = f"data/{cf}/{name}"
                if here not in folders:
                    self.folder.delete(here)
                    continue
                for file in self.folder.names(here):
                    if file.endswith(".parquet") and f"{here}/{file}" not in kept:
                        self.folder.delete(f"{here}/{file}")
        for v in self._versions():
            if v != version:
                self.folder.delete(f"manifests/m{v:010d}.json")

    def _sweep(self, seconds: float) -> None:
        while not self._stop.wait(seconds):
            for cf, name in self.list_collections():
                try:
                    self.purge_expired(cf, name)
                except Exception:  # noqa: BLE001, S112  the next turn tries again
                    continue

    def shutdown(self) -> None:
        self._stop.set()
        if self.passing:
            self.folder.delete("")

    def _alone(self, statement: str, *args: Any, **options: Any) -> Any:
        """One statement as a transaction: what a read finds, or how many documents a write met."""
        writes = statement not in ("find_one", "count", "distinct")
        with self.begin(not writes) as txn:
            done = getattr(txn, statement)(*args, **options)
            return done.drain() if isinstance(done, Cursor) else done

    def find(self, name: str, *args: Any, **options: Any) -> DataFrame:
        return self.begin(True).find(name, *args, **options).docs()


for _statement in (
    "find_one count distinct insert_one insert_many update_one update_many replace_one delete_one delete_many upsert_many merge_many delete_range "
    "create_collection drop_collection create_index drop_index register_validator register_trigger register_udf drop_validator drop_trigger drop_udf"
).split():
    setattr(Database, _statement, lambda self, *args, _statement=_statement, **options: self._alone(_statement, *args, **options))


class Transaction:
    """A pinned snapshot with this transaction's own writes over it."""

    def __init__(self, db: Database, read_only: bool) -> None:
        self.db, self.read_only = db, read_only
        self.version, self.meta = db.manifest()
        self.began = copy.deepcopy(self.meta)
        self.now = db.clock()
        self.hooks = {k: h.copy() for k, h in db.hooks.items()}
        self.fresh_hooks: dict[str, Hooks] = {k: h.copy() for k, h in db.hooks.items()}
        self.written: list[str] = []
        self.dirty = self.closed = False

    # catalog

    def _entry(self, cf: str, name: str) -> dict[str, Any]:
        found = self.meta["collections"].get(f"{cf}/{name}")
        if found is None:
            raise CollectionNotFound(f"{cf}/{name}")
        return found

    def _writes(self) -> None:
        if self.closed:
            raise StoreError("the transaction is over")
        if self.read_only:
            raise ReadOnly("the transaction is read-only")

    def create_collection(self, name: str, cf: str = DEFAULT, pk: str = "_id", ttl: str = "ttl") -> None:
        """Idempotent. The primary key is a top-level field; the expiry path may be dotted and has an index hint."""
        self._writes()
        if "." in pk:
            raise InvalidKey("the primary key is a top-level field")
        if f"{cf}/{name}" not in self.meta["collections"]:
            self.meta["collections"][f"{cf}/{name}"] = {"pk": pk, "ttl": ttl, "indexes": [ttl], "functions": {}, "files": [], "schema": None}
            self.dirty = True

    def drop_collection(self, name: str, cf: str = DEFAULT) -> None:
        self._writes()
        if self.meta["collections"].pop(f"{cf}/{name}", None) is not None:
            self.fresh_hooks.pop(f"{cf}/{name}", None)
            self.dirty = True

    def list_collections(self) -> list[tuple[str, str]]:
        return sorted(tuple(k.split("/", 1)) for k in self.meta["collections"])

    def create_index(self, name: str, path: str, cf: str = DEFAULT) -> None:
        """A hint: the next write sorts files by the field, whose statistics then prune reads. Results never change."""
        self._writes()
        entry = self._entry(cf, name)
        if path in entry["indexes"]:
            raise IndexExists(path)
        entry["indexes"] = sorted([*entry["indexes"], path])
        self.dirty = True

    def drop_index(self, name: str, path: str, cf: str = DEFAULT) -> None:
        self._writes()
        entry = self._entry(cf, name)
        entry["indexes"] = [x for x in entry["indexes"] if x != path]
        self.dirty = True

    def list_indexes(self, name: str, cf: str = DEFAULT) -> list[str]:
        return sorted(self._entry(cf, name)["indexes"])

    # hooks

    def _register(self, kind: str, name: str, collection: str, cf: str, f: Callable) -> None:
        self._writes()
        entry = self._entry(cf, collection)
        if name in entry["functions"]:
            raise FunctionExists(name)
        entry["functions"][name] = kind
        hooks = self.fresh_hooks.setdefault(f"{cf}/{collection}", Hooks())
        if kind != "udf":
            getattr(hooks, f"{kind}s")[name] = f
        self.dirty = True

    def _unregister(self, kind: str, name: str, collection: str, cf: str) -> None:
        self._writes()
        entry = self._entry(cf, collection)
        if entry["functions"].get(name) == kind:
            del entry["functions"][name]
            if kind != "udf":
                getattr(self.fresh_hooks.get(f"{cf}/{collection}", Hooks()), f"{kind}s").pop(name, None)
            self.dirty = True

    def register_validator(self, name: str, collection: str, check: Validator, cf: str = DEFAULT) -> None:
        """Counts for transactions that begin after this one's commit, like all hooks."""
        self._register("validator", name, collection, cf, check)

    def register_trigger(self, name: str, collection: str, trigger: Trigger, cf: str = DEFAULT) -> None:
        self._register("trigger", name, collection, cf, trigger)

    def register_udf(self, name: str, collection: str, f: Callable, cf: str = DEFAULT) -> None:
        """Recorded in the catalog, and registered with Spark SQL under its name."""
        self._register("udf", name, collection, cf, f)
        self.db.spark.udf.register(name, f)

    def drop_validator(self, name: str, collection: str, cf: str = DEFAULT) -> None:
        self._unregister("validator", name, collection, cf)

    def drop_trigger(self, name: str, collection: str, cf: str = DEFAULT) -> None:
        self._unregister("trigger", name, collection, cf)

    def drop_udf(self, name: str, collection: str, cf: str = DEFAULT) -> None:
        self._unregister("udf", name, collection, cf)

    # reads

    def _stored(self, cf: str, name: str, files: Sequence[str] | None = None) -> DataFrame:
        """The documents in some files (all, if None), expired ones too."""
        entry = self._entry(cf, name)
        schema = T.StructType.fromJson(entry["schema"]) if entry["schema"] else T.StructType([T.StructField(entry["pk"], T.StringType())])
        names = entry["files"] if files is None else files
        if not names:
            return self.db.spark.createDataFrame([], schema)
        return self.db.spark.read.schema(schema).parquet(*(f"{self.db.root}/{f}" for f in names))

    def frame(self, name: str, cf: str = DEFAULT) -> DataFrame:
        """The collection's live documents."""
        return visible(self._stored(cf, name), self._entry(cf, name)["ttl"], self.now)

    def _files_of(self, cf: str, name: str, rows: Callable[[DataFrame], DataFrame]) -> tuple[list[str], int]:
        """The files that hold the rows that rows picks of the stored documents, and how many rows they are."""
        entry = self._entry(cf, name)
        if not entry["files"]:
            return [], 0
        named = self._stored(cf, name).withColumn(_FILE, F.col("_metadata.file_name"))
        counts = {r[_FILE]: r["count"] for r in rows(named).groupBy(_FILE).count().collect()}
        return [f for f in entry["files"] if f.rsplit("/", 1)[1] in counts], sum(counts.values())

    def find(self, name: str, filter: Mapping[str, Any] | None = None, options: R.FindOptions | None = None, cf: str = DEFAULT) -> Cursor:  # noqa: A002
        df, pk = self.frame(name, cf), self._entry(cf, name)["pk"]
        found = R.find(df, filter, options, pk)
        return Cursor(lambda: (found, None))

    def find_one(self, name: str, filter: Mapping[str, Any] | None = None, cf: str = DEFAULT) -> dict[str, Any] | None:  # noqa: A002
        return next(self.find(name, filter, R.FindOptions(take=1), cf).iter(), None)

    def count(self, name: str, filter: Mapping[str, Any] | None = None, cf: str = DEFAULT) -> int:  # noqa: A002
        return R.count(self.frame(name, cf), filter).first()["count"]

    def distinct(self, name: str, path: str, filter: Mapping[str, Any] | None = None, cf: str = DEFAULT, sort: int | None = None, skip: int = 0, take: int | None = None) -> list[Any]:  # noqa: A002
        return [r["value"] for r in R.distinct(self.frame(name, cf), path, filter, sort, skip, take).toLocalIterator()]

    # writes

    def _publish(self, cf: str, name: str, touched: Sequence[str], rest: Callable[[DataFrame], DataFrame], add: DataFrame | None) -> None:
        """New files with what rest leaves of the live documents in the touched files, and with add; untouched files stay.

        Fields that are new are null in files that stay. Where a field's type has to be widened, all files are touched. New files
        are laid out by the collection's index hints: dealt by ranges of them and sorted, so that their statistics prune reads.
        """
        entry = self._entry(cf, name)
        known = T.StructType.fromJson(entry["schema"]) if entry["schema"] else None

        def result(files: Sequence[str]) -> DataFrame | None:
            parts = [rest(visible(self._stored(cf, name, files), entry["ttl"], self.now))] if files else []
            parts += [] if add is None else [add]
            if len(parts) == 2:
                a, b = M.aligned(*parts)
                return a.unionByName(b)
            return parts[0] if parts else None

        df = result(touched)
        if df is None:
            return
        want = df.schema if known is None else M.common_type(known, df.schema)
        if known is not None and any(want[f.name].dataType != f.dataType for f in known.fields):
            touched = list(entry["files"])
            df = result(touched)
        df = M.update_schema(df, want)
        hints = [quoted(x) for x in entry["indexes"] if x != entry["ttl"] and "[]" not in x and "." not in x and x in df.columns]
        if hints:
            df = df.repartitionByRange(*hints).sortWithinPartitions(*hints)
        path = f"data/{cf}/{name}-{uuid.uuid4().hex}"
        df.write.option(f"parquet.bloom.filter.enabled#{entry['pk']}", "true").parquet(f"{self.db.root}/{path}")
        self.written.append(path)
        fresh = [f"{path}/{f}" for f in self.db.folder.names(path) if f.endswith(".parquet")]
        entry["files"] = [f for f in entry["files"] if f not in set(touched)] + fresh
        entry["schema"] = df.schema.jsonValue()
        self.dirty = True

    def _hooks(self, cf: str, name: str) -> Hooks:
        return self.hooks.get(f"{cf}/{name}", Hooks()) if self.db.scripting else Hooks()

    def _context(self, cf: str) -> Context:
        def read(collection: str, key: Any) -> dict[str, Any] | None:
            pk = self._entry(cf, collection)["pk"]
            return next(iter(rows_of(self.frame(collection, cf).where(F.col(quoted(pk)) == F.lit(key)).limit(1))), None)

        return Context(read)

    def _settle(self, cf: str, context: Context) -> None:
        """Apply what triggers wrote."""
        for collection, rows in context.pending.items():
            pk = self._entry(cf, collection)["pk"]
            kept = [d for d in rows.values() if d is not None]
            new = M.documents(self.db.spark, kept, pk) if kept else None
            held = F.col(quoted(pk)).isin(list(rows))
            touched, _ = self._files_of(cf, collection, lambda df, held=held: df.where(held))
            self._publish(cf, collection, touched, lambda df, held=held: df.where(~F.coalesce(held, F.lit(False))), new)

    def _around(self, cf: str, name: str, before: list[tuple[str, DataFrame]], write: Callable[[], None], after: list[tuple[str, DataFrame]]) -> None:
        """Fire the triggers of actions before the write, write, fire those after it, and apply what they wrote."""
        hooks = self._hooks(cf, name)
        context = self._context(cf)
        for action, rows in before if hooks.triggers else ():
            fire(hooks, context, action, rows_of(rows))
        write()
        for action, rows in after if hooks.triggers else ():
            fire(hooks, context, action, rows_of(rows))
        self._settle(cf, context)

    def insert_many(self, name: str, docs: Documents, cf: str = DEFAULT) -> Cursor:
        self._writes()

        def run() -> tuple[DataFrame, int]:
            pk = self._entry(cf, name)["pk"]
            new = M.documents(self.db.spark, [docs] if isinstance(docs, (Mapping, str)) else docs, pk, generate=True)
            n = new.count()
            M.check_new(self.frame(name, cf), new, pk)
            if self._hooks(cf, name).validators:
                validate(self._hooks(cf, name), new)
            keys = new.select(F.col(quoted(pk)).alias("__k"))
            # an expired document of the same key goes for good
            touched, _ = self._files_of(cf, name, lambda df: expired(df, self._entry(cf, name)["ttl"], self.now).join(keys, F.col(quoted(pk)) == F.col("__k"), "left_semi"))
            self._around(cf, name, [("inserting", new)], lambda: self._publish(cf, name, touched, lambda df: df, new), [("inserted", new)])
            return new, n

        return Cursor(run)

    def insert_one(self, name: str, doc: Mapping[str, Any], cf: str = DEFAULT) -> Cursor:
        return self.insert_many(name, [doc], cf)

    def _change(self, cf: str, name: str, filter: Mapping[str, Any], one: bool, change: Callable[[DataFrame, str], DataFrame], actions: tuple[str, str], gone: bool = False) -> Cursor:  # noqa: A002
        self._writes()
        parse_filter(filter, required=True)

        def run() -> tuple[DataFrame, int]:
            entry = self._entry(cf, name)
            pk = entry["pk"]
            df = self.frame(name, cf)
            match = M.condition(df, filter)
            if one:
                first = M.first_match(df, filter, pk).collect()
                match = F.col(quoted(pk)) == F.lit(first[0][0]) if first else F.lit(False)
            touched, n = self._files_of(cf, name, lambda rows: visible(rows, entry["ttl"], self.now).where(match))
            hit = visible(self._stored(cf, name, touched), entry["ttl"], self.now).where(match)
            if not n:
                return hit, 0
            after = hit
            if not gone:
                if self._hooks(cf, name).validators:
                    validate(self._hooks(cf, name), hit)
                a, b = M.aligned(hit, change(hit, pk))
                after = b.exceptAll(a) if not any(t in x for _, x in b.dtypes for t in ("map<", "variant")) else b
            self._around(cf, name, [(actions[0], hit)], lambda: self._publish(cf, name, touched, lambda rows: change(rows, pk), None), [(actions[1], after)])
            return after, n

        return Cursor(run)

    def update_many(self, name: str, filter: Mapping[str, Any], said: Mapping[str, Any], cf: str = DEFAULT) -> Cursor:  # noqa: A002
        M.parse_update(said, self._entry(cf, name)["pk"])
        return self._change(cf, name, filter, False, lambda df, pk: M.update_many(df, filter, said, pk), ("updating", "updated"))

    def update_one(self, name: str, filter: Mapping[str, Any], said: Mapping[str, Any], cf: str = DEFAULT) -> Cursor:  # noqa: A002
        M.parse_update(said, self._entry(cf, name)["pk"])
        return self._change(cf, name, filter, True, lambda df, pk: M.update_one(df, filter, said, pk), ("updating", "updated"))

    def replace_one(self, name: str, filter: Mapping[str, Any], doc: Mapping[str, Any], cf: str = DEFAULT) -> Cursor:  # noqa: A002
        return self._change(cf, name, filter, True, lambda df, pk: M.replace_one(df, filter, doc, pk), ("updating", "updated"))

    def delete_many(self, name: str, filter: Mapping[str, Any], cf: str = DEFAULT) -> Cursor:  # noqa: A002
        return self._change(cf, name, filter, False, lambda df, pk: M.delete_many(df, filter), ("deleting", "deleted"), gone=True)

    def delete_one(self, name: str, filter: Mapping[str, Any], cf: str = DEFAULT) -> Cursor:  # noqa: A002
        return self._change(cf, name, filter, True, lambda df, pk: M.delete_one(df, filter, pk), ("deleting", "deleted"), gone=True)

    def _keyed(self, name: str, docs: Documents, cf: str, merge: bool, order: str | None) -> Cursor:
        self._writes()

        def run() -> tuple[DataFrame, int]:
            entry = self._entry(cf, name)
            pk = entry["pk"]
            rows = [docs] if isinstance(docs, (Mapping, str)) else docs
            if isinstance(rows, DataFrame):
                n = rows.count()
                new = M.last_of_each(rows, pk, order) if not merge or order is None else rows
                parts = [(M.documents(self.db.spark, new, pk, generate=True), order if merge else None)]
            else:
                rows = [json.loads(r) if isinstance(r, str) else r for r in rows]
                n = len(rows)
                folded: dict[Any, dict[str, Any]] = {}
                for k, row in enumerate(rows):
                    key = row.get(pk, ("new", k))
                    folded[key] = folded.get(key, {}) | dict(row) if merge else dict(row)
                groups: dict[tuple, list] = {}
                for row in folded.values():
                    groups.setdefault(tuple(sorted(x for x in row if x != pk)) if merge else (), []).append(row)
                parts = [(M.documents(self.db.spark, g, pk, generate=True), None) for g in groups.values()]
            written = None
            for new, by in parts:
                here = self._keyed_part(cf, name, new, merge, by)
                written = here if written is None else M.aligned(written, here)[0].unionByName(M.aligned(written, here)[1])
            return written if written is not None else self.frame(name, cf).limit(0), n

        return Cursor(run)

    def _keyed_part(self, cf: str, name: str, new: DataFrame, merge: bool, order: str | None) -> DataFrame:
        """Upsert or merge new, whose documents have the same fields; what was written."""
        entry = self._entry(cf, name)
        pk = entry["pk"]
        keys = new.select(F.col(quoted(pk)).alias("__k")).distinct()
        same = F.col(quoted(pk)) == F.col("__k")
        touched, _ = self._files_of(cf, name, lambda df: df.join(keys, same, "left_semi"))
        old = visible(self._stored(cf, name, touched), entry["ttl"], self.now).join(keys, same, "left_semi")
        result = (M.merge_many if merge else M.upsert_many)(old, new, pk, order) if entry["schema"] else new.drop(*([order] if order else []))
        before, after = [], []
        if self._hooks(cf, name).triggers:
            known = old.select(F.col(quoted(pk)).alias("__k"))
            added = result.join(known, same, "left_anti")
            changed = result.join(known, same, "left_semi")
            if merge and not any(t in x for _, x in changed.dtypes for t in ("map<", "variant")):
                a, b = M.aligned(old, changed)
                changed = b.exceptAll(a)
            before, after = [("updating", old), ("inserting", added)], [("updated", changed), ("inserted", added)]
        self._around(cf, name, before, lambda: self._publish(cf, name, touched, lambda df: df.join(keys, same, "left_anti"), result), after)
        return result

    def upsert_many(self, name: str, docs: Documents, cf: str = DEFAULT, order: str | None = None) -> Cursor:
        """The last of several documents of a key counts: of a list by place, of a DataFrame by the column order, which isn't stored."""
        return self._keyed(name, docs, cf, False, order)

    def merge_many(self, name: str, docs: Documents, cf: str = DEFAULT, order: str | None = None) -> Cursor:
        """Several documents of a key are merged one after another: of a list by place, of a DataFrame by the column order."""
        return self._keyed(name, docs, cf, True, order)

    def purge_expired(self, cf: str, name: str) -> int:
        """Remove the documents that have expired; how many they were."""
        return self.purge_before(cf, name, self.now)

    def purge_before(self, cf: str, name: str, at: dt.datetime) -> int:
        self._writes()
        ttl = self._entry(cf, name)["ttl"]
        touched, n = self._files_of(cf, name, lambda df: expired(df, ttl, at))
        if n:
            self._publish(cf, name, touched, lambda df: visible(df, ttl, at), None)
        return n

    def delete_range(self, name: str, low: Any = None, high: Any = None, cf: str = DEFAULT, with_low: bool = True, with_high: bool = False) -> None:
        """Remove the documents whose primary key lies between low and high, and at them if with_low, with_high; None is no bound."""
        self._writes()
        pk = F.col(quoted(self._entry(cf, name)["pk"]))
        above = F.lit(True) if low is None else pk >= low if with_low else pk > low
        below = F.lit(True) if high is None else pk <= high if with_high else pk < high
        inside = F.coalesce(above & below, F.lit(False))
        touched, _ = self._files_of(cf, name, lambda df: df.where(inside))
        self._publish(cf, name, touched, lambda df: df.where(~inside), None)

    # end

    def commit(self) -> None:
        self._writes()
        self.closed = True
        if not self.dirty:
            return
        mine = {k for k in self.meta["collections"] | self.began["collections"] if self.meta["collections"].get(k) != self.began["collections"].get(k)}
        for _ in range(TURNS):
            if self.db.folder.create(f"manifests/m{self.version + 1:010d}.json", json.dumps(self.meta)):
                self.db.hooks = self.fresh_hooks
                return
            # on top of the others' commits, unless they changed one of this one's collections
            self.version, latest = self.db.manifest()
            if any(latest["collections"].get(k) != self.began["collections"].get(k) for k in mine):
                break
            theirs = {k: v for k, v in latest["collections"].items() if k not in mine}
            self.meta = {"collections": theirs | {k: v for k, v in self.meta["collections"].items() if k in mine}}
        self._discard()
        raise StoreError("another transaction committed first")

    def rollback(self) -> None:
        self.closed = True
        self._discard()

    def _discard(self) -> None:
        for path in self.written:
            self.db.folder.delete(path)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if not self.closed and not self.read_only:
            self.rollback() if kind else self.commit()


