"""A session: tables with their models in a store, reads under filters, bulk writes, saved changes, and the audit trail
in the same commit."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from itertools import count, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tracking as tracks
from .audit.entry import ENTRY, entries
from .audit.spec import AuditSpec, audits, plan_audit
from .errors import AuditNotSupported, ConcurrencyConflict, ConstraintViolation, NotConfigured, WriteFailed, WriteNotSupported
from .events import EventBus
from .functions.ordinals import materialized, staging, with_dense_ordinal
from .model import TableModel
from .observers import Needs, Observation, WriteObserver
from .operators import changes as ch
from .operators import constraints as cn
from .operators import filtering, keyset, paging
from .operators import marking as mk
from .operators.graph import Branch, SelfReference, keyed, table_order, unfold, with_depth, with_parent_keys
from .options import Atomicity, AuditOptions, Call, OnSinkFailure, OnUnsupported, Op, QueryOptions, TrailLayout, WriteOptions
from .plans.advisor import Advisor
from .plans.partition import plan_partitions
from .plans.write_plan import WritePlan, check_model, plan_write
from .sources.store import Store, Transaction

_SOURCE = {Op.INSERT: "Bulk.Insert", Op.UPDATE: "Bulk.Update", Op.DELETE: "Bulk.Delete", Op.MERGE: "Bulk.Merge", Op.SYNCHRONIZE: "Bulk.Synchronize"}
_groups = count(1)


@dataclass(frozen=True)
class Progress:
    completed: int
    total: int

    @property
    def fraction(self) -> float:
        return 1.0 if not self.total else self.completed / self.total


class Session:
    """Capabilities are there when their options are given: query, write, audit."""

    def __init__(
        self, spark: SparkSession, path: str, models: list[TableModel], query: QueryOptions | None = None, write: WriteOptions | None = None,
        audit: AuditOptions | None = None, audit_specs: dict[str, AuditSpec] | None = None, observers: list[WriteObserver] = (), sink: Callable | None = None,
        audit_path: str | None = None,
    ):
        self.spark, self.store, self.events = spark, Store(spark, path), EventBus()
        self.models = {m.name: m for m in models}
        self.query_options, self.write_options, self.audit_options = query, write, audit
        self.observers, self.sink = list(observers), sink
        self._tx: Transaction | None = None
        self._snapshots: dict[str, DataFrame] = {}
        self.audit_specs = audit_specs or {}
        unknown = sorted(set(self.audit_specs) - set(self.models))
        if unknown:
            raise AuditNotSupported(f"no table {', '.join(unknown)}")
        self.audit_plans = {}
        if audit is not None:
            self.audit_plans = {n: plan_audit(m, self.audit_specs.get(n), audit) for n, m in self.models.items() if audits(m, self.audit_specs.get(n), audit)}
            if write is None and sink is None:
                raise NotConfigured("an audit trail is written by bulk writes; give write options")
        external = audit is not None and audit.external
        if external != (audit_path is not None):
            raise NotConfigured("entries go to another store if the audit options say so and audit_path names it")
        self.audit_store = Store(spark, audit_path) if external else None

    # reads

    def model(self, name: str) -> TableModel:
        if name not in self.models:
            raise WriteNotSupported(f"{name} isn't a table of this session")
        return self.models[name]

    def _manifest(self):
        return self._tx.now if self._tx is not None else self.store.manifest()

    def read(self, name: str, ignore_filters: bool | set[str] = False, version: int | None = None) -> DataFrame:
        """The table's rows, as of the latest version, a given one, or the open transaction."""
        model = self.model(name)
        manifest = self._manifest() if version is None else self.store.manifest(version)
        df = model.filtered(self.store.read(manifest, name, model.schema), ignore_filters)
        if self.query_options is not None and self.query_options.tracking_scopes and version is None:
            if tracks.current(owner=self) is tracks.Tracking.TRACKING:
                self._snapshots[name] = df
        return df

    def begin_tracking(self, behaviour: tracks.Tracking) -> tracks.TrackingScope:
        return tracks.TrackingScope(behaviour, owner=self)

    def _queries(self) -> QueryOptions:
        if self.query_options is None:
            raise NotConfigured("the session has no query options")
        return self.query_options

    def advisor(self, name: str) -> Advisor:
        return Advisor(self.model(name), self._queries(), self.events)

    def page(self, name: str, df: DataFrame, request: paging.PageRequest) -> paging.PagedResult:
        return paging.to_page(df, request, self._queries(), self.advisor(name).offset)

    def keyset_page(self, df: DataFrame, keys: keyset.KeysetDefinition, size: int | None = None, cursor: str | None = None) -> keyset.KeysetPage:
        return keyset.keyset_page(df, keys, size, cursor, self._queries(), self.advisor(keys.model.name).keyset)

    def where_in(self, name: str, df: DataFrame, column: str, values) -> DataFrame:
        return filtering.where_in(df, column, values, self._queries().max_in_values, self.advisor(name).in_list)

    def audit_trail(self) -> DataFrame:
        if self.audit_options is None:
            raise NotConfigured("the session has no audit options")
        if self.audit_store is not None:
            return self.audit_store.read(self.audit_store.manifest(), self.audit_options.table, self._entry_schema())
        return self.store.read(self._manifest(), self.audit_options.table, self._entry_schema())

    def _entry_schema(self):
        schema = ENTRY
        for name in self.audit_options.json_columns:
            schema = type(ENTRY)(schema.fields[:]).add(name, "string")
        return schema

    # transactions

    @contextmanager
    def transaction(self, savepoint: bool = True) -> Iterator[Transaction]:
        """Writes inside become visible at its end, or not at all.  Nested ones are savepoints; without one, a nested
        write that fails leaves the whole transaction unable to commit."""
        if self._tx is not None and not savepoint:
            try:
                yield self._tx
            except BaseException:
                self._tx.broken = True
                raise
            return
        if self._tx is not None:
            mark = self._tx.savepoint()
            try:
                yield self._tx
            except BaseException:
                self._tx.rollback_to(mark)
                raise
            self._tx.release(mark)
            return
        self._tx = Transaction(self.store)
        try:
            yield self._tx
            self._tx.commit()
        finally:
            if not self._tx.done:
                self._tx.rollback()
            self._tx = None

    # bulk writes

    def load(self, name: str, df: DataFrame) -> None:
        """The table's first rows, as they are."""
        with self.transaction() as tx:
            model = self.model(name)
            tx.relied.add(name)
            tx.now = tx.now.with_files(name, self.store.write(name, df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in model.schema]), self._sort(name)))
            for c in model.generated:
                tx.now = tx.now.with_next(f"{name}.{c}", None)

    def _sort(self, name: str) -> list[str]:
        m = self.model(name)
        return list(m.layout[0] if m.layout else m.key)

    def insert(self, name: str, source: DataFrame, call: Call = Call(), **settings) -> ch.BulkResult:
        call = _with(call, settings)
        if call.include_graph:
            if not self.model(name).nested:
                raise WriteNotSupported(f"{name} has no nested rows to bring along")
            if not isinstance(source, DataFrame):
                raise WriteNotSupported("nested rows come as a DataFrame with array columns")
            plan_write(self.model(name), Op.INSERT, source.drop(*[b.column for b in self.model(name).nested]), call)
            return self.insert_graph(name, source, self.model(name).nested, _with(call, {"include_graph": False}))
        return self.bulk(Op.INSERT, name, source, call)

    def update(self, name: str, source: DataFrame, call: Call = Call(), **settings) -> ch.BulkResult:
        return self.bulk(Op.UPDATE, name, source, _with(call, settings))

    def delete(self, name: str, source: DataFrame, call: Call = Call(), **settings) -> ch.BulkResult:
        return self.bulk(Op.DELETE, name, source, _with(call, settings))

    def merge(self, name: str, source: DataFrame, call: Call = Call(), **settings) -> ch.BulkResult:
        return self.bulk(Op.MERGE, name, source, _with(call, settings))

    def synchronize(self, name: str, source: DataFrame, call: Call = Call(), **settings) -> ch.BulkResult:
        return self.bulk(Op.SYNCHRONIZE, name, source, _with(call, settings))

    def insert_graph(self, name: str, parents: DataFrame, branches: tuple[Branch, ...], call: Call = Call(), own: SelfReference | None = None) -> ch.BulkResult:
        """Parents and their nested rows, referenced tables first, in one transaction.

        Keys that the store assigns are drawn before the children are written and handed down to them.  `own` says
        how rows of `name` refer to each other by numbers of their own; rows higher up get lower keys."""
        if self.write_options is None:
            raise NotConfigured("the session has no write options")
        total = 0
        with staging(self.spark), self.transaction(call.savepoint) as tx, self._deadline(call.timeout_seconds or self.write_options.timeout_seconds):
            found = unfold(materialized(parents, "graph"), self.model(name), branches)
            order = [m.name for m in table_order([self.model(n) for n in found])]
            for n in order:
                model, rows, links = self.model(n), found[n].rows, found[n].links
                for link in links:  # parents were written before
                    rows = keyed(rows, found[link.parent].rows, link)
                numbers = [c for c in model.key if model.generated.get(c) == "sequence"]
                if numbers:
                    starts = self._starts(tx, model, numbers)
                    rows = self._numbered(rows, numbers[0], starts[numbers[0]], own if n == name else None)
                found[n] = found[n].with_rows(rows := materialized(rows, "graph"))
                given = rows.select(*[F.col(f"`{c}`") for c in model.columns if c in rows.columns])
                plan = plan_write(model, Op.INSERT, given, call)
                full = ch.complete(given, None, WritePlan(model, Op.INSERT, (), tuple(given.columns), (), plan.generated), None, self._starts(tx, model, ch.assigned(plan, given.columns)))
                tx.relied.add(n)
                total += self._insert_rows(tx, plan, full, call, complete=True).inserted
                if numbers:
                    tx.now = tx.now.with_next(f"{n}.{numbers[0]}", starts[numbers[0]] + rows.count())
        return ch.BulkResult(total)

    def _numbered(self, rows: DataFrame, key: str, start: int, own: SelfReference | None) -> DataFrame:
        """Rows with assigned keys, parents before their children, and their own references by those keys."""
        rows = rows.drop(key)
        if own is None:
            return with_dense_ordinal(rows, key, None, start)
        rows = with_dense_ordinal(with_depth(rows, own.number, own.parent, "depth__"), key, [F.col("depth__"), F.col(f"`{own.number}`")], start)
        rows = materialized(rows.drop("depth__"), "graph")
        return with_parent_keys(rows, rows.select(F.col(f"`{own.number}`").alias("number__"), F.col(f"`{key}`").alias("key__")), own.parent, "number__", "key__", own.column)

    def bulk(self, op: Op, name: str, source: DataFrame | Iterable, call: Call) -> ch.BulkResult:
        """One bulk write of a DataFrame, or of rows in memory (dictionaries or Rows)."""
        if self.write_options is None:
            raise NotConfigured("the session has no write options")
        with staging(self.spark, lambda path, e: self.events.publish("write", "StagingCleanupFailed", path=path, error=str(e))):
            return self._bulk(op, name, self._frame(name, source), call)

    def _frame(self, name: str, source: DataFrame | Iterable) -> DataFrame:
        if isinstance(source, DataFrame):
            return source
        rows = [r.asDict() if hasattr(r, "asDict") else dict(r) for r in source]
        given = {c for r in rows for c in r}
        schema = T.StructType([f for f in self.model(name).schema.fields if f.name in given or not rows])
        return self.spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], T.StructType([T.StructField(f.name, f.dataType) for f in schema]))

    def insert_stream(self, name: str, rows: Iterable, batch: int | None = None, call: Call = Call()) -> ch.BulkResult:
        """Rows from an iterator, a batch in memory at a time, in one transaction."""
        if call.include_graph:
            raise WriteNotSupported("a stream of rows can't bring related rows along")
        size, total, rows = batch or self.write_options.max_batch, 0, iter(rows)
        with self.transaction():
            while lot := list(islice(rows, size)):
                total += self.insert(name, lot, call).inserted
        return ch.BulkResult(total)

    def bulk_save_changes(self, name: str, current: DataFrame, original: DataFrame | None = None) -> ch.BulkResult:
        return self.save_changes(name, current, original)

    def _bulk(self, op: Op, name: str, source: DataFrame, call: Call) -> ch.BulkResult:
        model = self.model(name)
        plan = plan_write(model, op, source, call)
        source = source.select(*[F.col(f"`{c}`") for c in model.columns if c in source.columns])
        if op is not Op.INSERT or call.batch_size or call.on_progress is not None:  # read more than once
            source = materialized(source.withColumn(mk.SRC, F.monotonically_increasing_id()))
        if op is Op.SYNCHRONIZE:
            ch.check_synchronize(model, source, call.scope, call.allow_full_table_delete)
        batches = [source]
        if call.batch_size and op is not Op.SYNCHRONIZE:
            total = source.count()
            lots = max(1, -(-total // call.batch_size))
            hashed = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in (plan.match or plan.write)]), F.lit(lots))
            batches = [source.where(hashed == i) for i in range(lots)]
        result, done, total = ch.BulkResult(), 0, None
        with self.transaction(call.savepoint) as tx, self._deadline(call.timeout_seconds or self.write_options.timeout_seconds):
            for batch in batches:
                r = self._write(tx, plan, batch, call)
                result = ch.BulkResult(result.inserted + r.inserted, result.updated + r.updated, result.deleted + r.deleted)
                if call.on_progress is not None:
                    total = source.count() if total is None else total
                    done = total if batch is batches[-1] else min(total, done + r.total)
                    call.on_progress(Progress(done, total))
        if call.track or name in self._snapshots:
            self._snapshots[name] = self.model(name).filtered(self.store.read(self._manifest(), name, model.schema))
        return result

    @contextmanager
    def _deadline(self, seconds: float | None):
        """Cancels the call's jobs when its time is up; whole seconds, one at least; 0 is no limit."""
        if not seconds:
            yield
            return
        group, late = f"ledgerframe-{next(_groups)}", threading.Event()
        sc = self.spark.sparkContext
        sc.setJobGroup(group, "bulk write", interruptOnCancel=True)

        def cancel():
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(max(1, -(-seconds // 1)), cancel)
        timer.start()
        try:
            yield
        except Exception as e:
            if late.is_set():
                raise WriteFailed(f"the write took longer than {seconds} s") from e
            raise
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def _declined(self, plan: WritePlan, rows: DataFrame) -> bool:
        """Whether the plain path takes the write, and the reason told; there is none for a merge."""
        options = self.write_options
        reason = options.declines(plan) if options.declines is not None else None
        if reason is None:
            return False
        if options.on_unsupported is OnUnsupported.RAISE or plan.op in (Op.MERGE, Op.SYNCHRONIZE):
            raise WriteNotSupported(f"{plan.op.value.lower()} of {plan.model.name}: {reason}")
        self.events.publish("write", "ExplicitFallback", table=plan.model.name, op=plan.op.value, rows=rows.count(), reason=reason)
        return True

    def _narrowed(self, files: tuple[str, ...], plan: WritePlan, source: DataFrame) -> list[str]:
        """Of many files, those that hold a match; found by the match columns alone, within the source's bounds."""
        model, keys = plan.model, list(plan.match)
        kinds = {c: model.schema[c].dataType for c in keys}
        s = source.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(f"s__{c}") for c in keys])
        ordered = [c for c in keys if isinstance(kinds[c], (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))]
        table = self.spark.read.schema(model.schema).parquet(*files)
        if ordered:
            ends = s.agg(*[f(f"s__{c}").alias(f"{n}{i}") for i, c in enumerate(ordered) for n, f in (("lo", F.min), ("hi", F.max))]).first()
            for i, c in enumerate(ordered):
                if ends[f"lo{i}"] is not None:
                    table = table.where(F.col(f"`{c}`").between(F.lit(ends[f"lo{i}"]).cast(kinds[c]), F.lit(ends[f"hi{i}"]).cast(kinds[c])))
        on = reduce(lambda a, b: a & b, [F.col(f"`{c}`") == F.col(f"s__{c}") for c in keys])
        at = table.select(*[F.col(f"`{c}`") for c in keys], F.col("_metadata.file_path").alias("file__"))
        named = {_plain(r.file__) for r in at.join(s, on, "left_semi").select("file__").distinct().collect()}  # no more than the table has files
        return [f for f in files if _plain(f) in named]

    def _starts(self, tx: Transaction, model: TableModel, columns: list[str]) -> dict[str, int]:
        """The next number of each sequence: from the log, or, after a plain load, from the whole table once."""
        out = {}
        for c in columns:
            at = tx.now.next.get(f"{model.name}.{c}")
            if at is None:
                at = (self.store.read(tx.now, model.name, model.schema).agg(F.max(F.col(f"`{c}`")).alias("m")).first().m or 0) + 1
            out[c] = int(at)
        return out

    def _advance(self, tx: Transaction, model: TableModel, starts: dict[str, int], highest: dict[str, int | None]) -> None:
        for c, top in highest.items():
            name = f"{model.name}.{c}"
            known = starts.get(c, tx.now.next.get(name))
            if known is not None:
                tx.now = tx.now.with_next(name, max(known, (top or 0) + 1))

    def _write(self, tx: Transaction, plan: WritePlan, source: DataFrame, call: Call) -> ch.BulkResult:
        started, model = time.monotonic(), plan.model
        tx.relied.add(model.name)
        declined = self._declined(plan, source)
        if plan.op is Op.INSERT:
            result = self._insert_rows(tx, plan, source, call)
        else:
            result = self._change_rows(tx, plan, source, call, plain=declined)
        self.events.publish("write", "PartitionExecuted", table=model.name, op=plan.op.value, rows=result.total, accelerated=not declined, seconds=time.monotonic() - started)
        return result

    def _insert_rows(self, tx: Transaction, plan: WritePlan, source: DataFrame, call: Call, order: list[str] | None = None, complete: bool = False) -> ch.BulkResult:
        """Rows go straight into their files, which nothing names yet; what is checked and told is read from these.
        `complete` rows have every column already."""
        model = plan.model
        stored = mk.located(self.store.read(tx.now, model.name, model.schema)) if tx.now.of(model.name) else None
        rows, starts = source, {}
        if not complete:
            rows = source.select(*[F.col(f"`{c}`").cast(model.schema[c].dataType).alias(c) for c in plan.write])
            starts = self._starts(tx, model, ch.assigned(plan, rows.columns))
            rows = ch.complete(rows, None, plan, order, starts)
        files = self.store.write(model.name, rows, self._sort(model.name))
        written = self.store.read(tx.now, model.name, model.schema, only=files)
        told = mk.facts(plan, None, None, written, self.write_options.validate_constraints)
        told.require(plan)
        self._constrain(tx, plan, stored, None, written)
        self._advance(tx, model, starts, told.highest)
        tx.now = tx.now.with_files(model.name, [*tx.now.of(model.name), *files])
        self._observe(tx, plan, mk.changed(None, written, plan), call)
        return ch.BulkResult(inserted=told.source)

    def _change_rows(self, tx: Transaction, plan: WritePlan, source: DataFrame, call: Call, plain: bool = False) -> ch.BulkResult:
        """Update, delete, merge and synchronize: one join marks, and everything else follows from what it marked."""
        model, files = plan.model, tx.now.of(plan.model.name)
        children = [(m, r) for m, r in cn.referring(model, plan, self.models) if self.write_options.validate_constraints and (m.name == model.name or tx.now.of(m.name))]
        wants = self._wants(plan, call)
        want_old = bool(children) or (wants is Needs.ALL and (call.before_images or plan.op is not Op.UPDATE)) or (wants is Needs.ROWS and plan.op in (Op.DELETE, Op.SYNCHRONIZE))
        near = files
        if not plain and plan.op is not Op.SYNCHRONIZE and len(files) > self.write_options.narrow_files:
            near = self._narrowed(files, plan, source)
        if near:
            target = mk.located(self.store.read(tx.now, model.name, model.schema, only=near))
        else:
            target = self.spark.createDataFrame([], T.StructType([*model.schema.fields, T.StructField(mk.FILE, T.StringType()), T.StructField(mk.ROW, T.LongType())]))
        marked = materialized(mk.mark(target, source, plan, call.scope, want_old), "marked")
        fresh, starts = None, {}
        if plan.op in (Op.MERGE, Op.SYNCHRONIZE):
            fresh = mk.unmatched(source, marked, plan)
            numbers = ch.assigned(plan, fresh.columns)
            starts = self._starts(tx, model, numbers)
            fresh = materialized(ch.complete(fresh, None, plan, list(plan.match) if numbers else None, starts), "fresh")
        told = mk.facts(plan, source, marked, fresh, self.write_options.validate_constraints)
        told.require(plan)
        if fresh is not None and told.source == told.met:
            fresh = None
        stored = mk.located(self.store.read(tx.now, model.name, model.schema)) if files else None
        self._constrain(tx, plan, stored, marked, fresh, children)
        self._rewrite(tx, model, marked, fresh, told, everything=plain)
        self._advance(tx, model, starts, told.highest)
        self._observe(tx, plan, mk.changed(marked, fresh, plan), call)
        return told.result(plan)

    def _rewrite(self, tx: Transaction, model: TableModel, marked: DataFrame, fresh: DataFrame | None, told: mk.Facts, everything: bool = False) -> None:
        """New files for those that lose or change a row, and for new rows."""
        named = {_plain(f) for f, ops in told.files.items() if any(ops.get(op) for op in (ch.UPDATE, ch.DELETE))}
        files = tx.now.of(model.name)
        touched = [f for f in files if everything or _plain(f) in named]
        parts = []
        if touched:
            parts.append(mk.remaining(mk.located(self.store.read(tx.now, model.name, model.schema, only=touched)), marked))
        if told.count(ch.UPDATE):
            parts.append(marked.where(F.col("op") == ch.UPDATE).select("new.*"))
        if fresh is not None:
            parts.append(fresh)
        if not parts:
            return
        rows = reduce(DataFrame.unionByName, parts)
        others = [f for f in files if f not in set(touched)]
        tx.now = tx.now.with_files(model.name, [*others, *self.store.write(model.name, rows, self._sort(model.name))])

    def _constrain(self, tx: Transaction, plan: WritePlan, stored: DataFrame | None, marked: DataFrame | None, fresh: DataFrame | None, children: list = ()) -> None:
        """Uniques and references, against the table as it will be."""
        if not self.write_options.validate_constraints:
            return
        model = plan.model
        if stored is None:
            stored = self.spark.createDataFrame([], T.StructType([*model.schema.fields, T.StructField(mk.FILE, T.StringType()), T.StructField(mk.ROW, T.LongType())]))
        read = lambda m: self.store.read(tx.now, m.name, m.schema)
        cn.check_uniques(plan, stored, marked, fresh)
        tx.relied.update(r.table for r in model.references if r.table in self.models)
        cn.check_references(plan, read, stored, marked, fresh, self.models)
        if children and marked is not None:
            tx.relied.update(m.name for m, _ in children)
            cn.check_referring(plan, read, stored, marked, fresh, children)

    def _wants(self, plan: WritePlan, call: Call) -> Needs:
        """What observers and the trail want to see of the rows."""
        if not call.observers:
            return Needs.NOTHING
        wanted = [o.observes(plan.model, plan.op) for o in self.observers]
        if plan.model.name in self.audit_plans:
            wanted.append(Needs.ALL if plan.op is not Op.UPDATE or (call.before_images and self.audit_options.before_images) else Needs.ROWS)
        return Needs(max((n.value for n in wanted), default=0))

    def _observe(self, tx: Transaction, plan: WritePlan, changes: DataFrame, call: Call) -> None:
        if not call.observers:
            return
        for o in self.observers:
            needs = o.observes(plan.model, plan.op)
            if needs is not Needs.NOTHING:
                images = needs is Needs.ALL and call.before_images
                seen = changes if images else changes.withColumn("old", F.when(F.col("op") == ch.DELETE, F.col("old")))
                o.observed(Observation(plan.model, plan.op, seen, images), tx)
        audit = self.audit_plans.get(plan.model.name)
        if audit is not None:
            before = call.before_images and self.audit_options.before_images
            self.write_entries(tx, entries(audit, changes, _SOURCE[plan.op], self.audit_options, before))

    def write_entries(self, tx: Transaction, told: DataFrame) -> None:
        """Entries to the trail in this commit, to the session's sink, or after the commit to another store.

        From `batch_threshold` entries on they are written as a batch, fewer as one file."""
        options = self.audit_options
        told = materialized(told, "entries")  # ids are drawn once
        n = told.count()
        if not n:
            self.events.publish("audit", "AuditSkipped")
            return
        batched = n >= options.batch_threshold
        self.events.publish("audit", "EntriesCaptured", count=n)
        rows = told if batched else told.coalesce(1)
        order = ["entity_type", "entity_key", "occurred_at"] if options.layout is TrailLayout.BY_ROW else ["tenant_id", "occurred_at"] if options.layout is TrailLayout.BY_TENANT else ["occurred_at"]

        def put() -> None:
            if self.sink is not None:
                self.sink(rows, tx)
            elif self.audit_store is not None:  # a commit of its own, after the data's: written now, while the staged entries are there
                files = self.audit_store.write(options.table, rows, order)
                tx.after.append(lambda: self._guarded(lambda: self._append(files)))
            else:
                tx.now = tx.now.with_files(options.table, [*tx.now.of(options.table), *self.store.write(options.table, rows, order)])
            self.events.publish("audit", "EntriesWritten", batched=batched, count=n)

        self._guarded(put)

    def _append(self, files: list[str]) -> None:
        base = self.audit_store.manifest()
        self.audit_store.commit(base, base.with_files(self.audit_options.table, [*base.of(self.audit_options.table), *files]))

    def _guarded(self, put: Callable[[], None]) -> None:
        """A sink that fails undoes the write, unless entries are a best effort whose failure is ignored."""
        options = self.audit_options
        try:
            put()
        except Exception as e:
            self.events.publish("audit", "SinkFailed", error=str(e))
            if options.atomicity is Atomicity.SAME_TRANSACTION or options.on_sink_failure is OnSinkFailure.RAISE:
                raise

    # saved changes

    def save_changes(self, name: str, current: DataFrame, original: DataFrame | None = None) -> ch.BulkResult:
        """Writes the difference between the rows that were read and `current`: new keys are inserted, changed rows
        updated, missing ones deleted.  Concurrency tokens must still be what they were."""
        with staging(self.spark, lambda path, e: self.events.publish("write", "StagingCleanupFailed", path=path, error=str(e))):
            return self._save_changes(name, current, original)

    def _save_changes(self, name: str, current: DataFrame, original: DataFrame | None) -> ch.BulkResult:
        if self.write_options is None:
            raise NotConfigured("the session has no write options")
        model = self.model(name)
        original = original if original is not None else self._snapshots.get(name)
        if original is None:
            raise WriteNotSupported(f"{name} wasn't read with tracking, so there is nothing to compare with")
        if not model.key:
            raise WriteNotSupported(f"{name} has no key")
        if model.temporal or not model.mapped:
            check_model(model, Op.INSERT)
        diff = materialized(difference(original, current, model), "difference")
        planned = plan_partitions(change_rows(diff, model), self.write_options)
        fast = [p for p in planned if p.reason is None]
        self.events.publish("write", "PartitionsPlanned", table=name, partitions=len(planned), accelerated=len(fast), rows=sum(p.n for p in planned))
        started = time.monotonic()
        with self.transaction() as tx:
            result = self._apply(tx, model, diff) if planned else ch.BulkResult()
            for p in planned:
                if p.reason is not None:
                    self.events.publish("write", "PartitionDeclined", table=name, state=p.state, shape=p.shape, rows=p.n, reason=p.reason)
                self.events.publish("write", "PartitionExecuted", table=name, state=p.state, shape=p.shape, rows=p.n, accelerated=p.reason is None, seconds=time.monotonic() - started)
        self._snapshots[name] = model.filtered(self.store.read(self._manifest(), name, model.schema))
        return result

    def _apply(self, tx: Transaction, model: TableModel, diff: DataFrame) -> ch.BulkResult:
        """All partitions of a change set in one pass over the table: they differ in what is worth planning apart,
        not in how a versioned table takes them."""
        tx.relied.add(model.name)
        condition = (*model.key, *sorted(model.tokens))
        free = tuple(c for c in model.columns if c not in model.key)
        plan = WritePlan(model, Op.SYNCHRONIZE, model.key, tuple(c for c in model.columns if c not in model.generated), free, tuple(model.generated))
        known = diff.where(F.col("op") != ch.INSERT)
        located = mk.located(self.store.read(tx.now, model.name, model.schema)) if tx.now.of(model.name) else None
        s = known.select(*[F.col(f"old.`{c}`").alias(f"s__{c}") for c in condition], F.col("op"), F.col("old"), F.col("new"))
        if located is None:
            located = self.spark.createDataFrame([], T.StructType([*model.schema.fields, T.StructField(mk.FILE, T.StringType()), T.StructField(mk.ROW, T.LongType())]))
        on = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"s__{c}")) if c in model.tokens else F.col(f"`{c}`") == F.col(f"s__{c}") for c in condition])
        number = F.monotonically_increasing_id().alias(mk.SRC)
        marked = located.join(s, on).select("op", mk.FILE, mk.ROW, number, *[F.col(f"`{c}`").alias(f"m__{i}") for i, c in enumerate(model.key)], "old", "new")
        marked = materialized(marked, "marked")
        added = diff.where(F.col("op") == ch.INSERT).select(*[F.col(f"new.`{c}`").alias(c) for c in plan.write])
        inserting = WritePlan(model, Op.INSERT, (), plan.write, (), plan.generated)
        starts = self._starts(tx, model, ch.assigned(inserting, list(plan.write)))
        fresh = materialized(ch.complete(added, None, inserting, None, starts), "fresh")
        told = mk.facts(WritePlan(model, Op.SYNCHRONIZE, (), plan.write, free, plan.generated), diff, marked.drop(*[f"m__{i}" for i in range(len(model.key))]), fresh, self.write_options.validate_constraints)
        wanted = diff.groupBy("op").agg(F.count(F.lit(1)).alias("n")).collect()
        sizes = {r.op: r.n for r in wanted}
        found = told.count(ch.UPDATE) + told.count(ch.DELETE)
        missing = sizes.get(ch.UPDATE, 0) + sizes.get(ch.DELETE, 0) - found
        if missing:
            raise ConcurrencyConflict(f"{missing} rows of {model.name} were changed or removed since they were read")
        if told.broken:
            raise ConstraintViolation(f"{model.name}: {'; '.join(f'{k} ({n} rows)' for k, n in told.broken.items())}")
        fresh = fresh if sizes.get(ch.INSERT) else None
        children = [(m, r) for m, r in cn.referring(model, plan, self.models) if m.name == model.name or tx.now.of(m.name)]
        self._constrain(tx, WritePlan(model, Op.SYNCHRONIZE, (), plan.write, free, plan.generated), located, marked, fresh, children)
        self._rewrite(tx, model, marked, fresh, told)
        self._advance(tx, model, starts, told.highest)
        audit = self.audit_plans.get(model.name)
        if audit is not None:
            self.write_entries(tx, entries(audit, mk.changed(marked, fresh, plan), "SaveChanges", self.audit_options))
        return ch.BulkResult(sizes.get(ch.INSERT, 0), sizes.get(ch.UPDATE, 0), sizes.get(ch.DELETE, 0))


def change_rows(diff: DataFrame, model: TableModel) -> DataFrame:
    """A change set as rows to plan partitions by: state, and the columns written, read back and matched on."""
    every = [c for c in model.columns if c not in model.generated]
    free = [c for c in model.columns if c not in model.key]
    differs = lambda c: ~F.col(f"old.`{c}`").eqNullSafe(F.col(f"new.`{c}`"))
    texts = lambda cs: F.array(*[F.lit(c) for c in cs]).cast("array<string>")
    is_new, is_changed = F.col("op") == "INSERT", F.col("op") == "UPDATE"
    moved = F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in free]).cast("array<string>"))
    state = F.when(is_new, "Added").when(is_changed, "Modified").otherwise("Deleted")
    by_hand = state.isin(*sorted(model.procedures)) if model.procedures else F.lit(False)
    return diff.select(
        F.monotonically_increasing_id().alias("seq"), F.lit(model.name).alias("table"), state.alias("state"),
        F.when(is_new, texts(every)).when(is_changed, moved).otherwise(texts([])).alias("write"),
        F.when(is_new, texts([c for c in model.columns if c in model.generated])).otherwise(texts([])).alias("read"),
        F.when(is_new, texts([])).otherwise(texts([*model.key, *sorted(model.tokens)])).alias("condition"),
        by_hand.alias("procedure"), (is_changed & F.arrays_overlap(moved, texts(sorted(model.json)))).alias("json_path") if model.json else F.lit(False).alias("json_path"),
    )


def difference(original: DataFrame, current: DataFrame, model: TableModel) -> DataFrame:
    """(op, old, new) of rows by key; equal rows aren't there."""
    row = lambda side: F.struct(*[F.col(f"{side}.`{c}`").alias(c) for c in model.columns])
    o, c = original.withColumn("o__", F.lit(True)).alias("o"), current.withColumn("c__", F.lit(True)).alias("c")
    on = reduce(lambda a, b: a & b, [F.col(f"o.`{k}`") == F.col(f"c.`{k}`") for k in model.key])
    same = reduce(lambda a, b: a & b, [F.col(f"o.`{k}`").eqNullSafe(F.col(f"c.`{k}`")) for k in model.columns])
    op = F.when(F.col("o__").isNull(), "INSERT").when(F.col("c__").isNull(), "DELETE").when(~same, "UPDATE")
    rows = o.join(c, on, "full_outer").select(op.alias("op"), F.when(F.col("o__"), row("o")).alias("old"), F.when(F.col("c__"), row("c")).alias("new"))
    return rows.where(F.col("op").isNotNull())


def _plain(path: str) -> str:
    from urllib.parse import unquote

    return unquote(path.split(":", 1)[-1].lstrip("/"))


def _with(call: Call, settings: dict) -> Call:
    from dataclasses import replace

    return replace(call, **settings) if settings else call
