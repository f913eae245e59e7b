"""Databases: a catalog of collections, commands as documents, cursors, sessions and transactions."""

from __future__ import annotations

import itertools
import time
from contextlib import ExitStack
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..plans.pipeline import Source
from ..sources.tables import read_snapshot, write_snapshot
from .collection import Collection, DuplicateKey
from .validation import check_collection_name


class CommandError(ValueError):
    def __init__(self, code: int, name: str, message: str):
        super().__init__(message)
        self.code, self.name = code, name


#: First batch of a cursor and seconds until an idle one may go. Fixed values.
BATCH, CURSOR_SECONDS, SESSION_SECONDS = 101, 600, 1800


@dataclass
class Cursor:
    """A query's rows, fetched from the cluster as they are asked for."""

    id: int
    rows: object
    touched: float = field(default_factory=time.time)

    def batch(self, n: int) -> list[dict]:
        self.touched = time.time()
        return [r.asDict(recursive=True) for r in itertools.islice(self.rows, n)]


@dataclass
class Session:
    """One transaction at a time: versions staged per collection, swapped in on commit."""

    number: int = -1
    state: str = "none"
    staged: dict[str, Collection] = field(default_factory=dict)
    #: The collection that a version was staged from, and how many writes it had seen.
    base: dict[str, tuple[Collection, int]] = field(default_factory=dict)
    touched: float = field(default_factory=time.time)


class Database:
    def __init__(self, spark: SparkSession, root: str | None = None):
        """root: a folder for snapshots; without one, versions live in the session only."""
        self.spark, self.root = spark, root
        self.collections: dict[str, Collection] = {}
        self.cursors: dict[int, Cursor] = {}
        self.sessions: dict[str, Session] = {}
        self._next = itertools.count(1)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, tables: list[str], natural: dict[str, list[str]] | None = None) -> Database:
        db = cls(spark)
        for name in tables:
            db.register(name, spark.read.parquet(f"{folder}/{name}.parquet"), (natural or {}).get(name))
        return db

    # catalog

    def register(self, name: str, df: DataFrame, natural: list[str] | None = None) -> Collection:
        check_collection_name(name)
        keep = (lambda n, d: self._snapshot(n, d)) if self.root else None
        self.collections[name] = Collection(self.spark, name, df, natural, self._source, keep)
        return self.collections[name]

    def _snapshot(self, name: str, df: DataFrame) -> DataFrame:
        return self.spark.read.parquet(write_snapshot(df, f"{self.root}/{name}"))

    def open_snapshot(self, name: str, natural: list[str] | None = None) -> Collection:
        return self.register(name, read_snapshot(self.spark, f"{self.root}/{name}"), natural)

    def get(self, name: str) -> Collection | None:
        return self.collections.get(name)

    def collection(self, name: str) -> Collection:
        """The collection, made if it isn't there."""
        return self.collections.get(name) or self.register(name, None)

    def drop_collection(self, name: str) -> None:
        self.collections.pop(name, None)

    def list_collections(self) -> list[str]:
        return sorted(self.collections)

    def _source(self, name: str) -> Source | None:
        found = self.collections.get(name)
        return found.source() if found is not None else None

    def validate(self) -> dict:
        """Every unique index holds, and every plan resolves."""
        errors = []
        for name, c in self.collections.items():
            try:
                c._check_unique(c.df)
            except DuplicateKey as e:
                errors.append(f"{name}: {e}")
        return {"valid": not errors, "errors": errors}

    # commands

    def run_command(self, command: dict) -> dict:
        try:
            if not command:
                raise CommandError(59, "CommandNotFound", "no command")
            name = next(iter(command))
            run = getattr(self, f"_c_{name.lower()}", None)
            if run is None:
                raise CommandError(59, "CommandNotFound", f"no such command: {name}")
            return {**run(command[name], command), "ok": 1.0}
        except CommandError as e:
            return {"ok": 0.0, "code": e.code, "codeName": e.name, "errmsg": str(e)}
        except DuplicateKey as e:
            return {"ok": 0.0, "code": 11000, "codeName": "DuplicateKey", "errmsg": str(e)}
        except ValueError as e:
            return {"ok": 0.0, "code": 2, "codeName": "BadValue", "errmsg": str(e)}

    def _c_ping(self, x, c):
        return {}

    def _c_hello(self, x, c):
        return {"isWritablePrimary": True, "maxBsonObjectSize": 16 * 1024 * 1024, "maxWriteBatchSize": 100_000, "readOnly": False}

    def _c_ismaster(self, x, c):
        return {**self._c_hello(x, c), "ismaster": True}

    def _c_buildinfo(self, x, c):
        return {"version": self.spark.version, "engine": "spark"}

    def _c_listcollections(self, x, c):
        return {"cursor": {"id": 0, "firstBatch": [{"name": n, "type": "collection"} for n in self.list_collections()]}}

    def _writes(self, name: str, c: dict) -> Collection:
        if (session := self._transaction(c)) is None:
            return self.collection(name)
        if name not in session.staged:
            now = self.collection(name)
            session.staged[name] = Collection(self.spark, name, now._df, now.natural, self._source)
            session.staged[name].indexes = dict(now.indexes)
            session.base[name] = now, now._writes
        return session.staged[name]

    def _c_insert(self, name, c):
        target, done, errors = self._writes(name, c), 0, []
        docs = c.get("documents", [])
        try:
            target.insert(docs)
            done = len(docs)
        except DuplicateKey as e:
            errors = [{"index": 0, "code": 11000, "errmsg": str(e)}]
        return {"n": done, **({"writeErrors": errors} if errors else {})}

    def _c_find(self, name, c):
        found = self.get(name)
        if found is None:
            return {"cursor": {"id": 0, "ns": name, "firstBatch": []}}
        df = found.find(c.get("filter"), c.get("projection"), c.get("sort"), c.get("skip", 0), c.get("limit", 0))
        cursor = Cursor(next(self._next), df.toLocalIterator())
        size = c.get("batchSize", BATCH)
        first = cursor.batch(size)
        more = self._peek(cursor)
        if more:
            self.cursors[cursor.id] = cursor
        return {"cursor": {"id": cursor.id if more else 0, "ns": name, "firstBatch": first}}

    def _peek(self, cursor: Cursor) -> bool:
        row = next(cursor.rows, None)
        if row is not None:
            cursor.rows = itertools.chain([row], cursor.rows)
        return row is not None

    def _c_getmore(self, id_, c):
        cursor = self.cursors.get(id_)
        if cursor is None or time.time() - cursor.touched > CURSOR_SECONDS:
            self.cursors.pop(id_, None)
            raise CommandError(43, "CursorNotFound", f"no cursor {id_}")
        got = cursor.batch(c.get("batchSize", BATCH))
        more = self._peek(cursor)
        if not more:
            del self.cursors[id_]
        return {"cursor": {"id": id_ if more else 0, "ns": c.get("collection", ""), "nextBatch": got}}

    def _c_killcursors(self, name, c):
        ids = c.get("cursors", [])
        killed = [i for i in ids if self.cursors.pop(i, None)]
        return {"cursorsKilled": killed, "cursorsNotFound": [i for i in ids if i not in killed]}

    def _c_update(self, name, c):
        """Each statement changes one document."""
        target, n, modified, upserted = self._writes(name, c), 0, 0, []
        for i, u in enumerate(c.get("updates", [])):
            r = target.update_one(u.get("q", {}), u.get("u", {}), bool(u.get("upsert")))
            n, modified = n + r.matched_count + r.upserted_count, modified + r.modified_count
            upserted += [{"index": i, "_id": r.upserted_id}] if r.upserted_count else []
        return {"n": n, "nModified": modified, **({"upserted": upserted} if upserted else {})}

    def _c_delete(self, name, c):
        target = self._writes(name, c)
        return {"n": sum(target.delete_one(d.get("q", {})) if d.get("limit") == 1 else target.delete_many(d.get("q", {})) for d in c.get("deletes", []))}

    def _c_count(self, name, c):
        found = self.get(name)
        return {"n": found.count(c.get("query")) if found else 0}

    def _c_drop(self, name, c):
        self.drop_collection(name)
        return {}

    def _c_createindexes(self, name, c):
        target = self.collection(name)
        before = len(target.indexes)
        for x in c.get("indexes", []):
            target.create_index(x["key"], bool(x.get("unique")), x.get("name"))
        return {"numIndexesBefore": before, "numIndexesAfter": len(target.indexes)}

    def _known(self, name: str) -> Collection:
        if (found := self.get(name)) is None:
            raise CommandError(26, "NamespaceNotFound", f"no collection {name}")
        return found

    def _c_listindexes(self, name, c):
        return {"cursor": {"id": 0, "firstBatch": [{"name": i.name, "key": i.keys, "unique": i.unique} for i in self._known(name).list_indexes()]}}

    def _c_dropindexes(self, name, c):
        target, which = self._known(name), c.get("index")
        before = len(target.indexes)
        for n in [n for n in target.indexes if n != "_id_"] if which == "*" else [which]:
            target.drop_index(n)
        return {"nIndexesWas": before}

    def _c_aggregate(self, name, c):
        found = self.get(name)
        df = found.aggregate(c.get("pipeline", [])) if found else None
        return {"cursor": {"id": 0, "ns": name, "firstBatch": [r.asDict(recursive=True) for r in df.collect()] if df is not None else []}}

    def _c_distinct(self, name, c):
        found = self.get(name)
        return {"values": [r.value for r in found.distinct(c["key"], c.get("query")).collect()] if found else []}

    def _c_findandmodify(self, name, c):
        target = self.collection(name)
        value = target.find_and_modify(c.get("query", {}), c.get("update"), c.get("sort"), bool(c.get("remove")), bool(c.get("new")), bool(c.get("upsert")))
        return {"value": value, "lastErrorObject": {"n": int(value is not None)}}

    def _c_dbstats(self, x, c):
        return {"collections": len(self.collections), "objects": sum(k.count() for k in self.collections.values()), "indexes": sum(len(k.indexes) for k in self.collections.values())}

    def _c_collstats(self, name, c):
        found = self._known(name)
        return {"ns": name, "count": found.count(), "nindexes": len(found.indexes), "size": 0}

    def _c_serverstatus(self, x, c):
        return {"version": self.spark.version, "uptimeMillis": int(time.time() * 1000 - self.spark.sparkContext.startTime), "cursors": len(self.cursors)}

    def _c_connectionstatus(self, x, c):
        return {"authInfo": {"authenticatedUsers": [], "authenticatedUserRoles": []}}

    def _c_explain(self, command, c):
        inner = command if isinstance(command, dict) else {}
        name = inner.get("find") or inner.get("aggregate") or inner.get("count")
        found = self.get(name) if name else None
        if found is None:
            return {"queryPlanner": {"winningPlan": {"stage": "EOF"}}}
        if "aggregate" in inner:
            plan = found.aggregate(inner.get("pipeline", []))._jdf.queryExecution().toString()
        else:
            plan = found.explain(inner.get("filter", inner.get("query")), inner.get("sort"), inner.get("projection"))
        return {"queryPlanner": {"namespace": name, "winningPlan": {"stage": "SPARK", "plan": plan}}}

    def _c_validate(self, name, c):
        found = self._known(name)
        try:
            found._check_unique(found.df)
        except DuplicateKey as e:
            return {"ns": name, "valid": False, "errors": [str(e)]}
        return {"ns": name, "valid": True, "errors": [], "nrecords": found.count()}

    # sessions

    def start_session(self) -> str:
        id_ = f"session-{next(self._next)}"
        self.sessions[id_] = Session()
        return id_

    def _session(self, c: dict) -> Session:
        lsid = c.get("lsid")
        if lsid is None:
            raise CommandError(2, "BadValue", "lsid is needed")
        key = str(lsid.get("id") if isinstance(lsid, dict) else lsid)
        session = self.sessions.setdefault(key, Session())
        session.touched = time.time()
        return session

    def _transaction(self, c: dict) -> Session | None:
        """The session of a command that belongs to a transaction; a new number starts one."""
        if c.get("autocommit") is not False or "lsid" not in c:
            return None
        session, number = self._session(c), c.get("txnNumber", 0)
        if number < session.number:
            raise CommandError(225, "TransactionTooOld", f"transaction {number} is older than {session.number}")
        if number > session.number:
            session.number, session.state, session.staged, session.base = number, "open", {}, {}
        if session.state != "open":
            raise CommandError(251, "NoSuchTransaction", f"transaction {number} has ended")
        return session

    def _c_starttransaction(self, x, c):
        self._transaction({**c, "autocommit": False, "txnNumber": c.get("txnNumber", self._session(c).number + 1)})
        return {}

    def _end(self, c: dict, state: str) -> Session:
        session = self._session(c)
        if "txnNumber" in c and c["txnNumber"] != session.number or session.state == "none":
            raise CommandError(251, "NoSuchTransaction", "no such transaction")
        if session.state not in ("open", state):
            raise CommandError(256 if state == "aborted" else 251, "NoSuchTransaction", f"transaction was {session.state}")
        return session

    def _c_committransaction(self, x, c):
        """Swaps the staged versions in, all or none: a collection that others wrote since it was staged is a conflict, which ends
        the transaction. A second commit of the same transaction does nothing."""
        session = self._end(c, "committed")
        if session.state == "open":
            targets = {name: self.collection(name) for name in sorted(session.staged)}
            with ExitStack() as locks:
                for target in targets.values():
                    locks.enter_context(target.lock)
                if stale := [name for name, target in targets.items() if session.base[name] != (target, target._writes)]:
                    session.state, session.staged, session.base = "aborted", {}, {}
                    raise CommandError(112, "WriteConflict", f"written by others since: {', '.join(stale)}")
                for name, target in targets.items():
                    target._replace(session.staged[name].df)
                    target.indexes = session.staged[name].indexes
        session.state, session.staged, session.base = "committed", {}, {}
        return {}

    def _c_aborttransaction(self, x, c):
        session = self._end(c, "aborted")
        session.state, session.staged, session.base = "aborted", {}, {}
        return {}

    def _c_endsessions(self, ids, c):
        for x in ids or []:
            self.sessions.pop(str(x.get("id") if isinstance(x, dict) else x), None)
        return {}

    def _c_refreshsessions(self, ids, c):
        for x in ids or []:
            self._session({"lsid": x})
        now = time.time()
        self.sessions = {k: s for k, s in self.sessions.items() if now - s.touched < SESSION_SECONDS}
        return {}
