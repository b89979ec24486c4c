"""Catalog of tenants, databases and collections, with versions, forks and conditional commits.

Each collection has an append-only log (Parquet folders named by their first offset), immutable segment snapshots (one Parquet
folder per version) and numbered version documents, the newest of which is the collection's state. A commit creates the next
version document; creation fails if another writer was first (``Storage.write``), so commits are atomic and no update is lost.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import metadata as M
from ..functions.distance import SPACES
from ..operators.cells import CellIndex
from .storage import Storage

DEFAULT_TENANT, DEFAULT_DATABASE = "default_tenant", "default_database"
LOG_SCHEMA = "id string, log_offset bigint, op string, document string, embedding array<float>, metadata string"
SEGMENT_SCHEMA = "id string, offset_id bigint, document string, embedding array<float>, metadata string"


class CatalogError(ValueError):
    """Something is missing, exists already or was changed meanwhile."""


class Conflict(CatalogError):
    """Another commit came first."""


@dataclass(frozen=True)
class Version:
    """State of a collection: what is folded (``segment``, up to ``log_position``) and where its log begins and ends."""

    id: str
    name: str
    tenant: str
    database: str
    version: int = 0
    metadata: dict[str, Any] = field(default_factory=dict)
    config: dict[str, Any] = field(default_factory=dict)
    dimension: int | None = None
    log_position: int = 0
    log_end: int = 0
    logs: tuple[str, ...] = ()
    segment: str | None = None
    index: str | None = None
    total_records: int = 0
    forked_from: str | None = None
    functions: dict[str, dict[str, Any]] = field(default_factory=dict)
    deleted: bool = False


def check_name(name: str) -> None:
    """Raise CatalogError unless the name has 3 to 512 characters of [a-zA-Z0-9._-], begins and ends with a letter or digit, has
    no ``..`` and is no IP address."""
    if not 3 <= len(name) <= 512 or not re.fullmatch(r"[a-zA-Z0-9][a-zA-Z0-9._-]*[a-zA-Z0-9]", name) or ".." in name or re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", name):
        raise CatalogError(f"bad collection name {name!r}")


#: Options of a graph index (name: smallest value); they are checked and kept, and change nothing: such searches are exact.
GRAPH = {"ef_construction": 1, "ef_search": 1, "max_neighbors": 1, "num_threads": 1, "batch_size": 2, "sync_threshold": 2, "resize_factor": 1}
#: Options of the cell index (name: smallest value).
CELLS = {"cell_rows": 1, "probes": 1, "rerank": 1, "replicas": 1, "epsilon": 0}


def check_config(config: Mapping[str, Any]) -> None:
    """Raise CatalogError for an unknown space, and for unknown or too small options of an index (``graph`` or ``index``)."""
    if config.get("space", "l2") not in SPACES:
        raise CatalogError(f"unknown space {config['space']!r}; one of {SPACES}")
    for name, known in (("graph", GRAPH), ("index", CELLS)):
        for k, v in (config.get(name) or {}).items():
            if k not in known:
                raise CatalogError(f"unknown option {k!r} of {name!r}; known: {', '.join(known)}")
            if v is None and k == "rerank":
                continue
            kinds = (int, float) if k in ("epsilon", "resize_factor") else int
            if isinstance(v, bool) or not isinstance(v, kinds) or v < known[k]:
                raise CatalogError(f"{k} must be a number of at least {known[k]}, not {v!r}")


class Catalog:
    """All collections under a root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store = spark, Storage(spark, root)
        if not self.store.exists("tenants", DEFAULT_TENANT, DEFAULT_DATABASE, "_database.json"):
            self.create_tenant(DEFAULT_TENANT, exist_ok=True)
            self.create_database(DEFAULT_DATABASE, exist_ok=True)

    # tenants and databases
    def create_tenant(self, name: str, exist_ok: bool = False) -> None:
        if not self.store.write({"name": name}, "tenants", name, "_tenant.json") and not exist_ok:
            raise CatalogError(f"tenant {name!r} exists")

    def create_database(self, name: str, tenant: str = DEFAULT_TENANT, exist_ok: bool = False) -> None:
        if not self.store.exists("tenants", tenant, "_tenant.json"):
            raise CatalogError(f"no tenant {tenant!r}")
        if not self.store.write({"name": name, "tenant": tenant}, "tenants", tenant, name, "_database.json") and not exist_ok:
            raise CatalogError(f"database {name!r} exists")

    def list_databases(self, tenant: str = DEFAULT_TENANT) -> list[str]:
        return [d for d in self.store.list("tenants", tenant) if d != "_tenant.json"]

    def delete_database(self, name: str, tenant: str = DEFAULT_TENANT) -> None:
        self._need_database(name, tenant)
        for c in self.list_collections(tenant=tenant, database=name):
            self.delete_collection(c.name, tenant, name)
        self.store.delete("tenants", tenant, name)

    def _need_database(self, database: str, tenant: str) -> None:
        if not self.store.exists("tenants", tenant, database, "_database.json"):
            raise CatalogError(f"no database {database!r} of tenant {tenant!r}")

    # collections
    def _pointer(self, name: str, tenant: str, database: str) -> tuple[str, ...]:
        return ("tenants", tenant, database, f"{name}.json")

    def create_collection(self, name: str, metadata: Mapping[str, Any] | None = None, config: Mapping[str, Any] | None = None, get_or_create: bool = False, tenant: str = DEFAULT_TENANT, database: str = DEFAULT_DATABASE) -> Version:
        check_name(name)
        self._need_database(database, tenant)
        M.validate(metadata or {})
        check_config(config or {})
        v = Version(uuid.uuid4().hex, name, tenant, database, metadata=dict(metadata or {}), config=dict(config or {}))
        self._write_version(v)
        if not self.store.write({"id": v.id}, *self._pointer(name, tenant, database)):
            self.store.delete("collections", v.id)
            if get_or_create:
                return self.get_collection(name, tenant, database)
            raise CatalogError(f"collection {name!r} exists")
        return v

    def _write_version(self, v: Version) -> None:
        if not self.store.write(asdict(v), "collections", v.id, "versions", f"{v.version:012d}.json"):
            raise Conflict(f"version {v.version} of {v.name!r} was committed by another writer")

    def versions(self, id: str) -> list[int]:
        """Kept version numbers, oldest first."""
        return [int(n[:-5]) for n in self.store.list("collections", id, "versions") if n.endswith(".json")]

    def at_version(self, id: str, version: int | None = None) -> Version:
        """State of a collection, by default the newest."""
        kept = self.versions(id)
        if not kept or (version is not None and version not in kept):
            raise CatalogError(f"no version {version} of collection {id!r}")
        d = self.store.read("collections", id, "versions", f"{kept[-1] if version is None else version:012d}.json")
        return Version(**{**d, "logs": tuple(d["logs"])})

    def get_collection(self, name: str, tenant: str = DEFAULT_TENANT, database: str = DEFAULT_DATABASE) -> Version:
        pointer = self._pointer(name, tenant, database)
        if not self.store.exists(*pointer):
            raise CatalogError(f"no collection {name!r}")
        return self.at_version(self.store.read(*pointer)["id"])

    def list_collections(self, limit: int | None = None, offset: int = 0, tenant: str = DEFAULT_TENANT, database: str = DEFAULT_DATABASE) -> list[Version]:
        self._need_database(database, tenant)
        names = [n[:-5] for n in self.store.list("tenants", tenant, database) if n.endswith(".json") and not n.startswith("_")]
        return [self.get_collection(n, tenant, database) for n in names[offset : None if limit is None else offset + limit]]

    def count_collections(self, tenant: str = DEFAULT_TENANT, database: str = DEFAULT_DATABASE) -> int:
        return sum(n.endswith(".json") and not n.startswith("_") for n in self.store.list("tenants", tenant, database))

    def commit(self, old: Version, **changes: Any) -> Version:
        """The next version of a collection; Conflict if ``old`` is not the newest any more."""
        new = replace(old, version=old.version + 1, **changes)
        if self.versions(old.id)[-1] != old.version:
            raise Conflict(f"{old.name!r} was changed after version {old.version}")
        self._write_version(new)
        return new

    def modify_collection(self, v: Version, name: str | None = None, metadata: Mapping[str, Any] | None = None) -> Version:
        """Rename a collection or replace its metadata."""
        M.validate(metadata or {})
        if name is not None and name != v.name:
            check_name(name)
            if not self.store.write({"id": v.id}, *self._pointer(name, v.tenant, v.database)):
                raise CatalogError(f"collection {name!r} exists")
            self.store.delete(*self._pointer(v.name, v.tenant, v.database))
        return self.commit(v, name=name or v.name, metadata=dict(v.metadata if metadata is None else metadata))

    def delete_collection(self, name: str, tenant: str = DEFAULT_TENANT, database: str = DEFAULT_DATABASE) -> None:
        """Take a collection out of the catalog; its files stay until ``collect_garbage``."""
        v = self.get_collection(name, tenant, database)
        self.commit(v, deleted=True)
        self.store.delete(*self._pointer(name, tenant, database))

    def fork(self, v: Version, name: str) -> Version:
        """A collection of its own that starts from the same files."""
        check_name(name)
        f = replace(v, id=uuid.uuid4().hex, name=name, version=0, forked_from=v.id, functions={})
        self._write_version(f)
        if not self.store.write({"id": f.id}, *self._pointer(name, v.tenant, v.database)):
            self.store.delete("collections", f.id)
            raise CatalogError(f"collection {name!r} exists")
        return f

    def fork_count(self, id: str) -> int:
        """Number of live collections forked from this one."""
        return sum(self.at_version(c).forked_from == id and not self.at_version(c).deleted for c in self.store.list("collections"))

    def restore(self, v: Version, version: int) -> Version:
        """A new version with the contents of an older one."""
        old = self.at_version(v.id, version)
        keep = ("metadata", "dimension", "log_position", "log_end", "logs", "segment", "index", "total_records")
        return self.commit(v, **{k: getattr(old, k) for k in keep})

    def collect_garbage(self, keep: int = 2, older_than: float = 86_400.0) -> list[str]:
        """Drop all but the last ``keep`` versions of each collection, and the files that no kept version of any names.

        Files that were changed within ``older_than`` seconds stay: a writer may have them ready for a commit.
        """
        ids, used, dropped = self.store.list("collections"), set(), []
        for c in ids:
            kept = self.versions(c)
            dead = self.at_version(c).deleted if kept else True
            for n in kept if dead else kept[:-keep]:
                self.store.delete("collections", c, "versions", f"{n:012d}.json")
            for n in [] if dead else kept[-keep:]:
                v = self.at_version(c, n)
                used.update(v.logs, [x for x in (v.segment, v.index) if x], [f["output"] for f in v.functions.values() if f.get("output")])
        for kind in ("logs", "segments", "indexes", "functions"):
            for n in self.store.list(kind):
                if f"{kind}/{n}" not in used and self.store.age(kind, n) >= older_than:
                    self.store.delete(kind, n)
                    dropped.append(f"{kind}/{n}")
        for c in ids:
            if not self.versions(c) and self.store.age("collections", c) >= older_than:
                self.store.delete("collections", c)
        return dropped

    # data of a version
    def read_log(self, v: Version) -> DataFrame:
        """The rows of the log that are not folded yet, up to the version's end."""
        paths = [self.store.path(p) for p in v.logs]
        df = self.spark.read.schema(LOG_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], LOG_SCHEMA)
        return df.filter(f"log_offset > {v.log_position} and log_offset <= {v.log_end}")

    def read_segment(self, v: Version) -> DataFrame:
        """The folded records."""
        return self.spark.read.schema(SEGMENT_SCHEMA).parquet(self.store.path(v.segment)) if v.segment else self.spark.createDataFrame([], SEGMENT_SCHEMA)

    def write_log(self, rows: DataFrame) -> str:
        """Write log rows as a new file set and give its name; a commit makes it part of a collection."""
        name = f"logs/{uuid.uuid4().hex}"
        rows.select("id", "log_offset", "op", "document", "embedding", "metadata").write.parquet(self.store.path(name))
        return name

    def read_index(self, v: Version) -> CellIndex | None:
        """The cell index over the folded records, if there is one; its ids are offset ids."""
        return CellIndex.read(self.spark, self.store.path(v.index)) if v.index else None

    def write_index(self, index: CellIndex) -> str:
        """Write a cell index and give its name."""
        name = f"indexes/{uuid.uuid4().hex}"
        index.write(self.store.path(name))
        return name

    def write_segment(self, rows: DataFrame) -> str:
        """Write a snapshot of records and give its name."""
        name = f"segments/{uuid.uuid4().hex}"
        rows.select("id", "offset_id", "document", "embedding", "metadata").write.parquet(self.store.path(name))
        return name
