"""The keyed memory as a client object, with its text commands and request paths.

Changes are buffered on the driver and merged into the table in batches; every
read merges first.  For bulk loads use set_batch with a DataFrame.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import code, keyed, search, vectors
from quillstone.sources.staging import staged

_SCHEMA = "key string, value string, ttl_ms long, written_at long, access_time long, expire_at long, permanent boolean, deleted boolean, version long"
#: Merges after which the table is staged anew, so that plans stay short.
STAGE_EVERY = 8


class Cache:
    """key -> text with time to live, namespaces, searches and vectors.

    `clock` gives the current milliseconds (the wall clock by default); max_memory
    in bytes, 0 for unlimited, is kept by least-recently-used retention."""

    def __init__(self, spark: SparkSession, path: str | None = None, max_memory: int = 0, clock=None):
        self.spark, self.path, self.max_memory = spark, path, max_memory
        self.clock = clock or (lambda: int(time.time() * 1000))
        self._pending: list[tuple] = []
        self._version, self._merges = 0, 0
        self.frame = spark.createDataFrame([], _SCHEMA)
        self.vectors = spark.createDataFrame([], "key string, embedding array<float>")
        if path:
            from quillstone.sources.snapshots import current, read_snapshot

            if current(spark, path):
                tables = read_snapshot(spark, path)
                self.frame, self.vectors = tables["entries"], tables["vectors"]
                self._version = self.frame.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    # writing
    def set(self, key: str, value: str, ttl: int = 0) -> None:
        if not 0 < len(key.encode()) <= keyed.MAX_KEY or len(value.encode()) > keyed.MAX_VALUE:
            raise ValueError("the key or the value is too long, or the key empty")
        now = self.clock()
        self._version += 1
        self._pending.append((key, value, ttl, now, now, now + ttl if ttl else 0, ttl == 0, False, self._version))

    def set_batch(self, rows: DataFrame, ttl: int = 0) -> None:
        """Upserts all rows of a frame (key, value)."""
        self._version += 1
        made = keyed.entries(rows, F.col("key"), F.col("value"), F.lit(self.clock()), ttl, F.lit(self._version))
        self._merge(keyed.valid_sizes(made))

    def delete(self, key: str) -> bool:
        if key not in self:
            return False
        now = self.clock()
        self._version += 1
        self._pending.append((key, "", 0, now, now, 0, True, True, self._version))
        return True

    def _merge(self, changes: DataFrame) -> None:
        # Identical versions within a batch are settled by order, so the buffer goes first.
        if self._pending:
            buffered, self._pending = self.spark.createDataFrame(self._pending, _SCHEMA), []
            changes = buffered if changes is None else buffered.unionByName(changes)
        if changes is None:
            return
        self.frame = keyed.upsert(self.frame, changes)
        if self.max_memory:
            self.frame = keyed.retained(self.frame.where(~F.col("deleted")), self.max_memory)
        self._merges += 1
        if self._merges % STAGE_EVERY == 0:
            self.frame = staged(self.frame, "cache")

    def table(self) -> DataFrame:
        """All entries, the buffered ones too."""
        self._merge(None)
        return self.frame

    # reading
    def get(self, key: str, default: str | None = None) -> str | None:
        rows = keyed.get(self.table(), key, self.clock()).take(1)
        if rows:
            self.touch(key)
        return rows[0].value if rows else default

    def __getitem__(self, key: str) -> str:
        value = self.get(key)
        if value is None:
            raise KeyError(key)
        return value

    def __setitem__(self, key: str, value: str) -> None:
        self.set(key, value)

    def __delitem__(self, key: str) -> None:
        if not self.delete(key):
            raise KeyError(key)

    def __contains__(self, key: str) -> bool:
        return keyed.exists(self.table(), key, self.clock()).first().found

    def __len__(self) -> int:
        return self.count()

    def count(self) -> int:
        return keyed.live(self.table(), self.clock()).count()

    def memory_used(self) -> int:
        return keyed.memory_used(keyed.live(self.table(), self.clock())).first().memory_used

    def set_json(self, key: str, value, ttl: int = 0) -> None:
        self.set(key, json.dumps(value, ensure_ascii=False), ttl)

    def get_json(self, key: str, default=None):
        value = self.get(key)
        return default if value is None else json.loads(value)

    # namespaces
    def set_ns(self, namespace: str, key: str, value: str, ttl: int = 0) -> None:
        self.set(keyed.full_key(namespace, key), value, ttl)

    def get_ns(self, namespace: str, key: str) -> str | None:
        return self.get(keyed.full_key(namespace, key))

    def delete_ns(self, namespace: str) -> int:
        """Deletes all entries below a namespace; returns how many."""
        before = self.count()
        self.frame = keyed.delete_namespace(self.table(), namespace)
        return before - self.count()

    def items(self, namespace: str | None = None) -> Iterator[tuple[str, str]]:
        for row in keyed.iterate(self.table(), self.clock(), namespace).select("key", "value").toLocalIterator():
            yield row.key, row.value

    def keys(self) -> Iterator[str]:
        return (k for k, _ in self.items())

    def values(self) -> Iterator[str]:
        return (v for _, v in self.items())

    # searches, as frames
    def search_prefix(self, prefix: str, **options) -> DataFrame:
        return search.prefix(self.table(), prefix, self.clock(), search.Options(**options))

    def search_range(self, start: str, end: str, **options) -> DataFrame:
        return search.between(self.table(), start, end, self.clock(), search.Options(**options))

    def search_regex(self, pattern: str, **options) -> DataFrame:
        return search.pattern(self.table(), pattern, self.clock(), search.Options(**options))

    def search_fuzzy(self, target: str, **options) -> DataFrame:
        return search.fuzzy(self.table(), target, self.clock(), search.Options(**options))

    def search_tag(self, tag: str, **options) -> DataFrame:
        return search.tag(self.table(), tag, self.clock(), search.Options(**options))

    def search_structure(self, query: str, **options) -> DataFrame:
        return search.structure(self.table(), query, self.clock(), search.Options(**options))

    def set_vector(self, key: str, content: str, vector: list[float], ttl: int = 0) -> None:
        if not 0 < len(vector) <= vectors.MAX_DIM:
            raise ValueError("a vector has 1 to 1536 dimensions")
        self.set(key, content, ttl)
        new = self.spark.createDataFrame([(key, [float(x) for x in vector])], "key string, embedding array<float>")
        self.vectors = self.vectors.where(F.col("key") != key).unionByName(new)

    def get_vector(self, key: str) -> list[float] | None:
        row = self.vectors.join(keyed.get(self.table(), key, self.clock()).select("key"), "key").first()
        return row.embedding if row else None

    def search_vector(self, vector: list[float], k: int = 10, query_text: str | None = None, min_score: float | None = None) -> DataFrame:
        rows = vectors.vector_entries(keyed.live(self.table(), self.clock()), self.vectors)
        if query_text:
            return vectors.hybrid_top_k(rows, vector, query_text, k)
        return vectors.exact_top_k(rows, vector, k, min_score)

    def context(self, namespace: str, name: str) -> DataFrame:
        return code.context(keyed.live(self.table(), self.clock()), namespace, name)

    # time and upkeep
    def expire(self, key: str) -> None:
        self.frame = keyed.expire(self.table(), key, self.clock())

    def touch(self, key: str) -> None:
        self.frame = keyed.touch(self.table(), key, self.clock())

    def purge_expired(self) -> int:
        before = self.table().count()
        self.frame = keyed.purge_expired(self.frame, self.clock())
        return before - self.frame.count()

    def compact(self) -> int:
        """Drops deleted and expired entries; returns how many stay."""
        self.frame = staged(keyed.live(self.table(), self.clock()), "cache")
        return self.frame.count()

    def stats(self) -> dict[str, int]:
        row = keyed.stats(self.table(), self.clock()).first()
        return {"count": row.entries, "memory_used": row.memory_used, "memory_max": self.max_memory}

    def sync(self) -> str:
        """Writes a snapshot; returns its version."""
        from quillstone.sources.snapshots import write_snapshot

        return write_snapshot(self.spark, self.path, {"entries": self.table(), "vectors": self.vectors})

    def close(self) -> None:
        if self.path:
            self.sync()

    # protocols, without their transport
    def execute(self, line: str) -> str:
        """A text command: PING, SET key value, GET, DEL, EXISTS, COUNT, SEARCH type query, STATS, SYNC, QUIT."""
        command, _, rest = line.strip().partition(" ")
        command = command.upper()
        if command == "PING":
            return "+PONG"
        if command == "SET" and " " in rest:
            key, _, value = rest.partition(" ")
            self.set(key, value)
            return "+OK"
        if command == "GET" and rest:
            value = self.get(rest)
            return "$-1" if value is None else f"${len(value.encode())}\n{value}"
        if command == "DEL" and rest:
            return f":{int(self.delete(rest))}"
        if command == "EXISTS" and rest:
            return f":{int(rest in self)}"
        if command == "COUNT":
            return f":{self.count()}"
        if command == "SEARCH" and " " in rest:
            kind, _, query = rest.partition(" ")
            rows = search.serve(self.table(), {"type": kind.lower(), "q": query}, self.clock()).collect()
            return "\n".join([f"*{len(rows)}", *(f"{r.key}\t{r.score:.6f}" for r in rows)])
        if command == "STATS":
            return " ".join(f"{k}={v}" for k, v in self.stats().items())
        if command == "SYNC":
            if self.path:
                self.sync()
            return "+OK"
        return "+BYE" if command == "QUIT" else "-ERR"

    def request(self, method: str, path: str, parameters: dict[str, str] | None = None, body: str = "") -> tuple[int, dict]:
        """A request's status and JSON body: /health, /stats, /search, /namespaces, /namespace/:ns, /batch, /sync,
        /cache/:key and /cache/:key/exists, also under /api/v1."""
        path, parameters = path.removeprefix("/api/v1"), parameters or {}
        if path == "/health":
            return 200, {"status": "ok"}
        if path == "/stats":
            return 200, self.stats()
        if path == "/search":
            if not parameters.get("q"):
                return 400, {"error": "q is missing"}
            rows = search.serve(self.table(), parameters, self.clock()).collect()
            return 200, {"count": len(rows), "results": [{"key": r.key, "value": r.value, "score": r.score} for r in rows]}
        if path == "/namespaces":
            return 200, {"namespaces": [r.namespace for r in keyed.namespaces(keyed.live(self.table(), self.clock())).orderBy("namespace").collect()]}
        if path.startswith("/namespace/"):
            rows = keyed.live(self.table(), self.clock()).where(F.col("key").startswith(path.removeprefix("/namespace/") + ":")).select("key").orderBy("key").collect()
            return 200, {"count": len(rows), "keys": [r.key for r in rows]}
        if path == "/batch" and method == "POST":
            entries = json.loads(body).get("entries", [])
            for entry in entries:
                self.set(entry["key"], entry["value"], int(entry.get("ttl", 0)))
            return 200, {"stored": len(entries)}
        if path == "/sync" and method == "POST":
            if self.path:
                self.sync()
            return 200, {"status": "ok"}
        if path.startswith("/cache/"):
            key = path.removeprefix("/cache/")
            if key.endswith("/exists"):
                return 200, {"exists": key.removesuffix("/exists") in self}
            if method == "GET":
                value = self.get(key)
                return (404, {"error": "not found"}) if value is None else (200, {"key": key, "value": value})
            if method in ("PUT", "POST"):
                entry = json.loads(body)
                self.set(key, entry["value"], int(entry.get("ttl", 0)))
                return 200, {"status": "ok"}
            if method == "DELETE":
                return (200, {"status": "ok"}) if self.delete(key) else (404, {"error": "not found"})
        return 404, {"error": "no such path"}
