"""Stored chunks, embeddings, indexes and the catalog: Parquet tables with manifests.

Each table keeps versions side by side. A version is a short log of parts: added
rows, and keys removed from the parts before them. Changing a table writes only what
is new; a log of more than ``LONG_LOG`` parts is rewritten as one. A version is
complete once its manifest row is committed by Spark's writer, so readers see whole
versions only, and a failed write leaves the last one in place.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incremental import one_per_key

LONG_LOG = 24
_MANIFEST = "version string, rows long, dimension int, created_at string, parts array<struct<path:string, removes:string, rows:long, checksum:long>>, properties map<string,string>"


class IntegrityError(ValueError):
    """A stored table is not what its manifest says."""


def checksum(rows: DataFrame, *columns: str) -> tuple[int, int]:
    """Row count and an order-free checksum."""
    h = F.xxhash64(*[F.col(c) for c in (columns or rows.columns)])
    # The sum tells apart what pairs of equal rows hide from the exclusive or.
    total = F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)).cast("string")
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.xxhash64(F.coalesce(F.bit_xor(h), F.lit(0)), total).alias("x")).first()
    return r["n"], r["x"]


class Tables:
    """Named tables under one folder, of kinds such as chunks, embeddings, indexes or catalog."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._verified: set[str] = set()

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, kind: str, name: str) -> str:
        if not name or "/" in name or name.startswith((".", "_")):
            raise ValueError(f"bad name {name!r}")
        return f"{self.root}/{kind}/{name}"

    def _write(self, at: str, rows: DataFrame, vector: str | None = None, removes: str | None = None) -> tuple[tuple, int | None]:
        """Writes a part; its entry in the log, and the dimension of its vectors."""
        path = f"{'gone' if removes else 'data'}/v{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:6]}"
        rows.write.parquet(f"{at}/{path}")
        stored = self.spark.read.parquet(f"{at}/{path}")
        n, x = checksum(stored)
        dimension = None
        if vector and n:
            d = stored.agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
            if d["a"] != d["b"]:
                self._delete(f"{at}/{path}")
                raise ValueError("vectors differ in dimension")
            dimension = d["a"]
        return (path, removes, n, x), dimension

    def _commit(self, at: str, parts: list[tuple], rows: int, dimension: int | None, properties: dict) -> dict:
        row = (f"v{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:6]}", rows, dimension, datetime.now(timezone.utc).isoformat(), parts, {k: str(v) for k, v in properties.items()})
        made = self.spark.createDataFrame([row], _MANIFEST)
        made.coalesce(1).write.mode("append").parquet(f"{at}/manifest")
        return made.first().asDict(recursive=True)

    def save(self, kind: str, name: str, rows: DataFrame, vector: str | None = None, **properties) -> dict:
        """Writes a new version of one part, with a manifest: rows, checksum, dimension and the given properties."""
        at = self._path(kind, name)
        part, dimension = self._write(at, rows, vector)
        return self._commit(at, [part], part[2], dimension, properties)

    def change(self, kind: str, name: str, added: DataFrame, removed: DataFrame | None = None, key: str | None = None, vector: str | None = None, **properties) -> dict:
        """A new version: without the rows whose ``key`` is in ``removed``, and with ``added``; only these are written."""
        info = self.info(kind, name)
        if info is None:
            return self.save(kind, name, added, vector, **properties)
        at = self._path(kind, name)
        parts, live = [tuple(p.values()) for p in info["parts"]], info["rows"]
        if removed is not None:
            gone = removed.select(key).where(F.col(key).isNotNull()).distinct()
            hit = self.load(kind, name).select(key).join(gone, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n")).persist()
            count = hit.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            if count:
                live -= count
                parts.append(self._write(at, hit.select(key), removes=key)[0])
            hit.unpersist()
        part, dimension = self._write(at, added, vector)
        if dimension and info["dimension"] and dimension != info["dimension"]:
            self._delete(f"{at}/{part[0]}")
            raise ValueError("vectors differ in dimension")
        made = self._commit(at, [*parts, part], live + part[2], dimension or info["dimension"], info["properties"] | properties)
        return self.save(kind, name, self.load(kind, name), vector, **made["properties"]) if len(made["parts"]) > LONG_LOG else made

    def exists(self, kind: str, name: str) -> bool:
        p, fs = self._fs(f"{self._path(kind, name)}/manifest")
        return fs.exists(p)

    def info(self, kind: str, name: str) -> dict | None:
        """The manifest of the last version."""
        if not self.exists(kind, name):
            return None
        r = self.spark.read.parquet(f"{self._path(kind, name)}/manifest").orderBy(F.desc("version")).first()
        return None if r is None else r.asDict(recursive=True)

    def load(self, kind: str, name: str, verify: bool = False) -> DataFrame:
        """The last version; ``verify`` compares each part's count and checksum with the manifest, once for each part."""
        info = self.info(kind, name)
        if info is None:
            raise FileNotFoundError(f"no {kind} named {name!r}")
        rows = None
        for p in info["parts"]:
            at = f"{self._path(kind, name)}/{p['path']}"
            part = self.spark.read.parquet(at)
            if verify and at not in self._verified:
                if checksum(part) != (p["rows"], p["checksum"]):
                    raise IntegrityError(f"{kind} {name!r} does not match its manifest")
                self._verified.add(at)
            if p["removes"]:
                rows = rows.join(part, p["removes"], "left_anti").select(*rows.columns)
            else:
                rows = part if rows is None else rows.unionByName(part)
        return rows

    def list(self, kind: str) -> list[str]:
        p, fs = self._fs(f"{self.root}/{kind}")
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
        return [n for n in names if self.exists(kind, n)]

    def _delete(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.delete(p, True)

    def delete(self, kind: str, name: str) -> bool:
        return self._delete(self._path(kind, name))

    def prune(self, kind: str, name: str, keep: int = 1) -> int:
        """Removes the parts that none of the last ``keep`` versions uses."""
        at = self._path(kind, name)
        logs = [[p["path"] for p in r["parts"]] for r in self.spark.read.parquet(f"{at}/manifest").orderBy(F.desc("version")).select("parts").collect()]
        used = {p for log in logs[:keep] for p in log}
        return sum(bool(self._delete(f"{at}/{p}")) for p in {p for log in logs for p in log} - used)

    def upsert(self, kind: str, name: str, new: DataFrame, key: str = "chunk_id", vector: str | None = None, **properties) -> dict:
        """Replaces rows of equal key and adds the others; of equal keys in ``new`` one stays, as in ``incremental.one_per_key``."""
        new = one_per_key(new, key)
        return self.change(kind, name, new, new, key, vector, **properties)


def validation(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """What a loader checks: rows, least and largest dimension, vectors with a bad number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return rows.agg(F.count(F.lit(1)).alias("num_rows"), F.min(F.size(vector)).alias("min_dim"), F.max(F.size(vector)).alias("max_dim"), F.coalesce(F.sum(bad.cast("int")), F.lit(0)).alias("bad_vectors"))
