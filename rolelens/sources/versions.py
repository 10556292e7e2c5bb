"""Tables that change by commits: Parquet folders written aside, and one small manifest per version.

Data is written to a folder of its own first. A commit then adds the manifest of the next version, which
lists the folders that make up the table. Adding it either succeeds or finds that another writer was
first, who is then taken into account; so no update is lost, a failed write leaves the table as it was,
a reader always sees one whole version, and former versions stay readable. A load has an id: committing it
again changes nothing. A manifest may also name single files of its folders that no longer belong to the table.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolelens.operators.quality import dedupe
from rolelens.session import ensure_checkpoint_dir

_MANIFESTS = "_manifests"
#: Conflicts with other writers after which a commit gives up.
ATTEMPTS = 100

State = tuple[int, list[list]]  # version, [folder, version that added it] of each folder


class VersionedTable:
    """A table at ``path``, a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self._jvm = jvm

    # --- manifests ---

    def _manifest(self, version: int) -> str:
        return f"{self.path}/{_MANIFESTS}/{version:012d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/{_MANIFESTS}")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _read(self, version: int) -> dict:
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _latest(self) -> dict:
        versions = self.versions()
        return self._read(versions[-1]) if versions else {"version": 0, "folders": [], "loads": []}

    def _add(self, manifest: dict) -> bool:
        """Make a manifest visible under its version, or find that there is one."""
        final = self._manifest(manifest["version"])
        aside = f"{self.path}/{_MANIFESTS}/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(aside), False)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self._path(final).toUri().getScheme() in (None, "file") and self._fs.getUri().getScheme() == "file":
            try:  # a local rename would overwrite
                os.link(self._path(aside).toUri().getPath(), self._path(final).toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(self._path(aside), False)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self._conf)
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(options, 0)
        try:
            context.rename(self._path(aside), self._path(final), none)
            return True
        except Exception:
            if not self._fs.exists(self._path(final)):
                raise
            self._fs.delete(self._path(aside), False)
            return False

    # --- reading ---

    def read(self, version: int | None = None, versioned: bool = False) -> DataFrame:
        """The table's rows in its last version, or a former one; with ``versioned`` also the version (``_version``)
        that added each row."""
        if version is not None and version not in self.versions():
            raise ValueError(f"{self.path} has no version {version}")
        return self._rows(self._latest() if version is None else self._read(version), versioned)

    def _paths(self, manifest: dict) -> list[str]:
        """The folders of a version, and the files that are left of folders that lost some."""
        removed = set(manifest.get("removed", []))
        changed = {name.partition("/")[0] for name in removed}
        paths = []
        for name, _ in manifest["folders"]:
            folder = f"{self.path}/{name}"
            if name not in changed:
                paths.append(folder)
                continue
            files = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]
            data = [f for f in files if not f.startswith(("_", "."))]
            paths += [f"{folder}/{f}" for f in data if f"{name}/{f}" not in removed]
        return paths

    def _rows(self, manifest: dict, versioned: bool) -> DataFrame:
        folders, paths = manifest["folders"], self._paths(manifest)
        extra = [T.StructField("_version", T.LongType())] if versioned else []
        if not paths:
            return self.spark.createDataFrame([], T.StructType([*self.schema, *extra]))
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        if not versioned:
            return rows
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        added = self.spark.createDataFrame([tuple(f) for f in folders], "_folder string, _version long")
        return rows.withColumn("_folder", name).join(added, "_folder").select(*self.schema.names, "_version")

    # --- writing ---

    def commit(self, rows: DataFrame, load_id: str | None = None, replace: bool = False) -> int:
        """Add rows to the table, or put them in place of all; returns the version. A load id counts once."""
        load_id = load_id or uuid.uuid4().hex
        if load_id in (before := self._latest())["loads"]:
            return before["version"]
        folder = f"data-{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.option("compression", "snappy").parquet(f"{self.path}/{folder}")
        return self._commit(lambda folders, version: ([] if replace else folders) + [[folder, version]], load_id)

    def _commit(
        self,
        change: Callable[[list[list], int], list[list] | None],
        load_id: str,
        seen: dict | None = None,
        removed: Iterable[str] = (),
    ) -> int:
        """Add a manifest with changed folders and further removed files; with ``seen`` only on top of that one."""
        self._fs.mkdirs(self._path(f"{self.path}/{_MANIFESTS}"))
        for _ in range(ATTEMPTS):
            last = self._latest()
            if load_id in last["loads"]:
                return last["version"]
            if seen and (last["folders"], last.get("removed", [])) != (seen["folders"], seen.get("removed", [])):
                return last["version"]
            version = last["version"] + 1
            folders = change(last["folders"], version)
            listed = {name for name, _ in folders}
            gone = [f for f in [*last.get("removed", []), *removed] if f.partition("/")[0] in listed]
            made = {"version": version, "folders": folders, "removed": gone, "loads": [*last["loads"], load_id]}
            if self._add(made):
                return version
        raise RuntimeError(f"{self.path}: {ATTEMPTS} other writers were first")

    def compact(self, current: Callable[[DataFrame], DataFrame]) -> int:
        """Put ``current`` of the versioned rows in place of all folders, unless the table changed meanwhile."""
        seen = self._latest()
        folder = f"data-{uuid.uuid4().hex}"
        rows = current(self._rows(seen, True))
        rows.select(*self.schema.names).write.option("compression", "snappy").parquet(f"{self.path}/{folder}")
        return self._commit(lambda _, version: [[folder, version]], uuid.uuid4().hex, seen)

    # --- merging ---

    def merge_distinct(
        self, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = (), load_id: str | None = None
    ) -> dict[str, int]:
        """Add rows to a table of one row per key, so that it equals ``dedupe`` of both; returns what was done.

        The keys and the rows' order are those of ``dedupe``. Stored files are searched for the new keys alone: by the
        range of the first key, which skips row groups where files are ordered by it, and by a semi-join.
        Only files that hold a row which must give way are rewritten; new keys are added. Meets another
        writer by merging again on top. Rows with NULL keys are one key, as in ``dedupe``.

        Returns version, added (rows of new keys), replaced (keys), rewritten_files, rewritten_rows.
        """
        load_id = load_id or uuid.uuid4().hex
        names = self.schema.names
        ensure_checkpoint_dir(self.spark)
        new = dedupe(rows.select(*names), keys, order).checkpoint()
        for _ in range(ATTEMPTS):
            seen = self._latest()
            if load_id in seen["loads"]:
                break
            done = self._merge(seen, new, list(keys), list(order), load_id)
            if load_id in self._latest()["loads"]:
                return done
        else:
            raise RuntimeError(f"{self.path}: {ATTEMPTS} other writers were first")
        return {"version": seen["version"], "added": 0, "replaced": 0, "rewritten_files": 0, "rewritten_rows": 0}

    def _merge(self, seen: dict, new: DataFrame, keys: list[str], order: list[str], load_id: str) -> dict[str, int]:
        names = self.schema.names
        file = F.concat_ws("/", F.slice(F.split(F.col("_metadata.file_path"), "/"), -2, 2))
        if self._paths(seen):
            stored = self._rows(seen, False).select(*names, file.alias("_file"))
        else:
            stored = self._rows(seen, False).withColumn("_file", F.lit(""))
        met = _keyed(stored.where(_range(new, keys[0])), new, keys, "left_semi").checkpoint()

        # per key with stored rows: does the only stored row win?
        both = met.select(*names, F.lit(1).alias("_old")).unionByName(new.select(*names, F.lit(0).alias("_old")))
        ranked = [*order, *[c for c in names if c not in {*keys, *order}]]
        row = F.struct(*ranked) if ranked else F.lit(0)
        decided = both.groupBy(*keys).agg(
            F.sum("_old").alias("_copies"), F.min(F.when(F.col("_old") == 1, row)).alias("_stored"), F.min(row).alias("_best")
        )
        known = decided.where("_copies > 0")
        beaten = known.where("_copies > 1 OR NOT (_stored <=> _best)").select(*keys, "_best").checkpoint()
        files = [r["_file"] for r in _keyed(met, beaten, keys, "left_semi").select("_file").distinct().toLocalIterator()]

        added = decided.where("_copies = 0").select(*keys, "_best").unionByName(beaten)
        winners = added.select(*[(F.col(c) if c in keys else F.col("_best")[c]).alias(c) for c in names])
        written = winners
        rewritten = 0
        if files:
            touched = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in files])
            written = winners.unionByName(_keyed(touched, beaten, keys, "left_anti"))
            rewritten = touched.count()
        folder = f"data-{uuid.uuid4().hex}"
        written.sortWithinPartitions(keys[0]).write.option("compression", "snappy").parquet(f"{self.path}/{folder}")
        version = self._commit(lambda folders, v: [*folders, [folder, v]], load_id, seen, files)
        replaced = beaten.count()
        return {
            "version": version, "added": added.count() - replaced, "replaced": replaced,
            "rewritten_files": len(files), "rewritten_rows": rewritten,
        }


#: Types whose values come back from their text unchanged, in any session.
_EXACT = (T.StringType, T.IntegralType, T.DecimalType, T.DateType, T.TimestampNTZType)


def _range(rows: DataFrame, key: str) -> Column:
    """Whether a key lies between the smallest and largest one of ``rows``; NULL passes if they have one."""
    kind, column = rows.schema[key].dataType, F.col(key)
    if not isinstance(kind, _EXACT):
        return F.lit(True)
    low, high, nulls = rows.agg(
        F.min(column).cast("string"), F.max(column).cast("string"), F.count_if(column.isNull())
    ).first()  # one row
    within = column.isNull() if nulls else F.lit(False)
    if low is None:
        return within
    return within | ((column >= F.lit(low).cast(kind)) & (column <= F.lit(high).cast(kind)))


def _keyed(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A semi- or anti-join on keys that may be NULL."""
    sought = right.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(keys)])
    return left.join(sought, same, how)
