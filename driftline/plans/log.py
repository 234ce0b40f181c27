"""A keyed table as a log: a base in order of the key, and deltas with what has changed since.

An upsert of n rows writes n rows and one empty file whose name commits it. Reading
merges: of several deltas the last one says what a key is, and of the base those keys
are left out. Once the deltas hold a share of the base (and EVERY changes at least),
they are folded into a new base, so a change is rewritten a bounded number of times on
average. Base files hold ranges of the key, with Parquet's Bloom filters on it, so a
lookup of single keys reads hardly more than the rows it finds.

Writers take version numbers by creating a claim that must not exist, once their rows
are written. A reader takes the entries that are named, so it sees all of a write or
nothing. A base says which version it covers; it never covers one whose claim has no
entry yet, unless the claim is so old that its writer must be gone. Nothing is replaced;
``vacuum`` removes what no version after a given one needs.

Defined cases: of several rows of a key in one write the last one by ``order`` stays
(without it: any one of them is an error); a key both upserted and deleted in one write
is deleted; null keys are an error; a log without entries reads as an empty table.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import column, fresh
from ..scratch import bytes_of
from .ledger import KEY, _fs, due

#: Changes before a log is folded at all, its deltas' share of the base, and seconds after which a claim without an entry is void.
EVERY, SHARE, VOID_SECONDS = 1024, 0.25, 600
BASE_BYTES = 256 << 20


@dataclass(frozen=True, order=True)
class Entry:
    version: int
    kind: str  # base or delta
    rows: int
    name: str

    def file(self) -> str:
        return f"LOG-{self.version:012d}-{self.kind}-{self.rows}-{self.name}"

    @staticmethod
    def of(file: str) -> Entry:
        _, version, kind, rows, name = file.split("-", 4)
        return Entry(int(version), kind, int(rows), name)


class LedgerLog:
    """The log in ``folder`` of a table with this schema (DDL) and key."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = KEY, every: int = EVERY):
        self.spark, self.folder, self.key, self.every = spark, folder, key, every
        self.schema = T.StructType.fromDDL(schema)
        self.rest = [f.name for f in self.schema.fields if f.name != key]
        (self.gone,) = fresh([f.name for f in self.schema.fields], "gone")

    # --- entries

    def _names(self) -> dict[str, int]:
        """File names with the times of their last change."""
        fs, where = _fs(self.spark, self.folder)
        return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(where)} if fs.exists(where) else {}

    def entries(self, version: int | None = None) -> list[Entry]:
        """The newest base up to ``version`` (default: all), if there is one, and the deltas after it."""
        found = sorted(Entry.of(n) for n in self._names() if n.startswith("LOG-"))
        found = [e for e in found if version is None or e.version <= version]
        base = max((e for e in found if e.kind == "base"), default=None)
        return [*([base] if base else []), *(e for e in found if e.kind == "delta" and (base is None or e.version > base.version))]

    def version(self) -> int:
        return max((e.version for e in self.entries()), default=0)

    def _settled(self) -> int:
        """The last version before the first claim that may still become an entry."""
        names, now = self._names(), time.time() * 1000
        done = {Entry.of(n).version for n in names if n.startswith("LOG-")}
        open_ = [int(n[6:]) for n, at in names.items() if n.startswith("CLAIM-") and int(n[6:]) not in done and now - at < VOID_SECONDS * 1000]
        return min([max(done, default=0), *(v - 1 for v in open_)])

    def _claim(self) -> int:
        """The next version number, taken by a file that only one writer can create."""
        while True:
            names = self._names()
            version = 1 + max([0, *(int(n.split("-")[1]) for n in names if n.startswith(("LOG-", "CLAIM-")))])
            fs, where = _fs(self.spark, f"{self.folder}/CLAIM-{version:012d}")
            try:
                fs.create(where, False).close()
            except Exception as e:
                if fs.exists(where):  # another writer was faster
                    continue
                raise e
            return version

    def _commit(self, entry: Entry) -> None:
        fs, where = _fs(self.spark, f"{self.folder}/{entry.file()}")
        fs.create(where, False).close()

    # --- writing

    def write(self, rows: DataFrame, deleted: DataFrame | None = None, order: str | None = None) -> int:
        """Upsert ``rows`` and delete the keys of ``deleted``; the version that says so."""
        key, columns = column(self.key), [f.name for f in self.schema.fields]
        news = rows.select(*map(column, columns), F.lit(False).alias(self.gone), (column(order) if order else F.lit(0)).alias("o"))
        if deleted is not None:
            gone = [(key if f.name == self.key else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
            news = news.unionByName(deleted.select(*gone, F.lit(True).alias(self.gone)), allowMissingColumns=True)
        every = news.groupBy(key.alias("k")).agg(F.max_by(F.struct(*map(column, columns), column(self.gone)), F.struct(column(self.gone), F.col("o"))).alias("r"), F.count_if(~column(self.gone)).alias("n"))
        wrong = F.when(F.col("k").isNull(), F.raise_error(F.lit("a row without a key"))) if order else F.when(F.col("k").isNull() | (F.col("n") > 1), F.raise_error(F.lit("a row without a key, or several rows of one key")))
        name = uuid.uuid4().hex
        every.filter(F.coalesce(wrong.cast("boolean"), F.lit(True))).select("r.*").write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        entry = Entry(self._claim(), "delta", self._read_folder(name, delta=True).count(), name)
        self._commit(entry)
        if self.due():
            self.fold()
        return entry.version

    def due(self) -> bool:
        """Whether the deltas since the base are to be folded into it."""
        found = self.entries()
        base = found[0].rows if found and found[0].kind == "base" else 0
        return due(sum(e.rows for e in found if e.kind == "delta"), every=max(self.every, int(SHARE * base)))

    def fold(self) -> None:
        """A new base with all settled versions, in ranges of the key."""
        covered = self._settled()
        found = self.entries(covered)
        if not any(e.kind == "delta" for e in found):
            return
        total = sum(bytes_of(self.spark, f"{self.folder}/{e.name}") for e in found)
        name, files = uuid.uuid4().hex, max(1, -(-total // BASE_BYTES))
        rows = self.read(covered).repartitionByRange(files, column(self.key)).sortWithinPartitions(column(self.key))
        bloom = {f"parquet.bloom.filter.enabled#{self.key}": "true", f"parquet.bloom.filter.expected.ndv#{self.key}": str(max(1, sum(e.rows for e in found) // files))}
        rows.write.options(compression="zstd", **bloom).parquet(f"{self.folder}/{name}")
        self._commit(Entry(covered, "base", self._read_folder(name).count(), name))

    def vacuum(self, version: int | None = None) -> int:
        """Remove what no reader of ``version`` (default: the newest) or later needs; how many entries went."""
        kept = self.entries(version)
        first = kept[0].version if kept and kept[0].kind == "base" else 0
        stale = [Entry.of(n) for n in self._names() if n.startswith("LOG-")]
        stale = [e for e in stale if e.version < first or e.version == first and e not in kept]
        for e in stale:  # the entry first: a reader finds no folder without one
            for file in (e.file(), e.name, f"CLAIM-{e.version:012d}"):
                fs, where = _fs(self.spark, f"{self.folder}/{file}")
                fs.delete(where, True)
        return len(stale)

    # --- reading

    def _read_folder(self, name: str, delta: bool = False) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(self.gone, T.BooleanType())]) if delta else self.schema
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of ``version`` (default: the newest)."""
        return self._merged(self.entries(version), lambda df: df)

    def lookup(self, *keys, version: int | None = None) -> DataFrame:
        """The rows of these keys; the filter reaches each file's statistics and Bloom filters."""
        return self._merged(self.entries(version), lambda df: df.filter(column(self.key).isin(*keys)))

    def changes(self, since: int) -> DataFrame:
        """What the versions after ``since`` have made of the keys that they touched: the schema's columns and ``gone``. Needs their deltas, folded or not."""
        found = sorted(Entry.of(n) for n in self._names() if n.startswith("LOG-"))
        return self._last([e for e in found if e.kind == "delta" and e.version > since], lambda df: df)

    def _last(self, deltas: list[Entry], only) -> DataFrame:
        """The last word of these deltas on each key."""
        if not deltas:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField(self.gone, T.BooleanType())]))
        parts = [only(self._read_folder(e.name, delta=True)).withColumn("v", F.lit(e.version)) for e in deltas]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        columns = [*map(column, [f.name for f in self.schema.fields]), column(self.gone)]
        return every.groupBy(column(self.key).alias("k")).agg(F.max_by(F.struct(*columns), "v").alias("r")).select("r.*")

    def _merged(self, found: list[Entry], only) -> DataFrame:
        base = [e for e in found if e.kind == "base"]
        deltas = [e for e in found if e.kind == "delta"]
        rows = only(self._read_folder(base[0].name)) if base else self.spark.createDataFrame([], self.schema)
        if not deltas:
            return rows
        news = self._last(deltas, only)
        keys = news.select(column(self.key).alias("k"))
        return rows.join(keys, rows[f"`{self.key}`"] == keys["k"], "left_anti").unionByName(news.filter(~column(self.gone)).drop(self.gone))
