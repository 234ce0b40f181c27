"""Tables stored by the hash of their key, so that plans over several of them need no shuffle.

Manifest, ledger, cache and destination of a sync are joined on the path again and again.
Stored in the same number of buckets, each sorted by the key, a second sync joins them
bucket by bucket: only what is newly scanned is dealt anew, into the same buckets.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..names import column
from ..scratch import bytes_of, stored
from .ledger import KEY, _fs

#: Stored bytes of a bucket of the largest table.
BUCKET_BYTES = 128 << 20


def buckets_for(spark: SparkSession, path: str) -> int:
    """Buckets for a stored table, a power of two, so that tables that grow apart still divide each other."""
    return 1 << max(0, (max(1, -(-bytes_of(spark, path) // BUCKET_BYTES)) - 1).bit_length())


@dataclass(frozen=True)
class CoLocated:
    """Tables in sub-folders of ``folder``, all in ``buckets`` buckets by ``key``."""

    spark: SparkSession
    folder: str
    buckets: int
    key: str = KEY

    def _file(self, table: str, version: str) -> str:
        return f"{self.folder}/{table}/{version}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        """The next version of a table, and the table as it reads from now on. A reader takes the newest version whose pointer exists."""
        now = self._versions(table)
        name = f"v{1 + max(now, default=0):012d}"
        dealt = df.repartition(self.buckets, column(self.key)).sortWithinPartitions(column(self.key))  # one file for each bucket
        made = f"colocated_{uuid.uuid4().hex}"
        dealt.write.option("compression", "zstd").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self._file(table, name)).saveAsTable(made)
        fs, pointer = _fs(self.spark, self._file(table, f"CURRENT-{name}"))
        fs.create(pointer, False).close()
        return self.spark.table(made)

    def _versions(self, table: str) -> list[int]:
        fs, where = _fs(self.spark, f"{self.folder}/{table}")
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return [int(n.removeprefix("CURRENT-v")) for n in names if re.match(r"CURRENT-v\d+$", n)]

    def load(self, table: str, schema: str) -> DataFrame:
        """The newest version, with its layout known to the planner; without one, an empty table."""
        found = max(self._versions(table), default=None)
        if found is None:
            return self.spark.createDataFrame([], schema)
        made, path = f"colocated_{uuid.uuid4().hex}", self._file(table, f"v{found:012d}")
        quoted = "`" + self.key.replace("`", "``") + "`"
        self.spark.sql(f"CREATE TABLE {made} ({schema}) USING parquet CLUSTERED BY ({quoted}) SORTED BY ({quoted}) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(made)

    def rebucketed(self, buckets: int, tables: dict[str, str]) -> CoLocated:
        """All tables (name: schema) in another number of buckets, in a folder beside."""
        other = CoLocated(self.spark, f"{self.folder}-{buckets}", buckets, self.key)
        for table, schema in tables.items():
            other.save(stored(self.load(table, schema), table), table)
        return other
