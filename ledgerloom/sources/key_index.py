"""Known keys on disk: hash buckets with a Bloom filter each, so that a batch reads few of them.

The index is two tables clustered by bucket, the keys (sorted) and the filters.
A batch is tested against the filters of its buckets; only keys that pass are
looked up, and only in the buckets that hold such keys.  Neither table is
shuffled: the batch goes to the buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256
from math import ceil, log2
from operator import and_
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import stage
from ledgerloom.sources.files import child_names, delete, touch
from ledgerloom.sources.tables import Version, commit, expire, head

#: Keys a bucket is meant for; a rebuilt index has as many buckets, 16 to 65,536.
BUCKET_KEYS = 4_000_000
#: A filter block: eight words of 32 bits, a key setting one bit in each.
_WORDS = 8
#: Bits of a filter for each key it is meant for: one key in some 5,000 passes by chance.
_BITS = 24
#: Added parts that are merged into one when there are more.
MERGED_AT = 64
_MERGED = "merged"

_PART, _BUCKET, _BLOCK = "part", "bucket", "block"


@contextmanager
def _joined_by_bucket(spark: SparkSession) -> Iterator[None]:
    """Let tables clustered by bucket meet others on (bucket, key) without a shuffle.

    Only while a lookup runs: elsewhere a join on more keys than its input is
    clustered by, such as one on a salt, must deal its rows out anew.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    held = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, held)


@dataclass(frozen=True)
class KeyIndex:
    """Keys by the run (part) that brought them; one key may be in several parts."""

    spark: SparkSession
    root: str
    key: str = "transaction_id"

    # --- layout ---------------------------------------------------------------

    def _shape(self) -> Version | None:
        return head(self.spark, self.root)

    def _table(self, version: Version, kind: str) -> str:
        """A catalog entry of this session for one of the two tables of a version."""
        path = f"{self.root}/{version.folders()[0]}/{kind}"
        name = f"key_index_{sha256(path.encode()).hexdigest()[:24]}"
        if not self.spark.catalog.tableExists(name):
            buckets = version.notes["buckets"]
            words = ", ".join(f"w{i} INT" for i in range(_WORDS))
            columns, order = {
                "keys": (f"{self.key} STRING", self.key), "filters": (f"{words}, {_BLOCK} INT", _BLOCK),
            }[kind]
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}, {_BUCKET} INT, {_PART} STRING) USING parquet "
                f"OPTIONS (path '{path}') PARTITIONED BY ({_PART}) "
                f"CLUSTERED BY ({_BUCKET}) SORTED BY ({_BUCKET}, {order}) INTO {buckets} BUCKETS"
            )
        return name

    def _read(self, version: Version, kind: str) -> DataFrame:
        name = self._table(version, kind)
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _placed(self, keys: DataFrame, version: Version) -> DataFrame:
        bucket = F.pmod(F.xxhash64(F.lit(1), self.key), F.lit(version.notes["buckets"])).cast("int")
        return keys.where(F.col(self.key).isNotNull()).withColumn(_BUCKET, bucket)

    def _block(self, version: Version) -> Column:
        return F.pmod(F.xxhash64(F.lit(2), self.key), F.lit(version.notes["blocks"])).cast("int")

    def _bits(self) -> list[Column]:
        chosen = F.xxhash64(F.lit(3), self.key)
        return [
            F.call_function("shiftleft", F.lit(1), F.shiftright(chosen, 5 * i).bitwiseAND(31).cast("int"))
            for i in range(_WORDS)
        ]

    # --- writing --------------------------------------------------------------

    def exists(self) -> bool:
        return self._shape() is not None

    def rebuild(self, keys: DataFrame) -> bool:
        """Start anew from ``keys(key, part)``, with buckets and filters sized to them.

        Beyond ``MERGED_AT`` parts their names are dropped.  False if another writer
        has rebuilt the index meanwhile; then that one is the index.
        """
        kept = stage(keys.where(F.col(self.key).isNotNull()).select(self.key, _PART), "keys")
        n, parts = kept.agg(F.count("*"), F.count_distinct(_PART)).first()
        if parts > MERGED_AT:
            kept = kept.withColumn(_PART, F.lit(_MERGED))
        buckets = 1 << max(4, min(16, ceil(log2(max(n, 1) / BUCKET_KEYS))))
        blocks = max(64, ceil(2 * n * _BITS / (32 * _WORDS * buckets)))
        number = (self._shape() or Version()).number + 1
        folder = f"data/{uuid.uuid4().hex}"
        made = Version(number, {"rows": [folder]}, {"buckets": buckets, "blocks": blocks})
        self._write(kept, made)
        if commit(self.spark, self.root, made):
            expire(self.spark, self.root, 2)
            return True
        delete(self.spark, f"{self.root}/{folder}")
        return False

    def add(self, keys: DataFrame, part: str) -> None:
        """Add the keys of a run; adding a run again replaces what it added."""
        added = keys.select(self.key).distinct().withColumn(_PART, F.lit(part))
        version = self._shape()
        if version is None and self.rebuild(added):
            return
        version = self._shape()
        self._write(added, version, part)
        while (now := self._shape()).number != version.number:
            version = now  # another writer has merged the index: it may have missed this part
            self._write(added, version, part)
        if len(self._parts(version)) > MERGED_AT:
            self._merge(version, part)

    def _parts(self, version: Version) -> list[str]:
        folder = f"{self.root}/{version.folders()[0]}/keys"
        return [unquote(n.partition("=")[2]) for n in child_names(self.spark, folder) if "=" in n]

    def _merge(self, version: Version, last: str) -> None:
        """Make one part of all but the last, in an index sized to what it holds."""
        seen = self._parts(version)
        held = self._read(version, "keys").where(F.col(_PART).isin(seen))
        name = F.when(F.col(_PART) == last, F.col(_PART)).otherwise(_MERGED)
        if self.rebuild(held.select(self.key, name.alias(_PART))):
            # Parts that were added while this went on are copied over.
            for late in set(self._parts(version)) - set(seen):
                self.add(self._read(version, "keys").where(F.col(_PART) == late), late)

    def _write(self, keys: DataFrame, version: Version, part: str | None = None) -> None:
        """One file a bucket and part in both tables, sorted within; ``part`` is replaced."""
        placed = stage(self._placed(keys, version), "placed")
        filters = placed.select(
            _PART, _BUCKET, self._block(version).alias(_BLOCK),
            *(bit.alias(f"w{i}") for i, bit in enumerate(self._bits())),
        ).groupBy(_BUCKET, _PART, _BLOCK).agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)))
        for kind, rows, order in (("keys", placed, self.key), ("filters", filters, _BLOCK)):
            name = self._table(version, kind)
            dealt = (
                rows.select(*self.spark.table(name).columns)
                .repartition(version.notes["buckets"], _BUCKET)
                .sortWithinPartitions(_PART, _BUCKET, order)
            )
            if part is None:
                dealt.write.mode("append").insertInto(name)
                continue
            view = f"added_{uuid.uuid4().hex}"
            dealt.drop(_PART).createOrReplaceTempView(view)
            # A streamed batch comes with a session of its own.
            dealt.sparkSession.sql(
                f"INSERT OVERWRITE TABLE {name} PARTITION ({_PART} = :part) TABLE {view}", {"part": part}
            )
            dealt.sparkSession.catalog.dropTempView(view)

    # --- looking up -----------------------------------------------------------

    def _suspects(self, keys: DataFrame, version: Version) -> DataFrame:
        placed = self._placed(keys.select(self.key).distinct(), version)
        batch = placed.withColumn(_BLOCK, self._block(version))
        # Bits follow from the key, where it meets its block: they need not travel with it.
        passed = reduce(and_, (
            F.col(f"w{i}").bitwiseAND(bit) != 0 for i, bit in enumerate(self._bits())
        ))
        found = self._read(version, "filters").drop(_PART).join(batch, [_BUCKET, _BLOCK])
        return found.where(passed).select(self.key, _BUCKET).distinct()

    def suspects(self, keys: DataFrame) -> DataFrame:
        """Those distinct keys that the filter of some part passes: (key, bucket)."""
        with _joined_by_bucket(self.spark):
            return stage(self._suspects(keys, self._shape()), "suspects")

    def lookup(self, suspects: DataFrame, buckets: list[int]) -> DataFrame:
        """The suspects that the given buckets hold, with their parts; not run yet."""
        return (
            self._read(self._shape(), "keys").where(F.col(_BUCKET).isin(buckets))
            .join(suspects, [_BUCKET, self.key], "left_semi").select(self.key, _PART)
        )

    def known(self, keys: DataFrame) -> DataFrame:
        """The keys of a batch that the index holds, with the parts they are in.

        What reaches the driver is the list of buckets to read.  An index without parts
        holds none.
        """
        version = self._shape()
        if version is None or not self._parts(version):
            return keys.select(self.key, F.lit("").alias(_PART)).limit(0)
        suspects = self.suspects(keys)
        buckets = [r[_BUCKET] for r in suspects.select(_BUCKET).distinct().collect()]
        with _joined_by_bucket(self.spark):
            return stage(self.lookup(suspects, buckets), "known")

    # --- runs that did not end --------------------------------------------------

    def begin(self, part: str) -> None:
        """Note that a run is about to load rows whose keys are not in the index yet."""
        touch(self.spark, f"{self.root}/_open/{quote(part, safe='')}")

    def end(self, part: str) -> None:
        delete(self.spark, f"{self.root}/_open/{quote(part, safe='')}")

    def unfinished(self) -> list[str]:
        """Runs that may have loaded rows without adding their keys."""
        return [unquote(name) for name in child_names(self.spark, f"{self.root}/_open")]
