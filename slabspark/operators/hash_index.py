"""An index over 64-bit hashes that is kept between calls.

Band keys of the distinct hashes and the rows of each hash are two tables of a
``TableStore``, spread over buckets.  A search opens only the buckets of its
probe keys, and then those of the hashes it has found.  Additions and removals
are new files beside the old; the newest entry of a row counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabspark import params as P
from slabspark.operators.hot import top_per_group
from slabspark.operators.search import BUCKET_ROWS, band_keys, keyed_pairs, probe_keys
from slabspark.session import materialize
from slabspark.sources.store import BUCKET, TableStore

#: Probe keys (about 40 bytes each) that are sent to the buckets they need; more are joined by a shuffle.
BROADCAST_PROBES = 500_000


class HashIndex:
    """Index ``name`` in a store over (id, hash) rows; ids are of one type, null hashes aren't held.

    Four bands need 68 keys of a hash for six bits.  ``buckets`` is fixed with
    the first row.
    """

    def __init__(self, store: TableStore, name: str, id_type: str = "bigint", max_distance: int = P.HASH_MAX_DISTANCE, bands: int = 4, buckets: int = 256):
        self.store, self.max_distance, self.buckets = store, max_distance, buckets
        edges = [round(i * 64 / bands) for i in range(bands + 1)]
        self.layout: Sequence[tuple[int, int]] = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]
        self.bands, self.members = f"{name}__bands", f"{name}__members"
        kind = T._parse_datatype_string(id_type)
        field = lambda n, t: T.StructField(n, t)
        self.band_schema = T.StructType([field("catalog_hash", T.LongType()), field("band", T.IntegerType()), field("key", T.LongType()), field(BUCKET, T.IntegerType())])
        self.member_schema = T.StructType([field("catalog_hash", T.LongType()), field("id", kind), field("live", T.BooleanType()), field("at", T.LongType()), field(BUCKET, T.IntegerType())])

    def _number(self, *cols: str) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("bigint") for c in cols]), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _opened(self, table: str, schema: T.StructType, rows: DataFrame) -> DataFrame:
        """The rows of a table in the buckets that ``rows`` name; no other file is listed or read."""
        manifest = self.store.manifest(table)
        numbers = {f"{BUCKET}={r[BUCKET]}" for r in rows.select(BUCKET).distinct().collect()}  # ``buckets`` at most
        files = manifest.within(numbers) if manifest else set()
        return self.store._read(table, manifest, schema, sorted(files)) if files else self.store.spark.createDataFrame([], schema)

    def _state(self, members: DataFrame) -> DataFrame:
        """The rows that are held: the newest entry of each counts."""
        last = members.groupBy("catalog_hash", "id").agg(F.max(F.struct("at", "live")).alias("e"))
        return last.where("e.live").select("catalog_hash", "id")

    def _put(self, rows: DataFrame, id_col: str, hash_col: str, live: bool) -> None:
        rows = rows.select(F.col(hash_col).cast("bigint").alias("catalog_hash"), F.col(id_col).cast(self.member_schema["id"].dataType).alias("id"))
        rows = materialize(rows.where("catalog_hash is not null and id is not null").distinct().select("*", self._number("catalog_hash")), "index-rows")
        if rows.isEmpty():
            return
        if live:
            known = self._opened(self.members, self.member_schema, rows).select("catalog_hash").distinct()
            new = materialize(rows.select("catalog_hash").distinct().join(known, "catalog_hash", "left_anti"), "new-hashes")
            keys = band_keys(new, self.layout).select("*", self._number("band", "key"))
            # Keys first: a hash without rows is harmless, a row without keys would never be found.
            self.store.append(self.bands, keys.repartition(BUCKET), [BUCKET])
        at = len(self.store.versions(self.members)) and self.store.versions(self.members)[-1]
        entries = rows.select("catalog_hash", "id", F.lit(live).alias("live"), F.lit(at).cast("bigint").alias("at"), BUCKET)
        self.store.append(self.members, entries.repartition(BUCKET), [BUCKET])

    def add(self, rows: DataFrame, id_col: str = "id", hash_col: str = "hash") -> None:
        """Hold these rows too; rows that are held already stay single."""
        self._put(rows, id_col, hash_col, True)

    def remove(self, rows: DataFrame, id_col: str = "id", hash_col: str = "hash") -> None:
        """Forget these (id, hash) rows; others under the same hash stay."""
        self._put(rows, id_col, hash_col, False)

    def sync(self, catalog: DataFrame, id_col: str = "id", hash_col: str = "hash") -> None:
        """Hold exactly the rows of ``catalog``: only the differences are written."""
        now = catalog.select(F.col(id_col).cast(self.member_schema["id"].dataType).alias("id"), F.col(hash_col).cast("bigint").alias("hash")).where("hash is not null and id is not null").distinct()
        held = self.rows()
        added = materialize(now.join(held, ["id", "hash"], "left_anti"), "added")
        self.remove(held.join(now, ["id", "hash"], "left_anti"))
        self.add(added)

    def rows(self) -> DataFrame:
        """All (id, hash) rows that are held."""
        return self._state(self.store.read(self.members, self.member_schema)).select("id", F.col("catalog_hash").alias("hash"))

    def compact(self) -> None:
        """Write both tables anew: removed rows and hashes without rows go."""
        state = materialize(self._state(self.store.read(self.members, self.member_schema)).select("catalog_hash", "id", F.lit(True).alias("live"), F.lit(0).cast("bigint").alias("at"), self._number("catalog_hash")), "live-rows")
        keys = band_keys(state.select("catalog_hash").distinct(), self.layout).select("*", self._number("band", "key"))
        self.store.replace(self.members, state.repartition(BUCKET), [BUCKET])
        self.store.replace(self.bands, keys.repartition(BUCKET), [BUCKET])

    def pairs(self, queries: DataFrame, query_hash: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
        """Distinct (query_hash, catalog_hash, distance) within the index's distance."""
        hashes = queries.select(F.col(query_hash).alias("query_hash")).where(F.col(query_hash).isNotNull()).distinct()
        probed = materialize(probe_keys(hashes, self.layout, self.max_distance).select("*", self._number("band", "key")), "probes")
        keyed = self._opened(self.bands, self.band_schema, probed).select("catalog_hash", "band", "key")
        keys = probed.select("query_hash", "band", "key")
        if probed.count() <= BROADCAST_PROBES:  # the kept side stays where it is
            keys = F.broadcast(keys)
        # A writer that was lost between two tables may have given a hash its keys twice.
        return keyed_pairs(keys, keyed, self.layout, self.max_distance, bucket_rows).distinct()

    def search(self, queries: DataFrame, query_id: str, query_hash: str, limit: int = P.HASH_LIMIT, out_id: str = "id") -> DataFrame:
        """Nearest held rows per query by Hamming distance, ties by id; as ``near_hash_join`` over the same rows."""
        pairs = materialize(self.pairs(queries, query_hash), "near-hashes")
        found = pairs.select("catalog_hash", self._number("catalog_hash")).distinct()
        members = self._opened(self.members, self.member_schema, found).join(found.select("catalog_hash"), "catalog_hash", "left_semi")
        members = top_per_group(self._state(members), ["catalog_hash"], [F.col("id")], limit, "_m").drop("_m")
        best = top_per_group(pairs.join(members, "catalog_hash"), ["query_hash"], [F.col("distance"), F.col("id")], limit, "rank")
        asked = queries.select(F.col(query_id), F.col(query_hash).alias("query_hash"))
        return asked.join(best.select("query_hash", F.col("id").alias(out_id), "distance", "rank"), "query_hash").select(query_id, out_id, "distance", "rank")
