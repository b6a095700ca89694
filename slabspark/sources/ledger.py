"""Keys a table has seen, with Bloom filters in front of them.

Keys are spread over buckets by hash; a filter page of 4 KB stands for a share
of a bucket.  A batch reads the pages of its keys, and opens only the buckets
of keys that a filter can't rule out.  About 40 bits for each key make a false
alarm one in a million, so batches of new keys open next to nothing.  Pages
double four times over once they are full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabspark.session import materialize
from slabspark.sources.store import BUCKET, TableStore, bucket_number

#: Bits of a page (what one ``bitmap_construct_agg`` holds), hashes of a key, keys for which a page is meant.
PAGE_BITS, HASHES, PAGE_KEYS = 32_768, 8, 800
#: Versions of the key table after which its files are put together.
COMPACT_EVERY = 16
FILTERS = T.StructType([T.StructField("page", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("pages", T.LongType())])


class KeyLedger:
    """Ledger of the key columns of one table in a store; null key parts are values like any other."""

    def __init__(self, store: TableStore, table: str, keys: Sequence[str], schema: T.StructType, buckets: int = 64, pages: int = 256):
        self.store, self.table, self.keys = store, table, list(keys)
        self.names, self.filters = f"{table}__keys", f"{table}__filters"
        self.schema = T.StructType([schema[k] for k in keys])
        self.stored = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        self.buckets, self.first_pages = buckets, pages

    def _hash(self, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), *[F.col(k).cast(self.schema[k].dataType) for k in self.keys])

    def _page(self, pages: int) -> Column:
        return F.pmod(self._hash(0), F.lit(pages))

    def _places(self) -> Column:
        return F.array(*[F.pmod(self._hash(i), F.lit(PAGE_BITS)) for i in range(1, HASHES + 1)])

    def _filters(self) -> tuple[DataFrame, int]:
        """The pages, and how many there are."""
        held = self.store.read(self.filters, FILTERS)
        first = held.select("pages").first()
        return held, int(first["pages"]) if first else self.first_pages

    def _opened(self, suspects: DataFrame) -> list[int]:
        return sorted(r[BUCKET] for r in suspects.select(BUCKET).distinct().collect())  # ``buckets`` at most

    def _known(self, numbers: list[int]) -> DataFrame:
        """The keys in these buckets; others aren't opened."""
        manifest = self.store.manifest(self.names)
        files = manifest.within({f"{BUCKET}={b}" for b in numbers}) if manifest else set()
        return self.store._read(self.names, manifest, self.stored, sorted(files)) if files else self.store.spark.createDataFrame([], self.stored)

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The distinct keys of ``rows`` that the ledger doesn't hold."""
        keys = rows.select(*[F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.keys]).distinct()
        filters, pages = self._filters()
        keys = keys.select("*", bucket_number(self.keys, self.schema, self.buckets).alias(BUCKET), self._page(pages).alias("page"), self._places().alias("places"))
        byte = lambda p: F.conv(F.hex(F.substring("bits", (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        maybe = F.forall("places", lambda p: F.getbit(byte(p), (p % 8).cast("int")) == 1)
        sought = keys.join(filters.select("page", "bits"), "page", "left").select(*self.keys, BUCKET, F.coalesce(maybe, F.lit(False)).alias("maybe"))
        sought = materialize(sought, "sought-keys")
        suspects = sought.where("maybe")
        known = self._known(self._opened(suspects))
        same = [suspects[k].eqNullSafe(known[k]) for k in self.keys]
        return sought.where("not maybe").unionByName(suspects.join(known, same, "left_anti")).select(*self.keys)

    def add(self, keys: DataFrame, epoch: tuple[str, int] | None = None) -> None:
        """Put keys that are ``unseen`` into the ledger: names first, then filters."""
        rows = materialize(keys.select(*self.keys, bucket_number(self.keys, self.schema, self.buckets).alias(BUCKET)), "new-keys")
        self.store.append(self.names, rows.repartition(BUCKET), [BUCKET], epoch)
        if self.store.versions(self.names)[-1] % COMPACT_EVERY == 0:
            self.store.compact(self.names, self.stored, [BUCKET])
        filters, pages = self._filters()
        total = sum(r["n"] for r in self.store.read(self.names, self.stored).groupBy(BUCKET).agg(F.count("*").alias("n")).collect())  # from file footers
        if total > pages * PAGE_KEYS:
            while total > pages * PAGE_KEYS:
                pages *= 4
            self._build(self.store.read(self.names, self.stored), None, pages, epoch)
        else:
            self._build(rows, filters, pages, epoch)

    def _build(self, keys: DataFrame, old: DataFrame | None, pages: int, epoch: tuple[str, int] | None) -> None:
        bits = keys.select(self._page(pages).alias("page"), F.explode(self._places()).alias("place")).groupBy("page").agg(F.bitmap_construct_agg("place").alias("bits"))
        if old is not None:
            bits = bits.unionByName(old.select("page", "bits")).groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits"))
        self.store.replace(self.filters, bits.select("page", "bits", F.lit(pages).cast("long").alias("pages")).coalesce(1 + pages // 4096), epoch=epoch)

    def repair(self) -> None:
        """Catch up with the table after a writer was lost between its three commits."""
        table, names, filters = (self.store.manifest(n) for n in (self.table, self.names, self.filters))
        if table is None:
            return
        if names is None or names.epochs != table.epochs:
            held = self.store.read(self.names, self.stored)
            found = self.store.read(self.table, self.schema).distinct()
            missing = found.join(held, [found[k].eqNullSafe(held[k]) for k in self.keys], "left_anti")
            rows = missing.select(*self.keys, bucket_number(self.keys, self.schema, self.buckets).alias(BUCKET)).repartition(BUCKET)
            self.store.append(self.names, rows, [BUCKET])
            self.store.note(self.names, table.epochs)
            names = self.store.manifest(self.names)
        if filters is None or filters.epochs != names.epochs:
            _, pages = self._filters()
            self._build(self.store.read(self.names, self.stored), None, pages, None)
            self.store.note(self.filters, names.epochs)
