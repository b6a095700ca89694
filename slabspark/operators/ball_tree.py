"""An exact ball tree over unit vectors that is kept between calls.

Every node is a ball: a centre and a radius that covers all of its rows.
Nodes above a size are split around pivots of their own, level by level, each
level one pass over the rows concerned.  New rows sink to a leaf, widen the
balls on their way and split the leaf if it has grown too large.  A search
goes down level by level with all queries at once and leaves out the balls
that the triangle inequality excludes; only the leaves that remain are read.

On unit vectors cosine and Euclidean distance order alike.  Zero vectors, at
cosine distance 1 from everything, lie outside the balls.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabspark import params as P
from slabspark.functions.vectors import l2_normalize
from slabspark.operators.hot import same_keys, top_per_group
from slabspark.operators.search import BLOCK_ROWS, LARGE_BLOCK, SLICE_CELLS, _blocked_join, _unit
from slabspark.session import materialize
from slabspark.sources.store import BUCKET, TableStore

ROOT, ZERO = "", "zero"
#: Children of a node, and rows above which a leaf is split.
FANOUT, LEAF_ROWS = 64, 4096
#: Distances are compared with this much room for rounding.
SLACK = 1e-6


def _points(series: pd.Series) -> np.ndarray:
    return _unit(np.stack(series.to_numpy()).astype(np.float64))


def _away(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit (or zero) vectors."""
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, squares))


def _plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Texts and lists as plain objects, which Arrow takes in one piece."""
    return frame.astype({c: object for c in ("query_id", "ref_id", "path", "vec") if c in frame and frame[c].dtype.kind not in "iufb"})


class BallTree:
    """Tree ``name`` in a store over (id, vector) rows of one length; null vectors and those of another length aren't held."""

    def __init__(self, store: TableStore, name: str, dim: int, id_type: str = "bigint", fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS, buckets: int = 256):
        self.store, self.dim, self.fanout, self.leaf_rows, self.buckets = store, dim, fanout, leaf_rows, buckets
        self.rows_table, self.nodes_table, self.id_type = f"{name}__rows", f"{name}__nodes", id_type
        parse = T._parse_datatype_string
        self.row_schema = parse(f"ref_id {id_type}, vec array<double>, leaf string, {BUCKET} int")
        self.node_schema = parse("path string, parent string, centre array<double>, radius double, n bigint, is_leaf boolean")

    # ------------------------------------------------------------ small steps

    def _number(self, leaf: Column) -> Column:
        return F.pmod(F.xxhash64(leaf), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def nodes(self) -> DataFrame:
        """(path, parent, centre, radius, n, is_leaf) of every ball."""
        return self.store.read(self.nodes_table, self.node_schema)

    def _rows_manifest(self):
        """The version of the rows that the nodes describe."""
        nodes = self.store.manifest(self.nodes_table)
        return self.store.manifest(self.rows_table, nodes.properties["rows"]) if nodes else None

    def _rows_of(self, leaves: DataFrame) -> DataFrame:
        """The rows in the buckets of these leaves; other files aren't read."""
        manifest = self._rows_manifest()
        numbers = leaves.select(self._number(F.col("leaf"))).distinct().collect()  # ``buckets`` at most
        files = manifest.within({f"{BUCKET}={r[0]}" for r in numbers}) if manifest else set()
        return self.store._read(self.rows_table, manifest, self.row_schema, sorted(files)) if files else self.store.spark.createDataFrame([], self.row_schema)

    def _meet(self, left: DataFrame, nodes: DataFrame, then, schema: str) -> DataFrame:
        """``then(rows, children)`` for the rows of every ``path``, in blocks; the children come once to a block."""
        blocks = left.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
        rows = left.join(blocks, "path").withColumn("block", F.pmod(F.xxhash64(*left.columns), F.col("blocks")).cast("int")).drop("blocks")
        children = nodes.withColumnRenamed("path", "child").join(blocks.withColumnRenamed("path", "parent"), "parent").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return rows.groupBy("path", "block").cogroup(children.groupBy(F.col("parent").alias("path"), "block")).applyInPandas(then, schema)

    def _sink(self, rows: DataFrame, nodes: DataFrame) -> DataFrame:
        """(ref_id, vec, leaf) of rows that go down to the nearest child, level by level."""
        at = rows.select("ref_id", "vec", F.lit(ROOT).alias("path"))
        done = None
        schema = f"ref_id {dict(rows.dtypes)['ref_id']}, vec array<double>, path string, is_leaf boolean"

        def down(left: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
            if left.empty or children.empty:
                return _plain(left.assign(is_leaf=True)[["ref_id", "vec", "path", "is_leaf"]])
            children = children.sort_values("child")
            best = _away(_points(left["vec"]), np.stack(children["centre"].to_numpy())).argmin(axis=1)
            return _plain(pd.DataFrame({"ref_id": left["ref_id"].to_numpy(), "vec": left["vec"].to_numpy(), "path": children["child"].to_numpy()[best], "is_leaf": children["is_leaf"].to_numpy()[best]}))

        while True:
            at = materialize(self._meet(at, nodes, down, schema), "sinking")
            arrived = at.where("is_leaf").select("ref_id", "vec", F.col("path").alias("leaf"))
            done = arrived if done is None else done.unionByName(arrived)
            at = at.where("not is_leaf").select("ref_id", "vec", "path")
            if at.isEmpty():
                return done

    def _pivots(self, rows: DataFrame, paths: DataFrame) -> DataFrame:
        """(parent, path, centre) of the children of these leaves: different vectors with the smallest hashes of each."""
        unit = F.transform(l2_normalize(F.col("vec")), lambda x: F.round(x, 9))
        few = rows.join(paths.select(F.col("path").alias("leaf")), "leaf").select("leaf", unit.alias("vec"))
        few = few.select("leaf", "vec", F.xxhash64("vec").alias("h")).dropDuplicates(["leaf", "h"])
        few = top_per_group(few, ["leaf"], [F.col("h"), F.col("vec")], self.fanout, "place")
        split = few.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("leaf")  # equal vectors stay together
        return few.join(split, "leaf").select(F.col("leaf").alias("parent"), F.concat("leaf", F.lpad(F.col("place").cast("string"), 3, "0")).alias("path"), F.col("vec").alias("centre"))

    def _balls(self, rows: DataFrame, nodes: DataFrame) -> DataFrame:
        """``nodes`` (path, centre, …) with radius and n of the ``rows`` below them."""
        depth = F.sequence(F.lit(0), (F.length("leaf") / 3).cast("int"))
        above = rows.select("ref_id", "vec", F.explode(F.transform(depth, lambda d: F.substring("leaf", F.lit(1), 3 * d))).alias("path"))

        def reach(left: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if left.empty or own.empty:
                return pd.DataFrame({"path": pd.Series([], dtype=object), "radius": pd.Series([], dtype=float), "n": pd.Series([], dtype="int64")})
            far = _away(_points(left["vec"]), np.stack(own["centre"].to_numpy()[:1]))
            return _plain(pd.DataFrame({"path": [left["path"].iloc[0]], "radius": [far.max()], "n": [len(left)]}))

        own = nodes.select(F.col("path").alias("parent"), "path", "centre")
        parts = self._meet(above, own, reach, "path string, radius double, n bigint")
        return parts.groupBy("path").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))

    def _split(self, rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Split leaves above the size until none is left that can be split."""
        tried = None
        while True:
            large = nodes.where(F.col("is_leaf") & (F.col("n") > self.leaf_rows))
            large = materialize(large if tried is None else large.join(tried, "path", "left_anti"), "large-leaves")
            if large.isEmpty():
                return rows, nodes
            pivots = materialize(self._pivots(rows, large), "pivots")
            tried = large.select("path") if tried is None else materialize(tried.unionByName(large.select("path")), "tried")
            moving = rows.join(pivots.select(F.col("parent").alias("leaf")).distinct(), "leaf", "left_semi")
            staying = rows.join(pivots.select(F.col("parent").alias("leaf")).distinct(), "leaf", "left_anti")
            fresh = pivots.select("path", "parent", "centre", F.lit(True).alias("is_leaf"))

            def down(left: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
                if left.empty or children.empty:
                    return _plain(left[["ref_id", "vec", "path"]])
                children = children.sort_values("child")
                best = _away(_points(left["vec"]), np.stack(children["centre"].to_numpy())).argmin(axis=1)
                return _plain(left[["ref_id", "vec"]].assign(path=children["child"].to_numpy()[best]))

            moved = self._meet(moving.select("ref_id", "vec", F.col("leaf").alias("path")), fresh, down, f"ref_id {self.id_type}, vec array<double>, path string")
            moved = materialize(moved.select("ref_id", "vec", F.col("path").alias("leaf")), "moved")
            rows = materialize(staying.select("ref_id", "vec", "leaf").unionByName(moved), "tree-rows")
            sizes = self._balls(moved, fresh).join(fresh, "path").select(*self.node_schema.fieldNames())
            inner = nodes.join(pivots.select(F.col("parent").alias("path")).distinct().withColumn("gone", F.lit(True)), "path", "left").withColumn("is_leaf", F.col("is_leaf") & F.col("gone").isNull())
            nodes = materialize(inner.select(*self.node_schema.fieldNames()).unionByName(sizes), "tree-nodes")

    # ------------------------------------------------------------ the tree

    def add(self, rows: DataFrame, id_col: str = "id", vec_col: str = "vec") -> None:
        """Hold these rows too; an id that is given again gives a second row.

        Only the buckets of the leaves that rows fall into, or that are split,
        are written.
        """
        fit = F.col(vec_col).isNotNull() & (F.size(vec_col) == self.dim)
        new = rows.where(fit).select(F.col(id_col).alias("ref_id"), F.col(vec_col).cast("array<double>").alias("vec"))
        new = materialize(new.withColumn("zero", F.forall("vec", lambda x: x == 0)), "tree-new")
        if new.isEmpty():
            return
        held = self._rows_manifest()
        if held and held.version != self.store.versions(self.rows_table)[-1]:  # a writer was lost before its nodes
            self.store.restore(self.rows_table, held.version)
        zeros, new = new.where("zero").select("ref_id", "vec", F.lit(ZERO).alias("leaf")), new.where("not zero").select("ref_id", "vec")
        nodes = self.nodes()
        if nodes.isEmpty():
            root = (ROOT, None, [0.0] * self.dim, 0.0, 0, True)
            nodes = self.store.spark.createDataFrame([root], self.node_schema)
        inner = nodes.where(F.col("parent").isNotNull())
        placed = new.withColumn("leaf", F.lit(ROOT)) if inner.isEmpty() else materialize(self._sink(new, inner), "placed")
        grown = self._balls(placed, nodes).select("path", F.col("radius").alias("_r"), F.col("n").alias("_n"))
        nodes = nodes.join(grown, "path", "left").select("path", "parent", "centre", F.greatest("radius", F.coalesce("_r", F.lit(0.0))).alias("radius"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), "is_leaf")
        nodes = materialize(nodes, "tree-nodes")
        large = nodes.where(F.col("is_leaf") & (F.col("n") > self.leaf_rows)).select(F.col("path").alias("leaf"))
        splitting = placed.join(large, "leaf", "left_semi").select("ref_id", "vec", "leaf")
        if held:
            splitting = splitting.unionByName(self._rows_of(large).join(large, "leaf", "left_semi").select("ref_id", "vec", "leaf"))
        rest = placed.join(large, "leaf", "left_anti").select("ref_id", "vec", "leaf").unionByName(zeros)
        moved, nodes = self._split(materialize(splitting, "splitting"), nodes)
        self._publish(moved, rest, large, nodes)

    def _publish(self, moved: DataFrame, rest: DataFrame, large: DataFrame, nodes: DataFrame) -> None:
        """Rows first, into the buckets they fall into; nodes name them afterwards."""
        numbered = lambda df: df.select("ref_id", "vec", "leaf", self._number(F.col("leaf")))
        added = materialize(numbered(moved.unionByName(rest)), "tree-added")
        if not self.store.exists(self.rows_table):
            self.store.append(self.rows_table, added.repartition(BUCKET), [BUCKET])
        else:
            gone = numbered(large.select(F.lit(None).alias("ref_id"), F.lit(None).alias("vec"), "leaf")).select(BUCKET).distinct()
            touched = [r[BUCKET] for r in added.select(BUCKET).distinct().unionByName(gone).distinct().collect()]  # ``buckets`` at most
            last = self.store.manifest(self.rows_table)
            folders = {f"{BUCKET}={b}" for b in touched}
            old = last.within(folders)
            kept = self.store._read(self.rows_table, last, self.row_schema, sorted(old)) if old else self.store.spark.createDataFrame([], self.row_schema)
            kept = kept.join(large, "leaf", "left_anti").select(*added.columns).unionByName(added)
            written = self.store._write(self.rows_table, last.base, kept.repartition(BUCKET), [BUCKET])
            self.store._commit(self.rows_table, last, "tree", written, old, touched=folders)
        self.store.replace(self.nodes_table, nodes, properties={"rows": self.store.versions(self.rows_table)[-1]})

    def visits(self, blocks: DataFrame, k: int) -> DataFrame:
        """(block, leaf): the leaves that can hold one of the ``k`` nearest of a query of the block.

        ``blocks``: block, vec of the tree's length, bound (an upper bound of
        the Euclidean distance of the k-th nearest).  A level sends each query
        once, and a block's children once to the block.
        """
        nodes = self.nodes().where(F.col("parent").isNotNull())
        parts = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)).cast("int").alias("parts")

        def down(left: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
            hit = np.zeros(len(children), bool)
            if len(left) and len(children):
                centres, points = np.stack(children["centre"].to_numpy()), _points(left["vec"])
                radius, n, bound = children["radius"].to_numpy(), children["n"].to_numpy(), left["bound"].to_numpy().copy()
                rows = max(1, SLICE_CELLS // len(children))
                open_ = np.flatnonzero(np.isinf(bound)) if n.sum() >= k else []
                for a in range(0, len(open_), rows):
                    # All rows of a ball lie within d + radius: the k-th nearest is no farther than that once balls hold k rows.
                    far = _away(points[open_[a : a + rows]], centres) + radius
                    order = np.argsort(far, axis=1)
                    enough = (np.cumsum(n[order], axis=1) >= k).argmax(axis=1)
                    bound[open_[a : a + rows]] = np.take_along_axis(far, order, axis=1)[np.arange(len(far)), enough]
                for a in range(0, len(points), rows):
                    rest = np.flatnonzero(~hit)  # a child that one query has to visit is settled
                    if not len(rest):
                        break
                    gap = _away(points[a : a + rows], centres[rest]) - radius[rest]
                    hit[rest] = (gap <= bound[a : a + rows, None] + SLACK).any(axis=0)
            found = children[hit]
            return _plain(pd.DataFrame({"block": found["block"].to_numpy(), "path": found["path"].to_numpy(), "is_leaf": found["is_leaf"].to_numpy()}))

        at, done = blocks.select("block", F.lit(ROOT).alias("path")).distinct(), None
        while True:
            wanted = materialize(nodes.join(at.withColumnRenamed("path", "parent"), "parent").select("block", "path", "centre", "radius", "n", "is_leaf"), "children")
            sizes = wanted.groupBy("block").agg(parts)
            part = F.pmod(F.xxhash64("path"), F.col("parts")).cast("int").alias("part")
            wanted = wanted.join(sizes, "block").select("block", part, "path", "centre", "radius", "n", "is_leaf")
            asked = blocks.select("block", "vec", "bound").join(sizes, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
            met = asked.groupBy("block", "part").cogroup(wanted.groupBy("block", "part")).applyInPandas(down, f"block {dict(blocks.dtypes)['block']}, path string, is_leaf boolean")
            met = materialize(met, "frontier")
            here = met.where("is_leaf").select("block", F.col("path").alias("leaf"))
            done = here if done is None else done.unionByName(here)
            at = met.where("not is_leaf").select("block", "path")
            if at.isEmpty():
                return done

    def search(self, queries: DataFrame, query_id: str, query_vec: str, k: int = P.TOP_K) -> DataFrame:
        """Exact ``k`` nearest held rows per query by cosine distance, ties by id; as ``cosine_top_k``.

        The leaf that a query sinks to is searched first; its k-th distance
        bounds the others.  Queries of neighbouring leaves then go through the
        tree as one block, and a leaf's rows come once to each block that has
        to visit it; no query is written or sent again for each of its leaves.
        """
        fit = F.col(query_vec).isNotNull() & (F.size(query_vec) == self.dim)
        asked = queries.where(fit).select(F.col(query_id).alias("query_id"), F.col(query_vec).cast("array<double>").alias("vec"))
        asked = materialize(asked.withColumn("zero", F.forall("vec", lambda x: x == 0)), "tree-queries")
        solid = asked.where("not zero").select("query_id", "vec")
        inner = self.nodes().where(F.col("parent").isNotNull())
        if inner.isEmpty():
            found = self._best(solid.withColumn("leaf", F.lit(ROOT)), k)
        else:
            found = self._found(solid, inner, k)
        found = found.select("query_id", "ref_id", "distance")
        # Zero references are all at distance 1, and so is everything from a zero query: the k lowest ids stand for them.
        stored = self._rows_of(self.store.spark.createDataFrame([(ZERO,)], "leaf string")).where(F.col("leaf") == ZERO)
        found = found.unionByName(solid.select("query_id", F.explode(self._lowest(stored, k)).alias("ref_id"), F.lit(1.0).alias("distance")))
        if not asked.where("zero").isEmpty():
            manifest = self._rows_manifest()
            every = self.store._read(self.rows_table, manifest, self.row_schema) if manifest else stored
            found = found.unionByName(asked.where("zero").select("query_id", F.explode(self._lowest(every, k)).alias("ref_id"), F.lit(1.0).alias("distance")))
        best = top_per_group(found, ["query_id"], [F.col("distance"), F.col("ref_id")], k, "rank")
        return best.select(F.col("query_id").alias(query_id), "ref_id", "distance", "rank")

    def _lowest(self, rows: DataFrame, k: int) -> Column:
        ids = [r["ref_id"] for r in rows.select("ref_id").orderBy("ref_id").limit(k).collect()]  # ``k`` rows
        return F.array(*[F.lit(i) for i in ids]).cast(f"array<{self.id_type}>")

    def _found(self, solid: DataFrame, inner: DataFrame, k: int) -> DataFrame:
        """(query_id, ref_id, distance, rank) of queries that aren't zero, in a tree of several nodes."""
        home = self._sink(solid.withColumnRenamed("query_id", "ref_id"), inner).select(F.col("ref_id").alias("query_id"), "vec", "leaf")
        home = materialize(home, "tree-home")
        first = self._best(home, k)
        last = first.groupBy("query_id").agg(F.max("distance").alias("worst"), F.count(F.lit(1)).alias("found"))
        far = F.when(F.col("found") >= k, F.sqrt(2 * F.greatest(F.col("worst"), F.lit(0.0)))).otherwise(F.lit(float("inf")))
        bounded = home.join(last, same_keys(home, last, ["query_id"]), "left").select(home["query_id"], "vec", "leaf", far.alias("bound"))
        asked = home.count()
        rows = int(min(max(asked / LARGE_BLOCK, BLOCK_ROWS), LARGE_BLOCK * BLOCK_ROWS))
        # Neighbouring leaves have neighbouring paths; the number of a block is physical, so it is written.
        ranged = bounded.repartitionByRange(max(1, -(-asked // rows)), "leaf", "query_id", F.xxhash64("vec"))
        blocks = materialize(ranged.withColumn("block", F.spark_partition_id()), "tree-blocks")
        reached = materialize(self.visits(blocks, k), "tree-visits")
        refs = self._rows_of(reached.select("leaf").distinct()).join(reached, "leaf").select("ref_id", "vec", F.col("block").alias("cell"))
        cells = blocks.select("query_id", F.lit(None).cast(self.id_type).alias("skip_id"), "vec", F.col("block").alias("cell"))
        return _blocked_join(cells, refs, k, rows)

    def _best(self, reached: DataFrame, k: int) -> DataFrame:
        cells = reached.select("query_id", F.lit(None).cast(self.id_type).alias("skip_id"), "vec", F.col("leaf").alias("cell"))
        rows = self._rows_of(reached.select("leaf").distinct()).select("ref_id", "vec", F.col("leaf").alias("cell"))
        return _blocked_join(cells, rows, k, BLOCK_ROWS)
