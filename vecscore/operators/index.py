"""Inverted-file index as tables: vectors by cluster, cluster boxes, a coarse grid over the two strongest dimensions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vector import axis
from ..params import SearchParams
from ..sources import tables
from ..sources.checkpoint import cut
from . import kmeans

VERSION = 1
BLOCK = 8


@dataclass
class Index:
    """meta (one row), clusters (cid, n, start, mn, mx), grid (bucket, cid), vectors (ref_id, v, fraud, cid), centroids (cid, c, cq)."""

    meta: DataFrame
    clusters: DataFrame
    grid: DataFrame
    vectors: DataFrame
    centroids: DataFrame

    @property
    def disc(self) -> tuple[int, int]:
        d = self.meta.first()["disc"]
        return d[0], d[1]


def energy(vectors: DataFrame, dims: int) -> DataFrame:
    """(dim, sumsq): sums of squares, not centred, in one scan."""
    sums = vectors.agg(F.array(*(F.sum(F.col("v")[d].cast("bigint") * F.col("v")[d]) for d in range(dims))).alias("s"))
    return sums.select(F.posexplode("s").alias("dim", "sumsq"))


def strongest(vectors: DataFrame, dims: int) -> tuple[int, int]:
    a, b = [r[0] for r in energy(vectors, dims).orderBy(F.desc("sumsq"), "dim").limit(2).collect()]
    return a, b


def boxes(assigned: DataFrame, dims: int) -> DataFrame:
    """(cid, n, mn, mx) of clusters that have vectors."""
    low, high = (F.array(*(f(F.col("v")[d]) for d in range(dims))) for f in (F.min, F.max))
    return assigned.groupBy("cid").agg(F.count("*").alias("n"), low.alias("mn"), high.alias("mx"))


def offsets(counts: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cid, n, start, blocks) of all clusters: running start in cid order, blocks of 8 vectors. One row for each cluster, a bounded number."""
    n = centroids.select("cid").join(counts.select("cid", "n"), "cid", "left").select("cid", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    before = F.sum("n").over(Window.orderBy("cid").rowsBetween(Window.unboundedPreceding, -1))
    return n.select("cid", "n", F.coalesce(before, F.lit(0)).alias("start"), F.ceil(F.col("n") / BLOCK).cast("bigint").alias("blocks"))


def grid_cells(boxes_: DataFrame, disc: tuple[int, int], p: SearchParams = SearchParams()) -> DataFrame:
    """(bucket, cid): every grid cell within `radius` cells of the cluster's box, on both strong dimensions."""
    span = lambda d: F.sequence(
        F.greatest(F.lit(0), axis(F.col("mn")[d], p.cells, p.scale) - p.radius), F.least(F.lit(p.cells - 1), axis(F.col("mx")[d], p.cells, p.scale) + p.radius)
    )
    rows = boxes_.select("cid", F.explode(span(disc[0])).alias("a"), span(disc[1]).alias("bs"))
    return rows.select("cid", "a", F.explode("bs").alias("b")).select((F.col("a") * p.cells + F.col("b")).cast("int").alias("bucket"), "cid")


def bucket_lists(grid: DataFrame) -> DataFrame:
    """(bucket, cids): at most one entry for each cluster."""
    return grid.groupBy("bucket").agg(F.array_sort(F.collect_list("cid")).alias("cids"))


def grid_stats(grid: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    n = grid.groupBy("bucket").agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return n.agg(total.alias("total"), F.floor(total / (p.cells * p.cells)).cast("bigint").alias("average"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def pack_blocks(assigned: DataFrame) -> DataFrame:
    """(cid, block, n, labels): 8 vectors in id order with their fraud bits.

    A place within a cluster is a rank within an id range of it plus the counts of the ranges before, so a large
    cluster is never one task's window."""
    width = 4096
    part = F.floor(F.col("ref_id") / width)
    counts = assigned.groupBy("cid", part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("cid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("cid", "part", F.coalesce(before, F.lit(0)).alias("first"))
    rk = F.row_number().over(Window.partitionBy("cid", "part").orderBy("ref_id")) - 1
    rows = assigned.select("cid", part.alias("part"), "ref_id", "fraud").withColumn("rk", rk).join(first, ["cid", "part"])
    pos = F.col("first") + F.col("rk")
    rows = rows.select("cid", F.floor(pos / BLOCK).cast("bigint").alias("block"), "fraud", (pos % BLOCK).cast("int").alias("bit"))
    return rows.groupBy("cid", "block").agg(F.count("*").alias("n"), F.sum(F.col("fraud") * F.expr("shiftleft(1, bit)")).cast("bigint").alias("labels"))


def build(refs: DataFrame, dims: int, n_clusters: int | None = None, rounds: int = 30, p: SearchParams = SearchParams(), seed: int | None = None) -> Index:
    """refs: (ref_id from 0 to n - 1, v, fraud), written once since every round scans them. seed: k-means++ instead of the stride start."""
    refs = cut(refs.select("ref_id", "v", "fraud"))
    n, last = refs.agg(F.count("*"), F.max("ref_id")).first()
    if n and last + 1 != n:
        raise ValueError(f"{n} references with ids up to {last}: ids have to be 0 to n - 1")
    n_clusters = n_clusters or max(1, min(kmeans.MOST_CLUSTERS, round(n**0.5)))
    centroids, _ = kmeans.fit(refs, n_clusters, dims, rounds, seed)
    return assemble(refs, centroids, dims, p)


def assemble(refs: DataFrame, centroids: DataFrame, dims: int, p: SearchParams = SearchParams()) -> Index:
    vectors = cut(kmeans.assign(refs, centroids))  # every search and summary reads them
    box = cut(boxes(vectors, dims))
    disc = strongest(refs, dims)
    clusters = offsets(box, centroids).join(box.drop("n"), "cid", "left")
    meta = refs.sparkSession.createDataFrame([(VERSION, dims, list(disc))], "version int, dims int, disc array<int>")
    return Index(meta, clusters, grid_cells(box, disc, p), vectors, centroids)


def build_index(spark: SparkSession, references: str, out: str, dims: int = 14, n_clusters: int | None = None, rounds: int = 30, seed: int | None = None, p: SearchParams = SearchParams()) -> Index:
    """From a file of references to a saved index, as loaded again."""
    save(build(tables.labelled(tables.read_references(spark, references)), dims, n_clusters, rounds, p, seed), out)
    return load(spark, out)


PARTS = ("meta", "clusters", "grid", "vectors", "centroids")
COLUMNS = {"meta": ("version", "dims", "disc"), "clusters": ("cid", "n", "start", "mn", "mx"), "grid": ("bucket", "cid"), "vectors": ("ref_id", "v", "fraud", "cid"), "centroids": ("cid", "cq")}


def save(index: Index, path: str) -> None:
    """Parquet tables; vectors in cid order, so that row-group statistics prune by cluster."""
    for name in PARTS:
        df = getattr(index, name)
        if name == "vectors":
            df = df.repartitionByRange("cid", "ref_id").sortWithinPartitions("cid", "ref_id")
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Index:
    index = Index(*(spark.read.parquet(f"{path}/{name}") for name in PARTS))
    version = index.meta.first()["version"]
    if version != VERSION:
        raise ValueError(f"index version {version} at {path}, {VERSION} is needed")
    for name, columns in COLUMNS.items():
        lacks = set(columns) - set(getattr(index, name).columns)
        if lacks:
            raise ValueError(f"{name} of the index at {path} lacks {sorted(lacks)}")
    if index.vectors.where(F.size("v") != index.meta.first()["dims"]).limit(1).count():
        raise ValueError(f"the index at {path} has vectors of other dimensions")
    if index.clusters.agg(F.sum("n")).first()[0] != index.vectors.count():
        raise ValueError(f"the index at {path} lacks vectors")
    return index
