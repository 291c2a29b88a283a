"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

Unit vectors are projected on Gaussian directions, and each projection falls into one of
``cells`` stretches of the line; the stretches of one table's projections name a bucket. For
a neighbour at angle t of a query with projection p, the neighbour's projection is normal
with mean p cos t and deviation sin t, so the chance to find it is known for every bucket.

A query first visits its few likeliest buckets, which bounds the angle of its k-th neighbour.
Then it visits buckets in the order of their chance at that angle, until the chance to have
met the k-th neighbour in one of the tables reaches ``target``. Queries that met fewer than k
vectors visit all buckets, which is exact. All candidates are scored on the original vectors.

Buckets lie in regions, and regions in blocks of at most ``BLOCK`` vectors, so a bucket with a
third of all vectors is many tasks' work. A query travels once to each block that it probes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.rows import ship, written

BLOCK = 4096
QUERY_BLOCK = 8192
_REGION = 64


@dataclass(frozen=True)
class Index:
    """Settings of the hash tables; ``cells`` ** ``projections`` buckets per table."""

    dimension: int
    tables: int = 4
    projections: int = 5
    cells: int = 4
    width: float = 0.8
    target: float = 0.98
    first_probes: int = 16
    first_cosine: float = 0.9
    seed: int = 29

    @property
    def buckets(self) -> int:
        return self.cells**self.projections

    @property
    def regions(self) -> int:
        return -(-self.buckets // _REGION)

    def directions(self) -> tuple[np.ndarray, np.ndarray]:
        """Directions, and the inner borders of the cells on each."""
        rng = np.random.default_rng(self.seed)
        shape = (self.tables, self.projections)
        offset = rng.uniform(-0.5, 0.5, (*shape, 1)) * self.width
        borders = (np.arange(1, self.cells) - self.cells / 2) * self.width + offset
        return rng.standard_normal((*shape, self.dimension)), borders

    def projected(self, unit: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tpd->ntp", unit, self.directions()[0])

    def bucket_of(self, unit: np.ndarray) -> np.ndarray:
        """Bucket of every vector in every table."""
        cell = (self.projected(unit)[..., None] > self.directions()[1]).sum(-1)
        return cell @ self.cells ** np.arange(self.projections)[::-1]

    def chances(self, projection: np.ndarray, cosine: float) -> np.ndarray:
        """Chance of every bucket, in every table, to hold a vector at this cosine."""
        sine = math.sqrt(max(1 - cosine * cosine, 1e-12))
        at = (self.directions()[1] - cosine * projection[..., None]) / sine
        below = np.concatenate([np.zeros((*at.shape[:2], 1)), _normal(at),
                                np.ones((*at.shape[:2], 1))], -1)
        each = np.diff(below, axis=-1)
        out = np.ones((self.tables, 1))
        for p in range(self.projections):
            out = (out[:, :, None] * each[:, p, None, :]).reshape(self.tables, -1)
        return out

    def first_visits(self, projection: np.ndarray) -> np.ndarray:
        chance = self.chances(projection, self.first_cosine)
        visit = np.zeros(chance.shape, bool)
        best = np.argsort(-chance, axis=1, kind="stable")[:, : self.first_probes]
        np.put_along_axis(visit, best, True, 1)
        return visit

    def visits(self, projection: np.ndarray, cosine: float) -> np.ndarray:
        """Buckets to visit, in each table, to meet a vector at this cosine or closer."""
        chance = self.chances(projection, max(cosine, -1.0))
        wanted = 1 - (1 - self.target) ** (1 / self.tables)
        order = np.argsort(-chance, axis=1, kind="stable")
        ranked = np.take_along_axis(chance, order, 1)
        enough = np.cumsum(ranked, 1) - ranked < wanted
        visit = np.zeros(chance.shape, bool)
        np.put_along_axis(visit, order, enough, 1)
        return visit


def _normal(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 1e-7."""
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    # A published rational approximation of the error function.
    terms = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    tail = sum(a * t ** (n + 1) for n, a in enumerate(terms)) * np.exp(-z * z) / 2
    return np.where(x > 0, 1 - tail, tail)


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column without nulls, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """True for the k largest of each row; of equal ones, the leftmost. -inf never counts."""
    k = min(k, scores.shape[1])
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    over, tied = scores > kth, scores == kth
    room = k - over.sum(axis=1, keepdims=True)
    return (over | (tied & (np.cumsum(tied, axis=1) <= room))) & (scores > -np.inf)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """row_id, vec_id, vec of rows whose vector is not null or zero and holds numbers alone."""
    vec = F.col(embedding).cast("array<double>")
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vec, lambda x: x != 0.0)
    return vectors.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(vec_id).cast("long").alias("vec_id"),
        vec.alias("vec"),
    ).filter((F.size("vec") > 0) & ~F.coalesce(odd, F.lit(True)) & F.coalesce(some, F.lit(False)))


def _indexed(vectors: DataFrame, index: Index) -> DataFrame:
    """A row per vector and table: its region and bucket."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = index.bucket_of(unit(matrix(batch.column("vec"))))
            which = pa.array(np.repeat(np.arange(batch.num_rows), index.tables))
            tables = np.tile(np.arange(index.tables), batch.num_rows)
            flat = bucket.reshape(-1)
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c).take(which) for c in ("row_id", "vec_id", "vec")},
                "area": pa.array((tables * index.regions + flat // _REGION).astype(np.int32)),
                "bucket": pa.array(flat.astype(np.int32)),
            })

    return vectors.mapInArrow(
        place, "row_id long, vec_id long, vec array<double>, area int, bucket int"
    )


def _probes(queries: DataFrame, index: Index, k: int, blocks: dict[int, int]) -> DataFrame:
    """A row per query and block: the buckets it visits there.

    ``queries`` has ``found`` and ``cosine`` in the second round: how many vectors the first
    one met, up to k, and the cosine of the k-th.
    """
    second = "found" in queries.columns

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            projected = index.projected(unit(matrix(batch.column("vec"))))
            out: dict[str, list] = {"which": [], "area": [], "block": [], "visits": []}
            for i in range(batch.num_rows):
                visit = index.first_visits(projected[i])
                if second and batch.column("found")[i].as_py() < k:
                    visit = ~visit
                elif second:
                    visit = index.visits(projected[i], batch.column("cosine")[i].as_py()) & ~visit
                table, bucket = np.nonzero(visit)
                areas = table * index.regions + bucket // _REGION
                for area in np.unique(areas).tolist():
                    for block in range(blocks.get(area, 0)):
                        out["which"].append(i)
                        out["area"].append(area)
                        out["block"].append(block)
                        out["visits"].append(bucket[areas == area])
            which = pa.array(out["which"], pa.int64())
            yield pa.RecordBatch.from_pydict({
                "query_row": batch.column("row_id").take(which),
                "query": batch.column("vec").take(which),
                "area": pa.array(out["area"], pa.int32()),
                "block": pa.array(out["block"], pa.int32()),
                "visits": pa.array(out["visits"], pa.list_(pa.int32())),
            })

    return queries.mapInArrow(
        probe,
        "query_row long, query array<double>, area int, block int, visits array<int>",
    )


def _scored(probes: DataFrame, indexed: DataFrame, k: int, query_blocks: int) -> DataFrame:
    """query_row, row_id, vec_id, score: the best k of each block for each of its queries."""
    share = F.pmod(F.xxhash64("query_row"), F.lit(query_blocks)).cast("int")
    left = probes.withColumn("share", share)
    right = indexed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def score(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ("query_row", "row_id", "vec_id", "score")
        found: dict[str, list] = {c: [] for c in names}
        in_order = held.sort_by([("vec_id", "ascending"), ("row_id", "ascending")])
        if asked.num_rows and held.num_rows:
            place = np.argsort(in_order["bucket"].to_numpy(), kind="stable")
            held = in_order.take(pa.array(place))
            vectors, queries = matrix(held["vec"]), matrix(asked["query"])
            units, asking = unit(vectors), unit(queries)
            bucket, row = held["bucket"].to_numpy(), held["row_id"].to_numpy()
            query_row = asked["query_row"].to_numpy()
            visits = asked["visits"].combine_chunks()
            visited = visits.flatten().to_numpy()
            visitor = np.repeat(np.arange(asked.num_rows), np.diff(visits.offsets.to_numpy()))
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.append(starts[1:], len(bucket))
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                who = visitor[visited == bucket[s]]
                if not len(who):
                    continue
                near = np.round(asking[who] @ units[s:e].T, 12)
                near[query_row[who][:, None] == row[s:e]] = -np.inf
                q, v = np.nonzero(best_of(near, k))
                a, b = queries[who[q]], vectors[s + v]
                norms = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
                with np.errstate(all="ignore"):
                    cosine = (a * b).sum(1) / norms
                wide = ~(np.isfinite(cosine) & (norms > 0))
                cosine[wide] = (asking[who[q]] * units[s + v]).sum(1)[wide]
                found["query_row"].append(query_row[who[q]])
                found["row_id"].append(row[s + v])
                found["vec_id"].append(place[s + v])
                found["score"].append(cosine)
        flat = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in found.items()}
        # A query may have met k vectors in each bucket here; the best k of all stay.
        order = np.lexsort((flat["vec_id"], -np.round(flat["score"], 12), flat["query_row"]))
        asked_by = flat["query_row"][order]
        nth = np.arange(len(order)) - np.searchsorted(asked_by, asked_by)
        flat = {c: v[order[nth < k]] for c, v in flat.items()}
        ids = in_order["vec_id"].combine_chunks().take(pa.array(flat["vec_id"].astype(np.int64)))
        return pa.table({
            "query_row": pa.array(flat["query_row"].astype(np.int64)),
            "row_id": pa.array(flat["row_id"].astype(np.int64)),
            "vec_id": ids,
            "score": pa.array(flat["score"].astype(np.float64)),
        })

    keys = ["area", "block", "share"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        score, "query_row long, row_id long, vec_id long, score double"
    )


def _nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(
        F.round("score", 12).desc(), F.col("vec_id").asc_nulls_last(), "row_id"
    )
    once = found.groupBy("query_row", "row_id").agg(
        F.first("vec_id").alias("vec_id"), F.first("score").alias("score")
    )
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    **settings,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for every query.

    Queries are the rows whose id is divisible by ``every``; all rows are indexed. Nearness
    is the cosine of the original vectors in double precision, ties (to 12 decimals) go to
    the smaller vec_id, null ids last. Rows that repeat are candidates of their own, and a
    query's own row never is. Vectors that are null, empty, zero or hold a null or non-finite
    component take no part. Vectors of different lengths have no cosine, so each length has an
    index of its own, and its queries find rows of their length. With k or fewer candidates all
    are returned. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = written(usable(vectors.select(vec_id, embedding), vec_id, embedding), "vectors")
    # One number per length that some query has.
    asked = F.count_if(F.col("vec_id") % every == 0)
    lengths = rows.groupBy(F.size("vec").alias("n")).agg(asked.alias("asked")).filter("asked > 0")
    found = [
        _nearest_of_length(rows.filter(F.size("vec") == n), Index(n, **settings), k, every)
        for n in sorted(row["n"] for row in lengths.collect())
    ]
    if not found:
        found = [_nearest_of_length(rows, Index(1, **settings), k, every)]
    return reduce(DataFrame.unionByName, found)


def _nearest_of_length(rows: DataFrame, index: Index, k: int, every: int) -> DataFrame:
    indexed = _indexed(rows, index)
    # At most a row for each region of each table, however many vectors there are.
    sizes = {r["area"]: r["count"] for r in indexed.groupBy("area").count().collect()}
    blocks = {area: -(-n // BLOCK) for area, n in sizes.items()}
    block_of = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]) if blocks else None
    count = F.coalesce(block_of[F.col("area")], F.lit(1)) if blocks else F.lit(1)
    indexed = indexed.withColumn("block", F.pmod(F.xxhash64("row_id"), count).cast("int"))

    queries = rows.filter(F.col("vec_id") % every == 0)
    asked = queries.count()
    query_blocks = max(1, -(-asked // QUERY_BLOCK))
    first = written(
        _nearest(_scored(_probes(queries, index, k, blocks), indexed, k, query_blocks), k), "first"
    )
    bound = first.groupBy(F.col("query_row").alias("row_id")).agg(
        F.count("*").alias("found"), F.min("score").alias("cosine")
    )
    again = queries.join(bound, "row_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    more = _scored(_probes(again, index, k, blocks), indexed, k, query_blocks)
    both = first.select("query_row", "row_id", "vec_id", "score").unionByName(more)
    ids = queries.select(F.col("row_id").alias("query_row"), F.col("vec_id").alias("query_id"))
    return _nearest(both, k).join(ids, "query_row").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
