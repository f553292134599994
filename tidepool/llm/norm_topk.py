"""Exact largest inner products, by buckets of vectors of like length.

Each worker sorts its vectors by length into buckets. For a query whose k-th best product so far is t, a bucket with
longest vector l asks for a cosine of t / (|q| l): above 1 the bucket is skipped; a high one makes it pay to look at the
query's largest coordinates first and to bound the rest by Cauchy-Schwarz; a low one leaves only vectors long enough.
What passes is verified by its product. First thresholds come from the longest vectors of all.

Queries are handled in blocks of QUERIES; each block is a broadcast of a fixed size, and its finds are written before the
next. A null id, a null or empty vector, or one with null or non-finite components takes no part. Vectors of different
dimension have no product, so each dimension is searched by itself. Components are whole numbers. Where a sum of products
could leave the 53 bits of a double, vectors with large components are handled by whole numbers of any size instead; a score
that doesn't fit in 64 bits is an error. A query is never its own candidate, nor is another row with its id; a query id that
occurs twice is asked once, with the smaller vector; repeated candidates are all candidates, ties go to smaller ids. A table
without queries or without candidates gives no rows; other columns are not looked at. Vectors are short, texts play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm import common

QUERIES, BUCKET, CHUNK, SEEDS = 16_384, 1024, 65_536, 2048
#: Local cosine threshold from which coordinates are looked at first, and how many of them.
COORDINATE_AT, FOCUS = 0.75, 12


class Best:
    """The k largest products of each query, ties to smaller ids."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least.copy()
        self.score = [np.zeros(0)] * n
        self.id = [np.zeros(0, np.int64)] * n

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[q], score]), np.concatenate([self.id[q], ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score[q], self.id[q] = score[order], ids[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], self.score[q][-1])


def search(query_id: np.ndarray, query: np.ndarray, best: Best, ids: np.ndarray, vectors: np.ndarray) -> None:
    """Adds to `best` what these candidates have."""
    length = np.sqrt((vectors * vectors).sum(1))
    order = np.argsort(-length, kind="stable")
    ids, vectors, length = ids[order], vectors[order], length[order]
    q_length = np.sqrt((query * query).sum(1))
    focus = np.argsort(-np.abs(query), axis=1)[:, :FOCUS]
    for a in range(0, len(ids), BUCKET):
        c, c_id, c_length = vectors[a : a + BUCKET], ids[a : a + BUCKET], length[a : a + BUCKET]
        reach = q_length * c_length[0]
        slack = 1e-6 * (1 + np.abs(best.least))
        live = np.flatnonzero(reach >= best.least - slack)
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach[live] > 0, best.least[live] / reach[live], -np.inf)
        by_coordinate = local >= COORDINATE_AT
        for q in live[by_coordinate].tolist():
            f = focus[q]
            part = c[:, f]
            rest = np.sqrt(np.maximum(0, c_length * c_length - (part * part).sum(1)) * max(0.0, q_length[q] ** 2 - (query[q, f] ** 2).sum()))
            near = np.flatnonzero(part @ query[q, f] + rest >= best.least[q] - slack[q])
            near = near[c_id[near] != query_id[q]]
            if len(near):
                score = c[near] @ query[q]
                hit = score >= best.least[q]
                if hit.any():
                    best.add(q, score[hit], c_id[near[hit]])
        some = live[~by_coordinate]
        for b in range(0, len(some), 1024):
            part = some[b : b + 1024]
            with np.errstate(divide="ignore", invalid="ignore"):
                long_enough = np.where(q_length[part] > 0, (best.least[part] - slack[part]) / q_length[part], -np.inf)
            n = int(np.searchsorted(-c_length, -long_enough.min(), "right"))
            score = query[part] @ c[:n].T
            hits = (score >= best.least[part, None]) & (c_id[None, :n] != query_id[part, None])
            for i in np.flatnonzero(hits.any(1)).tolist():
                h = np.flatnonzero(hits[i])
                best.add(int(part[i]), score[i, h], c_id[h])


def search_whole(query_id: np.ndarray, query: np.ndarray, found: dict, k: int, ids: np.ndarray, vectors: np.ndarray) -> None:
    """Keeps in found[q] the k best (-score, id) of query q and these candidates, in whole numbers of any size."""
    whole = np.array([[int(x) for x in v] for v in vectors.tolist()], object)
    for q, v in enumerate(query.tolist()):
        score = whole @ np.array([int(x) for x in v], object)
        found[q] = sorted(found.get(q, []) + [(-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != query_id[q]])[:k]


def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    return ids, batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(arrays(batch))
            n += batch.num_rows
        if n >= CHUNK:
            yield np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            held, n = [], 0
    if held:
        yield np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """query_id, rank, vec_id, score for the k largest inner products of every query with the other rows of its dimension.

    Components must be whole numbers.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    whole = F.expr(f"forall({vector_col}, x -> x IS NOT NULL AND abs(double(x)) < double('Infinity') AND NOT isnan(double(x)))")
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & whole & (F.size(vector_col) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), is_query.alias("asks"))
    schema = "query_id long, vec_id long, score long"
    folder = common.shared_dir(spark, "top-products")
    largest = F.expr("array_max(transform(v, x -> abs(x)))")
    asked = rows.where("asks").groupBy("vec_id").agg(F.min(F.struct(F.size("v").alias("n"), "v")).alias("q")).select("vec_id", "q.*")
    written = False
    # a row for each dimension, of which there are few
    for d in sorted(rows.groupBy(F.size("v").alias("n")).agg(F.max(largest).alias("most")).collect()):
        of, queries = rows.where(F.size("v") == d.n).select("vec_id", "v"), asked.where(F.col("n") == d.n)
        exact = math.isqrt((1 << 53) // d.n - 1)  # components up to this give sums of products that a double has
        if d.most <= exact:
            written |= search_all(queries, of, d.n, k, folder, schema)
        else:
            small, large = largest <= exact, largest > exact
            written |= search_all(queries.where(small), of.where(small), d.n, k, folder, schema)
            written |= search_all(queries.where(small), of.where(large), d.n, k, folder, schema, doubles=False)
            written |= search_all(queries.where(large), of, d.n, k, folder, schema, doubles=False)
    found = spark.read.schema(schema).parquet(folder) if written else spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_all(queries: DataFrame, candidates: DataFrame, dimension: int, k: int, folder: str, schema: str, doubles: bool = True) -> bool:
    """Appends what a block of queries after the other finds among the candidates to the folder; whether there was a query.

    A block's finds are written before the next is sent, so the driver and the workers hold one at a time.
    """
    spark = queries.sparkSession
    seed_id, seed = np.zeros(0, np.int64), np.zeros((0, dimension))
    if doubles:
        longest = candidates.orderBy(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)").desc(), "vec_id").limit(SEEDS).toArrow()
        if longest.num_rows:
            seed_id, seed = arrays(longest.combine_chunks().to_batches()[0])
    block: list = []
    asked = False

    def close():
        query_id, query = np.array([r.vec_id for r in block], np.int64), np.array([r.v for r in block], np.float64)
        block.clear()
        start = Best(len(query_id), k, np.full(len(query_id), -np.inf))
        search(query_id, query, start, seed_id, seed)
        sent = spark.sparkContext.broadcast((query_id, query, start.least))
        scan(candidates, sent, k, schema, doubles).write.mode("append").parquet(folder)
        sent.destroy()

    for row in queries.orderBy("vec_id").toLocalIterator():
        asked = True
        block.append(row)
        if len(block) == QUERIES:
            close()
    if block:
        close()
    return asked


def scan(rows: DataFrame, asked, k: int, schema: str, doubles: bool) -> DataFrame:
    def run(batches):
        query_id, query, least = asked.value
        best = Best(len(query_id), k, least)
        for ids, vectors in chunks(batches):
            search(query_id, query, best, ids, vectors)
        size = np.fromiter(map(len, best.id), np.int64, len(best.id))
        if size.sum():
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(query_id, size)), "vec_id": pa.array(np.concatenate(best.id).astype(np.int64)), "score": pa.array(np.concatenate(best.score).astype(np.int64))})

    def run_whole(batches):
        query_id, query, _ = asked.value
        found: dict[int, list] = {}
        for ids, vectors in chunks(batches):
            search_whole(query_id, query, found, k, ids, vectors)
        hits = [(int(query_id[q]), i, -s) for q, x in found.items() for s, i in x]
        if any(not -(1 << 63) <= s < 1 << 63 for _, _, s in hits):
            raise OverflowError("an inner product doesn't fit in 64 bits")
        if hits:
            yield pa.RecordBatch.from_pydict(dict(zip(("query_id", "vec_id", "score"), (pa.array(x, pa.int64()) for x in zip(*hits, strict=True)), strict=True)))

    return common.map_arrow(rows, run if doubles else run_whole, schema)


def op3_norm_topk(spark, sf_dir: str) -> DataFrame:
    # a double of 2**53 or more is a whole number; floor() gives 64 bits only
    scaled = "CASE WHEN x IS NULL OR isnan(x) OR abs(double(x)) = double('Infinity') THEN double(x) WHEN abs(64 * double(x)) < 9007199254740992D THEN double(floor(64 * double(x))) ELSE 64 * double(x) END"
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", F.expr(f"transform(embedding, x -> {scaled})").alias("v"))
    return top_products(rows, F.col("vec_id") % 20 == 0)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
