"""Exact top-k search by exhaustive term-at-a-time accumulation.

Every component of a vector is a term and every vector a document with integer weights. Candidates are packed into
blocks of postings (term -> rows and weights); a block of queries walks the terms one after another and scatters
``query weight x postings`` into dense score arrays, from which each query's k best are selected by partition. A task keeps
each query's k best over all its blocks; the tasks' lists are merged by rank. Every (query, candidate) pair is scored once:
the result is exact.

Queries go to the tasks in rounds whose bytes are measured before they are sent, so candidates stay where they are.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import trimmed

#: Rows of a candidate block and of a query block.
BLOCK, QUERIES = 4096, 512
#: Bytes of the queries that are sent to the tasks at once; more queries take more rounds.
ROUND_BYTES = 64 << 20

_PACKED = "n int, dims int, ids binary, weights binary, marks binary"


def quantise(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as a long; out-of-range values saturate."""
    x = np.floor(scale * values.astype(np.float64))
    top = float(2**63)
    return np.where(x >= top, np.iinfo(np.int64).max, np.where(x < -top, np.iinfo(np.int64).min, np.clip(x, -top, top - 1024))).astype(np.int64)


def _rows(batch: pa.RecordBatch) -> tuple[list[int], list[np.ndarray]]:
    """Ids and vectors that take part."""
    ids, vectors = [], []
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        if i is None or not v.is_valid or (x := v.values).null_count:
            continue
        x = x.to_numpy(zero_copy_only=False)
        if np.isfinite(x).all():
            ids.append(i)
            vectors.append(x)
    return ids, vectors


def _packer(rows: int, scale: float):
    """Blocks of rows that differ in id or weights, each with a hash of its weights."""

    def pack(batches):
        held: dict[tuple[int, int], np.ndarray] = {}

        def block() -> pa.RecordBatch:
            n, dims = len(held), max(map(len, held.values()))
            matrix = np.zeros((n, dims), np.int64)
            for k, v in enumerate(held.values()):
                matrix[k, : len(v)] = v
            ids, marks = (np.array(x, np.int64).tobytes() for x in zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((n, dims, ids, matrix.T.tobytes(), marks), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["n", "dims", "ids", "weights", "marks"])

        for batch in batches:
            for i, v in zip(*_rows(batch), strict=True):
                v = np.trim_zeros(quantise(v, scale), "b")  # components that are missing are 0
                held[i, int.from_bytes(blake2b(v.tobytes(), digest_size=8).digest(), "little", signed=True)] = v
                if len(held) >= rows:
                    yield block()
        if held:
            yield block()

    return pack


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, best first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], ~scores[at]))][:k]  # ~s falls as s rises, without overflow


def accumulate(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of query rows (queries x terms) against postings (terms x candidates), a term at a time."""
    scores = np.zeros((len(q), c.shape[1]), np.int64)
    with np.errstate(over="ignore"):
        for term in range(min(q.shape[1], c.shape[0])):
            weights = c[term]
            posted = np.flatnonzero(weights)
            asking = np.flatnonzero(q[:, term])
            if not len(posted) or not len(asking):
                continue
            if len(posted) == len(weights) and len(asking) == len(q):
                scores += q[:, term, None] * weights
            else:
                scores[np.ix_(asking, posted)] += q[asking, term, None] * weights[posted]
    return scores


class Best:
    """The k best candidates of each query of a block so far; candidates that agree in id and weights count once."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.lists: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * n
        self.least = np.full(n, np.iinfo(np.int64).min)  # the score that a candidate must reach

    def add(self, at: int, scores: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> None:
        places = best(scores, ids, self.k)
        new = (scores[places], ids[places], marks[places])
        old = self.lists[at]
        s, i, m = new if old is None else (np.concatenate(x) for x in zip(old, new, strict=True))
        order = np.lexsort((m, i, ~s))
        s, i, m = s[order], i[order], m[order]
        fresh = np.ones(len(s), bool)
        fresh[1:] = (i[1:] != i[:-1]) | (m[1:] != m[:-1])
        self.lists[at] = s, i, m = s[fresh][: self.k], i[fresh][: self.k], m[fresh][: self.k]
        if len(s) == self.k:
            self.least[at] = s[-1]


def _scorer(k: int, blocks):
    """``blocks`` is a broadcast list of query blocks."""

    def score(batches):
        queries = [(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["marks"], np.int64), np.ascontiguousarray(np.frombuffer(r["weights"], np.int64).reshape(r["dims"], r["n"]).T)) for r in blocks.value]
        tops = [Best(len(ids), k) for ids, _, _ in queries]
        for batch in batches:
            for r in batch.to_pylist():
                ids, marks = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["marks"], np.int64)
                c = np.frombuffer(r["weights"], np.int64).reshape(r["dims"], r["n"])
                for (qids, _, q), top in zip(queries, tops, strict=True):
                    for at in range(0, len(qids), 64):  # 64 dense arrays of one block stay in cache
                        scores = accumulate(q[at : at + 64], c)
                        for j in np.flatnonzero(scores.max(axis=1, initial=np.iinfo(np.int64).min) >= top.least[at : at + 64]).tolist():
                            near = (scores[j] >= top.least[at + j]) & (ids != qids[at + j])
                            top.add(at + j, scores[j][near], ids[near], marks[near])
        for (qids, qmarks, _), top in zip(queries, tops, strict=True):
            rows = [(np.full(len(x[0]), qids[j]), x[1], x[0], x[2], np.full(len(x[0]), qmarks[j])) for j, x in enumerate(top.lists) if x is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=["query_id", "vec_id", "score", "mark", "q_mark"])

    return trimmed(score)


def top_k(df: DataFrame, queries: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query row's k highest integer inner products: query_id, rank (from 1), vec_id, score; ties to smaller ids.

    ``queries`` is the condition that makes a row a query; candidates are all rows but those with the query's id.
    Defined cases: null ids, null vectors and vectors with null or non-finite components take no part; missing
    components of shorter vectors are 0, so empty vectors score 0; rows repeated whole (same id, same vector) count
    once; fewer than k candidates give all; an empty table gives no rows; other columns are ignored whatever their
    names. Arithmetic is that of 64-bit longs.
    """
    spark = df.sparkSession
    cells = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), queries.alias("asks"))
    asked = cells.where("asks").select("id", "v").dropDuplicates(["id", "v"]).mapInArrow(_packer(QUERIES, scale), _PACKED)
    asked = materialize(asked.withColumn("block", F.xxhash64("ids", "weights")).withColumn("bytes", F.length("weights") + 2 * F.length("ids")), "topk-queries")
    count, size = asked.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    packed = cells.select("id", "v").mapInArrow(_packer(BLOCK, scale), _PACKED)
    schema = "query_id long, vec_id long, score long, mark long, q_mark long"
    # Rounds by the hash of a block, more of them until none is too large; a block itself has a fixed number of rows.
    rounds = 1 if size <= ROUND_BYTES else max(1, min(2 * -(-size // ROUND_BYTES), 4 * count))
    number = lambda: F.pmod("block", F.lit(rounds))
    while rounds > 1 and rounds < 4 * count and asked.groupBy(number()).agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] > ROUND_BYTES:
        rounds *= 2
    lists = spark.createDataFrame([], schema)
    for k_round in range(rounds if count else 0):
        blocks = asked.where(number() == k_round).select("n", "dims", "ids", "weights", "marks").toArrow().to_pylist()
        if blocks:
            found = packed.mapInArrow(_scorer(k, spark.sparkContext.broadcast(blocks)), schema)
            lists = lists.union(materialize(found, "topk-lists") if rounds > 1 else found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lists.dropDuplicates(["query_id", "vec_id", "score", "mark", "q_mark"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
