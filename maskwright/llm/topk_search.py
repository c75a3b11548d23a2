"""Operator 10: exact top-k search by a three-phase uniform threshold.

The score of a query and a candidate is a sum over `slices` groups of dimensions, and each slice has a list of its own
scores. For a block of queries:

1. each task takes the k best of each slice's list of its candidates, adds up their exact scores and sends the k best;
   the k-th best of what all tasks sent is a safe cutoff t, since the answer holds no score below it;
2. t is broadcast. A candidate whose slices all score under t / slices has a sum under t, so only entries with a slice
   of t / slices or more are collected, and of these only those whose bound (known slices, t / slices for others)
   reaches t;
3. the slices that are still missing are added for these, and each task sends at most its k best of t or more, ties to
   the smaller vec_id. The k best of all are ranked.

Components become floor(64 * x). Products are float32 where sums stay under 2**24 and float64 under 2**53, so that
they are exact; larger ones are Python integers, cut to the range of long. Queries go in blocks of at most BLOCK_BYTES,
each broadcast on its own; candidates are read where they lie and are never shuffled.

Defined cases: vectors that are null or hold a null or non-finite component take no part. Shorter vectors count as
padded with zeros. A component whose 64-fold is over the range of double counts as the largest double. Rows that share a vec_id: each is a candidate, none for a query of that id, and the query is the
largest of their vectors. A null vec_id takes no part. Other columns are not read.
"""

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm.common import lean, new_path, read

K, SLICES, BLOCK_BYTES, CANDIDATES = 20, 4, 16 << 20, 4096
LONG, LARGEST = 2**63 - 1, np.finfo(np.float64).max


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v array<double> of whole numbers, for vectors that take part."""
    big = F.lit(float("inf"))
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    ok = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != big), F.lit(False)))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok)


def matrix(column, wide: int | None = None) -> np.ndarray:
    """floor(64 * x) of an Arrow list column, padded with zeros."""
    offsets = column.offsets.to_numpy()
    with np.errstate(over="ignore"):
        flat = np.floor(64 * column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]])
    flat = np.clip(flat, -LARGEST, LARGEST)
    n = np.diff(offsets)
    wide = max(int(n.max(initial=1)), wide or 1, 1)
    if (n == wide).all():
        return flat.reshape(-1, wide)
    out = np.zeros((len(n), wide))
    out[np.arange(wide) < n[:, None]] = flat
    return out


def kind_for(q: np.ndarray, c: np.ndarray):
    with np.errstate(over="ignore"):
        most = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[1], c.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def whole(m: np.ndarray, kind):
    return np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) if kind is object else np.ascontiguousarray(m, kind)


def as_float(m: np.ndarray) -> np.ndarray:
    """Whole numbers of any size as doubles, cut to their range."""
    most = int(LARGEST)
    return np.array([[float(max(-most, min(most, x))) for x in row] for row in m], np.float64).reshape(m.shape)


def sliced(q: np.ndarray, c: np.ndarray, slices: int):
    """The scores of each slice: a matrix of queries and candidates for each."""
    wide = min(q.shape[1], c.shape[1])
    cuts = np.linspace(0, wide, slices + 1).astype(int)
    return [q[:, a:b] @ c[:, a:b].T if b > a else np.zeros((len(q), len(c)), q.dtype) for a, b in zip(cuts, cuts[1:], strict=False)]


def search_block(candidates: DataFrame, qids: np.ndarray, queries: np.ndarray, k: int, slices: int) -> DataFrame:
    import pyarrow as pa

    spark = candidates.sparkSession
    block = spark.sparkContext.broadcast((qids, queries))
    names = ["query_id", "vec_id", "score"]

    def walk(batches):
        """(query ids, ids of candidates, query matrix, candidate matrix) of up to CANDIDATES rows."""
        qid, q = block.value
        for batch in batches:
            for a in range(0, len(batch), CANDIDATES):
                part = batch.slice(a, CANDIDATES)
                ids, c = part.column(0).to_numpy(), matrix(part.column(1))
                kind = kind_for(q, c)
                yield qid, ids, whole(q, kind), whole(c, kind)

    def merge(held, new, n):
        """Keeps the k best of each query: held and new are (query index, vec_id, score)."""
        q, i, s = (np.concatenate(x) for x in zip(held, new, strict=True)) if held else new
        order = np.lexsort((i, -s if s.dtype != object else np.array([-x for x in s], object), q))
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        stay = rank < k
        return q[stay], i[stay], s[stay]

    def sent(qid, held):
        if held and len(held[0]):
            score = np.array([max(-LONG - 1, min(LONG, int(x))) for x in held[2]], np.int64) if held[2].dtype == object else held[2].astype(np.int64)
            for a in range(0, len(score), 50_000):
                z = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(qid[held[0][z]]), pa.array(held[1][z]), pa.array(score[z])], names)

    def gather(batches):
        held, qid = None, block.value[0]
        for qid, ids, q, c in walk(batches):
            for a in range(0, len(q), 256):
                parts = sliced(q[a : a + 256], c, slices)
                own = ids[None, :] == qid[a : a + 256, None]
                top = []
                for p in parts:
                    # a query's own row may be among them: one more covers it unless its id repeats, which costs only tightness
                    n = min(k + 1, len(ids))
                    top.append(np.argpartition(-p, n - 1, 1)[:, :n] if p.dtype != object else np.argsort(-p, 1)[:, :n])
                at = np.sort(np.concatenate(top, 1), 1)
                rows = np.arange(len(at))[:, None]
                new = np.concatenate((np.ones((len(at), 1), bool), at[:, 1:] != at[:, :-1]), 1) & ~own[rows, at]
                total = sum(p[rows, at] for p in parts)
                qi = np.broadcast_to(rows + a, at.shape)[new]
                held = merge(held, (qi, ids[at[new]], total[new].astype(np.int64) if total.dtype != object else total[new]), k)
        yield from sent(qid, held)

    schema = "query_id long, vec_id long, score long"
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = candidates.mapInArrow(lean(gather), schema).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    cut = ranked.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-LONG - 1)).alias("cut")).toArrow()
    cutoff = np.full(len(qids), -LONG - 1, np.int64)
    where = {int(x): i for i, x in enumerate(qids)}
    for x, s in zip(cut.column("query_id").to_pylist(), cut.column("cut").to_pylist(), strict=True):  # a number for each query of the block
        cutoff[where[x]] = s
    cutoffs = spark.sparkContext.broadcast(cutoff)

    def collect(batches):
        held, qid, least = None, block.value[0], cutoffs.value
        for qid, ids, q, c in walk(batches):
            for a in range(0, len(q), 256):
                t = least[a : a + 256, None].astype(np.float64)
                share = t / slices - 1e-6 * np.abs(t) - 1e-6  # a little below: rounding must not lose an entry
                parts = sliced(q[a : a + 256], c, slices)
                enough = np.zeros((len(t), len(ids)), bool)
                bound = np.zeros((len(t), len(ids)), np.float32)
                for p in parts:
                    f = as_float(p) if p.dtype == object else p
                    known = f >= share
                    enough |= known
                    bound += np.where(known, f, share.astype(np.float32) + np.float32(1e-5) * np.abs(share).astype(np.float32))
                enough &= bound >= t - 1e-5 * np.abs(t) - 1
                enough |= t <= -LONG  # fewer than k are known: all are wanted
                enough &= ids[None, :] != qid[a : a + 256, None]
                qi, ci = np.nonzero(enough)
                total = sum(p[qi, ci] for p in parts)
                total = total.astype(np.int64) if total.dtype != object else total
                if total.dtype == object:
                    total = np.array([max(-LONG - 1, min(LONG, int(x))) for x in total], np.int64)
                stay = total >= least[a + qi]
                held = merge(held, (qi[stay] + a, ids[ci[stay]], total[stay]), k)
        yield from sent(qid, held)

    return (
        candidates.mapInArrow(lean(collect), schema).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def search(queries: DataFrame, candidates: DataFrame, k: int = K, slices: int = SLICES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query."""
    spark = candidates.sparkSession
    q = usable(queries, id_col, vec_col)
    c = usable(candidates, id_col, vec_col)
    size = q.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    blocks = max(1, -(-size[0] * 8 * max(1, size[1]) // (BLOCK_BYTES // 2)))
    path = new_path(spark, "topk")
    for b in range(blocks):
        mine = q.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).groupBy("vec_id").agg(F.max("v").alias("v")).toArrow()
        if mine.num_rows:
            ids, v = mine.column(0).to_numpy(), matrix(mine.column(1).combine_chunks())
            order = np.argsort(ids)
            search_block(c, ids[order], v[order], k, slices).write.mode("append").parquet(path)
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(path) if size[0] else spark.createDataFrame([], schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return search(vectors.filter("vec_id % 20 = 0"), vectors)


ORACLE = """
WITH v AS (SELECT vec_id, [CAST(floor(64 * x::DOUBLE) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
