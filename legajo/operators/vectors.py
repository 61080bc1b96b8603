"""Exact similarity search of a stated query set against all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block on either side; a task holds two blocks and their products.
BLOCK = 2048


def top_similar(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, score, place): the ``k`` vectors of highest positive cosine for each query, itself left out.

    Both sides are cut into blocks by a hash of the id.  A pair of blocks is one
    matrix product whose best ``k`` per query go on, so neither side is gathered
    whole and the candidates merged per query are ``k`` for each block.  Ties go
    to the smaller id.  Null, empty and all-zero vectors are left out; vectors of
    another length than a query's are not compared with it.
    """
    wanted = F.col("e").isNotNull() & (F.size("e") > 0)
    left = queries.select(F.col(vec_id).cast("bigint").alias("query_id"), F.col(embedding).cast("array<double>").alias("e")).where(wanted)
    right = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).where(wanted)
    q_blocks, v_blocks = (max(1, -(-side.count() // block)) for side in (left, right))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("vb", spread(v_blocks))
    right = right.withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.lit(v_blocks)).cast("int")).withColumn("qb", spread(q_blocks))

    def products(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})]
        for size, own in q.groupby(q["e"].map(len)):
            others = v[v["e"].map(len) == size]
            if len(others):
                out.append(_best(own, others, k))
        return pd.concat(out)

    near = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(products, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _best(q: pd.DataFrame, v: pd.DataFrame, k: int) -> pd.DataFrame:
    a, b = np.stack(q["e"].to_numpy()), np.stack(v["e"].to_numpy())
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    scores = np.round(np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0), 6)
    ids, keys = v["vec_id"].to_numpy(), q["query_id"].to_numpy()
    scores[keys[:, None] == ids[None, :]] = 0.0
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    found = np.take_along_axis(scores, order, axis=1)
    flat = pd.DataFrame({"query_id": np.repeat(keys, order.shape[1]), "vec_id": ids[order].ravel(), "score": found.ravel()})
    return flat[flat["score"] > 0]


def fit_cells(vectors: DataFrame, cells: int, sample: int = 5000, rounds: int = 12, vec_id: str = "vec_id", embedding: str = "embedding") -> np.ndarray:
    """Centres of ``cells`` cells by spherical k-means on the ``sample`` vectors of smallest hash, a bounded and repeatable sample."""
    known = vectors.select(F.col(vec_id).alias("i"), F.col(embedding).cast("array<double>").alias("e")).where("i is not null and size(e) > 0")
    part = min(1.0, 1.2 * sample / max(1, known.count()))
    near = known.withColumn("place", F.pmod(F.xxhash64("i"), F.lit(1 << 40))).where(F.col("place") < int(part * (1 << 40))).orderBy("place", "i").limit(sample)
    m = np.array([row.e for row in near.collect()], dtype=float)
    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    centres = m[:: max(1, len(m) // cells)][:cells].copy()
    for _ in range(rounds):
        own = (m @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                mean = m[own == c].mean(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    return centres


def cell_search(vectors: DataFrame, queries: DataFrame, k: int = 10, cells: int = 16, probes: int = 12, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Approximate :func:`top_similar`: every vector is indexed in its nearest cell, a query looks into its ``probes`` nearest.

    Cells have no cap; one larger than ``block`` is spread over salts, and its
    queries go to each of them.
    """
    centres = fit_cells(vectors, cells, vec_id=vec_id, embedding=embedding)

    def placed(depth: int):  # noqa: ANN202
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                m = np.stack(frame["e"].to_numpy()) if len(frame) else np.zeros((0, centres.shape[1]))
                near = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :depth]
                yield pd.DataFrame({"id": np.repeat(frame["id"].to_numpy(), near.shape[1]), "e": [e for e in frame["e"] for _ in range(near.shape[1])], "cell": near.ravel().astype("int32")})

        return run

    side = lambda df: df.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("e")).where(F.size("e") == centres.shape[1])
    index = side(vectors).mapInPandas(placed(1), "id bigint, e array<double>, cell int").withColumnRenamed("id", "vec_id")
    salts = max(1, -(-vectors.count() // (block * max(1, cells // 4))))
    index = index.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int"))
    asked = side(queries).mapInPandas(placed(probes), "id bigint, e array<double>, cell int").withColumnRenamed("id", "query_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def products(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        return _best(q, v, k) if len(q) and len(v) else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    near = asked.groupBy("cell", "salt").cogroup(index.groupBy("cell", "salt")).applyInPandas(products, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def maximum_mean_discrepancy(df: DataFrame, group: str, value: str, features: int = 64, seed: int = 7) -> DataFrame:
    """(mmd2): squared RBF discrepancy of the two groups of ``value`` (true and false) by random Fourier features, in one aggregate.

    The bandwidth is the median distance to the median.
    """
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=features), rng.uniform(0, 2 * np.pi, size=features)
    middle = F.broadcast(df.agg(F.percentile_approx(value, 0.5, 10_000).alias("mid")))
    spread = F.broadcast(df.crossJoin(middle).agg(F.greatest(F.percentile_approx(F.abs(F.col(value) - F.col("mid")), 0.5, 10_000), F.lit(1e-9)).alias("scale")))  # both of one row
    scaled = df.crossJoin(spread).select(F.col(group).alias("g"), (F.col(value) / F.col("scale")).alias("x"))
    means = scaled.agg(*[(F.avg(F.when(F.col("g"), F.cos(F.col("x") * float(wi) + float(bi)))) - F.avg(F.when(~F.col("g"), F.cos(F.col("x") * float(wi) + float(bi))))).alias(f"d{i}") for i, (wi, bi) in enumerate(zip(w, b))])
    total = sum((F.col(f"d{i}") * F.col(f"d{i}") for i in range(features)), F.lit(0.0))
    return means.select((total * 2 / features).alias("mmd2"))


def coherence(vectors: DataFrame, group: str = "label", embedding: str = "embedding") -> DataFrame:
    """(group, n, coherence): mean cosine over all pairs of different vectors of a group, without forming a pair.

    The sum over pairs is the squared length of the sum of unit vectors less their number.
    """
    known = vectors.select(F.col(group).alias("g"), F.col(embedding).cast("array<double>").alias("e")).where("g is not null and size(e) > 0")
    unit = known.withColumn("norm", F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))).where("norm > 0")
    sums = unit.select("g", "norm", F.posexplode("e").alias("dim", "x")).groupBy("g", "dim").agg(F.sum(F.col("x") / F.col("norm")).alias("s"), F.count("*").alias("n"))
    return sums.groupBy(F.col("g").alias(group)).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).where("n > 1").select(group, "n", ((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))
