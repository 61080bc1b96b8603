"""Components, layers, effects and proofs on graphs, with twins by recursion."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.functions.canonical import canonical_digest
from legajo.functions.session import cut, ensure_checkpoint_dir, table
from legajo.operators import folds, graphs, lineage, transport
from legajo.operators.hierarchy import dependency_edges
from legajo.plans.frames import _EDGES, _nation_edges
from legajo.plans.problems import _KEY


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nation_edges(spark, sf_dir).withColumn("confidence", ((F.col("a") * 7 + F.col("b") * 3) % 10 + 1) / 10)


def g4_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.closeness(_nation_edges(spark, sf_dir)).select("node", F.round("closeness", 6).alias("closeness"))


def g10_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.weighted_effects(_weighted(spark, sf_dir)).select("a", "b", F.round("strongest", 6).alias("strongest"), F.round("decayed", 6).alias("decayed"))


def g11_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of node 7 reaches once the edges into it are cut."""
    return graphs.reachable(_nation_edges(spark, sf_dir).where("b <> 7"), spark.range(7, 8).select(F.col("id").alias("node")))


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = table(spark, sf_dir, "pipeline_index")
    return graphs.topological_layers(components.select(F.col("code").alias("node")).where("node is not null"), dependency_edges(components))


def h12_topological_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _layers(spark, sf_dir)


def h12_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of each layer of the dependencies; -1 holds those on a cycle or after one."""
    return _layers(spark, sf_dir).groupBy("layer").agg(F.count("*").alias("n"))


def g19_topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer and place within the layer of each component that has an order."""
    known = _layers(spark, sf_dir).where("layer >= 0")
    return known.select("node", "layer", F.row_number().over(Window.partitionBy("layer").orderBy("node")).cast("bigint").alias("place"))


def g19_back_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies on a component that was first published after the one that needs it."""
    components = table(spark, sf_dir, "pipeline_index")
    first = cut(components.where("code is not null").groupBy("code").agg(F.min("generated_at").alias("at")))
    at = lambda node, name: first.select(F.col("code").alias(node), F.col("at").alias(name))
    return dependency_edges(components).join(at("a", "a_at"), "a").join(at("b", "b_at"), "b").where("a_at > b_at").select("a", "b")


def h9_verified_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaf whether the hashes beside its way lead from it to the stored root."""
    customer = table(spark, sf_dir, "customer")
    first = customer.agg(F.min("c_custkey")).collect()[0][0]
    levels = lineage.merkle_levels(customer.select((F.col("c_custkey") - F.lit(first)).alias("place"), F.sha2("c_name", 256).alias("hash")))
    # a way has as many steps as the tree has levels
    ways = lineage.inclusion_proofs(levels).groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "sibling", "on_left"))).alias("steps"))
    climbed = F.aggregate("steps", F.col("hash"), lambda h, s: F.when(s["on_left"], F.sha2(F.concat(s["sibling"], h), 256)).otherwise(F.sha2(F.concat(h, s["sibling"]), 256)))
    root = levels[-1].select(F.col("hash").alias("root"))
    reached = ways.join(levels[0].select(F.col("place").alias("leaf"), "hash"), "leaf").select("leaf", climbed.alias("reached"))
    return reached.crossJoin(F.broadcast(root)).select("leaf", (F.col("reached") == F.col("root")).alias("holds"))  # root is one row


def t15_canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids of payloads whatever the order of their keys; null for what is no JSON."""
    return table(spark, sf_dir, "aggregation_artifact").select("record_id", F.concat(F.lit("art_"), F.substring(canonical_digest(F.col("payload")), 1, 16)).alias("stable_id"))


def h5_salted_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "aggregation_artifact").select("record_id", canonical_digest(F.col("payload"), salt="legajo").alias("digest"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of each region: groups of a handful of rows."""
    return table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name").where("n_nationkey is not null and n_regionkey is not null")


def o2_sinkhorn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass moved between the nations of a region and as many even places, at least cost of distance, with the error of its margins."""

    def move(pdf):  # noqa: ANN001, ANN202
        n = len(pdf)
        keys = np.sort(pdf["n_nationkey"].to_numpy(dtype=float)) / 25
        even = (np.arange(n) + 0.5) / n
        plan = transport.sinkhorn(np.abs(keys[:, None] - even[None]), np.full(n, 1 / n), np.full(n, 1 / n))
        return pd.DataFrame({"region": [int(pdf["n_regionkey"].iloc[0])], "mass": [round(float(plan.sum()), 6)], "error": [round(float(np.abs(plan.sum(1) - 1 / n).max()), 6)]})

    return _regions(spark, sf_dir).groupBy("n_regionkey").applyInPandas(move, "region int, mass double, error double")


def o6_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of the entropic alignment of each region's distances with even ones, its entropy term and the bound on what the entropy costs."""
    reg = 0.01

    def align(pdf):  # noqa: ANN001, ANN202
        n = len(pdf)
        keys = np.sort(pdf["n_nationkey"].to_numpy(dtype=float))
        own, base = np.abs(keys[:, None] - keys[None]) / 25, np.abs(np.arange(n)[:, None] - np.arange(n)[None]) / n
        plan, cost = transport.gromov_wasserstein(own, base, np.full(n, 1 / n), np.full(n, 1 / n), reg)
        return pd.DataFrame({"region": [int(pdf["n_regionkey"].iloc[0])], "cost": [round(cost, 5)], "objective": [round(cost + reg * transport.plan_entropy(plan), 5)], "bound": [round(transport.entropic_bound(reg, n), 6)]})

    return _regions(spark, sf_dir).groupBy("n_regionkey").applyInPandas(align, "region int, cost double, objective double, bound double")


def o6_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of each region matched with those of region 0 by the letters of their names at least cost; even keys are one kind, odd ones another."""
    first = [(int(r.n_nationkey), set(r.n_name)) for r in _regions(spark, sf_dir).where("n_regionkey = 0").orderBy("n_nationkey").collect()]  # a handful

    def match(pdf):  # noqa: ANN001, ANN202
        own = sorted(zip(pdf["n_nationkey"].astype(int), map(set, pdf["n_name"])), key=lambda r: r[0])
        costs = transport.jaccard_costs([w for _, w in own], [w for _, w in first], ([k % 2 for k, _ in own], [k % 2 for k, _ in first]))
        pairs = transport.assign(costs) if first else []
        return pd.DataFrame({"nation": [own[i][0] for i, _ in pairs], "partner": [first[j][0] for _, j in pairs], "cost": [round(float(costs[i, j]), 6) for i, j in pairs]})

    return _regions(spark, sf_dir).groupBy("n_regionkey").applyInPandas(match, "nation int, partner int, cost double")


def s11_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors written as JSON lines and read back: size and sum of each."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/vectors-{uuid.uuid4().hex}"
    table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label").write.json(path)
    stored = spark.read.schema("vec_id bigint, embedding array<double>, label int").json(path)
    return stored.select("vec_id", "label", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def h10_coverage_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the items of each order those that cover most within a budget; large items need the order's first one."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("task"), "l_quantity", F.array("l_returnflag", "l_linestatus", F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("covers"))
    first = items.groupBy("l_orderkey").agg(F.min("task").alias("first"))
    needs = F.when((F.col("l_quantity") > 40) & (F.col("task") != F.col("first")), F.array("first"))
    tasks = items.join(first, "l_orderkey").select("l_orderkey", "task", "covers", F.col("l_quantity").alias("cost"), needs.alias("needs"))
    return folds.coverage_choice(tasks, "l_orderkey", 100.0)


QUERIES = {f.__name__: f for f in (g4_closeness, g10_effect, g11_counterfactual, h12_topological_layers, h12_layers, g19_topological_order, g19_back_edges, h9_verified_proofs, t15_canonical_ids, h5_salted_digests, o2_sinkhorn, o6_alignment, o6_assignment, s11_vector_index, h10_coverage_choice)}

_DEPENDENCIES = f"""c AS (SELECT code, unnest(dependencies) AS entry FROM pipeline_index WHERE code IS NOT NULL), k AS (SELECT {_KEY.format("code")} AS key, min(code) AS target FROM pipeline_index WHERE code IS NOT NULL GROUP BY 1),
    d AS (SELECT DISTINCT target AS a, code AS b FROM c JOIN k ON {_KEY.format("entry")} = key WHERE key <> '')"""
# the longest way into a node; as many steps as there are nodes only come from a cycle
_LAYERED = f"""{_DEPENDENCIES}, s AS (SELECT count(DISTINCT code) AS n FROM pipeline_index), r AS (SELECT DISTINCT a AS node, 0 AS steps FROM d WHERE a <> b UNION SELECT b, steps + 1 FROM r JOIN d ON node = a, s WHERE a <> b AND steps < n),
    l AS (SELECT node, CASE WHEN max(steps) >= any_value(n) THEN -1 ELSE max(steps) END AS layer FROM r, s GROUP BY node), o AS (SELECT DISTINCT code AS node, coalesce(layer, 0)::INTEGER AS layer FROM pipeline_index LEFT JOIN l ON l.node = code WHERE code IS NOT NULL)"""

ORACLES = {
    "g4_closeness": f"WITH RECURSIVE {_EDGES}, u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), r AS (SELECT a, b, 1 AS steps FROM u UNION SELECT r.a, u.b, steps + 1 FROM r JOIN u ON r.b = u.a WHERE steps < 25), p AS (SELECT a, b, min(steps) AS steps FROM r WHERE a <> b GROUP BY ALL), n AS (SELECT count(*) AS n FROM (SELECT a FROM e UNION SELECT b FROM e)) SELECT a AS node, round(count(*) / sum(steps)::DOUBLE * count(*) / (any_value(n) - 1), 6) AS closeness FROM p, n GROUP BY a",
    "g10_effect": f"WITH RECURSIVE {_EDGES}, w AS (SELECT DISTINCT a, b, ((a * 7 + b * 3) % 10 + 1) / 10.0::DOUBLE AS c FROM e WHERE a <> b), r AS (SELECT [a, b] AS path, c AS p, 1 AS n FROM w UNION ALL SELECT list_append(path, b), p * c, n + 1 FROM r JOIN w ON path[-1] = a WHERE NOT list_contains(path, b) AND n < 6) SELECT path[1] AS a, path[-1] AS b, round(max(p), 6) AS strongest, round(sum(p * power(0.9, n - 1)), 6) AS decayed FROM r GROUP BY 1, 2",
    "g11_counterfactual": f"WITH RECURSIVE {_EDGES}, r AS (SELECT b AS node FROM e WHERE a = 7 AND b <> 7 UNION SELECT b FROM r JOIN e ON node = a WHERE b <> 7) SELECT node FROM r",
    "h12_topological_layers": f"WITH RECURSIVE {_LAYERED} SELECT node, layer FROM o",
    "h12_layers": f"WITH RECURSIVE {_LAYERED} SELECT layer, count(*) AS n FROM o GROUP BY layer",
    "g19_topological_order": f"WITH RECURSIVE {_LAYERED} SELECT node, layer, row_number() OVER (PARTITION BY layer ORDER BY node) AS place FROM o WHERE layer >= 0",
    "g19_back_edges": f"WITH {_DEPENDENCIES}, f AS (SELECT code, min(generated_at) AS at FROM pipeline_index GROUP BY code) SELECT a, b FROM d JOIN f x ON x.code = a JOIN f y ON y.code = b WHERE x.at > y.at",
    "s11_vector_index": "SELECT vec_id, label, len(embedding)::INTEGER AS dims, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
    "o2_sinkhorn": "SELECT n_regionkey AS region, 1.0::DOUBLE AS mass, 0.0::DOUBLE AS error FROM nation GROUP BY n_regionkey",
    "h9_verified_proofs": "SELECT c_custkey - min(c_custkey) OVER () AS leaf, true AS holds FROM customer",
}
