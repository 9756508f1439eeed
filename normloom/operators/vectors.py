"""Vectors of nodes: length, soft edges to the nearest, principal components.

Defined results: null vectors have no length and no neighbours; of equal
similarities the smaller id wins; with a single vector or k = 0 there are no
soft edges; a component without spread keeps its raw scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normloom.runtime import written

#: Vectors of a block; of the orphans' blocks all meet all blocks, one pair of blocks at a time.
BLOCK_ROWS = 8_192


def dot(a: Column, b: Column) -> Column:
    """Scalar product in double precision, in order of the elements."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector divided by its length; zero vectors stay."""
    d = v.cast("array<double>")
    # The length is bound to a variable once; written into the inner function it would be computed for every element.
    divided = F.transform(F.array(norm(v)), lambda n: F.when(n == 0, d).otherwise(F.transform(d, lambda x: x / n)))
    return F.element_at(divided, 1)


def hashed_embedding(texts: DataFrame, key: str, text: str, width: int = 64) -> DataFrame:
    """(key, embedding): TF-IDF of hashed words at length 1, where no model is at hand."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    stages = [RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="_w", outputCol="_f", numFeatures=width), IDF(inputCol="_f", outputCol="_i"), Normalizer(inputCol="_i", outputCol="_n")]
    rows = texts.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    done = Pipeline(stages=stages).fit(rows).transform(rows)
    return done.select(key, vector_to_array("_n", "float32").alias("embedding"))


def provided_embedding(texts: DataFrame, key: str, text: str, provider) -> DataFrame:
    """(key, embedding) by ``provider()``, which is called once in each worker and returns texts -> matrix."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = provider()
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({key: batch[key], "embedding": list(np.asarray(model(batch[text].fillna("").tolist()), np.float32))})

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def _packed(rows: DataFrame, name: str, block_rows: int) -> DataFrame:
    """(name, ids, vs): vectors packed into blocks of rows."""
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    kind = dict(rows.dtypes)["id"]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        return pd.DataFrame({name: [frame["b"].iloc[0]], "ids": [frame["id"].tolist()], "vs": [np.array(frame["v"].tolist(), np.float64).tobytes()]})

    placed = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return written(placed.groupBy("b").applyInPandas(pack, f"{name} long, ids array<{kind}>, vs binary"), name)


def nearest(queries: DataFrame, base: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(source, target, similarity): the k rows of ``base`` with the greatest scalar product for each of ``queries``, itself left out.

    Both have id and v.  Exact, in units of two blocks; of each unit only k rows of a query go on.
    """
    kind = dict(base.dtypes)["id"]
    shape = f"source {kind}, target {kind}, similarity double"
    if k < 1:
        return base.sparkSession.createDataFrame([], shape)
    good = lambda df: df.filter(F.col("v").isNotNull() & F.col("id").isNotNull()).select("id", F.col("v").cast("array<double>").alias("v"))
    left, right = _packed(good(queries), "q", block_rows), _packed(good(base), "b", block_rows)
    # Every query block names every base block: a list of numbers, then an equi-join on them.
    names = right.select("b").distinct().agg(F.collect_list("b").alias("bs"))
    units = left.select("q", F.lit(1).alias("_one")).join(names.withColumn("_one", F.lit(1)), "_one").select("q", F.explode("bs").alias("b"))
    units = written(units.withColumn("unit", F.xxhash64("q", "b")), "units")
    asks = units.join(left, "q").select("unit", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
    holds = units.join(right, "b").select(F.col("unit").alias("b_unit"), F.col("ids").alias("b_ids"), F.col("vs").alias("b_vs"))

    def search(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        q_ids, b_ids = np.array(q["q_ids"][0]), np.array(b["b_ids"][0])
        x, y = (np.frombuffer(v).reshape(len(i), -1) for v, i in ((q["q_vs"][0], q_ids), (b["b_vs"][0], b_ids)))
        out = []
        for a in range(0, len(x), 512):
            s = np.round(x[a : a + 512] @ y.T, 12)
            s[q_ids[a : a + 512, None] == b_ids[None]] = -np.inf
            edge = np.partition(s, len(y) - k, axis=1)[:, len(y) - k] if len(y) > k else np.full(len(s), -1e300)
            i, j = np.nonzero((s >= edge[:, None]) & (s > -np.inf))
            out.append(pd.DataFrame({"source": q_ids[a : a + 512][i], "target": b_ids[j], "similarity": s[i, j]}))
        return pd.concat(out)

    met = asks.groupBy("unit").cogroup(holds.groupBy("b_unit")).applyInPandas(search, shape)
    w = Window.partitionBy("source").orderBy(F.col("similarity").desc(), "target")
    return met.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def soft_edges(orphans: DataFrame, base: DataFrame, k: int = 5, weight: float = 0.1) -> DataFrame:
    """(source, target, type, weight, cos): soft edges of the orphans to their nearest vectors, other orphans included."""
    near = nearest(orphans, base, k)
    return near.select("source", "target", F.lit("soft").alias("type"), F.lit(weight).alias("weight"), F.round("similarity", 6).alias("cos"))


def pca_z(rows: DataFrame, component: int = 0, scale: float = 1.0) -> DataFrame:
    """(id, z): z-scores of a principal component, the largest loading positive; without spread the raw scores."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    good = rows.filter(F.col("v").isNotNull()).select("id", array_to_vector(F.col("v").cast("array<double>")).alias("f"))
    model = PCA(k=component + 1, inputCol="f", outputCol="p").fit(good)
    loading = model.pc.toArray()[:, component]
    sign = 1.0 if loading[np.abs(loading).argmax()] >= 0 else -1.0
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(good).select("id", (vector_to_array("p")[component] * sign).alias("s"))
    mean, std = scored.agg(F.avg("s"), F.stddev_pop("s")).first()
    spread = std if std and std > 1e-12 else 1.0
    return scored.select("id", ((F.col("s") - F.lit(mean)) / spread * scale).alias("z"))
