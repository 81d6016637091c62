"""Archetypes of short descriptions: hashed term vectors, a reduced basis and k-means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from popgraph.plans.stage import stage

#: Fewer distinct descriptions than this keep their term vectors as they are.
LEAST_FOR_PCA = 5


def first_descriptions(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, description): the first description of each entity that is not null, ties to the smaller text."""
    return df.where(F.col(text).isNotNull()).groupBy(key).agg(F.min_by(text, F.struct(order, text)).alias("description"))


def archetypes(described: DataFrame, key: str, k: int = 12, terms: int = 128, dims: int = 50, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Archetypes of (key, description): one table of entities and one of archetypes.

    Entities: (key, archetype, one_hot, profile), ``profile`` being the standardized
    coordinates of the description in the reduced basis. Archetypes: (archetype,
    entities, descriptions, example), the example being the most frequent description,
    ties to the smaller text. Each distinct description counts once in the fit, so
    copies do not pull the centres. The basis comes from a covariance of ``terms``
    squared; ``k`` and ``dims`` shrink to what the distinct descriptions allow.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, StandardScaler
    from pyspark.ml.functions import vector_to_array

    rows = described.select(key, F.col("description").cast("string")).where("description is not null")
    distinct = stage(rows.groupBy("description").agg(F.count(F.lit(1)).alias("n")), "archetypes")
    found = distinct.count()
    if found == 0:
        nobody = rows.select(key, F.lit(0).alias("archetype"), F.array().cast("array<double>").alias("one_hot"), F.array().cast("array<double>").alias("profile"))
        none = distinct.select(F.lit(0).alias("archetype"), F.col("n").alias("entities"), F.col("n").alias("descriptions"), F.col("description").alias("example"))
        return nobody.limit(0), none.limit(0)
    x = distinct.withColumn("_w", F.regexp_extract_all(F.lower("description"), F.lit(r"[a-z0-9]+"), 0))
    x = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=terms).transform(x)
    x = IDF(inputCol="_tf", outputCol="_idf").fit(x).transform(x)
    x = Normalizer(inputCol="_idf", outputCol="_unit").transform(x)
    basis = "_unit"
    if found >= LEAST_FOR_PCA:
        x = PCA(k=min(dims, terms, found), inputCol="_unit", outputCol="_pca").fit(x).transform(x)
        basis = "_pca"
    k = min(k, found)
    if k > 1:
        x = KMeans(k=k, seed=seed, featuresCol=basis, predictionCol="archetype").fit(x).transform(x)
    else:
        x = x.withColumn("archetype", F.lit(0))
    x = StandardScaler(inputCol=basis, outputCol="_z", withMean=True).fit(x).transform(x) if found > 1 else x.withColumn("_z", F.col(basis))
    hot = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == F.col("archetype"), 1.0).otherwise(0.0))
    coded = stage(x.select("description", "n", "archetype", hot.alias("one_hot"), vector_to_array("_z").alias("profile")), "archetypes-coded")
    entities = rows.join(coded, "description").select(key, "archetype", "one_hot", "profile")
    catalogue = coded.groupBy("archetype").agg(F.sum("n").alias("entities"), F.count(F.lit(1)).alias("descriptions"), F.min_by("description", F.struct(-F.col("n"), "description")).alias("example"))
    return entities, catalogue
