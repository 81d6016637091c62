"""Sources: cases, profiles, edges, nested traces, embeddings and memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE = "agent_id long, age int, gender string, occupation string, household_id long, cluster string, vaccination_status int, comorbidity_count int, compliance_score double"
EDGE = "agent_1 long, agent_2 long, edge_type string, contact_rate double"
TRACES = (
    "scenarios array<struct<scenario_id: string, scenario_name: string, traces: array<struct<agent_id: long, age: int, occupation: string,"
    " conversations: array<struct<timestep: int, state: string, transition: string, response: string, tools_used: array<string>>>, behavioral_motifs: map<string, string>>>>>"
)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Case CSV: headers trimmed and lower-cased, bad dates and numbers null, rows without them dropped, states checked."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    missing = {"case", "date", "age"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    for name, default in (("gender", "unknown"), ("nationality", "unknown"), ("day_0", ""), ("imported", ""), ("cluster_local", ""), ("link", "")):
        raw = raw.withColumn(name, F.coalesce(F.col(name) if name in raw.columns else F.lit(None).cast("string"), F.lit(default)))
    state = F.upper(F.trim("day_0"))
    raw = raw.withColumn("case", F.col("case").try_cast("long")).withColumn("date", F.col("date").try_cast("date")).withColumn("age", F.col("age").try_cast("double"))
    raw = raw.withColumn("day_0", F.when(state.isin("S", "E", "I", "R", "D"), state).otherwise("S"))
    return raw.na.drop(subset=["case", "date", "age"]).orderBy("date", "case")


def read_profiles(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One JSON array a file, or JSON lines, which Spark splits, without ``multi_line``."""
    return spark.read.schema(PROFILE).json(path, multiLine=multi_line)


def read_edges(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One JSON array a file, or JSON lines, which Spark splits, without ``multi_line``."""
    return spark.read.schema(EDGE).json(path, multiLine=multi_line)


def read_embeddings(spark: SparkSession, path: str, size: int, vec: str = "embedding") -> DataFrame:
    """Rows whose vector has ``size`` entries; others raise when read."""
    df = spark.read.parquet(path)
    wrong = F.concat(F.lit("embedding of size "), F.size(vec).cast("string"))
    return df.withColumn(vec, F.when(F.size(vec) == size, F.col(vec)).otherwise(F.raise_error(wrong)))


def flatten_traces(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conversations, tool calls, motifs) from nested traces."""
    t = df.select(F.explode("scenarios").alias("s")).select("s.scenario_id", F.explode("s.traces").alias("t")).select("scenario_id", "t.*")
    talk = t.select("scenario_id", "agent_id", F.posexplode("conversations").alias("turn", "c")).select("scenario_id", "agent_id", "turn", "c.*")
    tools = talk.select("scenario_id", "agent_id", "timestep", F.explode("tools_used").alias("tool"))
    return talk.drop("tools_used"), tools, t.select("scenario_id", "agent_id", F.explode("behavioral_motifs").alias("axis", "motif"))


def normalize_assignments(df: DataFrame, column: str = "assignments") -> DataFrame:
    """(agent_id, cluster_id) from cluster -> members or agent -> cluster maps."""
    if df.schema[column].dataType.valueType.typeName() == "array":
        m = df.select(F.explode(column).alias("cluster_id", "_m")).select(F.explode("_m").alias("agent_id"), F.col("cluster_id").cast("int").alias("cluster_id"))
    else:
        m = df.select(F.explode(column).alias("agent_id", "cluster_id"))
    return m.select(F.col("agent_id").cast("long").alias("agent_id"), F.col("cluster_id").cast("int").alias("cluster_id"))
