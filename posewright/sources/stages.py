"""Versioned stage artifacts of a content-addressed cache, as Parquet folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stages and the stages that are built from them directly.
EDGES = [("compressed", "stabilization"), ("compressed", "pose"), ("stabilization", "pose"), ("pose", "reid"), ("reid", "arena"), ("stabilization", "arena"), ("arena", "metrics"), ("compressed", "audio"), ("audio", "metrics")]


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "stage string, dependent string")


def closure(spark: SparkSession) -> DataFrame:
    """(stage, dependent) for every stage that must be rebuilt when a stage changes, however far down."""
    edges(spark).createOrReplaceTempView("posewright_stage_edges")
    return spark.sql("""WITH RECURSIVE reach(stage, dependent) AS (
        SELECT stage, dependent FROM posewright_stage_edges UNION ALL
        SELECT r.stage, e.dependent FROM reach r JOIN posewright_stage_edges e ON e.stage = r.dependent)
      SELECT DISTINCT stage, dependent FROM reach""")


def content_hashes(spark: SparkSession, glob: str) -> DataFrame:
    """(path, content, length): the digest of each source file's bytes. A file is one row, so of 2 GB at most."""
    return spark.read.format("binaryFile").load(glob).select("path", F.sha2("content", 256).alias("content"), "length")


def artifact_path(root: str, content: str, stage: str, version: int) -> str:
    return f"{root}/{content}/stages/{stage}.v{version}.parquet"


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def store(df: DataFrame, root: str, content: str, stage: str, version: int) -> str:
    path = artifact_path(root, content, stage, version)
    df.write.mode("overwrite").parquet(path)
    return path


def has(spark: SparkSession, root: str, content: str, stage: str, version: int) -> bool:
    """Whether the artifact has been written whole; asked of the file system that holds it."""
    files, at = _at(spark, f"{artifact_path(root, content, stage, version)}/_SUCCESS")
    return files.exists(at)


def stored(spark: SparkSession, root: str, content: str, stage: str, version: int) -> DataFrame | None:
    """The artifact, or None where it has not been built."""
    return spark.read.parquet(artifact_path(root, content, stage, version)) if has(spark, root, content, stage, version) else None


def stale(spark: SparkSession, changed: list[str]) -> DataFrame:
    """Stages to be rebuilt after changes."""
    reach = closure(spark)
    return reach.where(reach["stage"].isin(changed)).select("dependent").distinct()


def invalidate(spark: SparkSession, root: str, content: str, stage: str) -> list[str]:
    """Removes all versions of a stage and of what is built from it, however far down; returns their stages."""
    gone = sorted({stage, *(r[0] for r in stale(spark, [stage]).collect())})  # names of stages, a dozen at most
    for name in gone:
        files, at = _at(spark, f"{root}/{content}/stages/{name}.v*.parquet")
        for found in files.globStatus(at) or []:
            files.delete(found.getPath(), True)
    return gone


def rebuild(spark: SparkSession, root: str, content: str, versions: dict[str, int], builders: dict[str, tuple[list[str], Callable[..., DataFrame]]]) -> list[str]:
    """Builds the stages that are not stored at their version, each from the stored ones that it names; returns them.

    builders come in an order in which a stage's inputs are ahead of it. Nothing that is stored is built again."""
    built = []
    for stage, (inputs, make) in builders.items():
        if not has(spark, root, content, stage, versions[stage]):
            frames = [stored(spark, root, content, i, versions[i]) for i in inputs]
            if any(f is None for f in frames):
                raise ValueError(f"{stage} needs {inputs}, which are not all stored")
            store(make(*frames), root, content, stage, versions[stage])
            built.append(stage)
    return built


def refresh_arena(spark: SparkSession, root: str, content: str, versions: dict[str, int], refresh: Callable[[DataFrame, DataFrame], DataFrame]) -> list[str]:
    """The arena anew from stored poses and stored maps between frames: neither is told again."""
    invalidate(spark, root, content, "arena")
    return rebuild(spark, root, content, versions, {"arena": (["pose", "stabilization"], refresh)})


def staleness(built: DataFrame, key: str = "content") -> DataFrame:
    """(key, stage, dependent, stale) for the stages that are stored and depend on each other, however far down; stale
    where what it depends on has been stored later. built: (key, stage, at), the last time each was stored."""
    reach = closure(built.sparkSession)
    upper = built.select(key, "stage", F.col("at").alias("_at"))
    lower = built.select(key, F.col("stage").alias("dependent"), F.col("at").alias("_below"))
    return upper.join(F.broadcast(reach), "stage").join(lower, [key, "dependent"]).select(key, "stage", "dependent", (F.col("_at") > F.col("_below")).alias("stale"))
