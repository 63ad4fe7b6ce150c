"""An extension: labels for points that arrive in a stream, by votes of fixed labelled cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.distributed import core_votes


def assign_stream(points: DataFrame, cores: DataFrame, core_points: DataFrame, path: str, checkpoint: str, k: int = 3, measure: str = "cosine") -> StreamingQuery:
    """Appends (id, cluster) of streamed points(id, v) to the folder `path`; each micro-batch is one X9 vote."""

    def batch(df: DataFrame, epoch: int) -> None:
        own = df.join(cores.select("id"), "id", "left_anti")
        both = own.select("id", "v").unionByName(core_points.select("id", "v"))
        core_votes(both, cores, k, measure).join(own.select("id"), "id", "left_semi").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
