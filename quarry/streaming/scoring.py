"""Score new rows with a fitted pipeline, batch or Structured Streaming.

Scoring is stateless (a ``PrepModel`` select + a Spark ML transform), so the
same plan runs on ``spark.readStream``; the sink is a parquet folder under
the shared checkpoint location, written exactly once per micro-batch by the
file sink's commit log.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.classify import assemble, class_scores
from quarry.session import checkpoint_dir


def score(df: DataFrame, prep, model, keep=()) -> DataFrame:
    """Batch or streaming frame -> (keep…, prediction, p0..p{k-1})."""
    feats = prep.feature_names
    t = prep.transform(df, keep=keep, with_label=False)
    out = model.transform(assemble(t, feats))
    return out.select(*keep, "prediction", *class_scores(prep.n_classes or 2))


def score_stream(spark: SparkSession, source: DataFrame, prep, model, keep=(),
                 prepare=None) -> DataFrame:
    """Run an availableNow stream over ``source`` (a streaming DataFrame),
    write predictions to parquet in the shared folder and return them."""
    base = os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    scored = score(prepare(source) if prepare else source, prep, model, keep)
    q = (scored.writeStream.format("parquet")
         .option("path", os.path.join(base, "out"))
         .option("checkpointLocation", os.path.join(base, "_ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(scored.schema).parquet(os.path.join(base, "out"))
