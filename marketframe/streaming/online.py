"""One-observation updates of the autoregressive model on a stream of bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DATE, SYMBOL
from ..functions.storage import delete
from ..models.ar import advance, end_state, predict_next
from ..plans.forecast import last_rows

COLUMNS = (SYMBOL, DATE, "close")


def _version(path: str, number: int, part: str) -> str:
    return f"{path}/version={number}/{part}"


def start_online_predictions(
    stream: DataFrame,
    history: DataFrame,
    params: DataFrame,
    state_path: str,
    output_path: str,
    checkpoint_path: str,
    replaceable: int = 40,
    available_now: bool = False,
) -> StreamingQuery:
    """For every micro-batch: append the new bars and predict each symbol's next one.

    A version of the state has two tables: the last ``replaceable`` bars of each symbol,
    and the model's state in front of them (last values and innovations), so a day
    among them that arrives again replaces the bar it had, exactly; earlier days are
    left alone. Of copies in one batch the highest close counts. Batch ``n`` reads version
    ``n`` and writes version ``n + 1`` and its predictions under its own number, so
    a batch that runs twice overwrites its own result and nothing is counted twice. Of
    the versions the last two are kept. All paths must be shared storage.
    """
    params = params.select(SYMBOL, "p", "d", "q", "n", "const", "phi", "theta", "sigma2", "aic")
    bars = history.select(*COLUMNS)
    recent = last_rows(bars, replaceable)
    recent.write.mode("ignore").parquet(_version(state_path, 0, "bars"))
    before = bars.join(recent.select(SYMBOL, DATE), [SYMBOL, DATE], "left_anti")
    end_state(before, params).write.mode("ignore").parquet(_version(state_path, 0, "front"))

    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = spark.read.parquet(_version(state_path, number, "bars")).select(*COLUMNS)
        front = spark.read.parquet(_version(state_path, number, "front"))
        new = batch.groupBy(SYMBOL, DATE).agg(F.max("close").alias("close"))
        passed = front.select(SYMBOL, "last_date")
        late = F.col("last_date").isNotNull() & (F.col(DATE) <= F.col("last_date"))
        new = new.join(passed, SYMBOL, "left").filter(~late).select(*COLUMNS)
        merged = kept.join(new, [SYMBOL, DATE], "left_anti").unionByName(new)
        touched = merged.join(new.select(SYMBOL).distinct(), SYMBOL, "left_semi")
        predicted = predict_next(advance(front, touched, params), params)
        predicted.write.mode("overwrite").parquet(f"{output_path}/batch={number}")
        recent = last_rows(merged, replaceable)
        recent.write.mode("overwrite").parquet(_version(state_path, number + 1, "bars"))
        gone = merged.join(recent.select(SYMBOL, DATE), [SYMBOL, DATE], "left_anti")
        moved = advance(front, gone, params)
        stay = front.join(gone.select(SYMBOL).distinct(), SYMBOL, "left_anti")
        stay.unionByName(moved).write.mode("overwrite").parquet(_version(state_path, number + 1, "front"))
        if number > 1:
            delete(spark, f"{state_path}/version={number - 1}")

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint_path)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
