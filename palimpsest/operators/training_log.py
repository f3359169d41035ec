"""Training histories: improvement, early stopping, learning-rate plateaus, overfitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def early_stopping(history: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "val_cer", patience: int = 10) -> DataFrame:
    """Adds is_best (strictly below all before), best_so_far, since_best (epochs) and keeps the rows up to the first
    with since_best >= patience, which has stopped = true."""
    w = Window.partitionBy(run).orderBy(epoch)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    out = history.withColumn("_n", F.row_number().over(w)).withColumn("_past", F.min(metric).over(past))
    out = out.withColumn("is_best", F.col("_past").isNull() | (F.col(metric) < F.col("_past")))
    out = out.withColumn("best_so_far", F.least("_past", metric)).withColumn("_at", F.max(F.when(F.col("is_best"), F.col("_n"))).over(w))
    out = out.withColumn("since_best", F.col("_n") - F.col("_at")).withColumn("stopped", F.col("since_best") >= patience)
    out = out.withColumn("_before", F.coalesce(F.max(F.col("stopped").cast("int")).over(past), F.lit(0)))
    return out.where("_before = 0").drop("_n", "_past", "_at", "_before")


def plateau_rates(history: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "val_loss", rate: float = 1e-3, factor: float = 0.5, patience: int = 5, threshold: float = 1e-4) -> DataFrame:
    """(run, epoch, learning_rate): the rate after each epoch, multiplied by factor once more than `patience` epochs in a
    row have not been below the best by the relative threshold. A fold over each run's epochs, which are bounded."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(metric).cast("double").alias("v"))))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(rate).alias("rate"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        better = x["v"] < s["best"] * (1 - threshold)
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        cut = bad > patience
        new = F.when(cut, s["rate"] * factor).otherwise(s["rate"])
        return F.struct(F.when(better, x["v"]).otherwise(s["best"]).alias("best"), F.when(cut, 0).otherwise(bad).alias("bad"), new.alias("rate"), F.concat(s["out"], F.array(new)).alias("out"))

    folded = history.groupBy(run).agg(rows.alias("rows")).select(run, "rows", F.aggregate("rows", start, step)["out"].alias("rates"))
    return folded.select(run, F.explode(F.arrays_zip("rows", "rates")).alias("x")).select(run, F.col("x.rows.e").alias("epoch"), F.col("x.rates").alias("learning_rate"))


def overfit_flags(history: DataFrame, train: str = "train_cer", val: str = "val_cer") -> DataFrame:
    """Adds overfits (train below val) and gap_percent (of val)."""
    gap = F.when(F.col(val) != 0, (F.col(val) - F.col(train)) / F.col(val) * 100)
    return history.withColumns({"overfits": F.col(train) < F.col(val), "gap_percent": gap})


def checkpoint_epochs(history: DataFrame, epoch: str = "epoch", every: int = 10) -> DataFrame:
    """Epochs at which a checkpoint is written besides the best."""
    return history.where(F.col(epoch) % every == 0)
