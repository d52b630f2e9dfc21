"""Calls of a language model from tasks, with replies that are stored and not asked for again."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import staging

SCHEMA = "digest string, reply string, error string, attempts int, model string"
MOST_TASKS = 1024  # tasks of one run at most, or four for each core


@dataclass(frozen=True)
class Asking:
    """How a model is asked.

    ``store`` is a folder of replies (of this run alone if None); ``model`` tells models and their options apart, and is part
    of what a reply is found by. A call that raises is tried ``tries`` times, with pauses of ``pause`` seconds that double.
    """

    client: Callable[[str], str]
    model: str = "model"
    store: str | None = None
    threads: int = 4
    tries: int = 3
    pause: float = 0.5
    prompts_per_task: int = 50


def stored(spark: SparkSession, how: Asking) -> DataFrame:
    """(digest, reply) of what the model has answered; one row for each digest, though a task that ran twice may have stored two."""
    rows = spark.read.schema(SCHEMA).parquet(how.store) if staging.exists(spark, how.store) else spark.createDataFrame([], SCHEMA)
    return rows.where((F.col("model") == how.model) & F.col("error").isNull()).groupBy("digest").agg(F.min("reply").alias("reply"))


def ask_model(df: DataFrame, key: str, prompt: str, how: Asking | Callable[[str], str]) -> DataFrame:
    """(key, reply, error): the model's reply to each row's prompt, or the message of the last failure; a null prompt is not sent and has neither.

    Each distinct prompt without a stored reply is sent once, and the replies of a task are in the store as soon as it
    ends, even if the job fails later: what a run repeats after a loss are the unfinished tasks, of
    ``prompts_per_task`` prompts each, or of a ``MOST_TASKS``th of all prompts where that is more (each task starts a process and writes
    files, so their number must not grow with the prompts). Failures are stored with their message, and asked again by the next run. The result is read
    from tables, so further actions on it call nothing.
    """
    how = how if isinstance(how, Asking) else Asking(how)
    spark = df.sparkSession
    if how.store is None:
        how = Asking(how.client, how.model, f"{staging.folder(spark)}/replies-{time.time_ns()}", how.threads, how.tries, how.pause, how.prompts_per_task)
    digest = F.sha2(F.concat_ws("\n", F.lit(how.model), prompt), 256)
    asked = staging.staged(df.select(key, prompt, F.when(F.col(prompt).isNotNull(), digest).alias("digest")), "asked")
    missing = asked.where("digest is not null").select("digest", prompt).dropDuplicates(["digest"]).join(stored(spark, how), "digest", "left_anti")
    missing = staging.staged(missing, "missing")

    client, tries, first_pause, threads = how.client, how.tries, how.pause, how.threads  # all that is sent to the tasks

    def one(text: str) -> tuple[str | None, str | None, int]:
        pause = first_pause
        for attempt in range(1, tries + 1):
            try:
                return client(text), None, attempt
            except Exception as error:  # the last one becomes the row's error
                message = f"{type(error).__name__}: {error}"
            if attempt < tries:
                time.sleep(pause)
                pause *= 2
        return None, message, tries

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                replies = list(pool.map(one, frame[prompt]))
                yield pd.DataFrame(replies, columns=["reply", "error", "attempts"]).assign(digest=frame["digest"].values)

    tasks = min(-(-missing.count() // how.prompts_per_task), max(MOST_TASKS, 4 * spark.sparkContext.defaultParallelism))
    failed = spark.createDataFrame([], "digest string, error string")
    if tasks:
        new = missing.repartition(tasks, "digest").mapInPandas(run, "reply string, error string, attempts int, digest string")
        rows = new.select("digest", "reply", "error", "attempts", F.lit(how.model).alias("model"))
        # version 2: a task's files count when the task ends
        rows.write.mode("append").partitionBy("model").option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("compression", "zstd").parquet(how.store)
        seen = spark.read.schema(SCHEMA).parquet(how.store).where((F.col("model") == how.model) & F.col("error").isNotNull())
        failed = seen.join(missing.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max("error").alias("error"))
    out = asked.join(stored(spark, how), "digest", "left").join(failed, "digest", "left")
    return out.select(key, "reply", F.when(F.col("reply").isNull(), F.col("error")).alias("error"))
