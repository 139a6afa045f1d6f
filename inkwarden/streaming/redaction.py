"""Redaction of a stream of texts, and placeholders that stay the same over a session's whole stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import entities, pseudonyms


def read_texts(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def redacted(stream: DataFrame, text_col: str = "text", level: str = "demo-safe") -> DataFrame:
    """Stateless: every text with its entities blacked out."""
    found = entities.detect(stream, text_col, level)
    return found.withColumn("redacted", entities.redact(found, text_col)).withColumn("n_entities", F.size("entities")).drop("entities")


def numbered_keys(stream: DataFrame, session: str, text_col: str = "text", level: str = "demo-safe") -> DataFrame:
    """Stateful: each new key of a session with its number, in order of arrival.

    ``session``, ``grp``, ``number_key``, ``n``; the state of a session is one number for each of its keys.
    """
    found = entities.detect(stream, text_col, level).select(session, F.explode("entities").alias("e")).select(session, "e.cat", "e.text", "e.start")
    keyed = pseudonyms.keys(found).select(session, "grp", "number_key", "start")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, numbers = state.get if state.exists else ([], [])
        seen, new = dict(zip(known, numbers)), []
        for frame in frames:
            for k in frame.sort_values("start", ascending=False)["number_key"]:
                if k not in seen:
                    seen[k] = len(seen) + 1
                    new.append(k)
        state.update((list(seen), list(seen.values())))
        yield pd.DataFrame({session: [key[0]] * len(new), "grp": [key[1]] * len(new), "number_key": new, "n": [seen[k] for k in new]})

    kind = stream.schema[session].dataType.simpleString()
    return keyed.groupBy(session, "grp").applyInPandasWithState(run, f"{session} {kind}, grp string, number_key string, n long", "keys array<string>, numbers array<long>", "append", GroupStateTimeout.NoTimeout)
