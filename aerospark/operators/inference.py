"""Batch inference on executors, with a pluggable model."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospark.functions.json_cells import result_row, row_to_context
from aerospark.sources.tables import write_results


BATCH_SIZE = 32


def _answer(client, context: dict, model: str) -> tuple[str, str | None]:
    try:
        return json.dumps(client.infer(context, model), default=str), None
    except Exception as error:  # noqa: BLE001 - one row must not fail the run
        return "{}", str(error)


def _answers(client, contexts: list[dict], model: str) -> list[tuple[str, str | None]]:
    """One call for all contexts where the client can; a batch that fails is asked row by row."""
    many = getattr(client, "infer_batch", None)
    if many and len(contexts) > 1:
        try:
            found = many(contexts, model)
            if len(found) == len(contexts):
                return [(json.dumps(answer, default=str), None) for answer in found]
        except Exception:  # noqa: BLE001 - the single calls tell which row is to blame
            pass
    return [_answer(client, context, model) for context in contexts]


def _infer(make_client: Callable[[], object], model: str, size: int):
    """Work of one task: a client built once, ``size`` contexts a call, a failing row kept as an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            contexts, found = [json.loads(text) for text in batch["context"]], []
            for at in range(0, len(contexts), size):
                found += _answers(client, contexts[at: at + size], model)
            yield batch.drop(columns=["context"]).assign(
                answer=[answer for answer, _ in found], error=[error for _, error in found]
            )

    return run


def run_inference(
    rows: DataFrame, model: str, make_client: Callable[[], object], include_frames: bool = True,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """The result table for ``rows``: one result per row, a failure as its error.

    Contexts are built and answers counted in the JVM; only the context text
    crosses to Python and only the answer comes back.  Rows never leave the
    executors.  ``make_client`` is called once per task.  A client with
    ``infer_batch(contexts, model)`` gets up to ``batch_size`` contexts a call; if that
    fails or gives another number of answers, each context is asked for by itself.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    ids = [
        (F.col(name) if name in kinds else F.lit(None)).cast("string").alias(name)
        for name in ("video_id", "frame_index")
    ]
    asked = rows.select(*ids, row_to_context(kinds, include_frames).alias("context"))
    answered = asked.mapInPandas(
        _infer(make_client, model, batch_size),
        "video_id string, frame_index string, answer string, error string",
    )
    parsed = answered.withColumn("result", F.try_parse_json("answer"))
    made = result_row(
        F.col("video_id"), F.col("frame_index"), F.lit(model), F.col("result"), F.col("error")
    )
    return parsed.select(*made)


def run_inference_batch(
    rows: DataFrame, model: str, make_client: Callable[[], object],
    table: str | None = None, path: str | None = None, mode: str = "append",
    include_frames: bool = True, batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Run the model and, given a table or path, store the results.

    With a destination the returned table reads what was stored, so that the
    model is not run a second time.
    """
    results = run_inference(rows, model, make_client, include_frames, batch_size)
    if not (table or path):
        return results
    write_results(results, table, path, mode)
    spark = rows.sparkSession
    return spark.read.parquet(path) if path else spark.read.table(table)


def text_model(complete: Callable[[str], str]) -> Callable[[Column], Column]:
    """A text model as a column function; a failure or a null prompt gives null."""

    def one(prompt: str | None) -> str | None:
        if prompt is None:
            return None
        try:
            return complete(prompt)
        except Exception:  # noqa: BLE001 - the template takes over
            return None

    def answers(prompts: pd.Series) -> pd.Series:
        return prompts.map(one, na_action=None)

    return F.pandas_udf(answers, "string")
