"""Batch translation of a table through a user-supplied translator."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from lingweave.operators.joins import pending_rows
from lingweave.session import path_exists
from lingweave.sources.corpus import append_answers, read_answers

Translator = Callable[[list[str]], list[str]]


def require_columns(df: DataFrame, *columns: str) -> None:
    """Fail before any job runs when columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def translate(
    df: DataFrame, make_translator: Callable[[], Translator], src: str, out: str = "translations", batch: int = 32
) -> DataFrame:
    """Add the translations of ``src``; a null text stays null and is not sent.

    ``make_translator`` runs once per task (load a model, open a client there) and
    returns a function from a list of texts to a list of translations. The result counts as
    not deterministic, so no filter on it makes Spark call the translator twice for a row.
    """
    require_columns(df, src)

    @F.pandas_udf(T.StringType())
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        translator = make_translator()
        for texts in series:
            sent = texts[texts.notna()]
            done: list[str] = []
            for start in range(0, len(sent), batch):
                part = sent.iloc[start : start + batch].tolist()
                answers = translator(part)
                if len(answers) != len(part):
                    raise ValueError("a translator must return one answer per text")
                done += answers
            yield pd.Series(done, index=sent.index, dtype=object).reindex(texts.index, fill_value=None)

    return df.withColumn(out, run.asNondeterministic()(F.col(src)))


def remote_translator(
    connect: Callable[[], Callable[[str, str], str]], prompt: str
) -> Callable[[], Translator]:
    """A translator that sends one row at a time with a fixed instruction.

    ``connect`` opens a client inside the task and returns ``ask(prompt, text)``.
    """

    def make() -> Translator:
        ask = connect()
        return lambda texts: [ask(prompt, text) for text in texts]

    return make


def patient_translator(
    make_translator: Callable[[], Translator], attempts: int = 5, wait: float = 1.0, per_second: float | None = None
) -> Callable[[], Translator]:
    """A translator that asks again when a call fails, and that keeps a rate per task.

    A failed call is repeated after ``wait`` seconds, then twice as long each time; the last of
    ``attempts`` failures is raised, and a translator that could not be opened is opened again. ``per_second``
    bounds the calls of one task, repeated ones included; a whole job makes at most as many
    times that as it has task slots.
    """
    if attempts < 1:
        raise ValueError("attempts must be 1 or more")

    def make() -> Translator:
        translator: Translator | None = None
        free_at = 0.0

        def answer(texts: list[str]) -> list[str]:
            nonlocal translator, free_at
            for attempt in range(attempts):
                if per_second:
                    time.sleep(max(0.0, free_at - time.monotonic()))
                    free_at = time.monotonic() + 1 / per_second
                try:
                    translator = translator or make_translator()
                    return translator(texts)
                except Exception:
                    if attempt + 1 == attempts:
                        raise
                    time.sleep(wait * 2**attempt)
            raise AssertionError("unreachable")

        return answer

    return make


def translate_slices(
    df: DataFrame,
    make_translator: Callable[[], Translator],
    src: str,
    path: str,
    slices: int,
    row: str = "row_id",
    batch: int = 32,
) -> DataFrame:
    """Translate a table slice by slice into an answer log at ``path``; returns ``row_id, line``.

    A slice is the rows whose hashed ``row`` falls to it, whatever order or files they are in. It
    counts once its folder is whole, so a job that stops pays for the open slice only: a later call with the same
    ``path`` and number of slices sends no row of a finished one again. Another number of slices is
    refused. Rows without a text are not answered; nor are rows that are added to a finished slice
    (use :func:`translate_pending`). Every open slice reads ``df`` again, so pass a stored table. Answers are stored by :func:`~lingweave.sources.corpus.append_answers`.
    """
    require_columns(df, row, src)
    spark = df.sparkSession
    base = path.rstrip("/")
    name = lambda k: f"slice-{k}-of-{slices}"
    if path_exists(spark, base):
        written = spark._jvm.org.apache.hadoop.fs.Path(base)
        folders = written.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(written)
        others = [n for f in folders if (n := str(f.getPath().getName())).startswith("run=slice-") and not n.endswith(f"-of-{slices}")]
        if others:
            raise ValueError(f"{path} holds slices of another number: {others[0]}")
    asked = df.where(F.col(src).isNotNull()).withColumn("_slice", F.pmod(F.xxhash64(F.col(row).cast("string")), F.lit(slices)))
    for k in range(slices):
        if not path_exists(spark, f"{base}/run={name(k)}/_SUCCESS"):
            part = translate(asked.where(F.col("_slice") == k), make_translator, src, "_answer", batch)
            append_answers(part, base, "_answer", row, run=name(k))
    return read_answers(spark, base, df.schema[row].dataType.simpleString())


def translate_text(text: str, make_translator: Callable[[], Translator]) -> str:
    """Translate one string, as an interactive check."""
    return make_translator()([text])[0]


def translate_pending(
    df: DataFrame, answered: DataFrame, make_translator: Callable[[], Translator], src: str, row: str = "row_id"
) -> DataFrame:
    """Translate only the rows without an answer, so a stopped run can go on."""
    return translate(pending_rows(df, answered, row), make_translator, src)


def source_target(df: DataFrame, src: str, out: str = "translations") -> DataFrame:
    """The (source, translation) pairs."""
    return df.select(F.col(src).alias("src"), F.col(out).alias("translation"))


