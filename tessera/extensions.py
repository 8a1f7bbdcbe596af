"""Extension points: models as SQL functions, table functions, and a data source for chat transcripts.

A caller's model is a plain function from a batch of texts to as many results. Nothing here loads one.
"""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.operators.trajectory import steps
from tessera.sources.transcripts import message

VECTOR, STEPS = "array<double>", "step_index int, tool_name string, start_sec double, end_sec double, note string"
#: Bytes of a transcript file that one task reads.
SPLIT = 64 << 20


def in_batches(texts: Sequence[str | None], model: Callable[[list[str]], Sequence[Any]]) -> list[Any]:
    """What ``model`` makes of each text; null for null ones and for those it fails on.

    Each distinct text is asked once for a batch. A batch that fails, or gives another number of results, is asked text by text.
    """
    asked = list(dict.fromkeys(t for t in texts if t is not None))
    try:
        got = list(model(asked)) if asked else []
        if len(got) != len(asked):
            raise ValueError("another number of results than texts")
    except Exception:  # noqa: BLE001
        got = []
        for t in asked:
            try:
                got.append(list(model([t]))[0])
            except Exception:  # noqa: BLE001
                got.append(None)
    held = dict(zip(asked, got, strict=True))
    return [None if t is None else held[t] for t in texts]


def register_model(spark: SparkSession, name: str, model: Callable[[list[str]], Sequence[Any]], returns: str = "string"):  # noqa: ANN201  a function of columns
    """A policy, judge, verifier or encoder as a function for columns and for SQL: ``name(text)``. An encoder returns ``array<double>``."""

    @F.pandas_udf(returns)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(in_batches([None if pd.isna(t) else t for t in texts], model), dtype=object)

    return spark.udf.register(name, run)


class OracleSteps:
    """``oracle_steps(duration, anomaly, precursor, moments)``: the steps a well-behaved agent takes on a clip."""

    def eval(self, duration: float, anomaly: list | None, precursor: list | None, moments: list | None) -> Iterator[tuple]:  # noqa: PLR6301
        if duration is not None:
            named = [m.asDict() if hasattr(m, "asDict") else dict(m) for m in moments or []]
            for i, s in enumerate(steps(duration, list(anomaly) if anomaly is not None else None, list(precursor) if precursor is not None else None, named), 1):
                yield (i, *s)


class ChatParts:
    """``chat_parts(record)``: role and text of a chat record (JSON text); no row for what holds no message."""

    def eval(self, record: str | None) -> Iterator[tuple]:  # noqa: PLR6301
        try:
            found = message(json.loads(record)) if record else None
        except ValueError:
            found = None
        if found:
            yield found


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("oracle_steps", F.udtf(OracleSteps, returnType=STEPS))
    spark.udtf.register("chat_parts", F.udtf(ChatParts, returnType="role string, text string"))


class Stretch(InputPartition):
    """Bytes of one file."""

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class TranscriptReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> Sequence[Stretch]:
        """Stretches of all ``.jsonl`` files; their number is that of the bytes over the split size."""
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(root)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        out = [Stretch(f.path, s, min(s + self.split, f.size)) for f in found if f.is_file and f.path.endswith(".jsonl") for s in range(0, f.size, self.split)]
        return out or [Stretch("", 0, 0)]

    def read(self, stretch: Stretch) -> Iterator[tuple]:
        """Lines that start in the stretch, each with the byte it starts at."""
        from pyarrow import fs

        if not stretch.path:
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(stretch.path) as file, io.BufferedReader(file, 1 << 20) as raw:
            raw.seek(max(stretch.start - 1, 0))
            at = raw.tell()
            if stretch.start:  # the line that the byte before belongs to is another task's
                at += len(raw.readline())
            while at < stretch.end:
                line = raw.readline()
                if not line:
                    break
                try:
                    found, error = message(json.loads(line)) if line.strip() else None, None
                except ValueError as e:
                    found, error = None, str(e)
                if found or error:
                    yield (stretch.path, at, *(found or (None, None)), error)
                at += len(line)


class Transcripts(DataSource):
    """``spark.read.format("transcripts").load(path)``: one row for each message of ``.jsonl`` chat transcripts.

    ``file``, ``offset`` (the byte at which the line starts), ``role``, ``text``, and ``error`` for a line that is no JSON. Lines
    without a message give no row. Files are read in stretches of ``split`` bytes, so a large one is many tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:  # noqa: PLR6301
        return "file string, offset long, role string, text string, error string"

    def reader(self, schema: object) -> TranscriptReader:  # noqa: ARG002
        path = self.options["path"]
        return TranscriptReader(path if "://" in path or path.startswith("file:") else f"file://{path}", int(self.options.get("split", SPLIT)))


def register(spark: SparkSession) -> None:
    """All table functions and data sources of this module."""
    register_table_functions(spark)
    spark.dataSource.register(Transcripts)
