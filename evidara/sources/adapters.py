"""Dataset adapters as Python data sources: a source of samples that has no file format of its own is read in partitions like any other."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sample_id string, subject_id string, session_id string, text string, start_s double, end_s double, values array<array<double>>"


class Subjects(InputPartition):
    """The subjects that one task reads."""

    def __init__(self, subjects: list[int]):
        super().__init__(tuple(subjects))
        self.subjects = subjects


class Adapter(DataSource):
    """What a dataset adapter gives: its name, its samples' schema, and ``samples(subject)``, which runs in tasks.

    Options: ``subjects``, how many there are, ``subject_ids``, a JSON list of those to read (all), and ``partitions``, into how many tasks they are dealt."""

    def schema(self) -> str:
        return SCHEMA

    def samples(self, subject: int) -> Iterator[tuple]:
        raise NotImplementedError

    def subject_id(self, subject: int) -> str:
        """The id that the samples of a subject carry."""
        return f"s{subject}"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self)


class Reader(DataSourceReader):
    """Subjects are chosen before any is read.

    The choice is an option and not a pushed filter: Spark 4.1 keeps what a filter left with the source, so that another query over the same frame would miss the rest."""

    def __init__(self, adapter: Adapter):
        self.adapter = adapter
        self.subjects = list(range(int(adapter.options.get("subjects", 1))))
        if asked := adapter.options.get("subject_ids"):
            asked = set(json.loads(asked))
            self.subjects = [i for i in self.subjects if adapter.subject_id(i) in asked]

    def partitions(self) -> list[InputPartition]:
        step = max(1, -(-len(self.subjects) // int(self.adapter.options.get("partitions", 8))))
        return [Subjects(self.subjects[i : i + step]) for i in range(0, len(self.subjects), step)] or [Subjects([])]

    def read(self, partition: Subjects) -> Iterator[tuple]:
        for subject in partition.subjects:
            yield from self.adapter.samples(subject)


class SyntheticAdapter(Adapter):
    """Closed-form signals of two channels: options ``trials`` and ``steps`` for each subject, and ``seed``."""

    @classmethod
    def name(cls) -> str:
        return "synthetic_signals"

    def samples(self, subject: int) -> Iterator[tuple]:
        trials, steps, seed = (int(self.options.get(k, v)) for k, v in (("trials", 2), ("steps", 100), ("seed", 42)))
        for trial in range(trials):
            base = seed + 17 * subject + trial
            values = [[(base + 3 * t) % 23 / 23 for t in range(steps)], [(base + 5 * t + 11) % 29 / 29 for t in range(steps)]]
            yield f"s{subject}-t{trial}", f"s{subject}", f"s{subject}", f"trial {trial} of subject {subject}", float(trial), float(trial + 1), values


def read(spark: SparkSession, adapter: type[Adapter], subject_ids: list[str] | None = None, **options) -> DataFrame:
    """The samples of an adapter, which is registered with the session under its name; with ``subject_ids`` only those subjects are read."""
    spark.dataSource.register(adapter)
    if subject_ids is not None:
        options["subject_ids"] = json.dumps(subject_ids)
    return spark.read.format(adapter.name()).options(**options).load()
