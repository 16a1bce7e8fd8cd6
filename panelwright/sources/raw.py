"""Raw answers of services: a store that is written through Spark and never half seen, and a stream of calls that resumes.

``raw_answers`` is a data source for (key, payload) rows. A task writes one compressed file; the commit of a
batch names the files of the tasks that succeeded, in one file of its own that appears at once. What a
failed task or batch leaves is named nowhere, and an abort removes it.

``table_years`` is a stream over the tables of a service that answers for two years a call: offsets count
tables, the calls of a table are partitions, and a restarted query goes on behind its checkpoint.
"""

from __future__ import annotations

import gzip
import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.grids import CUBE, merge_cubes
from ..operators.relational import first_per_key
from .services import get_json, year_calls


def folder_of(address: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a folder's address; a path without a scheme is local."""
    return pafs.FileSystem.from_uri(address) if ":/" in address else (pafs.LocalFileSystem(), address)


@dataclass
class _Written(WriterCommitMessage):
    name: str
    rows: int


class _RawWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def write(self, iterator) -> WriterCommitMessage:
        fs, folder = folder_of(self.path)
        fs.create_dir(folder, recursive=True)
        name, n, out = f"{uuid.uuid4().hex}.jsonl.gz", 0, None
        for row in iterator:
            if out is None:
                out = gzip.GzipFile(fileobj=fs.open_output_stream(f"{folder}/{name}", compression=None), mode="wb")
            out.write(json.dumps([row["key"], row["payload"]], ensure_ascii=False).encode() + b"\n")
            n += 1
        if out:
            stream = out.fileobj
            out.close()
            stream.close()
        return _Written(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = folder_of(self.path)
        fs.create_dir(f"{folder}/_commits", recursive=True)
        held = json.dumps([[m.name, m.rows] for m in messages if m and m.rows]).encode()
        place = f"{folder}/_commits/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.json"
        with fs.open_output_stream(f"{place}.new") as out:
            out.write(held)
        fs.move(f"{place}.new", place)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = folder_of(self.path)
        for m in messages:
            if m and m.rows:
                fs.delete_file(f"{folder}/{m.name}")


@dataclass
class _File(InputPartition):
    name: str
    batch: int


def commits(path: str) -> list[list[str]]:
    """The files of every committed batch, in the order of commits; none where there is no store yet."""
    fs, folder = folder_of(path)
    found = fs.get_file_info(pafs.FileSelector(f"{folder}/_commits", allow_not_found=True))
    out = []
    for info in sorted((f for f in found if f.path.endswith(".json")), key=lambda f: f.base_name):
        with fs.open_input_stream(info.path) as held:
            out.append([name for name, _ in json.loads(held.read())])
    return out


class _RawReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [_File(name, batch) for batch, names in enumerate(commits(self.path), 1) for name in names] or [_File("", 0)]

    def read(self, partition) -> Iterator[tuple]:
        if not partition.name:
            return
        fs, folder = folder_of(self.path)
        with fs.open_input_stream(f"{folder}/{partition.name}", compression="gzip") as held:
            rest = b""
            while piece := held.read(1 << 20):
                *lines, rest = (rest + piece).split(b"\n")
                for line in lines:
                    key, payload = json.loads(line)
                    yield key, payload, partition.batch


class RawAnswers(DataSource):
    """Data source ``raw_answers`` (option path): key, payload (text), and, when read, batch, which counts commits from 1."""

    @classmethod
    def name(cls) -> str:
        return "raw_answers"

    def schema(self) -> str:
        return "key string, payload string, batch int"

    def reader(self, schema) -> DataSourceReader:
        return _RawReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("raw answers are only added to")
        return _RawWriter(self.options["path"], schema.names)


def keep_raw(answers: DataFrame, path: str) -> None:
    """Add ``answers`` (key, payload) to the store as one batch."""
    answers.sparkSession.dataSource.register(RawAnswers)
    answers.select("key", "payload").write.format("raw_answers").mode("append").save(path)


def held_raw(spark: SparkSession, path: str) -> DataFrame:
    """The last payload of every key of a store, and its batch; of several in one batch the least. Empty if there is none."""
    spark.dataSource.register(RawAnswers)
    return first_per_key(spark.read.format("raw_answers").load(path), ["key"], F.desc("batch"), F.asc("payload"))


def not_held(items: DataFrame, key: str, path: str, good: Column | None = None) -> DataFrame:
    """``items`` whose key the store lacks or, where ``good`` (over ``payload``) is given, holds only a poor answer to."""
    held = held_raw(items.sparkSession, path)
    held = held.where(F.coalesce(good, F.lit(False))) if good is not None else held
    return items.join(held.select(F.col("key").alias(key)), key, "left_anti")


@dataclass
class _Call(InputPartition):
    ref: str
    url: str
    order: int


class TableYears(DataSource):
    """Stream ``table_years``: ref, part, payload, a row a call.

    Options: ``tables``, a JSON list of [ref, url], where ``url`` lists a table's years and ``url``/th/<ids> answers for
    at most two of them; ``per_batch``, tables a micro-batch (default 10); ``canned``, answers by URL to use instead of
    the network.
    """

    @classmethod
    def name(cls) -> str:
        return "table_years"

    def schema(self) -> str:
        return "ref string, part int, payload string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  the API's name
        return _YearStream(dict(self.options))


class _YearStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.tables = json.loads(options["tables"])
        self.step = int(options.get("per_batch", 10))
        self.canned = json.loads(options["canned"]) if "canned" in options else None
        self.at = 0

    def _get(self, url: str) -> dict:
        return self.canned.get(url, {}) if self.canned is not None else get_json(url)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"table": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = min(self.at + self.step, len(self.tables))
        return {"table": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(self.at, end["table"])
        calls = []
        for ref, url in self.tables[start["table"] : end["table"]]:
            data = self._get(url).get("data")
            years = [y["th_id"] for y in data[1] if isinstance(y, dict) and y.get("th_id") is not None] if isinstance(data, list) and len(data) > 1 else []
            calls += [_Call(ref, f"{url}/th/{ids}", k) for k, ids in enumerate(year_calls(years))]
        return calls

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        answer = self._get(partition.url)
        if answer.get("data-availability") == "available":
            yield partition.ref, partition.order, json.dumps(answer, ensure_ascii=False)

    def commit(self, end: dict) -> None:
        """Nothing is kept beyond the checkpoint."""


def fetch_tables(spark: SparkSession, tables: list[tuple[str, str]], out: str, checkpoint: str, per_batch: int = 10, canned: dict | None = None) -> int:
    """Fetch every table's years, two a call, into Parquet at ``out``, going on behind ``checkpoint``; returns the number of batches run."""
    spark.dataSource.register(TableYears)
    stream = spark.readStream.format("table_years").option("tables", json.dumps(tables)).option("per_batch", str(per_batch))
    stream = stream.option("canned", json.dumps(canned)) if canned is not None else stream
    n: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        n.append(batch)
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = stream.load().writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    query.processAllAvailable()
    query.stop()
    return len(n)


def merged_tables(calls: DataFrame) -> DataFrame:
    """One cube a ref out of its calls: ref, cube (JSON). Axes other than the years are those of the first call; cells of later calls stand."""
    own = calls.select("ref", "part", F.from_json("payload", CUBE).alias("c"))
    parts = own.select("ref", "part", F.col("c.tahun").alias("tahun"), F.col("c.datacontent").alias("datacontent"))
    merged = merge_cubes(parts, ["ref"], "tahun", "datacontent", "part")
    first = first_per_key(own, ["ref"], F.asc("part")).select("ref", *[F.col(f"c.{a}").alias(a) for a in ("vervar", "var", "turvar", "turtahun")])
    cube = F.to_json(F.struct("vervar", "var", "turvar", "tahun", "turtahun", "datacontent"))
    return first.join(merged, "ref").select("ref", cube.alias("cube"))
