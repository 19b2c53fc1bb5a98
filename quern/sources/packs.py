"""Vector packs (NumPy archives of vectors, labels and ids) as a Spark data source: partitions are ranges of rows, read where they lie in the
file, and a filter on the label is taken over, so that files and ranges of other labels aren't returned.

    register(spark)
    spark.read.format("quern_pack").option("path", folder).load().where("label = 'ai'")

Paths are what Arrow's file systems open. Stored members (np.savez) are read at their offsets; compressed ones are
passed over up to a range's begin, a bounded buffer at a time.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, IsNotNull

SCHEMA = "label string, doc_id string, vector array<float>, pos long, path string"
#: Rows of a partition and of a batch, and bytes of a compressed member that are passed over at once.
ROWS, BATCH, SKIP = 65_536, 4096, 1 << 22
SUFFIX = "_combined_embeddings.npz"


def _opened(path: str):
    from pyarrow import fs

    store, own = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return store, own


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, own = _opened(path)
    info = store.get_file_info(own)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(own, recursive=True, allow_not_found=False))
    base = path[: len(path) - len(own)] if path.endswith(own) else ""
    return sorted(base + f.path for f in found if f.is_file and f.path.endswith(".npz"))


class Pack:
    """An open archive."""

    def __init__(self, path: str):
        store, own = _opened(path)
        self.file = store.open_input_file(own)
        self.zip = zipfile.ZipFile(self.file)
        self.names = {n.removesuffix(".npy") for n in self.zip.namelist()}

    def close(self) -> None:
        self.zip.close()
        self.file.close()

    def _head(self, stream) -> tuple[tuple, bool, np.dtype]:
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[np.lib.format.read_magic(stream)]
        return read(stream)

    def rows(self, name: str) -> int:
        with self.zip.open(f"{name}.npy") as m:
            return self._head(m)[0][0]

    def part(self, name: str, start: int, stop: int) -> np.ndarray:
        """Rows start to stop of a member."""
        with self.zip.open(f"{name}.npy") as m:
            shape, fortran, dtype = self._head(m)
            if dtype.hasobject or fortran and len(shape) > 1:
                raise ValueError(f"{name}: only plain arrays by rows are read in parts")
            each = dtype.itemsize * int(np.prod(shape[1:], dtype=np.int64))
            if m._compress_type == zipfile.ZIP_STORED:
                m.seek(start * each, 1)
            else:
                left = start * each
                while left:
                    left -= len(m.read(min(left, SKIP)))
            data = m.read((stop - start) * each)
        return np.frombuffer(data, dtype).reshape(stop - start, *shape[1:])


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


class PackReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("rows", ROWS))
        self.members = [options.get(k, d) for k, d in (("vectors", "vectors"), ("labels", "labels"), ("ids", "doc_ids"))]
        self.label: str | None = None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("label",) and self.label is None:
                self.label = f.value
            elif not (isinstance(f, IsNotNull) and f.attribute == ("label",)):  # no label is null
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for path in _files(self.path):
            pack = Pack(path)
            n = pack.rows(self.members[0])
            if self.label is None or self.members[1] in pack.names or self._named(path) == self.label:
                out += [Range(path, at, min(at + self.each, n)) for at in range(0, n, self.each)]
            pack.close()
        return out or [Range("", 0, 0)]

    @staticmethod
    def _named(path: str) -> str:
        return path.rsplit("/", 1)[-1].removesuffix(SUFFIX)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        vectors, labels, ids = self.members
        if not partition.path:
            return
        pack = Pack(partition.path)
        name = partition.path.rsplit("/", 1)[-1]
        ids = ids if ids in pack.names else "filenames"
        for at in range(partition.start, partition.stop, BATCH):
            end = min(at + BATCH, partition.stop)
            label = pack.part(labels, at, end).astype(str) if labels in pack.names else np.full(end - at, self._named(partition.path))
            keep = np.flatnonzero(label == self.label) if self.label is not None else np.arange(end - at)
            if not len(keep):
                continue  # the vectors of other labels aren't read
            x = pack.part(vectors, at, end).astype("float32")[keep]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(label[keep].tolist(), pa.string()), pa.array(pack.part(ids, at, end).astype(str)[keep].tolist(), pa.string()), flat, pa.array(at + keep, pa.int64()), pa.array([name] * len(keep), pa.string())],
                names=["label", "doc_id", "vector", "pos", "path"],
            )
        pack.close()


class PackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern_pack"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackReader:
        return PackReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PackSource)


def read_packs(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """SCHEMA of all archives in a folder, or of one. An archive without labels has those of its file's name, one without ids its filenames."""
    register(spark)
    return spark.read.format("quern_pack").option("path", path).options(**options).load()


def write_packs(df: DataFrame, folder: str, each: int = BATCH) -> int:
    """Archives of up to `each` rows of (label, doc_id, vector) in a folder, written by the tasks that hold the rows; returns the number of rows. A task that runs again
    writes the same names."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, own = _opened(folder)
        store.create_dir(own, recursive=True)
        part, nth = pyspark.TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, len(b), each):
                own_rows = b.iloc[at : at + each]
                with store.open_output_stream(f"{own}/part-{part:05d}-{nth:05d}.npz") as f:
                    np.savez(f, vectors=np.stack(own_rows["vector"].to_numpy()).astype("float32"), labels=own_rows["label"].to_numpy(str), doc_ids=own_rows["doc_id"].to_numpy(str))
                nth += 1
                yield pd.DataFrame({"n": [len(own_rows)]})

    whole = df.selectExpr("cast(label AS string) AS label", "cast(doc_id AS string) AS doc_id", "vector").where("label IS NOT NULL AND doc_id IS NOT NULL AND vector IS NOT NULL")
    return whole.mapInPandas(write, "n long").groupBy().sum("n").first()[0] or 0
