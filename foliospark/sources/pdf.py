"""Reading and writing files: Spark's binaryFile scan, a DataSource named pdf, and a sink."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliospark.kernels.document import Document


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """doc_id (the path), length, content. A query that doesn't use content doesn't read it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), "length", "content")


class PdfSource(DataSource):
    """spark.read.format('pdf').load(folder): a row per page. Files are listed through pyarrow's file systems."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return "doc_id string, page_no int, rotation int, width double, height double, n_bytes bigint"

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options["path"])


#: Bytes of files to a partition; a larger file is one of its own.
PARTITION_BYTES = 128 << 20


class PdfPartition(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PdfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[PdfPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        packs: list[list[str]] = [[]]
        size = 0
        for f in sorted((f for f in found if f.is_file and f.path.lower().endswith(".pdf")), key=lambda f: f.path):
            if packs[-1] and size + f.size > PARTITION_BYTES:
                packs.append([])
                size = 0
            packs[-1].append(f.path)
            size += f.size
        return [PdfPartition(p) for p in packs]

    def read(self, partition: PdfPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with store.open_input_file(path) as f:
                data = f.read()
            try:
                pages = list(enumerate(Document(data).pages(), 1))
            except (ValueError, TypeError, KeyError, IndexError):
                continue  # no pages can be read; read_files() and pdf_docs() tell of such files
            for k, p in pages:
                box = p.box("MediaBox") or (0.0, 0.0, 612.0, 792.0)
                yield path, k, p.rotation, float(box[2]), float(box[3]), len(data)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfSource)


def write_files(df: DataFrame, folder: str) -> None:
    """A file per row (doc_id, content) in a folder that all executors see, named by the id (percent-encoded, so that no id names a sub-folder or a hidden file).

    A file is written under another name and moved, so that a reader sees it whole; a rerun task writes the same files again.
    """

    def run(rows) -> None:
        from urllib.parse import quote
        from uuid import uuid4

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for r in rows:
            part = f"{root}/_{uuid4().hex}.part"
            with store.open_output_stream(part, compression=None) as out:
                out.write(bytes(r.content))
            name = quote(str(r.doc_id), safe="")
            name = name.replace(name[0], f"%{ord(name[0]):02X}", 1) if name[:1] in (".", "_") else name  # readers skip such files
            store.move(part, f"{root}/{name}.pdf")

    df.select("doc_id", "content").foreachPartition(run)
