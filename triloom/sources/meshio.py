"""Mesh files as DataFrames: bytes columns, folders of files, and a Spark data source ``meshfile``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..kernels.batch import Failure, per_row
from ..types import MESH
from . import formats

NOT_FOUND, EXISTS = "MeshIO.FileNotFound", "MeshIO.FileExists"


def read_bytes(df: DataFrame, content: str = "content", kind: str = "format") -> DataFrame:
    """Meshes of a binary column; trouble is the row's error_code."""
    return per_row(df, [content, kind], lambda r: formats.read(r[content], r[kind]) | {"created_by": f"triloom.read.{r[kind]}"}, MESH)


def write_bytes(meshes: DataFrame, kind: str) -> DataFrame:
    """A binary column ``content`` of each mesh's file."""

    def run(r):
        return {"content": formats.write(r["vertices"], r["triangles"], kind, r.get("name") or "")}

    return per_row(meshes, ["vertices", "triangles", "name"], run, "content binary, error_code string")


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """One mesh a file, through Spark's binary reader; the extension chooses the parser and the file's stem is the name.

    A path that does not exist is one row with the error code ``MeshIO.FileNotFound``.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        missing = spark.createDataFrame([(path, None, "")], "path string, content binary, format string")
        return read_bytes(missing.withColumn("error_code", F.lit(NOT_FOUND))).withColumn("name", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("format"))
    return read_bytes(files).withColumn("name", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))


def export_files(meshes: DataFrame, path: str, kind: str, overwrite: bool = False) -> DataFrame:
    """Write each mesh to ``path``/name.kind and return path and error_code of each row; a file that exists is refused as a value.

    A file is written under a temporary name and then renamed, so a failed task leaves no torn file and a task that is run
    again replaces its own work. Rows that carry an error or have no faces write nothing. Names must be distinct.
    """
    content = write_bytes(meshes, kind)

    def run(r):
        if r.get("error_code"):
            return {"path": None, "error_code": r["error_code"]}
        return {"path": f"{path.rstrip('/')}/{r['name']}.{kind}", "error_code": put(path, f"{r['name']}.{kind}", r["content"], overwrite)}

    keep = [c for c in meshes.columns if c not in ("vertices", "triangles", "error_code")]
    rows = content.select(*keep, "content", "error_code")
    written = per_row(rows.withColumnRenamed("error_code", "failed"), ["content", "name", "failed"], lambda r: run({**r, "error_code": r["failed"]}), "path string, error_code string")
    return written.drop("content", "failed")


def opened(path: str):
    """The file system of a path, by pyarrow, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def put(folder: str, name: str, data: bytes, overwrite: bool) -> str | None:
    """Write one file whole or not at all; the error code if it exists already."""
    import uuid

    from pyarrow import fs

    system, root = opened(folder)
    system.create_dir(root, recursive=True)
    target = f"{root}/{name}"
    if not overwrite and system.get_file_info(target).type != fs.FileType.NotFound:
        return EXISTS
    part = f"{root}/.{name}.{uuid.uuid4().hex[:8]}.tmp"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, target)
    return None


def write_packages(df: DataFrame) -> DataFrame:
    """3MF packages of ``vertices``, ``triangles``, and optional ``reference_vertices``, ``reference_triangles`` and ``metadata``."""

    def run(r):
        reference = (r["reference_vertices"], r["reference_triangles"]) if r.get("reference_triangles") is not None and len(r["reference_triangles"]) else None
        if not len(r["triangles"]):
            raise Failure("Mesh.EmptyOperand")
        return {"content": formats.write_package(r["vertices"], r["triangles"], r.get("name") or "", reference, dict(r.get("metadata") or {}))}

    return per_row(df, [], run, "content binary, error_code string", whole_row=True)


def read_packages(df: DataFrame, role: str | None = None) -> DataFrame:
    from ..types import FACE, VEC3

    def run(r):
        try:
            found = formats.read_package(r["content"], role)
        except Exception:
            raise Failure(formats.UNREADABLE) from None
        v, t = found["reference"] or (None, None)
        return {"vertices": found["vertices"], "triangles": found["triangles"], "name": found["name"], "metadata": found["metadata"], "reference_vertices": v, "reference_triangles": t}

    return per_row(df, ["content"], run, f"vertices array<{VEC3}>, triangles array<{FACE}>, name string, metadata map<string,string>, reference_vertices array<{VEC3}>, reference_triangles array<{FACE}>, error_code string")


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        from pyarrow import fs

        system, root = opened(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            return [InputPartition(None)]
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root))
        return [InputPartition(f.path) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and f.extension.lower() in formats.FORMATS]

    def read(self, partition):
        if partition.value is None:
            yield (self.path.rstrip("/").rsplit("/", 1)[-1], [], [], NOT_FOUND)
            return
        with opened(self.path)[0].open_input_file(partition.value) as f:
            data = f.read()
        name, _, kind = partition.value.rsplit("/", 1)[-1].rpartition(".")
        try:
            found, code = formats.read(data, kind), None
        except Failure as failure:
            found, code = {"vertices": [], "triangles": []}, failure.code
        yield (name, [tuple(map(float, p)) for p in found["vertices"]], [tuple(map(int, f)) for f in found["triangles"]], code)


@dataclass
class _Written(WriterCommitMessage):
    """Files of a task, still in its own staging folder."""

    stage: str
    names: list[str]


class _Writer(DataSourceWriter):
    """Tasks write into staging folders of their own; the commit moves all files of tasks that count into place, an abort deletes them."""

    def __init__(self, options, overwrite):
        import uuid

        self.path, self.kind, self.overwrite, self.run = options["path"], options.get("format", "stl"), overwrite, uuid.uuid4().hex[:12]

    def write(self, rows):
        import uuid

        import numpy as np

        stage = f".stage-{self.run}/{uuid.uuid4().hex[:12]}"
        names = []
        for row in rows:
            names.append(f"{row['name']}.{self.kind}")
            data = formats.write(np.array([tuple(p) for p in row["vertices"]], float), np.array([tuple(t) for t in row["triangles"]], int), self.kind, row["name"])
            put(f"{self.path.rstrip('/')}/{stage}", names[-1], data, True)
        return _Written(stage, names)

    def _clear(self):
        from pyarrow import fs

        system, root = opened(self.path)
        if system.get_file_info(f"{root}/.stage-{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/.stage-{self.run}")

    def commit(self, messages):
        from pyarrow import fs

        system, root = opened(self.path)
        messages = [m for m in messages if m is not None]
        names = [n for m in messages for n in m.names]
        there = {f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File}
        clash = sorted((there if not self.overwrite else set()) & set(names)) or sorted({n for n in names if names.count(n) > 1} if len(set(names)) < len(names) else ())
        if clash:
            self._clear()
            raise FileExistsError(f"{EXISTS}: {root}/{clash[0]}")
        if self.overwrite:
            for name in there:
                if name.rpartition(".")[2].lower() in formats.FORMATS:
                    system.delete_file(f"{root}/{name}")
        for m in messages:
            for name in m.names:
                system.move(f"{root}/{m.stage}/{name}", f"{root}/{name}")
        self._clear()

    def abort(self, messages):
        self._clear()


class MeshFileSource(DataSource):
    """``spark.read.format("meshfile").load(folder)`` and ``df.write.format("meshfile").option("format", "ply").save(folder)``.

    Writing needs name, vertices and triangles, one file a mesh. Files appear when the whole write succeeds; mode overwrite replaces
    all mesh files of the folder, append refuses existing ones. Reading a path that does not exist gives one row with an error code.
    """

    @classmethod
    def name(cls):
        return "meshfile"

    def schema(self):
        from ..types import FACE, VEC3

        return f"name string, vertices array<{VEC3}>, triangles array<{FACE}>, error_code string"

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MeshFileSource)
