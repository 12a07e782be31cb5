"""Archive catalogs as DataFrames.

Tables of contents are scanned with ``binaryFile`` (they are small) and decoded
one per row; the result is written once as Parquet with nested arrays, from
which each table reads only its own columns. Blobs are never read whole: tasks
seek to the chunks that a file or a range needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import count

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import kernels as k
from tessera.sources import layout, lz4block, storage

_L, _S, _B = T.LongType(), T.StringType(), T.BinaryType()


def _rows(**fields) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))


SCHEMA = T.StructType([
    T.StructField("toc_path", _S), T.StructField("version", _L), T.StructField("image_size", _L), T.StructField("file_size", _L),
    T.StructField("archives", _rows(archive_idx=_L, name=_S, identity=_L, blob_size=T.DecimalType(20, 0))),
    T.StructField("paths", _rows(path_idx=_L, parent=_L, first_child=_L, child_count=_L, first_file=_L, file_count=_L, name=_S)),
    T.StructField("files", _rows(file_idx=_L, path_idx=_L, name=_S, full_name=_S, chunk_rel=_L, chunk_bytes=_L, total_size=_L, meta_rel=_L, meta_size=_L)),
    T.StructField("chunks", _rows(chunk_idx=_L, flags=_L, archive_idx=_L, reserved=_L, blob_off=_L, decomp=_L, comp=_L)),
    T.StructField("types", _rows(type_idx=_L, name=_S)),
    T.StructField("sections", _rows(file_idx=_L, sec_ord=_L, type_idx=_L, body=_B)),
    T.StructField("spans", _rows(section=_S, begin=_L, end=_L)),
    T.StructField("violations", _rows(group=_S, rule=_S, detail=_S)),
])


def decode_row(path: str, data: bytes) -> dict:
    """One table of contents as a row of ``SCHEMA``."""
    toc = layout.Toc(data)
    ints = lambda table, *names: [dict(zip(names, map(int, r), strict=True)) for r in table[list(names)].tolist()] if len(table) else []
    text = lambda r: toc.text(int(r["name_off"]), int(r["name_len"]))
    folders = layout.names_of(toc)
    paths = [{"path_idx": i, "name": text(r)} | {n: int(r[n]) for n in ("first_child", "child_count", "first_file", "file_count")} | {"parent": None if int(r["parent"]) in (layout.NO_PARENT, i) else int(r["parent"])} for i, r in enumerate(toc.paths)]
    files, sections = [], []
    for i, r in enumerate(toc.files):
        name, p = text(r), int(r["path_idx"])
        folder = folders[p] if p < len(folders) else None
        files.append({"file_idx": i, "name": name, "full_name": name if not folder else f"{folder}/{name}"} | {n: int(r[n]) for n in ("path_idx", "chunk_rel", "chunk_bytes", "total_size", "meta_rel", "meta_size")})
        sections += [{"file_idx": i, "sec_ord": o, "type_idx": t, "body": b} for o, t, b in toc.metadata(int(r["meta_rel"]), int(r["meta_size"]))]
    chunks = [{"chunk_idx": i, "blob_off": off} | c for i, (off, c) in enumerate(zip(layout.wide(toc.chunks["blob_off"]).tolist(), ints(toc.chunks, "flags", "archive_idx", "reserved", "decomp", "comp"), strict=True))]
    from decimal import Decimal

    archives = [{"archive_idx": i, "name": text(r), "identity": int(r["identity"]), "blob_size": Decimal(int(r["blob_size"]))} for i, r in enumerate(toc.archives)]
    types = [{"type_idx": i, "name": text(r)} for i, r in enumerate(toc.types)]
    spans = [{"section": s, "begin": b, "end": e} for s, b, e in toc.sections()]
    bad = [{"group": g, "rule": r, "detail": d} for g, r, d in dict.fromkeys(toc.violations)]
    return {"toc_path": path, "version": toc.header["version"], "image_size": len(toc.image), "file_size": len(data), "archives": archives, "paths": paths, "files": files, "chunks": chunks, "types": types, "sections": sections, "spans": spans, "violations": bad}


def listed(spark: SparkSession, root: str | Sequence[str], recursive: bool = True, glob: str = "*.rmdtoc", development: bool = True) -> DataFrame:
    """The files of tables of contents: of several roots (which may be globs) each file once.

    Without ``development`` those with ``-development`` in their path are left
    out where the plain one is there.
    """
    roots = [root] if isinstance(root, str) else list(root)
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(roots)
    if len(roots) > 1:
        found = found.dropDuplicates(["path"])
    return found if development else k.without_variant(found, "path", "-development")


def scan(spark: SparkSession, root: str | Sequence[str], recursive: bool = True, glob: str = "*.rmdtoc", development: bool = True, asserting: bool = False) -> DataFrame:
    """A row per table of contents, in order of path as ``toc_id``; see ``listed``.

    With ``asserting`` one that breaks a rule on its bytes is an error; else its
    violations are in its row.
    """
    found = listed(spark, root, recursive, glob, development)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for path, data in zip(rows["path"], rows["content"], strict=True):
                row = decode_row(path, data)
                if asserting and row["violations"]:
                    raise ValueError(f"{path}: {row['violations'][0]}")
                yield pd.DataFrame([row])

    return found.select("path", "content").mapInPandas(decode, SCHEMA)


@dataclass
class Catalog:
    """The tables of a scanned set of archives; ``toc_id`` is the place in path order."""

    rows: DataFrame

    @classmethod
    def save(cls, scanned: DataFrame, path: str) -> Catalog:
        """Writes the decoded rows and opens them."""
        scanned.write.mode("overwrite").parquet(path)
        return cls.open(scanned.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Catalog:
        rows = spark.read.schema(SCHEMA).parquet(path)
        numbers = k.first_seen_index(rows.select("toc_path"), "toc_path", ["toc_path"], "toc_id")
        return cls(rows.join(numbers, "toc_path"))

    def _table(self, name: str) -> DataFrame:
        return self.rows.select("toc_id", F.explode(name).alias("r")).select("toc_id", "r.*")

    @property
    def toc(self) -> DataFrame:
        return self.rows.select("toc_id", "toc_path", "version", "image_size", "file_size", *(F.size(n).alias(f"n_{n}") for n in ("archives", "paths", "files", "chunks", "types", "sections")))

    @property
    def archive(self) -> DataFrame:
        return self._table("archives")

    @property
    def path(self) -> DataFrame:
        return self._table("paths")

    @property
    def file(self) -> DataFrame:
        return self._table("files")

    @property
    def span(self) -> DataFrame:
        return self._table("spans")

    @property
    def violation(self) -> DataFrame:
        return self._table("violations")

    @property
    def chunk(self) -> DataFrame:
        return self._table("chunks")

    @property
    def section(self) -> DataFrame:
        """Metadata sections with their class; a type without a name is ``?`` and its number."""
        names = self._table("types").withColumnRenamed("name", "class")
        joined = self._table("sections").join(names, ["toc_id", "type_idx"], "left")
        return joined.withColumn("class", F.coalesce("class", F.concat(F.lit("?"), F.col("type_idx").cast("string"))))

    def file_chunk(self) -> DataFrame:
        """Chunks of files in order: a file's range of records becomes an equi-join."""
        wanted = self.file.where("chunk_bytes > 0").select("toc_id", "file_idx", "full_name", "total_size", F.posexplode(F.sequence(F.floor(F.col("chunk_rel") / 16), F.floor((F.col("chunk_rel") + F.col("chunk_bytes")) / 16) - 1)).alias("chunk_ord", "chunk_idx"))
        return wanted.join(self.chunk, ["toc_id", "chunk_idx"])

    def info(self) -> DataFrame:
        """Size and checksum that a file's metadata state."""
        # reverse() would turn characters around, not bytes.
        body, word = F.col("body"), lambda n: F.conv(F.concat(*(F.hex(F.substring("body", 4 * n + j, 1)) for j in (4, 3, 2, 1))), 16, 10).cast("long")
        own = self.section.where((F.col("class") == layout.FILE_INFO) & (F.octet_length(body) == 16))
        return own.where((word(0) == 1) & (word(2) == 0)).select("toc_id", "file_idx", word(1).alias("info_size"), word(3).alias("info_crc32"))

    def meta(self) -> DataFrame:
        """(toc_id, file_idx, meta): each file's metadata record as bytes, put together from its sections."""

        @F.pandas_udf("binary")
        def record(sections: pd.Series) -> pd.Series:
            return sections.map(lambda own: layout.metadata_record([(int(x["type_idx"]), bytes(x["body"])) for x in own]))

        own = F.sort_array(F.collect_list(F.struct("sec_ord", "type_idx", "body")))
        return self._table("sections").groupBy("toc_id", "file_idx").agg(own.alias("s")).select("toc_id", "file_idx", record("s").alias("meta"))

    def resource(self, extensions: list[str] | None = None) -> DataFrame:
        """A file's id and the ids that it depends on; the extension filter comes before decoding."""

        @F.pandas_udf("struct<primary_id:bigint,deps:array<bigint>>")
        def parse(bodies: pd.Series) -> pd.DataFrame:
            found = [layout.resource(b) or (None, []) for b in bodies]
            return pd.DataFrame({"primary_id": pd.array([f[0] for f in found], "Int64"), "deps": [f[1] for f in found]})

        files = self.file.select("toc_id", "file_idx", "full_name")
        if extensions is not None:
            files = files.where(F.lower(F.regexp_extract("full_name", r"(\.[^./]*)$", 1)).isin(*extensions))
        own = self.section.where((F.col("class") == layout.RESOURCE) & (F.octet_length("body") >= 20)).join(files, ["toc_id", "file_idx"])
        return own.select("toc_id", "file_idx", "full_name", parse("body").alias("r")).where("r.primary_id IS NOT NULL").select("toc_id", "file_idx", "full_name", "r.*")

    def blobs(self, spark: SparkSession, root: str) -> DataFrame:
        """Where each archive's blob is: beside its catalog, else the first of that name below ``root``."""
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("blob_path"), F.col("length").alias("length"))
        listed = listed.withColumn("base", F.substring_index("blob_path", "/", -1))
        named = self.archive.withColumn("base", F.substring_index(F.replace("name", F.lit("\\"), F.lit("/")), "/", -1)).join(self.toc.select("toc_id", "toc_path"), "toc_id")
        beside = F.regexp_replace("toc_path", "/[^/]*$", "")
        ranked = named.join(listed, "base").withColumn("rank", F.when(F.regexp_replace("blob_path", "/[^/]*$", "") == beside, 0).otherwise(1))
        return k.first_wins(ranked.select("toc_id", "archive_idx", "identity", "blob_size", "blob_path", "length", "rank"), ["toc_id", "archive_idx"], ["rank", "blob_path"]).drop("rank")


def strict_blobs(catalog: Catalog, spark: SparkSession, root: str) -> DataFrame:
    """``Catalog.blobs`` for every archive, and what is wrong with each: missing, size, header or identity.

    A blob has the size that its record states, and 16 bytes at its start of which
    the last eight are the record's identity.
    """

    @F.pandas_udf("binary")
    def header(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: storage.read_header(p) if p is not None else b"")

    found = catalog.blobs(spark, root).select("toc_id", "archive_idx", "blob_path", "length")
    out = catalog.archive.select("toc_id", "archive_idx", "name", "identity", "blob_size").join(found, ["toc_id", "archive_idx"], "left").withColumn("_h", header("blob_path"))
    own = F.conv(F.concat(*(F.hex(F.substring("_h", 9 + k, 1)) for k in range(7, -1, -1))), 16, -10).cast("long")
    problem = F.when(F.col("blob_path").isNull(), "missing").when(F.col("length") != F.col("blob_size"), "size").when(F.octet_length("_h") < 16, "header").when(own != F.col("identity"), "identity")
    return out.withColumn("problem", problem).drop("_h")


def with_local(contents: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """Contents (full_name, content) with those of an extracted tree in place of the archives' where it has the file.

    Names in the tree lack the leading ``data/`` or ``data_pc/``.
    """
    tree = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = f"{root.rstrip('/').removeprefix('file://')}/"
    own = tree.select(F.substring_index("path", base, -1).alias("_short"), F.col("content").alias("_local"))
    short = F.regexp_replace("full_name", "^data(_pc)?/", "")
    return contents.withColumn("_short", short).join(own, "_short", "left").withColumn("content", F.coalesce("_local", "content")).drop("_short", "_local")


CONTENT = "toc_id long, file_idx long, full_name string, content binary, crc32 long, error string"


#: So many bytes of content make up an output batch, unless one file has more.
BATCH_BYTES = 16 << 20


def read_files(catalog: Catalog, blobs: DataFrame, which: DataFrame, start: Column | None = None, size: Column | None = None) -> DataFrame:
    """The content of the files ``which`` (toc_id, file_idx), or a range of each.

    A file's chunks are sliced from the lists of its own catalog row, and blobs
    come as a small map for each catalog, so only file rows are shuffled. Only
    chunks that the range meets are read and decoded.
    """
    at = lambda f: F.slice("chunks", (F.floor(f["chunk_rel"] / 16) + 1).cast("int"), F.floor(f["chunk_bytes"] / 16).cast("int"))
    nested = F.transform("files", lambda f: F.struct(f["file_idx"].alias("file_idx"), f["full_name"].alias("full_name"), at(f).alias("chunks")))
    files = catalog.rows.select("toc_id", F.explode(nested).alias("f")).select("toc_id", "f.*").join(which.select("toc_id", "file_idx").distinct(), ["toc_id", "file_idx"], "left_semi")
    paths = blobs.groupBy("toc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("archive_idx").cast("string"), "blob_path"))).alias("blobs"))
    files = files.repartition("toc_id", "file_idx").join(paths, "toc_id", "left")
    files = files.withColumn("start", (start if start is not None else F.lit(0)).cast("long")).withColumn("size", (size if size is not None else F.lit(1 << 62)).cast("long"))

    def content(r) -> bytes:
        parts, begin, blobs = [], 0, r.blobs or {}
        for c in r.chunks if r.chunks is not None else ():
            low, high = max(r.start - begin, 0), min(r.start + r.size - begin, c["decomp"])
            begin += c["decomp"]
            if low >= high:
                continue
            if (blob := blobs.get(str(c["archive_idx"]))) is None:
                raise ValueError("the blob is missing")
            raw = storage.read_range(blob, c["blob_off"], c["comp"] or c["decomp"])
            raw = lz4block.decode(raw, c["decomp"]) if c["comp"] else raw
            if len(raw) != c["decomp"]:
                raise ValueError("a chunk is cut short")
            parts.append(raw[low:high])
        return b"".join(parts)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out, held = [], 0
            for r in rows.itertuples():
                try:
                    found, why = content(r), None
                except (ValueError, OSError) as e:
                    found, why = None, str(e)
                out.append((r.toc_id, r.file_idx, r.full_name, found, None if found is None else zlib.crc32(found), why))
                held += len(found or b"")
                if held >= BATCH_BYTES:
                    yield frame(out)
                    out, held = [], 0
            if out:
                yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["toc_id", "file_idx", "full_name", "content", "crc32", "error"]).astype({"crc32": "Int64"})

    return files.mapInPandas(read, CONTENT)


def extract(contents: DataFrame, root: str) -> DataFrame:
    """Writes contents below ``root``: a row per file with what came of it.

    A file is written aside, synced, moved into place, read again and compared,
    so a task that runs twice leaves the same tree. Unsafe names aren't written,
    nor is content that differs from a size or checksum in ``total_size`` or
    ``info_crc32``, where the rows have these columns. With a column ``meta`` its
    bytes, if there are any, go beside the file as ``<file>.meta``.
    """
    known = [c for c in ("total_size", "info_crc32", "meta") if c in contents.columns]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.to_dict("records"):
                name, content, want = r["full_name"], r["content"], {c: r[c] for c in known if not pd.isna(r[c])}
                parts = name.replace("\\", "/").split("/")
                if content is None:
                    state = f"unread: {r.get('error')}"
                elif name.startswith("/") or {"", ".", ".."} & set(parts) or ":" in parts[0]:
                    state = "unsafe name"
                elif len(content) != want.get("total_size", len(content)):
                    state = "size differs"
                elif "info_crc32" in want and zlib.crc32(content) != want["info_crc32"]:
                    state = "checksum differs"
                else:
                    target = f"{root.rstrip('/')}/{'/'.join(parts)}"
                    storage.write_whole(target, content)
                    again = storage.read_range(target, 0, len(content) + 1)
                    state = "written" if again == content else "differs"
                    if want.get("meta"):
                        storage.write_whole(f"{target}.meta", want["meta"])
                out.append((name, 0 if content is None else len(content), state))
            yield pd.DataFrame(out, columns=["full_name", "n_bytes", "state"])

    return contents.select("full_name", "content", *known, *(c for c in ("error",) if c in contents.columns)).mapInPandas(write, "full_name string, n_bytes long, state string")


#: So many files at most are in an archive written here: its table of contents is put together, and decoded again, in one worker's memory.
MOST_FILES = 1 << 13


def write_archives(df: DataFrame, name: str, content: str, folder: str, most_bytes: int = 256 << 20, most_files: int = MOST_FILES) -> DataFrame:
    """Packs rows (name, content) into archives below ``folder``: a new one per partition, ``most_bytes`` of content and ``most_files``.

    Content goes into the blob as it comes; what a task holds is the records of the files.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = ((own, raw) for batch in batches for k in range(batch.num_rows) for own, raw in [(batch.column(0)[k].as_py(), batch.column(1)[k].as_py())])
        ahead = next(rows, None)
        for k in count():
            if ahead is None:
                return
            stem, identity = f"part-{part:05d}-{k:04d}", (part << 16) + k + 1
            held, size, at = [], 0, layout.BLOB_HEADER
            with storage.writing(f"{folder}/{stem}.rmdblob") as blob:
                blob.write(layout.blob_header(identity))
                while ahead is not None and size < most_bytes and len(held) < most_files:
                    record, chunks = layout.store_file(*ahead, at)
                    for chunk in chunks:
                        blob.write(chunk)
                        at += len(chunk)
                    held.append(record)
                    size += record[1]
                    ahead = next(rows, None)
            storage.write_whole(f"{folder}/{stem}.rmdtoc", layout.pack_toc(held, f"{stem}.rmdblob", at, identity))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64())], ["part", "n_files", "n_bytes"])

    return df.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInArrow(pack, "part int, n_files long, n_bytes long")
