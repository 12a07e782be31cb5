"""Structural rules of archives as one table of violations.

Rules on raw bytes are checked where the bytes are (``layout.Toc``) and arrive
in the catalog; rules between records are joins, windows and aggregates here.
Every violation is reported; nothing stops at the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import kernels as k
from tessera.sources.catalog import Catalog
from tessera.sources.layout import HEADER_SIZE, Toc, wide

#: The groups a report lists, also where nothing was found.
GROUPS = (
    "header", "segments", "sections", "archives", "folders", "files", "chunk ranges",
    "folder ranges", "folders and files", "metadata classes", "metadata", "chunks", "texts",
)


def violations(c: Catalog) -> DataFrame:
    """(toc_id, group, rule, detail) of all rules."""
    found = [c.violation]

    def rule(df: DataFrame, bad: Column, group: str, name: str, detail: str) -> None:
        found.append(df.where(F.coalesce(bad, F.lit(True))).select("toc_id", F.lit(group).alias("group"), F.lit(name).alias("rule"), F.col(detail).cast("string").alias("detail")))

    sizes = c.rows.select("toc_id", F.size("paths").alias("n_paths"), F.size("files").alias("n_files"), F.size("archives").alias("n_archives"), F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: F.when(s["section"] == "chunks", s["end"] - s["begin"]).otherwise(a)).alias("chunk_bytes_all"), F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: F.when(s["section"] == "metadata", s["end"] - s["begin"]).otherwise(a)).alias("meta_all"))
    rule(c.archive, F.col("blob_size") < 16, "archives", "blob holds its header", "archive_idx")
    paths = c.path.join(sizes, "toc_id")
    group = "folders"
    rule(paths, F.col("parent").isNotNull() & (F.col("parent") >= F.col("n_paths")), group, "parent exists", "path_idx")
    rule(paths, F.col("first_child") + F.col("child_count") > F.col("n_paths"), group, "child range exists", "path_idx")
    rule(paths, F.col("first_file") + F.col("file_count") > F.col("n_files"), group, "file range exists", "path_idx")
    roots = c.rows.select("toc_id", F.size(F.filter("paths", lambda p: p["parent"].isNull())).alias("n_roots"), F.size("paths").alias("n"))
    rule(roots.where("n > 0"), F.col("n_roots") != 1, group, "one root", "n_roots")
    children = c.path.where("child_count > 0").select("toc_id", F.col("path_idx").alias("up"), F.explode(F.sequence(F.col("first_child"), F.col("first_child") + F.col("child_count") - 1)).alias("path_idx"))
    linked = c.path.where("parent IS NOT NULL").select("toc_id", "path_idx", "parent").join(children, ["toc_id", "path_idx"], "full")
    rule(linked, ~F.col("parent").eqNullSafe(F.col("up")), group, "ranges and parents agree", "path_idx")
    rule(children.groupBy("toc_id", "path_idx").agg(F.count("*").alias("n")), F.col("n") != 1, group, "in one child range", "path_idx")
    files = c.file.join(sizes, "toc_id")
    group = "files"
    rule(files, F.col("path_idx") >= F.col("n_paths"), group, "path exists", "file_idx")
    rule(files, (F.col("chunk_rel") % 16 != 0) | (F.col("chunk_bytes") % 16 != 0), group, "whole chunk records", "file_idx")
    rule(files, F.col("chunk_rel") + F.col("chunk_bytes") > F.col("chunk_bytes_all"), group, "chunk range exists", "file_idx")
    rule(files, F.col("meta_rel") + F.col("meta_size") > F.col("meta_all"), group, "metadata range exists", "file_idx")
    spans = files.where("chunk_bytes > 0").select("toc_id", F.col("chunk_rel").alias("b"), (F.col("chunk_rel") + F.col("chunk_bytes")).alias("e"), "chunk_bytes_all")
    for df, high, name in ((spans, "chunk_bytes_all", "chunk ranges"), (paths.where("file_count > 0").select("toc_id", F.col("first_file").alias("b"), (F.col("first_file") + F.col("file_count")).alias("e"), "n_files"), "n_files", "folder ranges")):
        rule(k.partition_violations(df, ["toc_id"], "b", "e", F.lit(0), F.col(high)), F.lit(True), name, "ranges cover all exactly once", "b")
    held = c.path.where("file_count > 0").select("toc_id", F.col("path_idx").alias("owner"), F.explode(F.sequence(F.col("first_file"), F.col("first_file") + F.col("file_count") - 1)).alias("file_idx"))
    rule(c.file.select("toc_id", "file_idx", "path_idx").join(held, ["toc_id", "file_idx"], "left"), ~F.col("path_idx").eqNullSafe(F.col("owner")), "folders and files", "file names the path that holds it", "file_idx")
    rule(c._table("types"), F.coalesce(F.length("name"), F.lit(0)) == 0, "metadata classes", "type has a name", "type_idx")
    group = "chunks"
    chunks = c.chunk.join(sizes, "toc_id")
    rule(chunks, F.col("reserved") != 0, group, "reserved byte is zero", "chunk_idx")
    rule(chunks, F.col("archive_idx") >= F.col("n_archives"), group, "archive exists", "chunk_idx")
    rule(chunks, ~(((F.col("flags") == 0x10) & (F.col("comp") > 0)) | ((F.col("flags") == 0) & (F.col("comp") == 0))), group, "flags fit the sizes", "chunk_idx")
    sums = c.file_chunk().groupBy("toc_id", "file_idx").agg(F.sum("decomp").alias("got"))
    rule(c.file.join(sums, ["toc_id", "file_idx"], "left"), F.coalesce("got", F.lit(0)) != F.col("total_size"), group, "chunks add up to the size", "file_idx")
    counted = c.rows.select("toc_id", F.size("chunks").alias("n"), F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + F.floor(f["chunk_bytes"] / 16)).alias("used"))
    rule(counted, F.col("n") != F.col("used"), group, "every chunk belongs to a file", "used")
    return reduce(DataFrame.unionByName, found)


def report(c: Catalog) -> DataFrame:
    """By group over all catalogs: violations, catalogs that fail and that pass; groups without any, too."""
    groups = c.rows.sparkSession.createDataFrame([(k, g) for k, g in enumerate(GROUPS)], "ord int, group string")
    counts = violations(c).groupBy("group").agg(F.count("*").alias("n_violations"), F.count_distinct("toc_id").alias("n_tocs"))
    every = c.rows.agg(F.count("*").alias("every"))
    out = groups.join(counts, "group", "left").join(F.broadcast(every))
    failed = F.coalesce("n_tocs", F.lit(0))
    return out.select("ord", "group", F.coalesce("n_violations", F.lit(0)).alias("n_violations"), failed.alias("n_tocs"), (F.col("every") - failed).alias("n_passed")).orderBy("ord")


def report_text(c: Catalog) -> list[str]:
    """The report as lines; it has as many as there are groups."""
    return [f"{r['group']:<20} {r['n_passed']:>8} passed {r['n_tocs']:>8} failed {r['n_violations']:>10} violations" for r in report(c).collect()]


def root_mismatches(c: Catalog) -> DataFrame:
    """(toc_id, file_idx, n): files with metadata that don't state size and checksum exactly once."""
    stated = c.info().join(c.file.select("toc_id", "file_idx", "total_size"), ["toc_id", "file_idx"]).where("info_size = total_size").groupBy("toc_id", "file_idx").agg(F.count("*").alias("n"))
    files = c.file.where("meta_size > 0").select("toc_id", "file_idx").join(stated, ["toc_id", "file_idx"], "left")
    return files.select("toc_id", "file_idx", F.coalesce("n", F.lit(0)).alias("n")).where("n != 1")


def type_names(c: Catalog) -> DataFrame:
    """The distinct names of metadata classes over all catalogs."""
    return c._table("types").select("name").distinct().orderBy("name")


def file_json(c: Catalog) -> DataFrame:
    """(toc_id, full_name, json): each file without its chunks and dependencies."""
    own = c.resource().select("toc_id", "file_idx", "primary_id")
    classes = c.section.groupBy("toc_id", "file_idx").agg(F.sort_array(F.collect_list(F.struct("sec_ord", "class"))).alias("s"))
    rows = c.file.join(own, ["toc_id", "file_idx"], "left").join(c.info(), ["toc_id", "file_idx"], "left").join(classes, ["toc_id", "file_idx"], "left")
    out = F.struct(F.col("full_name").alias("fullname"), "total_size", "primary_id", F.col("info_crc32").alias("crc32"), F.floor(F.col("chunk_bytes") / 16).alias("nchunks"), F.transform("s", lambda x: x["class"]).alias("sections"))
    return rows.select("toc_id", "full_name", F.to_json(out, {"ignoreNullFields": "false"}).alias("json"))


def toc_accounting(listed: DataFrame) -> DataFrame:
    """(path, total, structural, zero_gap, nonzero_gap): what each byte of the files of ``catalog.listed`` is.

    Structural are header, descriptors and segments; what lies between is counted by
    whether it is zero. The three add up to the file's size.
    """

    def account(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, data in zip(rows["path"], rows["content"], strict=True):
                used = np.zeros(len(data), bool)
                toc = Toc(data)
                start, n = toc.header["table_off"], len(toc.descriptors)
                used[:HEADER_SIZE] = True
                used[start : start + 16 * n] = True
                for d, at in zip(toc.descriptors, wide(toc.descriptors["offset"]).tolist() if n else [], strict=True):
                    used[at : at + (int(d["comp"]) or int(d["decomp"]))] = True
                gaps = np.frombuffer(data, np.uint8)[~used]
                zero = int((gaps == 0).sum())
                out.append((path, len(data), int(used.sum()), zero, len(gaps) - zero))
            yield pd.DataFrame(out, columns=["path", "total", "structural", "zero_gap", "nonzero_gap"])

    return listed.select("path", "content").mapInPandas(account, "path string, total long, structural long, zero_gap long, nonzero_gap long")


def summary(c: Catalog) -> DataFrame:
    """Counts and sizes over all catalogs in one row."""
    chunks = c.chunk.agg(F.count("*").alias("n_chunks"), F.count_if(F.col("comp") > 0).alias("n_compressed"), F.count_if(F.col("comp") == 0).alias("n_stored"), F.sum("decomp").alias("plain_bytes"), F.sum(F.when(F.col("comp") > 0, F.col("comp")).otherwise(F.col("decomp"))).alias("stored_bytes"))
    files = c.file.agg(F.count("*").alias("n_files"), F.sum("total_size").alias("file_bytes"))
    return files.join(F.broadcast(chunks))


def extensions(c: Catalog) -> DataFrame:
    """Files by extension, the most frequent first."""
    from tessera.functions.text import extension

    return k.histogram(c.file, extension(F.col("name")), "extension")


def logical_accounting(c: Catalog) -> DataFrame:
    """Bytes of each image by section, and what lies between sections."""
    spans = c.span.where(F.col("end") > F.col("begin"))
    inside = spans.select("toc_id", "section", (F.col("end") - F.col("begin")).alias("n_bytes"))
    between = k.gaps(spans, ["toc_id"], "begin", "end").select("toc_id", F.lit("padding").alias("section"), (F.col("gap_end") - F.col("gap_begin")).alias("n_bytes"))
    return inside.union(between).groupBy("toc_id", "section").agg(F.sum("n_bytes").alias("n_bytes"))


def physical_accounting(c: Catalog, blobs: DataFrame) -> DataFrame:
    """Bytes of each blob: header, chunks (shared ones once) and gaps."""
    at = F.col("blob_off")
    spans = c.chunk.select("toc_id", "archive_idx", at.alias("b"), (at + F.when(F.col("comp") > 0, F.col("comp")).otherwise(F.col("decomp"))).alias("e"))
    spans = spans.union(c.archive.select("toc_id", "archive_idx", F.lit(0), F.lit(16)))
    used = k.merge_intervals(spans, ["toc_id", "archive_idx"], "b", "e").groupBy("toc_id", "archive_idx").agg(F.sum(F.col("e") - F.col("b")).alias("used"))
    return c.archive.join(used, ["toc_id", "archive_idx"], "left").join(blobs.select("toc_id", "archive_idx", "length"), ["toc_id", "archive_idx"], "left").select("toc_id", "archive_idx", F.col("blob_size").cast("long").alias("blob_size"), "length", F.coalesce("used", F.lit(0)).alias("used"), (F.col("length") - F.coalesce("used", F.lit(0))).alias("gaps"))
