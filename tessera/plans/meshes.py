"""Meshes of an archive as GLB files: their metadata, skeletons, levels and variants."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources import mesh, storage

# How files of a mesh end.
MESH, META, SKELETON = ".binfbx", ".meta", ".binskeleton"
GLB = "full_name string, variant string, lod int, glb binary, error string"


def with_companions(files: DataFrame) -> DataFrame:
    """Each mesh with its metadata and skeleton: (full_name, content, meta, skeleton, n_skeletons).

    ``files`` has full_name and content. Metadata are ``<mesh>.meta``, else the
    mesh's name with that ending in place of its own. The skeleton is the only one
    in the mesh's folder or below; of several none is taken.
    """
    own = files.where(F.endswith("full_name", F.lit(MESH)))
    stem = F.left("full_name", F.length("full_name") - len(MESH))
    folder = F.regexp_extract("full_name", "^(.*/)?[^/]*$", 1)
    meta = files.where(F.endswith("full_name", F.lit(META))).select(F.left("full_name", F.length("full_name") - len(META)).alias("_of"), F.col("content").alias("_meta"))
    out = own.withColumn("_stem", stem).withColumn("_folder", folder)
    first = meta.select(F.col("_of").alias("full_name"), F.col("_meta").alias("_m1"))
    second = meta.select(F.col("_of").alias("_stem"), F.col("_meta").alias("_m2"))
    out = out.join(first, "full_name", "left").join(second, "_stem", "left")
    # A skeleton serves its own folder and all above: its folder's parts make as many rows.
    bones = files.where(F.endswith("full_name", F.lit(SKELETON))).select(folder.alias("_at"), "content")
    parts = F.filter(F.split("_at", "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.lit("/"))))
    bones = bones.select(F.explode(above).alias("_folder"), "content").groupBy("_folder").agg(F.count("*").alias("n_skeletons"), F.min("content").alias("_bones"))
    out = out.join(bones, "_folder", "left")
    return out.select("full_name", "content", F.coalesce("_m1", "_m2").alias("meta"), F.when(F.col("n_skeletons") == 1, F.col("_bones")).alias("skeleton"), F.coalesce("n_skeletons", F.lit(0)).alias("n_skeletons"))


def convert(meshes: DataFrame, lods: list[int] | None = None, variants: list[str] | None = None) -> DataFrame:
    """A GLB for each mesh, variant and level (all of them by default), or the reason why there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                for out in one(r):
                    yield pd.DataFrame([out], columns=["full_name", "variant", "lod", "glb", "error"]).astype({"lod": "Int32"})

    def one(r) -> Iterator[tuple]:
        if r.meta is None:
            yield r.full_name, None, None, None, "no metadata"
            return
        try:
            meta = mesh.metadata(r.meta, len(r.content))
            body = mesh.body(r.content, meta)
            bones = mesh.skeleton(r.skeleton) if r.skeleton is not None and (meta["has_bones"] or meta["skeleton_id"]) else None
        except (ValueError, IndexError, KeyError) as why:
            yield r.full_name, None, None, None, str(why)
            return
        for variant in variants or list(body["variants"]):
            for lod in lods if lods is not None else sorted({p["lod"] for p in body["primitives"]}):
                try:
                    yield r.full_name, variant, lod, mesh.convert(r.content, r.meta, lod, variant, bones), None
                except (ValueError, IndexError, KeyError) as why:
                    yield r.full_name, variant, lod, None, str(why)

    return meshes.select("full_name", "content", "meta", "skeleton").mapInPandas(run, GLB)


def write_glbs(converted: DataFrame, root: str) -> DataFrame:
    """Writes each GLB as ``<mesh>_<variant>_lod<n>.glb`` below ``root``: (path, n_bytes)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                path = f"{r.full_name.removesuffix(MESH)}_{r.variant}_lod{r.lod}.glb"
                storage.write_whole(f"{root.rstrip('/')}/{path}", r.glb)
                out.append((path, len(r.glb)))
            yield pd.DataFrame(out, columns=["path", "n_bytes"])

    return converted.where("glb IS NOT NULL").mapInPandas(write, "path string, n_bytes long")
