"""Output trees: paths without collisions, one file per row, manifests."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens.functions import urls
from bundlelens.operators.graphs import cut
from bundlelens.operators.votes import first_free

TOOL = "bundlelens"


def placed(files: DataFrame) -> DataFrame:
    """Files (path, content, ord) with safe paths, each once and none lost: equal content at an equal path is one file, a
    file whose path others need as directory goes to `~dir`, further ones of a path get `~2`, `~3`.. as far as these are
    free. Contents stay where they are: only paths and digests are settled."""
    rows = files.withColumn("path", urls.safe_path(F.col("path"))).withColumn("_h", F.sha2(F.col("content").cast("binary"), 256))
    rows = rows.groupBy("path", "_h").agg(F.min("ord").alias("ord"), F.any_value("content").alias("content"))
    at = cut(rows.select(F.col("path").alias("_path"), "_h", F.col("ord").alias("_ord"), "path"))
    while True:
        numbered = at.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy("_ord", "_path", "_h")))
        first, further = numbered.where("_n = 1"), numbered.where("_n > 1")
        dot = F.regexp_extract("path", r"^(.*[^/])(\.[^./]*)$", 2)
        stem = F.expr("left(path, length(path) - length(_dot))")
        again = lambda k: F.concat(stem, F.lit("~"), (F.col("_n") + (k - 1)).cast("string"), F.col("_dot"))  # noqa: B023, E731
        moved = first_free(further.withColumn("_dot", dot), at.select(F.col("path").alias("_taken")).distinct(), again, "_ord").drop("path", "_dot").withColumnRenamed("unique_name", "path")
        at = first.unionByName(moved).drop("_n")
        parts = F.split("path", "/", -1)
        folders = at.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("_dir")).distinct()
        marked = cut(at.join(folders, F.col("path") == F.col("_dir"), "left"))
        at = marked.withColumn("path", F.when(F.col("_dir").isNull(), F.col("path")).otherwise(F.concat("path", F.lit("~dir")))).drop("_dir")
        if marked.where("_dir IS NOT NULL").isEmpty():
            break
    joined = rows.join(at.select(F.col("_path").alias("_of"), F.col("_h").alias("_as"), F.col("path").alias("_to")), (F.col("path") == F.col("_of")) & F.col("_h").eqNullSafe(F.col("_as")))
    return joined.select(F.col("_to").alias("path"), "content", "ord")


def resolve_inside(root: str, relative: str) -> str:
    """The absolute path of a file of the tree; ValueError for one outside it."""
    base = os.path.abspath(root)
    target = os.path.abspath(os.path.join(base, relative))
    if target != base and not target.startswith(base.rstrip(os.sep) + os.sep):
        raise ValueError(f"outside the output: {relative}")
    return target


def write_tree(files: DataFrame, root: str) -> None:
    """Write every row (path, content) as a file below `root`, from the executors. A folder that isn't empty is taken
    over only if it has our manifest. Each task writes its own files; a task that runs again writes the same ones."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    at = f"{base}/manifest.json"
    held = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
    if held:
        info = system.get_file_info(at)
        ours = info.is_file and json.loads(system.open_input_file(at).read() or b"{}").get("tool") == TOOL
        if not ours:
            raise FileExistsError(f"{root} isn't empty and has no manifest of ours")

    def save(rows) -> None:
        where, top = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for row in rows:
            target = resolve_inside("/", row.path).lstrip("/")
            where.create_dir(os.path.dirname(f"{top}/{target}"), recursive=True)
            with where.open_output_stream(f"{top}/{target}", compression=None) as out:
                out.write((row.content or "").encode())

    files.select("path", "content").foreachPartition(save)
    with system.open_output_stream(at) as out:
        out.write(json.dumps({"tool": TOOL}).encode())


def manifest(summary: dict[str, DataFrame]) -> DataFrame:
    """One row with the JSON document of tables of one row each (counters, not listings)."""
    parts = None
    for name, df in summary.items():
        one = df.select(F.struct(*df.columns).alias(name))
        parts = one if parts is None else parts.join(F.broadcast(one))
    if parts is None:
        raise ValueError("a manifest has at least one table")
    return parts.select(F.to_json(F.struct(F.lit(TOOL).alias("tool"), *parts.columns)).alias("manifest"))


def package_json(imports: DataFrame, versions: DataFrame) -> DataFrame:
    """(file): a package.json with the packages that specifiers name, and their versions (package, version) where known."""
    used = imports.select(urls.package_of(F.col("specifier")).alias("package")).where("package IS NOT NULL").distinct()
    known = used.join(versions.groupBy("package").agg(F.min("version").alias("version")), "package", "left").select("package", F.coalesce("version", F.lit("*")).alias("version"))
    packed = known.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("package", "version")))).alias("dependencies"))
    return packed.select(F.to_json(F.struct(F.lit("recovered").alias("name"), F.lit(True).alias("private"), F.lit("module").alias("type"), "dependencies")).alias("file"))


def missing_stubs(missing: DataFrame) -> DataFrame:
    """(path, content): a stub for each missing module (dst, importers)."""
    return missing.select(F.concat(F.lit("js/_missing/module-"), urls.safe_segment(F.regexp_extract("dst", "([^\x00]*)$", 1)), F.lit(".js")).alias("path"), F.concat(F.lit("// not captured; "), F.col("importers").cast("string"), F.lit(" importers\nexport default undefined;\n")).alias("content"))
