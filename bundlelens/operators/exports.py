"""Imports and exports across modules as edge tables: forwarding, shims, unused names, names by consensus.

An import edge is (importer, source, imported, local); an export is (module, exported, local, source), source being the
module it is passed on from, or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bundlelens import rules
from bundlelens.operators import graphs, votes


def resolve_specifiers(specifiers: DataFrame, files: DataFrame, suffixes: tuple[str, ...] = ("", ".js", ".ts", ".jsx", ".tsx", ".vue", ".mjs", "/index.js", "/index.ts")) -> DataFrame:
    """Adds target, the file (path) that a relative specifier of a file (importer, specifier) means: the first suffix
    under which one exists. Specifiers are joined by equality on each suffixed path, never against all files."""
    folder = F.regexp_replace("importer", r"[^/]*$", "")
    joined = F.when(F.col("specifier").startswith("/"), F.col("specifier")).otherwise(F.concat(folder, F.col("specifier")))
    folded = normal_path(joined)
    tried = specifiers.withColumn("_p", folded).select("*", F.posexplode(F.transform(F.array(*map(F.lit, suffixes)), lambda s: F.concat("_p", s))).alias("_i", "_t"))
    met = tried.join(files.select(F.col("path").alias("_t")).distinct(), "_t").groupBy("importer", "specifier").agg(F.min_by("_t", "_i").alias("target"))
    return specifiers.join(met, ["importer", "specifier"], "left")


def normal_path(path: Column) -> Column:
    """A path without `.` and `..`; those that lead above the root are dropped."""
    kept = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda a, s: F.when(s.isin("", "."), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)),
    )
    return F.array_join(kept, "/")


def forward(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Imports of names that their source only passes on, pointed at where those come from: one hop."""
    passed = exports.where("source IS NOT NULL").select(F.col("module").alias("_m"), F.col("exported").alias("_e"), F.col("local").alias("_l"), F.col("source").alias("_s"))
    joined = imports.join(passed, (F.col("source") == F.col("_m")) & (F.col("imported") == F.col("_e")), "left")
    return joined.withColumns({"source": F.coalesce("_s", "source"), "imported": F.coalesce("_l", "imported")}).drop("_m", "_e", "_l", "_s")


def shims(exports: DataFrame, own: DataFrame) -> DataFrame:
    """(module) of modules that export nothing of their own: all exports come from elsewhere. own: (module) of those
    with other statements."""
    counts = exports.groupBy("module").agg(F.count("*").alias("n"), F.count("source").alias("passed")).where("n = passed")
    return counts.select("module").join(own.select("module"), "module", "left_anti")


def collapse(imports: DataFrame, exports: DataFrame, own: DataFrame, hops: int = 10) -> DataFrame:
    """Imports through chains of shims pointed at the modules that really have the names."""
    hollow = shims(exports, own)
    chain = exports.join(hollow, "module", "left_semi").select(F.to_json(F.struct(F.col("module").alias("m"), F.col("exported").alias("n"))).alias("src"), F.to_json(F.struct(F.col("source").alias("m"), F.col("local").alias("n"))).alias("dst"))
    ends = graphs.aliases(chain, hops).select("src", F.from_json("dst", "m string, n string").alias("_to"))
    keyed = imports.withColumn("src", F.to_json(F.struct(F.col("source").alias("m"), F.col("imported").alias("n"))))
    return keyed.join(ends, "src", "left").withColumns({"source": F.coalesce("_to.m", "source"), "imported": F.coalesce("_to.n", "imported")}).drop("src", "_to")


def unused(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """Exports that nobody imports, neither by name nor with all others."""
    whole = imports.where("imported = '*'").select(F.col("source").alias("module")).distinct()
    named = imports.select(F.col("source").alias("module"), F.col("imported").alias("exported")).distinct()
    return exports.join(whole, "module", "left_anti").join(named, ["module", "exported"], "left_anti")


def merged(imports: DataFrame) -> DataFrame:
    """(importer, source, names): one import of each source, with its distinct names in order."""
    return imports.groupBy("importer", "source").agg(F.array_sort(F.collect_set(F.struct("imported", "local"))).alias("names"))


def unified_locals(imports: DataFrame) -> DataFrame:
    """(importer, local, keep): local names that are second names of an import which the file has already."""
    first = imports.groupBy("importer", "source", "imported").agg(F.min("local").alias("keep"), F.count_distinct("local").alias("n")).where("n > 1")
    return imports.join(first, ["importer", "source", "imported"]).where("local <> keep").select("importer", "local", "keep").distinct()


def readable_name(name: Column) -> Column:
    return (F.length(name) > 2) & ~name.isin(rules.SHORT_NAMES) & name.rlike(r"^[A-Za-z_$][\w$]*$")


def consensus_names(imports: DataFrame, least: int = 2, share: float = 2 / 3) -> DataFrame:
    """(source, imported, name): what most importers call an export whose own name says nothing; numbers at the end of
    a name don't count."""
    named = imports.where(~readable_name(F.col("imported")) & readable_name(F.col("local"))).select("source", "imported", F.regexp_replace("local", r"\d+$", "").alias("name"))
    return votes.consensus(named, ["source", "imported"], "name", least, share).select("source", "imported", "name")


def sole_targets(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(importer, source, module): imports of chunks that hold just one module, which they can name themselves."""
    single = modules.groupBy("chunk").agg(F.min("module").alias("module"), F.count("*").alias("n")).where("n = 1").select(F.col("chunk").alias("source"), "module")
    return imports.select("importer", "source").distinct().join(single, "source").select("importer", "source", "module")


def exclusive_folders(edges: DataFrame, least: int = 3) -> DataFrame:
    """(dst, owner): files that one file alone imports, where it is the only importer of `least` files or more: they
    belong into its folder."""
    only = votes.unanimous(edges.where("src <> dst"), ["dst"], "src").withColumnRenamed("src", "owner")
    many = only.groupBy("owner").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("owner")
    return only.join(many, "owner", "left_semi").select("dst", "owner")


# Folders of a project, and by what a unit's facts it goes there; the first that holds counts.
FOLDERS = ["stores", "pages", "components", "hooks", "icons", "functions", "constants"]


def classify(units: DataFrame) -> DataFrame:
    """Adds folder to units (name, kind, calls, returns_markup, is_page, is_icon)."""
    store = F.exists("calls", lambda c: c.isin("defineStore", "createStore", "configureStore", "createSlice", "create"))
    folder = (
        F.when(store, "stores").when(F.col("is_page"), "pages").when(F.col("is_icon"), "icons").when(F.col("returns_markup"), "components")
        .when((F.col("kind") == "function") & F.col("name").rlike(r"^use[A-Z]"), "hooks").when(F.col("kind").isin("function", "class"), "functions").otherwise("constants")
    )
    return units.withColumn("folder", folder)


def destinations(units: DataFrame, root: str = "src") -> DataFrame:
    """Adds path to classified units: folder and name, unique but for case in the whole project."""
    ext = F.when(F.col("folder").isin("components", "pages", "icons"), ".jsx").otherwise(".js")
    named = units.withColumn("_file", F.concat(F.lit(f"{root}/"), "folder", F.lit("/"), "name"))
    return votes.unique_names(named, "_file", "name").withColumn("path", F.concat("unique_name", ext)).drop("_file", "unique_name")


def aliased(imports: DataFrame, root: str = "src") -> DataFrame:
    """Adds alias to resolved imports (importer, target): `@/..` for what lies below the root and isn't a neighbour."""
    below = F.regexp_extract("target", rf"^{root}/(.*)$", 1)
    near = F.regexp_replace("importer", r"[^/]*$", "") == F.regexp_replace("target", r"[^/]*$", "")
    return imports.withColumn("alias", F.when((below != "") & ~near, F.concat(F.lit("@/"), F.regexp_replace(below, r"\.(jsx?|tsx?|mjs)$", ""))))


def repointed(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Import edges (importer, target) after files moved (from, to): both ends follow."""
    a = moves.select(F.col("from").alias("_a"), F.col("to").alias("_a_to"))
    b = moves.select(F.col("from").alias("_b"), F.col("to").alias("_b_to"))
    joined = edges.join(a, F.col("importer") == F.col("_a"), "left").join(b, F.col("target") == F.col("_b"), "left")
    return joined.withColumns({"importer": F.coalesce("_a_to", "importer"), "target": F.coalesce("_b_to", "target")}).drop("_a", "_a_to", "_b", "_b_to")
