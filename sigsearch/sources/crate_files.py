"""Reading a directory of documentation files and set files.

Layout: ``<dir>/crate/<name>.json`` (one object per package with ``index`` and ``paths`` maps) and
``<dir>/set/<name>.json`` (a list of package names).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigsearch.operators.joins import shared_folder

# --- fixed values -------------------------------------------------------------------------------
ITEM_KINDS = ("function", "method", "trait", "impl", "typedef", "assoc_const")
PATH_KINDS = ("struct", "union", "enum", "function", "trait", "method")
# ------------------------------------------------------------------------------------------------

FILE_SCHEMA = "index map<string,string>, paths map<string,string>, _bad string"
ENTRY_SCHEMA = "kind string, name string, docs string, inner string, path array<string>"
STAGED_SCHEMA = "crate string, id string, name string, docs string, inner string, path array<string>, source string, kind string"
# Text inside an item stays JSON text, so only the maps themselves are decoded per file.
JSON_OPTIONS = {"columnNameOfCorruptRecord": "_bad", "maxNestingDepth": "1000000", "maxStringLen": "2000000000"}


def _stem() -> Column:
    name = F.try_url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # names come as part of a URL
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def _whole_files(spark: SparkSession, path: str, key: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(_stem().alias(key), "value")


def file_entries(spark: SparkSession, directory: str) -> DataFrame:
    """(crate, source, id, text) of ``<directory>/crate``, every file decoded once.

    ``source`` is 'item' or 'path' for the members of a good file, and 'good' or 'bad' for the file; the text of a
    bad one is the reason: 'no JSON' (or nested too deeply for the reader), 'no index or paths', or 'unknown layout' if a member of the index has no kind.
    """
    files = _whole_files(spark, f"{directory}/crate", "crate").withColumn(
        "j", F.from_json("value", FILE_SCHEMA, JSON_OPTIONS)
    )
    entry = "struct('{0}' AS source, {1} AS id, {2} AS text)"
    none = "cast(NULL AS string)"
    # The outer form keeps Spark from adding a filter that would decode the file once more.
    return files.selectExpr("crate", f"""inline_outer(
        CASE WHEN j IS NULL OR j._bad IS NOT NULL THEN array({entry.format('bad', none, "'no JSON'")})
          WHEN j.index IS NULL OR j.paths IS NULL THEN array({entry.format('bad', none, "'no index or paths'")})
          WHEN exists(map_values(j.index), t -> get_json_object(t, '$.kind') IS NULL)
            THEN array({entry.format('bad', none, "'unknown layout'")})
        ELSE concat(array({entry.format('good', none, none)}),
          transform(map_entries(j.index), e -> {entry.format('item', 'e.key', 'e.value')}),
          transform(map_entries(j.paths), e -> {entry.format('path', 'e.key', 'e.value')})) END)""")


def stage(entries: DataFrame, directory: str | None = None) -> dict[str, DataFrame]:
    """Write the entries a search needs, split by kind, and return them as tables.

    ``items`` (crate, id, kind, name, docs, inner), ``paths`` (crate, id, path, kind), ``bad_files``
    (crate, reason) and ``crates`` (crate).  Rows are spread over all tasks on the way, since one file may hold
    a large part of them.
    """
    spark = entries.sparkSession
    directory = directory or f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    kept = (F.col("source") == "item") & F.col("kind").isin(*ITEM_KINDS)
    kept |= (F.col("source") == "path") & F.col("kind").isin(*PATH_KINDS)
    kept |= F.col("source").isin("good", "bad")
    (
        entries.withColumn("e", F.from_json("text", ENTRY_SCHEMA))
        .select("source", "crate", "id", F.coalesce("e.kind", F.lit("-")).alias("kind"), "e.name",
                F.when(F.col("source") == "bad", F.col("text")).otherwise(F.col("e.docs")).alias("docs"), "e.inner", "e.path")
        .filter(kept)
        .repartition("crate", "id")
        .write.partitionBy("source", "kind").parquet(directory)
    )
    staged = spark.read.schema(STAGED_SCHEMA).parquet(directory)
    items, paths, good, bad = (staged.filter(F.col("source") == s) for s in ("item", "path", "good", "bad"))
    return {
        "items": items.select("crate", "id", "kind", "name", "docs", "inner"),
        "paths": paths.select("crate", "id", "path", "kind"),
        "bad_files": bad.select("crate", F.col("docs").alias("reason")),
        "crates": good.select("crate").unionByName(bad.select("crate")),
    }


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """(name) of the files that Spark's readers pass over because of how their names begin."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(folder)
    names = [s.getPath().getName() for s in found if s.isFile()]
    skipped = [(n,) for n in names if n[0] in "._" and not n.endswith(".crc")]
    return spark.createDataFrame(skipped, "file string").select(F.regexp_replace("file", r"(?<=.)\.[^.]*$", "").alias("name"))


def read_crate_files(spark: SparkSession, directory: str, staged: str | None = None) -> dict[str, DataFrame]:
    """The tables of ``stage`` for ``<directory>/crate``; files that the reader passes over are bad ones too."""
    tables = stage(file_entries(spark, directory), staged)
    skipped = skipped_files(spark, f"{directory}/crate").select(F.col("name").alias("crate"))
    return tables | {
        "bad_files": tables["bad_files"].unionByName(skipped.withColumn("reason", F.lit("skipped by its name"))),
        "crates": tables["crates"].unionByName(skipped),
    }


def _set_files(spark: SparkSession, directory: str) -> DataFrame:
    """(set, crates) of ``<directory>/set``; crates is NULL for a file that is no list of texts."""
    try:
        files = _whole_files(spark, f"{directory}/set", "set")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "set string, crates array<string>")
    return files.select("set", F.from_json("value", "array<string>").alias("crates"))


def read_sets(spark: SparkSession, directory: str) -> DataFrame:
    """(set, crate) rows of ``<directory>/set``; no rows if there is no such directory.

    A set file that is no list of texts has no rows here; ``bad_sets`` names it.
    """
    return _set_files(spark, directory).select("set", F.explode("crates").alias("crate")).filter(F.col("crate").isNotNull())


def bad_sets(spark: SparkSession, directory: str) -> DataFrame:
    """(set, reason) of the set files that cannot be used, or only in part."""
    reason = F.when(F.col("crates").isNull(), "no list of names").when(F.exists("crates", lambda c: c.isNull()), "a name is null")
    return _set_files(spark, directory).select("set", reason.alias("reason")).filter(F.col("reason").isNotNull())


def make_scopes(sets: DataFrame, crates: DataFrame) -> DataFrame:
    """(scope, crate) rows: every set and every single package, without repeats."""
    return (
        sets.select(F.concat(F.lit("set:"), "set").alias("scope"), "crate")
        .unionByName(crates.select(F.concat(F.lit("crate:"), "crate").alias("scope"), "crate"))
        .distinct()
    )


def file_lines(entries: DataFrame) -> DataFrame:
    """(crate, part, nth, line): the lines of one documentation file per package, in order.

    ``entries`` are (crate, source, id, text) with source 'item' or 'path'.  The members of a package are numbered
    as they stream by, in the order of their ids; no package is gathered.
    """
    rows = entries.select("crate", F.when(F.col("source") == "item", 1).otherwise(3).alias("part"), "id", "text")
    nth = F.row_number().over(Window.partitionBy("crate").orderBy("part", "id"))
    start = F.lag("part").over(Window.partitionBy("crate").orderBy("part", "id"))
    member = F.concat(F.when(start == F.col("part"), ",").otherwise(""), F.to_json(F.struct("id")).substr(F.lit(7), F.length(F.to_json(F.struct("id"))) - 7), F.lit(":"), "text")
    members = rows.select("crate", "part", nth.alias("nth"), member.alias("line"))
    frame = entries.select("crate").distinct().selectExpr(
        "crate", """stack(5, 0, 0, '{"index":{', 2, 0, '}', 3, 0, ',"paths":{', 4, 0, '}', 5, 0, '}') AS (part, nth, line)""")
    return members.unionByName(frame)


def write_lines(lines: DataFrame, directory: str) -> None:
    """Write ``<directory>/<crate>.json`` for every package from (crate, part, nth, line).

    A task writes the lines of its packages one behind the other into a folder of each package, under Spark's commit
    protocol; then the files get their names.
    """
    spark = lines.sparkSession
    staged = f"{directory}-staged-{uuid.uuid4().hex}"
    order = ["crate", "part", "nth"]
    lines.repartition("crate").sortWithinPartitions(*order).select(F.col("crate").alias("file"), "line").write.partitionBy("file").text(staged)
    jvm = spark.sparkContext._jvm
    Path, unescaped = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    folder = Path(staged)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(Path(directory))
    for at in system.listStatus(folder):  # one rename per package
        if at.isDirectory():
            for file in system.listStatus(at.getPath()):
                name = unescaped(at.getPath().getName().removeprefix("file="))
                if file.getPath().getName().startswith("part-"):
                    system.rename(file.getPath(), Path(f"{directory}/{name}.json"))
