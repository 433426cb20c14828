"""Readers of public trajectory data sets in their published layouts."""
from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import labels_by_interval, speed_filter_lag
from ..operators.splits import drawn_keys, trajectory_cap
from ..session import work_dir
from .tables import read_table, to_seconds

# Transport labels and the classes they count as.
MODE_CLASSES = {"walk": "walk", "bike": "bike", "bus": "bus", "car": "car", "taxi": "car", "train": "train", "subway": "train", "railway": "train"}

# Files up to this size are read as one value each; larger ones are read by splits.
WHOLE_FILE_BYTES = 16 * 1024 * 1024

# The driver holds a list of about this many files of a tree of folders at a time (1 to 2 KB each); it first lists so many folders to see how many files they have.
FILES_AT_ONCE, FOLDERS_FIRST = 50_000, 100


def _path_part(index: int):
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), index)


def _stem():
    return F.regexp_replace(_path_part(-1), "\\.[^.]*$", "")


def _depth(spark: SparkSession, root: str) -> int:
    """Folders above the entries of ``root``, from the top of its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(path).depth()


def _listed(spark: SparkSession, path: str | list[str], names: str) -> DataFrame:
    """The files of these names at any depth, listed once, here. Each task of Spark's listing loads Hadoop's settings anew, which takes longer than
    listing a folder, so tasks get many folders each: there are a few for every core, not one for every folder. The list is held by the result
    alone, not by Spark's cache of lists too."""
    key, cache = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.hive.filesourcePartitionFileCacheSize"
    before = {k: spark.conf.get(k) for k in (key, cache)}
    spark.conf.set(key, str(min(int(before[key]), 8 * spark.sparkContext.defaultParallelism)))
    spark.conf.set(cache, "0")
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _entries(spark: SparkSession, root: str) -> list[str]:
    """Paths right below ``root``, which may be a pattern; thousands come over from Java at a time."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*")
    store = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = spark._jvm.org.apache.spark.deploy.SparkHadoopUtil.get().globPath(store, pattern)
    mark, out, step = "\n//\n", [], 10_000                # no path has that in it
    for first in range(0, found.size(), step):
        out.extend(found.slice(first, first + step).mkString(mark).split(mark))
    return out


def _in_turns(spark: SparkSession, root: str, names: str) -> Iterator[tuple[DataFrame, bool]]:
    """The files of these names below the folders in ``root``, about ``FILES_AT_ONCE`` at a time, and whether they are the last. Each list is to be
    dropped before the next one is asked for: the driver cannot hold the list of any number of files. All files of one folder are in one list."""
    folders, first, n, rate = _entries(spark, root), 0, FOLDERS_FIRST, 0.0
    if not folders:
        yield _listed(spark, f"{root.rstrip('/')}/*", names), True             # Spark's error
    while first < len(folders):
        some = folders[first:first + n]
        files = _listed(spark, [_literal(f) for f in some], names)
        found = len(files._jdf.inputFiles())
        if not first and n < len(folders) and 2 * found <= FILES_AT_ONCE:      # more go into the first list, all if they are few
            n = int(n * min(10, FILES_AT_ONCE / max(found, 1)))
            continue
        rate, first = max(rate, found / len(some)), first + len(some)          # of the fullest list: the next folders may be like those
        yield files, first >= len(folders)
        files, n = None, max(1, min(10 * n, int(FILES_AT_ONCE / rate) if rate else 10 * n))


def _by_size(files: DataFrame) -> tuple[DataFrame, list[str]]:
    """Of files listed once (format ``binaryFile``): the ones read whole, and the paths of the larger ones, as patterns that match only them.

    Readers of text and CSV set up a reader for every file, which takes several times as long as reading a short file.
    """
    size = F.col("_metadata.file_size")
    large = files.filter(size > WHOLE_FILE_BYTES).select("path").collect()
    return files.filter(size <= WHOLE_FILE_BYTES), [_literal(r.path) for r in large]


def _literal(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _split_lines() -> Column:
    """Lines of a file read whole, ended as Hadoop's line reader ends them, without a byte order mark."""
    return F.split(F.regexp_replace(F.col("content").cast("string"), "^\ufeff", ""), "\r\n|\r|\n")


def _whole(files: DataFrame, lines: Column, **columns: Column) -> DataFrame:
    """``lines`` of each file read whole, as an array, beside columns of its path. Spark counts every file as 4 MB when it deals them to tasks; short
    files by the hundred thousand would make tasks of 32, so these are joined to a few tasks for every core."""
    return files.select(*[c.alias(n) for n, c in columns.items()], "content").coalesce(8 * files.sparkSession.sparkContext.defaultParallelism) \
        .select(*columns, lines.alias("_lines"))


def _lines(files: DataFrame, **columns: Column) -> DataFrame:
    """Text lines (``value``) of listed files, with columns of the file's path; empty lines are left out."""
    whole, large = _by_size(files)
    out = _whole(whole, _split_lines(), **columns).select(*columns, F.explode("_lines").alias("value"))
    if large:
        out = out.unionByName(files.sparkSession.read.text(large).select(*[c.alias(n) for n, c in columns.items()], "value"))
    return out.filter("value <> ''")


def _geolife_lines(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Fixes (user_id, traj_id, lat, lon, t) and lines of labels (user_id, value). A tree with more files than the driver lists at once is read into
    the work folder, some users after others."""
    depth = _depth(spark, root)
    base = f"{work_dir(spark)}/read/geolife-{uuid.uuid4().hex[:8]}"
    whole = True
    # one listing serves both kinds of files; below the users' folders Spark lists in tasks
    for files, last in _in_turns(spark, root, "{*.plt,labels.txt}"):
        parts = dict(zip(("fixes", "labels"), _geolife_parts(files, depth)))
        if whole and last:
            return parts["fixes"], parts["labels"]
        whole = False
        for name, part in parts.items():
            part.write.mode("append").parquet(f"{base}/{name}")
        del files, part, parts
    return spark.read.parquet(f"{base}/fixes"), spark.read.parquet(f"{base}/labels")


def _geolife_parts(files: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    path = F.regexp_replace("_metadata.file_path", "^[^:/]+:(//[^/]*)?", "")
    at_depth = lambda n: F.size(F.split(path, "/")) == depth + n + 1
    plt = files.filter(at_depth(3) & (_path_part(-2) == "Trajectory") & F.col("_metadata.file_name").endswith(".plt"))
    lines = _lines(plt, user_id=_path_part(-3), trip=_stem())
    f = F.split("value", ",")
    fixes = lines.filter(F.col("value").rlike(r"^[^,]*(,[^,]*){4},\d{4}-\d{2}-\d{2},\s*\d{2}:\d{2}:\d{2}\s*$"))
    stamp = F.to_timestamp_ntz(F.concat_ws(" ", f[5], F.trim(f[6])), F.lit("yyyy-MM-dd HH:mm:ss"))
    points = fixes.select("user_id", F.concat_ws("_", "user_id", "trip").alias("traj_id"), stamp.alias("_s"),
                          f[0].try_cast("double").alias("lat"), f[1].try_cast("double").alias("lon"))
    return points.withColumn("t", to_seconds(points, "_s")).drop("_s"), \
        _lines(files.filter(at_depth(2) & (F.col("_metadata.file_name") == "labels.txt")), user_id=_path_part(-2))


def read_geolife(spark: SparkSession, root: str, users: list[str] | None = None, labelled_only: bool = False,
                 max_speed_mps: float | None = 60.0) -> DataFrame:
    """Directory tree ``<user>/Trajectory/<trip>.plt`` with ``<user>/labels.txt`` intervals.

    Fix lines are recognised by their shape (seven fields with a date), so header lines need no line
    numbers and large files stay splittable.
    """
    points, rows = _geolife_lines(spark, root)
    g = F.split("value", "\t")
    at = lambda c: F.to_timestamp_ntz(F.trim(c), F.lit("yyyy/MM/dd HH:mm:ss"))
    raw = rows.filter(F.col("value").rlike(r"^\d{4}/")).select("user_id", at(F.get(g, 0)).alias("_a"), at(F.get(g, 1)).alias("_b"), F.lower(F.trim(F.get(g, 2))).alias("raw"))
    mode = F.create_map(*[F.lit(x) for kv in MODE_CLASSES.items() for x in kv])[F.col("raw")]
    labels = raw.select("user_id", to_seconds(raw, "_a").alias("start"), to_seconds(raw, "_b").alias("end"), mode.alias("mode")).dropna()
    if users is not None:
        points, labels = points.filter(F.col("user_id").isin(users)), labels.filter(F.col("user_id").isin(users))
    if labelled_only:
        points = points.join(rows.select("user_id").distinct(), "user_id", "left_semi")
    out = labels_by_interval(points, labels).filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    if max_speed_mps is not None:
        out = speed_filter_lag(out, max_speed_mps)
    if labelled_only:
        known = out.filter("mode is not null").select("traj_id").distinct()
        out = out.join(known, "traj_id", "left_semi")
    return out.select("user_id", "traj_id", "t", "lat", "lon", "mode")


def read_worldtrace(spark: SparkSession, root: str, max_trajectories: int | None = None, seed: int = 0, use_matched: bool = False) -> DataFrame:
    """Folder of per-trajectory CSV files (time, latitude, longitude[, matched_*]); every trajectory is
    its own user. A cap draws whole files."""
    lat, lon = ("matched_latitude", "matched_longitude") if use_matched else ("latitude", "longitude")
    raw = _csv_rows(spark, root)
    rows = raw.select(F.col("_file").alias("traj_id"), F.col("time"), F.col(lat).try_cast("double").alias("lat"), F.col(lon).try_cast("double").alias("lon"))
    out = rows.select("traj_id", to_seconds(rows, "time").alias("t"), "lat", "lon").dropna()
    if max_trajectories:
        out = out.join(drawn_keys(out, "traj_id", max_trajectories, seed, "file"), "traj_id", "left_semi")
    return out.select(F.col("traj_id").alias("user_id"), "traj_id", "t", "lat", "lon")


def _csv_rows(spark: SparkSession, root: str) -> DataFrame:
    """Text columns of the CSV files below ``root`` and the name of each row's file as ``_file``. As Spark's own reader has it, one file's header names
    the columns of all, and every file's first line is dropped."""
    files = _listed(spark, root, "*.csv")
    first = files.filter("_metadata.file_size > 0").select("path").head(1)
    header = spark.read.option("header", True)
    schema = (header.csv(_literal(first[0].path)) if first else header.csv(root, recursiveFileLookup=True, pathGlobFilter="*.csv")).schema
    whole, large = _by_size(files)
    kept = F.filter(_split_lines(), lambda v: v.rlike(r"[^\x00-\x20]"))
    fields = ", ".join("`" + n.replace("`", "``") + "` string" for n in schema.names)
    body = _whole(whole, kept, _file=_stem()).select("_file", F.posexplode("_lines").alias("_i", "_line")).filter("_i > 0")
    rows = body.select("_file", F.inline(F.array(F.from_csv("_line", fields))))  # a generator: every line is parsed once, however often its fields are used
    if large:
        rows = rows.unionAll(spark.read.schema(schema).option("header", True).csv(large).select(_stem().alias("_file"), "*"))
    return rows


def read_porto(spark: SparkSession, path: str, max_trajectories: int | None = None, seed: int = 0, step_s: float = 15.0, drop_missing: bool = True) -> DataFrame:
    """Taxi trips with a JSON list of [lon, lat], one fix per ``step_s`` from TIMESTAMP."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path) \
        .select("TRIP_ID", "TAXI_ID", "TIMESTAMP", "MISSING_DATA", "POLYLINE")
    if drop_missing:
        rows = rows.filter(F.lower(F.trim("MISSING_DATA")) != "true")
    if max_trajectories:
        rows = rows.join(drawn_keys(rows, "TRIP_ID", max_trajectories, seed, "trip"), "TRIP_ID", "left_semi")
    line = F.from_json("POLYLINE", "array<array<double>>")
    p = rows.select(F.col("TAXI_ID").alias("user_id"), F.col("TRIP_ID").alias("traj_id"), F.col("TIMESTAMP").cast("double").alias("t0"), F.posexplode(line).alias("i", "p"))
    return p.select("user_id", "traj_id", (F.col("t0") + step_s * F.col("i")).alias("t"), F.col("p")[1].alias("lat"), F.col("p")[0].alias("lon"))


def read_trip_tables(spark: SparkSession, trips: str, trip_info: str | None = None) -> DataFrame:
    """``trips(trip, seq_i, time, lng, lat)`` with the driver of ``trip_info(trip, driver)`` as user."""
    t = read_table(spark, trips)
    rows = t.select(F.col("trip").cast("string").alias("traj_id"), to_seconds(t, "time").alias("t"), F.col("lat").cast("double"), F.col("lng").cast("double").alias("lon"))
    if trip_info is None:
        return rows.select(F.col("traj_id").alias("user_id"), "traj_id", "t", "lat", "lon")
    info = read_table(spark, trip_info).select(F.col("trip").cast("string").alias("traj_id"), F.col("driver").cast("string").alias("user_id"))
    return rows.join(info, "traj_id", "left").select("user_id", "traj_id", "t", "lat", "lon")


def archive_subset(points: DataFrame, n: int, path: str, min_points: int = 36, seed: int = 0) -> DataFrame:
    """``n`` drawn trajectories of at least ``min_points`` fixes, written compactly with every
    trajectory in one file region."""
    sizes = points.groupBy("traj_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_points)
    kept = trajectory_cap(points.join(sizes.select("traj_id"), "traj_id", "left_semi"), n, seed)
    kept.repartitionByRange("traj_id", "t").sortWithinPartitions("traj_id", "t").write.mode("overwrite").parquet(path)
    return points.sparkSession.read.parquet(path)
