"""Readers and writers of the file formats: beat tables, corrected bars, onsets, overviews, results, wide grids."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEATS = "`beat_time(s)` DOUBLE, `downbeat_time(s)` DOUBLE, beat_pos INT, global_beat INT, bar_num INT"


def track_of(path: Column | str = "_metadata.file_path", ending: str = "") -> Column:
    """A file's name without folder and ending is its track."""
    return F.url_decode(F.regexp_extract(F.col(path) if isinstance(path, str) else path, rf"([^/]+?)(?:{ending})?\.[^./]*$", 1))


#: Lines of a file that holds many tracks, at most.
LINES = 100_000


def packed(rows: DataFrame, lines: int = LINES) -> DataFrameWriter:
    """A writer of text formats in which a file holds many tracks: their lines have a column track_id.

    So the number of files goes with the rows and not with the tracks, and a file of bounded size can be parsed whole.
    """
    return rows.write.option("maxRecordsPerFile", lines).option("header", True)


def _track(rows: DataFrame) -> Column:
    """The track of a row: a folder track_id=... or a column of that name, else the file's name."""
    return F.col("track_id").cast("string") if "track_id" in rows.columns else track_of()


def _tracks(header: list[str], lines: list[list[str]], track: str) -> pa.Array:
    """The track of each line: its cell under track_id, or that of the file."""
    at = header.index("track_id") if "track_id" in header else None
    return pa.array([track if at is None else row[at] if at < len(row) else None for row in lines], pa.string())


def _parsed(spark: SparkSession, path: str, find: Callable[[list[str]], list[int] | None], columns: list[str], sep: str = ",", default: list[int] | None = None) -> DataFrame:
    """CSV files with headers of their own, each parsed whole: track_id and the columns as text, by one scan.

    find: called with a row's cells, gives the places of the columns if the row is the header. A file without one has
    the places `default`, or no rows. Quoted cells may hold separators and line ends; cells that a line lacks are null.
    A header with a column track_id says the track of each line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for track, text in zip(batch.column("track_id").to_pylist(), batch.column("value").to_pylist(), strict=True):
                rows = [[c.strip() for c in row] for row in csv.reader(io.StringIO((text or "").lstrip("\ufeff"), newline=""), delimiter=sep, skipinitialspace=True) if row]
                header, places = next(((i, at) for i, row in enumerate(rows) if (at := find(row)) is not None), (-1, default))
                lines = [row for i, row in enumerate(rows) if i != header] if places is not None else []
                cells = {c: pa.array([row[at] if 0 <= at < len(row) else None for row in lines], pa.string()) for c, at in zip(columns, places or [], strict=bool(places))}
                if lines:
                    yield pa.record_batch({"track_id": _tracks(rows[header] if header >= 0 else [], lines, track)} | cells)

    rows = spark.read.text(path, wholetext=True)
    return rows.select(_track(rows).alias("track_id"), "value").mapInArrow(run, ", ".join(f"`{c}` string" for c in ["track_id", *columns]))


def read_beats(spark: SparkSession, path: str) -> DataFrame:
    """Beat tables with a header line, one file per track or with a first column track_id. Missing bar_num or beat_pos is an error."""
    header = spark.read.csv(path, sep="\t", header=True).columns
    if missing := {"bar_num", "beat_pos"} - set(header):
        raise ValueError(f"beat table without {sorted(missing)}")
    many = "track_id STRING, " if header[:1] == ["track_id"] else ""
    rows = spark.read.csv(path, sep="\t", header=True, schema=many + BEATS, enforceSchema=False)
    return rows.select(_track(rows).alias("track_id"), F.col("`beat_time(s)`").alias("beat_time"), F.col("`downbeat_time(s)`").alias("downbeat_time"), "beat_pos", "global_beat", "bar_num")


CORRECTED = "corrected_bar_num INT, bar_num STRING, start DOUBLE, next DOUBLE, duration_s DOUBLE, tempo_bpm DOUBLE, usable INT, bpm_threshold STRING, action STRING, removed STRING, inserted STRING"


def read_corrected(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Corrected-bar tables with '# key=value' lines: the bars, and a row of metadata per track (time_signature: 4 if absent).

    A file holds a track, or many: lines then begin with a cell track_id, and those of metadata are '# track_id<TAB>key=value'.
    """
    first = spark.read.text(path).where("value LIKE 'corrected_bar_num\t%' OR value LIKE 'track_id\t%'").first()
    many = first is not None and first.value.startswith("track_id")
    rows = spark.read.csv(path, sep="\t", header=True, comment="#", schema=("track_id STRING, " if many else "") + CORRECTED)
    number = F.col("bar_num")
    bars = rows.select(
        _track(rows).alias("track_id"), "corrected_bar_num", F.transform(F.split(number, r"\|"), lambda x: x.cast("int")).alias("bar_num"), "start", F.col("next").alias("end"), "duration_s", "tempo_bpm",
        (F.col("usable") == 1).alias("usable"), "bpm_threshold", "action", F.col("removed").try_cast("double").alias("removed"), F.col("inserted").try_cast("double").alias("inserted"),
    )
    if many:
        text = spark.read.text(path).where("value LIKE '#%'").select(F.regexp_extract("value", r"^#\s*([^\t]*)\t", 1).alias("track_id"), F.regexp_replace("value", r"^#[^\t]*\t", "# ").alias("line"))
        text = text.withColumn("number", F.monotonically_increasing_id())  # in the order of a file's lines
    else:
        text = spark.read.text(path, wholetext=True)
        text = text.select(_track(text).alias("track_id"), F.posexplode(F.split("value", r"\r?\n")).alias("number", "line")).where("line LIKE '#%'")
    lines = text.select("track_id", "number", F.regexp_extract("line", r"^#\s*(\w+)\s*=", 1).alias("key"), F.trim(F.regexp_extract("line", r"^#\s*\w+\s*=(.*)$", 1)).alias("v"))
    first = lines.where("key <> ''").groupBy("track_id", "key").agg(F.min_by("v", "number").alias("v"))  # of a repeated key the first
    entries = first.groupBy("track_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "v"))).alias("meta"))
    meta = bars.select("track_id").distinct().join(entries.hint("merge"), "track_id", "left")
    return bars, meta.select("track_id", F.coalesce(F.try_element_at("meta", F.lit("time_signature")).try_cast("int"), F.lit(4)).alias("time_signature"), "meta")


def write_corrected(fixed: DataFrame, statistics: DataFrame, path: str, buckets: int = 64) -> None:
    """Two Parquet tables under path, bars and tracks, the bars in folders by a hash bucket of the track."""
    fixed.withColumn("bucket", F.pmod(F.xxhash64("track_id"), F.lit(buckets))).repartition("bucket").write.partitionBy("bucket").mode("errorifexists").parquet(f"{path}/bars")
    statistics.write.mode("errorifexists").parquet(f"{path}/tracks")


def text_of_corrected(fixed: DataFrame) -> DataFrame:
    """The columns as the text format has them: sources joined by |, times to 6 decimals, tempos to 2, flags 0 and 1."""

    def time(c: str) -> Column:
        return F.coalesce(F.format_string("%.6f", c), F.lit(""))

    return fixed.select(
        "track_id", "corrected_bar_num", F.array_join(F.transform("bar_num", lambda x: x.cast("string")), "|").alias("bar_num"), time("start").alias("start"), time("end").alias("next"),
        time("duration_s").alias("duration_s"), F.format_string("%.2f", "tempo_bpm").alias("tempo_bpm"), F.col("usable").cast("int").alias("usable"), "bpm_threshold", "action", time("removed").alias("removed"), time("inserted").alias("inserted"),
    )


def read_onsets(spark: SparkSession, path: str) -> DataFrame:
    """Onset lists: each file's column onset_times or onset_time, else its first; what is no number is dropped."""

    def find(row: list[str]) -> list[int] | None:
        return next(([row.index(n)] for n in ("onset_times", "onset_time") if n in row), None)

    return _parsed(spark, path, find, ["t"], default=[0]).select("track_id", F.col("t").try_cast("double").alias("t")).where("t IS NOT NULL")


def write_onsets(onsets: DataFrame, path: str, by_track: bool = False) -> None:
    """Onset lists in files that hold many tracks, or in a folder for each track."""
    rows = onsets.select("track_id", F.col("t").alias("onset_times"))
    if by_track:
        # files are moved by the tasks that write them, not one after the other by the driver
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("track_id").csv(path, header=True)
    else:
        packed(rows).csv(path)


def read_overview(spark: SparkSession, path: str) -> DataFrame:
    """;-separated overviews with messy headers, each file by its own: song_id, songname, offset (ms in the file, seconds here)."""

    def find(row: list[str]) -> list[int]:
        names = [c.lower() for c in row]
        places = [next((i for i, c in enumerate(names) if part in c), -1) for part in ("id", "name", "offset")]
        if places[0] < 0 or places[2] < 0:
            raise ValueError("overview without an id or offset column")
        return places

    rows = _parsed(spark, path, find, ["song_id", "songname", "offset"], ";")
    ms = F.regexp_replace("offset", ",", ".").try_cast("double")
    empty = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("song_id", "songname")]
    return rows.select(*empty, (ms / 1000.0).alias("offset"))


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Pattern lengths by track: CSV files whose first column is the track and whose second the length, under a header."""
    rows = _parsed(spark, path, lambda row: [0, 1], ["name", "L"])
    return rows.select(F.col("name").alias("track_id"), F.col("L").try_cast("int").alias("L")).where("L IS NOT NULL")


RESULT = T.StructType([
    T.StructField("track_id", T.StringType()),
    T.StructField("correction", T.StructType([T.StructField("raw_bars", T.IntegerType()), T.StructField("corrected_bars", T.IntegerType())])),
    T.StructField("onsets", T.StructType([T.StructField("count", T.IntegerType())])),
    T.StructField("pattern_lengths", T.MapType(T.StringType(), T.IntegerType())),
    T.StructField("errors", T.ArrayType(T.StringType())),
    T.StructField("steps_completed", T.ArrayType(T.StringType())),
])


def read_results(spark: SparkSession, path: str, schema: T.StructType = RESULT, lines: bool = False) -> DataFrame:
    """Result files (one JSON document each, or one in each line) under a folder tree; broken ones are left out."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(full).option("multiLine", not lines).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("track_id", F.coalesce("track_id", track_of())).where("_corrupt_record IS NULL").drop("_corrupt_record")


def write_json(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Rows as JSON; with `by`, a folder for each of its values, so rows that differ in it are files of their own."""
    (rows.write.partitionBy(by) if by else rows.write).json(path)


def read_wide(spark: SparkSession, path: str, keys: tuple[str, ...] = ("bar_number", "bar_number_global", "tick_16th", "onset_time_uncorrected")) -> DataFrame:
    """A wide grid (columns phase_<method>, grid_time_<method>, the length in the name as L=n) in long form.

    Files may have unlike columns: each is read by its own header, the line that names a phase or grid time. Keys that a
    file lacks are null, and so are cells that a line lacks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for track, text in zip(batch.column("track_id").to_pylist(), batch.column("value").to_pylist(), strict=True):
                rows = [[c.strip() for c in row] for row in csv.reader(io.StringIO(text or "", newline=""), skipinitialspace=True) if row]
                header = next((i for i, row in enumerate(rows) if any(c.startswith(("phase_", "grid_time_")) for c in row)), None)
                if header is None:
                    continue
                names, lines = rows[header], [row + [None] * (len(rows[header]) - len(row)) for i, row in enumerate(rows) if i != header]
                own = {k: pa.array([row[names.index(k)] if k in names else None for row in lines], pa.string()) for k in keys}
                places = [i for i, c in enumerate(names) if c.startswith(("phase_", "grid_time_"))]
                cells = pa.array([[(names[i], row[i]) for i in places] for row in lines], pa.map_(pa.string(), pa.string()))
                yield pa.record_batch({"track_id": _tracks(names, lines, track)} | own | {"m": cells})

    text = spark.read.text(path, wholetext=True)
    types = ", ".join(f"`{k}` string" for k in ("track_id", *keys))
    rows = text.select(_track(text).alias("track_id"), "value").mapInArrow(run, f"{types}, m map<string, string>")
    cells = rows.select("track_id", *(F.col(k).try_cast("double").alias(k) for k in keys), F.explode("m").alias("name", "text"))
    return _methods(cells.select("track_id", *keys, "name", F.col("text").try_cast("double").alias("v")), ["track_id", *keys])


def wide_to_long(wide: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    names = [c for c in wide.columns if c.startswith(("phase_", "grid_time_"))]
    quoted = [F.col(f"`{c}`").cast("double").alias(c) for c in names]
    kept = [k for k in keys if k in wide.columns]
    long = wide.select(*kept, *quoted).unpivot([F.col(k) for k in kept], [F.col(f"`{c}`") for c in names], "name", "v")
    return _methods(long, kept)


def _methods(long: DataFrame, kept: list[str]) -> DataFrame:
    """Cells (keys, name, v) as rows by method and length."""
    kind = F.when(F.col("name").startswith("phase_"), "phase").otherwise("grid_time")
    long = long.withColumn("kind", kind).withColumn("method", F.regexp_replace(F.regexp_replace("name", r"^(phase|grid_time)_", ""), r"\(.*$", ""))
    long = long.withColumn("L", F.nullif(F.regexp_extract("name", r"L=(\d+)", 1), F.lit("")).cast("int"))
    value = [F.max(F.when((F.col("kind") == k) & ~F.isnan("v"), F.col("v"))).alias(k) for k in ("phase", "grid_time")]
    return long.groupBy(*kept, "method", "L").agg(*value)


def read_values(spark: SparkSession, path: str, low: float, high: float) -> DataFrame:
    """Value series (time, f0_hz), voiced and inside [low, high): the filter is pushed to the scan."""
    many = "track_id STRING, " if spark.read.csv(path, header=True).columns[:1] == ["track_id"] else ""
    rows = spark.read.csv(path, header=True, schema=many + "time DOUBLE, f0_hz DOUBLE")
    return rows.where((F.col("time") >= low) & (F.col("time") < high) & (F.col("f0_hz") > 0)).select(_track(rows).alias("track_id"), F.col("time").alias("t"), F.col("f0_hz").alias("value"))


def discover(spark: SparkSession, path: str, pattern: str, low: int | None = None, high: int | None = None, glob: str = "*", folders: bool = False) -> DataFrame:
    """Files whose name matches a regular expression with one group, the id; `._` files and empty ones are skipped.

    With a range, ids must be numbers inside it. folders: the whole path is matched instead of the name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")
    name = F.url_decode(F.regexp_extract("path", r"([^/]+)$", 1))
    rows = files.withColumn("name", name).where(~F.col("name").startswith("._")).withColumn("id", F.regexp_extract(F.url_decode("path") if folders else F.col("name"), pattern, 1)).where("id <> ''")
    if low is not None and high is not None:
        rows = rows.where(F.coalesce(F.col("id").try_cast("int").between(low, high), F.lit(False)))
    return rows


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation tables (dataset, song, t, and beat_pos where it is known)."""
    rows = spark.read.parquet(path)
    return rows if "beat_pos" in rows.columns else rows.withColumn("beat_pos", F.lit(None).cast("int"))


def write_wide(wide: DataFrame, path: str, mode: str = "errorifexists", present: str | None = None) -> None:
    """A wide grid (track_id, keys, columns by method) as CSV with headers, in files that hold many tracks.

    present: a column with the methods that a row has, named as in the columns of cells. A line is read back as a row for
    every method of its file, so rows lie in files without the columns of methods that they lack: one pass for each set of
    methods that occurs.
    """
    if present is None:
        packed(wide).mode(mode).csv(path)
        return
    cells = {c: c.removeprefix("phase_").removeprefix("grid_time_") for c in wide.columns if c.startswith(("phase_", "grid_time_"))}
    held = F.array_sort(present)
    for names in wide.agg(F.collect_set(held)).first()[0] or [list(cells.values())]:
        kept = [f"`{c}`" for c in wide.columns if c != present and (c not in cells or cells[c] in names)]
        packed(wide.where(held == F.array(*map(F.lit, names)).cast("array<string>")).select(*kept)).mode(mode).csv(path)
        mode = "append"


def write_table(rows: DataFrame, path: str) -> None:
    """Bar tempos side by side, bar durations, histograms: CSV with a header, in as many files as the rows need."""
    rows.write.csv(path, header=True)


def write_references(references: DataFrame, ranges: DataFrame, path: str) -> None:
    """The references whose bar lies inside the snippet."""
    references.join(ranges.select("track_id", "first_bar", F.col("last_bar").alias("last")), "track_id").where("ref_bar BETWEEN first_bar AND last").drop("first_bar", "last").write.parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A report, a row per track, as one CSV file."""
    flat = summary.withColumn("errors", F.array_join("errors", "; ")) if "errors" in summary.columns else summary
    flat.coalesce(1).write.csv(path, header=True)


def write_version(rows: DataFrame, path: str) -> str:
    """Writes a new version beside the older ones, which stay as backups; current() finds it. Returns its path."""
    spark = rows.sparkSession
    versions = _versions(spark, path)
    target = f"{path}/version={(versions[-1] if versions else 0) + 1:06d}"
    rows.write.mode("errorifexists").parquet(target)
    return target


def current(spark: SparkSession, path: str) -> DataFrame:
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/version={versions[-1]:06d}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions, by the marker that a write leaves at its end."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    found = []
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("version=") and system.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name[8:]))
    return sorted(found)
