"""Delimited track lists (S1-S9): delimiter fallback, projection, cleaning, preview.

The file is read by Spark's CSV source with an explicit all-string schema
(no inference pass) and RFC-4180 quoting (``""`` inside quotes). Quoted titles
may hold line breaks, so those are read by default; a file then goes to one
task. ``multi_line=False`` lets Spark split large files that are known to hold
none. With ``strict=False`` malformed rows (too many or too few fields) do not
stop the load; ``read_rejects`` returns them as they stand in the file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import remove_prefix, strip_ws
from tessera.operators.prepare import ROW_ID
from tessera.session import cut_lineage
from tessera.spec import (
    ARTIST,
    PREVIEW_MAX_ROWS,
    SRC_ARTIST_NAME,
    SRC_TRACK_NAME,
    SRC_TRACK_URI,
    TITLE,
    TRACK_ID,
    TRACK_URI_PREFIX,
)

REQUIRED = (SRC_TRACK_NAME, SRC_ARTIST_NAME, SRC_TRACK_URI)
DELIMITERS = (",", ";")
#: Column that holds a malformed row's text while reading.
REJECTED = "_rejected"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the path (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def header_columns(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Columns of the header line under a delimiter (reads only the first line)."""
    return list(spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path).columns)


def choose_delimiter(spark: SparkSession, path: str, required=REQUIRED) -> tuple[str, list[str]]:
    """The first delimiter whose header holds every required column.

    S2: when none does, the error names the columns missing under the
    delimiter that came closest.
    """
    best: tuple[int, str, list[str]] | None = None
    for sep in DELIMITERS:
        cols = header_columns(spark, path, sep)
        if all(c in cols for c in required):
            return sep, cols
        hits = sum(c in cols for c in required)
        if best is None or hits > best[0]:
            best = (hits, sep, cols)
    cols = best[2] if best else []
    missing = [c for c in required if c not in cols]
    raise ValueError(f"CSV is missing required column(s): {', '.join(missing)}.")


def read_delimited(
    spark: SparkSession,
    path: str,
    *,
    multi_line: bool = True,
    strict: bool = True,
) -> DataFrame:
    """Raw all-string frame of a delimited export (S1/S2); malformed rows raise or are left to ``read_rejects``."""
    raw = _reader(spark, path, multi_line, strict)
    return raw if strict else raw.where(F.col(REJECTED).isNull()).drop(REJECTED)


def read_rejects(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """The malformed rows of a delimited export as text: one column, ``rejected``."""
    raw = _reader(spark, path, multi_line, False)
    return cut_lineage(raw.where(F.col(REJECTED).isNotNull())).select(F.col(REJECTED).alias("rejected"))


def _reader(spark: SparkSession, path: str, multi_line: bool, strict: bool) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"track list not found: {path}")
    sep, cols = choose_delimiter(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in (cols if strict else [*cols, REJECTED])])
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .option("columnNameOfCorruptRecord", REJECTED)
        .option("columnPruning", strict)  # a row is judged by all its fields
        .option("enforceSchema", not strict)
    )
    return reader.csv(path)


def clean_tracks(raw: DataFrame) -> DataFrame:
    """Project + rename, strip whitespace, drop the URI prefix, keep rows with an id."""
    t = raw.select(
        strip_ws(F.col(f"`{SRC_TRACK_NAME}`")).alias(TITLE),
        strip_ws(F.col(f"`{SRC_ARTIST_NAME}`")).alias(ARTIST),
        remove_prefix(strip_ws(F.col(f"`{SRC_TRACK_URI}`")), TRACK_URI_PREFIX).alias(TRACK_ID),
    )
    return t.where(F.col(TRACK_ID).isNotNull() & (F.col(TRACK_ID) != ""))


@dataclass
class TrackLibrary:
    """A loaded track list; ``tracks`` carries a materialised ``row_id`` in file order."""

    path: str
    tracks: DataFrame
    n_rows: int | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str, *, multi_line: bool = True, strict: bool = True) -> "TrackLibrary":
        t = clean_tracks(read_delimited(spark, path, multi_line=multi_line, strict=strict))
        # ids follow file order (partition index, then position) and are materialised once
        t = cut_lineage(t.withColumn(ROW_ID, F.monotonically_increasing_id()).select(ROW_ID, TRACK_ID, TITLE, ARTIST))
        n = t.count()
        if not n:  # S7
            raise ValueError(f"No tracks with a track id found in {path}.")
        return cls(path, t, n)

    @property
    def dataframe(self) -> DataFrame:
        return self.tracks.select(TITLE, ARTIST, TRACK_ID)

    def count(self) -> int:
        """Rows of the list; counted once, at loading."""
        if self.n_rows is None:
            self.n_rows = self.tracks.count()
        return self.n_rows

    def __len__(self) -> int:
        return self.count()

    def __repr__(self) -> str:
        return f"TrackLibrary({self.count()} tracks from {self.path!r})"

    def preview(self, max_rows: int | None = PREVIEW_MAX_ROWS) -> DataFrame:
        return preview(self.tracks, max_rows)

    def extract_features(self, resolver, mode: str = "precomputed"):
        """resolve features through a registered resolver."""
        from tessera.operators.resolve import extract

        return extract(self.tracks, resolver, mode)


def preview(df: DataFrame, max_rows: int | None = PREVIEW_MAX_ROWS, order_col: str = ROW_ID) -> DataFrame:
    """All rows when short or when ``max_rows`` is None; else the first and last ``max_rows // 2`` rows, with a
    ``part`` column ('head' / 'tail'). Two bounded top-k reads, never a full sort."""
    if max_rows is None or df.count() <= max_rows:
        return df.withColumn("part", F.lit("all"))
    half = max(1, max_rows // 2)
    head = df.orderBy(F.col(order_col).asc()).limit(half).withColumn("part", F.lit("head"))
    tail = df.orderBy(F.col(order_col).desc()).limit(half).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)
