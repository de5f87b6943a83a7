"""Progress messages of a remote scan, one JSON object a line among noise; and text listings of a phone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TRACK = "path string, format string, title string, artist string, albumArtist string, album string, genre string, trackNo int, discNo int, year int, compilation boolean, hasSort boolean, legacyTag boolean, tagBytes bigint, hasLyrics boolean, seconds int"
MESSAGE = f"type string, track struct<{', '.join(x.replace(' ', ': ', 1) for x in TRACK.split(', '))}>, path string, error string, done int, total int"


def messages(lines: DataFrame) -> DataFrame:
    """(line) to the message's fields; lines that are no message are left out. Works on streams as on tables."""
    text = T.go_trim(F.col("line"))
    rows = lines.filter(F.startswith(text, F.lit("{"))).select(F.from_json(text, MESSAGE).alias("m")).filter("m.type is not null")
    return rows.select("m.*")


def tracks(parsed: DataFrame) -> DataFrame:
    return parsed.filter("type = 'track' and track is not null").select("track.*")


def failures(parsed: DataFrame) -> DataFrame:
    """(path, reason); an error that names no path ends the query."""
    whole = F.when(F.coalesce("path", F.lit("")) != "", F.col("path")).otherwise(F.raise_error(F.coalesce("error", F.lit("the scan failed"))))
    return parsed.filter("type = 'error'").select(whole.alias("path"), F.col("error").alias("reason"))


def progress(parsed: DataFrame) -> DataFrame:
    """One row: messages by type and the last total."""
    return parsed.agg(F.count_if(F.col("type") == "track").alias("tracks"), F.count_if(F.col("type") == "error").alias("failures"), F.max("done").alias("done"), F.max("total").alias("total"))


def devices(lines: DataFrame) -> DataFrame:
    """(serial, state, model) of a device listing; headers, notices of the daemon and blank lines are left out."""
    rows = lines.select(T.one_space(F.col("line")).alias("line")).filter("line <> '' and not startswith(line, '*') and not startswith(line, 'List of devices')")
    parts = F.split("line", " ", -1)
    model = F.replace(F.regexp_extract("line", r"model:(\S+)", 1), F.lit("_"), F.lit(" "))
    return rows.filter(F.size(parts) >= 2).select(parts[0].alias("serial"), parts[1].alias("state"), model.alias("model"))


def database_rows(lines: DataFrame) -> DataFrame:
    """(id, path) of a media database's listing."""
    pattern = T.rx(r"_id=(\d+), _data=(.+?)\s*$")
    rows = lines.select(F.regexp_extract("line", pattern, 1).alias("id"), F.regexp_extract("line", pattern, 2).alias("path"))
    return rows.filter("id <> ''").select(F.col("id").cast("bigint").alias("id"), "path")


def listed_paths(lines: DataFrame, kind: str = "media") -> DataFrame:
    """(path) of a listing of files: media or playlists by their ending, or folders; hidden names and blank lines are left out."""
    rows = lines.select(T.go_trim(F.col("line")).alias("path")).filter("path <> ''").filter(~F.regexp_extract("path", r"([^/]*)/?\z", 1).startswith("."))
    if kind == "folders":
        return rows.select(F.regexp_replace("path", r"/+\z", "").alias("path")).orderBy(F.lower("path"))
    return rows.filter(T.is_media_name(F.col("path")) if kind == "media" else T.is_playlist_name(F.col("path"))).orderBy(F.lower("path"))


def visible_counts(rows: DataFrame) -> DataFrame:
    """(path, n) with repeated paths: the largest count of each."""
    return rows.groupBy("path").agg(F.max("n").alias("n"))
