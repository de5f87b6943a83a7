"""Artists, albums and names that are no albums, from rows of track tags.

Input: tracks (path, artist, albumArtist, album, compilation and, for the counters, hasSort, legacyTag, tagBytes, hasLyrics); text is never
null there, '' means absent. Names are counted first, so that credits are parsed once for each distinct name and not for each track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W


def summary_counts(tracks: DataFrame) -> DataFrame:
    """One row of counters over the library."""
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return tracks.agg(
        F.count("*").alias("tracks"),
        count(F.col("albumArtist") != "").alias("album_artist"),
        count(F.col("compilation")).alias("compilation"),
        count(F.col("hasSort")).alias("sort"),
        count(F.col("legacyTag")).alias("legacy"),
        count(F.col("tagBytes") > W.TAG_LIMIT).alias("oversized"),
        count(F.col("hasLyrics")).alias("lyrics"),
    )


def occurrences(tracks: DataFrame, album_artists_only: bool = False) -> DataFrame:
    """(name, album, n): how often a name stands on tracks of an album. A track counts twice if its two names differ."""
    artist, album_artist = T.go_trim(F.col("artist")), T.go_trim(F.col("albumArtist"))
    names = F.array(album_artist) if album_artists_only else F.array_distinct(F.array(artist, album_artist))
    rows = tracks.select("album", F.explode(F.filter(names, lambda n: n != "")).alias("name"))
    return rows.groupBy("name", "album").agg(F.count("*").alias("n"))


def raw_names(tracks: DataFrame, album_artists_only: bool = False) -> DataFrame:
    """name, tracks and albums of each name as it is written."""
    return occurrences(tracks, album_artists_only).groupBy("name").agg(F.sum("n").alias("tracks"), F.count_if(F.col("album") != "").alias("albums"))


def credits(tracks: DataFrame) -> DataFrame:
    """name, tracks, key, lead, kind and guests of each distinct name."""
    named = raw_names(tracks).select("name", "tracks", T.lead_of(F.col("name")).alias("s"))
    return named.select("name", "tracks", T.spelling_key(F.col("s.lead")).alias("key"), "s.lead", "s.kind", "s.guests")


def best_spelling(counted: DataFrame, keys: list[str], value: str, uses: str, name: str) -> DataFrame:
    """For each group the most used value, then the better spelling, then the smaller one; uses of equal values add up."""
    summed = counted.groupBy(*keys, value).agg(F.sum(uses).alias("__n"))
    order = F.struct(-F.col("__n"), -T.spelling_quality(F.col(value)), F.col(value))
    return summed.groupBy(*keys).agg(F.min_by(value, order).alias(name))


def artist_reduce(tracks: DataFrame) -> DataFrame:
    """key, name, tracks, albums and sources of each artist that spellings and credits fold to."""
    named = credits(tracks)
    totals = named.groupBy("key").agg(F.sum("tracks").alias("tracks"), F.count("*").alias("sources"))
    albums = occurrences(tracks).filter("album <> ''").join(named.select("name", "key"), "name").groupBy("key").agg(F.count_distinct("album").alias("albums"))
    best = best_spelling(named, ["key"], "lead", "tracks", "name")
    return totals.join(best, "key").join(albums, "key", "left").select("key", "name", "tracks", F.coalesce("albums", F.lit(0)).alias("albums"), "sources")


def artist_sources(tracks: DataFrame) -> DataFrame:
    """key, target, value, tracks, kind and guests of each name in the files."""
    named = credits(tracks)
    targets = best_spelling(named, ["key"], "lead", "tracks", "target")
    exact = F.col("name") == F.col("target")
    kind = F.when(exact, "exact").when(F.col("kind") == "exact", "spelling").otherwise(F.col("kind"))
    guests = F.when(exact, F.array().cast(T.STRINGS)).otherwise(F.col("guests"))
    return named.join(targets, "key").select("key", "target", F.col("name").alias("value"), "tracks", kind.alias("kind"), guests.alias("guests"))


def credited(tracks: DataFrame) -> DataFrame:
    """Tracks with a trimmed album, the name it goes by (album artist, else artist) and its owner; a compilation's owner is null."""
    album_artist = T.go_trim(F.col("albumArtist"))
    name = F.when(album_artist != "", album_artist).otherwise(T.go_trim(F.col("artist")))
    rows = tracks.select("path", "compilation", T.go_trim(F.col("album")).alias("value"), name.alias("name")).filter("value <> ''")
    leads = rows.select("path", "compilation", "value", T.lead_of(F.col("name"))["lead"].alias("lead"))
    owner = F.when(~F.col("compilation"), T.spelling_key(F.col("lead")))
    return leads.select("path", "compilation", "value", F.when(F.col("compilation"), "Various artists").otherwise(F.col("lead")).alias("name"), owner.alias("owner"))


def album_parts(tracks: DataFrame) -> DataFrame:
    """owner, value, name, tracks and album_key, before absorption; keys are computed for distinct values only."""
    counted = credited(tracks).groupBy("owner", "value", "name").agg(F.count("*").alias("tracks"))
    keys = counted.select("value").distinct().select("value", T.album_key(F.col("value")).alias("album_key"))
    return counted.join(keys, "value")


def absorbed(parts: DataFrame) -> DataFrame:
    """Tracks of compilations go to the owner who has most tracks of an album of that key (then the smaller owner and value)."""
    sources = parts.filter("owner is not null").groupBy("owner", "value", "album_key").agg(F.sum("tracks").alias("n"))
    best = sources.groupBy("album_key").agg(F.min_by("owner", F.struct(-F.col("n"), F.col("owner"), F.col("value"))).alias("into"))
    return parts.join(best, "album_key", "left").withColumn("owner", F.coalesce("owner", "into"))


def albums(tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Albums (owner, album_key, name, artist, tracks, sources) and their sources (owner, album_key, album, value, tracks, kind)."""
    parts = absorbed(album_parts(tracks)).drop("into")
    sources = parts.groupBy("owner", "album_key", "value").agg(F.sum("tracks").alias("tracks"))
    shown = sources.withColumn("shown", T.strip_disc(F.col("value")))
    plain = T.strip_album(F.col("shown")) == F.col("shown")
    order = F.struct(-F.col("tracks"), ~plain, -T.spelling_quality(F.col("shown")), F.col("shown"))
    named = shown.groupBy("owner", "album_key").agg(F.min_by("shown", order).alias("name"), F.sum("tracks").alias("tracks"), F.count("*").alias("sources"))
    artists = best_spelling(parts, ["owner", "album_key"], "name", "tracks", "artist")

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        """Both, where owner (null too) and album_key agree."""
        other = right.withColumnsRenamed({"owner": "__owner", "album_key": "__key"})
        return left.join(other, (F.col("album_key") == F.col("__key")) & F.col("owner").eqNullSafe(F.col("__owner"))).drop("__owner", "__key")

    whole = beside(named, artists).select("owner", "album_key", "name", "artist", "tracks", "sources")
    listed = beside(sources, named.select("owner", "album_key", F.col("name").alias("album")))
    return whole, listed.select("owner", "album_key", "album", "value", "tracks", T.album_kind(F.col("value"), F.col("album")).alias("kind"))


def junk_albums(tracks: DataFrame) -> DataFrame:
    """value, reason, tracks, artists and first path of names that are a site's or are shared by several owners."""
    grouped = credited(tracks).groupBy("value").agg(
        F.count("*").alias("tracks"),
        (F.count_distinct("owner") + F.max(F.col("owner").isNull().cast("int"))).alias("artists"),
        F.bool_or("compilation").alias("compilation"),
        F.min("path").alias("first_path"),
    )
    reason = F.when(T.is_junk_name(F.col("value")), "site").when((F.col("artists") >= W.SHARED_ARTISTS) & ~F.col("compilation"), "shared")
    return grouped.select("value", reason.alias("reason"), "tracks", "artists", "first_path").filter("reason is not null")


def names_in_order(names: DataFrame, limit: int | None = None) -> DataFrame:
    """Busiest first, then alphabetically."""
    ordered = names.orderBy(F.col("tracks").desc(), F.lower("name"), "name")
    return ordered.limit(limit) if limit else ordered


def albums_in_order(albums: DataFrame, limit: int | None = None) -> DataFrame:
    """Busiest first, then by name, then by owner; compilations of no owner first among equals."""
    ordered = albums.orderBy(F.col("tracks").desc(), F.lower("name"), "owner")
    return ordered.limit(limit) if limit else ordered


def junk_in_order(junk: DataFrame, limit: int | None = None) -> DataFrame:
    """Busiest first; equal ones as they come in the library, which is by their first path."""
    ordered = junk.orderBy(F.col("tracks").desc(), "first_path")
    return ordered.limit(limit) if limit else ordered


def selected(tracks: DataFrame, names: DataFrame | None = None, only_missing: bool = True) -> DataFrame:
    """Tracks to look words up for: without lyrics, searchable, and by one of `names` (name), if given."""
    from .matching import attempts

    rows = tracks.filter(~F.col("hasLyrics")) if only_missing else tracks
    rows = rows.join(attempts(rows).select("path").distinct(), "path", "left_semi")
    if names is None:
        return rows
    wanted = names.select(F.col("name")).distinct()
    by = rows.select("path", F.explode(F.array_distinct(F.array(T.go_trim(F.col("artist")), T.go_trim(F.col("albumArtist"))))).alias("name"))
    return rows.join(by.join(wanted, "name", "left_semi").select("path"), "path", "left_semi")


def survivors(failures: DataFrame, deleted: DataFrame) -> DataFrame:
    """Failures that remain after files were deleted."""
    return failures.join(deleted.select("path"), "path", "left_anti")


def deletable(requested: DataFrame, failures: DataFrame) -> DataFrame:
    """Only files that the last scan reported can be deleted."""
    return requested.join(failures.select("path"), "path", "left_semi")


def display_title(title: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(T.go_trim(title), F.lit("")), T.name_from_file(path)["title"])
