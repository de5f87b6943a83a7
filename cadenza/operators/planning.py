"""Change plans: what rules and edits by hand make of each track, as differences between before and after.

Rules are small tables: rename (name, keep), album_rename and album_artist_set (path, value), clear_album and clear_compilation (path),
manual (path, fields that are null where nothing is said, flags). '' clears a text, 0 a number. The engine chooses how to join them; a rule
table that it finds to be small is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W

TEXTS = (("artist", "Artist"), ("albumArtist", "Album artist"), ("album", "Album"), ("title", "Title"), ("genre", "Genre"))
NUMBERS = (("year", "Year"), ("trackNo", "Track number"), ("discNo", "Disc number"))
FLAGS = ("removeCompilation", "removeAlbumArtistSort", "removeLegacyTag", "shrinkArtwork")
MANUAL = "path string, artist string, albumArtist string, album string, title string, genre string, lyrics string, year int, trackNo int, discNo int, removeCompilation boolean, removeAlbumArtistSort boolean, removeLegacyTag boolean, shrinkArtwork boolean"


@dataclass
class Rules:
    rename: DataFrame | None = None
    album_rename: DataFrame | None = None
    album_artist_set: DataFrame | None = None
    clear_album: DataFrame | None = None
    clear_compilation: DataFrame | None = None
    manual: DataFrame | None = None
    album_artist_mode: str = "keep"
    remove_compilation: bool = False
    remove_sort: bool = False
    remove_legacy: bool = False
    shrink_artwork: bool = False
    backup: bool = False


def looked_up(rows: DataFrame, table: DataFrame | None, key: Column, value: str, name: str) -> DataFrame:
    """rows with the table's value for a key, null where it has none."""
    if table is None:
        return rows.withColumn(name, F.lit(None).cast("string"))
    one = table.groupBy(F.col(table.columns[0]).alias(f"__{name}")).agg(F.max(value).alias(name))
    return rows.join(one, key == F.col(f"__{name}"), "left").drop(f"__{name}")


def wanted(tracks: DataFrame, rules: Rules) -> DataFrame:
    """Tracks with a struct `want` of what the fields should be, and flags of the manual edit."""
    rows = looked_up(tracks, rules.rename, T.go_trim(F.col("artist")), "keep", "r_artist")
    rows = looked_up(rows, rules.rename, T.go_trim(F.col("albumArtist")), "keep", "r_album_artist")
    rows = looked_up(rows, rules.album_rename, F.col("path"), "value", "r_album")
    rows = looked_up(rows, rules.album_artist_set, F.col("path"), "value", "r_shared")
    for table, name in ((rules.clear_album, "r_clear"), (rules.clear_compilation, "r_stray")):
        rows = looked_up(rows, table.select("path", F.lit("y").alias("value")) if table is not None else None, F.col("path"), "value", name)
    if rules.manual is None:
        rows = rows.withColumn("m", F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ':', 1) for x in MANUAL.split(', '))}>"))
    else:
        rows = rows.join(rules.manual.select(F.col("path").alias("__path"), F.struct(*rules.manual.columns).alias("m")), F.col("path") == F.col("__path"), "left").drop("__path")
    named = lambda field, found: F.coalesce(T.go_trim(F.col(found)), T.go_trim(F.col(field)))
    artist = F.when(T.go_trim(F.col("artist")) == "", "").otherwise(named("artist", "r_artist"))
    album_artist = F.when(T.go_trim(F.col("albumArtist")) == "", "").otherwise(named("albumArtist", "r_album_artist"))
    renamed = F.nullif(T.go_trim(F.col("r_album")), F.lit(""))
    moved = F.coalesce(renamed != F.col("album"), F.lit(False))
    disc = F.when(moved & (F.col("discNo") == 0) & (T.disc_of(renamed) == 0), T.disc_of(F.col("album"))).otherwise(F.col("discNo"))
    album = F.when(F.col("r_clear").isNotNull(), "").otherwise(F.coalesce(renamed, F.col("album")))
    if rules.album_artist_mode == "clear":
        album_artist = F.lit("")
    elif rules.album_artist_mode == "fromArtist":
        album_artist = artist
    if rules.album_artist_mode != "clear":
        album_artist = F.coalesce(T.go_trim(F.col("r_shared")), album_artist)
    by_rule = {"artist": artist, "albumArtist": album_artist, "album": album, "title": F.col("title"), "genre": F.col("genre"), "year": F.col("year"), "trackNo": F.col("trackNo"), "discNo": disc}
    want = [F.coalesce(T.go_trim(F.col(f"m.{f}")), by_rule[f]).alias(f) for f, _ in TEXTS] + [F.coalesce(F.col(f"m.{f}"), by_rule[f]).alias(f) for f, _ in NUMBERS]
    return rows.withColumn("want", F.struct(*want))


def build(tracks: DataFrame, rules: Rules) -> DataFrame:
    """path, fields (array of name, before, after, in a fixed order) and edit (null where a field stays) of each track that changes."""
    rows = wanted(tracks, rules)
    flag = lambda on, name: F.coalesce(F.lit(on) | F.col(f"m.{name}"), F.lit(on))
    drop = {
        "removeCompilation": (flag(rules.remove_compilation, "removeCompilation") | F.col("r_stray").isNotNull()) & F.col("compilation"),
        "removeAlbumArtistSort": flag(rules.remove_sort, "removeAlbumArtistSort") & F.col("hasSort"),
        "removeLegacyTag": flag(rules.remove_legacy, "removeLegacyTag") & F.col("legacyTag"),
        "shrinkArtwork": flag(rules.shrink_artwork, "shrinkArtwork") & (F.col("tagBytes") > W.TAG_LIMIT),
    }
    field = lambda changed, name, before, after: F.when(changed, F.struct(F.lit(name).alias("name"), before.cast("string").alias("before"), after.cast("string").alias("after")))
    changed = {f: F.col(f"want.{f}") != F.col(f) for f, _ in (*TEXTS, *NUMBERS)}
    words = F.coalesce(F.col("m.lyrics") != F.col("lyrics"), F.lit(False))
    fields = [field(changed[f], label, F.col(f), F.col(f"want.{f}")) for f, label in TEXTS]
    fields += [field(changed[f], label, T.format_number(F.col(f)), T.format_number(F.col(f"want.{f}"))) for f, label in NUMBERS]
    fields.append(field(words, "Lyrics", T.summarise(F.col("lyrics")), T.summarise(F.col("m.lyrics"))))
    labels = (("removeCompilation", "Compilation flag", F.lit("yes"), F.lit("")), ("removeAlbumArtistSort", "Album artist sort", F.lit("set"), F.lit("")), ("removeLegacyTag", "Old tag at the end of the file", F.lit("set"), F.lit("")), ("shrinkArtwork", "Artwork", F.concat(T.megabytes(F.col("tagBytes")), F.lit(" of tags")), F.lit("shrunk to fit a player")))
    fields += [field(drop[f], label, before, after) for f, label, before, after in labels]
    edit = [F.when(changed[f], F.col(f"want.{f}")).alias(f) for f, _ in (*TEXTS, *NUMBERS)]
    edit += [F.when(words, F.col("m.lyrics")).alias("lyrics"), *(drop[f].alias(f) for f in FLAGS), F.lit(rules.backup).alias("backup")]
    out = rows.select("path", F.filter(F.array(*fields), lambda x: x.isNotNull()).alias("fields"), F.struct(*edit).alias("edit"))
    return out.filter(F.size("fields") > 0)


def plan_fields(changes: DataFrame) -> DataFrame:
    """One row for each changed field: path, pos, name, before, after."""
    return changes.select("path", F.posexplode("fields").alias("pos", "f")).select("path", "pos", "f.name", "f.before", "f.after")


def plan_summary(changes: DataFrame) -> DataFrame:
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    said = lambda f: F.col(f"edit.{f}").isNotNull()
    return changes.agg(
        F.count("*").alias("files"),
        count(said("artist")).alias("artist_renamed"),
        count(F.col("edit.albumArtist") != "").alias("album_artist_set"),
        count(F.col("edit.albumArtist") == "").alias("album_artist_cleared"),
        count(F.col("edit.removeCompilation")).alias("compilation_removed"),
        count(said("genre")).alias("genre_set"),
        count(said("album")).alias("album_renamed"),
    )


def preview(changes: DataFrame, rows: int = W.PREVIEW_ROWS) -> DataFrame:
    return changes.orderBy("path").limit(rows)


def plan_json(changes: DataFrame) -> DataFrame:
    """path and the edit as JSON: what isn't said and flags that aren't set are absent, '' survives."""
    kept = F.col("edit")
    for f in (*FLAGS, "backup"):
        kept = kept.withField(f, F.nullif(F.col(f"edit.{f}"), F.lit(False)))
    return changes.select("path", F.to_json(kept).alias("edit"))


def applied(tracks: DataFrame, changes: DataFrame) -> DataFrame:
    """The library as it is after the plan was written."""
    said = changes.select(F.col("path").alias("__path"), "edit")
    rows = tracks.join(said, tracks.path == F.col("__path"), "left")
    new = {f: F.coalesce(F.col(f"edit.{f}"), F.col(f)) for f in (*(x for x, _ in (*TEXTS, *NUMBERS)), "lyrics")}
    gone = lambda f: F.coalesce(F.col(f"edit.{f}"), F.lit(False))
    new |= {"compilation": F.col("compilation") & ~gone("removeCompilation"), "hasSort": F.col("hasSort") & ~gone("removeAlbumArtistSort"), "legacyTag": F.col("legacyTag") & ~gone("removeLegacyTag")}
    return rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in tracks.columns))


def merge_patches(patches: DataFrame, merge_all_flags: bool = False) -> DataFrame:
    """Edits by hand (edit_no, path, fields, flags) to one for each path: the latest that says something about a field counts.

    Only two flags are merged, as the program that these edits come from does it; the others are on request.
    """
    latest = lambda f: F.max_by(f, F.when(F.col(f).isNotNull(), F.col("edit_no"))).alias(f)
    merged = FLAGS if merge_all_flags else FLAGS[:2]
    fields = [latest(f) for f in ("artist", "albumArtist", "album", "title", "genre", "lyrics", "year", "trackNo", "discNo")]
    flags = [(F.coalesce(F.bool_or(f), F.lit(False)) if f in merged else F.lit(False)).alias(f) for f in FLAGS]
    return patches.groupBy("path").agg(*fields, *flags)


def results_summary(outcomes: DataFrame, written: DataFrame) -> DataFrame:
    """Counts by status of (path, status), where a found one whose write failed (path, error) counts as failed."""
    failed = written.filter("error <> ''").select("path", F.lit(True).alias("failed")).distinct()
    status = F.when((F.col("status") == "found") & F.coalesce("failed", F.lit(False)), "failed").otherwise(F.col("status"))
    return outcomes.join(failed, "path", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
