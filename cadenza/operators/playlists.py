"""Playlists: reading lines and files, finding the files that entries mean, writing.

entries: (playlist_id, pos, location, title, artist, duration; -1 unknown). files: (rel, ord), paths under a root, in listing order.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrow as A
from ..functions import text as T
from ..functions import words as W


def text_lines(text: Column) -> Column:
    """The lines that aren't blank, whatever ends them."""
    lines = F.split(F.regexp_replace(text, "^﻿", ""), r"\r\n|\r|\n", -1)
    return F.filter(lines, lambda x: T.go_trim(x) != "")


def titled(text: Column) -> tuple[Column, Column]:
    """Artist and title of "Artist - Title", cut at the first dash between spaces."""
    text = T.go_trim(text)
    before, after = T.cut_at(text, " - ")
    return F.coalesce(before, F.lit("")), F.coalesce(after, text)


def known_length(c: Column) -> Column:
    n = T.leading_number(c)
    return F.when(n > 0, n).otherwise(-1)


def m3u_entries(lines: DataFrame) -> DataFrame:
    """Entries of lines (playlist_id, pos, line): an #EXTINF line tells about the next path, other # lines nothing."""
    path = ~F.startswith("line", F.lit("#"))
    info = F.startswith(F.upper("line"), F.lit("#EXTINF:"))
    before = Window.partitionBy("playlist_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    grouped = lines.withColumn("no", F.coalesce(F.sum(path.cast("int")).over(before), F.lit(0)))
    entries = grouped.groupBy("playlist_id", "no").agg(
        F.max_by("line", F.when(path, F.col("pos"))).alias("location"),
        F.max_by(F.substring("line", F.lit(9), F.length("line")), F.when(info, F.col("pos"))).alias("info"),
    )
    entries = entries.filter("location is not null and not startswith(location, '#')")
    length, name = T.cut_at(F.col("info"), ",")
    artist, title = titled(name)
    return entries.select("playlist_id", F.col("no").cast("int").alias("pos"), "location", F.coalesce(title, F.lit("")).alias("title"), F.coalesce(artist, F.lit("")).alias("artist"), F.coalesce(known_length(F.coalesce(length, F.col("info"))), F.lit(-1)).alias("duration"))


def pls_entries(lines: DataFrame) -> DataFrame:
    """Entries of a .pls by number; of repeated keys the last line counts, numbers without a file are dropped."""
    part = lambda i: F.regexp_extract("line", T.rx(W.PLS_LINE), i)
    rows = lines.select("playlist_id", "pos", F.lower(part(1)).alias("kind"), part(2).try_cast("int").alias("no"), part(3).alias("value")).filter("kind <> '' and no is not null")
    value = lambda k, c=F.lit(True): F.max_by("value", F.when((F.col("kind") == k) & c, F.col("pos")))
    grouped = rows.groupBy("playlist_id", "no").agg(value("file").alias("location"), value("title").alias("name"), value("length", T.leading_number(F.col("value")) > 0).alias("length")).filter("location is not null")
    artist, title = titled(F.col("name"))
    return grouped.select("playlist_id", F.col("no").alias("pos"), "location", F.coalesce(title, F.lit("")).alias("title"), F.coalesce(artist, F.lit("")).alias("artist"), F.coalesce(known_length(F.col("length")), F.lit(-1)).alias("duration"))


def itunes_text_entries(lines: DataFrame) -> DataFrame:
    """Entries of the tab-separated export: name first, artist second, location last; the length stands under a title that says time."""
    cols = F.split("line", "\t", -1)
    first = Window.partitionBy("playlist_id").orderBy("pos")
    rows = lines.select("playlist_id", "pos", cols.alias("cols"), F.first(cols).over(first).alias("head"), F.row_number().over(first).alias("no")).filter("no > 1 and size(head) >= 6 and size(cols) >= 2")
    times = F.transform("head", lambda h: T.go_trim(h).isin(W.TIME_HEADERS))
    at = F.size("head") - F.array_position(F.reverse(times), True).cast("int")
    length = F.when(F.array_contains(times, True), F.get(F.col("cols"), at))
    out = rows.select("playlist_id", (F.col("no") - 2).alias("pos"), F.element_at("cols", -1).alias("location"), F.get("cols", F.lit(0)).alias("title"), F.get("cols", F.lit(1)).alias("artist"), F.coalesce(known_length(length), F.lit(-1)).alias("duration"))
    return out.filter("location <> ''")


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Playlists (playlist_id, name, format, folder) and their entries of files (path, content), by extension."""
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    rows = files.select("path", "content", T.extension(F.col("path")).alias("ext"), F.regexp_replace(name, r"\.[^.]*\z", "").alias("name"), F.regexp_replace("path", r"/[^/]*\z", "").alias("folder")).filter(F.col("ext").isin(W.PLAYLIST_EXTENSIONS))
    texts = rows.filter(F.col("ext").isin(".m3u", ".m3u8", ".pls", ".txt"))
    lines = texts.select(F.col("path").alias("playlist_id"), "ext", F.posexplode(text_lines(A.decode_text(F.col("content")))).alias("pos", "line"))
    of = lambda *ext: lines.filter(F.col("ext").isin(*ext)).drop("ext")
    listed = m3u_entries(of(".m3u", ".m3u8")).unionByName(pls_entries(of(".pls"))).unionByName(itunes_text_entries(of(".txt")))
    nested = rows.filter(F.col("ext").isin(".xspf", ".wpl", ".zpl")).select(F.col("path").alias("playlist_id"), F.posexplode(F.when(F.col("ext") == ".xspf", A.read_xspf("content")).otherwise(A.read_wpl("content"))).alias("pos", "e"))
    library = rows.filter("ext = '.xml'").select("path", "folder", F.posexplode(A.read_itunes_xml("content")).alias("no", "p"))
    identified = library.select(F.concat("path", F.lit("#"), F.col("no").cast("string")).alias("playlist_id"), "folder", "p")
    more = identified.select("playlist_id", F.posexplode("p.entries").alias("pos", "e"))
    entries = listed.unionByName(nested.unionByName(more).select("playlist_id", "pos", "e.*"))
    format_ = F.when(F.col("ext") == ".txt", "iTunes").otherwise(F.upper(F.substring("ext", F.lit(2), F.length("ext"))))
    playlists = rows.filter("ext <> '.xml'").select(F.col("path").alias("playlist_id"), "name", format_.alias("format"), "folder")
    return playlists.unionByName(identified.select("playlist_id", F.col("p.name").alias("name"), F.lit("iTunes XML").alias("format"), "folder")), entries


# Paths ------------------------------------------------------------------------


def path_key(c: Column) -> Column:
    """How paths are compared: composed and in lower case. To be selected as a column before it is used."""
    return F.lower(A.nfc_once(c))


def is_windows_path(c: Column) -> Column:
    return c.rlike(r"^\\\\") | c.rlike(r"^[A-Za-z]:[\\/]")


def path_from_location(c: Column) -> Column:
    """A file URL as a path; anything else is one already."""
    bare = F.regexp_replace(F.regexp_replace(F.substring(c, F.lit(6), F.length(c)), r"^//localhost/", "/"), r"^//", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)
    return F.when(c.rlike(r"^(?i)file:"), F.regexp_replace(decoded, r"^/(?=[A-Za-z]:[\\/].)", "")).otherwise(c)


def clean_path(c: Column) -> Column:
    """An absolute path without empty, `.` and `..` parts; a drive letter stays."""
    drive = F.regexp_extract(c, r"^[^/]:", 0)
    parts = F.split(F.substring(c, F.length(drive) + 1, F.length(c)), "/", -1)
    kept = F.aggregate(parts, F.array().cast(T.STRINGS), lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p)))
    return F.concat(drive, F.lit("/"), F.array_join(kept, "/"))


def components(c: Column) -> Column:
    """Names of a path, at slashes of either kind, or at colons if it has none."""
    parts = F.when(c.rlike(r"[/\\]"), F.split(c, r"[/\\]", -1)).otherwise(F.split(c, ":", -1))
    return F.filter(parts, lambda p: ~p.isin("", ".", ".."))


def tails(parts: Column) -> Column:
    """array<struct<n, tail>>: the last 1, 2, 3 ... parts."""
    some = F.when(F.size(parts) > 0, parts)
    return T.let(some, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.struct(k.alias("n"), F.array_join(F.slice(p, F.size(p) - k + 1, k), "/").alias("tail"))))


def file_index(files: DataFrame) -> DataFrame:
    """(key, rel, ord): of files whose keys agree the first."""
    return files.select(path_key(F.col("rel")).alias("key"), "rel", "ord").groupBy("key").agg(F.min_by("rel", "ord").alias("rel"), F.min("ord").alias("ord"))


ALIASES = ("/sdcard/", "/mnt/sdcard/", "/storage/self/primary/")


def literal_paths(path: Column, folder: Column) -> Column:
    """The absolute paths that a location may mean literally, best first; a Windows path means none here."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    aliased = [F.when(F.startswith(slashed, F.lit(a)), clean_path(F.concat(F.lit("/storage/emulated/0/"), F.substring(slashed, F.lit(len(a) + 1), F.length(slashed))))) for a in ALIASES]
    absolute = F.when(F.startswith(slashed, F.lit("/")), clean_path(slashed))
    relative = F.when(~F.startswith(slashed, F.lit("/")) & (folder != ""), clean_path(F.concat(folder, F.lit("/"), slashed)))
    return F.when(is_windows_path(path), F.array().cast(T.STRINGS)).otherwise(F.filter(F.array(absolute, *aliased, relative), lambda p: p.isNotNull()))


def resolve(entries: DataFrame, files: DataFrame, root: str, folder: str = "") -> DataFrame:
    """entries with `file`, the absolute path of the file that each means, null if none is found.

    A file whose whole path is meant literally goes first; otherwise the longest tail of the entry's path that is known counts, if it is
    one file's or has several parts (then the first file's). A location is tried as it is, then trimmed. Both sides meet by equal
    keys; the index is reduced to one row a key and a tail before it is joined. Both sides are sorted: their sizes are estimated by those
    of compressed files, so that either could be sent whole to the driver. What an entry may mean is dealt by entry before it is reduced:
    a task that joins tails has few of an entry, and would sort them once more for nothing.
    """
    base = "" if root == "/" else root.rstrip("/")
    index = file_index(files)
    said, trimmed = F.struct(F.lit(0).alias("try"), F.col("location").alias("l")), F.struct(F.lit(1).alias("try"), T.go_trim(F.col("location")).alias("l"))
    tries = entries.select("playlist_id", "pos", F.explode(F.when(said["l"] == trimmed["l"], F.array(said)).otherwise(F.array(said, trimmed))).alias("t"))
    paths = tries.select("playlist_id", "pos", "t.try", path_from_location(F.col("t.l")).alias("p")).filter("p <> ''")
    exact = paths.select("playlist_id", "pos", "try", F.posexplode(literal_paths(F.col("p"), F.lit(folder))).alias("no", "full"))
    prefix = base.lower() + "/"
    exact = exact.select("playlist_id", "pos", "try", "no", path_key(F.col("full")).alias("full")).filter(F.startswith("full", F.lit(prefix)))
    exact = exact.select("playlist_id", "pos", "try", F.col("no").alias("rank"), F.substring("full", F.lit(len(prefix) + 1), F.length("full")).alias("key")).join(index.hint("merge"), "key").select("playlist_id", "pos", "try", F.lit(0).alias("step"), "rank", "rel")
    known = index.select("rel", "ord", F.explode(tails(F.split("key", "/", -1))).alias("t")).groupBy("t.tail").agg(F.min_by("rel", "ord").alias("rel"), F.count("*").alias("files"))
    wanted = paths.select("playlist_id", "pos", "try", path_key(F.col("p")).alias("k")).select("playlist_id", "pos", "try", F.explode(tails(components(F.col("k")))).alias("t")).select("playlist_id", "pos", "try", "t.n", "t.tail")
    near = wanted.join(known.hint("merge"), "tail").filter("files = 1 or n > 1").select("playlist_id", "pos", "try", F.lit(1).alias("step"), (-F.col("n")).alias("rank"), "rel")
    found = exact.unionByName(near).repartition("playlist_id", "pos").groupBy("playlist_id", "pos").agg(F.min_by("rel", F.struct("try", "step", "rank")).alias("rel"))
    return entries.join(found.hint("merge"), ["playlist_id", "pos"], "left").withColumn("file", F.concat(F.lit(base + "/"), "rel")).drop("rel")


def found_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("playlist_id").agg(F.count_if(F.col("file").isNotNull()).alias("found"), F.count_if(F.col("file").isNull()).alias("missing"))


def missing(resolved: DataFrame) -> DataFrame:
    return resolved.filter("file is null").drop("file")


def playlist_ids(files: DataFrame, database: DataFrame) -> DataFrame:
    """files (path) with the id that the database (id, path) has them under; /sdcard and /storage/emulated/0 are one place."""
    place = lambda c: F.regexp_replace(c, "^/storage/emulated/0/", "/sdcard/")
    ids = database.select(place(F.col("path")).alias("key"), "id").groupBy("key").agg(F.max("id").alias("id"))
    return files.withColumn("key", place(F.col("path"))).join(ids, "key", "left").drop("key")


# Writing ----------------------------------------------------------------------


def relative(file: Column, folder: Column | str) -> Column:
    """The path of a file as seen from a folder, both absolute; a folder that is given as text is composed here, not for each row."""
    names = lambda c: F.filter(F.split(c, "/", -1), lambda p: p != "")

    def steps(x: Column) -> Column:
        target, base = x["t"], x["b"]
        shared = F.least(F.size(target) - 1, F.size(base))
        alike = F.transform(F.sequence(F.lit(0), F.greatest(shared - 1, F.lit(0))), lambda i: (shared > 0) & (F.lower(F.get(target, i)) == F.lower(F.get(base, i))))
        stop = F.array_position(alike, False).cast("int")
        common = F.when(stop > 0, stop - 1).otherwise(shared)
        return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(base) - common), F.slice(target, common + 1, F.greatest(F.size(target), F.lit(1)))), "/")

    base = F.lit(unicodedata.normalize("NFC", folder)) if isinstance(folder, str) else A.nfc(folder)
    return T.let(F.struct(names(A.nfc(file)).alias("t"), names(base).alias("b")), steps)


def one_line(c: Column) -> Column:
    return F.translate(c, "\t\r\n", "   ")


def xml_escape(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def url_part(c: Column) -> Column:
    """One part of a path, percent-encoded as URLs of files are."""
    c = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%26", "&"), ("%3D", "="), ("%3A", ":"), ("%40", "@"), ("%24", "$"), ("%2B", "+"), ("%7E", "~")):
        c = F.replace(c, F.lit(code), F.lit(char))
    return F.replace(c, F.lit("*"), F.lit("%2A"))


def uri_path(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "/", -1), url_part), "/")


def file_url(c: Column, windows: bool = False) -> Column:
    parts = F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/", -1)
    coded = F.transform(parts, lambda p, i: F.when((F.lit(windows)) & (i == 0) & p.rlike(r"^.:\z"), p).otherwise(url_part(p)))
    joined = F.array_join(coded, "/")
    return F.concat(F.lit("file://localhost/"), F.regexp_replace(joined, "^/", "")) if windows else F.concat(F.lit("file://"), joined)


def safe_name(c: Column) -> Column:
    safe = T.go_trim(F.regexp_replace(F.regexp_replace(c, r'[/\\:*?"<>|\x00-\x1F]', "-"), r"[. ]+\z", ""))
    return F.when(safe == "", "Playlist").otherwise(safe)


def shown_title(title: Column, file: Column) -> Column:
    base = F.regexp_replace(F.regexp_extract(file, r"([^/]*)\z", 1), r"\.[^./]*\z", "")
    return one_line(F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(base))


TARGETS = {"android": "m3u", "itunes": "xml", "m3u8": "m3u8", "wpl": "wpl", "xspf": "xspf", "pls": "pls"}


#: What of an entry is sorted for a target, if it isn't everything but the URL. Entries of one place stand in the order of all of it, for any target alike.
SAID = {"android": ["path"], "wpl": ["path"], "itunes": ["path", "title", "artist", "seconds", "url"]}


#: Lines of a playlist that are put together at a time.
CHUNK = 1000


def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(playlist_id, name, lines, n) of ordered (playlist_id, named, name, line), where a list's names stand before its entries; one list is held at a time."""
    at, names, texts, pending, n, kind = None, [], [], [], 0, None

    def ended() -> Iterator[pa.RecordBatch]:
        lines = "".join([*texts, *pending]) if n else ""
        for name in names if n else ():
            yield pa.RecordBatch.from_arrays([pa.array([at], kind), pa.array([name], pa.string()), pa.array([lines], pa.string()), pa.array([n], pa.int32())], names=["playlist_id", "name", "lines", "n"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for which, named, name, line in zip(*(c.to_pylist() for c in batch.columns)):
            if which != at:
                yield from ended()
                at, names, texts, pending, n = which, [], [], [], 0
            if named:
                names.append(name)
            elif names:
                n += 1
                pending.append(str(n).join(line))
                if len(pending) == CHUNK:
                    texts.append("".join(pending))
                    pending = []
    yield from ended()


def write(resolved: DataFrame, names: DataFrame, target: str, folder: str, windows: bool = False) -> DataFrame:
    """playlist_id, file_name and content of each playlist (names: playlist_id, name) with a found entry, for one of TARGETS.

    Names stand before the entries of their list, and one sort that spills brings both in order; entries become text after it, one by one,
    and a task puts together one list at a time. A file's text is one row, so a playlist is bounded by what a player can read.
    """
    seconds = F.when(F.col("duration") > 0, F.col("duration")).otherwise(-1)
    told = {"path": relative(F.col("file"), folder), "title": shown_title(F.col("title"), F.col("file")), "artist": one_line(F.coalesce("artist", F.lit(""))), "seconds": seconds, "url": file_url(F.col("file"), windows)}
    said = SAID.get(target, [x for x in told if x != "url"])
    rows = resolved.filter("file is not null").select("playlist_id", F.lit(False).alias("named"), "pos", *(told[x].alias(x) for x in said))
    rows = rows.unionByName(names.select("playlist_id", "name", F.lit(True).alias("named")).distinct(), allowMissingColumns=True).filter("playlist_id is not null")
    ordered = rows.repartition("playlist_id").sortWithinPartitions("playlist_id", F.desc("named"), "pos", *said)
    kind = rows.schema["playlist_id"].dataType.simpleString()
    lists = ordered.select("playlist_id", "named", "name", F.when(~F.col("named"), entry(target, windows)).alias("line")).mapInArrow(put_together, f"playlist_id {kind}, name string, lines string, n int")
    return lists.select("playlist_id", F.concat(safe_name(F.col("name")), F.lit("." + TARGETS[target])).alias("file_name"), rendered(target).alias("content"))


def text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


#: Where an entry's text has its number, which is known when the list is put together.
NUMBER = object()


def numbered(*parts: object) -> Column:
    """A text as what stands before, between and after its numbers."""
    pieces: list[list] = [[]]
    for p in parts:
        pieces.append([]) if p is NUMBER else pieces[-1].append(p)
    return F.array(*(text(*p) for p in pieces))


def entry(target: str, windows: bool) -> Column:
    """What a file of the target says of one entry, as `numbered` gives it."""
    x, i = F.col, NUMBER
    local = F.replace(x("path"), F.lit("/"), F.lit("\\")) if windows else x("path")
    given = lambda c, *parts: F.when(c, text(*parts)).otherwise("")
    if target == "android":
        return numbered(x("path"), "\n")
    if target == "m3u8":
        return numbered("#EXTINF:", x("seconds"), ",", given(x("artist") != "", x("artist"), " - "), x("title"), "\n", local, "\n")
    if target == "pls":
        return numbered("File", i, "=", local, "\nTitle", i, "=", x("title"), "\nLength", i, "=", x("seconds"), "\n")
    if target == "xspf":
        return numbered("    <track>\n      <location>", xml_escape(uri_path(x("path"))), "</location>\n      <title>", xml_escape(x("title")), "</title>\n", given(x("artist") != "", "      <creator>", xml_escape(x("artist")), "</creator>\n"), given(x("seconds") > 0, "      <duration>", x("seconds") * 1000, "</duration>\n"), "    </track>\n")
    if target == "wpl":
        return numbered('            <media src="', xml_escape(F.replace(x("path"), F.lit("/"), F.lit("\\"))), '"/>\n')
    number = lambda key, value: ("\t\t\t<key>", key, "</key><integer>", value, "</integer>\n")
    string = lambda key, value: ("\t\t\t<key>", key, "</key><string>", xml_escape(value), "</string>\n")
    return numbered("\t\t<key>", i, "</key>\n\t\t<dict>\n", *number("Track ID", i), *string("Name", x("title")), given(x("artist") != "", *string("Artist", x("artist"))), given(x("seconds") > 0, *number("Total Time", x("seconds") * 1000)), *string("Location", x("url")), "\t\t</dict>\n")


def rendered(target: str) -> Column:
    """A file's text: the lines of its n entries with what stands before and after them."""
    lines, n, name = F.col("lines"), F.col("n"), xml_escape(F.col("name"))
    if target in ("android", "m3u8"):
        return text("#EXTM3U\n", lines)
    if target == "pls":
        return text("[playlist]\n", lines, "NumberOfEntries=", n, "\nVersion=2\n")
    if target == "xspf":
        return text('<?xml version="1.0" encoding="UTF-8"?>\n<playlist version="1" xmlns="http://xspf.org/ns/0/">\n  <title>', name, "</title>\n  <trackList>\n", lines, "  </trackList>\n</playlist>\n")
    if target == "wpl":
        head = ('<?wpl version="1.0"?>\n<smil>\n    <head>\n        <meta name="ItemCount" content="', n, '"/>\n        <title>', name, "</title>\n    </head>\n    <body>\n        <seq>\n")
        return text(*head, lines, "        </seq>\n    </body>\n</smil>\n")
    items = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: text("\t\t\t\t<dict><key>Track ID</key><integer>", i, "</integer></dict>\n")), "")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE plist PUBLIC "-//Apple//DTD PLIST 1.0//EN" "http://www.apple.com/DTDs/PropertyList-1.0.dtd">\n<plist version="1.0">\n<dict>\n\t<key>Tracks</key>\n\t<dict>\n'
    return text(head, lines, "\t</dict>\n\t<key>Playlists</key>\n\t<array>\n\t\t<dict>\n\t\t\t<key>Name</key><string>", name, "</string>\n\t\t\t<key>Playlist Items</key>\n\t\t\t<array>\n", items, "\t\t\t</array>\n\t\t</dict>\n\t</array>\n</dict>\n</plist>\n")
