"""Queries on sources and sinks: tags in hand-built bytes, edits written into them, playlists of every target, listings, outcomes; with their SQL."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import library as L
from ..operators import planning as P
from ..operators import playlists as PL
from ..sources import codecs as C
from ..sources import files as FI
from ..sources import messages as S
from . import tracks as V
from .function_queries import read
from .matching_queries import RESOLVE, message_lines, resolved
from .oracle import TRACKS

#: A frame of MPEG audio: layer III at 128 kbit/s.
AUDIO = b"\xff\xfb\x90\x00" + b"\0" * 413


def id3(version: int, frames: list[tuple[str, bytes]]) -> bytes:
    """A tag of version 2.2, 2.3 or 2.4, with some padding."""
    size = {2: lambda n: n.to_bytes(3), 3: lambda n: n.to_bytes(4), 4: C.safe_bytes}[version]
    body = b"".join(name.encode() + size(len(x)) + (b"" if version == 2 else b"\0\0") + x for name, x in frames) + b"\0" * 16
    return b"ID3" + bytes([version, 0, 0]) + C.safe_bytes(len(body)) + body


def id3v1(title: str, artist: str, album: str, year: int, no: int) -> bytes:
    fixed = lambda s, n: s.encode("latin-1")[:n].ljust(n, b"\0")
    return b"TAG" + fixed(title, 30) + fixed(artist, 30) + fixed(album, 30) + fixed(str(year), 4) + b"\0" * 29 + bytes([no, 17])


def flac(comments: list[str]) -> bytes:
    """Ten seconds by its header; the comments' block is the last."""
    info = b"\0" * 10 + ((44100 << 44) | (1 << 41) | (15 << 36) | 441000).to_bytes(8) + b"\0" * 16
    coded = [c.encode() for c in comments]
    body = struct.pack("<I", 3) + b"own" + struct.pack("<I", len(coded)) + b"".join(struct.pack("<I", len(c)) + c for c in coded)
    return b"fLaC" + b"\0" + len(info).to_bytes(3) + info + b"\x84" + len(body).to_bytes(3) + body + b"audio"


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(body), kind) + body


def item(kind: bytes, flag: int, value: bytes) -> bytes:
    return box(kind, box(b"data", struct.pack(">II", flag, 0) + value))


def mp4(items: list[bytes]) -> bytes:
    """5.4 seconds by its header; the audio stands behind the movie box."""
    head = box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 5400) + b"\0" * 80)
    trak = box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stco", b"\0" * 4 + struct.pack(">II", 1, 0))))))
    moov = box(b"moov", head + trak + box(b"udta", box(b"meta", b"\0" * 4 + box(b"hdlr", b"\0" * 25) + box(b"ilst", b"".join(items)))))
    return box(b"ftyp", b"M4A ") + moov + box(b"mdat", b"bytes")


def sample_file(key: int, name: str, brand: str, kind: str, size: int) -> tuple[str, bytes]:
    """A file for each part, of seven kinds by its key, the last of which can't be read."""
    no, year = size % 30 + 1, 1970 + size
    utf8 = lambda s: b"\3" + s.encode()
    wide = lambda s: b"\1\xff\xfe" + s.encode("utf-16-le")
    old = lambda s: b"\0" + s.encode("latin-1")
    if key % 7 == 0:
        return f"/t/{key}.mp3", id3(4, [("TIT2", utf8(name)), ("TPE1", utf8(f"{brand}\0{kind}")), ("TALB", utf8(kind)), ("TRCK", utf8(f"{no}/40")), ("TDRC", utf8(f"{year}-05-01")), ("TCMP", utf8("1")), ("USLT", b"\3eng\0" + name.encode()), ("TXXX", utf8("ALBUM ARTIST SORT\0x"))]) + AUDIO
    if key % 7 == 1:
        return f"/t/{key}.MP3", id3(3, [("TIT2", wide(name)), ("TPE1", wide(brand)), ("TPE2", old(kind)), ("TALB", wide(kind)), ("TRCK", old(str(no))), ("TYER", old(str(year)))]) + AUDIO
    if key % 7 == 2:
        return f"/t/{key}.mp3", id3(2, [("TT2", old(name)), ("TP1", old(brand)), ("TAL", old(kind)), ("TRK", old(str(no))), ("TYE", old(str(year)))]) + AUDIO
    if key % 7 == 3:
        return f"/t/{key}.mp3", AUDIO + id3v1(name, brand, kind, year, no)
    if key % 7 == 4:
        return f"/t/{key}.flac", flac([f"title={name}", f"ARTIST={brand}", f"Album={kind}", f"TRACKNUMBER={no}/40", f"DATE={year}-01", "COMPILATION=1", f"LYRICS={name}"])
    if key % 7 == 5:
        pair = struct.pack(">HHHH", 0, no, 40, 0)
        return f"/t/{key}.m4a", mp4([item(b"\xa9nam", 1, name.encode()), item(b"\xa9ART", 1, brand.encode()), item(b"\xa9alb", 1, kind.encode()), item(b"trkn", 0, pair), item(b"\xa9day", 1, str(year).encode()), item(b"cpil", 21, b"\1")])
    return f"/t/{key}.flac", b"nothing of the kind"


def sample_files(spark, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sample_file(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary())], names=["path", "content"])

    return read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").mapInArrow(run, "path string, content binary")


def edited_files(spark, sf_dir: str) -> DataFrame:
    """The same files after an edit: a new title, another artist for some, no album for others, year and flags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, out = batch.column(0).to_pylist(), []
            for path, data in zip(paths, batch.column(1).to_pylist()):
                key = int(path.rpartition("/")[2].partition(".")[0])
                edit = {"title": f"new {key}", "artist": f"артист {key}" if key % 2 else None, "album": "" if key % 3 == 0 else None, "year": 2000 + key % 20, "trackNo": key % 9 + 1, "removeCompilation": key % 4 == 0, "lyrics": f"la {key}" if key % 5 == 0 else None}
                out.append(C.write(path, data, edit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    return sample_files(spark, sf_dir).filter("content <> cast('nothing of the kind' as binary)").mapInArrow(run, "path string, content binary")


FIELDS = ("path", "format", "title", "artist", "albumArtist", "album", "trackNo", "year", "compilation", "hasSort", "hasLyrics", "legacyTag")
FILE = """f as (select *, p_partkey % 7 as k, cast(p_size % 30 + 1 as int) as no, cast(1970 + p_size as int) as yr,
'/t/' || p_partkey || case p_partkey % 7 when 1 then '.MP3' when 4 then '.flac' when 5 then '.m4a' when 6 then '.flac' else '.mp3' end as path,
case p_partkey % 7 when 4 then 'FLAC' when 5 then 'M4A' else 'MP3' end as format from part)"""

#: What an outcome of a search and of a write would be, of customers.
OUTCOMES = "case c_custkey % 4 when 0 then 'missing' when 1 then 'skipped' else 'found' end"


def outcomes(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.expr(OUTCOMES).alias("status"))


def writes(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").filter("c_custkey % 4 > 1").select(F.col("c_custkey").cast("string").alias("path"), F.when(F.col("c_custkey") % 3 == 0, "denied").otherwise("").alias("error"))


def listing(spark, sf_dir: str) -> DataFrame:
    """Lines of a listing of files, some hidden, some blank, some folders."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    kind = F.col("p_partkey") % 5
    return p.select(F.when(kind == 0, F.concat(F.lit("/s/"), k, F.lit(".mp3"))).when(kind == 1, F.concat(F.lit(" /s/"), k, F.lit(".M3U \r"))).when(kind == 2, F.concat(F.lit("/s/.hidden"), k, F.lit(".mp3"))).when(kind == 3, "  ").otherwise(F.concat(F.lit("/s/"), k, F.lit("/"))).alias("line"))


def adb_lines(spark, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    kind = F.col("s_suppkey") % 4
    return s.select(F.when(kind == 0, "List of devices attached").when(kind == 1, "* daemon started").when(kind == 2, F.concat(k, F.lit("\tdevice product:x model:Pixel_"), k, F.lit(" device:y"))).otherwise(F.concat(k, F.lit("   unauthorized"))).alias("line"))


def database_lines(spark, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    return s.select(F.when(F.col("s_suppkey") % 5 == 0, "No result found.").otherwise(F.concat(F.lit("Row: 1 _id="), k, F.lit(", _data=/sdcard/a, b/"), "s_name", F.lit(".mp3  "))).alias("line"))


def lists(spark, sf_dir: str, target: str) -> DataFrame:
    names = resolved(spark, sf_dir).select("playlist_id", F.concat("playlist_id", F.lit(" & <mix>")).alias("name")).distinct()
    return PL.write(resolved(spark, sf_dir), names, target, "/m/lists").select("file_name", F.sha2("content", 256).alias("content"))


#: Entries of found files in their order, with what every target shows of them.
SHOWN = f"""{RESOLVE},
g as (select playlist_id, pos, row_number() over (partition by playlist_id order by pos) as i, count(*) over (partition by playlist_id) as n, '../' || substr(file, 4) as p, file, case when title <> '' then title else lpad(cast(pos as varchar), 7, '0') end as t, artist as a, case when duration > 0 then duration else -1 end as s from found where file is not null)"""


def esc(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), '''', '&apos;')"


def url(x: str) -> str:
    """Paths of the derived files hold letters, digits, blanks, / and #."""
    return f"replace(replace({x}, ' ', '%20'), '#', '%23')"


def whole(target: str, extension: str, head: str, line: str, foot: str) -> tuple:
    body = f"{head} || string_agg({line}, '' order by pos) || {foot}"
    return (lambda s, d: lists(s, d, target), f"with {SHOWN} select playlist_id || ' & -mix-.{extension}' as file_name, sha256({body}) as content from g group by playlist_id")


NL, TAB = "chr(10)", "chr(9)"
NAME = esc("playlist_id || ' & <mix>'")
QUERIES = {
    "tags_read": (
        lambda s, d: FI.tracks(FI.read_files(sample_files(s, d))).select(*FIELDS, F.round("duration", 4).alias("duration")),
        f"""with {FILE} select path, format, p_name as title, case when k = 0 then p_brand || '; ' || p_type else p_brand end as artist, case when k = 1 then p_type else '' end as albumArtist, p_type as album, no as trackNo, yr as year, k in (0, 4, 5) as compilation, k = 0 as hasSort, k in (0, 4) as hasLyrics, k = 3 as legacyTag,
case k when 4 then 10.0 when 5 then 5.4 when 3 then round(({len(AUDIO)} + 128) * 8 / 128000.0, 4) else round({len(AUDIO)} * 8 / 128000.0, 4) end::double as duration from f where k < 6""",
    ),
    "tag_failures": (lambda s, d: FI.failures(FI.read_files(sample_files(s, d))).select("path"), f"with {FILE} select path from f where k = 6"),
    "tags_written": (
        lambda s, d: FI.tracks(FI.read_files(edited_files(s, d))).select("path", "title", "artist", "album", "year", "trackNo", "compilation", "hasLyrics"),
        f"""with {FILE} select path, 'new ' || p_partkey as title, case when p_partkey % 2 = 1 then 'артист ' || p_partkey when k = 0 then p_brand || '; ' || p_type else p_brand end as artist, case when p_partkey % 3 = 0 and k <> 3 then '' else p_type end as album, cast(2000 + p_partkey % 20 as int) as year, cast(p_partkey % 9 + 1 as int) as trackNo, k in (0, 4, 5) and p_partkey % 4 <> 0 as compilation, k in (0, 4) or p_partkey % 5 = 0 as hasLyrics from f where k < 6""",
    ),
    "listed_media": (lambda s, d: S.listed_paths(listing(s, d)), "select '/s/' || p_partkey || '.mp3' as path from part where p_partkey % 5 = 0"),
    "listed_playlists": (lambda s, d: S.listed_paths(listing(s, d), "playlists"), "select '/s/' || p_partkey || '.M3U' as path from part where p_partkey % 5 = 1"),
    "listed_devices": (
        lambda s, d: S.devices(adb_lines(s, d)),
        "select cast(s_suppkey as varchar) as serial, case when s_suppkey % 4 = 2 then 'device' else 'unauthorized' end as state, case when s_suppkey % 4 = 2 then 'Pixel ' || s_suppkey else '' end as model from supplier where s_suppkey % 4 > 1",
    ),
    "database_rows": (lambda s, d: S.database_rows(database_lines(s, d)), "select s_suppkey as id, '/sdcard/a, b/' || s_name || '.mp3' as path from supplier where s_suppkey % 5 <> 0"),
    "playlist_ids": (
        lambda s, d: PL.playlist_ids(S.database_rows(database_lines(s, d)).select("path"), S.database_rows(database_lines(s, d))).select("path", "id"),
        "select '/sdcard/a, b/' || s_name || '.mp3' as path, s_suppkey as id from supplier where s_suppkey % 5 <> 0",
    ),
    "visible_counts": (lambda s, d: S.visible_counts(read(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("path"), F.col("l_linenumber").alias("n"))), "select cast(l_suppkey as varchar) as path, max(l_linenumber) as n from lineitem group by 1"),
    "scan_progress": (
        lambda s, d: S.progress(S.messages(message_lines(s, d))),
        "select count(*) filter (event_id % 5 = 4) as tracks, count(*) filter (event_id % 5 = 0) as failures, cast(max(event_id) filter (event_id % 5 = 1) as int) as done, cast(99 as int) as total from events",
    ),
    "results_summary": (
        lambda s, d: P.results_summary(outcomes(s, d), writes(s, d)),
        f"select case when st = 'found' and c_custkey % 3 = 0 then 'failed' else st end as status, count(*) as n from (select *, {OUTCOMES} as st from customer) group by 1",
    ),
    "deletable_files": (
        lambda s, d: L.deletable(outcomes(s, d).select("path"), failed_writes(s, d)),
        "select cast(c_custkey as varchar) as path from customer where c_custkey % 4 > 1 and c_custkey % 3 = 0",
    ),
    "remaining_failures": (
        lambda s, d: L.survivors(failed_writes(s, d), outcomes(s, d).filter("status = 'found' and cast(path as bigint) % 2 = 0")).select("path", "reason"),
        f"select cast(c_custkey as varchar) as path, 'denied' as reason from customer where c_custkey % 4 > 1 and c_custkey % 3 = 0 and not ({OUTCOMES} = 'found' and c_custkey % 2 = 0)",
    ),
    "plan_json": (
        lambda s, d: P.plan_json(edits_of(s, d)).select("path", "edit"),
        """select cast(p_partkey as varchar) as path, '{' || concat_ws(',', case when p_partkey % 2 = 0 then '"artist":"' || p_name || '"' end, case when p_partkey % 3 = 0 then '"album":""' end, case when p_partkey % 5 = 0 then '"year":' || (1990 + p_size) end, case when p_partkey % 7 = 0 then '"removeCompilation":true' end) || '}' as edit from part""",
    ),
    "plan_applied": (
        lambda s, d: P.applied(V.tracks(s, d), edits_of(s, d, F.col("path"))).select("path", "artist", "album", "year", "compilation"),
        f"with {TRACKS}, n as (select *, cast(regexp_extract(path, '([0-9]+)[.]mp3', 1) as int) as k from tracks) select t.path, case when k % 2 = 0 then p_name else artist end as artist, case when k % 3 = 0 then '' else album end as album, case when k % 5 = 0 then cast(1990 + p_size as int) else year end as year, compilation and k % 7 <> 0 as compilation from n t join part on p_partkey = k",
    ),
    "android_write": whole("android", "m3u", f"'#EXTM3U' || {NL}", f"p || {NL}", "''"),
    "pls_write": whole("pls", "pls", f"'[playlist]' || {NL}", f"'File' || i || '=' || p || {NL} || 'Title' || i || '=' || t || {NL} || 'Length' || i || '=' || s || {NL}", f"'NumberOfEntries=' || max(n) || {NL} || 'Version=2' || {NL}"),
    "wpl_write": whole(
        "wpl", "wpl",
        f"""'<?wpl version="1.0"?>' || {NL} || '<smil>' || {NL} || '    <head>' || {NL} || '        <meta name="ItemCount" content="' || max(n) || '"/>' || {NL} || '        <title>' || {NAME} || '</title>' || {NL} || '    </head>' || {NL} || '    <body>' || {NL} || '        <seq>' || {NL}""",
        f"""'            <media src="' || {esc("replace(p, '/', chr(92))")} || '"/>' || {NL}""", f"'        </seq>' || {NL} || '    </body>' || {NL} || '</smil>' || {NL}",
    ),
    "xspf_write": whole(
        "xspf", "xspf",
        f"""'<?xml version="1.0" encoding="UTF-8"?>' || {NL} || '<playlist version="1" xmlns="http://xspf.org/ns/0/">' || {NL} || '  <title>' || {NAME} || '</title>' || {NL} || '  <trackList>' || {NL}""",
        f"""'    <track>' || {NL} || '      <location>' || {esc(url('p'))} || '</location>' || {NL} || '      <title>' || {esc('t')} || '</title>' || {NL} || case when a <> '' then '      <creator>' || {esc('a')} || '</creator>' || {NL} else '' end || case when s > 0 then '      <duration>' || s * 1000 || '</duration>' || {NL} else '' end || '    </track>' || {NL}""",
        f"'  </trackList>' || {NL} || '</playlist>' || {NL}",
    ),
    "itunes_write": whole(
        "itunes", "xml",
        f"""'<?xml version="1.0" encoding="UTF-8"?>' || {NL} || '<!DOCTYPE plist PUBLIC "-//Apple//DTD PLIST 1.0//EN" "http://www.apple.com/DTDs/PropertyList-1.0.dtd">' || {NL} || '<plist version="1.0">' || {NL} || '<dict>' || {NL} || {TAB} || '<key>Tracks</key>' || {NL} || {TAB} || '<dict>' || {NL}""",
        f"""repeat({TAB}, 2) || '<key>' || i || '</key>' || {NL} || repeat({TAB}, 2) || '<dict>' || {NL} || repeat({TAB}, 3) || '<key>Track ID</key><integer>' || i || '</integer>' || {NL} || repeat({TAB}, 3) || '<key>Name</key><string>' || {esc('t')} || '</string>' || {NL} || case when a <> '' then repeat({TAB}, 3) || '<key>Artist</key><string>' || {esc('a')} || '</string>' || {NL} else '' end || case when s > 0 then repeat({TAB}, 3) || '<key>Total Time</key><integer>' || s * 1000 || '</integer>' || {NL} else '' end || repeat({TAB}, 3) || '<key>Location</key><string>' || {esc("'file://' || " + url('file'))} || '</string>' || {NL} || repeat({TAB}, 2) || '</dict>' || {NL}""",
        f"""{TAB} || '</dict>' || {NL} || {TAB} || '<key>Playlists</key>' || {NL} || {TAB} || '<array>' || {NL} || repeat({TAB}, 2) || '<dict>' || {NL} || repeat({TAB}, 3) || '<key>Name</key><string>' || {NAME} || '</string>' || {NL} || repeat({TAB}, 3) || '<key>Playlist Items</key>' || {NL} || repeat({TAB}, 3) || '<array>' || {NL} || string_agg(repeat({TAB}, 4) || '<dict><key>Track ID</key><integer>' || i || '</integer></dict>' || {NL}, '' order by pos) || repeat({TAB}, 3) || '</array>' || {NL} || repeat({TAB}, 2) || '</dict>' || {NL} || {TAB} || '</array>' || {NL} || '</dict>' || {NL} || '</plist>' || {NL}""",
    ),
}


def failed_writes(spark, sf_dir: str) -> DataFrame:
    """Writes that failed, as failures of a scan."""
    return writes(spark, sf_dir).filter("error <> ''").select("path", F.col("error").alias("reason"))


def edits_of(spark, sf_dir: str, path=None) -> DataFrame:
    """An edit for each part, with fields that aren't said, that are empty and flags that are off."""
    k = F.col("p_partkey")
    none = lambda kind: F.lit(None).cast(kind)
    fields = {
        "artist": F.when(k % 2 == 0, F.col("p_name")), "albumArtist": none("string"), "album": F.when(k % 3 == 0, F.lit("")), "title": none("string"), "genre": none("string"), "lyrics": none("string"),
        "year": F.when(k % 5 == 0, (F.lit(1990) + F.col("p_size")).cast("int")), "trackNo": none("int"), "discNo": none("int"),
        "removeCompilation": k % 7 == 0, "removeAlbumArtistSort": F.lit(False), "removeLegacyTag": F.lit(False), "shrinkArtwork": F.lit(False), "backup": F.lit(False),
    }
    where = k.cast("string") if path is None else F.expr(V.TRACKS["path"])
    return read(spark, sf_dir, "part").select(where.alias("path"), F.struct(*(c.alias(n) for n, c in fields.items())).alias("edit"))
