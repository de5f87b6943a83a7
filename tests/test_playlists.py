"""Playlists: parsing, finding files, writing; messages of a remote scan; streaming."""

import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.functions import arrow as A
from cadenza.operators import playlists as P
from cadenza.plans import function_queries, registry
from cadenza.sources import files as FI
from cadenza.sources import messages as S
from cadenza.streaming import progress

NFD = unicodedata.normalize("NFD", "Танцуй")
FILES = [f"Ясень/{NFD}.mp3", "A/Intro.mp3", "B/Intro.mp3", "A/B/Song & Co #1.mp3", "x/one.mp3"]


def index(spark, names=FILES):
    return spark.createDataFrame(list(enumerate(names)), "ord int, rel string")


def entries(spark, *locations):
    return spark.createDataFrame([("p", i, x, "", "", -1) for i, x in enumerate(locations)], "playlist_id string, pos int, location string, title string, artist string, duration int")


def find(spark, *locations, folder="/lists", root="/music"):
    rows = P.resolve(entries(spark, *locations), index(spark), root, folder).orderBy("pos").collect()
    return [r.file and r.file.removeprefix(root + "/") for r in rows]


def test_resolve(spark):
    assert find(spark, "/music/Ясень/Танцуй.mp3", "D:\\Music\\КИНО\\танцуй.MP3", "file:///Users/me/%D0%9A%D0%B8%D0%BD%D0%BE/%D0%A2%D0%B0%D0%BD%D1%86%D1%83%D0%B9.mp3", "gone.mp3") == [FILES[0], FILES[0], FILES[0], None]
    assert find(spark, "Intro.mp3", "b/intro.MP3", "z/A/Intro.mp3", " x/one.mp3 ", "Disk:Users:me:x:one.mp3") == [None, "B/Intro.mp3", "A/Intro.mp3", "x/one.mp3", "x/one.mp3"]
    assert find(spark, "../A/Intro.mp3", folder="/music/B") == ["A/Intro.mp3"]
    assert find(spark, "/sdcard/Music/A/Intro.mp3", root="/storage/emulated/0/Music") == ["A/Intro.mp3"]
    assert find(spark, "") == [None]


def test_ambiguous_tail_of_several_parts_takes_the_first(spark):
    rows = P.resolve(entries(spark, "q/a/s.mp3"), index(spark, ["2/a/s.mp3", "1/a/s.mp3"]), "/m").collect()
    assert rows[0].file == "/m/2/a/s.mp3"


@pytest.mark.parametrize("target", list(P.TARGETS))
@pytest.mark.parametrize("windows", [False, True])
def test_round_trip(spark, tmp_path, target, windows):
    listed = P.resolve(entries(spark, *("/music/" + f for f in FILES)), index(spark), "/music").withColumn("title", F.concat(F.lit("T & <"), "pos")).withColumn("artist", F.lit("A")).withColumn("duration", F.lit(215))
    names = spark.createDataFrame([("p", "my: list.")], "playlist_id string, name string")
    written = P.write(listed, names, target, "/music/lists", windows)
    assert [r.status for r in FI.save_playlists(written, str(tmp_path)).collect()] == ["new"]
    assert [r.status for r in FI.save_playlists(written, str(tmp_path)).collect()] == ["same"]
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content")
    playlists, read = P.parse_files(files)
    assert playlists.count() == 1
    again = P.resolve(read, index(spark), "/music", "/music/lists").orderBy("pos").collect()
    assert [r.file for r in again] == ["/music/" + f for f in FILES]
    if target in ("m3u8", "xspf", "itunes"):
        assert (again[0].title, again[0].artist, again[0].duration) == ("T & <0", "A", 215)


def lines(spark, *text):
    return spark.createDataFrame([("p", i, x) for i, x in enumerate(text)], "playlist_id string, pos int, line string")


def test_m3u(spark):
    got = P.m3u_entries(lines(spark, "#EXTM3U", "#extinf:215 a=1,Artist - Title - x", "# remark", "/a.mp3", "/b.mp3", "#EXTINF:0,Alone", "c.mp3", "#EXTINF:9,last")).orderBy("pos").collect()
    assert [(r.location, r.artist, r.title, r.duration) for r in got] == [("/a.mp3", "Artist", "Title - x", 215), ("/b.mp3", "", "", -1), ("c.mp3", "", "Alone", -1)]


def test_pls_and_table(spark):
    got = P.pls_entries(lines(spark, "[playlist]", "File2=/b", "title2=x", "Title2=A - B", "Length2=7", "Length2=-1", "Title3=none", "File10=/j", "File1=/a")).orderBy("pos").collect()
    assert [(r.pos, r.location, r.artist, r.title, r.duration) for r in got] == [(1, "/a", "", "", -1), (2, "/b", "A", "B", 7), (10, "/j", "", "", -1)]
    head = "\t".join(["Name", "Artist", "Album", "Genre", "Время", "Location"])
    got = P.itunes_text_entries(lines(spark, head, "N\tA\t\t\t12\t/f", "N\tA\t\t\t0\t")).collect()
    assert [(r.title, r.artist, r.location, r.duration) for r in got] == [("N", "A", "/f", 12)]


def test_text_of_old_files():
    russian = "Ясень/Тихий берег.mp3\nОтлив\n"
    assert A.decoded(russian.encode("windows-1251")) == russian
    assert A.decoded("Porte de la Lumière/Straße.mp3".encode("windows-1252")) == "Porte de la Lumière/Straße.mp3"
    for name in ("utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-8"):
        assert A.decoded("a/b.mp3\n".encode(name)) == "a/b.mp3\n"


def test_plist():
    plist = b"""<?xml version="1.0"?><!DOCTYPE plist PUBLIC "-//Apple//DTD PLIST 1.0//EN" "http://x"><plist><dict>
    <key>Tracks</key><dict><key>1</key><dict><key>Name</key><string>S</string><key>Total Time</key><integer>239500</integer><key>Location</key><string>file:///a%20b.mp3</string></dict></dict>
    <key>Playlists</key><array>
    <dict><key>Master</key><true/><key>Playlist Items</key><array><dict><key>Track ID</key><integer>1</integer></dict></array></dict>
    <dict><key>Distinguished Kind</key><integer>4</integer></dict>
    <dict><key>Name</key><string>Mine</string><key>Playlist Items</key><array><dict><key>Track ID</key><integer>1</integer></dict><dict><key>Track ID</key><integer>9</integer></dict></array></dict>
    </array></dict></plist>"""
    got = A.itunes_playlists(plist)
    assert [(p["name"], [(e["location"], e["duration"]) for e in p["entries"]]) for p in got] == [("Mine", [("file:///a%20b.mp3", 239)])]
    assert A.itunes_playlists(b"no xml") == []


def test_paths(apply):
    assert apply(P.clean_path, ["/a/./b//../c", "C:/x/../y", "/../a"]) == ["/a/c", "C:/y", "/a"]
    assert apply(P.relative, [("/m/a/b.mp3", "/m/c"), ("/m/b.mp3", "/m"), ("/m/b.mp3", "/"), ("/M/x/b.mp3", "/m/X")]) == ["../a/b.mp3", "b.mp3", "m/b.mp3", "b.mp3"]
    assert apply(P.path_from_location, ["file:///C:/Music/a%20b.mp3", "file://localhost/a+b.mp3", "FILE:/x%zz", "x y"]) == ["C:/Music/a b.mp3", "/a+b.mp3", "/x%zz", "x y"]
    assert apply(P.file_url, ["/a b/é&=+:@$~*!.mp3"]) == ["file:///a%20b/%C3%A9&=+:@$~%2A%21.mp3"]
    assert apply(P.safe_name, ["a/b: c?.", " .. ", "x"]) == ["a-b- c-", "Playlist", "x"]


MESSAGES = ['{"type":"start","total":3}', "noise", "{broken", '{"type":"track","track":{"path":"/a","title":"A"}}', ' {"type":"track","track":{"path":"/b"}} \r', '{"type":"error","path":"/c","error":"bad"}', '{"type":"done","done":3,"total":3}']


def test_messages(spark):
    parsed = S.messages(spark.createDataFrame([(x,) for x in MESSAGES], "line string"))
    assert sorted(r.path for r in S.tracks(parsed).collect()) == ["/a", "/b"]
    assert [(r.path, r.reason) for r in S.failures(parsed).collect()] == [("/c", "bad")]
    assert S.progress(parsed).first().asDict() == {"tracks": 2, "failures": 1, "done": 3, "total": 3}
    with pytest.raises(Exception, match="lost"):
        S.failures(S.messages(spark.createDataFrame([('{"type":"error","error":"lost"}',)], "line string"))).collect()


def test_listings(spark):
    rows = lambda *x: spark.createDataFrame([(y,) for y in x], "line string")
    got = S.devices(rows("List of devices attached", "* daemon started", "emu-1  device product:x model:Big_Phone", "abc unauthorized", "")).collect()
    assert [(r.serial, r.state, r.model) for r in got] == [("emu-1", "device", "Big Phone"), ("abc", "unauthorized", "")]
    assert [r.path for r in S.listed_paths(rows("/a/b.mp3", "/a/.x.mp3", "", "/a/c.m3u", "/A/a.FLAC")).collect()] == ["/A/a.FLAC", "/a/b.mp3"]
    assert [r.path for r in S.listed_paths(rows("/b/", "/.x/", "/A/"), "folders").collect()] == ["/A", "/b"]
    ids = S.database_rows(rows("Row: 0 _id=7, _data=/storage/emulated/0/a.m3u ", "No result"))
    assert [(r.path, r.id) for r in P.playlist_ids(spark.createDataFrame([("/sdcard/a.m3u",), ("/x",)], "path string"), ids).orderBy("path").collect()] == [("/sdcard/a.m3u", 7), ("/x", None)]
    assert S.visible_counts(spark.createDataFrame([("/a", 1), ("/a", 3)], "path string, n int")).first().n == 3


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(MESSAGES))
    got = []
    stream = progress.message_stream(spark, str(tmp_path / "in"), 1)
    progress.each_batch(stream, lambda df, n: got.append((n, S.tracks(df).count())), str(tmp_path / "state")).awaitTermination()
    assert sorted(got) == [(0, 2), (1, 2)]


def test_lenient_xml():
    spiff = lambda body: b'<?xml version="1.0"?><playlist xmlns="http://xspf.org/ns/0/"><trackList>' + body + b"</playlist>"
    got = A.xspf_entries(spiff(b"<track><location>/a%20b.mp3</location><title>Salt & Tin&nbsp;x</title><creator><![CDATA[Oda <3]]></creator></track>"))
    assert got == [{"location": "/a b.mp3", "title": "Salt & Tin\xa0x", "artist": "Oda <3", "duration": -1}]
    assert [e["location"] for e in A.wpl_entries(b'<smil><body><seq><media src="a&b.mp3"><media src="c.mp3"/></seq></smil>')] == ["a&b.mp3", "c.mp3"]
    assert A.xspf_entries(b"no markup") is None


def test_throttled_reports(spark):
    rows = [("j", i, stage, ms, done, 9) for i, (stage, ms, done) in enumerate([("a", 0, 1), ("a", 50, 2), ("a", 79, 3), ("a", 80, 4), ("a", 90, 9), ("b", 91, 1), ("b", 120, 2)])] + [("k", 9, "a", 5, 1, 9)]
    got = progress.throttled(spark.createDataFrame(rows, "job string, no int, stage string, ms bigint, done int, total int")).collect()
    assert sorted(r.no for r in got) == [0, 3, 4, 5, 9]


def test_lines_of_an_export_have_a_place_each(spark):
    """A heading that shares its place with a part's line is the first of them by chance only."""
    got = function_queries.itunes_lines(spark, "/root/testdata/sf0.001")
    assert got.groupBy("playlist_id", "pos").count().filter("count > 1").collect() == []
    first = got.groupBy("playlist_id").agg(F.min_by("line", "pos").alias("line")).collect()
    assert first and all(r.line.startswith("Name\t") for r in first)


def test_more_entries_than_are_put_together_at_a_time(spark):
    listed = spark.range(2 * P.CHUNK + 5).selectExpr("'p' as playlist_id", "cast(id as int) as pos", "'t' as title", "'' as artist", "-1 as duration", "concat('/m/', id, '.mp3') as file").repartition(7)
    got = P.write(listed, spark.createDataFrame([("p", "n")], "playlist_id string, name string"), "pls", "/m").first().content
    want = "".join(f"File{i + 1}={i}.mp3\nTitle{i + 1}=t\nLength{i + 1}=-1\n" for i in range(2 * P.CHUNK + 5))
    assert got == f"[playlist]\n{want}NumberOfEntries={2 * P.CHUNK + 5}\nVersion=2\n"


#: Their lists, files and found entries are estimated as too small at any size, so that a plan with a broadcast fills the driver.
WRITERS = ["android_write", "itunes_write", "m3u_write", "pls_write", "wpl_write", "xspf_write"]


@pytest.mark.parametrize("name", WRITERS)
def test_nothing_of_a_written_list_goes_to_the_driver(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastExchange" not in plan


#: Their lists are put together one at a time: an aggregate would hold those of a task all at once.
ONE_LIST_AT_A_TIME = ["itunes_write", "m3u_write", "pls_write", "wpl_write", "xspf_write"]


@pytest.mark.parametrize("name", ONE_LIST_AT_A_TIME)
def test_a_task_holds_one_written_list(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan


def test_lists_are_put_together_as_they_end():
    seen = []

    def batches():
        for i, rows in enumerate([[("p", True, "a"), ("p", True, "b"), ("p", False, None)], [("p", False, None), ("q", False, None), ("r", True, None)], [("r", False, None)], [("s", True, "empty")]]):
            seen.append(i)
            columns = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [None if r[1] else [f"{r[0]}<", ">"] for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.string(), pa.list_(pa.string())))], names=["playlist_id", "named", "name", "line"])

    got = [(len(seen), *(c[0].as_py() for c in b.columns)) for b in P.put_together(batches())]
    assert got == [(2, "p", "a", "p<1>p<2>", 2), (2, "p", "b", "p<1>p<2>", 2), (4, "r", None, "r<1>", 1)]


def test_lists_without_a_name_or_an_entry_are_not_written(spark):
    listed = spark.createDataFrame([(i, p, "t", "", -1, "/m/x.mp3") for p, i in ((1, 1), (0, 1), (0, 2), (0, None))], "playlist_id bigint, pos int, title string, artist string, duration int, file string")
    got = P.write(listed, spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (3, "c"), (None, "d")], "playlist_id int, name string"), "pls", "/m")
    lines = lambda *no: "".join(f"File{i}=x.mp3\nTitle{i}=t\nLength{i}=-1\n" for i in no)
    assert sorted(map(tuple, got.collect())) == [(1, n, f"[playlist]\n{lines(1, 2)}NumberOfEntries=2\nVersion=2\n") for n in ("a.pls", "b.pls")]


def test_a_location_without_blanks_around_it_is_tried_once(spark):
    listed = entries(spark, "/music/x/one.mp3", " /music/x/one.mp3", "x/one.mp3　")
    found = P.resolve(listed, index(spark), "/music")
    assert [r.file for r in found.orderBy("pos").collect()] == ["/music/x/one.mp3"] * 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan and "RepartitionByExpression [playlist_id" in plan


def test_a_path_is_composed_once(spark):
    """A function of Python that Spark may repeat is computed below a filter and above it, by a worker for each."""
    plan = P.resolve(entries(spark, "x"), index(spark), "/music")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [nfc") == 4


def test_a_folder_is_composed_once_not_for_each_row(spark):
    folder = "/m/é"
    assert spark.range(1).select(P.relative(F.lit(f"{folder}/a.mp3"), unicodedata.normalize("NFD", folder)).alias("p")).first().p == "a.mp3"
    plan = registry.queries()["pls_write"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "nfc(file" in plan and "nfc(/m/lists" not in plan


def sorted_by(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    order = next(x for x in plan.splitlines() if "Sort [playlist_id" in x and "named#" in x)
    return [x for x in ("path", "title", "artist", "seconds", "url") if f"{x}#" in order]


def test_a_list_of_paths_sorts_nothing_but_paths(spark):
    assert sorted_by(spark, "wpl_write") == ["path"]


@pytest.mark.parametrize("name", ["xspf_write", "itunes_write"])
def test_urls_are_made_where_they_are_written(spark, name):
    assert ("url" in sorted_by(spark, name)) == (name == "itunes_write")
