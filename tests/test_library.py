"""Artists, albums and plans on small libraries."""

import pytest
from pyspark.sql import functions as F

from cadenza.operators import library as L
from cadenza.operators import planning as P
from cadenza.plans import tracks as V

DEFAULTS = {"path": "", "format": "MP3", "title": "", "artist": "", "albumArtist": "", "album": "", "genre": "", "trackNo": 0, "discNo": 0, "year": 0, "compilation": False, "hasSort": False, "legacyTag": False, "tagBytes": 0, "lyrics": "", "hasLyrics": False}
SCHEMA = "path string, format string, title string, artist string, albumArtist string, album string, genre string, trackNo int, discNo int, year int, compilation boolean, hasSort boolean, legacyTag boolean, tagBytes bigint, lyrics string, hasLyrics boolean"


@pytest.fixture
def library(spark):
    def make(*tracks):
        rows = [DEFAULTS | {"path": f"/m/{i}.mp3"} | t for i, t in enumerate(tracks)]
        return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)

    return make


def test_artist_reduction(library):
    names = ["Oda Brask", "oda brask", "Oda Brask feat. Une", "Oda Brask & Nil Kite", "ODA BRASK", "Ясень", "ясень"]
    t = library(*({"artist": n, "album": "A" if i < 3 else "B"} for i, n in enumerate(names)))
    got = {r.name: r for r in L.artist_reduce(t).collect()}
    assert set(got) == {"Oda Brask", "Ясень"}
    assert (got["Oda Brask"].tracks, got["Oda Brask"].albums, got["Oda Brask"].sources) == (5, 2, 5)
    kinds = {r.value: r.kind for r in L.artist_sources(t).collect()}
    assert kinds == {"Oda Brask": "exact", "oda brask": "spelling", "Oda Brask feat. Une": "feature", "Oda Brask & Nil Kite": "separator", "ODA BRASK": "spelling", "Ясень": "exact", "ясень": "spelling"}


def test_best_spelling_is_settled(library):
    assert L.artist_reduce(library({"artist": "BEATLES"}, {"artist": "beatles"})).first().name == "BEATLES"
    assert L.artist_reduce(library({"artist": "!!!"}, {"artist": "???"})).count() == 1  # names of symbols only fold together
    assert L.artist_reduce(library()).count() == 0


def test_album_artist_counts_once(library):
    t = library({"artist": "A", "albumArtist": "A"}, {"artist": "A", "albumArtist": "a"})
    assert {r["name"]: r.tracks for r in L.raw_names(t).collect()} == {"A": 2, "a": 1}
    assert {r["name"]: r.tracks for r in L.raw_names(t, True).collect()} == {"A": 1, "a": 1}


def test_albums(library):
    t = library(*({"artist": "X", "album": a} for a in ("Record", "record", "Record (Deluxe)", "Record | @ch", "Record", "Record (CD2)")))
    albums, sources = L.albums(t)
    assert [(r.name, r.artist, r.tracks, r.sources) for r in albums.collect()] == [("Record", "X", 6, 5)]
    assert {r.value: r.kind for r in sources.collect()} == {"Record": "exact", "record": "spelling", "Record (Deluxe)": "edition", "Record | @ch": "watermark", "Record (CD2)": "disc"}
    order, _ = L.albums(library({"artist": "X", "album": "Моя кассета - твой первый диск"}, {"artist": "X", "album": "Твой первый диск - моя кассета"}))
    assert order.count() == 1


def test_albums_stay_apart(library):
    albums, _ = L.albums(library({"artist": "Queen", "album": "Greatest Hits"}, {"artist": "ABBA", "album": "Greatest Hits"}, {"artist": "ABBA", "album": "Greatest Hits"}))
    assert {(r.owner, r.tracks) for r in albums.collect()} == {("queen", 1), ("abba", 2)}


def test_compilations(library):
    albums, _ = L.albums(library({"artist": "A", "album": "Now 50", "compilation": True}, {"artist": "B", "album": "Now 50", "compilation": True}))
    assert [(r.owner, r.artist, r.tracks) for r in albums.collect()] == [(None, "Various artists", 2)]
    stray, _ = L.albums(library({"artist": "Oda Brask", "album": "X"}, {"artist": "Oda Brask", "album": "X"}, {"artist": "Y", "album": "X", "compilation": True}))
    assert [(r.owner, r.artist, r.tracks) for r in stray.collect()] == [("odabrask", "Oda Brask", 3)]


def test_junk(library):
    t = library(*({"artist": a, "album": "Hits"} for a in "ABC"), {"artist": "A", "album": "VK"}, {"artist": "A", "album": "<unknown>"}, {"artist": "A", "album": "@leaks"}, {"artist": "A", "album": "Real"})
    assert {r.value: r.reason for r in L.junk_albums(t).collect()} == {"Hits": "shared", "VK": "site", "<unknown>": "site", "@leaks": "site"}


def test_summary(library):
    t = library({"albumArtist": "A", "compilation": True, "hasSort": True}, {"albumArtist": "B", "compilation": True}, {"hasLyrics": True, "tagBytes": 4_000_000})
    assert L.summary_counts(t).first().asDict() == {"tracks": 3, "album_artist": 2, "compilation": 2, "sort": 1, "legacy": 0, "oversized": 1, "lyrics": 1}
    assert L.summary_counts(t.limit(0)).first().tracks == 0


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_plan(spark, library):
    t = library({"path": "/1", "artist": "x feat. y", "albumArtist": " A ", "album": "Record (CD2)"}, {"path": "/2", "artist": "X", "album": "VK", "compilation": True}, {"path": "/3", "artist": "X"})
    rules = P.Rules(rename=table(spark, [("x feat. y", " X ")], "name string, keep string"), album_rename=table(spark, [("/1", "Record")], "path string, value string"), clear_album=table(spark, [("/2",)], "path string"), remove_compilation=True)
    got = {r.path: {f["name"]: (f.before, f.after) for f in r.fields} for r in P.build(t, rules).collect()}
    assert got == {
        "/1": {"Artist": ("x feat. y", "X"), "Album artist": (" A ", "A"), "Album": ("Record (CD2)", "Record"), "Disc number": ("", "2")},
        "/2": {"Album": ("VK", ""), "Compilation flag": ("yes", "")},
    }
    summary = P.plan_summary(P.build(t, rules)).first()
    assert (summary.files, summary.artist_renamed, summary.album_renamed, summary.compilation_removed) == (2, 1, 2, 1)
    after = P.applied(t, P.build(t, rules))
    rules.album_rename = None
    assert P.build(after, rules).count() == 0


def test_modes_and_hand_edits(spark, library):
    t = library({"path": "/1", "artist": "A", "albumArtist": "B", "lyrics": "old"})
    names = lambda r: {f["name"]: f.after for row in P.build(t, r).collect() for f in row.fields}
    assert names(P.Rules(album_artist_mode="clear")) == {"Album artist": ""}
    assert names(P.Rules(album_artist_mode="fromArtist")) == {"Album artist": "A"}
    assert names(P.Rules(album_artist_mode="unknown")) == {}
    shared = table(spark, [("/1", "S")], "path string, value string")
    assert names(P.Rules(album_artist_set=shared)) == {"Album artist": "S"}
    assert names(P.Rules(album_artist_set=shared, album_artist_mode="clear")) == {"Album artist": ""}
    hand = table(spark, [("/1", "H ", None, "", None, None, "new\nwords", 1999, None, 0, False, False, False, False)], P.MANUAL)
    assert names(P.Rules(manual=hand)) == {"Artist": "H", "Year": "1999", "Lyrics": "new"}
    edit = P.plan_json(P.build(t, P.Rules(manual=hand, album_artist_mode="clear"))).first().edit
    assert '"albumArtist":""' in edit and "album\"" not in edit and "removeCompilation" not in edit and "backup" not in edit


def test_patches(spark):
    cols = P.MANUAL.replace("path string, ", "path string, edit_no int, ", 1)
    rows = [("/1", 1, "A", None, "x", None, None, None, None, None, None, True, False, True, False), ("/1", 2, None, "B", "", None, None, None, None, None, None, False, False, False, False)]
    got = P.merge_patches(table(spark, rows, cols)).first()
    assert (got.artist, got.albumArtist, got.album, got.removeCompilation, got.removeLegacyTag) == ("A", "B", "", True, False)
    assert P.merge_patches(table(spark, rows, cols), True).first().removeLegacyTag
    done = P.results_summary(table(spark, [("/1", "found"), ("/2", "found"), ("/3", "missing")], "path string, status string"), table(spark, [("/1", "x"), ("/2", "")], "path string, error string"))
    assert {r.status: r.n for r in done.collect()} == {"found": 1, "failed": 1, "missing": 1}


def test_plan_of_derived_tracks_comes_to_rest(spark):
    t = V.tracks(spark, "/root/testdata/sf0.001")
    rules = P.Rules(album_artist_mode="fromArtist", remove_compilation=True, remove_sort=True, remove_legacy=True)
    plan = P.build(t, rules)
    assert plan.count() > 0 and P.build(P.applied(t, plan), rules).count() == 0
    assert P.plan_fields(plan).agg(F.max("pos")).first()[0] <= 12


def test_guards(spark):
    failed = table(spark, [("/1", "bad")], "path string, reason string")
    asked = table(spark, [("/1",), ("/2",)], "path string")
    assert [r.path for r in L.deletable(asked, failed).collect()] == ["/1"]
    assert L.survivors(failed, asked).count() == 0
