"""Tags in hand-built bytes: reading, writing, and both together."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.sources import codecs as C
from cadenza.sources import files as FI


def frame(name, body, synchsafe=True):
    size = C.safe_bytes(len(body)) if synchsafe else len(body).to_bytes(4)
    return name.encode() + size + b"\0\0" + body


def id3(version, frames, padding=0):
    body = b"".join(frames) + b"\0" * padding
    return b"ID3" + bytes([version, 0, 0]) + C.safe_bytes(len(body)) + body


def text(value):
    return b"\3" + value.encode()


AUDIO = b"\xff\xfb\x90\x00" + b"\0" * 413


def v1(title, artist, album, year="1999", no=7):
    fixed = lambda s, n: s.encode("latin-1")[:n].ljust(n, b"\0")
    return b"TAG" + fixed(title, 30) + fixed(artist, 30) + fixed(album, 30) + fixed(year, 4) + b"\0" * 29 + bytes([no, 17])


def flac(comments, rate=44100, samples=441000):
    info = b"\0" * 10 + ((rate << 44) | (1 << 41) | (15 << 36) | samples).to_bytes(8) + b"\0" * 16
    coded = [c.encode() for c in comments]
    body = struct.pack("<I", 3) + b"own" + struct.pack("<I", len(coded)) + b"".join(struct.pack("<I", len(c)) + c for c in coded)
    return b"fLaC" + b"\0" + len(info).to_bytes(3) + info + b"\x84" + len(body).to_bytes(3) + body + b"audio"


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def mp4(items, after=b"mdat-bytes"):
    head = box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 5400) + b"\0" * 80)
    stco = box(b"stco", b"\0" * 4 + struct.pack(">II", 1, 0))
    trak = box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", stco))))
    meta = box(b"meta", b"\0" * 4 + box(b"hdlr", b"\0" * 25) + box(b"ilst", b"".join(items)))
    moov = box(b"moov", head + trak + box(b"udta", meta))
    front = box(b"ftyp", b"M4A ")
    place = len(front) + len(moov) + 8
    at = moov.index(b"stco") + 4 + 8
    moov = moov[:at] + struct.pack(">I", place) + moov[at + 4 :]
    return front + moov + box(b"mdat", after)


def test_id3v24():
    data = id3(4, [frame("TIT2", text("Song")), frame("TPE1", text("Night Yard\0RustBee")), frame("TPE2", text("Band")), frame("TRCK", text("3/12")), frame("TDRC", text("2011-05")), frame("TCMP", text("1")), frame("USLT", b"\3eng\0la la"), frame("TXXX", text("ALBUM ARTIST SORT\0x"))], 20) + AUDIO
    got = C.read("/a.mp3", data)
    assert (got["title"], got["artist"], got["albumArtist"], got["trackNo"], got["year"]) == ("Song", "Night Yard; RustBee", "Band", 3, 2011)
    assert got["compilation"] and got["hasSort"] and got["hasLyrics"] and not got["legacyTag"]
    assert got["lyrics"] == "la la" and got["tagBytes"] == len(data) - len(AUDIO)
    assert got["duration"] == pytest.approx(len(AUDIO) * 8 / 128000)


def test_id3v23_and_wrong_sizes():
    long = "x" * 200
    plain = id3(3, [frame("TIT2", b"\1\xff\xfe" + "Ясень".encode("utf-16-le"), False), frame("TPE1", b"\0" + long.encode(), False), frame("TYER", b"\x001988", False)])
    got = C.read("a.mp3", plain + AUDIO)
    assert (got["title"], got["artist"], got["year"]) == ("Ясень", long, 1988)
    mixed = id3(4, [frame("TPE1", b"\0" + long.encode(), False), frame("TIT2", text("After"))])
    got = C.read("a.mp3", mixed + AUDIO)
    assert (got["artist"], got["title"]) == (long, "After")


def test_id3v22():
    old = lambda name, body: name.encode() + len(body).to_bytes(3) + body
    body = old("TT2", b"\0Old song") + old("TP1", b"\0Somebody") + old("ULT", b"\0eng\0words") + old("PIC", b"\0PNG\3\0img")
    data = b"ID3\2\0\0" + C.safe_bytes(len(body)) + body + AUDIO
    got = C.read("a.mp3", data)
    assert (got["title"], got["artist"], got["lyrics"]) == ("Old song", "Somebody", "words")
    new = C.write("a.mp3", data, {"artist": "Другой"})
    again = C.read("a.mp3", new)
    assert (again["title"], again["artist"], again["lyrics"]) == ("Old song", "Другой", "words")
    assert b"image/png" in new and new.endswith(AUDIO)


def test_old_tag_fills_and_follows():
    data = AUDIO + v1("Nur hier", "Jemand", "Platte")
    got = C.read("a.mp3", data)
    assert (got["title"], got["artist"], got["album"], got["year"], got["trackNo"], got["legacyTag"]) == ("Nur hier", "Jemand", "Platte", 1999, 7, True)
    synced = C.write("a.mp3", data, {"artist": "Neu"})
    assert C.id3v1(synced)["artist"] == "Neu" and C.read("a.mp3", synced)["title"] == "Nur hier"
    assert C.id3v1(C.write("a.mp3", data, {"artist": "Ясень"})) is None  # not in its alphabet
    stripped = C.write("a.mp3", data, {"removeLegacyTag": True})
    assert C.id3v1(stripped) is None and C.read("a.mp3", stripped)["album"] == "Platte"


def test_xing_and_vbri():
    xing = b"\xff\xfb\x90\x00" + b"\0" * 32 + b"Xing" + struct.pack(">II", 1, 1000)
    assert C.mp3_duration(xing + b"\0" * 500, 0) == pytest.approx(1000 * 1152 / 44100)
    vbri = b"\xff\xfb\x90\x00" + b"\0" * 32 + b"VBRI" + b"\0" * 10 + struct.pack(">I", 500)
    assert C.mp3_duration(vbri + b"\0" * 500, 0) == pytest.approx(500 * 1152 / 44100)
    assert C.mp3_duration(b"no audio", 0) == 0


def test_flac():
    data = flac(["Title=A", "artist=B", "ARTIST=C", "album artist=D", "TRACKNUMBER=4/9", "DATE=2001-01-01", "unsynced lyrics=la", "COMPILATION=0", "odd"])
    got = C.read("a.flac", data)
    assert (got["title"], got["artist"], got["albumArtist"], got["trackNo"], got["year"], got["lyrics"], got["duration"]) == ("A", "B", "D", 4, 2001, "la", 10.0)
    new = C.write("a.flac", data, {"artist": "E", "albumArtist": "", "year": 0, "removeCompilation": True})
    got = C.read("a.flac", new)
    assert (got["artist"], got["albumArtist"], got["year"], got["title"]) == ("E", "", 0, "A")
    assert new.endswith(b"audio") and b"odd" in new and b"COMPILATION" not in new
    with pytest.raises(C.BadFile):
        C.read("a.flac", b"nothing")


def test_mp4():
    free = box(b"----", box(b"mean", b"\0" * 4 + b"com") + box(b"name", b"\0" * 4 + b"LYRICS") + C.data_box(1, b"words"))
    items = [box(b"\xa9nam", C.data_box(1, "Имя".encode())), box(b"trkn", C.data_box(0, struct.pack(">4H", 0, 3, 12, 0))), box(b"cpil", C.data_box(21, b"\1")), free, box(b"gnre", C.data_box(0, b"\0\x12"))]
    data = mp4(items)
    got = C.read("a.m4a", data)
    assert (got["title"], got["trackNo"], got["compilation"], got["lyrics"], got["duration"], got["seconds"], got["format"]) == ("Имя", 3, True, "words", 5.4, 5, "M4A")
    new = C.write("a.m4a", data, {"artist": "Somebody new", "trackNo": 5, "genre": "Rock", "lyrics": "", "removeCompilation": True})
    got = C.read("a.m4a", new)
    assert (got["artist"], got["trackNo"], got["genre"], got["lyrics"], got["compilation"]) == ("Somebody new", 5, "Rock", "", False)
    assert b"gnre" not in new and struct.pack(">4H", 0, 5, 12, 0) in new
    at = new.index(b"stco") + 12
    assert new[struct.unpack_from(">I", new, at)[0] :] == b"mdat-bytes"
    assert C.read("a.mp4", mp4([]))["format"] == "MP4"


edits = st.fixed_dictionaries({}, optional={k: st.text(st.characters(exclude_categories=["Cs", "Cc"], exclude_characters=" \xa0"), max_size=20) for k in ("title", "artist", "album", "genre", "albumArtist")} | {k: st.integers(0, 200) for k in ("trackNo", "discNo")})


@settings(max_examples=40, deadline=None)
@given(edits, st.sampled_from(["a.mp3", "a.flac", "a.m4a"]))
def test_what_is_written_is_read(edit, name):
    data = {"a.mp3": id3(4, [frame("TIT2", text("t"))]) + AUDIO, "a.flac": flac(["TITLE=t"]), "a.m4a": mp4([box(b"\xa9nam", C.data_box(1, b"t"))])}[name]
    new = C.write(name, data, edit)
    got = C.read(name, new)
    want = {k: C.clean(v) if isinstance(v, str) else v for k, v in edit.items()}
    assert {k: got[k] for k in want} == want
    assert C.write(name, new, edit) == new  # a second time nothing changes


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "in" / "_a.mp3").write_bytes(id3(4, [frame("TIT2", text("A"))]) + AUDIO)
    (tmp_path / "in" / "b.FLAC").write_bytes(flac(["TITLE=B"]))
    (tmp_path / "in" / "bad.m4a").write_bytes(b"nothing")
    (tmp_path / "in" / "note.txt").write_text("x")
    (tmp_path / ".hidden" / "c.mp3").write_bytes(AUDIO)
    FI.register(spark)
    scanned = spark.read.format("tags").option("filesPerTask", "2").load(str(tmp_path))
    rows = {r.path.rsplit("/", 1)[1]: r for r in scanned.collect()}
    assert set(rows) == {"_a.mp3", "b.FLAC", "bad.m4a"}
    assert rows["_a.mp3"].title == "A" and rows["bad.m4a"].error
    assert FI.failures(scanned).count() == 1 and FI.tracks(scanned).count() == 2
    listed = FI.scan(spark, str(tmp_path / "in"), "*.FLAC").collect()
    assert [r.title for r in listed] == ["B"]


def test_apply_plan(spark, tmp_path):
    from cadenza.operators import planning as P

    path = tmp_path / "a.mp3"
    path.write_bytes(id3(4, [frame("TIT2", text("A")), frame("TPE1", text("x feat. y"))]) + AUDIO)
    FI.register(spark)
    tracks = FI.tracks(spark.read.format("tags").load(str(tmp_path)))
    rules = P.Rules(rename=spark.createDataFrame([("x feat. y", "X")], "name string, keep string"), backup=True)
    plan = P.build(tracks, rules)
    assert [r.error for r in FI.apply_plan(plan).collect()] == [""]
    after = FI.tracks(spark.read.format("tags").load(str(tmp_path)))
    assert after.first().artist == "X" and (tmp_path / "a.mp3.bak").exists()
    assert P.build(after, rules).count() == 0  # a second pass finds nothing to do
    old = (tmp_path / "a.mp3.bak").read_bytes()
    FI.apply_plan(P.build(after, P.Rules(album_artist_mode="fromArtist", backup=True))).collect()
    assert (tmp_path / "a.mp3.bak").read_bytes() == old
