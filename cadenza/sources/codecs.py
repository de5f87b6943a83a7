"""Tags in the bytes of audio files: MP3 (ID3v1, ID3v2.2 to 2.4), FLAC and MP4. Pure functions of bytes; files are the caller's.

read(name, data) gives a track's fields; write(name, data, edit) the bytes with an edit applied, where a key that is absent or None
leaves its field alone, '' and 0 clear it. Damaged ID3 tags give what can be walked. Pictures are carried, not shrunk.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

FORMATS = {".mp3": "MP3", ".flac": "FLAC", ".m4a": "M4A", ".m4b": "M4A", ".m4p": "M4A", ".mp4": "MP4", ".aac": "M4A"}
TAG_LIMIT = 3145728
#: Keys that hold a field under other names, without case, spaces, underscores and dashes.
KEYS = {
    "albumArtist": ("ALBUMARTIST", "TPE2"),
    "compilation": ("COMPILATION", "ITUNESCOMPILATION", "TCMP"),
    "sort": ("ALBUMARTISTSORT", "ALBUMARTISTSORTORDER", "SORTALBUMARTIST", "TSO2"),
    "lyrics": ("LYRICS", "UNSYNCEDLYRICS", "UNSYNCHRONISEDLYRICS"),
}
FRAMES = {"title": "TIT2", "artist": "TPE1", "albumArtist": "TPE2", "album": "TALB", "genre": "TCON", "trackNo": "TRCK", "discNo": "TPOS"}
OLD_FRAMES = {"TT2": "TIT2", "TP1": "TPE1", "TP2": "TPE2", "TP3": "TPE3", "TAL": "TALB", "TCO": "TCON", "TRK": "TRCK", "TPA": "TPOS", "TYE": "TYER", "TCP": "TCMP", "TS2": "TSO2", "TXX": "TXXX", "ULT": "USLT", "COM": "COMM", "PIC": "APIC", "TCM": "TCOM", "TEN": "TENC", "TSS": "TSSE", "TBP": "TBPM", "TPB": "TPUB", "TCR": "TCOP"}
COMMENTS = {"title": "TITLE", "artist": "ARTIST", "album": "ALBUM", "genre": "GENRE", "trackNo": "TRACKNUMBER", "discNo": "DISCNUMBER", "year": "DATE"}
ATOMS = {"title": b"\xa9nam", "artist": b"\xa9ART", "album": b"\xa9alb", "genre": b"\xa9gen", "albumArtist": b"aART", "lyrics": b"\xa9lyr", "year": b"\xa9day"}
PAIRS = {"trackNo": b"trkn", "discNo": b"disk"}
#: kbit/s of MPEG 1 and of MPEG 2 and 2.5, Layer III; samples a second by version bits.
BITRATES = {True: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0), False: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0)}
RATES = {3: (44100, 48000, 32000, 0), 2: (22050, 24000, 16000, 0), 0: (11025, 12000, 8000, 0)}
NUMBERS = ("year", "trackNo", "discNo")


class BadFile(ValueError):
    """The file isn't what its name says."""


def blank() -> dict:
    return {"title": "", "artist": "", "albumArtist": "", "album": "", "genre": "", "lyrics": "", "trackNo": 0, "discNo": 0, "year": 0, "compilation": False, "hasSort": False, "legacyTag": False, "tagBytes": 0, "duration": 0.0}


def clean(text: str) -> str:
    parts = (re.sub(r"[\x00-\x08\x0b-\x1f]", "", p).strip() for p in text.split("\0"))
    return "; ".join(p for p in parts if p)


def number(text: str) -> int:
    m = re.match(r"\s*([0-9]+)", text)
    return int(m[1]) if m else 0


def year(text: str) -> int:
    return int(text[:4]) if re.match(r"[+-]?[0-9]+\Z", text[:4]) and len(text) >= 4 else 0


def truthy(text: str) -> bool:
    return text.strip() not in ("", "0", "false", "no")


def known_as(key: str, what: str) -> bool:
    return re.sub(r"[ _-]", "", key.strip().upper()) in KEYS[what]


def shown(n: int) -> str:
    return str(n) if n > 0 else ""


def take(track: dict, key: str, value: str) -> None:
    """A field under a free key: the first album artist and words count, flags are set."""
    if known_as(key, "albumArtist"):
        track["albumArtist"] = track["albumArtist"] or value
    elif known_as(key, "lyrics"):
        track["lyrics"] = track["lyrics"] or value
    elif known_as(key, "compilation"):
        track["compilation"] = track["compilation"] or truthy(value)
    elif known_as(key, "sort"):
        track["hasSort"] = track["hasSort"] or value != ""


def dropped_keys(edit: dict) -> set[str]:
    """Which groups of free keys an edit takes away."""
    out = {k for k in ("albumArtist", "lyrics") if edit.get(k) is not None}
    return out | {k for k, flag in (("compilation", "removeCompilation"), ("sort", "removeAlbumArtistSort")) if edit.get(flag)}


# ID3 --------------------------------------------------------------------------


def synchsafe(raw: bytes) -> int:
    return sum((b & 0x7F) << 7 * i for i, b in enumerate(reversed(raw)))


def safe_bytes(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


@dataclass
class ID3:
    version: int = 0
    frames: list[tuple[str, bytes]] = field(default_factory=list)
    end: int = 0  # where the audio begins
    size: int = 0
    damaged: bool = False


def parse_id3(data: bytes) -> ID3:
    if data[:3] != b"ID3" or len(data) < 10:
        return ID3()
    tag = ID3(data[3], end=10 + synchsafe(data[6:10]), size=10 + synchsafe(data[6:10]))
    body = data[10 : tag.end]
    tag.end += 10 if data[5] & 0x10 else 0
    wide, at = (3, 0) if tag.version == 2 else (4, 0)
    if tag.version >= 3 and data[5] & 0x40 and len(body) >= 4:
        at = synchsafe(body[:4]) if tag.version >= 4 else 4 + int.from_bytes(body[:4])
    head = 2 * wide if wide == 3 else 10
    while at + head <= len(body):
        name = body[at : at + wide]
        if not re.fullmatch(rb"[A-Z0-9]+", name):
            tag.damaged |= name[0] != 0
            break
        start = at + head
        size = frame_size(tag, body, start, body[at + wide : at + 2 * wide])
        if size is None:
            tag.damaged = True
            break
        tag.frames.append((OLD_FRAMES.get(name.decode(), "") if wide == 3 else name.decode(), body[start : start + size]))
        at = start + size
    return tag


def frame_size(tag: ID3, body: bytes, start: int, raw: bytes) -> int | None:
    """A frame's length: as its version writes it, else the other way round, if that leads to a frame, to padding or to the end."""
    if tag.version == 2:
        size = int.from_bytes(raw)
        return size if start + size <= len(body) else None
    choices = [synchsafe(raw), int.from_bytes(raw)] if tag.version >= 4 else [int.from_bytes(raw), synchsafe(raw)]
    for i, size in enumerate(choices):
        after = body[start + size : start + size + 4]
        fits = start + size <= len(body)
        if fits and (start + size + 10 > len(body) or after[:1] == b"\0" or re.fullmatch(rb"[A-Z0-9]{4}", after)):
            tag.damaged |= i > 0
            return size
    tag.damaged = True
    return choices[0] if start + choices[0] <= len(body) else None


def text_in(encoding: int, raw: bytes) -> str:
    if encoding == 0:
        return raw.decode("latin-1")
    if encoding == 3:
        return raw.decode("utf-8", "replace")
    even = raw[: len(raw) - len(raw) % 2]
    if encoding == 2:
        return even.decode("utf-16-be", "replace")
    return even[2:].decode("utf-16-be", "replace") if even[:2] == b"\xfe\xff" else even.removeprefix(b"\xff\xfe").decode("utf-16-le", "replace")


def halves(encoding: int, raw: bytes) -> tuple[bytes, bytes]:
    """Two strings that a terminator of the encoding's width separates."""
    wide = 2 if encoding in (1, 2) else 1
    for i in range(0, len(raw) - wide + 1, wide):
        if raw[i : i + wide] == b"\0" * wide:
            return raw[:i], raw[i + wide :]
    return raw, b""


def frame_text(body: bytes) -> str:
    return text_in(body[0], body[1:]).rstrip("\0") if body else ""


def keyed_text(body: bytes, language: bool = False) -> tuple[str, str]:
    """Description and text of a frame that has both."""
    if not body:
        return "", ""
    a, b = halves(body[0], body[4 if language else 1 :])
    return text_in(body[0], a), text_in(body[0], b).rstrip("\0")


def id3v1(data: bytes) -> dict | None:
    raw = data[-128:]
    if len(raw) < 128 or raw[:3] != b"TAG":
        return None

    def text(a: int, b: int) -> str:
        own = raw[a:b].rstrip(b"\0 ")
        try:
            return clean(own.decode("utf-8"))
        except UnicodeDecodeError:
            return clean(own.decode("latin-1"))

    return {"title": text(3, 33), "artist": text(33, 63), "album": text(63, 93), "year": text(93, 97), "genre": raw[127], "trackNo": raw[126] if raw[125] == 0 else 0}


def mp3_duration(data: bytes, start: int) -> float:
    audio = data[start : start + 8192]
    for at in range(len(audio) - 3):
        b = audio[at : at + 4]
        version = b[1] >> 3 & 3
        if b[0] != 0xFF or b[1] & 0xE0 != 0xE0 or version == 1 or b[1] >> 1 & 3 != 1:
            continue
        rate = RATES[version][b[2] >> 2 & 3]
        if not rate:
            continue
        first, mono = version == 3, b[3] >> 6 == 3
        side = (17 if mono else 32) if first else (9 if mono else 17)
        frame = audio[at:]
        for place, names, counts in ((4 + side, (b"Xing", b"Info"), 8), (36, (b"VBRI",), 14)):
            head = frame[place : place + 4]
            said = names[0] == b"VBRI" or len(frame) > place + 7 and frame[place + 7] & 1
            count = int.from_bytes(frame[place + counts : place + counts + 4]) if head in names and said else 0
            if count:
                return count * (1152 if first else 576) / rate
        kbits = BITRATES[first][b[2] >> 4]
        return (len(data) - start - at) * 8 / (kbits * 1000) if kbits else 0.0
    return 0.0


def read_mp3(data: bytes) -> dict:
    track, tag = blank(), parse_id3(data)
    if data[:3] == b"ID3" and tag.version >= 3 and not tag.frames and tag.damaged:
        raise BadFile("the tag at the front can't be read")
    tidy = clean if tag.version >= 3 and not tag.damaged else (lambda s: s)
    by_name = {v: k for k, v in FRAMES.items()}
    years = {}
    for name, body in tag.frames:
        if name in by_name:
            key, text = by_name[name], frame_text(body)
            track[key] = number(text) if key in NUMBERS else tidy(text)
        elif name in ("TDRC", "TYER"):
            years.setdefault(name, year(frame_text(body)))
        elif name == "TCMP":
            track["compilation"] = truthy(frame_text(body))
        elif name == "TSO2":
            track["hasSort"] = frame_text(body) != ""
        elif name == "USLT":
            track["lyrics"] = track["lyrics"] or keyed_text(body, True)[1]
    for name, body in tag.frames:
        if name == "TXXX":
            key, value = keyed_text(body)
            take(track, key, value if known_as(key, "lyrics") else tidy(value))
    track["year"] = years.get("TDRC", 0) or years.get("TYER", 0)
    track["duration"], track["tagBytes"] = mp3_duration(data, tag.end), tag.size
    old = id3v1(data) if tag.version != 2 else None
    if old:
        track["legacyTag"] = True
        if not (track["title"] and track["artist"] and track["album"]):
            for key in ("title", "artist", "album"):
                track[key] = track[key] or old[key]
            track["year"] = track["year"] or year(old["year"])
            track["trackNo"] = track["trackNo"] or old["trackNo"]
    return track


def in_utf8(name: str, body: bytes) -> bytes:
    """A frame's body with its text in UTF-8; pictures and other data as they are."""
    if not body or body[0] > 3:
        return body
    if name == "TXXX":
        key, value = keyed_text(body)
        return b"\3" + key.encode() + b"\0" + value.encode()
    if name in ("USLT", "COMM") and len(body) >= 4:
        key, value = keyed_text(body, True)
        return b"\3" + body[1:4] + key.encode() + b"\0" + value.encode()
    return b"\3" + frame_text(body).encode() if name[0] == "T" else body


def picture_frame(body: bytes) -> bytes:
    """A picture of an ID3v2.2 tag, whose three letters become a media type."""
    kind = body[1:4].decode("latin-1").lower()
    return body[:1] + f"image/{ {'jpg': 'jpeg', 'jpe': 'jpeg'}.get(kind, kind) }".encode() + b"\0" + body[4:]


def write_mp3(data: bytes, edit: dict) -> bytes:
    tag, old = parse_id3(data), id3v1(data)
    frames = [(n, picture_frame(b) if tag.version == 2 and n == "APIC" else b) for n, b in tag.frames if n]
    frames = [(n, in_utf8(n, b)) for n, b in frames]

    def put(name: str, text: str) -> None:
        frames[:] = [f for f in frames if f[0] != name]
        if text:
            frames.append((name, b"\3" + text.encode()))

    for key, name in FRAMES.items():
        if edit.get(key) is not None:
            put(name, shown(edit[key]) if key in NUMBERS else edit[key])
    if edit.get("year") is not None:
        put("TYER", "")
        put("TDRC", shown(edit["year"]))
    for flag, name in (("removeCompilation", "TCMP"), ("removeAlbumArtistSort", "TSO2")):
        if edit.get(flag):
            put(name, "")
    if edit.get("lyrics") is not None:
        put("USLT", "")
        if edit["lyrics"]:
            frames.append(("USLT", b"\3xxx\0" + edit["lyrics"].encode()))
    gone = dropped_keys(edit) - ({"albumArtist"} if edit.get("albumArtist") else set())
    frames = [f for f in frames if not (f[0] == "TXXX" and any(known_as(keyed_text(f[1])[0], g) for g in gone))]
    has = {n for n, b in frames if frame_text(b)}
    if old:
        for name, text in (("TIT2", old["title"]), ("TPE1", old["artist"]), ("TALB", old["album"]), ("TDRC", old["year"]), ("TRCK", shown(old["trackNo"]))):
            if text and name not in has:
                frames.append((name, b"\3" + text.encode()))
    frames.sort(key=lambda f: f[0])
    body = b"".join(n.encode() + safe_bytes(len(b)) + b"\0\0" + b for n, b in frames)
    out = (b"ID3\4\0\0" + safe_bytes(len(body)) + body if body else b"") + without_id3v1(data[tag.end :])
    if (old or len(body) > TAG_LIMIT) and (not edit.get("removeLegacyTag") or len(body) > TAG_LIMIT):
        texts = {n: frame_text(b) for n, b in frames}
        values = [texts.get(n, "") for n in ("TIT2", "TPE1", "TALB")] + [texts.get("TDRC") or texts.get("TYER", "")]
        if all(ord(c) < 256 for v in values for c in v):
            fixed = b"".join(v.encode("latin-1")[:w].ljust(w, b"\0") for v, w in zip(values, (30, 30, 30, 4)))
            no = number(texts.get("TRCK", ""))
            out += b"TAG" + fixed + b"\0" * 29 + bytes([no if no < 256 else 0, old["genre"] if old else 255])
    return out


def without_id3v1(data: bytes) -> bytes:
    if data[-128:-125] == b"TAG" and len(data) >= 128:
        data = data[:-128]
        if data[-227:-223] == b"TAG+":
            data = data[:-227]
    return data


# FLAC -------------------------------------------------------------------------


def flac_blocks(data: bytes) -> tuple[list[tuple[int, bytes]], int]:
    """Metadata blocks (type, body), and where the audio begins."""
    if data[:4] != b"fLaC":
        raise BadFile("no FLAC stream")
    blocks, at, last = [], 4, False
    while not last:
        if at + 4 > len(data):
            raise BadFile("a metadata block is cut off")
        last, size = bool(data[at] & 0x80), int.from_bytes(data[at + 1 : at + 4])
        blocks.append((data[at] & 0x7F, data[at + 4 : at + 4 + size]))
        at += 4 + size
    return blocks, at


def vorbis(body: bytes) -> tuple[bytes, list[str]]:
    """Vendor and comments."""
    try:
        size = struct.unpack_from("<I", body)[0]
        vendor, at = body[4 : 4 + size], 8 + size
        out = []
        for _ in range(struct.unpack_from("<I", body, 4 + size)[0]):
            n = struct.unpack_from("<I", body, at)[0]
            out.append(body[at + 4 : at + 4 + n].decode("utf-8", "replace"))
            at += 4 + n
    except struct.error:
        raise BadFile("the comments are cut off") from None
    return vendor, out


def read_flac(data: bytes) -> dict:
    track = blank()
    blocks, _ = flac_blocks(data)
    track["tagBytes"] = sum(4 + len(b) for _, b in blocks)
    for kind, body in blocks:
        if kind == 0 and len(body) >= 18:
            packed = int.from_bytes(body[10:18])
            rate, samples = packed >> 44, packed & 0xFFFFFFFFF
            track["duration"] = samples / rate if rate else 0.0
    names = {v: k for k, v in COMMENTS.items()}
    comments = next((vorbis(b)[1] for k, b in blocks if k == 4), [])
    for key, found, value in (c.partition("=") for c in comments):
        value, plain = clean(value), re.sub(r"[ _-]", "", key.strip().upper())
        if not found:
            continue
        if plain in names:
            name = names[plain]
            if name == "artist":
                track["artist"] = track["artist"] or value
            else:
                track[name] = year(value) if name == "year" else number(value) if name in NUMBERS else value
        elif known_as(key, "compilation"):
            track["compilation"] = truthy(value)
        else:
            take(track, key, value)
    return track


def edited_comments(comments: list[str], edit: dict) -> list[str]:
    new = {k: shown(edit[k]) if k in NUMBERS else edit[k] for k in (*COMMENTS, "albumArtist", "lyrics") if edit.get(k) is not None}
    groups = dropped_keys(edit)
    plain = {COMMENTS[k] for k in new if k in COMMENTS}
    keep = [c for c in comments if "=" not in c or not (re.sub(r"[ _-]", "", c.partition("=")[0].strip().upper()) in plain or any(known_as(c.partition("=")[0], g) for g in groups))]
    order = ("artist", "albumArtist", "album", "title", "genre", "lyrics", "year", "trackNo", "discNo")
    names = COMMENTS | {"albumArtist": "ALBUMARTIST", "lyrics": "LYRICS"}
    return keep + [f"{names[k]}={new[k]}" for k in order if new.get(k)]


def write_flac(data: bytes, edit: dict) -> bytes:
    blocks, start = flac_blocks(data)
    at = next((i for i, (k, _) in enumerate(blocks) if k == 4), None)
    vendor, comments = vorbis(blocks[at][1]) if at is not None else (b"cadenza", [])
    coded = [c.encode() for c in edited_comments(comments, edit)]
    body = struct.pack("<I", len(vendor)) + vendor + struct.pack("<I", len(coded)) + b"".join(struct.pack("<I", len(c)) + c for c in coded)
    if at is None:
        blocks.append((4, body))
    else:
        blocks[at] = (4, body)
    heads = b"".join(bytes([k | (0x80 if i == len(blocks) - 1 else 0)]) + len(b).to_bytes(3) + b for i, (k, b) in enumerate(blocks))
    return b"fLaC" + heads + data[start:]


# MP4 --------------------------------------------------------------------------

INNER = {b"moov", b"udta", b"ilst", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"mvex"}


@dataclass
class Box:
    kind: bytes
    body: bytes = b""
    kids: list[Box] | None = None
    head: bytes = b""  # what stands before the children, in a meta box

    def coded(self) -> bytes:
        body = self.body if self.kids is None else self.head + b"".join(k.coded() for k in self.kids)
        return (struct.pack(">I4s", 8 + len(body), self.kind) if len(body) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, self.kind, 16 + len(body))) + body

    def find(self, *path: bytes) -> Box | None:
        box = self
        for kind in path:
            box = next((k for k in box.kids or () if k.kind == kind), None)
            if box is None:
                return None
        return box


def boxes(data: bytes, inner: set[bytes] | None = None) -> list[Box]:
    inner = INNER if inner is None else inner
    out, at = [], 0
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= len(data):
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or len(data) - at
        if size < head or at + size > len(data):
            raise BadFile("a box doesn't fit")
        body = data[at + head : at + size]
        if kind in inner:
            out.append(Box(kind, kids=boxes(body, inner)))
        elif kind == b"meta" and inner:
            lead = 0 if body[4:8] == b"hdlr" else 4  # without version and flags in some writers' files
            out.append(Box(kind, kids=boxes(body[lead:], inner), head=body[:lead]))
        else:
            out.append(Box(kind, body))
        at += size
    return out


def top_boxes(data: bytes) -> list[tuple[bytes, int, int]]:
    """Kind, place and size of the boxes of a file."""
    out, at = [], 0
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if size == 1 and at + 16 <= len(data):
            size = int.from_bytes(data[at + 8 : at + 16])
        size = size or len(data) - at
        if size < 8:
            break
        out.append((kind, at, size))
        at += size
    return out


def movie(data: bytes) -> tuple[Box, int, int]:
    for kind, at, size in top_boxes(data):
        if kind == b"moov" and at + size <= len(data):
            return boxes(data[at : at + size])[0], at, size
    raise BadFile("no movie box")


def payload(body: bytes) -> tuple[bytes, int]:
    """Value and type of an item's data box; type -1: none."""
    if len(body) >= 16 and body[4:8] == b"data" and 16 <= int.from_bytes(body[:4]) <= len(body):
        return body[16 : int.from_bytes(body[:4])], int.from_bytes(body[8:12])
    return b"", -1


def item_text(body: bytes) -> str:
    value, kind = payload(body)
    return clean(value.decode("utf-8", "replace")) if kind in (0, 1) else ""


def freeform(body: bytes) -> tuple[str, str]:
    key = value = ""
    try:
        for box in boxes(body, set()):
            if box.kind == b"name" and len(box.body) > 4:
                key = box.body[4:].decode("utf-8", "replace")
            elif box.kind == b"data" and len(box.body) >= 8 and int.from_bytes(box.body[:4]) in (0, 1):
                value = box.body[8:].decode("utf-8", "replace")
    except BadFile:
        return "", ""
    return key, value


def read_mp4(data: bytes) -> dict:
    track = blank()
    moov, _, size = movie(data)
    track["tagBytes"] = size
    head = moov.find(b"mvhd")
    if head and len(head.body) >= 20:
        wide = head.body[0] == 1
        if not wide or len(head.body) >= 32:
            scale, units = struct.unpack_from(">IQ" if wide else ">II", head.body, 20 if wide else 12)
            track["duration"] = units / scale if scale else 0.0
    items = moov.find(b"udta", b"meta", b"ilst")
    names = {v: k for k, v in ATOMS.items()}
    pairs = {v: k for k, v in PAIRS.items()}
    for item in items.kids if items else ():
        if item.kind in names:
            name, text = names[item.kind], item_text(item.body)
            track[name] = year(text) if name == "year" else text
        elif item.kind in pairs:
            value, _ = payload(item.body)
            track[pairs[item.kind]] = int.from_bytes(value[2:4]) if len(value) >= 4 else 0
        elif item.kind == b"cpil":
            track["compilation"] = any(payload(item.body)[0])
        elif item.kind == b"soaa":
            track["hasSort"] = True
        elif item.kind == b"----":
            key, value = freeform(item.body)
            if known_as(key, "sort"):
                track["hasSort"] = True
            elif known_as(key, "compilation"):
                track["compilation"] = track["compilation"] or value not in ("", "0")
            else:
                take(track, key, value)
    return track


def data_box(kind: int, value: bytes) -> bytes:
    return struct.pack(">I4sII", 16 + len(value), b"data", kind, 0) + value


def write_mp4(data: bytes, edit: dict) -> bytes:
    moov, at, size = movie(data)
    box = moov
    for kind in (b"udta", b"meta", b"ilst"):
        found = box.find(kind)
        if found is None:
            handler = Box(b"hdlr", b"\0" * 8 + b"mdirappl" + b"\0" * 9)
            found = Box(kind, kids=[handler] if kind == b"meta" else [], head=b"\0" * 4 if kind == b"meta" else b"")
            box.kids.append(found)
        box = found

    def put(kind: bytes, value: bytes | None) -> None:
        new = [] if value is None else [Box(kind, value)]
        place = next((i for i, k in enumerate(box.kids) if k.kind == kind), len(box.kids))
        rest = [k for k in box.kids if k.kind != kind]
        box.kids = rest[:place] + new + rest[place:]

    for key, kind in ATOMS.items():
        if edit.get(key) is not None:
            text = shown(edit[key]) if key == "year" else edit[key]
            put(kind, data_box(1, text.encode()) if text else None)
    if edit.get("genre") is not None:
        put(b"gnre", None)
    for key, kind in PAIRS.items():
        if edit.get(key) is not None:
            old = box.find(kind)
            total = (payload(old.body)[0] if old else b"")[4:6].rjust(2, b"\0")
            put(kind, data_box(0, b"\0\0" + edit[key].to_bytes(2) + total + b"\0\0") if edit[key] > 0 else None)
    for flag, kind in (("removeCompilation", b"cpil"), ("removeAlbumArtistSort", b"soaa")):
        if edit.get(flag):
            put(kind, None)
    gone = dropped_keys(edit) - {k for k in ("albumArtist", "lyrics") if edit.get(k)}
    box.kids = [k for k in box.kids if not (k.kind == b"----" and any(known_as(freeform(k.body)[0], g) for g in gone))]
    delta = len(moov.coded()) - size
    shift(moov, delta, at + size)
    return data[:at] + moov.coded() + data[at + size :]


def shift(box: Box, delta: int, after: int) -> None:
    """Move chunk offsets that point behind the movie box."""
    for kid in box.kids or ():
        if kid.kind in (b"stco", b"co64") and len(kid.body) >= 8:
            code = ">%dI" if kid.kind == b"stco" else ">%dQ"
            n = min(int.from_bytes(kid.body[4:8]), (len(kid.body) - 8) // (4 if kid.kind == b"stco" else 8))
            places = struct.unpack_from(code % n, kid.body, 8)
            kid.body = kid.body[:8] + struct.pack(code % n, *(p + delta if p >= after else p for p in places)) + kid.body[8 + struct.calcsize(code % n) :]
        shift(kid, delta, after)


# Files ------------------------------------------------------------------------

READ = {"MP3": read_mp3, "FLAC": read_flac, "M4A": read_mp4, "MP4": read_mp4}
WRITE = {"MP3": write_mp3, "FLAC": write_flac, "M4A": write_mp4, "MP4": write_mp4}


def format_of(name: str) -> str | None:
    m = re.search(r"\.[^./]*\Z", name)
    return FORMATS.get(m[0].lower()) if m else None


def read(name: str, data: bytes) -> dict:
    kind = format_of(name)
    if kind is None:
        raise BadFile("unsupported format")
    track = READ[kind](data)
    seconds = track.pop("duration")
    return {"path": name, "format": kind, **track, "hasLyrics": track["lyrics"].strip() != "", "duration": seconds, "seconds": int(seconds + 0.5)}


def is_empty(edit: dict) -> bool:
    return all(v is None or v is False for k, v in edit.items() if k not in ("path", "backup"))


def write(name: str, data: bytes, edit: dict) -> bytes:
    kind = format_of(name)
    if kind is None:
        raise BadFile("unsupported format")
    return data if is_empty(edit) else WRITE[kind](data, edit)
