"""What Spark has no function for: Unicode composition, character references, nested markup, old code pages, lenient XML. Arrow batches, never rows."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W

FLAGS = re.I | re.S


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))


#: The same, but never computed twice: a deterministic function of Python is, where its result is both filtered and selected.
nfc_once = F.pandas_udf(nfc.func, T.StringType()).asNondeterministic()


def composed(c):
    """Text in composed form (NFC); a sentinel for texts that are already, which is nearly all, keeps them from being sent to Python as they are."""
    plain = c.isNull() | ~c.rlike(r"[^\x00-\x{2ff}]")  # nothing below U+0300 combines
    return F.when(plain, c).otherwise(nfc(F.when(~plain, c)))


@F.pandas_udf(T.StringType())
def unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: v if v is None or "&" not in v else html.unescape(v))


def text_of(fragment: str) -> str:
    """A fragment of markup as text: breaks and ends of blocks are line ends, other tags go."""
    fragment = re.sub(r"<br\s*/?>|</(?:div|p)>", "\n", fragment, flags=re.I)
    return html.unescape(re.sub(W.ANY_TAG, "", fragment)).strip()


def element_end(page: str, start: int) -> int:
    """Where the div that opens before `start` ends, tag included."""
    depth = 1
    for m in re.finditer(r"<(/?)div\b", page[start:], re.I):
        depth += -1 if m[1] else 1
        if not depth:
            end = page.find(">", start + m.start())
            return len(page) if end < 0 else end + 1
    return len(page)


def container_text(page: str) -> str:
    """The text of all lyrics containers, without the blocks in them that are marked as no part of the words."""
    parts, at = [], 0
    opens = re.compile(W.LYRICS_CONTAINER.replace("(?i)", ""), re.I | re.A)
    excluded = re.compile(W.EXCLUDED_BLOCK.replace("(?i)", ""), re.I | re.A)
    while m := opens.search(page, at):
        at = element_end(page, m.end())
        inner = re.sub(r"</div\s*>\Z", "", page[m.end() : at], flags=re.I)
        while x := excluded.search(inner):
            inner = inner[: x.start()] + inner[element_end(inner, x.end()) :]
        parts.append(text_of(inner))
    return "\n".join(parts).strip()


@F.pandas_udf(T.StringType())
def containers(pages: pd.Series) -> pd.Series:
    return pages.map(lambda p: None if p is None else container_text(p))


def decoded(data: bytes) -> str:
    """Text of a playlist file: byte order marks, UTF-16 without one, UTF-8, else the Windows code page that the bytes look like."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data[2 : len(data) - len(data) % 2].decode("utf-16-le" if data[:1] == b"\xff" else "utf-16-be", "replace")
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8", "replace")
    if len(data) >= 4 and len(data) % 2 == 0:
        zero = [b == 0 for b in data[:4]]
        if zero == [False, True, False, True]:
            return data.decode("utf-16-le", "replace")
        if zero == [True, False, True, False]:
            return data.decode("utf-16-be", "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        high = sum(b >= 0x80 for b in data)
        upper = sum(b >= 0xC0 for b in data)
        letters = sum(b >= 0x80 or chr(b | 0x20) in "abcdefghijklmnopqrstuvwxyz" for b in data)
        cyrillic = high and upper * 10 >= high * 8 and high * 4 >= letters
        return data.decode("windows-1251" if cyrillic else "windows-1252", "replace")


@F.pandas_udf(T.StringType())
def decode_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else decoded(bytes(v)))


ENTRY = T.ArrayType(T.StructType([T.StructField("location", T.StringType()), T.StructField("title", T.StringType()), T.StructField("artist", T.StringType()), T.StructField("duration", T.IntegerType())]))
PLAYLISTS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("entries", ENTRY)]))


class Node(list):
    """An element: children, local name, attributes, and the text before its first child."""

    def __init__(self, tag: str, attributes: dict):
        super().__init__()
        self.tag, self.attributes, self.text = tag, attributes, ""

    def get(self, name: str):
        return self.attributes.get(name)

    def find(self, name: str):
        return next((c for c in self if c.tag == name), None)

    def iter(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node))


class Lenient(HTMLParser):
    """Reads markup that isn't well-formed: names of HTML's characters, bare ampersands, elements that never end or end too late."""

    #: Elements that HTML never closes.
    ALONE = frozenset("basefont br area link img param hr input col frame isindex base meta".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open_ = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag.rpartition(":")[2], {k.rpartition(":")[2]: v or "" for k, v in attrs})
        self.open_[-1].append(node)
        if tag not in self.ALONE:
            self.open_.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open_[-1].append(Node(tag.rpartition(":")[2], {k.rpartition(":")[2]: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        name = tag.rpartition(":")[2]
        if any(n.tag == name for n in self.open_[1:]):
            while self.open_.pop().tag != name:
                pass

    def handle_data(self, data):
        if not self.open_[-1]:
            self.open_[-1].text += data

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def parsed(data: bytes):
    """A tree by local names, read strictly where that works and leniently where not; None where there is no element."""
    import xml.etree.ElementTree as E

    try:
        root = E.fromstring(data)
    except (E.ParseError, ValueError, LookupError):
        reader = Lenient()
        reader.feed(data.decode("utf-8-sig", "replace"))
        reader.close()
        return next(iter(reader.root), None)
    for node in root.iter():
        if isinstance(node.tag, str):
            node.tag = node.tag.rpartition("}")[2]
    return root


def inner(node, name: str) -> str:
    found = next((c for c in node if c.tag.lower() == name), None)
    return "" if found is None else (found.text or "").strip()


def leading(text: str | None) -> int:
    m = re.match(r"\s*([0-9]+)", text or "")
    return int(m[1]) if m else 0


def entry(location: str, title: str = "", artist: str = "", seconds: int = 0) -> dict:
    return {"location": location, "title": title, "artist": artist, "duration": seconds if seconds > 0 else -1}


def xspf_entries(data: bytes) -> list[dict] | None:
    root = parsed(data)
    if root is None:
        return None
    tracks = [t for t in root.iter() if isinstance(t.tag, str) and t.tag.lower() == "track"]
    place = lambda x: x if x[:5].lower() == "file:" else unquote(x)
    return [entry(place(inner(t, "location")), inner(t, "title"), inner(t, "creator"), leading(inner(t, "duration")) // 1000) for t in tracks if inner(t, "location")]


def wpl_entries(data: bytes) -> list[dict] | None:
    root = parsed(data)
    if root is None:
        return None
    return [entry(m.get("src")) for m in root.iter() if isinstance(m.tag, str) and m.tag.lower() == "media" and m.get("src")]


def keyed(node) -> dict:
    """The values of a plist dictionary by key."""
    nodes = list(node) if node is not None else []
    return {k.text or "": v for k, v in zip(nodes, nodes[1:]) if k.tag == "key"}


def itunes_playlists(data: bytes) -> list[dict]:
    root = parsed(data)
    library = None if root is None or root.tag.lower() != "plist" else root.find("dict")
    if library is None:
        return []
    top = keyed(library)
    tracks = {k: keyed(v) for k, v in keyed(top.get("Tracks")).items()}
    value = lambda d, k: (d[k].text or "") if k in d else ""
    holds = lambda d, k: k in d and d[k].tag == "true"
    out = []
    for item in top.get("Playlists", ()):
        info = keyed(item)
        if holds(info, "Master") or holds(info, "Folder") or "Distinguished Kind" in info or ("Visible" in info and not holds(info, "Visible")):
            continue
        members = (tracks.get(value(keyed(m), "Track ID").strip(), {}) for m in info.get("Playlist Items", ()))
        entries = [entry(value(t, "Location").strip(), value(t, "Name"), value(t, "Artist"), leading(value(t, "Total Time")) // 1000) for t in members if value(t, "Location").strip()]
        if entries:
            out.append({"name": value(info, "Name") or "Playlist", "entries": entries})
    return out


@F.udf(ENTRY, useArrow=True)
def read_xspf(data):
    return None if data is None else xspf_entries(bytes(data))


@F.udf(ENTRY, useArrow=True)
def read_wpl(data):
    return None if data is None else wpl_entries(bytes(data))


@F.udf(PLAYLISTS, useArrow=True)
def read_itunes_xml(data):
    return None if data is None else itunes_playlists(bytes(data))
