"""Words out of web pages and timed lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..functions.arrow import containers, unescape

NAMED_REFERENCES = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&amp;": "&"}


def html_text(c: Column, known_only: bool = False) -> Column:
    """A fragment as text; with known_only character references are those of NAMED_REFERENCES, and no Python runs."""
    c = T.replace_all(T.replace_all(T.replace_all(c, W.LINE_BREAK, "\n"), W.BLOCK_END, "\n"), W.ANY_TAG)
    if known_only:
        for name, char in NAMED_REFERENCES.items():
            c = F.replace(c, F.lit(name), F.lit(char))
    else:
        c = unescape(c)
    return T.go_trim(c)


def declared_lyrics(page: Column) -> Column:
    """Words that a page declares in its data, '' if it declares none."""
    found = F.regexp_extract(page, T.rx(W.DECLARED_LYRICS), 1)
    value = F.get(F.from_json(F.concat(F.lit("["), found, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(found == "", "").otherwise(T.go_trim(F.replace(F.coalesce(value, F.lit("")), F.lit("′"), F.lit("'"))))


def broken_section(page: Column) -> Column:
    """The section of a page with the most line breaks, the first of several, as markup; '' if that has too few."""
    page = T.replace_all(page, W.HIDDEN_MARKUP)
    page = T.let(page, lambda v: T.repeated(v, lambda p: F.when(T.matches(p, W.EMPTY_ELEMENT), T.replace_all(p, W.EMPTY_ELEMENT)), T.count_of(v, ">") + 1))
    breaks = lambda p: F.size(F.regexp_extract_all(p, F.lit(T.rx(W.LINE_BREAK)), F.lit(0)))
    counted = F.transform(T.split_on(page, W.SECTION_TAG), lambda p, i: F.struct(breaks(p).alias("n"), (-i).alias("i"), p.alias("p")))
    return T.let(F.array_max(counted), lambda x: F.when(x["n"] >= W.BROKEN_LINES, x["p"]).otherwise(""))


def broken_lines(page: Column, known_only: bool = False) -> Column:
    section = T.replace_all(T.replace_all(broken_section(page), W.SOURCE_BREAK, " "), W.PARA_END, "\n\n")
    lines = F.transform(F.split(html_text(section, known_only), "\n", -1), T.go_trim)
    return F.array_join(lines, "\n")


def any_lyrics(page: Column) -> Column:
    """The fuller of what a page declares and what it prints."""
    return T.let(F.struct(declared_lyrics(page).alias("d"), broken_lines(page).alias("p")), lambda x: F.when(F.octet_length(x["p"]) > F.octet_length(x["d"]), x["p"]).otherwise(x["d"]))


def azlyrics(page: Column) -> Column:
    at = F.regexp_instr(page, F.lit(T.rx(W.AZLYRICS_START)))
    song = F.regexp_extract(F.substring(page, at, F.length(page)), r"(?is)^(.*?)(?:</div>|\z)", 1)
    return broken_lines(F.when(at > 0, song).otherwise(page))


def amalgama(page: Column) -> Column:
    lines = F.regexp_extract_all(page, F.lit(T.rx(W.AMALGAMA_LINE)), F.lit(1))
    shown = F.array_join(F.filter(lines, lambda x: ~T.matches(x, W.LINK_TAG)), "\u0001")
    return T.go_trim(F.regexp_replace(html_text(shown), " *\u0001 *", "\n"))


def page_lyrics(url: Column, page: Column) -> Column:
    """The words of a page, by the reader of its site."""
    site = T.site_name(url)
    return T.tidy_lyrics(F.when(site == "Genius", containers(page)).when(site == "AZLyrics", azlyrics(page)).when(site == "Amalgama", amalgama(page)).otherwise(any_lyrics(page)))


def lrc_words(lrc: Column) -> Column:
    """struct<plain, synced> of timed lines without credits; both '' for a track without words."""
    lines = F.transform(F.split(F.replace(lrc, F.lit("\r"), F.lit("")), "\n", -1), lambda x: F.struct(F.regexp_extract(x, T.rx(W.LRC_TIME), 1).alias("time"), T.go_trim(F.regexp_extract(x, T.rx(W.LRC_TIME), 2)).alias("words")))
    kept = F.filter(lines, lambda x: (x["time"] != "") & ~T.matches(x["words"], W.LRC_CREDIT))

    def result(x: Column) -> Column:
        plain = T.go_trim(F.array_join(F.transform(x, lambda y: y["words"]), "\n"))
        synced = F.array_join(F.transform(x, lambda y: F.concat(y["time"], y["words"])), "\n")
        silent = (plain == "") | lrc.rlike(W.LRC_INSTRUMENTAL)
        return F.struct(F.when(silent, "").otherwise(plain).alias("plain"), F.when(silent, "").otherwise(synced).alias("synced"))

    return T.let(kept, result)
