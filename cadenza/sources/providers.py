"""Answers of lyrics services, as JSON columns, decoded to candidates. A text that is no answer of a service gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.markup import lrc_words

#: Fixed value: hits that a search page gives at most.
HITS = 5
LRCLIB = "array<struct<trackName:string,artistName:string,albumName:string,duration:double,instrumental:boolean,plainLyrics:string,syncedLyrics:string>>"
SONGS = "struct<result:struct<songs:array<struct<id:bigint,name:string,duration:bigint,artists:array<struct<name:string>>>>>>"
WORDS = "struct<nolyric:boolean,uncollected:boolean,lrc:struct<lyric:string>>"
SECTIONS = "struct<response:struct<sections:array<struct<type:string,hits:array<struct<type:string,result:struct<id:bigint,title:string,artist_names:string,url:string,primary_artist:struct<name:string>>>>>>>>"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def lrclib_entries(answer: Column) -> Column:
    """array<struct<artist, title, lyrics, synced, duration>> of entries that have words and aren't instrumental."""
    found = F.filter(F.from_json(answer, LRCLIB), lambda e: ~F.coalesce(e.instrumental, F.lit(False)) & (text(e.plainLyrics) != ""))
    return F.transform(found, lambda e: F.struct(text(e.artistName).alias("artist"), text(e.trackName).alias("title"), e.plainLyrics.alias("lyrics"), text(e.syncedLyrics).alias("synced"), F.coalesce(e.duration, F.lit(0.0)).alias("duration")))


def netease_songs(answer: Column) -> Column:
    """array<struct<id, artist, title, url, duration>>; several artists are joined, durations are seconds."""
    found = F.from_json(answer, SONGS).result.songs
    return F.transform(
        found,
        lambda s: F.struct(
            s.id.alias("id"),
            F.array_join(F.transform(F.coalesce(s.artists, F.array().cast("array<struct<name:string>>")), lambda a: text(a["name"])), " & ").alias("artist"),
            text(s["name"]).alias("title"),
            F.concat(F.lit("https://music.163.com/#/song?id="), s.id.cast("string")).alias("url"),
            (F.coalesce(s.duration, F.lit(0)) / 1000.0).alias("duration"),
        ),
    )


def netease_words(answer: Column) -> Column:
    """struct<plain, synced>, both '' for a song without words."""
    a = F.from_json(answer, WORDS)
    silent = F.coalesce(a.nolyric, F.lit(False)) | F.coalesce(a.uncollected, F.lit(False))
    return F.when(a.isNotNull(), lrc_words(F.when(silent, "").otherwise(text(a.lrc.lyric))))


def genius_hits(answer: Column, most: int = HITS) -> Column:
    """array<struct<id, artist, title, url>>: songs of all sections, each address once, in their order; names without translations."""
    sections = F.coalesce(F.from_json(answer, SECTIONS).response.sections, F.array().cast("array<" + SECTIONS.split("array<", 1)[1].rsplit(">", 2)[0]))
    songs = F.filter(F.flatten(F.transform(sections, lambda s: F.coalesce(s.hits, F.array().cast("array<struct<type:string,result:struct<id:bigint,title:string,artist_names:string,url:string,primary_artist:struct<name:string>>>>")))), lambda h: (h.type == "song") & (text(h.result.url) != ""))

    def once(found: Column) -> Column:
        urls = F.transform(found, lambda h: h.result.url)
        fresh = F.filter(found, lambda h, i: F.array_position(urls, h.result.url) == i + 1)
        credit = lambda r: F.when(text(r.artist_names) != "", r.artist_names).otherwise(text(r.primary_artist["name"]))
        return F.transform(F.slice(fresh, 1, most), lambda h: F.struct(h.result.id.alias("id"), T.without_translations(credit(h.result)).alias("artist"), T.without_translation(text(h.result.title)).alias("title"), h.result.url.alias("url")))

    return F.when(F.from_json(answer, SECTIONS).isNotNull(), T.let(songs, once))


def first_by_url(hits: DataFrame, keys: list[str], most: int = HITS) -> DataFrame:
    """Of a search's hits (keys, pos, url) each address once, the first `most` of them."""
    named = hits.filter("url <> ''").groupBy(*keys, "url").agg(F.min_by(F.struct(*(c for c in hits.columns if c not in (*keys, "url"))), "pos").alias("h")).select(*keys, "url", "h.*")
    order = Window.partitionBy(*keys).orderBy("pos")
    return named.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= most).drop("no")
