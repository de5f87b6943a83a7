"""Queries on artists, albums and plans over the derived tracks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators import library as L
from ..operators import planning as P
from . import tracks as V
from .oracle import TRACKS, album_key, clean_title, disc_of, junk, key, lead, lead_kind, quality, strip_album, strip_disc, trim, unwatermark

NAMES = f"""{TRACKS},
occ as (select name, album from tracks, unnest(list_distinct([{trim('artist')}, {trim('albumArtist')}])) u(name) where name <> ''),
names as (select name, count(*) tracks, count(distinct nullif(album, '')) albums from occ group by name)"""
CREDITS = f"""{NAMES},
credits as (select *, {key('lead')} as key from (select name, tracks, {lead('name')} as lead, {lead_kind('name')} as kind from names)),
best as (select key, arg_min(lead, (-n, -{quality('lead')}, lead)) as target from (select key, lead, sum(tracks) n from credits group by key, lead) group by key)"""
ALBUMS = f"""{TRACKS},
named as (select path, compilation, {trim('album')} as value, case when {trim('albumArtist')} <> '' then {trim('albumArtist')} else {trim('artist')} end as raw from tracks),
leads as (select path, compilation, value, {lead('raw')} as lead from named where value <> ''),
owned as (select path, compilation, value, case when compilation then 'Various artists' else lead end as name, case when not compilation then {key('lead')} end as owner from leads),
keyed as (select value, {album_key('value')} as album_key from (select distinct value from owned)),
parts as (select owner, value, name, album_key, count(*) as tracks from owned join keyed using (value) group by all),
into_ as (select album_key, arg_min(owner, (-n, owner, value)) as into_owner from (select owner, value, album_key, sum(tracks) n from parts where owner is not null group by all) group by album_key),
joined as (select coalesce(owner, into_owner) as owner, owner is null and into_owner is not null as moved, value, name, album_key, tracks from parts left join into_ using (album_key)),
sources as (select owner, album_key, value, sum(tracks) as tracks from joined group by all),
shown as (select *, {strip_disc('value')} as shown from sources),
albums as (select owner, album_key, arg_min(shown, (-tracks, {strip_album('shown')} <> shown, -{quality('shown')}, shown)) as name, sum(tracks) as tracks, count(*) as sources from shown group by all),
artists as (select owner, album_key, arg_min(name, (-n, -{quality('name')}, name)) as artist from (select owner, album_key, name, sum(tracks) n from joined group by all) group by all)"""
KIND = f"""case when value = album then 'exact' when {key('value')} = {key('album')} then 'spelling'
when {disc_of('value')} > 0 and {strip_disc('value')} <> value then 'disc'
when {unwatermark('value')} <> value and {key(unwatermark('value'))} = {key(unwatermark('album'))} then 'watermark'
when {strip_album('value')} = value and {strip_album('album')} = album then 'order' else 'edition' end"""


def whole(df: DataFrame) -> DataFrame:
    """Counts as bigint, as SQL's sums of them are cast."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if k in ("int", "bigint", "decimal") else F.col(c) for c, k in df.dtypes))


def entry_rules(spark, sf_dir: str) -> P.Rules:
    """The rules of the plan queries, derived from the tracks."""
    t = V.tracks(spark, sf_dir)
    artist = T.go_trim(F.col("artist"))
    number = F.regexp_extract("path", r"([0-9]+)\.mp3", 1).cast("int")
    rename = t.select(artist.alias("name")).filter("contains(name, ' & ')").distinct().select("name", F.substring_index("name", " & ", 1).alias("keep"))
    moved = t.filter("contains(album, ' (CD1)')").select("path", F.replace("album", F.lit(" (CD1)"), F.lit("")).alias("value"))
    shared = t.filter(number % 10 == 3).select("path", F.lit("Shared").alias("value"))
    stray = t.filter(F.col("compilation") & (number % 2 == 0)).select("path")
    hand = t.filter(number % 13 == 0).select(
        "path", F.lit(None).cast("string").alias("artist"), F.lit(None).cast("string").alias("albumArtist"), F.lit(None).cast("string").alias("album"), F.concat(F.lit(" "), "title", F.lit("! ")).alias("title"),
        F.when(number % 2 == 0, "").alias("genre"), F.lit("new words").alias("lyrics"), F.lit(0).alias("year"), F.lit(None).cast("int").alias("trackNo"), F.lit(None).cast("int").alias("discNo"),
        F.lit(False).alias("removeCompilation"), (number % 3 == 0).alias("removeAlbumArtistSort"), F.lit(False).alias("removeLegacyTag"), F.lit(False).alias("shrinkArtwork"),
    )
    return P.Rules(rename=rename, album_rename=moved, album_artist_set=shared, clear_album=t.filter("album = 'vk.com'").select("path"), clear_compilation=stray, manual=hand, remove_legacy=True, shrink_artwork=True)


NUM = r"cast(regexp_extract(path, '([0-9]+)\.mp3', 1) as int)"
RENAMED = lambda f: f"(case when contains({trim(f)}, ' & ') and {trim(f)} in (select {trim('artist')} from tracks) then split_part({trim(f)}, ' & ', 1) else {trim(f)} end)"
PLAN = f"""{TRACKS},
want as (select *, {NUM} as no,
  {RENAMED('artist')} as w_artist,
  case when {NUM} % 10 = 3 then 'Shared' else {RENAMED('albumArtist')} end as w_albumArtist,
  case when album = 'vk.com' then '' else replace(album, ' (CD1)', '') end as w_album,
  case when contains(album, ' (CD1)') and discNo = 0 then 1 else discNo end as w_discNo,
  case when {NUM} % 13 = 0 then {trim("title || '!'")} else title end as w_title,
  case when {NUM} % 26 = 0 then '' else genre end as w_genre,
  case when {NUM} % 13 = 0 then 0 else year end as w_year
  from tracks),
fields as (select path, unnest([
  {{'name': 'Artist', 'on': w_artist <> artist, 'before': artist, 'after': w_artist}},
  {{'name': 'Album artist', 'on': w_albumArtist <> albumArtist, 'before': albumArtist, 'after': w_albumArtist}},
  {{'name': 'Album', 'on': w_album <> album, 'before': album, 'after': w_album}},
  {{'name': 'Title', 'on': w_title <> title, 'before': title, 'after': w_title}},
  {{'name': 'Genre', 'on': w_genre <> genre, 'before': genre, 'after': w_genre}},
  {{'name': 'Year', 'on': w_year <> year, 'before': cast(year as varchar), 'after': case when w_year > 0 then cast(w_year as varchar) else '' end}},
  {{'name': 'Disc number', 'on': w_discNo <> discNo, 'before': case when discNo > 0 then cast(discNo as varchar) else '' end, 'after': case when w_discNo > 0 then cast(w_discNo as varchar) else '' end}},
  {{'name': 'Lyrics', 'on': no % 13 = 0 and lyrics <> 'new words', 'before': lyrics, 'after': 'new words'}},
  {{'name': 'Compilation flag', 'on': compilation and no % 2 = 0, 'before': 'yes', 'after': ''}},
  {{'name': 'Album artist sort', 'on': hasSort and no % 39 = 0, 'before': 'set', 'after': ''}},
  {{'name': 'Old tag at the end of the file', 'on': legacyTag, 'before': 'set', 'after': ''}},
  {{'name': 'Artwork', 'on': tagBytes > {W.TAG_LIMIT}, 'before': printf('%.1f MB of tags', tagBytes / 1048576.0), 'after': 'shrunk to fit a player'}}
]) as f from want)"""

QUERIES = {
    "summary_counts": (
        lambda s, d: whole(L.summary_counts(V.tracks(s, d))),
        f"with {TRACKS} select count(*) as tracks, cast(count_if(albumArtist <> '') as bigint) as album_artist, cast(count_if(compilation) as bigint) as compilation, cast(count_if(hasSort) as bigint) as sort, cast(count_if(legacyTag) as bigint) as legacy, cast(count_if(tagBytes > {W.TAG_LIMIT}) as bigint) as oversized, cast(count_if(hasLyrics) as bigint) as lyrics from tracks",
    ),
    "raw_names": (lambda s, d: L.raw_names(V.tracks(s, d)), f"with {NAMES} select * from names"),
    "artist_reduce": (
        lambda s, d: whole(L.artist_reduce(V.tracks(s, d))),
        f"with {CREDITS} select key, target as name, cast(tracks as bigint) as tracks, albums, sources from (select key, sum(tracks) as tracks, count(*) as sources from credits group by key) join best using (key) join (select key, count(distinct nullif(album, '')) as albums from occ join credits using (name) group by key) using (key)",
    ),
    "artist_sources": (
        lambda s, d: L.artist_sources(V.tracks(s, d)).select("key", "target", "value", "tracks", "kind"),
        f"with {CREDITS} select key, target, name as value, tracks, case when name = target then 'exact' when kind = 'exact' then 'spelling' else kind end as kind from credits join best using (key)",
    ),
    "split_credits": (
        lambda s, d: L.credits(V.tracks(s, d)).select("name", "lead", "kind", "key"),
        f"with {CREDITS} select name, lead, kind, key from credits",
    ),
    "album_reduce": (
        lambda s, d: whole(L.albums(V.tracks(s, d))[0]),
        f"with {ALBUMS} select a.owner, a.album_key, name, artist, cast(tracks as bigint) as tracks, sources from albums a join artists b on a.owner is not distinct from b.owner and a.album_key = b.album_key",
    ),
    "album_sources": (
        lambda s, d: L.albums(V.tracks(s, d))[1],
        f"with {ALBUMS}, listed as (select s.owner, s.album_key, a.name as album, s.value, s.tracks from sources s join albums a on a.owner is not distinct from s.owner and a.album_key = s.album_key) select owner, album_key, album, value, cast(tracks as bigint) as tracks, {KIND} as kind from listed",
    ),
    "junk_albums": (
        lambda s, d: whole(L.junk_albums(V.tracks(s, d))),
        f"with {ALBUMS}, g as (select value, count(*) as tracks, count(distinct owner) + max(case when owner is null then 1 else 0 end) as artists, bool_or(compilation) as compilation, min(path) as first_path from owned group by value) select value, case when {junk('value')} then 'site' else 'shared' end as reason, tracks, artists, first_path from g where {junk('value')} or (artists >= {W.SHARED_ARTISTS} and not compilation)",
    ),
    "compilation_absorb": (
        lambda s, d: L.absorbed(L.album_parts(V.tracks(s, d))).filter("name = 'Various artists' and into is not null").select("owner", "value", "tracks"),
        f"with {ALBUMS} select owner, value, tracks from joined where moved",
    ),
    "plan_changes": (
        lambda s, d: P.build(V.tracks(s, d), entry_rules(s, d)).select("path", F.array_join(F.transform("fields", lambda f: f["name"]), "|").alias("names")),
        f"with {PLAN} select path, string_agg(name, '|' order by i) as names from (select path, f.name as name, f['on'] as is_on, row_number() over () as i from fields) where is_on group by path",
    ),
    "plan_fields": (
        lambda s, d: P.plan_fields(P.build(V.tracks(s, d), entry_rules(s, d))).select("path", "name", "before", "after"),
        f"with {PLAN} select path, f.name as name, f.before as before, f.after as after from fields where f['on']",
    ),
    "plan_summary": (
        lambda s, d: whole(P.plan_summary(P.build(V.tracks(s, d), entry_rules(s, d)))),
        f"with {PLAN} select count(distinct path) as files, cast(count_if(f.name = 'Artist') as bigint) as artist_renamed, cast(count_if(f.name = 'Album artist' and f.after <> '') as bigint) as album_artist_set, cast(count_if(f.name = 'Album artist' and f.after = '') as bigint) as album_artist_cleared, cast(count_if(f.name = 'Compilation flag') as bigint) as compilation_removed, cast(count_if(f.name = 'Genre') as bigint) as genre_set, cast(count_if(f.name = 'Album') as bigint) as album_renamed from fields where f['on']",
    ),
    "plan_preview": (
        lambda s, d: P.preview(P.build(V.tracks(s, d), entry_rules(s, d))).select("path", F.size("fields").cast("bigint").alias("n")),
        f"with {PLAN} select path, count(*) as n from fields where f['on'] group by path order by path limit {W.PREVIEW_ROWS}",
    ),
    "clean_titles": (
        lambda s, d: V.tracks(s, d).select("path", T.clean_title(F.col("title")).alias("clean")),
        f"with {TRACKS} select path, {clean_title('title')} as clean from tracks",
    ),
}
