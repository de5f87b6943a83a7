"""Queries on titles, matching, markup, playlists and messages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators import library as L
from ..operators import markup as H
from ..operators import matching as M
from ..operators import planning as P
from ..operators import playlists as PL
from ..sources import messages as S
from . import tracks as V
from .oracle import TRACKS, bared, clean_title, fold, has, lead_artist, long_words, one_space, overlap, q, qualifiers, rep, similarity, stem, tidy, trim


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


CANDIDATES = f"cands as ({V.sql_of(V.CANDIDATES)})"
TITLES = f"""{TRACKS},
t1 as (select *, {clean_title('title')} as clean from tracks),
t2 as (select *, {bared('clean')} as bare, {qualifiers('clean')} as quals from t1)"""
#: No derived name is a stand-in; a title can start with an artist's name and a space; the file's name is a number.
ATTEMPTS = f"""{TRACKS},
b0 as (select path, artist, albumArtist, hasLyrics, title as raw, {lead_artist('artist')} as la, {lead_artist('albumArtist')} as lb, regexp_extract(path, '([^/]*)[.]mp3$', 1) as file from tracks),
b1 as (select *, case when la = '' and lb = '' then [] when la = '' then [lb] when lb = '' or {fold('la')} = {fold('lb')} then [la] else [la, lb] end as artists from b0),
b2 as (select *, list_filter(list_append(artists, artist), lambda a: contains(a, ' ') and starts_with(lower(raw), lower(a) || ' '))[1] as twice from b1),
b3 as (select *, case when twice is null then raw else {trim("substr(raw, length(twice) + 2)")} end as title from b2),
t1 as (select *, {clean_title('title')} as clean from b3),
t2 as (select *, {bared('clean')} as bare, {qualifiers('clean')} as quals from t1),
a0 as (select *, list_filter([clean, case when len(quals) > 0 then bare || ' ' || array_to_string(quals, ' ') end, case when lower(bare) <> lower(clean) then bare end, file], lambda t: coalesce(t, '') <> '') as titles from t2),
a1 as (select path, quals, unnest(titles) as title, generate_subscripts(titles, 1) as i, artists from a0 where len(artists) > 0 and clean <> ''),
a2 as (select path, quals, title, i, unnest(artists) as artist, generate_subscripts(artists, 1) as j from a1),
a3 as (select *, row_number() over (partition by path, {fold('artist')}, {fold('title')} order by i, j) as dup from a2),
a4 as (select *, row_number() over (partition by path order by i, j) - 1 as attempt from a3 where dup = 1),
attempts as (select path, attempt, artist, title, array_to_string(quals, ' ') as quals from a4 where attempt < {W.MAX_ATTEMPTS})"""
SIDES = f"""{TRACKS}, {CANDIDATES},
q0 as (select path, artist, title, cast(regexp_extract(path, '([0-9]+)[.]mp3', 1) as int) as no, regexp_extract(path, '^/m/([^/]*)', 1) as brand, trackNo, {clean_title('title')} as clean from tracks where artist <> ''),
q1 as (select *, {bared('clean')} as bare, {qualifiers('clean')} as ql from q0),
qs as (select path, no, brand, trackNo, ql, cast(100 + no % 40 as double) as dur, {fold('clean')} as f_clean, {fold('bare')} as f_bare, {long_words('title')} as tw, {fold('artist')} as f_art, {fold(lead_artist('artist'))} as f_lead, {long_words('artist')} as aw from q1),
c0 as (select *, {clean_title('title')} as clean from cands),
cs as (select brand, size, round, source, pos, title, lyrics, duration, {fold('clean')} as f_clean, {fold(bared('clean'))} as f_bare, {long_words('title')} as tw, {fold('artist')} as f_art, {fold(lead_artist('artist'))} as f_lead, {long_words('artist')} as aw, list_transform({long_words('title')}, lambda w: {stem('w')}) as stems from c0),
pairs as (select q.path, c.round, c.source, c.pos, c.title, c.lyrics, len(list_filter(q.ql, lambda w: not list_contains(c.stems, w))) = 0 as qualified,
  0.6 * greatest({similarity('q.f_clean', 'c.f_clean')}, 0.95 * {similarity('q.f_bare', 'c.f_bare')}, 0.9 * {overlap('q.tw', 'c.tw')})
  + 0.4 * greatest({similarity('q.f_art', 'c.f_art')}, {similarity('q.f_lead', 'c.f_lead')}, 0.9 * {overlap('q.aw', 'c.aw')})
  + case when len(q.ql) = 0 then 0 when len(list_filter(q.ql, lambda w: not list_contains(c.stems, w))) = 0 then 0.04 else -0.08 end
  + case when abs(q.dur - c.duration) <= 3 then 0.06 when abs(q.dur - c.duration) > 20 then -0.15 else 0 end as raw
  from qs q join cs c on q.brand = c.brand and q.trackNo = c.size),
scored as (select * exclude raw, greatest(0.0, least(1.0, raw))::double as score from pairs)"""


#: All pairs of names, without blocks: that no accepted pair lacks a block key is part of what is checked, by the same keys.
FUZZY = f"""with {TRACKS}, {CANDIDATES},
q0 as (select min(path) as path, artist, title, {clean_title('title')} as clean from tracks where artist <> '' group by artist, title),
q1 as (select *, {bared('clean')} as bare, {qualifiers('clean')} as ql from q0),
qs as (select path, ql, {fold('clean')} as f_clean, {fold('bare')} as f_bare, {long_words('title')} as tw, {fold('artist')} as f_art, {fold(lead_artist('artist'))} as f_lead, {long_words('artist')} as aw, left({fold('title')}, 3) as head from q1),
c0 as (select min(pos) as pos, artist, title, {clean_title('title')} as clean from cands group by artist, title),
cs as (select pos, {fold('clean')} as f_clean, {fold(bared('clean'))} as f_bare, {long_words('title')} as tw, {fold('artist')} as f_art, {fold(lead_artist('artist'))} as f_lead, {long_words('artist')} as aw, list_transform({long_words('title')}, lambda w: {stem('w')}) as stems, left({fold('title')}, 3) as head from c0),
met as (select q.*, c.pos, c.f_clean as g_clean, c.f_bare as g_bare, c.tw as gw, c.f_art as g_art, c.f_lead as g_lead, c.aw as gaw, c.stems from qs q join cs c on list_has_any(q.tw, c.tw) or q.head = c.head),
raw as (select path, pos,
  0.6 * greatest({similarity('f_clean', 'g_clean')}, 0.95 * {similarity('f_bare', 'g_bare')}, 0.9 * {overlap('tw', 'gw')})
  + 0.4 * greatest({similarity('f_art', 'g_art')}, {similarity('f_lead', 'g_lead')}, 0.9 * {overlap('aw', 'gaw')})
  + case when len(ql) = 0 then 0 when len(list_filter(ql, lambda w: not list_contains(stems, w))) = 0 then 0.04 else -0.08 end as s from met)
select path, pos, round(greatest(0.0, least(1.0, s)), 6)::double as score from raw where greatest(0.0, least(1.0, s)) >= {W.MIN_SCORE}"""


def tries(spark, sf_dir: str) -> DataFrame:
    """One search for each track with an artist, as it is tagged, with what it is joined to candidates by."""
    t = V.tracks(spark, sf_dir).filter("artist <> ''")
    number = F.regexp_extract("path", r"([0-9]+)\.mp3", 1).cast("int")
    return t.select("path", F.lit(0).alias("attempt"), "artist", "title", (100 + number % 40).cast("double").alias("duration"), F.regexp_extract("path", "^/m/([^/]*)", 1).alias("brand"), F.col("trackNo").alias("size"))


def match_pairs(spark, sf_dir: str) -> DataFrame:
    return M.scored(tries(spark, sf_dir), V.candidates(spark, sf_dir), ["brand", "size"], digits=6)


def entries_of(spark, sf_dir: str) -> DataFrame:
    """Playlist entries of the derived tracks: a list of each brand; paths are literal, from another place, ambiguous or unknown."""
    t = V.tracks(spark, sf_dir)
    no = F.regexp_extract("path", r"([0-9]+)\.mp3", 1).cast("int")
    place = F.when(no % 5 == 0, F.col("path")).when(no % 5 == 1, F.concat(F.lit("D:\\Music"), F.replace(F.upper("path"), F.lit("/"), F.lit("\\")))).when(no % 5 == 2, F.concat(F.lit("file:///Users/me"), F.replace("path", F.lit("#"), F.lit("%23")))).when(no % 5 == 3, F.lit("gone.mp3")).otherwise(F.concat(F.lit(" /x/"), F.regexp_extract("path", r"[^/]*\z", 0)))
    title = F.when(no % 2 == 0, F.col("title")).otherwise("")
    return t.select(F.regexp_extract("path", "^/m/([^/]*)", 1).alias("playlist_id"), no.alias("pos"), place.alias("location"), title.alias("title"), F.col("artist").alias("artist"), F.when(no % 3 == 0, no).otherwise(-1).alias("duration"))


def files_of(spark, sf_dir: str) -> DataFrame:
    t = V.tracks(spark, sf_dir)
    return t.select(F.substring("path", F.lit(4), F.length("path")).alias("rel"), F.regexp_extract("path", r"([0-9]+)\.mp3", 1).cast("int").alias("ord"))


def resolved(spark, sf_dir: str) -> DataFrame:
    return PL.resolve(entries_of(spark, sf_dir), files_of(spark, sf_dir), "/m")


#: Suffix resolution as a join of all files: a literal path first, else the longest tail that files share, of one file or of several parts.
RESOLVE = f"""{TRACKS},
f as (select substr(path, 4) as rel, lower(substr(path, 4)) as key, cast(regexp_extract(path, '([0-9]+)[.]mp3', 1) as int) as ord from tracks),
x as (select rel, ord, key, string_split(key, '/') as parts from f),
tl as (select rel, ord, unnest(list_transform(range(1, len(parts) + 1), lambda k: array_to_string(parts[len(parts) - k + 1:], '/'))) as tail, unnest(range(1, len(parts) + 1)) as n from x),
ti as (select tail, n, arg_min(rel, ord) as rel, count(*) as files from tl group by all),
e as (select regexp_extract(path, '^/m/([^/]*)', 1) as playlist_id, cast(regexp_extract(path, '([0-9]+)[.]mp3', 1) as int) as pos, path, title, artist from tracks),
l as (select *, case pos % 5 when 0 then path when 1 then 'D:\\Music' || replace(upper(path), '/', '\\') when 2 then 'file:///Users/me' || replace(path, '#', '%23') when 3 then 'gone.mp3' else ' /x/' || regexp_extract(path, '[^/]*$', 0) end as location from e),
p as (select *, trim(location) as t from l),
d as (select *, case when starts_with(t, 'file://') then replace(substr(t, 8), '%23', '#') else t end as place from p),
c as (select *, list_filter(string_split_regex(lower(place), '[/\\\\]'), lambda y: y not in ('', '.', '..')) as names from d),
w as (select playlist_id, pos, unnest(list_transform(range(1, len(names) + 1), lambda k: array_to_string(names[len(names) - k + 1:], '/'))) as tail from c),
hit as (select w.playlist_id, w.pos, arg_max(ti.rel, ti.n) as rel from w join ti using (tail) where ti.n >= 2 or ti.files = 1 group by all),
found as (select c.playlist_id, c.pos, '/m/' || coalesce(f.rel, hit.rel) as file, case when c.pos % 2 = 0 then c.title else '' end as title, c.artist, case when c.pos % 3 = 0 then c.pos else -1 end as duration from c left join f on c.place = '/m/' || f.rel left join hit on hit.playlist_id = c.playlist_id and hit.pos = c.pos)"""
ENTRY = f"""{TRACKS},
e as (select regexp_extract(path, '^/m/([^/]*)', 1) as playlist_id, cast(regexp_extract(path, '([0-9]+)[.]mp3', 1) as int) as pos, path, title, artist from tracks),
found as (select playlist_id, pos, case when pos % 5 <> 3 then path end as file, case when pos % 2 = 0 then title else '' end as title, artist, case when pos % 3 = 0 then pos else -1 end as duration from e)"""


def m3u_text(spark, sf_dir: str) -> DataFrame:
    """Lines of an extended playlist for each brand, with remarks between."""
    e = entries_of(spark, sf_dir)
    lines = F.array(F.when(F.col("pos") % 3 == 0, F.concat(F.lit("#extinf:"), F.col("pos").cast("string"), F.lit(" x=1,"), "artist", F.lit(" - "), "title")), F.when(F.col("pos") % 4 == 0, F.lit("# a remark")), F.concat(F.lit("/p/"), F.col("pos").cast("string"), F.lit(".mp3")))
    rows = e.select("playlist_id", F.col("pos").alias("n"), F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("i", "line"))
    return rows.select("playlist_id", (F.col("n") * 4 + F.col("i")).alias("pos"), "line")


def pls_text(spark, sf_dir: str) -> DataFrame:
    """Lines of an older playlist for each brand; some numbers have no file, some a second title."""
    e = entries_of(spark, sf_dir)
    n = F.col("pos").cast("string")
    line = lambda k, v, c=F.lit(True): F.when(c, F.concat(F.lit(k), n, F.lit("="), v))
    lines = F.array(line("Title", F.lit("old")), line("file", F.concat(F.lit("/p/"), n), F.col("pos") % 7 != 0), line("TITLE", F.col("artist"), F.col("pos") % 2 == 0), line("Length", n, F.col("pos") % 3 == 0))
    rows = e.select("playlist_id", F.col("pos").alias("n"), F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("i", "line"))
    return rows.select("playlist_id", (F.col("n") * 4 + F.col("i")).alias("pos"), "line")


def message_lines(spark, sf_dir: str) -> DataFrame:
    """Events as scan messages: tracks, errors, an end, and lines that are no message."""
    e = read(spark, sf_dir, "events")
    track = F.struct(F.concat(F.lit("/e/"), F.col("event_id").cast("string")).alias("path"), F.col("event_type").alias("title"), F.get_json_object("props", "$.k").cast("int").alias("year"))
    error = F.struct(F.lit("error").alias("type"), F.concat(F.lit("/e/"), F.col("event_id").cast("string")).alias("path"), F.lit("unreadable").alias("error"))
    done = F.struct(F.lit("progress").alias("type"), F.col("event_id").cast("int").alias("done"), F.lit(99).alias("total"))
    kind = F.col("event_id") % 5
    line = F.when(kind == 0, F.to_json(error)).when(kind == 1, F.to_json(done)).when(kind == 2, F.concat(F.lit("noise "), "props")).when(kind == 3, F.lit("{broken")).otherwise(F.concat(F.lit("  "), F.to_json(F.struct(F.lit("track").alias("type"), track.alias("track")))))
    return e.select(line.alias("line"))


def patches(spark, sf_dir: str) -> DataFrame:
    """Orders as edits by hand of a customer's record, the latest of which counts."""
    o = read(spark, sf_dir, "orders")
    text = lambda c, v: F.when(c, v).cast("string")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").cast("string").alias("path"), k.alias("edit_no"), text(k % 3 == 0, F.col("o_orderstatus")).alias("artist"), text(k % 4 == 0, F.lit("")).alias("albumArtist"), text(k % 5 == 0, F.col("o_orderpriority")).alias("album"),
        text(F.lit(False), F.lit("")).alias("title"), text(F.lit(False), F.lit("")).alias("genre"), text(F.lit(False), F.lit("")).alias("lyrics"), F.when(k % 7 == 0, F.col("o_orderkey").cast("int")).alias("year"), F.lit(None).cast("int").alias("trackNo"), F.lit(None).cast("int").alias("discNo"),
        (k % 11 == 0).alias("removeCompilation"), (k % 13 == 0).alias("removeAlbumArtistSort"), (k % 2 == 0).alias("removeLegacyTag"), F.lit(False).alias("shrinkArtwork"),
    )





def breaks_page(page):
    """Each line end of a text as a break, so that pages of the tables have broken lines."""
    return F.concat(F.lit("<html><body><div>x<br>y</div><div>"), F.regexp_replace(page, r"\n", "<br>\n"), F.lit("</div></body></html>"))


HTML_SQL = rep(rep(rep("html", W.LINE_BREAK, "\n"), W.BLOCK_END, "\n"), W.ANY_TAG)
for _name, _char in H.NAMED_REFERENCES.items():
    HTML_SQL = f"regexp_replace({HTML_SQL}, {q(_name + '?' if _name[1] != '#' else _name)}, {q(_char)}, 'g')"

LRC = lambda x: F.concat(F.lit("[00:00.00] composer : x\n"), F.regexp_replace(F.regexp_replace(x, "^", "[00:01.50]"), r"\n", "\n[01:02]"))
LRC_SQL = "'[00:00.00] composer : x' || chr(10) || '[00:01.50]' || replace(text, chr(10), chr(10) || '[01:02]')"

QUERIES = {
    "bare_titles": (lambda s, d: V.tracks(s, d).select("path", T.bare_title(F.col("title")).alias("bare")), f"with {TITLES} select path, bare from t2"),
    "qualifiers": (lambda s, d: V.tracks(s, d).select("path", F.array_join(T.qualifiers(F.col("title")), " ").alias("qualifiers")), f"with {TITLES} select path, array_to_string(quals, ' ') as qualifiers from t2"),
    "name_from_file": (
        lambda s, d: V.tracks(s, d).select(T.name_from_file(F.concat(F.lit("/x/03. "), "artist", F.lit(" - "), "title", F.lit(".mp3"))).alias("n")).select("n.artist", "n.title"),
        f"with {TRACKS} select {trim('artist')} as artist, case when artist = '' then '- ' else '' end || {trim('title')} as title from tracks",
    ),
    "attempts": (
        lambda s, d: M.attempts(V.tracks(s, d)).select("path", F.col("attempt").cast("bigint").alias("attempt"), "artist", "title", F.array_join("qualifiers", " ").alias("quals")),
        f"with {ATTEMPTS} select path, attempt, artist, title, quals from attempts",
    ),
    "dedupe_attempts": (
        lambda s, d: M.attempts(V.tracks(s, d)).groupBy("path").agg(F.count("*").alias("n"), F.count_distinct(T.fold(F.col("title"))).alias("titles")),
        f"with {ATTEMPTS} select path, count(*) as n, count(distinct {fold('title')}) as titles from attempts group by path",
    ),
    "select_targets": (
        lambda s, d: L.selected(V.tracks(s, d), s.createDataFrame([("small ring",), ("RED WIDGET",), ("Old bolt",)], "name string")).select("path"),
        f"with {ATTEMPTS} select path from a0 where not hasLyrics and path in (select path from attempts) and ({trim('artist')} in ('small ring', 'RED WIDGET', 'Old bolt') or {trim('albumArtist')} in ('small ring', 'RED WIDGET', 'Old bolt'))",
    ),
    "similarity": (
        lambda s, d: match_names(s, d).select("p_partkey", F.round(T.similarity(F.col("a"), F.col("b")), 6).alias("similarity")),
        f"select p_partkey, round({similarity(fold('p_name'), fold('p_type || p_brand'))}, 6) as similarity from part",
    ),
    "word_overlap": (
        lambda s, d: match_names(s, d).select("p_partkey", T.word_overlap(F.concat("p_name", F.lit(" small red old")), F.concat("b", F.lit(" "), "p_name")).alias("overlap")),
        f"select p_partkey, {overlap(long_words("p_name || ' small red old'"), long_words('p_type || p_brand || ' + q(' ') + ' || p_name'))} as overlap from part",
    ),
    "match_score": (lambda s, d: match_pairs(s, d).select("path", F.col("c_pos").alias("pos"), "score", "qualified"), f"with {SIDES} select path, pos, round(score, 6) as score, qualified from scored"),
    "find_best": (
        lambda s, d: M.best_of(tries(s, d), V.candidates(s, d), ["brand", "size"]).select("path", "status", "title", F.round("score", 6).alias("score"), "source"),
        f"""with {SIDES},
w as (select *, row_number() over (partition by path, round, source order by score desc, pos) as no, {tidy('lyrics')} as words from scored where lyrics <> ''),
good as (select * from w where no = 1 and score >= {W.MIN_SCORE} and words <> ''),
best as (select path, arg_min({{'title': title, 'score': score, 'source': source}}, (not qualified, case when qualified then 0.0 else -score end, round, source, pos)) as b from good group by path),
near as (select path, arg_min({{'title': title, 'score': score}}, (-score, round, source, pos)) as n from scored group by path)
select path, case when b is null then 'missing' else 'found' end as status, coalesce(b.title, case when n.score >= {W.MENTION_SCORE} then n.title end) as title, round(coalesce(b.score, n.score), 6) as score, b.source as source from near left join best using (path)""",
    ),
    "tidy_lyrics": (lambda s, d: read(s, d, "documents").select("doc_id", F.sha2(T.tidy_lyrics(F.col("text")), 256).alias("tidy")), f"select doc_id, sha256({tidy('text')}) as tidy from documents"),
    "hook_count": (
        lambda s, d: read(s, d, "conversations").select("conv_id", "turn", T.hook_count(F.col("text"), F.lit("The")).cast("bigint").alias("n")),
        f"select conv_id, turn, cast((length(t) - length(replace(t, ' the ', ''))) / 5 as bigint) as n from (select conv_id, turn, ' ' || {one_space(rep('lower(text)', W.NOT_WORD, ' '))} || ' ' as t from conversations)",
    ),
    "html_text": (lambda s, d: read(s, d, "pages").select("page_id", F.sha2(H.html_text(F.col("html")), 256).alias("text")), f"select page_id, sha256({trim(HTML_SQL)}) as text from pages"),
    "broken_lines": (
        lambda s, d: read(s, d, "conversations").select("conv_id", "turn", H.broken_lines(breaks_page(F.col("text"))).alias("lines")),
        f"""select conv_id, turn, case when len(string_split(t, chr(10))) - 1 < {W.BROKEN_LINES} then '' else array_to_string(list_transform(string_split({trim('t')}, chr(10)), lambda x: {trim('x')}), chr(10)) end as lines from (select conv_id, turn, text as t from conversations)""",
    ),
    "lrc_words": (
        lambda s, d: read(s, d, "documents").select("doc_id", H.lrc_words(LRC(F.col("text"))).alias("w")).select("doc_id", "w.plain", "w.synced"),
        f"""with l as (select doc_id, unnest(string_split({LRC_SQL}, chr(10))) as line, generate_subscripts(string_split({LRC_SQL}, chr(10)), 1) as i from documents),
k as (select doc_id, i, regexp_extract(line, {q(W.LRC_TIME)}, 1) as t, {trim(f"regexp_extract(line, {q(W.LRC_TIME)}, 2)")} as w from l),
g as (select doc_id, {trim("string_agg(w, chr(10) order by i)")} as plain, string_agg(t || w, chr(10) order by i) as synced from k where t <> '' and not {has('w', W.LRC_CREDIT)} group by doc_id)
select doc_id, coalesce(plain, '') as plain, case when coalesce(plain, '') = '' then '' else synced end as synced from documents left join g using (doc_id)""",
    ),
    "m3u_parse": (
        lambda s, d: PL.m3u_entries(m3u_text(s, d)).select("playlist_id", "location", "title", "artist", "duration"),
        f"""with {ENTRY}, x as (select *, {trim("artist || ' - ' || title")} as info from found) select playlist_id, '/p/' || pos || '.mp3' as location, case when pos % 3 <> 0 then '' when contains(info, ' - ') then substr(info, instr(info, ' - ') + 3) else info end as title, case when pos % 3 = 0 and contains(info, ' - ') then split_part(info, ' - ', 1) else '' end as artist, case when pos % 3 = 0 and pos > 0 then pos else -1 end as duration from x""",
    ),
    "pls_parse": (
        lambda s, d: PL.pls_entries(pls_text(s, d)),
        f"with {ENTRY} select playlist_id, pos, '/p/' || pos as location, case when pos % 2 = 0 then {trim('artist')} else 'old' end as title, '' as artist, case when pos % 3 = 0 and pos > 0 then pos else -1 end as duration from found where pos % 7 <> 0",
    ),
    "suffix_resolve": (lambda s, d: resolved(s, d).select("playlist_id", "pos", "file"), f"with {RESOLVE} select playlist_id, pos, file from found"),
    "found_missing": (lambda s, d: PL.found_counts(resolved(s, d)), f"with {RESOLVE} select playlist_id, count(file) as found, count(*) - count(file) as missing from found group by playlist_id"),
    "m3u_write": (
        lambda s, d: PL.write(resolved(s, d), resolved(s, d).select("playlist_id", F.concat("playlist_id", F.lit(": mix.")).alias("name")).distinct(), "m3u8", "/m/lists").select("file_name", F.sha2("content", 256).alias("content")),
        f"""with {RESOLVE}, li as (select playlist_id, pos, '#EXTINF:' || case when duration > 0 then duration else -1 end || ',' || case when artist <> '' then artist || ' - ' else '' end || case when title <> '' then title else lpad(cast(pos as varchar), 7, '0') end || chr(10) || '../' || substr(file, 4) || chr(10) as line from found where file is not null)
select playlist_id || '- mix.m3u8' as file_name, sha256('#EXTM3U' || chr(10) || string_agg(line, '' order by pos)) as content from li group by playlist_id""",
    ),
    "relative_path": (
        lambda s, d: V.tracks(s, d).select("path", PL.relative(F.col("path"), F.concat(F.lit("/m/"), F.regexp_extract("path", "^/m/([^/]*)", 1), F.lit("/LARGE"))).alias("relative")),
        f"with {TRACKS} select path, case when split_part(path, '/', 4) = 'LARGE' then split_part(path, '/', 5) else '../' || split_part(path, '/', 4) || '/' || split_part(path, '/', 5) end as relative from tracks",
    ),
    "message_stream": (
        lambda s, d: M.union_all(S.tracks(S.messages(message_lines(s, d))).select("path", F.col("title").alias("value"), "year"), S.failures(S.messages(message_lines(s, d))).select("path", F.col("reason").alias("value"), F.lit(None).cast("int").alias("year"))),
        "select '/e/' || event_id as path, case when event_id % 5 = 0 then 'unreadable' else event_type end as value, case when event_id % 5 = 4 then cast(props ->> '$.k' as integer) end as year from events where event_id % 5 in (0, 4)",
    ),
    "patch_merge": (
        lambda s, d: P.merge_patches(patches(s, d)).select("path", "artist", "albumArtist", "album", "year", "removeCompilation", "removeAlbumArtistSort", "removeLegacyTag"),
        "select cast(o_custkey as varchar) as path, arg_max(o_orderstatus, o_orderkey) filter (o_orderkey % 3 = 0) as artist, arg_max('', o_orderkey) filter (o_orderkey % 4 = 0) as albumArtist, arg_max(o_orderpriority, o_orderkey) filter (o_orderkey % 5 = 0) as album, cast(max(o_orderkey) filter (o_orderkey % 7 = 0) as integer) as year, bool_or(o_orderkey % 11 = 0) as removeCompilation, bool_or(o_orderkey % 13 = 0) as removeAlbumArtistSort, false as removeLegacyTag from orders group by o_custkey",
    ),
    "fuzzy_join": (
        lambda s, d: blocked(s, d).select("path", F.col("c_pos").alias("pos"), F.round("score", 6).alias("score")),
        FUZZY,
    ),
}


def match_names(spark, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_name").alias("a"), F.concat("p_type", "p_brand").alias("b"))


def blocked(spark, sf_dir: str) -> DataFrame:
    """Distinct artist and title pairs of the tracks against distinct catalogue names, by block keys of the title; accepted ones."""
    t = V.tracks(spark, sf_dir).filter("artist <> ''").groupBy("artist", "title").agg(F.min("path").alias("path"))
    none = F.array().cast(T.STRINGS)
    asked = t.select("path", F.lit(0).alias("attempt"), "artist", "title", T.qualifiers(F.col("title")).alias("qualifiers"), none.alias("guests"))
    known = V.candidates(spark, sf_dir).groupBy("artist", "title").agg(F.min("pos").alias("pos"))
    return M.scored(asked, known).filter(F.col("score") >= W.MIN_SCORE)
