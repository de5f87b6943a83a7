"""Queries on single functions: names, addresses, numbers, small texts, markup and providers' answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..operators import library as L
from ..operators import markup as H
from ..operators import matching as M
from ..operators import playlists as PL
from ..sources import messages as S
from ..sources import providers as PR
from ..streaming import progress as G
from . import library_queries
from . import tracks as V
from .oracle import TRACKS, after, bared, clean_title, fold, has, lead_artist, long_words, one_space, q, qualifiers, rep, similarity, stem, trim, words_in


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def choice(key: str, *values: str) -> str:
    """An expression that Spark and DuckDB read alike: one of the values by the key's remainder."""
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values[:-1])) + f" else {values[-1]} end"


def over(table: str, key: str, source: str, function, sql, name: str = "value"):
    """A query of function(Column) over an expression of a table, and the same in SQL."""
    return (
        lambda s, d: read(s, d, table).select(key, function(F.expr(source)).alias(name)),
        f"select {key}, {sql('v')} as {name} from (select *, {source} as v from {table})",
    )


#: Derived texts that reach the functions' branches.
NAMES = choice("p_partkey", "p_name", "'VK'", "'Unknown  Artist'", "'various artists'", "upper(p_name)", "' MP3 '", "'Сборник'")
CREDITS = choice("p_partkey", "concat(p_name, ' (feat. ', p_brand, ' & ', p_type, ' and Al)')", "concat(p_name, ' ft. ', p_type, ', ', p_brand)", "concat(p_name, ' | @ch; ', p_type)", "concat(p_type, ' & ', p_name, ' x ', p_brand)", "concat(p_name, ' / ', p_type, ', ', p_brand)", "p_name", "concat('[with ', p_brand, ' + ', p_name, '] ', p_type)")
CYRILLIC = choice("p_partkey", "concat('Песня (', p_name, ')')", "concat('Песня (', p_name, ') [', p_type, '] (', p_brand, ')')", "concat(p_name, ' (', p_type, ')')", "concat('Песня ', p_name, ' (Ещё)')", "'семь'", "concat('Ночь ', p_name, ' {', p_type, '} ')")
TITLES = choice("p_partkey", "concat(p_name, ' (', p_type, ')')", "concat(p_name, ' x ', p_type)", "concat(p_name, ' (Remix)')", "concat(p_name, ' (v2) [for ', p_name, ']')", "concat(p_name, ' (12 34)')", "p_name")
HOOKS = choice("p_partkey", "p_name", "'Go'", "'Love'", "concat(p_name, ' ', p_type, ' and so on')", "concat(p_name, ' (Session Edit)')", "concat('03. ', p_name)")
SLUGS = choice("p_partkey", "concat(p_name, ' & ', p_type)", "concat(p_name, '''s $', p_brand)", "concat('Песня ', p_name)", "concat('--', p_name, '’s  ')")
FILES = choice("p_partkey", "concat('/m/', p_name, '.MP3')", "concat('/m/', p_name, '.flac')", "concat('/m.x/', p_name)", "concat(p_name, '.tar.gz')", "concat('/m/', p_name, '.M3U8')", "concat('/m/', p_name, '.xspf')", "concat('/m/', p_name, '.')")
CONTROLS = choice("p_partkey", "concat(p_name, chr(7), 'x')", "concat(' ', p_name, chr(9), p_type, ' ')", "concat(p_name, chr(1), chr(2))", "p_name")
YEARS = choice("o_orderkey", "cast(year(o_orderdate) as string)", "concat(cast(year(o_orderdate) as string), '-05')", "o_orderpriority", "''")
FLAGS = choice("o_orderkey", "'1'", "' 0 '", "'false'", "'no'", "'No'", "''", "o_orderstatus")
ALBUMS = choice("p_partkey", "concat(p_type, ' (Deluxe) [Explicit] (2019)')", "concat(p_type, ' - Single - EP (Bonus Track) [HD] (Remastered) (Special Edition) [Web] (HQ) (CD) (LP) [MP3]')", "concat(p_type, ' (Live)')", "concat(p_type, ' [', p_name, '] (Deluxe)')")
LETTER, LATIN = r"\p{L}", r"\p{Latin}"
ASIDE_NAMES = f"(case when len(string_split(b, ' x ')) > 1 then list_filter(list_filter(list_transform(string_split(b, ' x '), lambda p: {trim('p')}), lambda p: p <> ''), lambda p: length(p) >= 3) else [] end)"


def listed(parts: str) -> str:
    return f"array_to_string({parts}, '|')"


def foreign(x: str) -> str:
    """Whether a text has a letter that isn't Latin."""
    return has(f"regexp_replace({x}, {q(LATIN)}, '', 'g')", LETTER)


def translated(x: str) -> str:
    """Rounds of the rule, three of which are enough for the derived names."""
    out = x
    for i in range(3):
        rest, inside = f"regexp_replace(t{i}, {q(W.TRANSLATION)}, '')", f"regexp_extract(t{i}, {q(W.TRANSLATION)}, 1)"
        cut = f"case when {has(f't{i}', W.TRANSLATION)} and {foreign(rest)} and not {foreign(inside)} then {trim(rest)} else t{i} end"
        out = f"(select {cut} from (select {out} as t{i}))"
    return out


def stripped(x: str) -> str:
    """Edition qualifiers of the derived albums, one of the ten after the other."""
    from .oracle import before, is_edition

    out = trim(x)
    for i in range(12):
        t = f"t{i}"
        cut = lambda p, t=t: f"when {before(t, p)} is not null and {is_edition(f'regexp_extract({t}, {q(p)}, 1)')} then {trim(before(t, p))}"
        out = f"(select case {cut(W.TRAILING_BRACKET)} {cut(W.TRAILING_DASH)} else {t} end from (select {out} as {t}))"
    return out


def other_artists(x: str) -> str:
    a = f"(case when trim({rep(x, W.HANDLE, ' ')}, ' |,;-') = '' then {trim(x)} else {one_space(f"trim({rep(x, W.HANDLE, ' ')}, ' |,;-')")} end)"
    split = ", ".join(f"string_split({a}, {q(s)})[2:]" for s in T.CREDIT_SEPARATORS)
    return f"list_filter(list_transform(flatten([{split}]), lambda p: {trim('p')}), lambda p: p <> '')"


def guests_in(x: str) -> str:
    tail = f"regexp_extract(regexp_extract({x}, {q('(?is)' + '(?:' + W.GUEST_CREDIT.removeprefix('(?i)') + ')(.*)$')}, 1), '^[^)\\]]*', 0)"
    return f"case when {has(x, W.GUEST_CREDIT)} then list_filter(list_transform(string_split_regex({tail}, {q(W.GUEST_SEPARATOR)}), lambda p: {trim('p')}), lambda p: strlen(p) > 2) else [] end"


def container_page(c) -> object:
    """A text as a page with a lyrics container that holds a nested block and one that is no part of the words."""
    return F.concat(F.lit('<p>a</p><div class="x" data-lyrics-container="true">'), F.regexp_replace(c, r"\n", "<br/>"), F.lit('<div data-exclude-from-selection="true">no <div>words</div></div>'), F.lit('<div><i>end</i></div></div><div>b</div>'))


def json_text(c):
    """A text as a JSON string, quotes included."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


#: Conversations of one turn each as providers' answers.
def lrclib_answers(spark, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    entry = lambda text, instrumental: F.struct(F.col("role").alias("trackName"), F.col("conv_id").cast("string").alias("artistName"), F.lit("al").alias("albumName"), (F.col("turn") * 1.5).alias("duration"), instrumental.alias("instrumental"), text.alias("plainLyrics"), F.lit("").alias("syncedLyrics"))
    first, second = entry(F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")), F.col("turn") % 4 == 1), entry(F.col("role"), F.lit(False))
    return c.select("conv_id", "turn", F.when(F.col("conv_id") % 9 == 0, "not an answer").otherwise(F.to_json(F.array(first, second))).alias("answer"))


LRCLIB = """with e as (select conv_id, turn, unnest([{'no': 0, 'w': case when turn % 3 = 0 then '' else text end, 'i': turn % 4 = 1}, {'no': 1, 'w': role, 'i': false}]) as e, role from conversations where conv_id % 9 <> 0)
select conv_id, turn, cast(conv_id as varchar) as artist, role as title, e.w as lyrics, turn * 1.5::double as duration from e where not e.i and e.w <> ''"""


def genius_answers(spark, sf_dir: str) -> DataFrame:
    """For each part an answer of two sections: the same address twice, one without an address, one that is no song, eight more."""
    p = read(spark, sf_dir, "part")
    result = lambda i, url, names: F.struct(F.lit(i).cast("bigint").alias("id"), F.col("p_name").alias("title"), names.alias("artist_names"), url.alias("url"), F.struct(F.col("p_brand").alias("name")).alias("primary_artist"))
    hit = lambda kind, i, url, names=F.lit(""): F.struct(F.lit(kind).alias("type"), result(i, url, names).alias("result"))
    url = lambda i: F.concat(F.lit("https://genius.com/"), F.col("p_partkey").cast("string"), F.lit(f"/{i}"))
    top = F.struct(F.lit("top_hit").alias("type"), F.array(hit("song", 1, url(1)), hit("album", 2, url(2)), hit("song", 3, F.lit(""))).alias("hits"))
    songs = F.struct(F.lit("song").alias("type"), F.array(hit("song", 9, url(1)), *(hit("song", i, url(i), F.concat(F.lit("Имя (Name) & "), F.col("p_type"))) for i in range(4, 12))).alias("hits"))
    return p.select("p_partkey", F.to_json(F.struct(F.struct(F.array(top, songs).alias("sections")).alias("response"))).alias("answer"))


GENIUS = """with n as (select *, unnest([1, 4, 5, 6, 7]) as id from part)
select p_partkey, cast(id as bigint) as id, case when id = 1 then p_brand else 'Имя & ' || p_type end as artist, p_name as title, 'https://genius.com/' || p_partkey || '/' || id as url from n"""


def netease_answers(spark, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    song = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") * 1000).alias("duration"), F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.col("p_type").alias("name"))).alias("artists"))
    words = F.struct((F.col("p_partkey") % 3 == 0).alias("nolyric"), F.lit(False).alias("uncollected"), F.struct(F.concat(F.lit("[00:01.00]作词 : x\n[00:02.00] "), "p_name", F.lit("\n[00:03.00]"), "p_type").alias("lyric")).alias("lrc"))
    return p.select("p_partkey", F.to_json(F.struct(F.struct(F.array(song).alias("songs")).alias("result"))).alias("answer"), F.to_json(words).alias("words"))


def reports(spark, sf_dir: str) -> DataFrame:
    """Events as progress of one job a user: milliseconds are small so that some fall within an interval."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("job"), F.col("event_id").alias("no"), F.col("event_type").alias("stage"), (F.col("event_id") * 7 % 100000).alias("ms"), (F.col("event_id") % 10).alias("done"), F.lit(9).cast("bigint").alias("total"))


THROTTLE = """with recursive r as (select user_id as job, event_id as no, event_type as stage, event_id * 7 % 100000 as ms, event_id % 10 as done, row_number() over (partition by user_id order by event_id * 7 % 100000, event_id) as i from events),
s(job, i, kept, stage, last) as (select job, i, no, stage, ms from r where i = 1
 union all select r.job, r.i, case when r.stage = s.stage and r.done < 9 and r.ms - s.last < 80 then null else r.no end, case when r.stage = s.stage and r.done < 9 and r.ms - s.last < 80 then s.stage else r.stage end, case when r.stage = s.stage and r.done < 9 and r.ms - s.last < 80 then s.last else r.ms end from s join r on r.job = s.job and r.i = s.i + 1)
select job, kept as no from s where kept is not null"""


def tries(spark, sf_dir: str) -> DataFrame:
    """An attempt for each part, with a guest for some."""
    p = read(spark, sf_dir, "part")
    guests = F.when(F.col("p_partkey") % 2 == 0, F.array("p_brand")).otherwise(F.array().cast(T.STRINGS))
    return p.select(F.col("p_partkey").alias("path"), F.lit(0).alias("attempt"), F.col("p_type").alias("artist"), F.col("p_name").alias("title"), F.array().cast(T.STRINGS).alias("qualifiers"), guests.alias("guests"), F.col("p_brand").alias("album"), (F.col("p_partkey") % 5).alias("k"))


def slug_sql(x: str) -> str:
    text = rep(rep(f"replace(lower({x}), '&', ' and ')", "['’]"), W.SLUG_BREAK, "-")
    body = f"trim({text}, '-')"
    return rf"(case when regexp_matches(regexp_replace({x}, '[\x00-\x7f]', '', 'g'), '\p{{L}}') then '' else upper(left({body}, 1)) || substr({body}, 2) end)"


def pages_of(spark, sf_dir: str) -> DataFrame:
    """Pages at the addresses that some parts' names make: the lead's alone, the guest's first, without words."""
    p = read(spark, sf_dir, "part")
    at = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_type", F.lit(" and "), "p_brand", F.lit(" "), "p_name")).otherwise(F.concat("p_type", F.lit(" "), "p_name"))
    rows = p.groupBy(T.slug(at).alias("slug")).agg(F.max("p_partkey").alias("k"))
    return rows.select("slug", F.when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("words of "), F.col("k").cast("string"))).alias("lyrics"))


ADDRESS = f"""with n as (select *, {slug_sql("p_type || ' ' || p_name")} as one, {slug_sql("p_type || ' and ' || p_brand || ' ' || p_name")} as two from part),
pages as (select case when p_partkey % 4 = 0 then two else one end as slug, max(p_partkey) as k from n group by 1),
w as (select slug, 'words of ' || k as lyrics from pages where k % 3 <> 0)
select p_partkey as path, coalesce(a.lyrics, b.lyrics) as lyrics from n left join w a on a.slug = one left join w b on b.slug = two and p_partkey % 2 = 0 where coalesce(a.lyrics, b.lyrics) is not null"""


def links(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages of the conversations, and tracks that point at them; some addresses are none."""
    c = read(spark, sf_dir, "conversations").filter("turn = 0")
    url = F.concat(F.lit("https://www.azlyrics.com/"), F.col("conv_id").cast("string"))
    page = F.concat(F.lit("<div><!-- Usage of azlyrics.com content by any third-party -->"), F.lit("line one<br>line two<br>line three<br>line four<br>"), F.col("conv_id").cast("string"), F.lit("</div>"))
    asked = c.select(F.col("conv_id").cast("string").alias("path"), F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("ftp://x/"), F.col("conv_id").cast("string"))).otherwise(F.concat(F.lit("  "), url, F.lit(" "))).alias("url"))
    return asked, c.select(url.alias("url"), page.alias("html"))


def itunes_lines(spark, sf_dir: str) -> DataFrame:
    """A tab-separated export for each brand: a heading, then a line a part; keys start at 0, so the heading's line comes before."""
    p = read(spark, sf_dir, "part")
    head = p.select(F.col("p_brand").alias("playlist_id")).distinct().select("playlist_id", F.lit(-1).cast("bigint").alias("pos"), F.lit("Name\tArtist\tAlbum\tDauer\tSize\tLocation").alias("line"))
    place = F.when(F.col("p_partkey") % 6 == 0, "").otherwise(F.concat(F.lit("D:\\m\\"), "p_name"))
    return head.unionByName(p.select(F.col("p_brand").alias("playlist_id"), F.col("p_partkey").alias("pos"), F.concat_ws("\t", "p_name", "p_type", F.lit("al"), F.col("p_size").cast("string"), F.lit("1"), place).alias("line")))


def playlist_files(spark, sf_dir: str) -> DataFrame:
    """A nested playlist for each part, well-formed or not: .xspf, .wpl or a library, as bytes."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " &amp; x").otherwise(" & x&nbsp;y"))
    track = F.concat(F.lit("<track><location>/m/a%20b/"), k, F.lit(".mp3</location><title>"), name, F.lit("</title><creator>"), "p_brand", F.lit("</creator><duration>"), F.col("p_size").cast("string"), F.lit("500</duration></track>"))
    xspf = F.concat(F.lit('<?xml version="1.0"?><playlist xmlns="http://xspf.org/ns/0/"><trackList>'), track, F.lit("<track><title>no place</title></track></trackList></playlist>"))
    wpl = F.concat(F.lit('<?wpl version="1.0"?><smil><body><seq><media src="/m/'), k, F.lit('.mp3"/><media src="x&amp;y.mp3"/>'), F.when(F.col("p_partkey") % 2 == 0, "</seq></body></smil>").otherwise("</body></smil>"))
    value = lambda key, v: F.concat(F.lit(f"<key>{key}</key>"), v)
    song = F.concat(F.lit("<dict>"), value("Location", F.concat(F.lit("<string>file:///m/"), k, F.lit("</string>"))), value("Name", F.concat(F.lit("<string>"), name, F.lit("</string>"))), value("Artist", F.lit("<string>A</string>")), value("Total Time", F.lit("<integer>61000</integer>")), F.lit("</dict>"))
    lists = F.concat(F.lit("<array><dict><key>Name</key><string>All</string><key>Master</key><true/></dict><dict><key>Name</key><string>Mine</string><key>Playlist Items</key><array><dict><key>Track ID</key><integer>7</integer></dict></array></dict></array>"))
    library = F.concat(F.lit('<?xml version="1.0"?><plist version="1.0"><dict><key>Tracks</key><dict><key>7</key>'), song, F.lit("</dict><key>Playlists</key>"), lists, F.lit("</dict></plist>"))
    kind = F.col("p_partkey") % 3
    return p.select(F.concat(F.lit("/l/"), k, F.when(kind == 0, ".xspf").when(kind == 1, ".wpl").otherwise(".xml")).alias("path"), F.encode(F.when(kind == 0, xspf).when(kind == 1, wpl).otherwise(library), "UTF-8").alias("content"))


NESTED = """with n as (select *, cast(p_partkey as varchar) as k, p_name || case when p_partkey % 2 = 0 then ' & x' else ' & x' || chr(160) || 'y' end as nm from part)
select '/l/' || k || '.xspf' as playlist_id, '/m/a b/' || k || '.mp3' as location, nm as title, p_brand as artist, cast(p_size as int) as duration from n where p_partkey % 3 = 0
union all select '/l/' || k || '.wpl', unnest(['/m/' || k || '.mp3', 'x&y.mp3']), '', '', -1 from n where p_partkey % 3 = 1
union all select '/l/' || k || '.xml#0', 'file:///m/' || k, nm, 'A', 61 from n where p_partkey % 3 = 2"""


def encoded_lists(spark, sf_dir: str) -> DataFrame:
    """One-line playlists in six encodings."""
    p = read(spark, sf_dir, "part")
    text = F.concat(F.lit("/m/"), "p_name", F.lit(".mp3\n"))
    kind = F.col("p_partkey") % 6
    data = (
        F.when(kind == 0, F.encode(text, "UTF-8")).when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).when(kind == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).when(kind == 3, F.encode(text, "UTF-16BE"))
        .when(kind == 4, F.unhex(F.lit("/м/песня номер один.mp3\n".encode("windows-1251").hex()))).otherwise(F.encode(F.lit("/m/café.mp3\n"), "ISO-8859-1"))
    )
    return p.select(F.concat(F.lit("/l/"), F.col("p_partkey").cast("string"), F.lit(".m3u")).alias("path"), data.alias("content"))


QUERIES = {
    "placeholder_names": over("part", "p_partkey", NAMES, T.is_placeholder, lambda v: f"{fold(v)} in {words_in(W.PLACEHOLDER_NAMES)}"),
    "guests": over("part", "p_partkey", CREDITS, lambda c: F.array_join(T.guests_in(c), "|"), lambda v: listed(guests_in(v))),
    "other_artists": over("part", "p_partkey", CREDITS, lambda c: F.array_join(T.other_artists(c), "|"), lambda v: listed(other_artists(v))),
    "lead_artists": over("part", "p_partkey", CREDITS, T.lead_artist, lead_artist),
    "non_latin": over("part", "p_partkey", CYRILLIC, T.has_non_latin, foreign),
    "translations": over("part", "p_partkey", CYRILLIC, T.without_translation, translated),
    "translation_lists": over("part", "p_partkey", f"concat('Имя (Name), Хор (Choir) & ', {CYRILLIC})", T.without_translations, lambda v: f"'Имя, Хор & ' || {translated(trim(f"substr({v}, 27)"))}"),
    "editions": over("part", "p_partkey", ALBUMS, T.strip_album, stripped),
    "aliases": (
        lambda s, d: read(s, d, "part").select("p_partkey", F.array_join(T.aliases(F.expr(TITLES)), "|").alias("value")),
        f"""with v as (select *, {clean_title('v')} as c from (select *, {TITLES} as v from part)), b as (select *, {bared('c')} as b, list_transform(regexp_extract_all(c, {q(W.ASIDE)}), lambda a: {trim('substr(a, 2, length(a) - 2)')}) as asides from v)
select p_partkey, {listed(f"list_concat({ASIDE_NAMES}, list_filter(asides, lambda a: len({long_words('a')}) > 0 and len(list_filter({long_words('a')}, lambda w: w in {words_in(W.FILE_QUALIFIERS, W.RECORDING_WORDS)} or {has('w', W.VERSION_WORD)})) = 0 and len(list_filter({long_words('a')}, lambda w: {has('w', LETTER)})) > 0))")} as value from b""",
    ),
    "hook_attempts": (
        lambda s, d: read(s, d, "part").select("p_partkey", T.hook_attempt(F.expr(HOOKS), T.qualifiers(F.expr(HOOKS))).alias("value")),
        f"""with v as (select *, {clean_title('v')} as c from (select *, {HOOKS} as v from part)), b as (select *, {bared('c')} as b, {qualifiers('c')} as ql, list_transform({long_words('v')}, lambda w: {stem('w')}) as st from v)
select p_partkey, {fold('b')} = {fold('v')} and not (len(ql) > 0 and len(list_filter(ql, lambda w: not list_contains(st, w))) = 0) and len(list_filter(string_split_regex(b, '\\s+'), lambda w: w <> '')) between 2 and 6 and strlen({fold('b')}) >= 8 as value from b""",
    ),
    "same_names": (
        lambda s, d: read(s, d, "part").select("p_partkey", T.same_name(F.expr(TITLES), F.concat("p_name", F.lit(" [Official Video]"))).alias("value")),
        f"""with v as (select *, {clean_title('v')} as c, {clean_title("p_name || ' [Official Video]'")} as e from (select *, {TITLES} as v from part))
select p_partkey, {similarity(fold('c'), fold('e'))} >= {W.NAME_SCORE} or {similarity(fold(bared('c')), fold(bared('e')))} >= {W.NAME_SCORE} as value from v""",
    ),
    "slugs": over("part", "p_partkey", SLUGS, T.slug, slug_sql),
    "site_names": (
        lambda s, d: read(s, d, "pages").select("page_id", T.site_name(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://www.genius.com/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))).alias("value")),
        "select page_id, case when page_id % 5 = 0 then 'Genius' else regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', ''), '^m\\.', ''), '^ru\\.', ''), '^en\\.', '') end as value from pages",
    ),
    "order_numbers": (
        lambda s, d: read(s, d, "orders").select("o_orderkey", T.leading_number(F.col("o_orderpriority")).alias("leading"), T.first_number(F.concat(F.lit("no. "), F.col("o_orderkey").cast("string"), F.lit("/9"))).alias("first"), T.parse_year(F.expr(YEARS)).alias("year"), T.is_true(F.expr(FLAGS)).alias("flag"), T.format_number(F.col("o_orderkey") % 3).alias("shown")),
        f"select o_orderkey, coalesce(try_cast(nullif(regexp_extract({trim('o_orderpriority')}, '^[0-9]+', 0), '') as int), 0) as leading, cast(o_orderkey as int) as first, coalesce(try_cast(left({YEARS}, 4) as int), 0) as year, {trim(f'({FLAGS})')} not in ('', '0', 'false', 'no') as flag, case when o_orderkey % 3 > 0 then cast(o_orderkey % 3 as varchar) else '' end as shown from orders",
    ),
    "summaries": over("conversations", "conv_id", "text", T.summarise, lambda v: f"(select case when length(l) > 48 then left(l, 48) || '…' else l end from (select split_part({trim(v)}, chr(10), 1) as l))"),
    "megabytes": over("part", "p_partkey", "p_partkey * 104729", T.megabytes, lambda v: f"printf('%.1f MB', {v} / 1048576.0::double)"),
    "clean_texts": over("part", "p_partkey", CONTROLS, T.clean_text, lambda v: trim(rep(v, r"[\x00-\x08\x0B-\x1F]"))),
    "normal_keys": over("part", "p_partkey", "concat(' ', p_name, '_', p_type, '-x ')", T.normal_key, lambda v: f"translate(upper({trim(v)}), ' _-', '')"),
    "media_names": (
        lambda s, d: read(s, d, "part").select("p_partkey", T.extension(F.expr(FILES)).alias("extension"), T.is_media_name(F.expr(FILES)).alias("media"), T.is_playlist_name(F.expr(FILES)).alias("playlist")),
        f"select p_partkey, e as extension, e in {words_in(W.MEDIA_EXTENSIONS)} as media, e in {words_in(W.PLAYLIST_EXTENSIONS)} as playlist from (select *, lower(regexp_extract({FILES}, '([.][^./]*)$', 1)) as e from part)",
    ),
    "display_titles": (
        lambda s, d: V.tracks(s, d).select("path", L.display_title(F.when(F.col("trackNo") % 2 == 0, F.col("title")).otherwise(" "), F.col("path")).alias("value")),
        f"with {TRACKS} select path, case when trackNo % 2 = 0 then {trim('title')} else regexp_extract(path, '([^/]*)[.]mp3$', 1) end as value from tracks",
    ),
    "retryable_codes": over("events", "event_id", "cast(400 + event_id % 130 as int)", M.retryable, lambda v: f"{v} = 429 or {v} >= 500"),
    "container_words": (
        lambda s, d: read(s, d, "conversations").select("conv_id", "turn", H.containers(container_page(F.col("text"))).alias("words")),
        f"select conv_id, turn, {trim('text')} || 'end' as words from conversations",
    ),
    "declared_words": (
        lambda s, d: read(s, d, "conversations").select("conv_id", "turn", H.declared_lyrics(F.concat(F.lit('<script>{"lyrics": {"id": 1, "text": '), json_text(F.col("text")), F.lit("}}</script>"))).alias("words")),
        f"select conv_id, turn, {trim("replace(text, '′', '''')")} as words from conversations",
    ),
    "amalgama_words": (
        lambda s, d: read(s, d, "conversations").select("conv_id", "turn", H.amalgama(F.concat(F.lit('<div class="original">'), F.regexp_replace("text", r"\n", '</div><div class="translate">x</div><div class="original">'), F.lit('</div><div class="original"><a href="/">more</a></div>'))).alias("words")),
        f"select conv_id, turn, {trim("regexp_replace(text, ' *' || chr(10) || ' *', chr(10), 'g')")} as words from conversations",
    ),
    "lrclib_entries": (lambda s, d: lrclib_answers(s, d).select("conv_id", "turn", F.explode(PR.lrclib_entries(F.col("answer"))).alias("e")).select("conv_id", "turn", "e.artist", "e.title", "e.lyrics", "e.duration"), LRCLIB),
    "genius_hits": (lambda s, d: genius_answers(s, d).select("p_partkey", F.explode(PR.genius_hits(F.col("answer"))).alias("h")).select("p_partkey", "h.id", "h.artist", "h.title", "h.url"), GENIUS),
    "netease_songs": (
        lambda s, d: netease_answers(s, d).select("p_partkey", "answer", PR.netease_words(F.col("words")).alias("w")).select("p_partkey", F.explode(PR.netease_songs(F.col("answer"))).alias("x"), "w").select("p_partkey", "x.artist", "x.title", "x.url", "x.duration", "w.plain", "w.synced"),
        "select p_partkey, p_brand || ' & ' || p_type as artist, p_name as title, 'https://music.163.com/#/song?id=' || p_partkey as url, p_size::double as duration, case when p_partkey % 3 = 0 then '' else p_name || chr(10) || p_type end as plain, case when p_partkey % 3 = 0 then '' else '[00:02.00]' || p_name || chr(10) || '[00:03.00]' || p_type end as synced from part",
    ),
    "hits_by_url": (
        lambda s, d: PR.first_by_url(read(s, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("pos"), F.concat(F.lit("u/"), (F.col("event_id") % 7).cast("string")).alias("url")), ["job"]).select("job", "pos", "url"),
        f"with f as (select user_id as job, 'u/' || (event_id % 7) as url, min(event_id) as pos from events group by all) select job, pos, url from (select *, row_number() over (partition by job order by pos) as no from f) where no <= {PR.HITS}",
    ),
    "progress_reports": (lambda s, d: G.throttled(reports(s, d)).select("job", "no"), THROTTLE),
    "address_lookup": (lambda s, d: M.by_address(tries(s, d), pages_of(s, d)).select("path", "lyrics"), ADDRESS),
    "links_read": (
        lambda s, d: M.from_link(*links(s, d), H.page_lyrics(F.col("url"), F.col("html"))).select("path", "source", "url", "lyrics", "score"),
        "select cast(conv_id as varchar) as path, 'AZLyrics' as source, 'https://www.azlyrics.com/' || conv_id as url, 'line one' || chr(10) || 'line two' || chr(10) || 'line three' || chr(10) || 'line four' || chr(10) || conv_id as lyrics, 1.0::double as score from conversations where turn = 0 and conv_id % 4 <> 0",
    ),
    "field_then_text": (
        lambda s, d: M.field_then_text(tries(s, d).filter("k < 2").select("path", "attempt", F.lit("field").alias("how")), tries(s, d).filter("k > 0").select("path", "attempt", F.lit("text").alias("how"))).select("path", "how"),
        "select p_partkey as path, case when p_partkey % 5 < 2 then 'field' else 'text' end as how from part",
    ),
    "itunes_text_parse": (
        lambda s, d: PL.itunes_text_entries(itunes_lines(s, d)).select("playlist_id", "location", "title", "artist", "duration"),
        "select p_brand as playlist_id, 'D:\\m\\' || p_name as location, p_name as title, p_type as artist, cast(case when p_size > 0 then p_size else -1 end as int) as duration from part where p_partkey % 6 <> 0",
    ),
    "nested_playlists": (lambda s, d: PL.parse_files(playlist_files(s, d))[1].select("playlist_id", "location", "title", "artist", "duration"), NESTED),
    "playlist_encodings": (
        lambda s, d: PL.parse_files(encoded_lists(s, d))[1].select("playlist_id", "location"),
        "select '/l/' || p_partkey || '.m3u' as playlist_id, case when p_partkey % 6 < 4 then '/m/' || p_name || '.mp3' when p_partkey % 6 = 4 then '/м/песня номер один.mp3' else '/m/café.mp3' end as location from part",
    ),
    "artists_in_order": (
        lambda s, d: L.names_in_order(L.artist_reduce(V.tracks(s, d)), 20).select("name", "tracks"),
        f"select name, tracks from ({library_queries.QUERIES['artist_reduce'][1]}) order by tracks desc, lower(name), name limit 20",
    ),
    "albums_in_order": (
        lambda s, d: L.albums_in_order(L.albums(V.tracks(s, d))[0].filter("owner is not null"), 20).select("owner", "name", "tracks"),
        f"select owner, name, tracks from ({library_queries.QUERIES['album_reduce'][1]}) where owner is not null order by tracks desc, lower(name), owner limit 20",
    ),
    "junk_in_order": (
        lambda s, d: L.junk_in_order(L.junk_albums(V.tracks(s, d)), 15).select("value", "tracks", "first_path"),
        f"select value, tracks, first_path from ({library_queries.QUERIES['junk_albums'][1]}) order by tracks desc, first_path limit 15",
    ),
}
