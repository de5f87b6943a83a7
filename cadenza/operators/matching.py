"""Matching tracks with candidate texts: search attempts, scores, the best acceptable candidate.

attempts: one row per search, (path, attempt, artist, title, qualifiers, guests, duration), best first, at most MAX_ATTEMPTS a track.
candidates: (round, source, pos, artist, title, lyrics, duration, hook, sameAlbum) and what they are joined by. Everything that a score
needs of one side is computed before the join, once for each row of that side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import words as W
from ..functions.arrow import composed


def first_by_fold(names: Column) -> Column:
    """Names that fold alike once, the first kept."""

    def add(kept: Column, name: Column) -> Column:
        return F.when(F.exists(kept, lambda k: T.fold(k) == T.fold(name)), kept).otherwise(F.array_append(kept, name))

    return F.aggregate(names, F.array().cast(T.STRINGS), add)


def queries(tracks: DataFrame) -> DataFrame:
    """path, artists, titles, qualifiers and guests of a track's searches, before they are paired."""
    rows = tracks.select("path", "artist", "albumArtist", T.go_trim(F.col("title")).alias("tag_title"), F.col("title").alias("raw_title"), T.name_from_file(F.col("path")).alias("file"))
    leads = lambda *names: F.filter(F.transform(F.array(*names), lambda n: T.lead_artist(T.go_trim(n))), lambda n: n != "")
    real = F.filter(leads("artist", "albumArtist", "file.artist"), lambda n: ~T.is_placeholder(n))
    rows = rows.withColumn("real", first_by_fold(real)).withColumn("stand_in", F.slice(leads("artist", "albumArtist"), 1, 1))
    rows = rows.withColumn("artists", F.when(F.size("real") > 0, F.col("real")).otherwise(F.col("stand_in")))
    title = F.when(F.col("tag_title") != "", F.col("tag_title")).otherwise(F.col("file.title"))
    rows = rows.withColumn("named", T.without_leading_artist(title, F.concat("artists", F.array("artist", "file.artist"))))
    rows = rows.withColumn("clean", T.clean_title(F.col("named"))).withColumn("bare", T.bare_title(F.col("named"))).withColumn("qualifiers", T.qualifiers(F.col("named")))
    described = F.when(F.size("qualifiers") > 0, F.concat(F.col("bare"), F.lit(" "), F.array_join("qualifiers", " ")))
    plain = F.when(F.lower("bare") != F.lower("clean"), F.col("bare"))
    file_title = T.clean_title(T.without_leading_artist(F.col("file.title"), F.col("artists")))
    titles = F.concat(F.array("clean", described, plain), T.aliases(F.col("named")), F.array(F.nullif(file_title, F.lit(""))))
    guests = F.concat(T.guests_in(F.concat(F.col("raw_title"), F.lit(" "), F.col("artist"))), T.other_artists(F.col("artist")), T.other_artists(F.col("albumArtist")), T.other_artists(F.col("file.artist")))
    out = rows.select("path", "artists", F.filter(titles, lambda t: F.coalesce(t, F.lit("")) != "").alias("titles"), "qualifiers", guests.alias("guests"), "clean")
    return out.filter((F.size("artists") > 0) & (F.col("clean") != "")).drop("clean")


def attempts(tracks: DataFrame) -> DataFrame:
    """path, attempt (from 0), artist, title, qualifiers, guests: each title with each artist, pairs that fold alike once."""
    pair = F.transform("titles", lambda t: F.transform("artists", lambda a: F.struct(a.alias("artist"), t.alias("title"), F.concat(T.fold(a), F.lit("\x01"), T.fold(t)).alias("key"))))
    none = F.array().cast("array<struct<artist:string,title:string,key:string>>")
    keep = F.aggregate(F.flatten(pair), none, lambda kept, p: F.when(F.exists(kept, lambda k: k.key == p.key), kept).otherwise(F.array_append(kept, p)))
    rows = queries(tracks).select("path", F.posexplode(F.slice(keep, 1, W.MAX_ATTEMPTS)).alias("attempt", "p"), "qualifiers", "guests")
    return rows.select("path", "attempt", composed(F.col("p.artist")).alias("artist"), composed(F.col("p.title")).alias("title"), "qualifiers", "guests")


def side(artist: str, title: str, extra: dict[str, Column] | None = None) -> Column:
    """What a score needs of one side's names; folded names are as bytes."""
    a, t = F.col(artist), F.col(title)
    folded = lambda c: T.as_bytes(T.fold(c))
    parts = {
        "clean": folded(T.clean_title(t)),
        "bare": folded(T.bare_title(t)),
        "title_words": T.long_words(t),
        "artist": folded(a),
        "lead": folded(T.lead_artist(a)),
        "artist_words": T.long_words(a),
        **(extra or {}),
    }
    return F.struct(*(c.alias(n) for n, c in parts.items()))


def query_side(rows: DataFrame, name: str = "q") -> DataFrame:
    """rows with a struct of the attempt's names, its qualifiers (those of its title, where there is no such column), guests and duration (null: unknown)."""
    given = lambda c, other: F.col(c) if c in rows.columns else other
    guests = F.transform(given("guests", F.array().cast(T.STRINGS)), lambda g: F.struct(T.as_bytes(T.fold(g)).alias("name"), T.long_words(g).alias("words")))
    extra = {"qualifiers": given("qualifiers", T.qualifiers(F.col("title"))), "guests": guests, "duration": given("duration", F.lit(None).cast("double"))}
    return rows.withColumn(name, side("artist", "title", extra))


def candidate_side(rows: DataFrame, name: str = "c") -> DataFrame:
    """rows with a struct of the candidate's names, its title's stems, duration and what its source has checked."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else F.lit(False)
    duration = F.col("duration") if "duration" in rows.columns else F.lit(None).cast("double")
    stems = F.transform(T.long_words(F.col("title")), T.stem)
    return rows.withColumn(name, side("artist", "title", {"stems": stems, "duration": duration, "hook": flag("hook"), "same_album": flag("sameAlbum")}))


def title_score(q: Column, c: Column) -> Column:
    """How close the titles are, 0 to 1; arguments as for score. What reads the same without its additions isn't compared again."""
    same = (q["bare"] == q["clean"]) & (c["bare"] == c["clean"])
    bare = F.when(same, 0.0).otherwise(T.bytes_similarity(q["bare"], c["bare"]))
    return F.greatest(T.bytes_similarity(q["clean"], c["clean"]), 0.95 * bare, 0.9 * T.words_overlap(q["title_words"], c["title_words"]))


def artist_score(q: Column, c: Column) -> Column:
    """How close a candidate's artist is to the attempt's or to one of its guests, 0 to 1; arguments as for score."""
    same = (q["lead"] == q["artist"]) & (c["lead"] == c["artist"])
    lead = F.when(same, 0.0).otherwise(T.bytes_similarity(q["lead"], c["lead"]))
    own = F.greatest(T.bytes_similarity(q["artist"], c["artist"]), lead, 0.9 * T.words_overlap(q["artist_words"], c["artist_words"]))
    guests = F.transform(q["guests"], lambda g: F.greatest(0.95 * T.bytes_similarity(g["name"], c["artist"]), 0.9 * T.words_overlap(g["words"], c["artist_words"])))
    return F.greatest(own, F.coalesce(F.array_max(guests), F.lit(0.0)))


def score(q: Column, c: Column) -> Column:
    """How well a candidate matches an attempt, 0 to 1; arguments are the structs of query_side and candidate_side."""
    return weighed(q, c, title_score(q, c), artist_score(q, c))


def weighed(q: Column, c: Column, title: Column, artist: Column) -> Column:
    """score() from those of title and artist, by what the source has checked, by recording and length."""
    artist = F.greatest(artist, F.when(c["same_album"], 0.85).otherwise(0.0))
    title = F.greatest(title, F.when(c["hook"], 0.85).otherwise(0.0))
    recording = F.when(F.size(q["qualifiers"]) == 0, 0.0).when(holds(q, c), 0.04).otherwise(-0.08)
    gap = F.abs(q["duration"] - c["duration"])
    length = F.when((q["duration"] > 0) & (c["duration"] > 0), F.when(gap <= 3, 0.06).when(gap > 20, -0.15).otherwise(0.0)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * title + 0.4 * artist + recording + length))


def holds(q: Column, c: Column) -> Column:
    """Whether a candidate has all qualifiers that are asked for; arguments as for score."""
    return F.size(F.array_except(q["qualifiers"], c["stems"])) == 0


def block_keys(title: Column) -> Column:
    """Candidates are searched by a shared word of three characters or more, or by the first three characters of the folded title."""
    return F.array_distinct(F.concat(T.long_words(title), F.array(F.concat(F.lit("#"), F.substring(T.fold(title), 1, 3)))))


def title_pairs(tries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distinct (title, c_title) that share a block key; only titles and their keys meet, and a pair counts by the first key that it shares."""
    keyed = lambda rows, name: rows.select(F.col("title").alias(name)).distinct().withColumn(f"{name}_keys", block_keys(F.col(name))).withColumn("key", F.explode(f"{name}_keys"))
    met = keyed(tries, "title").join(keyed(candidates, "c_title"), "key")
    return met.filter(F.col("key") == F.get(F.array_intersect("title_keys", "c_title_keys"), F.lit(0))).select("title", "c_title")


#: What scores depend on, of either side; and how many rows that agree in it are held together.
ASKED = ("artist", "title", "qualifiers", "guests", "duration")
KNOWN = ("artist", "title", "duration", "hook", "sameAlbum")
ALIKE = 1000
#: How many names of candidates are held together.
NAMES = 200


def alike(rows: DataFrame, on: list[str], names: tuple[str, ...], of: str) -> DataFrame:
    """Rows that agree in `on` and those of `names` that there are as one, with an array of what else they have; ALIKE at most, others in further ones."""
    by = [*on, *(n for n in names if n in rows.columns and n not in on)]
    no = F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))
    dealt = rows.repartition(*on).withColumn("__chunk", F.floor((no - 1) / ALIKE))
    return dealt.groupBy(*by, "__chunk").agg(F.collect_list(F.struct(*(c for c in rows.columns if c not in by))).alias(of)).drop("__chunk")


def scored_alike(tries: DataFrame, candidates: DataFrame, on: list[str], digits: int | None = None) -> DataFrame:
    """scored() by equal `on`: each pair of names and durations is scored once, whatever the number of rows that have it, and then expanded.

    Scores are rounded before that too, as rounding takes longer than all else that a row costs. Neither side is broadcast, as rows with arrays are larger than estimated.
    """
    left, right = query_side(alike(tries, on, ASKED, "__q")), candidate_side(alike(candidates, on, KNOWN, "__c"))
    q_own, c_own = [c for c in left.columns if c not in (*on, "__q", "q")], [c for c in right.columns if c not in (*on, "__c", "c")]
    right = right.select(*on, *(F.col(k).alias(f"c_{k}") for k in c_own), "__c", "c")
    worth = score(F.col("q"), F.col("c"))
    worth = worth if digits is None else F.round(worth, digits)
    pairs = left.join(right.hint("merge"), on).withColumn("score", worth).withColumn("qualified", holds(F.col("q"), F.col("c"))).drop("q", "c")
    rows = pairs.withColumn("__q", F.explode("__q")).withColumn("__c", F.explode("__c"))
    own = [F.col(k) if k in q_own else F.col(f"__q.{k}").alias(k) for k in tries.columns if k not in on]
    known = [F.col(f"c_{k}") if k in c_own else F.col(f"__c.{k}").alias(f"c_{k}") for k in candidates.columns if k not in on]
    return rows.select(*on, *own, *known, "score", "qualified")


def scored(tries: DataFrame, candidates: DataFrame, on: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Attempts with the candidates that share `on` (or else a block key of the title), and their score, rounded to `digits` if given.

    With block keys distinct titles meet first, and rows are joined to the pairs of titles that do; no side is compared as a whole with the other.
    """
    if on:
        return scored_alike(tries, candidates, on, digits)
    left, right = query_side(tries), candidate_side(candidates)
    right = right.select(*(F.col(k).alias(f"c_{k}") for k in candidates.columns), "c")
    pairs = left.join(title_pairs(tries, candidates), "title").join(right, "c_title")
    worth = score(F.col("q"), F.col("c"))
    return pairs.withColumn("score", worth if digits is None else F.round(worth, digits)).withColumn("qualified", holds(F.col("q"), F.col("c"))).drop("q", "c")


def choices(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, with what the searches of one attempt come to: `best`, the accepted candidate (or null), and `near`, the closest; both start with their order.

    Keys tell the attempt. In each search of a source only its best candidate with words counts, even if these come to nothing when tidied;
    a best one below the least score is none, so only candidates with that score are sorted.
    """
    searched = pairs.filter((F.col("c_round") == 0) | (F.col("attempt") == 0))
    one = Window.partitionBy(*keys, "c_round", "c_source").orderBy(F.col("score").desc(), "c_pos")
    able = searched.filter((F.col("c_lyrics") != "") & (F.col("score") >= W.MIN_SCORE))
    worded = able.withColumn("no", F.row_number().over(one)).filter("no = 1").withColumn("words", T.tidy_lyrics(F.col("c_lyrics"))).filter("words <> ''")
    place, named = ("c_round", "c_source", "c_pos"), ("score", F.col("c_title").alias("title"))
    best = F.struct((~F.col("qualified")).alias("other"), F.when(F.col("qualified"), F.lit(0.0)).otherwise(-F.col("score")).alias("worse"), *place, *named, "words")
    near = F.struct((-F.col("score")).alias("worse"), *place, *named)
    found = worded.groupBy(*keys).agg(F.min(best).alias("best")).withColumn("near", F.lit(None).cast(searched.select(near.alias("x")).schema["x"].dataType))
    closest = searched.groupBy(*keys).agg(F.min(near).alias("near")).withColumn("best", F.lit(None).cast(found.schema["best"].dataType))
    return found.unionByName(closest).groupBy(*keys).agg(F.min("best").alias("best"), F.min("near").alias("near"))


def decided(chosen: DataFrame) -> DataFrame:
    """One row a path of the choices of its attempts (path, attempt, best, near)."""
    first = lambda x, *order: F.min(F.when(F.col(x).isNotNull(), F.struct(*(F.col(f"{x}.{o}") for o in order), F.struct(f"{x}.c_round", "attempt", f"{x}.c_source", f"{x}.c_pos").alias("search"), F.col(x).alias("it")))).alias(x)
    rows = chosen.groupBy("path").agg(first("best", "other", "worse"), first("near", "worse")).select("path", F.col("best.it").alias("best"), F.col("near.it").alias("near"))
    near = F.when(F.col("near.score") >= W.MENTION_SCORE, F.col("near.title"))
    return rows.select("path", F.when(F.col("best").isNotNull(), "found").otherwise("missing").alias("status"), F.coalesce("best.title", near).alias("title"), F.coalesce("best.score", "near.score").alias("score"), F.col("best.c_source").alias("source"), F.col("best.words").alias("lyrics"))


def find_best(pairs: DataFrame) -> DataFrame:
    """The accepted candidate of each path, or the closest one that is worth a mention.

    Pairs: path, attempt, score, qualified and c_round, c_source, c_pos, c_title, c_lyrics. The first search that gives the wanted recording
    ends it, else the highest score wins. Rounds after the first search with the first attempt only.
    """
    return decided(choices(pairs, ["path", "attempt"]))


def firsts(rows: Column, of: tuple[str, ...]) -> Column:
    """The smallest of an array's structs for each value of their first fields, which are named."""
    other = lambda x, y: ~reduce(lambda a, b: a & b, (x[n].eqNullSafe(y[n]) for n in of))
    return T.let(F.array_sort(rows), lambda s: F.filter(s, lambda x, i: (i == 0) | other(x, F.get(s, i - 1))))


def offered(candidates: DataFrame, on: list[str]) -> DataFrame:
    """on, names, titles, artists: what candidates' names are scored by, at most NAMES a row; titles and artists are distinct, names have their places there.

    A name has `offers`, the first candidate of each search with words and without, and the first place of all of them (`place`) and of those in round 0 (`early`).
    """
    own = ("round", "source", "pos", "lyrics")
    rows = alike(candidates.select(*dict.fromkeys([*on, *(n for n in KNOWN if n in candidates.columns), *own])), on, KNOWN, "__c")
    of = lambda x, n: F.col(n) if n in rows.columns else x[n]
    offer = lambda x: F.struct(of(x, "round").alias("round"), of(x, "source").alias("source"), F.coalesce(of(x, "lyrics") != "", F.lit(False)).alias("worded"), of(x, "pos").alias("pos"), of(x, "lyrics").alias("lyrics"))
    first = lambda some: F.array_min(F.transform(some, lambda o: F.struct(o["round"].alias("c_round"), o["source"].alias("c_source"), o["pos"].alias("c_pos"))))
    named = F.struct("c", "title", "offers", first(F.col("offers")).alias("place"), first(F.filter("offers", lambda o: o["round"] == 0)).alias("early"))
    no = F.row_number().over(Window.partitionBy(*on).orderBy(F.lit(0)))
    dealt = candidate_side(rows).withColumn("offers", firsts(F.transform("__c", offer), ("round", "source", "worded"))).select(*on, named.alias("name"), F.floor((no - 1) / NAMES).alias("__block"))
    held = dealt.groupBy(*on, "__block").agg(F.collect_list("name").alias("names"))
    title = lambda n: F.struct(*(n["c"][x].alias(x) for x in ("clean", "bare", "title_words")))
    artist = lambda n: F.struct(*(n["c"][x].alias(x) for x in ("artist", "lead", "artist_words")))
    parts = held.select(*on, "names", F.array_distinct(F.transform("names", title)).alias("titles"), F.array_distinct(F.transform("names", artist)).alias("artists"))
    at = lambda some, x: (F.array_position(F.col(some), x) - 1).cast("int")
    rest = lambda n: F.struct(*(n["c"][x].alias(x) for x in ("stems", "duration", "hook", "same_album")))
    name = lambda n: F.struct(rest(n).alias("c"), at("titles", title(n)).alias("t"), at("artists", artist(n)).alias("a"), *(n[x].alias(x) for x in ("title", "offers", "place", "early")))
    return parts.select(*on, F.transform("names", name).alias("names"), "titles", "artists")


def best_of(tries: DataFrame, candidates: DataFrame, on: list[str]) -> DataFrame:
    """find_best(scored(tries, candidates, on)) without its pairs of rows.

    Attempts that agree in all that a score depends on come to one choice, and of candidates of a search that agree in it only the first
    with words and the first without can be chosen. Names of candidates meet an attempt's in arrays: each title and each artist there is
    compared once, and only what can be chosen leaves the row.
    """
    asked = tries.select(*dict.fromkeys([*on, *(n for n in ASKED if n in tries.columns), "path", "attempt"]), (F.col("attempt") == 0).alias("first"))
    left = query_side(alike(asked, on, (*ASKED, "first"), "__q")).select(*on, "q", "first", "__q")
    q, place, search = F.col("q"), ("c_round", "c_source", "c_pos"), ("c_round", "c_source")

    def scores(parts: Column) -> Column:
        of = lambda n: weighed(q, n["c"], F.get(parts["titles"], n["t"]), F.get(parts["artists"], n["a"]))
        return F.transform("names", lambda n: F.struct(of(n).alias("score"), F.when(F.col("first"), n["place"]).otherwise(n["early"]).alias("at"), n.alias("name")))

    def chosen(names: Column) -> Column:
        placed = F.filter(names, lambda x: x["at"].isNotNull())
        near = lambda x: F.struct((-x["score"]).alias("worse"), *(x["at"][p].alias(p) for p in place), x["score"].alias("score"), x["name"]["title"].alias("title"))
        able = lambda o: o["worded"] & (F.col("first") | (o["round"] == 0))
        one = lambda x, o: F.struct(o["round"].alias("c_round"), o["source"].alias("c_source"), (-x["score"]).alias("worse"), o["pos"].alias("c_pos"), x["score"].alias("score"), x["name"]["title"].alias("title"), holds(q, x["name"]["c"]).alias("qualified"), o["lyrics"].alias("lyrics"))
        good = F.transform(F.filter(names, lambda x: x["score"] >= W.MIN_SCORE), lambda x: F.transform(F.filter(x["name"]["offers"], able), lambda o: one(x, o)))
        nearest = T.let(F.array_max(F.transform(placed, lambda x: x["score"])), lambda most: F.array_min(F.transform(F.filter(placed, lambda x: x["score"] == most), near)))
        return F.struct(nearest.alias("near"), firsts(F.flatten(good), search).alias("good"))

    def best(x: Column) -> Column:
        return F.struct((~x["qualified"]).alias("other"), F.when(x["qualified"], F.lit(0.0)).otherwise(-x["score"]).alias("worse"), *(x[p].alias(p) for p in place), x["score"].alias("score"), x["title"].alias("title"), T.tidy_lyrics(x["lyrics"]).alias("words"))

    parts = F.struct(F.transform("titles", lambda c: title_score(q, c)).alias("titles"), F.transform("artists", lambda c: artist_score(q, c)).alias("artists"))
    met = left.join(offered(candidates, on).hint("merge"), on).select(*on, "q", "first", "__q", T.let(parts, lambda p: T.let(scores(p), chosen)).alias("it"))
    both = met.groupBy(*on, "q", "first", "__q").agg(F.min("it.near").alias("near"), F.flatten(F.collect_list("it.good")).alias("good")).filter("near is not null")
    worded = F.filter(F.transform(firsts(F.col("good"), search), best), lambda x: x["words"] != "")
    return decided(both.select("near", F.array_min(worded).alias("best"), "__q").withColumn("a", F.explode("__q")).select("a.path", "a.attempt", "best", "near"))


def opened(pairs: DataFrame, rule: str) -> DataFrame:
    """The candidates that a source would have opened: `names` keeps two with a close name before their words are known, `lyrics` two that have words."""
    close = pairs.filter(F.col("score") >= 0.5)
    if rule == "lyrics":
        close = close.filter("c_lyrics <> ''")
    else:
        close = close.filter(T.same_name(F.col("title"), F.col("c_title")))
    order = Window.partitionBy("path", "attempt", "c_source").orderBy(F.col("score").desc(), "c_pos")
    return close.withColumn("no", F.row_number().over(order)).filter("no <= 2").drop("no")


def by_hook(tries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates by the title alone whose lead is the attempt's and whose words repeat the title: (path, attempt, pos)."""
    wanted = tries.filter(T.hook_attempt(F.col("title"), F.col("qualifiers"))).withColumn("phrase", T.bare_title(F.col("title"))).withColumn("lead", T.fold(T.lead_artist(F.col("artist"))))
    named = candidates.select(F.col("pos"), F.col("lyrics"), T.fold(T.lead_artist(F.col("artist"))).alias("c_lead"))
    pairs = wanted.join(named, wanted.lead == named.c_lead).filter(T.hook_count(F.col("lyrics"), F.col("phrase")) >= W.HOOK_REPEATS)
    first = Window.partitionBy("path", "attempt").orderBy("pos")
    return pairs.withColumn("no", F.row_number().over(first)).filter("no = 1").select("path", "attempt", "pos")


def by_album(tries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (pos, artist, title, album) under the attempt's title on its album (tries with `album`): (path, attempt, pos), their sameAlbum is true.

    Names are compared without the translations that a catalogue adds; the two closest titles of an attempt are asked for their album.
    """
    plain = lambda c: T.fold(T.without_translations(F.col(c)))
    asked = tries.filter("album <> ''").withColumn("key", F.explode(block_keys(F.col("title")))).withColumn("t", T.fold(T.bare_title(F.col("title")))).withColumn("al", T.fold(F.col("album")))
    known = candidates.select("pos", plain("title").alias("c_t"), plain("album").alias("c_al"), F.explode(block_keys(T.without_translations(F.col("title")))).alias("key"))
    close = asked.join(known, "key").withColumn("near", T.folded_similarity(F.col("t"), F.col("c_t"))).filter("near >= 0.9").dropDuplicates(["path", "attempt", "pos"])
    first = Window.partitionBy("path", "attempt").orderBy(F.col("near").desc(), "pos")
    two = close.withColumn("no", F.row_number().over(first)).filter("no <= 2")
    return two.filter(T.folded_similarity(F.col("al"), F.col("c_al")) >= 0.85).select("path", "attempt", "pos")


def exact(tries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The last round's lookup by (artist, title), for the first attempt only; an answer bears the names that were asked for."""
    asked = tries.filter("attempt = 0").select("path", "attempt", "artist", "title", T.fold(T.lead_artist(F.col("artist"))).alias("a"), T.fold(F.col("title")).alias("t"))
    known = catalogue.select(T.fold(F.col("artist")).alias("a"), T.fold(F.col("title")).alias("t"), "lyrics")
    return asked.join(known, ["a", "t"]).drop("a", "t")


#: Rounds of sources, and their order within a round.
SOURCES = ((0, 0, "LRCLIB"), (0, 1, "NetEase"), (0, 2, "Genius"), (1, 0, "lyrics.ovh"))


def addresses(tries: DataFrame, most: int = 2) -> DataFrame:
    """(path, attempt, no, slug): the addresses that an attempt's page may have, its lead's alone and with each guest on either side."""
    lead = T.lead_artist(F.col("artist"))
    guests = F.col("guests") if "guests" in tries.columns else F.array().cast(T.STRINGS)
    joined = F.flatten(F.transform(guests, lambda g: F.array(F.concat(F.col("__lead"), F.lit(" and "), g), F.concat(g, F.lit(" and "), F.col("__lead")))))
    rows = tries.withColumn("__lead", lead).withColumn("__credits", F.concat(F.array("__lead"), joined)).withColumn("__title", T.clean_title(F.col("title")))
    slugs = F.filter(F.transform("__credits", lambda c: T.slug(F.concat(c, F.lit(" "), F.col("__title")))), lambda x: x != "")
    return rows.select("path", "attempt", F.posexplode(F.slice(slugs, 1, most)).alias("no", "slug"))


def by_address(tries: DataFrame, pages: DataFrame) -> DataFrame:
    """The first page (slug, lyrics) with words at an address of each attempt: (path, attempt, lyrics)."""
    found = addresses(tries).join(pages.filter("lyrics <> ''"), "slug")
    return found.groupBy("path", "attempt").agg(F.min_by("lyrics", "no").alias("lyrics"))


def field_then_text(by_field: DataFrame, by_text: DataFrame) -> DataFrame:
    """A service's candidates (path, attempt, ...) by artist and title; those by free text only where that search found none."""
    return fallback(by_field, by_text, ["path", "attempt"])


def searched(pairs: DataFrame, hooked: DataFrame, on_album: DataFrame) -> DataFrame:
    """A service's candidates by name (two that have words); by a line of the song where none of these is accepted, then by the album."""
    named = opened(pairs, "lyrics")
    keys = ["path", "attempt"]
    accepted = any_accepted(named, keys).filter("accepted").select(*keys)
    extra = hooked.join(accepted, keys, "left_anti")
    more = any_accepted(union_all(named.select(*keys, "score"), extra.select(*keys, "score")), keys).filter("accepted").select(*keys)
    found = [named.select(*keys, F.col("c_pos").alias("pos"), "score"), extra.select(*keys, "pos", "score"), on_album.join(more, keys, "left_anti").select(*keys, "pos", "score")]
    return union_all(*found)


def from_link(links: DataFrame, pages: DataFrame, lyrics: Column) -> DataFrame:
    """Pages that were pointed at (path, url), read by their site's reader: score 1, since nothing is left to judge; null where no words are."""
    address = T.go_trim(F.col("url"))
    asked = links.withColumn("url", address).filter(F.col("url").rlike(r"^(?i)https?://[^/?#]+"))
    read = asked.join(pages.select("url", "html"), "url").withColumn("lyrics", lyrics)
    return read.filter("lyrics <> ''").select("path", T.site_name(F.col("url")).alias("source"), "url", "lyrics", F.lit(1.0).alias("score"))


def fallback(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """First choices, and second ones only for keys that have no first."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def any_accepted(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.bool_or(F.col("score") >= W.MIN_SCORE).alias("accepted"))


def retryable(code: Column) -> Column:
    return (code == 429) | (code >= 500)


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)
