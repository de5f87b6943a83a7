"""Attempts, scores, best candidates, markup."""

import pytest
from pyspark.sql import functions as F

from cadenza.functions import arrow as A
from cadenza.operators import markup as H
from cadenza.operators import matching as M


def tracks(spark, **more):
    row = {"path": "", "artist": "", "albumArtist": "", "title": ""} | more
    return spark.createDataFrame([tuple(row.values())], "path string, artist string, albumArtist string, title string")


def searches(spark, **more):
    rows = M.attempts(tracks(spark, **more)).orderBy("attempt").collect()
    return [(r.artist, r.title) for r in rows]


def test_attempts(spark):
    assert searches(spark, artist="VK", albumArtist="Night Yard", title="GREY BARN [Prod. Une]") == [("Night Yard", "GREY BARN")]
    assert [t for _, t in searches(spark, artist="Oda Brask", title="Undertow (Session Edit)")] == ["Undertow (Session Edit)", "Undertow session", "Undertow"]
    assert len(searches(spark, artist="Oda Brask", albumArtist="Oda Brask", title="Low Tide")) == 1
    assert ("PaleMoth", "GREY BARN") in searches(spark, artist="VK", title="GREY BARN", path="/m/PaleMoth x RustBee - GREY BARN.mp3")
    assert "Grey Water" in [t for _, t in searches(spark, artist="Oda Brask", title="Ebb's (Grey Water)")]
    assert "Row With Me Nite" in [t for _, t in searches(spark, artist="Oda Brask", title="Row With Me Night (Solo Session Edit)", path="/m/Oda_Brask_Row_With_Me_Nite_BPM_128_Stem_Mix_Master_v1_2.mp3")]
    assert searches(spark) == []
    guests = M.attempts(tracks(spark, artist="Тихий берег", path="/m/Тихий берег, Ясень - Отлив.mp3")).first().guests
    assert "Ясень" in guests


QUERY = "artist string, title string, qualifiers array<string>, guests array<string>, duration double"
CANDIDATE = "artist string, title string, duration double, hook boolean, sameAlbum boolean"


def scores(spark, query, *candidates):
    q = M.query_side(spark.createDataFrame([query], QUERY)).select("q")
    c = spark.createDataFrame([(i, *(x + (None, False, False)[len(x) - 2 :])) for i, x in enumerate(candidates)], "i int, " + CANDIDATE)
    rows = M.candidate_side(c).join(q, F.lit(True)).select("i", M.score(F.col("q"), F.col("c")).alias("s")).orderBy("i").collect()
    return [r.s for r in rows]


def test_score(spark):
    right, wrong, near = scores(spark, ("Oda Brask", "Low Tide", [], [], 240.0), ("Oda Brask", "Low Tide", 240.0), ("Mira Vant", "Lover"), ("Oda Brask", "Low Tide (Remix)"))
    assert right >= 0.9 and wrong <= 0.4 and near > wrong
    take, other = scores(spark, ("Oda Brask", "Undertow (Session Edit)", ["session"], [], None), ("Oda Brask", "Undertow (Studio Session)"), ("Oda Brask", "Wishing Well"))
    assert take >= 0.8 > other
    shared, stranger = scores(spark, ("PaleMoth x RustBee", "Bukkake", [], [], None), ("Night Yard (Ft. PaleMoth & RustBee)", "Bukkake"), ("Mira Vant", "Bukkake"))
    assert shared >= 0.62 and stranger < shared
    guest, plain = scores(spark, ("A", "Boomerang", [], ["Lil Yachty"], None), ("Lil Yachty", "Boomerang"), ("Mira Vant", "Boomerang"))
    assert guest > plain
    hooked, unhooked = scores(spark, ("A", "Row Me Home", [], [], None), ("A", "Extra", None, True, False), ("A", "Extra"))
    assert hooked > unhooked


def pairs(spark, rows):
    return spark.createDataFrame(rows, "path string, attempt int, score double, qualified boolean, c_round int, c_source string, c_pos int, c_title string, c_lyrics string")


WORDS = "words that are long enough to be a song"


def test_find_best(spark):
    got = M.find_best(pairs(spark, [("a", 0, 0.9, False, 0, "x", 0, "released", WORDS), ("a", 1, 0.7, True, 0, "x", 0, "session", WORDS), ("b", 0, 0.5, True, 0, "x", 0, "close", ""), ("c", 0, 0.9, True, 0, "x", 0, "stub", "la"), ("d", 1, 0.9, True, 1, "x", 0, "late", WORDS), ("e", 0, 0.3, True, 0, "x", 0, "far", WORDS)]))
    assert {r.path: (r.status, r.title) for r in got.collect()} == {"a": ("found", "session"), "b": ("missing", "close"), "c": ("missing", "stub"), "e": ("missing", None)}
    released = M.find_best(pairs(spark, [("a", 0, 0.9, False, 0, "x", 0, "released", WORDS)])).first()
    assert released.status == "found"


def test_generators(spark):
    tries = spark.createDataFrame([("a", 0, "Oda Brask", "Row Me Home", [])], "path string, attempt int, artist string, title string, qualifiers array<string>")
    words = "row me home la\n" * 3
    found = M.by_hook(tries, spark.createDataFrame([(1, "Oda Brask & X", "a"), (2, "ODA BRASK", words), (3, "oda brask", words)], "pos int, artist string, lyrics string"))
    assert [(r.path, r.pos) for r in found.collect()] == [("a", 2)]
    pages = spark.createDataFrame([("Oda-brask-row-me-home", "la")], "slug string, lyrics string")
    assert M.by_address(tries, pages).count() == 1
    asked = spark.createDataFrame([("a", 0, "A", "Прилив", "Альбом", []), ("b", 0, "A", "Song", "", [])], "path string, attempt int, artist string, title string, album string, qualifiers array<string>")
    albums = spark.createDataFrame([(1, "Б", "Прилив (Tide)", "Альбом (Album)"), (2, "Б", "Прилив", "Другой совсем")], "pos int, artist string, title string, album string")
    assert [(r.path, r.pos) for r in M.by_album(asked, albums).collect()] == [("a", 1)]
    assert [r.lyrics for r in M.exact(asked, spark.createDataFrame([("a!", "SONG", "la")], "artist string, title string, lyrics string")).collect()] == ["la"]
    a, b = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a")], [(1, "b"), (2, "c")]))
    assert {(r.k, r.v) for r in M.fallback(a, b, ["k"]).collect()} == {(1, "a"), (2, "c")}


def test_searches_of_a_service(spark):
    """Two by name that have words; a line of the song only where none of them is accepted, the album only where that gave none either."""
    named = pairs(spark, [("a", 0, 0.9, True, 0, "x", 0, "t", WORDS), ("a", 0, 0.8, True, 0, "x", 1, "t", WORDS), ("a", 0, 0.7, True, 0, "x", 2, "t", WORDS), ("b", 0, 0.55, True, 0, "x", 3, "t", WORDS), ("c", 0, 0.9, True, 0, "x", 4, "t", "")])
    more = lambda *rows: spark.createDataFrame(list(rows), "path string, attempt int, pos int, score double")
    got = M.searched(named, more(("a", 0, 10, 0.9), ("b", 0, 11, 0.9), ("c", 0, 12, 0.3)), more(("a", 0, 20, 0.9), ("b", 0, 21, 0.9), ("c", 0, 22, 0.9)))
    assert sorted((r.path, r.pos) for r in got.collect()) == [("a", 0), ("a", 1), ("b", 3), ("b", 11), ("c", 12), ("c", 22)]
    first, second = more(("a", 0, 1, 0.1)), more(("a", 0, 2, 0.9), ("b", 0, 3, 0.9))
    assert sorted((r.path, r.pos) for r in M.field_then_text(first, second).collect()) == [("a", 1), ("b", 3)]


def test_addresses_with_guests(spark):
    tries = spark.createDataFrame([("a", 0, "Oda & Une", "Ebb (Official Audio)", ["Nil"]), ("b", 0, "Ясень", "Отлив", [])], "path string, attempt int, artist string, title string, guests array<string>")
    assert [(r.path, r.no, r.slug) for r in M.addresses(tries).orderBy("no").collect()] == [("a", 0, "Oda-ebb"), ("a", 1, "Oda-and-nil-ebb")]


def test_blocked_join_finds_each_pair_once(spark):
    q = spark.createDataFrame([("p", 0, "A", "small red ring", [], [])], "path string, attempt int, artist string, title string, qualifiers array<string>, guests array<string>")
    c = spark.createDataFrame([(1, "A", "small red bolt"), (2, "A", "smarter"), (3, "A", "other")], "pos int, artist string, title string")
    assert sorted(r.c_pos for r in M.scored(q, c).collect()) == [1, 2]


def test_lrc(spark, apply):
    table = {
        "[00:00.00] 作词 : Ясень\n[00:01.00] 作曲 : Ясень\n[00:19.46]Тихий берег\n[00:22.06]И снова отлив\n": ("Тихий берег\nИ снова отлив", "[00:19.46]Тихий берег\n[00:22.06]И снова отлив"),
        "[00:00.00] 纯音乐，请欣赏\n": ("", ""),
        "no time": ("", ""),
    }
    assert [tuple(x) for x in apply(H.lrc_words, list(table))] == list(table.values())


def test_markup(apply):
    verse = "<div class=\"ad\"></div>".join(["one<br>\ntwo<br/>three", "<br>four<br>five &amp; six<p>seven</p>"])
    page = f"<html><script>a<br><br><br><br><br><br></script><ul><li>x<br></li></ul><div>{verse}</div></html>"
    assert apply(H.broken_lines, [page, "<div>a<br>b</div>"]) == ["one\ntwo\nthree\nfour\nfive & six\nseven".replace("six\nseven", "sixseven"), ""]
    declared = r'{"lyrics": {"lang": "en", "text": "It′s\na \"line\""}}'
    assert apply(H.declared_lyrics, [declared, "none"]) == ["It's\na \"line\"", ""]
    assert apply(H.any_lyrics, [declared + "<div>" + "a<br>" * 30 + "</div>"])[0].startswith("a\na")
    genius = '<div data-lyrics-container="true" class="x">One<br/>Two <div data-exclude-from-selection="true"><div>ad</div></div><i>three</i></div><div data-lyrics-container="true">Four</div><div>no</div>'
    assert A.container_text(genius) == "One\nTwo three\nFour"
    az = "<div>title<br>a<br>b<br>c<br>d</div><div><!-- Usage of azlyrics.com content -->w1<br>w2<br>w3<br>w4<br>w5</div><div>z</div>"
    assert apply(H.azlyrics, [az]) == ["w1\nw2\nw3\nw4\nw5"]
    assert apply(H.amalgama, ['<div class="original">a b</div>x<div class="original"><a href="#">n</a></div><div class="original">c</div>']) == ["a b\nc"]
    assert apply(H.html_text, ["a<br>b</p><b>c</b> &eacute;"]) == ["a\nb\nc é"]


@pytest.mark.parametrize("code,again", [(429, True), (503, True), (404, False), (200, False)])
def test_retryable(spark, code, again):
    assert spark.range(1).select(M.retryable(F.lit(code))).first()[0] is again


def test_rows_alike_are_scored_once(spark, monkeypatch):
    """Every pair of rows comes out, also beyond what one array holds; the join meets distinct names only."""
    monkeypatch.setattr(M, "ALIKE", 4)
    q = spark.range(9).selectExpr("cast(id as string) as path", "0 as attempt", "'Oda Brask' as artist", "'Low Tide' as title", "cast(array() as array<string>) as qualifiers", "cast(array() as array<string>) as guests", "cast(if(id = 8, null, 240) as double) as duration", "1 as k")
    c = spark.range(6).selectExpr("cast(id as int) as pos", "'Oda Brask' as artist", "if(id = 0, 'Lover', 'Low Tide') as title", "240.0D as duration", "1 as k")
    got = M.scored(q, c, ["k"])
    assert got.columns == ["k", "path", "attempt", "artist", "title", "qualifiers", "guests", "duration", "c_pos", "c_artist", "c_title", "c_duration", "score", "qualified"]
    rows = got.collect()
    assert sorted((r.path, r.c_pos) for r in rows) == [(str(p), n) for p in range(9) for n in range(6)]
    assert all((r.score == 1) == (r.c_pos > 0) for r in rows)
    assert {r.n for r in M.alike(q, ["k"], M.ASKED, "of").select(F.size("of").alias("n")).collect()} == {4, 1}


def test_best_of_names_agrees_with_best_of_pairs(spark):
    """Attempts that are alike and several of one path, unknown durations, candidates without words and in later rounds."""
    q = spark.range(24).selectExpr("cast(id div 2 as string) as path", "cast(id % 2 as int) as attempt", "if(id % 3 = 0, 'Oda Brask', 'Mira Vant') as artist", "if(id % 4 < 2, 'Low Tide', 'Undertow (Studio Session)') as title", "if(id % 4 < 2, cast(array() as array<string>), array('session')) as qualifiers", "cast(array() as array<string>) as guests", "cast(if(id % 5 = 0, null, 240) as double) as duration", "id % 2 as k")
    words = f"if(id % 4 = 0, '', if(id % 7 = 0, 'la', '{WORDS}'))"
    c = spark.range(60).selectExpr("cast(id % 2 as int) as round", "if(id % 3 = 0, 'a', 'b') as source", "cast(60 - id as int) as pos", "if(id % 3 = 0, 'Oda Brask', 'Mira Vant') as artist", "case id % 5 when 0 then 'Low Tide' when 1 then 'Undertow' when 2 then 'Lover' else 'Undertow (Session)' end as title", f"{words} as lyrics", "240.0D as duration", "(id div 2) % 2 as k")
    key = lambda rows: sorted((r.path, r.status, r.title, r.score, r.source, r.lyrics) for r in rows.collect())
    got = M.best_of(q, c, ["k"])
    want = key(M.find_best(M.scored(q, c, ["k"])))
    assert len(want) == 12 and {w[1] for w in want} >= {"found"} and key(got) == want


def test_best_of_scores_a_pair_of_names_once(spark, monkeypatch):
    """One join, one comparison of titles, artists and guests each in the whole plan; qualifiers are read from titles where they aren't given; several rows of names."""
    monkeypatch.setattr(M, "NAMES", 3)
    monkeypatch.setattr(M, "ALIKE", 4)
    q = spark.range(20).selectExpr("cast(id as string) as path", "cast(id % 2 as int) as attempt", "'Oda Brask' as artist", "if(id % 4 < 2, 'Low Tide', 'Undertow (Studio Session)') as title", "id % 3 as k")
    c = spark.range(90).selectExpr("cast(id % 2 as int) as round", "if(id % 4 = 0, 'a', 'b') as source", "cast(id * 7 % 90 as int) as pos", "if(id % 3 = 0, 'Oda Brask', 'Mira Vant') as artist", "case id % 5 when 0 then 'Low Tide' when 1 then concat('Under', id) when 2 then 'Lover' else 'Undertow (Session)' end as title", f"if(id % 7 = 0, '', '{WORDS}') as lyrics", "id div 3 % 3 as k")
    best = M.best_of(q, c, ["k"])
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(") == 5 and plan.count("Join ") == 1
    key = lambda rows: sorted((r.path, r.status, r.title, r.score, r.source, r.lyrics) for r in rows.collect())
    asked = q.withColumn("qualifiers", F.when(F.col("title") == "Low Tide", F.array().cast("array<string>")).otherwise(F.array(F.lit("studio"), F.lit("session")))).withColumn("guests", F.array().cast("array<string>"))
    want = key(M.find_best(M.scored(asked, c, ["k"])))
    assert len(want) == 20 and key(best) == want


def test_scores_are_rounded_before_rows_are_expanded(spark):
    """Rounding a score takes longer than all else that an expanded row costs; nothing but copying is left above the expansion."""
    from cadenza.plans import matching_queries as Q

    plan = Q.QUERIES["match_score"][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan[: plan.rindex("Generate ")], plan[plan.rindex("Generate ") :]
    assert "round(" not in above and below.count("round(") == 1 and below.count("levenshtein(") == 5
    q = spark.sql("select 'p' as path, 0 as attempt, 'Oda Brask' as artist, 'Low Tide' as title, 1 as k")
    c = spark.range(9).selectExpr("cast(id as int) as pos", "'Oda Brask' as artist", "concat('Low Ti', id) as title", "1 as k")
    exact, rounded = ({r.c_pos: r.score for r in M.scored(q, c, ["k"], n).collect()} for n in (None, 3))
    assert len(exact) == 9 and rounded == {p: round(s, 3) for p, s in exact.items()} != exact
