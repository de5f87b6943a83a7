"""Text functions against tables of inputs and expected values."""

import pytest
from pyspark.sql import functions as F

from cadenza.functions import text as T


def check(apply, function, table, **more):
    got = apply(function, list(table), **more)
    assert dict(zip(table, got)) == table


def test_split_artists(apply):
    table = {
        "Mirelle Vant": None,
        "Salt, Copper & Tin": ("Salt", ["Copper", "Tin"], False),
        "N/A/B": None,
        "Oda Brask ft. Little Kite": ("Oda Brask", ["Little Kite"], True),
        "Oda Brask (featuring Little Kite)": ("Oda Brask", ["Little Kite"], True),
        "Oda Brask [with Nil & Une]": ("Oda Brask", ["Nil", "Une"], True),
        "PaleMoth x RustBee": ("PaleMoth", ["RustBee"], False),
        "One / Two; Three": ("One", ["Two", "Three"], False),
        "Oda Brask | @tape_store": ("Oda Brask", [], True),
        "Ясень | vk.com/list": ("Ясень", [], True),
        "Oda Brask | Une | t.me/tapes": ("Oda Brask", ["Une"], False),
        "": None,
        " \t": None,
        "ft. Nobody": None,
    }
    got = apply(T.split_artists, list(table))
    assert {k: None if g is None else (g.primary, g.rest, g.certain) for k, g in zip(table, got)} == table


def test_spelling(apply):
    for group in (["The Lanterns", "Lanterns", "the  lanterns", "THE LANTERNS!"], ["Mo's Choir", "Mos Choir", "mo's  choir"], ["Тихий Берег", "тихий берег"]):
        assert len(set(apply(T.spelling_key, group))) == 1
    assert len(set(apply(T.spelling_key, ["Lanterns", "Lanterns Revival"]))) == 2
    check(apply, T.spelling_quality, {"Oda Brask": 3, "ODA": 2, "oda Brask": 1, "oda": 0, "Ясень": 3, "": 0, "77": 0})


def test_albums(apply):
    check(
        apply,
        T.strip_album,
        {
            "Glass Weather": "Glass Weather",
            "Glass Weather (2014 Remaster)": "Glass Weather",
            "Glass Weather [Bonus Tracks]": "Glass Weather",
            "Glass Weather - EP": "Glass Weather",
            "Glass Weather {Web} (Special Edition) - Single": "Glass Weather",
            "Glass Weather (3rd Anniversary Edition) [Explicit] (HQ)": "Glass Weather",
            "Стеклянная погода (Делюкс издание)": "Стеклянная погода",
            "Glass Weather | @tape_store": "Glass Weather",
            "Glass Weather (vk.com/list)": "Glass Weather",
            "At the Pier (Live)": "At the Pier (Live)",
            "Glass Weather (Dub + Echo)": "Glass Weather (Dub + Echo)",
            "(All the) Small Hours": "(All the) Small Hours",
            "Hours - Part One": "Hours - Part One",
            "@tape_store": "@tape_store",
        },
    )
    many = "Glass Weather" + " (Deluxe) [Web] - EP" * 10  # more rounds than any bound that was ever set
    check(apply, T.strip_album, {many: "Glass Weather", "[Deluxe] " * 3: "[Deluxe]"})
    check(apply, T.disc_of, {"Hours (CD 4)": 4, "Hours [disk 12]": 12, "Hours - Disc 2": 2, "Часы {диск 3}": 3, "Hours": 0, "CD 7 of Hours": 0})
    check(apply, T.album_key, {"Второй вечер - мой": "вечер второй мой", "???": "???", "Hours (Deluxe)": "hours"})
    check(apply, T.is_junk_name, {"SoundCloud": True, "www.vk.com/audio": True, "[unknown album]": True, "@tape_store": True, "Hours": False})


def test_titles(apply):
    check(
        apply,
        T.clean_title,
        {
            "Low Tide": "Low Tide",
            "Low Tide [Lyrics]": "Low Tide",
            "12) Low Tide": "Low Tide",
            "Low Tide (prod. Une)": "Low Tide",
            "Low Tide (with Little Kite)": "Low Tide",
            "Low Tide ft. Little Kite": "Low Tide",
            "Low Tide (Snippet) [HQ]": "Low Tide",
            "Low Tide - Single Version 1999": "Low Tide",
            "Ebb & Low": "Ebb & Low",
            "Отлив и прилив": "Отлив и прилив",
            "Low Tide produced by Une": "Low Tide",
            "Low Tide | prod. by Une": "Low Tide",
            "Producer": "Producer",
            "Productive Day": "Productive Day",
        },
    )
    check(
        apply,
        T.bare_title,
        {
            "Low Tide (Studio Take)": "Low Tide",
            "Low Tide (v3)": "Low Tide",
            "Low Tide v12": "Low Tide",
            "LOW TIDE [Prod. Une]": "LOW TIDE",
            "[Outro]": "[Outro]",
            "Low Tide Stems": "Low Tide",
            "Low Tide V2 (Home Demo)": "Low Tide",
            "Tide": "Tide",
        },
    )
    check(apply, lambda c: F.array_join(T.qualifiers(c), " "), {"Low Tide V2 (Home Demos)": "home demo", "Tide (Acoustic Takes) [Choir]": "acoustic take choir", "Tide (v2)": ""})
    check(
        apply,
        lambda c: F.array_join(T.aliases(c), "|"),
        {
            "Ebb (Grey Water)": "Grey Water",
            "Ebb (Studio Take)": "",
            "Ebb (Reprise)": "",
            "Ebb (1984)": "",
            "Ebb (v4)": "",
            "Ebb (Part 3)": "",
            "Ebb (ft. Little Kite)": "",
            "Берег (Grey Water) (Instrumental)": "Grey Water",
            "Grey Water x Ebb": "Grey Water|Ebb",
        },
    )


def test_credits(apply):
    check(
        apply,
        T.lead_artist,
        {
            "Oda Brask": "Oda Brask",
            "Oda Brask featuring Une": "Oda Brask",
            "Oda Brask & Une": "Oda Brask",
            "Brask, O. Une": "Brask",
            "Oda Brask | @tape_store": "Oda Brask",
            "@tape_store | Oda Brask": "Oda Brask",
            "Ясень | vk.com/list": "Ясень",
            "@tape_store": "@tape_store",
        },
    )
    check(apply, T.is_placeholder, {"Telegram": True, "vk.com": True, "Unknown Artist": True, "Музыка": True, "Oda Brask": False, "VK Brask": False})
    check(apply, lambda c: F.array_join(T.other_artists(c), "|"), {"Ясень, Берег": "Берег", "Oda & Une": "Une", "Oda": ""})
    check(apply, lambda c: F.array_join(T.guests_in(c), "|"), {"Ebb (feat. Une & Nil Kite)": "Une|Nil Kite", "Ebb": "", "Ebb ft. Jo, Берег": "Берег"})
    check(
        apply,
        T.without_translation,
        {
            "Отлив (Ebb)": "Отлив",
            "Отлив (Ebb) [Low Tide] (Neap)": "Отлив",
            "Отлив" + " (Ebb)" * 12: "Отлив",
            "Кто там? (Who is there?)": "Кто там?",
            "Ebb (Low Tide)": "Ebb (Low Tide)",
            "Отлив 3 (Deluxe) (Прилив)": "Отлив 3 (Deluxe) (Прилив)",
        },
    )
    check(apply, T.without_translations, {"Ясень (Ash) & Берег, Тихий (Quiet)": "Ясень & Берег, Тихий"})
    got = apply(lambda t, a: T.without_leading_artist(t, F.array(a)), [("Тихий берег-Отлив", "Тихий берег"), ("Une-Deux", "Une"), ("Oda Brask Low Tide", "Oda Brask"), ("BRASK - Ebb", "brask")])
    assert got == ["Отлив", "Une-Deux", "Low Tide", "Ebb"]


def test_name_from_file(apply):
    table = {
        "/sd/Tapes/PaleMoth x RustBee - Ebb.ogg": ("PaleMoth x RustBee", "Ebb"),
        "E:\\Tapes\\11. Oda Brask – Low Tide.mp3": ("Oda Brask", "Low Tide"),
        "/sd/Tapes/Low Tide.flac": ("", "Low Tide"),
        "": ("", ""),
        "/t/Oda_Brask_Low_Tide_Now_BPM_96_Final_Mix.mp3": ("", "Oda Brask Low Tide Now"),
        "/t/Oda_Brask_--_Ebb_Session_v3.mp3": ("Oda Brask", "Ebb"),
        "/t/every_other_tide.mp3": ("", "every other tide"),
        "/t/Oda Brask - Low Tide.mp3": ("Oda Brask", "Low Tide"),
        "/t/Low_Tide.mp3": ("", "Low_Tide"),
    }
    assert [tuple(x) for x in apply(T.name_from_file, list(table))] == list(table.values())


def test_similarity(apply):
    got = apply(T.similarity, [("Ещё раз", "еще  раз!"), ("", "a"), ("Low Tide", "tide"), ("pillar", "millers"), ("море", "more")])
    assert got == pytest.approx([1, 0, 0.9, 1 - 3 / 7, 0])
    assert apply(T.byte_levenshtein, [("море", "more")]) == [8]
    assert apply(T.word_overlap, [("PaleMoth x RustBee", "Night Yard (Ft. PaleMoth & RustBee)"), ("a b", "a b")]) == [1.0, 0.0]


def test_lyrics(apply):
    words = "Will you row me home'?\nWill you row me home?\nI said you row me home'\nHarbour, hold the light"
    assert apply(T.hook_count, [(words, "Row Me Home"), (words, "Harbour"), (words, " ")]) == [3, 1, 0]
    got = apply(T.tidy_lyrics, ["[Instrumental]", "   ", "First line of a song\r\nSecond line of a song  \n\n\n\nThird line", "short"])
    assert got == ["", "", "First line of a song\nSecond line of a song\n\nThird line", ""]
    check(apply, lambda t: T.hook_attempt(t, T.qualifiers(t)), {"Row Me Home": True, "Tide": False, "Ox": False, "One Two Three Four Five Six Se": False, "Row Me Home (Studio Take)": False})


def test_small_functions(apply):
    check(
        apply,
        T.slug,
        {
            "Oda BRASK Low Tide": "Oda-brask-low-tide",
            "Oda & Une's Ebb’s": "Oda-and-unes-ebbs",
            "O$D  Une -- Ok!": "O-d-une-ok",
            "Ясень Отлив": "",
        },
    )
    check(apply, T.clean_text, {"Oda\0Une": "Oda; Une", "End\0": "End", "Ring\x07ing": "Ringing"})
    check(apply, T.leading_number, {"3/12": 3, " 07": 7, "x": 0, "": 0})
    check(apply, T.parse_year, {"2011-05-01": 2011, "x": 0, "": 0})
    check(apply, T.is_true, {"1": True, "0": False, "false": False, "No": True, "no": False, "": False})
    check(apply, T.extension, {"a/b.MP3": ".mp3", "a.b/c": "", "x.tar.gz": ".gz"})
    check(apply, T.normal_key, {"album artist": "ALBUMARTIST", "Album_Artist-Sort ": "ALBUMARTISTSORT"})
    check(apply, T.site_name, {"https://www.genius.com/a": "Genius", "http://m.azlyrics.com/b": "AZLyrics", "https://x.org/": "x.org"})
    assert apply(T.megabytes, [(13526630,)], kinds=["bigint"]) == ["12.9 MB"]
    assert apply(T.summarise, ["a" * 60 + "\nb", " x "]) == ["a" * 48 + "…", "x"]
    assert apply(T.go_trim, ["\u00a0 x\u3000\n"]) == ["x"]


def test_megabytes_round_ties_to_even(apply):
    assert apply(T.megabytes, [(262144,), (786432,), (1310720,), (1835008,)], kinds=["bigint"]) == ["0.2 MB", "0.8 MB", "1.2 MB", "1.8 MB"]
