"""Tracks, candidates and playlists derived from the part table, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

K = "p_partkey"
CAPITAL = "concat(upper(substr(p_name, 1, 1)), substr(p_name, 2))"
NUMBER = f"lpad(cast({K} as string), 7, '0')"


def case(n: int, values: dict[int, str], other: str) -> str:
    return f"case {K} % {n} " + " ".join(f"when {i} then {v}" for i, v in values.items()) + f" else {other} end"


TRACKS = {
    "path": f"concat('/m/', p_brand, '/', p_type, '/', {NUMBER}, '.mp3')",
    "format": "'MP3'",
    "title": case(6, {0: "p_name", 1: "concat(p_name, ' (Official Audio)')", 2: "concat(p_name, ' [Prod. X]')", 3: "concat(p_name, ' v2')", 4: "concat(p_name, ' (Session Edit)')"}, "concat('07. ', p_name)"),
    "artist": case(8, {0: "p_name", 1: "upper(p_name)", 2: CAPITAL, 3: "concat('the ', p_name)", 4: "concat(p_name, ' feat. ', p_brand)", 5: "concat(p_name, ' & ', p_type)", 6: "concat(p_name, ' | @ch')"}, "''"),
    "albumArtist": case(5, {1: "p_name", 3: f"concat(' ', {CAPITAL}, ' ')"}, "''"),
    "album": case(9, {0: "p_type", 1: "concat(p_type, ' (Deluxe)')", 2: "concat(p_type, ' [Explicit]')", 3: "concat(p_type, ' (CD1)')", 4: "concat(p_type, ' - Single')", 5: "concat(p_type, ' | @ch')", 6: "concat(p_type, ' ', p_brand)", 7: "concat(p_brand, ' - ', p_type)"}, "case when p_partkey % 2 = 0 then 'vk.com' else '' end"),
    "genre": case(4, {0: "'Rock'", 1: "'Pop'"}, "''"),
    "trackNo": "cast(p_size as int)",
    "discNo": f"cast({K} % 2 as int)",
    "year": "cast(1990 + p_size % 30 as int)",
    "compilation": f"{K} % 11 = 0",
    "hasSort": f"{K} % 7 = 0",
    "legacyTag": f"{K} % 3 = 0",
    "tagBytes": f"cast({K} % 5 * 1000000 as bigint)",
    "lyrics": f"case when {K} % 4 = 0 then p_name else '' end",
    "hasLyrics": f"{K} % 4 = 0",
}
#: What a search of a catalogue would give: candidates are joined by brand and size.
CANDIDATES = {
    "brand": "p_brand",
    "size": "p_size",
    "round": f"cast({K} % 2 as int)",
    "source": case(3, {0: "'a'", 1: "'b'"}, "'c'"),
    "pos": K,
    "artist": case(5, {0: "p_name", 1: "concat(p_name, ' & ', p_type)", 2: CAPITAL, 3: "concat(p_type, ' (Ft. ', p_name, ')')"}, "concat('the ', p_name)"),
    "title": case(7, {0: "p_name", 1: "concat(p_name, ' (Studio Session)')", 2: "concat(p_name, ' (Remix)')", 3: "upper(p_name)", 4: "concat(p_type, ' ', p_name)", 5: "p_type"}, "concat(p_name, ' (Live)')"),
    "lyrics": f"case when {K} % 5 = 0 then '' when {K} % 9 = 0 then '[Instrumental]' else concat(p_name, ' and ', p_name, ' again and again') end",
    "duration": f"cast(100 + {K} % 50 as double)",
}


def rows_of(spark: SparkSession, sf_dir: str, columns: dict[str, str], more: str = "") -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.selectExpr(*(f"{e} as {n}" for n, e in columns.items()), *([more] if more else []))


def sql_of(columns: dict[str, str], more: str = "") -> str:
    return "select " + ", ".join([*(f"{e} as {n}" for n, e in columns.items()), *([more] if more else [])]) + " from part"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sf_dir, TRACKS)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sf_dir, CANDIDATES)
