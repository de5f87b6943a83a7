"""SQL fragments for DuckDB: the same rules as the text functions, in RE2's own dialect and DuckDB's functions."""

from __future__ import annotations

from ..functions import words as W
from . import tracks as V


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def rep(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def one_space(x: str) -> str:
    return rep(trim(x), r"\s+", " ")


def bare_pattern(pattern: str) -> str:
    return pattern.removeprefix("(?i)").removesuffix("$")


def before(x: str, pattern: str) -> str:
    """Before the first match that doesn't start the text, else null."""
    end = r"\z" if pattern.endswith("$") else ""
    return f"nullif(regexp_extract({x}, {q('(?is)^(.+?)(?:' + bare_pattern(pattern) + ')' + end)}, 1), '')"


def after(x: str, pattern: str) -> str:
    return f"regexp_extract({x}, {q('(?is)^.+?(?:' + bare_pattern(pattern) + ')(.*)$')}, 1)"


def words_in(*lists: list[str]) -> str:
    return "(" + ", ".join(q(w) for x in lists for w in x) + ")"


def key(x: str) -> str:
    return rep(f"regexp_replace(lower({trim(x)}), '^the ', '')", W.NOT_WORD)


def fold(x: str) -> str:
    return rep(f"replace(lower({trim(x)}), 'ё', 'е')", W.NOT_WORD)


def quality(x: str) -> str:
    return rf"(case when regexp_matches({x}, '^\p{{Lu}}') and regexp_matches({x}, '\p{{Ll}}') then 3 when regexp_matches({x}, '^\p{{Lu}}') then 2 when regexp_matches({x}, '\p{{Lu}}') then 1 else 0 end)"


def parts(x: str) -> str:
    """The names of a credit without marks, watermarks dropped unless nothing is left."""
    split = f"list_filter(list_transform(string_split_regex({x}, {q(W.BARE_SEPARATOR)}), lambda p: {trim('p')}), lambda p: p <> '')"
    kept = f"list_filter({split}, lambda p: not {has('p', W.WATERMARK)})"
    return f"(case when len({kept}) = 0 then {split} else {kept} end)"


def lead(x: str) -> str:
    return f"coalesce({trim(before(x, W.GUEST_MARKER))}, case when len({parts(x)}) >= 1 and {has(x, W.BARE_SEPARATOR)} then {parts(x)}[1] end, {x})"


def lead_kind(x: str) -> str:
    several = f"case when {has(x, W.BARE_SEPARATOR)} and len({parts(x)}) > 1 then 'separator' when {has(x, W.BARE_SEPARATOR)} and len({parts(x)}) = 1 and {parts(x)}[1] <> {x} then 'feature' else 'exact' end"
    return f"(case when {before(x, W.GUEST_MARKER)} is not null then 'feature' else {several} end)"


def disc_of(x: str) -> str:
    return f"coalesce(try_cast(regexp_extract({x}, {q(W.DISC)}, 1) || regexp_extract({x}, {q(W.DISC)}, 2) as integer), 0)"


def strip_disc(x: str) -> str:
    return f"coalesce({trim(before(x, W.DISC))}, {x})"


def unwatermark(x: str) -> str:
    kept = f"list_filter(list_transform(string_split({x}, '|'), lambda p: {trim('p')}), lambda p: p <> '' and not {has('p', W.WATERMARK)})"
    return f"(case when len({kept}) = 0 then {x} else array_to_string({kept}, ' | ') end)"


def is_edition(x: str) -> str:
    found = f"list_filter(string_split_regex(lower({x}), {q(W.NOT_WORD)}), lambda w: w <> '')"
    bad = f"list_filter({found}, lambda w: w not in {words_in(W.EDITION_WORDS)} and not {has('w', W.EDITION_NUMBER)})"
    return f"(len({found}) > 0 and len({bad}) = 0)"


def strip_album(x: str) -> str:
    """One round is enough for the derived albums, which have one qualifier at most."""
    x = strip_disc(unwatermark(x))
    cut = lambda p: f"when {before(x, p)} is not null and {is_edition(f'regexp_extract({x}, {q(p)}, 1)')} then {trim(before(x, p))}"
    return f"(case {cut(W.TRAILING_BRACKET)} {cut(W.TRAILING_DASH)} else {x} end)"


def album_key(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split_regex(lower({strip_album(x)}), {q(W.NOT_WORD)}), lambda w: w <> '')), ' ')"


def junk(x: str) -> str:
    return f"({has(x, W.WATERMARK)} or {key(x)} in {words_in(W.JUNK_NAMES)})"


def clean_title(x: str) -> str:
    x = rep(rep(rep(trim(x), W.LEADING_NUMBER), W.NOISE_CHUNK, " "), W.NOISE_SUFFIX)
    x = f"coalesce({before(x, W.GUEST_SUFFIX)}, {x})"
    return one_space(f"coalesce({before(x, W.PRODUCER_SUFFIX)}, {x})")


def bared(clean: str) -> str:
    """The bare title of a clean one."""
    bare = one_space(rep(one_space(rep(clean, W.ASIDE, " ")), W.VERSION_SUFFIX))
    return f"coalesce(nullif({bare}, ''), {clean})"


def long_words(x: str) -> str:
    return f"list_filter(string_split_regex(lower({trim(x)}), {q(W.NOT_WORD)}), lambda w: length(w) > 2)"


def stem(w: str) -> str:
    return f"(case when length({w}) > 4 then regexp_replace({w}, 's$', '') else {w} end)"


def qualifiers(clean: str) -> str:
    """The qualifiers of a clean title, in order; no derived title repeats one."""
    found = f"list_transform(flatten(list_transform(regexp_extract_all({clean}, {q(W.ASIDE)}), lambda a: {long_words('a')})), lambda w: {stem('w')})"
    return f"list_filter({found}, lambda w: w not in {words_in(W.FILE_QUALIFIERS)} and not {has('w', W.VERSION_WORD)})"


def lead_artist(x: str) -> str:
    a = one_space(f"trim({rep(x, W.HANDLE, ' ')}, ' |,;-')")
    a = f"(case when trim({rep(x, W.HANDLE, ' ')}, ' |,;-') = '' then {trim(x)} else {a} end)"
    cuts = [f"case when contains({a}, {q(s)}) then nullif({trim(f'split_part({a}, {q(s)}, 1)')}, '') end" for s in ("|", ";", " & ", " / ", " x ", ", ")]
    return f"coalesce({trim(before(a, W.GUEST_SUFFIX))}, {', '.join(cuts)}, {trim(a)})"


def similarity(a: str, b: str) -> str:
    """Of folded texts; DuckDB's levenshtein counts bytes."""
    far = f"greatest(0.0, least(1.0, 1 - levenshtein({a}, {b})::double / greatest(strlen({a}), strlen({b}))))"
    return f"(case when {a} = '' or {b} = '' then 0.0::double when {a} = {b} then 1.0::double when contains({a}, {b}) or contains({b}, {a}) then 0.9::double else {far}::double end)"


def overlap(a: str, b: str) -> str:
    """Of word lists."""
    share = lambda s, l: f"len(list_filter({s}, lambda w: list_contains({l}, w)))::double / len({s})"  # noqa: E731, E741
    return f"(case when len({a}) = 0 or len({b}) = 0 then 0.0::double when len({a}) > len({b}) then {share(b, a)} else {share(a, b)} end)"


def tidy(x: str) -> str:
    x = rep(rep(rep(x, r"\r\n?", "\n"), r"[ \t]+(\n|$)", r"\1"), r"\n{3,}", "\n\n")
    return f"(select case when lower(t) in ('', '[instrumental]', 'instrumental', '(instrumental)') or length(t) < 25 then '' else t end from (select {trim(x)} as t))"


TRACKS = f"tracks as ({V.sql_of(V.TRACKS)})"
