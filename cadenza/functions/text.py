"""Text functions on Columns: names, credits, titles, similarity. Null in, null out unless a function says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W

BLANK = r"\t\n\f\r "
WIDE_BLANK = r"\s\x0B\x85\p{Z}"
STRINGS = "array<string>"


def rx(pattern: str) -> str:
    """An RE2 pattern in Java's dialect: ASCII word boundaries and white space, Unicode case folding, `$` at the very end."""
    flags = "d"
    if pattern.startswith("(?"):
        given, pattern = pattern[2:].split(")", 1) if pattern[2] in "is" else ("", pattern)
        flags += given + ("u" if "i" in given else "")
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            two = pattern[i : i + 2]
            if two == r"\s":
                out.append(BLANK if inside else f"[{BLANK}]")
            elif two == r"\S" and not inside:
                out.append(f"[^{BLANK}]")
            elif two == r"\b" and not inside:
                out.append(r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")
            else:
                out.append(two)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif c == "]" and inside:
            inside = False
            out.append(c)
        elif inside and c in "[&":
            out.append("\\" + c)
        elif c == "$" and not inside:
            out.append(r"\z")
        else:
            out.append(c)
        i += 1
    return f"(?{flags})" + "".join(out)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated(c: Column, step, rounds: Column) -> Column:
    """step applied to a text until it gives null, which says that nothing is left to do; `rounds` bounds how often that can be.

    A mark at the end stops the fold: rounds after that cost little. A fold over structs with a lambda inside would keep Spark from
    planning Python functions beside it.
    """
    mark = "\x00\x01"
    again = lambda acc, _: F.when(F.endswith(acc, F.lit(mark)), acc).otherwise(F.coalesce(step(acc), F.concat(acc, F.lit(mark))))
    return F.aggregate(F.sequence(F.lit(1), rounds), c, again, lambda acc: F.when(F.endswith(acc, F.lit(mark)), F.substring(acc, F.lit(1), F.length(acc) - len(mark))).otherwise(acc))


def count_of(c: Column, characters: str) -> Column:
    return F.length(c) - F.length(F.translate(c, characters, ""))


def replace_all(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, rx(pattern), by)


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(rx(pattern))


def go_trim(c: Column) -> Column:
    """White space of any script off both ends."""
    return F.regexp_replace(c, rf"^[{WIDE_BLANK}]+|[{WIDE_BLANK}]+\z", "")


def one_space(c: Column) -> Column:
    """Words between single spaces."""
    return F.regexp_replace(go_trim(c), rf"[{WIDE_BLANK}]+", " ")


def split_on(c: Column, pattern: str) -> Column:
    return F.split(c, rx(pattern), -1)


def trimmed_parts(parts: Column) -> Column:
    return F.filter(F.transform(parts, go_trim), lambda p: p != "")


def before_match(c: Column, pattern: str) -> Column:
    """What stands before the first match, or null if there is none or it starts the text."""
    at = F.regexp_instr(c, F.lit(rx(pattern)))
    return F.when(at > 1, F.substring(c, F.lit(1), at - 1))


def after_match(c: Column, pattern: str) -> Column:
    """What follows the first match; the text must have one."""
    return F.regexp_extract(c, rx(pattern).replace("(?d", "(?ds", 1) + r"(.*)\z", groups_in(pattern) + 1)


def groups_in(pattern: str) -> int:
    import re

    return len(re.findall(r"(?<!\\)\((?!\?)", re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", pattern)))


def cut_at(c: Column, separator: str) -> tuple[Column, Column]:
    """Before and after the first occurrence of a separator; both null if it doesn't occur."""
    at = F.instr(c, separator)
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1)), F.when(at > 0, F.substring(c, at + len(separator), F.length(c)))


# Names and credits ------------------------------------------------------------


def spelling_key(c: Column) -> Column:
    return replace_all(F.regexp_replace(F.lower(go_trim(c)), "^the ", ""), W.NOT_WORD)


def spelling_quality(c: Column) -> Column:
    c = go_trim(c)
    return F.when(c.rlike(r"^\p{Lu}") & c.rlike(r"\p{Ll}"), 3).when(c.rlike(r"^\p{Lu}"), 2).when(c.rlike(r"\p{Lu}"), 1).otherwise(0)


def is_watermark(c: Column) -> Column:
    return matches(c, W.WATERMARK)


def drop_watermarks(parts: Column) -> Column:
    kept = F.filter(parts, lambda p: ~is_watermark(go_trim(p)))
    return F.when(F.size(kept) == 0, parts).otherwise(kept)


def split_artists(c: Column) -> Column:
    """struct<primary, rest, certain>, null if the credit names one artist."""

    def marked(v: Column) -> Column:
        primary = go_trim(before_match(v, W.GUEST_MARKER))
        rest = F.regexp_replace(go_trim(after_match(v, W.GUEST_MARKER)), r"[)\]]+\z", "")
        return F.when(F.coalesce(primary, F.lit("")) != "", F.struct(primary.alias("primary"), trimmed_parts(split_on(go_trim(rest), W.BARE_SEPARATOR)).alias("rest"), F.lit(True).alias("certain")))

    def listed(v: Column) -> Column:
        raw = split_on(v, W.BARE_SEPARATOR)

        def named(parts: Column) -> Column:
            first = F.get(parts, F.lit(0))
            several = F.struct(first.alias("primary"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("rest"), F.lit(False).alias("certain"))
            alone = F.struct(first.alias("primary"), F.array().cast(STRINGS).alias("rest"), F.lit(True).alias("certain"))
            return F.when(F.size(parts) > 1, several).when((F.size(parts) == 1) & (first != v), alone)

        return F.when(F.size(raw) > 1, let(drop_watermarks(trimmed_parts(raw)), named))

    return let(go_trim(c), lambda v: F.when(v == "", None).otherwise(F.coalesce(marked(v), listed(v))))


def lead_of(c: Column) -> Column:
    """struct<lead, kind, guests>: kind is feature, separator or exact."""

    def described(s: Column) -> Column:
        split = F.struct(s.primary.alias("lead"), F.when(s.certain, F.lit("feature")).otherwise(F.lit("separator")).alias("kind"), s.rest.alias("guests"))
        return F.when(s.isNotNull(), split).otherwise(F.struct(c.alias("lead"), F.lit("exact").alias("kind"), F.array().cast(STRINGS).alias("guests")))

    return let(split_artists(c), described)


def fold(c: Column) -> Column:
    return replace_all(F.replace(F.lower(go_trim(c)), F.lit("ё"), F.lit("е")), W.NOT_WORD)


def long_words(c: Column) -> Column:
    """Lower-case words of three characters or more, duplicates kept."""
    return F.filter(split_on(F.lower(go_trim(c)), W.NOT_WORD), lambda w: F.length(w) > 2)


def drop_handle(c: Column) -> Column:
    left = F.btrim(replace_all(c, W.HANDLE, " "), F.lit(" |,;-"))
    return F.when(left == "", go_trim(c)).otherwise(one_space(left))


CREDIT_SEPARATORS = ("|", ";", " & ", " / ", " x ", ", ")


def lead_artist(c: Column) -> Column:
    """The lead that a search is made for; separators are tried in their order."""

    def found(a: Column) -> Column:
        first = [go_trim(F.substring_index(a, s, 1)) for s in CREDIT_SEPARATORS]
        cuts = [F.when((F.instr(a, s) > 0) & (b != ""), b) for s, b in zip(CREDIT_SEPARATORS, first)]
        return F.coalesce(go_trim(before_match(a, W.GUEST_SUFFIX)), *cuts, go_trim(a))

    return let(drop_handle(c), found)


def other_artists(c: Column) -> Column:
    def parts(a: Column) -> Column:
        split = [F.slice(s, F.lit(2), F.size(s)) for s in (F.split(a, F.lit("\\Q" + x + "\\E"), -1) for x in CREDIT_SEPARATORS)]
        return trimmed_parts(F.concat(*split))

    return let(drop_handle(c), parts)


def guests_in(c: Column) -> Column:
    tail = F.regexp_extract(after_match(c, W.GUEST_CREDIT), r"(?s)^[^)\]]*", 0)
    names = F.filter(F.transform(split_on(tail, W.GUEST_SEPARATOR), go_trim), lambda n: F.octet_length(n) > 2)
    return F.when(matches(c, W.GUEST_CREDIT), names).otherwise(F.array().cast(STRINGS))


def is_placeholder(c: Column) -> Column:
    return fold(c).isin(W.PLACEHOLDER_NAMES)


def has_non_latin(c: Column) -> Column:
    return c.rlike(r"[\p{L}&&[^\p{IsLatin}]]")


def without_translation(c: Column) -> Column:
    """A name without the translations in brackets at its end, however many."""

    def step(name: Column) -> Column:
        at = F.regexp_instr(name, F.lit(rx(W.TRANSLATION)))
        rest, inside = F.substring(name, F.lit(1), at - 1), F.regexp_extract(name, rx(W.TRANSLATION), 1)
        return F.when((at > 0) & has_non_latin(rest) & ~has_non_latin(inside), go_trim(rest))

    return let(c, lambda v: repeated(v, step, count_of(v, ")]") + 1))


def without_translations(c: Column) -> Column:
    names = lambda part: F.array_join(F.transform(F.split(part, F.lit(", "), -1), lambda n: without_translation(go_trim(n))), ", ")
    return F.array_join(F.transform(F.split(c, F.lit(" & "), -1), names), " & ")


# Albums -----------------------------------------------------------------------


def disc_of(c: Column) -> Column:
    c, p = go_trim(c), rx(W.DISC)
    return F.coalesce(F.concat(F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2)).try_cast("int"), F.lit(0))


def strip_disc(c: Column) -> Column:
    c = go_trim(c)
    return F.coalesce(go_trim(before_match(c, W.DISC)), c)


def unwatermark(c: Column) -> Column:
    def shown(v: Column) -> Column:
        inside = go_trim(F.regexp_extract(v, rx(W.TRAILING_BRACKET), 1))
        before = before_match(v, W.TRAILING_BRACKET)
        return F.when(before.isNotNull() & is_watermark(inside), go_trim(before)).otherwise(v)

    kept = F.filter(trimmed_parts(F.split(c, r"\|", -1)), lambda p: ~is_watermark(p))
    return F.when(F.size(kept) == 0, go_trim(c)).otherwise(let(F.array_join(kept, " | "), shown))


def is_edition(c: Column) -> Column:
    parts = F.filter(split_on(F.lower(c), W.NOT_WORD), lambda w: w != "")
    return (F.size(parts) > 0) & F.forall(parts, lambda w: w.isin(W.EDITION_WORDS) | matches(w, W.EDITION_NUMBER))


def strip_album(c: Column) -> Column:
    """Without watermark, disc and all edition qualifiers at the end."""

    def step(v: Column) -> Column:
        return F.coalesce(*(F.when(is_edition(F.regexp_extract(v, rx(p), 1)), go_trim(before_match(v, p))) for p in (W.TRAILING_BRACKET, W.TRAILING_DASH)))

    return go_trim(let(go_trim(strip_disc(unwatermark(go_trim(c)))), lambda v: repeated(v, step, count_of(v, ")]}-–—") + 1)))


def album_key(c: Column) -> Column:
    parts = F.array_sort(F.filter(split_on(F.lower(strip_album(c)), W.NOT_WORD), lambda w: w != ""))
    return let(parts, lambda p: F.when(F.size(p) == 0, F.lower(go_trim(c))).otherwise(F.array_join(p, " ")))


def album_kind(value: Column, kept: Column) -> Column:
    bare, bare_kept = unwatermark(value), unwatermark(kept)
    return (
        F.when(value == kept, "exact")
        .when(spelling_key(value) == spelling_key(kept), "spelling")
        .when((disc_of(value) > 0) & (strip_disc(value) != value), "disc")
        .when((bare != value) & (spelling_key(bare) == spelling_key(bare_kept)), "watermark")
        .when((strip_album(value) == value) & (strip_album(kept) == kept), "order")
        .otherwise("edition")
    )


def is_junk_name(c: Column) -> Column:
    v = F.btrim(go_trim(c), F.lit("<>[]()"))
    return is_watermark(v) | spelling_key(v).isin(W.JUNK_NAMES)


# Titles -----------------------------------------------------------------------


def clean_title(c: Column) -> Column:
    c = replace_all(go_trim(c), W.LEADING_NUMBER)
    c = replace_all(replace_all(c, W.NOISE_CHUNK, " "), W.NOISE_SUFFIX)
    c = let(c, lambda v: F.coalesce(before_match(v, W.GUEST_SUFFIX), v))
    return one_space(let(c, lambda v: F.coalesce(before_match(v, W.PRODUCER_SUFFIX), v)))


def bare_title(c: Column) -> Column:
    def bared(clean: Column) -> Column:
        bare = one_space(replace_all(one_space(replace_all(clean, W.ASIDE, " ")), W.VERSION_SUFFIX))
        return F.when(bare == "", clean).otherwise(bare)

    return let(clean_title(c), bared)


def stem(w: Column) -> Column:
    return F.when(F.length(w) > 4, F.regexp_replace(w, r"s\z", "")).otherwise(w)


def qualifiers(c: Column) -> Column:
    asides = F.regexp_extract_all(clean_title(c), F.lit(rx(W.ASIDE)), F.lit(0))
    found = F.transform(F.flatten(F.transform(asides, long_words)), stem)
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(W.FILE_QUALIFIERS) & ~matches(w, W.VERSION_WORD)))


def has_qualifiers(want: Column, title: Column) -> Column:
    return F.size(F.array_except(want, F.transform(long_words(title), stem))) == 0


def aliases(c: Column) -> Column:
    halves = F.split(bare_title(c), F.lit(" x "), -1)
    medley = F.when(F.size(halves) > 1, F.filter(trimmed_parts(halves), lambda p: F.length(p) >= 3)).otherwise(F.array().cast(STRINGS))
    asides = F.transform(F.regexp_extract_all(clean_title(c), F.lit(rx(W.ASIDE)), F.lit(0)), lambda a: go_trim(F.substring(a, F.lit(2), F.length(a) - 2)))

    def is_name(inner: Column) -> Column:
        found = long_words(inner)
        known = F.exists(found, lambda w: w.isin(W.FILE_QUALIFIERS + W.RECORDING_WORDS) | matches(w, W.VERSION_WORD))
        return (F.size(found) > 0) & ~known & F.exists(found, lambda w: w.rlike(r"\p{L}"))

    return F.concat(medley, F.filter(asides, is_name))


def hook_attempt(title: Column, wanted: Column) -> Column:
    def guarded(bare: Column) -> Column:
        n = F.size(F.filter(F.split(bare, rf"[{WIDE_BLANK}]+", -1), lambda w: w != ""))
        alike = (fold(bare) == fold(title)) & ~((F.size(wanted) > 0) & has_qualifiers(wanted, title))
        return alike & n.between(2, 6) & (F.octet_length(fold(bare)) >= 8)

    return let(bare_title(title), guarded)


def without_leading_artist(title: Column, artists: Column) -> Column:
    """The title without the first artist that it repeats; the separator may be tight after five characters, a space after two words."""

    def prefixes(a: Column) -> Column:
        apart = [F.concat(a, F.lit(s)) for s in (" - ", " — ", " – ", " -- ")]
        tight = [F.when(F.length(a) >= 5, F.concat(a, F.lit(s))) for s in ("-", "–", "—")]
        space = F.when(F.size(F.filter(F.split(a, rf"[{WIDE_BLANK}]+", -1), lambda w: w != "")) >= 2, F.concat(a, F.lit(" ")))
        return F.filter(F.array(*apart, *tight, space), lambda p: p.isNotNull())

    known = F.filter(artists, lambda a: F.coalesce(a, F.lit("")) != "")
    every = F.flatten(F.transform(known, prefixes))
    hits = F.filter(every, lambda p: (F.octet_length(title) > F.octet_length(p)) & (F.lower(F.substring(title, F.lit(1), F.length(p))) == F.lower(p)))
    return let(F.get(hits, F.lit(0)), lambda p: F.when(p.isNotNull(), go_trim(F.substring(title, F.length(p) + 1, F.length(title)))).otherwise(title))


def name_from_file(path: Column) -> Column:
    """struct<artist, title> as a file's name says them."""
    base = F.regexp_extract(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/+\z", ""), r"([^/]*)\z", 1)
    name = F.regexp_replace(base, r"\.[^./]*\z", "")
    score = F.length(name) - F.length(F.replace(name, F.lit("_"), F.lit("")))
    underscored = (score >= 2) | (F.contains(name, F.lit(" ")) & (score >= 1))

    def read(x: Column) -> Column:
        plain = replace_all(go_trim(x["name"]), W.LEADING_NUMBER)

        def halves(n: Column) -> Column:
            pairs = [cut_at(n, s) for s in (" — ", " – ", " - ", " -- ")]
            artist = F.coalesce(*(go_trim(a) for a, _ in pairs), F.lit(""))
            title = F.coalesce(*(go_trim(b) for _, b in pairs), go_trim(n))
            return F.struct(artist.alias("artist"), F.when(x.underscored, before_studio_words(title)).otherwise(title).alias("title"))

        return let(plain, halves)

    spaced = F.when(underscored, one_space(F.replace(name, F.lit("_"), F.lit(" ")))).otherwise(name)
    blank = F.struct(F.lit("").alias("artist"), F.lit("").alias("title"))
    return F.when(base.isin("", "."), blank).otherwise(let(F.struct(spaced.alias("name"), underscored.alias("underscored")), read))


def before_studio_words(title: Column) -> Column:
    def cut(parts: Column) -> Column:
        number = lambda w: matches(w, W.PLAIN_NUMBER)
        stops = F.transform(parts, lambda w, i: (i > 0) & (matches(w, W.STUDIO_WORD) | (number(w) & F.coalesce(number(F.get(parts, i + 1)), F.lit(True)))))
        at = F.array_position(stops, True).cast("int")
        return F.when(at > 0, F.array_join(F.slice(parts, F.lit(1), at - 1), " ")).otherwise(title)

    return let(F.filter(F.split(title, rf"[{WIDE_BLANK}]+", -1), lambda w: w != ""), cut)


# Similarity -------------------------------------------------------------------


def as_bytes(c: Column) -> Column:
    """A text with a character for each of its UTF-8 bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def byte_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance over UTF-8 bytes."""
    return F.levenshtein(as_bytes(a), as_bytes(b))


def folded_similarity(a: Column, b: Column) -> Column:
    """Similarity of folded texts: 0 if one is empty, 1 if equal, 0.9 if one holds the other, else by edit distance."""
    far = 1 - byte_levenshtein(a, b).cast("double") / F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.9).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), far)))


def bytes_similarity(a: Column, b: Column) -> Column:
    """folded_similarity of texts that went through as_bytes, which then happens once for each text, not for each pair."""
    far = 1 - F.levenshtein(a, b).cast("double") / F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.9).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), far)))


def similarity(a: Column, b: Column) -> Column:
    return let(F.struct(fold(a).alias("a"), fold(b).alias("b")), lambda x: folded_similarity(x.a, x.b))


def words_overlap(left: Column, right: Column) -> Column:
    """The share of the shorter list's words that the other has; of lists equally long, the first counts."""

    def share(x: Column) -> Column:
        return F.when(F.size(x.s) == 0, 0.0).otherwise(F.size(F.filter(x.s, lambda w: F.array_contains(x.l, w))).cast("double") / F.size(x.s))

    swap = F.size(left) > F.size(right)
    return F.when(~F.arrays_overlap(left, right), 0.0).otherwise(let(F.struct(F.when(swap, right).otherwise(left).alias("s"), F.when(swap, left).otherwise(right).alias("l")), share))


def word_overlap(a: Column, b: Column) -> Column:
    return words_overlap(long_words(a), long_words(b))


def same_name(asked: Column, found: Column) -> Column:
    return (similarity(clean_title(asked), clean_title(found)) >= W.NAME_SCORE) | (similarity(bare_title(asked), bare_title(found)) >= W.NAME_SCORE)


# Lyrics, numbers and small change ---------------------------------------------


def tidy_lyrics(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+(?=\n|\z)", "")
    c = go_trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))
    return let(c, lambda t: F.when(F.lower(t).isin("", "[instrumental]", "instrumental", "(instrumental)") | (F.length(t) < 25), "").otherwise(t))


def hook_count(lyrics: Column, phrase: Column) -> Column:
    """How often the phrase is sung, word for word; occurrences share no space."""
    norm = lambda c: F.concat(F.lit(" "), one_space(replace_all(F.lower(c), W.NOT_WORD, " ")), F.lit(" "))

    def count(x: Column) -> Column:
        return F.when(F.trim(x.p) == "", 0).otherwise(((F.length(x.n) - F.length(F.replace(x.n, x.p, F.lit("")))) / F.length(x.p)).cast("int"))

    return let(F.struct(norm(lyrics).alias("n"), norm(phrase).alias("p")), count)


def slug(c: Column) -> Column:
    text = F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), "['’]", "")
    text = F.btrim(F.regexp_replace(text, W.SLUG_BREAK, "-"), F.lit("-"))
    return F.when(c.rlike(r"[\p{L}&&[^\x00-\x7f]]"), "").otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text))))


def site_name(url: Column) -> Column:
    host = reduce(lambda h, p: F.regexp_replace(h, f"^{p}\\.", ""), ("www", "m", "ru", "en"), F.lower(F.parse_url(url, F.lit("HOST"))))
    return F.coalesce(*(F.when(host == h, F.lit(n)) for h, n in W.SITES.items()), host)


def leading_number(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(go_trim(c), r"^[0-9]+", 0).try_cast("int"), F.lit(0))


def first_number(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, r"([0-9]+)", 1).try_cast("int"), F.lit(0))


def parse_year(c: Column) -> Column:
    return F.coalesce(F.substring(c, 1, 4).try_cast("int"), F.lit(0))


def is_true(c: Column) -> Column:
    return ~go_trim(c).isin("", "0", "false", "no")


def format_number(c: Column) -> Column:
    return F.when(c > 0, c.cast("string")).otherwise("")


def summarise(c: Column) -> Column:
    return let(F.substring_index(go_trim(c), "\n", 1), lambda line: F.when(F.length(line) > 48, F.concat(F.substring(line, 1, 48), F.lit("…"))).otherwise(line))


def megabytes(c: Column) -> Column:
    """Ties go to the even digit, as they are exact in binary; Java's own format rounds them up. Tenths are exact below 2^50 bytes."""
    return F.format_string("%.1f MB", F.rint(c / F.lit(1048576.0) * 10) / 10)


def clean_text(c: Column) -> Column:
    """Values that NUL separates, without control characters, joined by a semicolon."""
    parts = F.transform(F.split(c, "\\x00", -1), lambda p: go_trim(F.regexp_replace(p, r"[\x00-\x08\x0B-\x1F]", "")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "; ")


def normal_key(c: Column) -> Column:
    return F.translate(F.upper(go_trim(c)), " _-", "")


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^./]*)\z", 1))


def is_media_name(c: Column) -> Column:
    return extension(c).isin(W.MEDIA_EXTENSIONS)


def is_playlist_name(c: Column) -> Column:
    return extension(c).isin(W.PLAYLIST_EXTENSIONS)
