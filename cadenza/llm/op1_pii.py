"""Surrogates for personal data: detected entities get keyed replacements of their own type, gender, script and format.

Kinds: email, card (Luhn), iban (mod 97), ip, phone, ssn, and names (given, by gender, and family). Names are found by a title, by a
known given name before a capitalised word, by what stands before a name ("my name is", "Dear") or after one ("met", "was born"), and
by an address whose local part spells the two words out. Where a name is found in a text, its bare mentions there are found too.

An entity is what mentions have in common (lower case, digits only), so every mention of it gets the same surrogate everywhere, poured
into the mention's own case and separators: coreference holds within and across documents, and addresses of one host share their new host.

Surrogates of numbers and addresses are a keyed permutation of all entities of their shape: letters stay letters of their script, digits
stay digits of theirs, check digits hold, networks stay private or public; of a host only its last label stays. Addresses without a letter
or digit to replace, or whose shape has too few texts for all of them, get more letters. Names are built from syllables of their script,
with endings that tell the gender, or, in scripts without a table here, from letters beside their own. A key and the attempt decide
everything: who has the key can tell which entity a surrogate stands for, who has only this code can't. The operator has no key of its
own; session_key takes it from the session or the environment, or draws one that lasts as long as the process.

Collision check, over all entities of the corpus: a surrogate that two entities of a kind share, or that is itself an entity that occurs
or the one that it stands for, goes to the entity that comes first; the others take their next attempt, until no two agree. Entities
with a later attempt are few; at most FEW go to the tasks as they are, more are joined by doc_id, or by the text's hash without one.

Null texts stay null, empty ones empty; documents without an entity are unchanged. Repeated rows get the same result. An empty table
gives no rows. All columns of the input are kept; a column named `replaced` is superseded. Time is linear in a text's length.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
import re
import secrets
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, lean, read

FEW = 10_000
#: Where the key comes from: a setting of the session, or a variable of the environment.
KEY_SETTING, KEY_VARIABLE = "spark.cadenza.pii.key", "CADENZA_PII_KEY"
#: Titles by gender, and common given names by gender.
TITLES = {"f": "Mrs Ms Miss Frau Señora Sra Madame Mme Mlle Mademoiselle Signora Г-жа Κυρία Κα".split(), "m": "Mr Herr Señor Sr Monsieur Signor Г-н Κύριος Κος".split(), "x": "Dr Prof Doctor Professor".split()}
GIVEN = {
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Emma Maria Sofia Laura Julia Lena Claudia Sabine Petra Monika Ursula Marie Camille Chloé Julie Sophie Nathalie Isabelle Carmen Lucía Elena Pilar Dolores Isabel Ольга Анна Мария Елена Наталья Татьяна Ирина".split(),
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Paul Peter Hans Jürgen Klaus Wolfgang Stefan Andreas Pierre Jean Jacques Philippe Nicolas Antoine Juan Carlos José Luis Miguel Javier Antonio Francisco Иван Сергей Алексей Дмитрий Андрей Николай Владимир".split(),
}
#: Syllables that surrogate names are built from, by script, and endings of given names by gender.
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ha ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te ti to va ve vi".split(), "cyrillic": "ба бе бо да де до ка ке ла ле ли ло ма ме ми мо на не ни но па ра ре ри ро са се со та те ти то ва ве ви".split(), "greek": "βα βε βο γα δα δε δο ζα θα κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πε πο ρα ρε ρι ρο σα σε σο τα τε τι το φα φι χα".split()}
ENDINGS = {"latin": {"f": ["lia", "nella", "rine", "ssa"], "m": ["rik", "ton", "mund", "las"], "x": ["rin", "lis", "ren", "nis"], "family": ["sen", "mont", "berg", "well", "rez", "ford"]}, "cyrillic": {"f": ["лина", "рия", "нья"], "m": ["слав", "мир", "тон"], "x": ["нис", "рен"], "family": ["ров", "нин", "ский"]}, "greek": {"f": ["λία", "νίκη", "ρίνα"], "m": ["νος", "λαος", "ράς"], "x": ["νις", "ρις"], "family": ["ίδης", "άκης", "όπουλος", "άτος"]}}
#: Alphabets within which a character is replaced; other letters and digits have theirs by alphabet().
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåçèéêëìíîïñòóôõöùúûüý", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
PLACE = {c: (a, i) for a in ALPHABETS for i, c in enumerate(a)}
#: Attempts after which surrogates of e-mail addresses get longer, and rounds of the collision check.
SAME_SHAPE, ROUNDS = 4, 60

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
CAPITAL = r"[^\W\d_a-zß-öø-ÿа-яёΐά-ώ][^\W\d_]+(?:-[^\W\d_]+)?"
#: What stands before a name, what stands after two of its words, and capitalised words that are no names there.
BEFORE = ("[Mm]y name is", "I am called", "[Ff]ull [Nn]ame:", "Author:", "Attn:?", "Dear", "[Rr]egards,", "Sincerely,", "Yours,", "[Ss]igned by", "[Mm]ein Name ist", "[Ii]ch heiße", "Liebe", "Lieber", "Grüßen", "[Jj]e m'appelle", "Cher", "Chère", "Cordialement,", "[Mm]e llamo", "[Mm]i nombre es", "Querid[oa]", "Estimad[oa]", "[Мм]еня зовут", "Уважаем(?:ый|ая)", "Дорог(?:ой|ая)", "Με λένε")
AFTER = ("met", "married", "was born", "lives in", "lived in", "works at", "works for", "emailed", "phoned", "texted", "smiled", "laughed", "nodded")
NOT_NAMES = frozenset("The A An This That These Those Our My Your His Her Their Its In On At By To For From Of When While If As But And Or So Then Some Many Every Each One No All Sir Sirs Madam Madame Customer Customers Team Friend Friends Colleague Colleagues Members Member Reader Readers Editor Editors Hiring Manager Everyone Santa Diary Lord Damen Herren Kollegen Kolleginnen Grüße Gott God Leute Eltern Gäste Mitglieder Leser Leserinnen Freunde Kunde Kunden Kundin Monsieur Messieurs Client Clients Amis Señor Señora Señores Amigo Amiga Amigos Cliente Клиент Клиенты Друзья Коллеги We They He She It There Here".split())
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)+", re.I)),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)")),
    ("ip", re.compile(rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)")),
    ("phone", re.compile(r"(?<!\w)(?:\+\d{1,3}(?:[ .-]?\(\d{1,4}\)|[ .-]?\d{1,4}){2,5}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
)
WANTED = re.compile(r"[@\d]").search
TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted((t for x in TITLES.values() for t in x), key=len, reverse=True))})\.?[ \xa0]+({CAPITAL})(?:[ \xa0]+({CAPITAL}))?")
NAMED = re.compile(rf"(?<![\w-])((?:{'|'.join(sorted((t for x in GIVEN.values() for t in x), key=len, reverse=True))})(?:-{CAPITAL})?)[ \xa0]+({CAPITAL})")
FULL = rf"({CAPITAL})(?:[ \xa0]+({CAPITAL}))?(?:[ \xa0]+({CAPITAL}))?"
INTRODUCED = re.compile(rf"(?<!\w)(?:{'|'.join(BEFORE)})\s+{FULL}")
PERSON = re.compile(rf"(?<!\w)({CAPITAL})[ \xa0]+({CAPITAL})(?= (?:{'|'.join(AFTER)})(?!\w)| (?:and|und|et|y|и|και) {CAPITAL} {CAPITAL} (?:{'|'.join(AFTER)})(?!\w))")
LOCAL = re.compile(r"([^\W\d_]{2,})[._-]([^\W\d_]{2,})\d*@")
GENDER = {t: g for table in (TITLES, GIVEN) for g, names in table.items() for t in names}
TITLE_WORDS, GIVEN_NAMES = (frozenset(t for x in table.values() for t in x) for table in (TITLES, GIVEN))
NO_PERSON = NOT_NAMES | TITLE_WORDS
#: Literals without which no cue in BEFORE is there.
CUES = ("name is", "called", "ame:", "uthor", "Attn", "Dear", "egards", "Sincerely", "Yours", "igned by", "Name ist", "heiße", "Lieb", "Grüßen", "appelle", "Cher", "Chère", "Cordialement", "llamo", "nombre es", "Querid", "Estimad", "зовут", "Уважаем", "Дорог", "λένε")
CAPITALS = re.compile(rf"(?<!\w){CAPITAL}(?!\w)")
NAMES = ("given_f", "given_m", "given_x", "family")
FOUND = "kind string, entity string"


def luhn(digits: str) -> int:
    """The Luhn sum of digits, of which the last is the check digit."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))


def mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def entity_of(kind: str, mention: str) -> str | None:
    """What all mentions of one entity have in common, or None if the mention is none of that kind."""
    if kind == "email":
        return mention.lower()
    if kind == "iban":
        plain = mention.replace(" ", "")
        return plain if 15 <= len(plain) <= 34 and mod97(plain) == 1 else None
    if kind in NAMES:
        return mention.lower()
    if kind == "ip":
        return mention
    digits = re.sub(r"\D", "", mention)
    if kind == "card":
        return digits if luhn(digits) % 10 == 0 and digits.strip("0") else None
    if kind == "phone":
        return ("+" if mention[0] == "+" else "") + digits if 7 <= len(digits) <= 15 else None
    return digits


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of what is found, in order, without overlaps; earlier patterns go first."""
    text = text or ""
    found: list[tuple[int, int, str, str]] = []

    def add(spans: list[tuple[int, int, str]]) -> None:
        """Adds spans, in order and without overlaps, that no span before overlaps."""
        nonlocal found
        i, fresh = 0, []
        for start, end, kind in spans:
            while i < len(found) and found[i][1] <= start:
                i += 1
            if (i == len(found) or end <= found[i][0]) and (entity := entity_of(kind, text[start:end])) is not None:
                fresh.append((start, end, kind, entity))
        if fresh:
            found = list(heapq.merge(found, fresh))

    if WANTED(text):
        for kind, pattern in PATTERNS:
            add([(*m.span(), kind) for m in pattern.finditer(text)])
    capitals = {x.partition("-")[0] for x in CAPITALS.findall(text)}
    if capitals & TITLE_WORDS or "Г-" in text:
        add([(*m.span(g), kind) for m in TITLED.finditer(text) for g, kind in titled(m)])
    if capitals & GIVEN_NAMES:
        add([x for m in NAMED.finditer(text) for x in ((*m.span(1), given(m[1].partition("-")[0])), (*m.span(2), "family"))])
    if any(x in text for x in CUES):
        for m in INTRODUCED.finditer(text):
            words = [g for g in (1, 2, 3) if m[g]]
            words = words[: next((i for i, g in enumerate(words) if m[g] in NOT_NAMES or m[g] in TITLE_WORDS), len(words))]
            add([(*m.span(g), given(m[g]) if g < words[-1] or len(words) == 1 else "family") for g in words])
    if any(x in text for x in AFTER):
        persons = [m for m in PERSON.finditer(text) if not {m[1], m[2], *text[max(0, m.start() - 12) : m.start()].split()[-1:]} & NO_PERSON]
        add([x for m in persons for x in ((*m.span(1), given(m[1])), (*m.span(2), "family"))])
    for one, two in {(m[1], m[2]) for _, _, kind, entity in found if kind == "email" and (m := LOCAL.match(entity))}:
        both = re.compile(rf"(?<!\w)({re.escape(one)})[ \xa0]+({re.escape(two)})(?!\w)", re.I)
        add([x for m in both.finditer(text) if not (m[1][0].islower() or m[2][0].islower()) for x in ((*m.span(1), given(m[1])), (*m.span(2), "family"))])
    names: dict[str, str] = {}
    for _, _, kind, entity in found:
        if kind in NAMES:
            names.setdefault(entity, kind)
    if names:
        add([(*m.span(), names[m[0].lower()]) for m in CAPITALS.finditer(text) if m[0].lower() in names])
    return found


def given(name: str) -> str:
    return f"given_{GENDER.get(name, 'x')}"


def titled(m: re.Match) -> list[tuple[int, str]]:
    """The groups of a match of TITLED that are names, and their kinds."""
    gender = GENDER[m[1]]
    if not m[3]:
        return [(2, "family")]
    known = GENDER.get(m[2])
    return [(2, f"given_{known if gender == 'x' and known else gender}"), (3, "family")]


def word(key: bytes, *parts) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key[:64], digest_size=8).digest(), "big")


def permuted(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..n-1: six Feistel rounds on the next even number of bits, walked until the result is in range."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for i in range(6):
            a, b = b, a ^ (word(key, tweak, i, b) & mask if half <= 64 else int.from_bytes(hashlib.shake_128(key + f"{tweak}\0{i}\0{b}".encode()).digest(-(-half // 8)), "big") & mask)
        x = a << half | b
        if x < n:
            return x


@functools.lru_cache(maxsize=4096)
def alphabet(script: str, row: int) -> str:
    """The lower-case or caseless letters and numbers of a script in a row of 256 code points that no fixed alphabet has."""
    row = map(chr, range(row << 8, row + 1 << 8))
    return "".join(c for c in row if c.isalnum() and not c.isdecimal() and c not in PLACE and c.lower() == c and script_of(c) == script)


def script_of(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


@functools.lru_cache(maxsize=65536)
def place(c: str) -> tuple[str, int] | None:
    """The alphabet within which a character is replaced, and its place there; None if it is no letter and no digit."""
    if c in PLACE or not c.isalnum():
        return PLACE.get(c)
    if c.isdecimal():
        return "".join(chr(ord(c) - int(c) + i) for i in range(10)), int(c)
    own = alphabet(script_of(c), ord(c) >> 8)
    return (own, own.index(c)) if c in own else None


def reshaped(text: str, key: bytes, tweak: str) -> str:
    """The text with each character of an alphabet replaced within it: a permutation of all texts of that shape."""
    at = [(i, *place(c)) for i, c in enumerate(text) if place(c)]
    n = x = 0
    size = 1
    for _, letters, i in at:
        x, size = x * len(letters) + i, size * len(letters)
    if not at:
        return text
    shape = "".join(place(c)[0][0] if place(c) else c for c in text)
    x, out = permuted(x, size, key, f"{tweak}\0{shape}"), list(text)
    for i, letters, _ in reversed(at):
        x, n = divmod(x, len(letters))
        out[i] = letters[n]
    return "".join(out)


def private(ip: int) -> bool:
    return ip >> 24 in (10, 127) or ip >> 20 == 0xAC1 or ip >> 16 in (0xC0A8, 0xA9FE)


def new_host(host: str, key: bytes) -> str:
    """A host's replacement, with its last label kept; a host that would stay as it is gets more letters."""
    body, dot, last = host.rpartition(".")
    new = reshaped(body, key, "host")
    return (letters(word(key, "host", host), 6) + new if new == body else new) + dot + last


def letters(h: int, n: int) -> str:
    out = ""
    for _ in range(n):
        h, i = divmod(h, 26)
        out += ALPHABETS[1][i]
    return out


def surrogate(kind: str, entity: str, attempt: int, key: bytes) -> str:
    """The entity's replacement, as an entity of the same kind."""
    tweak = f"{kind}\0{attempt}"
    if kind == "email":
        name, host = entity.rsplit("@", 1)
        new = reshaped(name, key, f"{tweak}\0{host}")
        if attempt >= SAME_SHAPE or not any(len(p[0]) > 1 for p in map(place, name) if p):  # the shape has too few texts, or one
            new += letters(word(key, tweak, entity), 8 + max(0, attempt - SAME_SHAPE) // 8)
        return f"{new}@{new_host(host, key)}"
    if kind == "card":
        head, body = entity[0], reshaped(entity[1:-1], key, tweak + entity[0])
        zero = ord(entity[-1]) - int(entity[-1])
        return head + body + chr(zero + -luhn(head + body + "0") % 10)
    if kind == "iban":
        body = reshaped(entity[4:].lower(), key, tweak + entity[:2]).upper()
        return f"{entity[:2]}{98 - mod97(entity[:2] + '00' + body):02d}{body}"
    if kind == "ip":
        x = own = int.from_bytes(bytes(map(int, entity.split("."))), "big")
        while True:
            x = permuted(x, 1 << 32, key, tweak)
            if private(x) == private(own) and (1 <= x >> 24 <= 223) == (1 <= own >> 24 <= 223):
                return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "phone":
        head = entity[: max(0, len(entity) - 10)] if entity[0] == "+" else ""  # the country's code and more stays
        return head + reshaped(entity[len(head) :], key, tweak + head)
    if kind == "ssn":
        return reshaped(entity, key, tweak)
    script = script_of(entity[0]).lower()
    h = word(key, tweak, entity)
    out = ""
    if script not in SYLLABLES:
        for c in entity + entity[:1] * (attempt // 4):
            own = place(c)
            h, i = divmod(h, len(own[0])) if own else (h, 0)
            out += own[0][i] if own else c
            h = h or word(key, tweak, out)
        return out
    ends, syllables = ENDINGS[script][kind.removeprefix("given_")], SYLLABLES[script]
    for _ in range(2 + attempt // 4):
        h, i = divmod(h, len(syllables))
        out += syllables[i]
    return out + ends[h % len(ends)]


def poured(kind: str, new: str, mention: str) -> str:
    """A surrogate in a mention's case and separators."""
    if kind in ("card", "phone", "ssn", "iban"):
        new = iter(new.lstrip("+"))
        return "".join(next(new, "") if c.isalnum() else c for c in mention)
    if kind == "email":
        return "".join(n.upper() if m.isupper() and n.upper().lower() == n else n for n, m in zip(new, mention)) if len(new) == len(mention) else new
    if kind in NAMES:
        return new.upper() if mention.isupper() and len(mention) > 1 else new.title()
    return new


def candidates(key: bytes):
    """A mapInArrow function: (kind, entity, attempt) with the surrogate; an attempt whose surrogate is the entity itself is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, entities, attempts = (c.to_pylist() for c in batch.columns)
            out = []
            for i, (k, e) in enumerate(zip(kinds, entities)):
                while (new := surrogate(k, e, attempts[i], key)) == e and attempts[i] < 50:
                    attempts[i] += 1
                out.append(new)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(attempts, pa.int32()), pa.array(out, pa.string())], names=["kind", "entity", "attempt", "surrogate"])

    return run


def assignments(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, attempt and surrogate of distinct entities: within a kind no two share a surrogate, and none is an entity."""
    columns = "kind string, entity string, attempt int, surrogate string"
    known = cut(entities.select("kind", "entity"))
    done = cut(known.withColumn("attempt", F.lit(0)).mapInArrow(lean(candidates(key)), columns))
    for _ in range(ROUNDS):
        owner = cut(done.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("o"), F.count("*").alias("n")).filter("n > 1").select("kind", "surrogate", F.col("o.entity").alias("owner")))
        taken = known.withColumnRenamed("entity", "surrogate").withColumn("real", F.lit(True))
        judged = cut(done.join(owner, ["kind", "surrogate"], "left").join(taken, ["kind", "surrogate"], "left").withColumn("bad", F.coalesce("real", F.lit(False)) | F.coalesce(F.col("owner") != F.col("entity"), F.lit(False))))
        if judged.filter("bad").isEmpty():
            return done
        again = judged.filter("bad").select("kind", "entity", (F.col("attempt") + 1).alias("attempt")).mapInArrow(lean(candidates(key)), columns)
        done = cut(judged.filter("not bad").select("kind", "entity", "attempt", "surrogate").unionByName(again))
    raise RuntimeError(f"surrogates collide after {ROUNDS} attempts")


def distinct_entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {(k, e) for t in batch.column(0) for _, _, k, e in mentions(t.as_py())}
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["kind", "entity"])


def doc_entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {(d, k, e) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for _, _, k, e in mentions(t.as_py())}
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["__at", "kind", "entity"])


@functools.cache
def own_key() -> bytes:
    return secrets.token_bytes(32)


def session_key(spark: SparkSession) -> bytes:
    """The key by KEY_SETTING or KEY_VARIABLE; without either a random one, the same for all queries of this process."""
    found = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE)
    return found.encode() if found else own_key()


def replace_pii(docs: DataFrame, key: bytes) -> DataFrame:
    """The input with surrogates in `text`, and `replaced`: array of (kind, start, end, surrogate), positions in the new text."""
    kept = [c for c in docs.columns if c != "replaced"]
    done = assignments(docs.select("text").mapInArrow(lean(distinct_entities), FOUND).distinct(), key)
    later = cut(done.filter("attempt > 0").select("kind", "entity", "attempt"))
    rows = docs.select(*kept)
    few = [(r.kind, r.entity, r.attempt) for r in later.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        attempts = {(k, e): a for k, e, a in few}
    else:
        attempts = {}
        at = F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text"))  # documents that share a key only get more attempts than they need
        own = docs.select(at.alias("__at"), "text").mapInArrow(lean(doc_entities), "__at long, " + FOUND).join(later, ["kind", "entity"])
        lists = own.groupBy("__at").agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("__attempts"))
        rows = rows.select(F.struct(*kept).alias("__row"), at.alias("__at")).join(lists, "__at", "left").select("__row.*", "__attempts")
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("surrogate", T.StringType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.index("text")
        new_of = functools.lru_cache(maxsize=100_000)(lambda kind, entity, attempt: surrogate(kind, entity, attempt, key))
        for batch in batches:
            texts, spans = [], []
            extra = batch.column(len(kept)).to_pylist() if batch.num_columns > len(kept) else None
            for i, text in enumerate(batch.column(at)):
                text = text.as_py()
                found = mentions(text)
                own = {(x["kind"], x["entity"]): x["attempt"] for x in extra[i] or ()} if extra else attempts
                out, last, size, listed = [], 0, 0, []
                for start, end, kind, entity in found:
                    new = poured(kind, new_of(kind, entity, own.get((kind, entity), 0)), text[start:end])
                    size += start - last
                    listed.append({"kind": kind, "start": size, "end": size + len(new), "surrogate": new})
                    size += len(new)
                    out += [text[last:start], new]
                    last = end
                texts.append("".join([*out, text[last:]]) if found else text)
                spans.append(listed)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surrogate", pa.string())])))], names=[*kept, "replaced"])

    fields = [docs.schema[c] for c in kept]
    return rows.mapInArrow(lean(run), T.StructType([*fields, T.StructField("replaced", span)]))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = replace_pii(read(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    written = F.array_join(F.transform("replaced", lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return got.select("doc_id", "text", F.size("replaced").cast("bigint").alias("n_replaced"), written.alias("spans"))
