"""Personal data: detected entities get keyed surrogates of the same type, gender, script and format.

Detection is a set of patterns. Every entity has a canonical form (a phone number's digits, a name's
lower-cased words), and its surrogate depends on the key, the type and that form only: however an
entity is written and wherever it stands, it gets the same surrogate, in the format of the place. All
distinct entities of the corpus are collected and their surrogates compared. Entities that share a
surrogate, or whose surrogate is itself an entity of the corpus, draw again until no two are alike, so
the replaced corpus has as many distinct entities as the original. Names are made of syllables of
their script, with an ending of their gender.

Persons are found by their titles. Every word of a name is an entity of its script, with one gender, or
none as a family name, settled by its titled mentions in the corpus. Where the words of a name found in a
document stand there without a title, they get the same surrogates. Names without a title anywhere in
their document stay.

Everything is a column expression or a join. Texts without entities are not moved; of the others, the
entities alone meet the table of surrogates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import saved, whole_text

# fixed values: what the patterns know
HONORIFICS = {
    "m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин", "Κύριος", "Պարոն"),
    "f": ("Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Госпожа", "Κυρία", "Տիկին"),
    "n": ("Dr", "Prof", "Mx", "доктор", "Доктор"),
}
SECRET_WORDS = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HONORIFIC = "(?:" + "|".join(sorted((w for ws in HONORIFICS.values() for w in ws), key=lambda w: (-len(w), w))) + r")\.?"
_NAME = r"\p{Lu}[\p{Ll}'’]+(?:-\p{Lu}[\p{Ll}]+)?"
_CAPITAL = r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}'’]*+(?:-\p{Lu}[\p{L}'’]*+)*+"
"""A word that can be part of a name found elsewhere in the document."""
_TAIL = r"['’]+(?:[sS]['’]*)?$"
"""What is not part of a name: the ending of a possessive, a closing quote."""
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*+(?<=\.[\p{L}]{2,24})"
_SECRET_LEAD = r"(?i:" + "|".join(SECRET_WORDS) + r")\s{0,3}[=:]\s{0,3}[\"']?"
_PATTERNS = {
    "email": _EMAIL,
    "secret": r"(?<![\p{L}\p{N}])" + _SECRET_LEAD + r"[A-Za-z0-9+/_-]{8,}|(?<![\p{L}\p{N}])[0-9a-f]{32,}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
             r"|(?<![\d.])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d.-]\d|\d)",
    "card": r"(?<![\d.])[2-6](?:[ -]?\d){12,18}(?!\d)",
    "person": rf"(?<![\p{{L}}\p{{N}}]){_HONORIFIC} {_NAME}(?: {_NAME}){{0,2}}",
}
"""In order: where several fit at one place, the first counts."""
_NONE = "none"
"""The type of what has an entity's form and is none."""
_ANY = "|".join(f"(?:{p})" for p in _PATTERNS.values())
_TITLES = "".join(sorted({w[0] for ws in HONORIFICS.values() for w in ws}))


def _may_hold(text: Column) -> Column:
    """Whether any pattern can fit somewhere: cheap looks, each of which settles most texts."""
    return (text.contains("@") | text.rlike("[0-9]") | text.rlike("[a-f]{32}")
            | text.rlike(rf"(?=[{_TITLES}]){_HONORIFIC} \p{{Lu}}")
            | (text.rlike("[=:]") & text.rlike("(?i:" + "|".join(SECRET_WORDS) + ")")))


# fixed values: what names are made of, for each script that has capitals; other such scripts get Latin names
_SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "armenian": r"\p{IsArmenian}"}
_CONSONANTS = {"latin": "bdfghklmnprstvwz", "cyrillic": "бвгдзклмнпрстфхш", "greek": "βγδζθκλμνπρστφχψ", "armenian": "բգդզթլկհմնպստրվք"}
_VOWELS = {"latin": "aeio", "cyrillic": "аеио", "greek": "αειο", "armenian": "աեիո"}
_ENDINGS = {
    ("latin", "f"): ("a", "ina", "elle", "ia"), ("latin", "m"): ("o", "us", "an", "er"), ("latin", "n"): ("in", "en", "is", "yn"),
    ("latin", "s"): ("son", "mann", "ez", "ard"), ("cyrillic", "f"): ("а", "ина", "ия", "ея"),
    ("cyrillic", "m"): ("ан", "ор", "ий", "ей"), ("cyrillic", "n"): ("ин", "ен", "он", "ич"), ("cyrillic", "s"): ("енко", "чук", "ман", "ский"),
    ("greek", "f"): ("α", "ια", "ινα", "η"), ("greek", "m"): ("ος", "ης", "ας", "ιος"), ("greek", "n"): ("ι", "ω", "υ", "ις"),
    ("greek", "s"): ("ιδης", "ακης", "πουλος", "ου"), ("armenian", "f"): ("ուհի", "ինե", "անուշ", "ե"),
    ("armenian", "m"): ("իկ", "են", "ակ", "ոս"), ("armenian", "n"): ("ի", "ան", "ուշ", "ամ"), ("armenian", "s"): ("յան", "ունի", "ենց", "եան"),
}
ROOMY = 8
"""Draws after which a surrogate becomes longer than its entity: its form may have too few values."""


def _type_of(raw: Column) -> Column:
    """The first type whose pattern fits the whole match."""
    found = None
    for name, pattern in _PATTERNS.items():
        fits = raw.rlike(rf"\A(?:{pattern})\z")
        found = F.when(fits, name) if found is None else found.when(fits, name)
    return found


def _plain(raw: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(raw, r"[^\p{L}\p{N}]", "")


def _stem(word: Column) -> Column:
    return F.regexp_replace(word, _TAIL, "")


def _parts(raw: Column, kind: Column) -> tuple[Column, Column]:
    """What stands before the replaced part, and the replaced parts: (type, raw, canonical form, tail, hint).

    The hint of a name word is the gender of its title, or its place: ``s`` as the last of several
    words, ``l`` as the only one.
    """
    lead = (F.when(kind == "person", F.regexp_extract(raw, rf"\A{_HONORIFIC} ", 0))
            .when(kind == "secret", F.regexp_extract(raw, rf"\A(?:{_SECRET_LEAD})?", 0)).otherwise(F.lit("")))
    rest = F.substr(raw, F.length(lead) + 1)
    title = F.regexp_replace(lead, r"[. ]+$", "")
    gender = F.when(title.isin(*HONORIFICS["m"]), "m").when(title.isin(*HONORIFICS["f"]), "f").otherwise("n")
    words = F.split(rest, " ")

    def word(w: Column, i: Column) -> Column:
        hint = F.when(F.size(words) == 1, F.lit("l")).when(i == F.size(words) - 1, F.lit("s")).otherwise(gender)
        script = F.lit("latin")
        for name, letters in _SCRIPTS.items():
            script = F.when(w.rlike(letters), name).otherwise(script)
        return F.struct(F.concat_ws(":", F.lit("person"), script).alias("type"), _stem(w).alias("raw"),
                        F.lower(_stem(w)).alias("canon"), F.substr(w, F.length(_stem(w)) + 1).alias("tail"), hint.alias("hint"))

    canon = F.when(kind == "email", F.lower(rest)).when(kind.isin("secret", "ip"), rest).otherwise(_plain(rest))
    one = F.array(F.struct(kind.alias("type"), rest.alias("raw"), canon.alias("canon"), F.lit("").alias("tail"), F.lit("").alias("hint")))
    return lead, F.when(kind == "person", F.transform(words, word)).otherwise(one)


# -- surrogates --------------------------------------------------------------------------------------

def _draw(stream: Column, at: Column, below: int) -> Column:
    """A whole number below ``below`` from two hex digits of the stream, at a place counted round."""
    pair = F.substr(stream, (F.pmod(at, F.lit(127)) + 1).cast("int"), F.lit(2))
    return F.pmod(F.conv(pair, 16, 10).cast("int"), F.lit(below))


def _pick(letters: str, at: Column) -> Column:
    return F.substr(F.lit(letters), at + 1, F.lit(1))


def _like(text: Column, stream: Column) -> Column:
    """Digits for digits, letters for letters of the same case, everything else as it is."""
    def char(c: Column, i: Column) -> Column:
        return (F.when(c.rlike(r"\d"), _draw(stream, i * 2, 10).cast("string"))
                .when(c.rlike(r"\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _draw(stream, i * 2, 26)))
                .when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", _draw(stream, i * 2, 26))).otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), char), "")


def _name(stream: Column, script: str, side: str, more: Column) -> Column:
    """Syllables and an ending; further draws have a syllable more."""
    def syllable(i: Column) -> Column:
        return F.concat(_pick(_CONSONANTS[script], _draw(stream, i * 4, 16)), _pick(_VOWELS[script], _draw(stream, i * 4 + 2, 4)))

    endings = F.array(*map(F.lit, _ENDINGS[script, side]))
    count = F.least(F.lit(3) + more, F.lit(24))
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), count), syllable), ""),
                    F.get(endings, _draw(stream, F.lit(101), 4)))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits; a valid number's is a multiple of ten."""
    def weigh(c: Column, i: Column) -> Column:
        digit = c.cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return F.when(F.pmod(F.length(digits) - i, F.lit(2)) == 0, doubled).otherwise(digit)

    return F.aggregate(F.transform(F.split(digits, ""), weigh), F.lit(0), lambda a, b: a + b)


def iban_rest(text: Column) -> Column:
    """An IBAN's number modulo 97 (letters count from 10, the first four characters last): 1 if it is valid."""
    turned = F.split(F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4))), "")
    value = F.transform(turned, lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(value, F.lit(0), lambda a, v: F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))


def _not_real(raw: Column) -> Column:
    """Whether a match is a card's or an account's by its form only: its check digits say no."""
    plain = _plain(raw)
    card = raw.rlike(r"\A[0-9][0-9 -]{12,}\z") & (F.length(plain) >= 13)
    iban = raw.rlike(rf"\A(?:{_PATTERNS['iban']})\z")
    return (card & (luhn_sum(plain) % 10 != 0)) | (iban & (iban_rest(plain) != 1))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of the replacement, for one draw."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"))
    stream = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\x1f+")), 256))
    local = F.substring_index(canon, "@", 1)
    mail = F.concat(_like(local, stream), F.lit("@"), F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(5)), lambda i: _pick("abcdefghijklmnopqrstuvwxyz", _draw(stream, i * 2 + 90, 26))), ""), F.lit(".example"))
    octets = F.concat_ws(".", (_draw(stream, F.lit(1), 223) + 1).cast("string"), _draw(stream, F.lit(9), 256).cast("string"),
                         _draw(stream, F.lit(17), 256).cast("string"), (_draw(stream, F.lit(25), 254) + 1).cast("string"))
    hexes = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.substr(
        stream, (F.pmod(i, F.lit(128)) + 1).cast("int"), F.lit(1))), "")
    like = _like(canon, stream)
    country = F.greatest(F.length(canon) - 10, F.lit(0))
    phone = F.concat(F.substr(canon, F.lit(1), country), (_draw(stream, F.lit(3), 8) + 2).cast("string"), F.substr(like, country + 2))
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(like, F.lit(2), F.length(canon) - 2))
    check = F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = F.concat(body, F.when(luhn_sum(canon) % 10 == 0, check).otherwise(F.substr(like, F.length(canon))))
    land, account = F.substr(canon, F.lit(1), F.lit(2)), F.substr(like, F.lit(5))
    iban = F.concat(land, F.lpad((98 - iban_rest(F.concat(land, F.lit("00"), account))).cast("string"), 2, "0"), account)
    made = (F.when(kind == "email", mail).when(kind == "ip", octets).when(kind == "phone", phone).when(kind == "card", card)
            .when(kind == "iban", iban).when(kind.isin("secret") & canon.rlike(r"\A[0-9a-f]+\z"), hexes))
    for script in _CONSONANTS:
        for side in ("f", "m", "n", "s"):
            made = made.when(kind == f"person:{script}:{side}", _name(stream, script, side, attempt))
    made = made.otherwise(like)
    # forms of a fixed size may have no value left that is free: then two digits more, or an address of the longer kind
    longer = F.array_join(F.transform(F.sequence(F.lit(1), F.least(2 * (attempt - ROOMY + 1), F.lit(24))), lambda i: _draw(
        stream, i * 4 + 1, 10).cast("string")), "")
    groups = F.concat(F.lit("2001:db8"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.concat(
        F.lit(":"), F.substr(stream, (i * 8 + 1).cast("int"), F.lit(4)))), ""))
    return (F.when((attempt < ROOMY) | kind.startswith("person") | (kind == "email"), made).when(kind == "ip", groups)
            .otherwise(F.concat(made, longer)))


def _settled(place: DataFrame) -> DataFrame:
    """type, canon, full type: of a name word with the gender that most of its mentions have."""
    def votes(hint: str) -> Column:
        return F.count_if(F.col("hint") == hint)

    gender = F.when(votes("f") > votes("m"), "f").when(votes("m") > votes("f"), "m").otherwise("n")
    first = votes("f") + votes("m") + votes("n")
    side = F.when((first > 0) & (first >= votes("s")), gender).otherwise("s")
    full = F.when(F.col("type").startswith("person"), F.concat_ws(":", "type", side)).otherwise(F.col("type"))
    return saved(place.groupBy("type", "canon").agg(full.alias("full")), "settled")


def _untitled(piece: Column, names: Column) -> Column:
    """Text between entities with surrogates for the words of ``names`` (by canonical form), and how many it has."""
    words, gaps = F.regexp_extract_all(piece, F.lit(_CAPITAL), F.lit(0)), F.split(piece, _CAPITAL, -1)

    def new(w: Column, i: Column) -> Column:
        given, stem = F.element_at(names, F.lower(_stem(w))), _stem(w)
        return F.concat(F.get(gaps, i), F.when(given.isNull(), w).otherwise(
            F.concat(_written(stem, F.lit("person"), given), F.substr(w, F.length(stem) + 1))))

    known = F.filter(words, lambda w: F.element_at(names, F.lower(_stem(w))).isNotNull())
    text = F.concat(F.array_join(F.transform(words, new), ""), F.element_at(gaps, -1))
    held = (F.size(names) > 0) & (F.size(known) > 0)
    return F.struct(F.when(held, text).otherwise(piece).alias("text"), F.when(held, F.size(known)).otherwise(0).alias("n"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """type, canon, given: a surrogate for each distinct entity, all distinct and none an entity itself.

    Entities that still share one after ``ROOMY`` draws get longer surrogates, of which there are ever more, so
    the rounds end even where a form has fewer free values than entities.
    """
    table = saved(entities.select("type", "canon", F.lit(0).alias("attempt"), surrogate(
        F.col("type"), F.col("canon"), F.lit(0), key).alias("given")), "surrogates")
    first = Window.partitionBy("type", "given").orderBy("attempt", "canon")
    while True:
        # a name is a real one whatever its gender
        table = table.withColumn("base", F.substring_index("type", ":", 2))
        real = table.select("base", F.col("canon").alias("given"), F.lit(True).alias("real"))
        shared = table.groupBy("type", "given").count().where("count > 1").select("type", "given")
        losers = table.join(shared, ["type", "given"], "left_semi").withColumn("n", F.row_number().over(first)).where("n > 1")
        again = losers.select("type", "canon").unionByName(
            table.join(real, ["base", "given"], "left_semi").select("type", "canon")).distinct()
        again = saved(again.withColumn("again", F.lit(True)), "again")
        if again.isEmpty():
            return table.drop("attempt", "base")
        attempt = F.col("attempt") + F.when(F.col("again"), 1).otherwise(0)
        table = saved(table.join(again, ["type", "canon"], "left").select("type", "canon", attempt.alias("attempt"), F.when(
            F.col("again"), surrogate(F.col("type"), F.col("canon"), attempt, key)).otherwise(F.col("given")).alias("given")), "surrogates")


def _written(raw: Column, kind: Column, given: Column) -> Column:
    """The surrogate in the format of the place: its letters and digits where the entity has its own."""
    place = F.transform(F.split(raw, ""), lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), F.substr(
        given, F.length(_plain(F.substr(raw, F.lit(1), i + 1))), F.lit(1))).otherwise(c))
    cased = (F.when(raw == F.upper(raw), F.upper(given)).otherwise(F.initcap(given)))
    mail = F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(given)).otherwise(given)
    return (F.when(kind.startswith("person"), cased).when(kind == "email", mail).when(kind.isin("ip", "secret"), given)
            .otherwise(F.concat(F.array_join(place, ""), F.substr(given, F.length(_plain(raw)) + 1))))


def replaced(docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: doc_id, text with surrogates, n_entities: what the patterns found, and each
    word that repeats a name of the document without a title.

    Null and empty texts come back empty, texts without entities unchanged. Repeated rows and ids are
    each replaced, with the same surrogates. Texts are searched whole. Other columns are ignored. No
    rows give no rows.
    """
    own = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text"))
    found = own.withColumn("raws", F.when(_may_hold(F.col("text")), F.regexp_extract_all("text", F.lit(_ANY), F.lit(0)))
                           .otherwise(F.array().cast("array<string>")))
    found = found.withColumn("n_real", F.size(F.filter("raws", lambda r: ~_not_real(r))))
    some = saved(found.where(F.col("n_real") > 0).withColumn("row_id", F.monotonically_increasing_id()), "texts")
    place = some.select("row_id", F.posexplode("raws").alias("place", "match"))
    lead, parts = _parts(F.col("match"), F.col("kind"))
    kind = F.when(_not_real(F.col("match")), F.lit(_NONE)).otherwise(_type_of(F.col("match")))
    place = place.withColumn("kind", kind).select("row_id", "place", lead.alias("lead"), parts.alias("parts"))
    place = saved(place.select("row_id", "place", "lead", F.posexplode("parts").alias("word", "part")).select(
        "row_id", "place", "lead", "word", "part.*"), "entities")
    full = _settled(place.where(F.col("type") != _NONE))
    given = surrogates(full.select(F.col("full").alias("type"), "canon"), key)
    given = full.join(given.withColumnRenamed("type", "full"), ["full", "canon"]).drop("full")
    new = F.concat(F.coalesce(_written(F.col("raw"), F.col("type"), F.col("given")), F.col("raw")), F.col("tail"))
    word = F.struct("place", "word", "lead", new.alias("new"))
    name = F.when(F.col("type").startswith("person"), F.struct("canon", "given"))
    news = place.join(given, ["type", "canon"], "left").groupBy("row_id").agg(
        F.array_sort(F.collect_list(word)).alias("words"), F.map_from_entries(F.collect_set(name)).alias("names"))
    # words of one entity are joined by a blank, its lead stands before the first
    pieces = F.transform(F.split("text", _ANY, -1), lambda p: _untitled(p, F.col("names")))
    between = F.transform("words", lambda w: F.concat(
        F.when(w["word"] == 0, F.concat(F.get("pieces", w["place"])["text"], w["lead"])).otherwise(F.lit(" ")), w["new"]))
    text = F.concat(F.array_join(between, ""), F.element_at("pieces", -1)["text"])
    more = F.aggregate("pieces", F.lit(0), lambda n, p: n + p["n"])
    changed = some.join(saved(news, "words"), "row_id").withColumn("pieces", pieces).select(
        "doc_id", text.alias("text"), (F.col("n_real") + more).cast("bigint").alias("n_entities"))
    untouched = found.where(F.col("n_real") == 0).select("doc_id", "text", F.lit(0).cast("bigint").alias("n_entities"))
    return untouched.unionByName(changed)
