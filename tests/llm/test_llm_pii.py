"""Personal data: whole replaced texts against texts that were put together from known pieces."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from gridloom.llm import pii

NAMES = {
    "latin": (["Anna", "Paul", "Mira", "Jonas"], ["Berg", "Okafor", "Lind"], [("Dr", "n"), ("Mrs.", "f"), ("Herr", "m")]),
    "greek": (["Γιώργος", "Ελένη", "Νίκος"], ["Παπαδόπουλος", "Μαυρίδης"], [("Dr", "n"), ("Κύριος", "m"), ("Κυρία", "f")]),
    "armenian": (["Արամ", "Անի"], ["Պետրոսյան", "Հակոբյան"], [("Dr.", "n"), ("Պարոն", "m")]),
    "cyrillic": (["Анна", "Иван"], ["Петров", "Орлова"], [("госпожа", "f"), ("Dr", "n")]),
}
CLEAN = ["see ISBN 978-3-16-148410-0 there", "at 1700000000123 ms", "number 4929348385146301 is none", "order 9807915762804490", "GB00 WEST 1234 5698 7654 32 fails",
         "version 1.2.3 of 2020", "the 12 of May", "Anna is here", "a plain line, nothing more", "300.1.1.1 and 12345678"]


def luhn(digits):
    weighed = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(w - 9 if w > 9 else w for w in weighed) % 10


def iban_rest(text):
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def plain(text):
    return "".join(c for c in text if c.isalnum())


def entity(chance):
    """(kind, what stands before it, how it is written)."""
    kind = chance.choice(["email", "secret", "iban", "ip", "ssn", "phone", "card", "person"])
    number = chance.randrange(40)
    fixed = random.Random(f"{kind}{number}")
    digits = lambda n: "".join(fixed.choice("0123456789") for _ in range(n))
    if kind == "email":
        mail = f"{fixed.choice(['jo', 'a.lee', 'info'])}{number}@host{number % 5}.org"
        return kind, "", mail.upper() if chance.random() < 0.3 else mail
    if kind == "secret":
        return kind, "token = ", f"Ab{digits(6)}xY"
    if kind == "iban":
        account = digits(18)
        check = 98 - int("".join(str(int(c, 36)) for c in account + "DE00")) % 97
        whole = f"DE{check:02}{account}"
        return kind, "", whole if chance.random() < 0.5 else " ".join(whole[i:i + 4] for i in range(0, 22, 4))
    if kind == "ip":
        return kind, "", f"10.{number}.{fixed.randrange(256)}.7"
    if kind == "ssn":
        return kind, "", f"{digits(3)}-{digits(2)}-{digits(4)}"
    if kind == "phone":
        a, b, c, d, e = fixed.choice("123456789"), digits(2), digits(2), digits(2), digits(2)
        return kind, "", f"+33{chance.choice([' ', '.'])}{a}" + "".join(chance.choice([" ", "-"]) + x for x in (b, c, d, e))
    if kind == "card":
        body = "4" + digits(14)
        whole = body + str((10 - luhn(body + "0")) % 10)
        return kind, "", whole if chance.random() < 0.5 else " ".join(whole[i:i + 4] for i in range(0, 16, 4))
    script = fixed.choice(sorted(NAMES))
    first, last, titles = NAMES[script]
    return f"person {script}", chance.choice(titles)[0] + " ", f"{fixed.choice(first)} {fixed.choice(last)}"


def test_whole_texts_of_known_pieces(spark):
    chance = random.Random(12)
    made = []
    for doc in range(120):
        pieces = [("clean", "", chance.choice(CLEAN[:7] + CLEAN[8:])) if chance.random() < 0.4 else entity(chance) for _ in range(chance.randint(0, 9))]
        made.append((doc, pieces, " | ".join(lead + raw for _, lead, raw in pieces)))
    rows = spark.createDataFrame([(d, t) for d, _, t in made], "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.text, r.n_entities) for r in pii.replaced(rows, "key").collect()}
    given, real = {}, set()
    for doc, pieces, _ in made:
        text, count = found[doc]
        news = text.split(" | ") if pieces else []
        assert len(news) == len(pieces) and count == sum(k != "clean" for k, _, _ in pieces)
        for (kind, lead, raw), new in zip(pieces, news):
            if kind == "clean":
                assert new == raw
                continue
            assert new.startswith(lead)
            new = new[len(lead):]
            if kind.startswith("person"):
                assert len(new.split(" ")) == 2
                for a, b in zip(raw.split(" "), new.split(" ")):
                    assert given.setdefault((kind, a), b) == b and b.istitle()
                    assert {unicodedata.name(c).split(" ")[0] for c in b} == {kind.split(" ")[1].upper()}
                    real.add(a)
                continue
            own, other = (raw.lower(), new.lower()) if kind == "email" else (plain(raw), plain(new)) if kind != "ip" else (raw, new)
            assert given.setdefault((kind, own), other) == other
            real.add(own)
            if kind in ("iban", "ssn", "phone", "card"):
                assert re.sub(r"\d", "9", raw) == re.sub(r"\d", "9", new)
            if kind == "email":
                assert new.endswith(".EXAMPLE" if raw.isupper() else ".example")
            assert kind != "card" or luhn(other) == 0
            assert kind != "iban" or iban_rest(other) == 1
    assert len({(k.split(" ")[0], v) for (k, _), v in given.items()}) == len(given) > 100
    assert not real & set(given.values())


def test_a_form_with_too_few_values_gets_longer_ones(spark, count=501):
    entities = spark.range(count).select(F.lit("ssn").alias("type"), F.format_string("%03d", F.col("id")).alias("canon"))
    found = pii.surrogates(entities, "k").collect()
    given, known = [r.given for r in found], {r.canon for r in found}
    assert len(set(given)) == count and not known & set(given) and max(map(len, given)) <= 3 + 8


def test_longer_surrogates_are_written_whole(spark):
    row = spark.createDataFrame([("12-3", "9876543")], "raw string, given string")
    assert row.select(pii._written(F.col("raw"), F.lit("ssn"), F.col("given"))).first()[0] == "98-76543"


def test_check_digits(spark):
    texts = ["GB82WEST12345698765432", "DE89370400440532013000", "GB82WEST12345698765433"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(pii.iban_rest(F.col("t"))).collect()] == [iban_rest(t) for t in texts] == [1, 1, 28]
