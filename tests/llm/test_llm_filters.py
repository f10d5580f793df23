"""URL rules, surrogates, quality and benchmark leaks."""

import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, pii, quality, queries, url_filter

RULES = queries.URL_RULES


def judged(spark, urls, rules=RULES, limit=None, monkeypatch=None):
    if limit is not None:
        monkeypatch.setattr(url_filter, "BROADCAST_CHARS", limit)
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, prefix string")
    found = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}


def plain_judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


URLS = ["https://www.example.com/en/1?x#y", "http://EXAMPLE.com/en/", "http://a.b.example.com/en/q", "http://example.com/de", "http://x.net/es/1",
        "http://x.net/es", "http://x.net", "http://com/", "http://com", None, "", "no scheme", "://a.com/x", "http://a.com?x=/en/", "ftp://u@h.com:80/p",
        "http://a..com/x", "http://a.com./x", "http://xcom/", "http://é.com/ü", "http://a://b/c", "http://net/fr/" + "x/" * 300,
        "http://" + "s." * 200 + "net/fr/x", "http://a.com/x\ny", "http://x.net/es/1"]


@pytest.mark.parametrize("limit", [None, 0])
def test_url_rules(spark, monkeypatch, limit):
    found = judged(spark, URLS, limit=limit, monkeypatch=monkeypatch)
    assert found == {i: plain_judge(u, RULES) for i, u in enumerate(URLS)}


def test_url_rules_inside_a_folder_and_conflicts(spark):
    rules = [("a.com", "/x", "block"), ("a.com", "/x/y", "allow"), ("a.com", "", "block"), ("b.com", "/", "allow"), ("b.com", "/", "block"),
             ("B.org", "/q/", "block"), (None, "/", "block"), ("c.com", None, "block")]
    urls = ["http://a.com/xyz", "http://a.com/x/yz", "http://a.com", "http://a.com/q", "http://b.com/", "http://b.org/q/", "http://c.com/"]
    want = {0: ("a.com/x", "block"), 1: ("a.com/x/y", "allow"), 2: ("a.com", "block"), 3: ("a.com", "block"), 4: ("b.com/", "block"),
            5: ("b.org/q/", "block"), 6: (None, "allow")}
    assert {i: r[2:] for i, r in judged(spark, urls, rules).items()} == want
    assert judged(spark, urls, rules[:1])[6] == ("c.com", "/", None, "allow")
    assert {r[3] for r in judged(spark, urls, [(None, None, None)]).values()} == {"allow"}


def test_url_judges_no_pages(spark):
    assert judged(spark, ["x"])[0][2] is None
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, spark.createDataFrame(RULES, "host string, path string, action string")).collect() == []


# -- surrogates --------------------------------------------------------------------------------------

def surrogates_of(spark, texts, key="k"):
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)]
    made = pii.replaced(spark.createDataFrame(rows, "doc_id long, text string, raws string, place int"), key)
    return {r.doc_id: (r.text, r.n_entities) for r in made.collect()}


def test_surrogates_keep_format_and_coreference(spark):
    texts = ["Call +1 (523) 555-1055, or +1 523 555 1055.", "Mr John Smith met Mrs. Smith.", "jane.doe@mail5.example.com JANE.DOE@MAIL5.EXAMPLE.COM",
             "card 4111 1111 1111 1111, 4111111111111111; ip 10.20.30.40.", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###',
             "IBAN DE89 3704 0044 0532 0130 00 ssn 123-45-6789", "госпожа Анна Иванова", None, "", "clean, 12 of 2020; 1.2.3", "Call +1 (523) 555-1055"]
    found = surrogates_of(spark, texts)
    one, two = re.fullmatch(r"Call \+1 \((\d{3})\) (\d{3})-(\d{4}), or \+1 (\d{3} \d{3} \d{4})\.", found[0][0]).group(1, 4)
    assert two.startswith(one) and "523" != one
    a, b = re.fullmatch(r"Mr [A-Z][a-z]+ ([A-Z][a-z]+) met Mrs\. ([A-Z][a-z]+)\.", found[1][0]).groups()
    assert a == b != "Smith"
    low, up = found[2][0].split(" ")
    assert low.upper() == up and re.fullmatch(r"[a-z]{4}\.[a-z]{3}@[a-z]{6}\.example", low)
    spaced, plain = re.fullmatch(r"card ((?:\d{4} ){3}\d{4}), (\d{16}); ip (?:\d+\.){3}\d+\.", found[3][0]).groups()
    assert spaced.replace(" ", "") == plain and spark.range(1).select(pii.luhn_sum(F.lit(plain)) % 10).first()[0] == 0
    assert re.fullmatch(r'token = "[0-9a-f]{40}"###', found[4][0]) and "24be" not in found[4][0]
    assert re.fullmatch(r"IBAN DE\d\d( \d{4}){4} \d\d ssn \d{3}-\d\d-\d{4}", found[5][0])
    assert re.fullmatch(r"госпожа [А-Я][а-я]+(а|ина|ия|ея) [А-Я][а-я]+", found[6][0])
    assert found[7] == found[8] == ("", 0) and found[9] == (texts[9], 0)
    assert found[10][0] == found[0][0].split(",")[0]
    assert found[0][1] == 2 and found[1][1] == 2
    assert surrogates_of(spark, texts, "other")[0][0] != found[0][0]


def test_surrogates_stay_distinct(spark):
    # three hundred entities of a format that has a thousand surrogates, three hundred of which are entities
    entities = spark.range(300).select(F.lit("ssn").alias("type"), F.format_string("%03d", F.col("id")).alias("canon"))
    found = pii.surrogates(entities, "k").collect()
    given, real = [r.given for r in found], {r.canon for r in found}
    assert len(set(given)) == 300 and not real & set(given)


def test_surrogates_in_long_and_repeated_rows(spark):
    text = ("mail a.b@c.org. " + "word " * 20_000) * 2
    found = surrogates_of(spark, [text, text, "a.b@c.org"])
    assert found[0] == found[1] and found[0][1] == 2
    mail = found[2][0]
    assert found[0][0] == text.replace("a.b@c.org", mail)
    assert pii.replaced(spark.createDataFrame([], "doc_id long, text string"), "k").collect() == []


# -- quality -----------------------------------------------------------------------------------------

def test_quality_learns_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.quality_scores(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").select("quality", "predicted").collect()
    assert scored.count() == docs.count() and len(rows) > 200
    assert sum(r.quality == r.predicted for r in rows) / len(rows) > 0.97


def test_quality_edge_rows(spark):
    good, bad = "Some plain words that say a thing. Then more of it, calmly.", "BUY!! NOW!! $$$ ### !!! CASH!!"
    rows = [(i, (good if i % 3 else bad) + f" {i}", "x", 1.0) for i in range(200)]
    rows += [(1000, None, "x", 1.0), (1001, "", "x", 1.0), (None, good, "x", 1.0), (5, bad, "x", 1.0), (1002, "a" * 200_000, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, stat_upper double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(3, None), (None, 1)], "doc_id long, quality int")
    found = quality.quality_scores(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert all(r.predicted == (r.score >= 0.3) for r in found)
    by_id = {r.doc_id: r.predicted for r in found if r.doc_id not in (5, None)}
    assert sum(by_id[i] == (i % 3 > 0) for i in range(200) if i != 5) > 190
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in found)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.quality_scores(docs, none).collect()] == [0.5, 0.5]
    assert quality.quality_scores(docs.limit(0), none).collect() == []


# -- benchmark leaks ---------------------------------------------------------------------------------

def plain_found(text, items):
    words, found = decontaminate.words_of(text or ""), {}
    for item, other in items:
        own = decontaminate.words_of(other or "")
        width = min(5, len(own))
        if item is None or not own:
            continue
        wanted = {tuple(own[i:i + width]) for i in range(len(own) - width + 1)}
        hits = len(wanted & {tuple(words[i:i + width]) for i in range(len(words) - width + 1)})
        if hits * 5 >= len(wanted) * 4:
            found[item] = max(found.get(item, 0), hits / len(wanted))
    return found


PASSAGE = "The quick brown fox jumps over the lazy dog, while seven wizards watch from a tower near the quiet river at noon."


@pytest.mark.parametrize("block_chars", [10_000_000, 60])
def test_leaks(spark, block_chars):
    words = PASSAGE.split(" ")
    hit = lambda n: " ".join(w if i >= n else f"other{i}" for i, w in enumerate(words))
    items = [(1, PASSAGE), (2, "two words"), (3, ""), (4, None), (5, "word " * 40), (1, PASSAGE), (6, "Éa çb ñc öd üe ßf gg"), (None, "nobody"),
             (7, "alpha beta gamma delta epsilon zeta"), (7, "eta theta iota kappa lambda mu")]
    filler = " ".join(f"fill{i}" for i in range(20_000))
    texts = [PASSAGE, PASSAGE.upper().replace(",", " --"), filler + " " + PASSAGE + " " + filler, *(hit(n) for n in range(6)), None, "", "two  words",
             "two other words", "word word word word word word", "x éA ÇB ñC öd üe ßf gg", filler, PASSAGE, "eta theta iota kappa lambda mu"]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, found string, item_id int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    into = "hits"
    made = decontaminate.with_items(docs, benchmark, into, block_chars=block_chars)
    got = {r.doc_id: {h.item_id: h.containment for h in r.hits} for r in made.collect()}
    assert got == {i: plain_found(t, items) for i, t in enumerate(texts)}
    assert got[2] == {1: 1.0} and got[15] == {}
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in got if not got[i]]


def test_leaks_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs, none).collect()[0].contaminated is False
    assert decontaminate.contamination(docs.limit(0), none).collect() == []
