"""Cases in which the training-data operators once did less than the whole job."""

import re

import numpy as np
import pytest

from gridloom.llm import decontaminate, html_text, packing, pii, quality, simhash


def dense_prints(chance):
    """A group of close fingerprints, larger than a leaf, among others."""
    base = np.uint64(chance.integers(0, 2 ** 63))
    flips = np.uint64(1) << chance.integers(0, 64, size=(900, 2)).astype(np.uint64)
    dense = base ^ flips[:, 0] ^ flips[:, 1]
    return chance.permutation(np.unique(np.concatenate([dense, chance.integers(0, 2 ** 63, 600).astype(np.uint64)])))


def brute_roots(values, radius):
    forest = simhash._Forest(len(values))
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= radius)
    forest.link(a, b)
    return forest.find(np.arange(len(values)))


@pytest.mark.parametrize("slices", [2, 4])
def test_pieces_of_a_shard_lose_no_link(slices):
    for seed in range(40):
        chance = np.random.default_rng(seed)
        values = dense_prints(chance)
        forest = simhash._Forest(len(values))
        for piece in range(slices):
            order = chance.permutation(len(values))
            turn = (values[order] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            asks = np.flatnonzero(turn % np.uint64(slices) == piece)
            roots = simhash.near_links(values[order], np.arange(len(values)), asks, 4)
            forest.link(order, order[roots])
        assert np.array_equal(forest.find(np.arange(len(values))), brute_roots(values, 4)), seed


@pytest.mark.parametrize("slices", [2, 4])
def test_sliced_shards_find_every_group(spark, slices):
    for seed in range(1):
        values = np.sort(dense_prints(np.random.default_rng(seed)).view(np.int64)).view(np.uint64)
        shuffled = np.random.default_rng(seed + 50).permutation(values)
        table = spark.createDataFrame([(int(v),) for v in shuffled.view(np.int64)], "fp long").repartition(3)
        found = {r.node: r.root for r in simhash.components(simhash.near_edges(table, 4, slices)).collect()}
        signed = values.view(np.int64)
        want = {int(v): int(signed[root]) for v, root in zip(signed, brute_roots(values, 4)) if signed[root] != v}
        assert {v: root for v, root in found.items() if v != root} == want


@pytest.mark.parametrize("broken", [
    '<svg viewBox="0 0 1 1"/>', '<svg viewBox="0 0 1 1"><path d="M0 0">', "<math/>", "<math>", '<object data="x.pdf">', "<noscript>", "<select>",
    "<select><option>", "<option>", "<datalist>", "<template>", "<svg><title/></svg>", '<p class=x">', "<p class=x'>", '<a href=u="v>'])
def test_broken_mark_up_keeps_the_text_after_it(broken):
    rest = '<p>Two "quoted" words, it\'s said.</p>'
    later = "<svg><g></g></svg><math></math><object></object><noscript></noscript><select><option></option></select><datalist></datalist>"
    for more in ("", later):
        found = html_text.blocks_of(f'<article><p>One.</p>{broken}{rest}{more}<p class="y">Three.</p></article>')
        assert [b.text for b in found if b.text] == ["One.", 'Two "quoted" words, it\'s said.', "Three."]
        assert html_text.marked_labels(found) == [1, 1, 1]


def test_text_of_formulas_and_noscript_stays_and_that_of_graphics_is_side_matter():
    page = ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p><noscript><p>Shown without scripts.</p></noscript>"
            "<object><p>Instead.</p></object><svg><title>t</title><text>label</text></svg><select><option>A<option>B</select>"
            "<script>if (a < b) '<p>no</p>'</script><textarea><p>typed</p></textarea><p>End.</p></article>")
    found = html_text.blocks_of(page)
    labels = html_text.marked_labels(found)
    assert [b.text for b, y in zip(found, labels) if y] == ["Let x=1 hold.", "Shown without scripts.", "Instead.", "End."]
    assert [b.text for b, y in zip(found, labels) if not y] == ["label", "A", "B"]


def test_a_name_has_one_surrogate_however_it_is_written(spark):
    rows = [
        (1, "Dr Anna Smith came. Anna Smith said that Smith's dog and ANNA left, annals aside; mail a@b.de."),
        (2, "Mrs Anna Smith. Mrs. Anna. Mr Smith’s son, (Smith)."), (3, "Anna Smith is named without a title."),
        (4, "Dr Anna Smith's cat."), (5, "Ms Anna Иванов und Frau Иванов, Иванов.")]
    made = {r.doc_id: r for r in pii.replaced(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    first, last = re.match(r"Dr (\w+) (\w+) came", made[1].text).groups()
    assert first not in ("Anna", "Smith") and last not in ("Anna", "Smith") and first.endswith(pii._ENDINGS["latin", "f"])
    mail = made[1].text.split("mail ")[1]
    assert made[1].text == (f"Dr {first} {last} came. {first} {last} said that {last}'s dog and {first.upper()} left, annals aside; mail {mail}")
    assert mail != "a@b.de." and made[1].n_entities == 6
    assert made[2].text == f"Mrs {first} {last}. Mrs. {first}. Mr {last}’s son, ({last})." and made[2].n_entities == 4
    assert made[3].text == rows[2][1] and made[3].n_entities == 0
    assert made[4].text == f"Dr {first} {last}'s cat."
    other = made[5].text.split()[2]
    assert made[5].text == f"Ms {first} {other} und Frau {other}, {other}." and other != "Иванов"


def test_one_block_of_the_benchmark_is_held_at_a_time(spark, monkeypatch):
    order, finder, saved = [], decontaminate._finder, decontaminate.saved
    monkeypatch.setattr(decontaminate, "_finder", lambda *a: order.append("index") or finder(*a))
    monkeypatch.setattr(decontaminate, "saved", lambda df, purpose: order.append("saved") or saved(df, purpose))
    items = [(i, f"one two three four five six item{i}") for i in range(12)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + items[3][1] + " y"), (2, "none"), (3, items[7][1])], "doc_id long, text string")
    found = decontaminate.with_items(docs, benchmark, "found", block_chars=150, min_share=decontaminate.Fraction(1))
    assert order == ["index", "saved"] * (len(order) // 2) and len(order) > 2
    assert {r.doc_id: [x.item_id for x in r.found] for r in found.collect()} == {1: [3], 2: [], 3: [7]}


def test_the_search_ends_when_nothing_improves():
    # every piece alone: more exchanges than a fixed number would allow
    count = 26_800
    found = packing.local_search([[i] for i in range(count)], np.ones(count, dtype=np.int64), 4)
    assert len(found) == count // 4 and sorted(i for b in found for i in b) == list(range(count))


@pytest.mark.parametrize("text", [
    " " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "\t" * 1_000_000 + " x", "x" + " " * 5_000_000 + "\n\n y" + "　" * 200_000 + "\x1c" * 100_000 + "z",
    "\r\n" * 100_000 + "'s" + "\xa0" * 70_000], ids=["blanks", "line ends", "tabs", "five million", "mixed"])
def test_long_runs_of_white_space_have_the_ids_of_the_library(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.array_equal(packing._Encoder(path)(text), np.array(want, dtype="<u4"))


@pytest.mark.parametrize("run", [2, 3, 5])
def test_runs_are_cut_where_the_pattern_cuts(monkeypatch, run):
    monkeypatch.setattr(packing, "LONG_RUN", run)
    monkeypatch.setattr(packing, "_LONG_RUN", re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % run))
    encode = packing._Encoder(packing.default_tokenizer())
    chance = np.random.default_rng(run)
    for _ in range(300):
        text = "".join(chance.choice(list(" \n\t\xa0 \x1cab1é'!"), size=chance.integers(1, 40), p=[.2, .15, .1, .05, .05, .05, .1, .1, .05, .05, .05, .05]))
        assert encode(text).tolist() == encode.fast.encode_ordinary(text), repr(text)


def test_a_white_page_is_packed(spark):
    from test_llm_texts import check_packing

    rows = [(1, " " * 1_000_000), (2, "words " * 50)]
    check_packing(packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect(), dict(rows))


def test_shingles_that_share_a_hash_are_told_apart(monkeypatch):
    # eight hashes for everything: only the words decide
    monkeypatch.setattr(decontaminate, "_mixed", lambda columns: (sum(c.astype(np.int64) * 31 for c in columns) % 8).astype(np.uint64))
    chance = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    for _ in range(20):
        items = [(i, " ".join(chance.choice(words, size=chance.integers(1, 14)))) for i in range(8)]
        text = " ".join([*chance.choice(words, size=30), items[0][1], "unknown", items[1][1].upper()])
        have = text.lower().split()
        want = []
        for item, own in items:
            split = own.split()
            width = min(5, len(split))
            mine = {tuple(split[i:i + width]) for i in range(len(split) - width + 1)}
            theirs = {tuple(have[i:i + width]) for i in range(len(have) - width + 1)}
            if len(mine & theirs) * 5 >= len(mine) * 4:
                want.append((item, len(mine & theirs) / len(mine)))
        assert decontaminate.ItemIndex(items, 5, decontaminate.Fraction(4, 5)).found(text) == want


def test_labels_are_written_to_files_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(quality, "LABEL_FILES", 2)
    monkeypatch.setattr(quality, "ROWS_OF_A_FILE", 10)
    docs = spark.createDataFrame([(i, "word " * (i % 7 + 1)) for i in range(90)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 7 > 3) AS quality")
    held = quality._labelled(quality.with_statistics(docs, "doc_id"), labels)
    assert len(held.inputFiles()) == 9
