"""Token counts, packing, chats and pages: round trips, the tokenizers themselves, brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from gridloom.llm import chat, html_text, packing, token_counts

LONG = "verylong" * 20_000
TEXTS = ["", None, "the cat", "  two  blanks ", "line\nbreak\n\n x", "日本語 テスト 🙂🙂", " ", "a\tb\rc", "aaaa" * 50, "Éa çb ñc", "<|endoftext|> and </s>", "x" * 7000,
         "the cat", "word " * 9000, LONG]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(texts)], "doc_id long, text string, length int, piece string")


# -- token counts ------------------------------------------------------------------------------------

def best_count(counter, text):
    """Viterbi over the whole text, without cutting it: the score, and the tokens of the longest last pieces."""
    whole = counter.model.normalize(text or "")
    best, count = [0.0], [0]
    for end in range(1, len(whole) + 1):
        options = [(best[s] + counter.pieces[whole[s:end]], -s, count[s] + 1)
                   for s in range(max(0, end - counter.longest), end) if whole[s:end] in counter.pieces]
        if whole[end - 1] not in counter.pieces:
            options.append((best[end - 1] + counter.unknown, 1 - end, count[end - 1] + len(whole[end - 1].encode())))
        top = max(options)
        best.append(top[0])
        count.append(top[2])
    return best[-1], count[-1]


def test_token_counts(spark):
    counter = token_counts.UnigramCounter(token_counts.default_tokenizer())
    found = {r.doc_id: (r.n_tokens, r.n_pretokens) for r in token_counts.token_counts(docs(spark)).collect()}
    assert len(found) == len(TEXTS) and found[0] == found[1] == (0, 0)
    assert {i: n for i, (n, _) in found.items()} == {i: best_count(counter, t)[1] for i, t in enumerate(TEXTS)}


def test_token_counts_of_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    counter = token_counts.UnigramCounter(token_counts.default_tokenizer())
    found = {r.doc_id: r.n_tokens for r in token_counts.token_counts(rows).collect()}
    assert found == {r.doc_id: best_count(counter, r.text)[1] for r in rows.collect()}


def test_trie_agrees_with_lone_words_and_library():
    path = token_counts.default_tokenizer()
    chance, counter = random.Random(4), token_counts.UnigramCounter(path)
    words = {"▁" + "".join(chance.choice("theandirongé") for _ in range(chance.randint(1, 30))) for _ in range(500)}
    counter.learn(words)
    assert {w: counter.stored[w] for w in words} == {w: counter.alone(w) for w in words}
    # the library's own lattice, with the same pieces and scores read as a unigram model
    import sentencepiece

    raw = open(path, "rb").read()
    unigram = sentencepiece.SentencePieceProcessor(model_proto=_as_unigram(raw))
    for word in sorted(words)[:120]:
        pieces = unigram.nbest_encode_as_pieces(word[1:], 1)[0]
        if all(p in counter.pieces for p in pieces):
            assert sum(counter.pieces[p] for p in pieces) == best_count(counter, word[1:])[0]


def _as_unigram(raw: bytes) -> bytes:
    """The model file with its trainer's model type (field 2, then 3) set to unigram (1)."""
    def number(at):
        value = shift = 0
        while True:
            byte = raw[at]
            value |= (byte & 127) << shift
            shift, at = shift + 7, at + 1
            if byte < 128:
                return value, at

    def varint(value):
        out = b""
        while value > 127:
            out += bytes([value & 127 | 128])
            value >>= 7
        return out + bytes([value])

    out, at = b"", 0
    while at < len(raw):
        tag, at = number(at)
        size, at = number(at)
        body, at = raw[at:at + size], at + size
        if tag >> 3 == 2:
            body += bytes([3 << 3, 1])
        out += varint(tag) + varint(len(body)) + body
    return out


def test_stored_counts_are_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "STORED", 3)
    monkeypatch.setattr(token_counts, "TRIE_CHARS", 20)
    counter = token_counts.UnigramCounter(token_counts.default_tokenizer())
    fresh = token_counts.UnigramCounter(token_counts.default_tokenizer())
    for text in ["one two three four five six", "seven eight nine", "one ten"]:
        assert counter.counts([text])[0][0] == best_count(fresh, text)[1]


# -- packing -----------------------------------------------------------------------------------------

def check_packing(rows, texts, capacity=1024):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == capacity for r in pieces[1:]) and len(pieces) == -(-len(ids) // capacity)
        at = 0
        for r in pieces:
            part = np.array(ids[at:at + r.length], dtype="<u4")
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in rows)


def test_packing_round_trip(spark):
    texts = dict(enumerate(TEXTS[:-1]))
    check_packing(packing.pack(docs(spark, TEXTS[:-1])).collect(), texts)


def test_packing_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 100)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sequences, tokens = check_packing(packing.pack(rows).collect(), {r.doc_id: r.text for r in rows.collect()})
    assert sequences <= -(-tokens // 1024) * 1.01 + 1


def test_packing_repeated_null_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    found = packing.pack(rows).collect()
    assert sorted((str(r.doc_id), r.piece, r.length) for r in found) == [("1", 0, 3), ("1", 0, 3), ("None", 0, 1), ("None", 0, 2)]
    assert len({r.sequence_id for r in found}) == 1 and sorted(r.offset for r in found)[0] == 0
    assert packing.pack(rows.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_local_search_packs_all_and_never_worse(seed):
    chance = np.random.default_rng(seed)
    sizes = chance.integers(1, 60, size=200)
    first = packing.best_fit(sizes, 100)
    better = packing.local_search(first, sizes, 100)
    for bins in (first, better):
        assert sorted(i for b in bins for i in b) == list(range(200)) and max(sizes[b].sum() for b in bins) <= 100
    assert len(better) <= len(first)
    assert sum(sizes[b].sum() ** 2 for b in better) >= sum(sizes[b].sum() ** 2 for b in first)


def test_local_search_empties_bins():
    sizes = np.array([6, 6, 4, 4, 3, 3, 2, 2])
    # one for none; one for one and two for one are needed where each bin has some room
    assert len(packing.local_search([[0], [1], [2], [3], [4], [5], [6], [7]], sizes, 10)) == 3
    sizes = np.array([7, 2, 3, 5, 3])
    assert len(packing.local_search([[0, 1], [2, 3], [4]], sizes, 10)) == 2


# -- chats -------------------------------------------------------------------------------------------

HARD = ["<|im_end|>", "<\\|im_start|>", "<\\\\|x", "<|", "<", "|", "<<|", "a<|im_end|>\n<|im_start|>assistant\nb", "\n", "", None, "<|nl|>", "é🙂", "$1 \\$1 \\\\"]


def test_chat_round_trip(spark):
    rows = [(i, t, role, text) for i, text in enumerate(HARD) for t, role in enumerate(["user", "assistant", "us\ner<|", None])]
    rows += [(50, 2, "assistant", "late"), (50, None, "assistant", "first"), (50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, 1, "assistant", "a"),
             (None, 1, "assistant", "no id"), (None, 0, "user", "x"), (51, 0, "assistant", "w " * 60_000)]
    table = spark.createDataFrame([(*r, "x", 4) for r in rows], "conv_id long, turn long, role string, text string, id string, depth int")
    found = {r.conv_id: r for r in chat.formatted_digests(table).collect()}
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    assert set(found) == set(by_conv)
    for conv, turns in by_conv.items():
        turns = sorted(turns)
        spoken = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        masked = "".join(text for *_, role, text in turns if role == "assistant")
        r = found[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(masked))
        assert r.turns_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(masked.encode()).hexdigest()
    assert chat.formatted_digests(table.limit(0)).collect() == []


def plain_paths(messages, per_tree):
    by_id = {m[0]: m for m in messages}
    parents = {m[1] for m in messages if m[1] in by_id}
    trees = collections.defaultdict(list)
    for leaf in by_id:
        path, at = [], leaf
        while at in by_id and at not in path:
            path.append(at)
            at = by_id[at][1]
        if leaf not in parents and at not in path:
            trees[path[-1]].append((-sum(by_id[i][2] or 0.0 for i in path) / len(path), leaf, path[::-1]))
    return {leaf: path for found in trees.values() for _, leaf, path in sorted(found)[:per_tree]}


@pytest.mark.parametrize("per_tree", [1, 3])
def test_reply_trees(spark, per_tree):
    chance = random.Random(per_tree)
    messages = [(f"m{i}", f"m{chance.randrange(i)}" if i % 9 else (None if i % 2 else f"gone{i}"), chance.choice([None, 0.0, 0.5, 1.0])) for i in range(150)]
    messages += [(f"c{i}", f"c{i - 1}" if i else None, 0.25) for i in range(40)]  # a long chain
    messages += [("x", "y", 1.0), ("y", "x", 1.0), ("z", "x", 1.0)]  # a cycle, and an answer to it
    table = spark.createDataFrame(messages, "id string, parent string, score double")
    found = collections.defaultdict(dict)
    for r in chat.chosen_paths(table, per_tree).collect():
        found[r.leaf][r.depth] = r.id
    want = plain_paths(messages, per_tree)
    assert {leaf: [path[d] for d in sorted(path)] for leaf, path in found.items()} == want


# -- pages -------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.1/pages.parquet")


@pytest.fixture(scope="module")
def field(pages):
    return html_text.fit(pages)


PAGE = """<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<div id="header"><h2>My Site</h2><ul class="main-menu"><li><a href=1>Home</a><li><a>News</a></ul></div>
<div class="cookie-consent">We use cookies here. <button>OK</button></div><!-- <p>no</p> -->
<div id="content"><h1>Title of it</h1><p>First &eacute; &lt;b&gt; with <b>bold</b>,<a href=x>link</a>, and more of it.<p>Second   para
 broken over&nbsp;lines &#x41;&#66;.<blockquote>Quoted words are here, in a whole sentence.</blockquote>
<div class="advert">Buy now, this is the best of all.</div><p>Last para of the text, which ends here.</p>
<form><label>Name</label><input><textarea>no</textarea></form></div>
<aside><p>Related: a long text that is prose and ends with a stop.</p></aside>
<div class="comments"><h3>Comments</h3><p>I liked this article very much, thanks to the author of it.</p></div>
<div id="footer">&copy; 2020 All rights reserved</div></body></html>"""
MAIN = """Title of it
First é <b> with bold,link, and more of it.
Second para broken over lines AB.
Quoted words are here, in a whole sentence.
Last para of the text, which ends here."""


def test_page_without_marks(field):
    assert html_text.extract(PAGE, field) == MAIN
    assert html_text.extract(PAGE.replace('<div id="content">', "<main>").replace("</form></div>", "</form></main>"), field) == MAIN


def test_marked_pages_are_whole(spark, pages, field):
    found = {(r.page_id, r.url): r for r in html_text.main_texts(pages, field).collect()}
    assert len(found) == pages.count()
    wrong = 0
    for r in pages.collect():
        blocks = html_text.blocks_of(r.html or "")
        labels = html_text.marked_labels(blocks) or []
        want = "\n".join(b.text for b, y in zip(blocks, labels) if y)
        got = found[r.page_id, r.url]
        wrong += got.text != want
        assert got.n_chars == len(got.text)
    assert wrong <= len(found) * 0.002


def test_other_layouts_held_out(pages, field):
    rest = [r.html for r in pages.orderBy("page_id", ascending=False).limit(150).collect()]
    other = html_text.labelled_pages(rest, layouts=3, seed=77)
    right = sum(field.labels(b) == y for b, y in other)
    assert right / len(other) > 0.97


@pytest.mark.parametrize("broken", ["", "<", "</", "<p", "<p>a<", "<!--", "<script>x", "<p title='", "&", "&amp", "plain", "<a><b></i></a>", "</p></div>x", "<p>a</section>b"])
def test_broken_pages_are_read(field, broken):
    assert isinstance(html_text.extract(broken, field), str)


def test_page_edge_rows(spark, field):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "u", PAGE), (3, "u", "<main><p>" + "A word in a sentence. " * 20_000 + "</main>")]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = sorted((str(r.page_id), r.n_chars) for r in html_text.main_texts(table, field).collect())
    assert found == [("1", 0), ("1", 0), ("2", 0), ("3", len("A word in a sentence. ") * 20_000 - 1), ("None", len(MAIN))]
    assert html_text.main_texts(table.limit(0)).collect() == []


def test_field_gradient_and_viterbi():
    chance = random.Random(2)
    pages = []
    for _ in range(60):
        labels = [chance.random() < 0.5 for _ in range(chance.randint(1, 6))]
        pages.append(([html_text.Block("w " * (40 if y else 2) + ("stop." if y else "x"), html_text.Element("div", (), False, None, 0, None), 0) for y in labels], [int(y) for y in labels]))
    field = html_text.train(pages)
    assert all(field.labels(b) == y for b, y in pages)
    # Viterbi against all labellings
    import itertools

    for blocks, _ in pages[:20]:
        own = [sum(field.weights.get(f, 0.0) for f in fs) for fs in html_text.features(blocks)]

        def score(y):
            return field.start[y[0]] + sum(own[i] * l for i, l in enumerate(y)) + sum(field.pairs[a][b] for a, b in zip(y, y[1:]))

        best = max(itertools.product((0, 1), repeat=len(blocks)), key=score)
        assert score(tuple(field.labels(blocks))) == pytest.approx(score(best))
