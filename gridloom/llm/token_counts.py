"""Token counts under a unigram model, with forward scores shared along a trie.

The model is the piece list of a public tokenizer file: every piece has a score, a text's
segmentation is the one with the largest sum of scores, and its length is the text's token count. No
piece reaches over the start of a run of blanks, so a text falls apart into pre-tokens whose
segmentations are independent. The distinct pre-tokens of a batch are inserted in a trie; a walk over
it computes the best score and its token count once for every prefix, however many pre-tokens share
it, and the count at a terminal node is the pre-token's. Texts then add up stored counts.

Counting needs no shuffle: rows stay where they are, and only counts leave a task. Trie and stored
counts are bounded by parameters, beyond which they are started anew, not cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import whole_text

BLANK = "▁"
TRIE_CHARS = 250_000
"""Characters that are inserted in one trie at most; longer pre-tokens are scored on their own."""
STORED = 500_000
"""Pre-tokens whose counts a task remembers."""
UNKNOWN_PENALTY = 10.0


def default_tokenizer() -> str:
    """Where this installation has the public piece list."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class UnigramCounter:
    """Counts tokens of texts; pieces and scores come from a sentencepiece file.

    Ties between segmentations go to the longer last piece. A character that no piece covers costs the
    lowest score less ``UNKNOWN_PENALTY`` and counts as its UTF-8 bytes if the model has byte pieces,
    else as one token.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(self.model.vocab_size()) if not (
            self.model.is_unknown(i) or self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.pieces = {self.model.id_to_piece(i): self.model.get_score(i) for i in normal}
        self.unknown = min(self.pieces.values()) - UNKNOWN_PENALTY
        self.bytes = any(self.model.is_byte(i) for i in range(self.model.vocab_size()))
        self.longest = max(map(len, self.pieces))
        # every tail of a piece, with the score of those that are pieces: other tails end a search
        self.tails: dict[str, float | None] = {p[i:]: None for p in self.pieces for i in range(len(p))}
        self.tails.update(self.pieces)
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("A piece holds a blank after another character; its texts cannot be cut at blanks.")
        alone = "".join(c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in self.pieces))
        # a run of blanks belongs to what follows; line ends that are in no longer piece stand alone
        self.cut = re.compile(f"[{alone}]|{BLANK}*[^{BLANK}{alone}]+|{BLANK}+" if alone else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.stored: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        return self.cut.findall(self.model.normalize(text))

    def _step(self, window: str, best: list[float], count: list[int], depth: int) -> tuple[float, int]:
        """Best score and its count for the prefix of ``depth`` characters that ends with ``window``."""
        top, tokens, tails = None, 0, self.tails
        for length in range(1, min(len(window), depth) + 1):
            tail = window[-length:]
            if tail not in tails:
                break
            score = tails[tail]
            if score is not None:
                score += best[depth - length]
                if top is None or score >= top:
                    top, tokens = score, count[depth - length] + 1
        if top is None or window[-1] not in self.pieces:
            score = best[depth - 1] + self.unknown
            if top is None or score > top:
                top, tokens = score, count[depth - 1] + (len(window[-1].encode("utf-8", "surrogatepass")) if self.bytes else 1)
        return top, tokens

    def alone(self, pretoken: str) -> int:
        """The count of one pre-token, without a trie."""
        best, count = [0.0], [0]
        for depth in range(1, len(pretoken) + 1):
            top, tokens = self._step(pretoken[max(0, depth - self.longest):depth], best, count, depth)
            best.append(top)
            count.append(tokens)
        return count[-1]

    def _walk(self, chunk: list[str]) -> None:
        """Stores the counts of ``chunk`` from one walk over its trie."""
        trie: dict = {}
        for pretoken in chunk:
            node = trie
            for char in pretoken:
                node = node.setdefault(char, {})
            node[""] = pretoken
        deepest = max(map(len, chunk))
        best, count = [0.0] * (deepest + 1), [0] * (deepest + 1)
        # the last characters before a node are enough to find the pieces that end there
        stack = [(trie, "", 0)]
        while stack:
            node, window, depth = stack.pop()
            if depth:
                best[depth], count[depth] = self._step(window, best, count, depth)
            for char, child in node.items():
                if char:
                    stack.append((child, (window + char)[-self.longest:], depth + 1))
                else:
                    self.stored[child] = count[depth]

    def learn(self, pretokens: Iterable[str]) -> None:
        """Counts all pre-tokens that are not stored yet, in tries of bounded size."""
        chunk, chars = [], 0
        for pretoken in sorted(pretokens):
            if len(pretoken) > TRIE_CHARS // 8:
                self.stored[pretoken] = self.alone(pretoken)
                continue
            if chars + len(pretoken) > TRIE_CHARS:
                self._walk(chunk)
                chunk, chars = [], 0
            chunk.append(pretoken)
            chars += len(pretoken)
        if chunk:
            self._walk(chunk)

    def counts(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of every text."""
        if len(self.stored) > STORED:
            self.stored.clear()
        cut = [self.pretokens(text) for text in texts]
        self.learn(set().union(*map(set, cut)) - self.stored.keys())
        return [(sum(map(self.stored.__getitem__, c)), len(c)) for c in cut]


def token_counts(docs: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """A row per document: doc_id, n_tokens, n_pretokens.

    Whole texts count; null and empty ones have no tokens. Repeated rows are each counted, a null doc_id
    stays null, other columns are ignored, no rows give no rows.
    """
    path = tokenizer or default_tokenizer()
    wanted = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), whole_text(text_column).alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(path)
        for part in parts:
            for at in range(0, part.num_rows, 512):
                some = part.slice(at, 512)
                found = counter.counts(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())],
                    names=["doc_id", "n_tokens", "n_pretokens"])

    return wanted.mapInArrow(batches, "doc_id bigint, n_tokens bigint, n_pretokens bigint")
