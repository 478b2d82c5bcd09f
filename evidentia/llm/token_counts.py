"""Token counts by trie-shared dynamic programming.

A unigram tokenizer cuts a pre-token into the pieces whose log probabilities
sum highest. The best cut of a prefix doesn't depend on what follows it, so the
distinct pre-tokens are put in a trie, the forward score of each prefix is found
once for all pre-tokens that share it, and the node where a pre-token ends holds
its token count. A document's count is the sum over its pre-tokens.

The trie of a block of texts is laid out level by level: of the sorted pre-tokens,
neighbours that agree so far share a node, and all nodes of a level are scored at
once. Only the levels that a piece can reach back to are held.

Every task counts by itself, so nothing is shuffled and a lost task is simply run
again. A task keeps the counts of at most MEMO_BYTES of pre-tokens from block to block,
then starts afresh, which changes no count.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from evidentia.llm.common import _U, mix64, powers, renamed, table
from evidentia.llm.tokenizer import small_batches

#: Bytes (about) of the counts that a task keeps; characters of text to a block.
MEMO_BYTES, BLOCK_CHARS = 48 << 20, 4 << 20
#: Levels of the trie; the rare longer pre-token is scored by itself, character by character.
LEVELS = 48
#: Pre-tokens laid out at a time.
AT_ONCE = 1 << 16
SPACE = "▁"


def zipf_pieces(model: str = "piece_bpe_32k.model") -> dict[str, float]:
    """Pieces of a public vocabulary with log probabilities by their rank (Zipf's law)."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    pieces = [
        sp.id_to_piece(i)
        for i in range(sp.get_piece_size())
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
    ]
    total = math.log(sum(1 / (r + 2.7) for r in range(len(pieces))))
    return {p: -math.log(r + 2.7) - total for r, p in enumerate(pieces)}


class CountTrie:
    """Token counts of pre-tokens, from the best score of each prefix of those put in together.

    A character that is no piece costs one token for each byte in UTF-8. Of equal
    scores the cut with fewer tokens is taken.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - 10.0
        self.hashes, self.scores = [np.zeros(0, _U)] * (self.longest + 1), [np.zeros(0)] * (self.longest + 1)
        self.bits = [np.zeros(0, bool)] * (self.longest + 1)
        for size in range(1, self.longest + 1):
            own = [p for p in pieces if len(p) == size]
            if own:
                h = self._hashes("".join(own), np.arange(0, size * len(own), size), size)
                order = np.argsort(h, kind="stable")
                self.hashes[size], self.scores[size] = h[order], np.array([pieces[p] for p in own])[order]
                self.bits[size] = np.zeros(1 << max(12, (8 * len(own)).bit_length()), bool)
                self.bits[size][(h & _U(len(self.bits[size]) - 1)).astype(np.int64)] = True
        self.clear()

    def clear(self) -> None:
        self.count: dict[str, int] = {}
        self.held = 0

    @staticmethod
    def _sums(text: str) -> tuple[np.ndarray, np.ndarray]:
        """(sums from which the hash of any part follows, characters)."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        up, _ = powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, _U)
        np.cumsum(mix64(points.astype(_U) + _U(0x51ED270B)) * up[: len(points)], out=sums[1:])
        return sums, points

    def _hashes(self, text: str, starts: np.ndarray, size: int) -> np.ndarray:
        sums, _ = self._sums(text)
        return (sums[starts + size] - sums[starts]) * powers(len(sums))[1][starts]

    def _piece(self, sums: np.ndarray, down: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the starts where a piece of `size` characters stands."""
        if not len(self.bits[size]):
            return np.zeros(0, np.int64), np.zeros(0)
        h = (sums[start + size] - sums[start]) * down[start]
        at = np.flatnonzero(self.bits[size][(h & _U(len(self.bits[size]) - 1)).astype(np.int64)])
        i = np.searchsorted(self.hashes[size], h[at])
        i[i == len(self.hashes[size])] = 0
        right = self.hashes[size][i] == h[at]
        return at[right], self.scores[size][i[right]]

    def level_counts(self, words: list[str]) -> np.ndarray:
        """The token counts of sorted distinct pre-tokens, by the levels of their trie."""
        sums, points = self._sums("".join(words))
        down = powers(len(sums))[1]
        length = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(length) - length
        found = np.zeros(len(words), np.int64)
        row = np.arange(len(words))
        node = np.zeros(len(words), np.int64)  # of the level before, for each word
        levels: deque = deque([(np.zeros(1), np.zeros(1, np.int64), None)], maxlen=self.longest)  # score, tokens, parent
        depth = 0
        while len(row):
            depth += 1
            alive = length[row] >= depth
            row, node = row[alive], node[alive]
            if not len(row):
                break
            ch = points[begin[row] + depth - 1]
            new = np.ones(len(row), bool)
            new[1:] = (node[1:] != node[:-1]) | (ch[1:] != ch[:-1])
            first = np.flatnonzero(new)
            parent, end, own = node[first], begin[row[first]] + depth, ch[first]
            node = np.cumsum(new) - 1
            before, few, _ = levels[-1]
            score = before[parent] + self.unknown
            tokens = few[parent] + 1 + (own >= 0x80) + (own >= 0x800) + (own >= 0x10000)
            at, p = self._piece(sums, down, end - 1, 1)
            score[at], tokens[at] = before[parent[at]] + p, few[parent[at]] + 1
            up = parent
            for size in range(2, min(self.longest, depth) + 1):
                up = levels[1 - size][2][up]
                at, p = self._piece(sums, down, end - size, size)
                if len(at):
                    s, t = levels[-size][0][up[at]] + p, levels[-size][1][up[at]] + 1
                    better = (s > score[at]) | ((s == score[at]) & (t < tokens[at]))
                    score[at[better]], tokens[at[better]] = s[better], t[better]
            levels.append((score, tokens, parent))
            ended = length[row] == depth
            found[row[ended]] = tokens[node[ended]]
        return found

    def long_count(self, word: str) -> int:
        """The token count of one pre-token of any length, holding only the scores that pieces reach back to."""
        score, tokens = deque([0.0], maxlen=self.longest), deque([0], maxlen=self.longest)
        for end, ch in enumerate(word, 1):
            p = self.pieces.get(ch)
            if p is None:
                best, few = score[-1] + self.unknown, tokens[-1] + len(ch.encode("utf-8", "surrogatepass"))
            else:
                best, few = score[-1] + p, tokens[-1] + 1
            for size in range(2, min(self.longest, end) + 1):
                p = self.pieces.get(word[end - size : end])
                if p is not None:
                    s = score[-size] + p
                    if s > best or (s == best and tokens[-size] + 1 < few):
                        best, few = s, tokens[-size] + 1
            score.append(best)
            tokens.append(few)
        return tokens[-1]

    def put(self, words: set[str]) -> None:
        """Has the counts of these pre-tokens known."""
        new = sorted(words - self.count.keys())
        size = sum(map(len, new)) + 120 * len(new)
        if self.held and self.held + size > MEMO_BYTES:
            self.clear()
            new = sorted(words)
            size = sum(map(len, new)) + 120 * len(new)
        self.held += size
        short = [w for w in new if len(w) <= LEVELS]
        for i in range(0, len(short), AT_ONCE):
            part = short[i : i + AT_ONCE]
            self.count.update(zip(part, self.level_counts([SPACE + w for w in part]).tolist(), strict=True))
        for w in new:
            if len(w) > LEVELS:
                self.count[w] = self.long_count(SPACE + w)

    def terminal(self, word: str) -> int:
        """The token count of a pre-token with its leading mark."""
        return int(self.level_counts([word])[0]) if len(word) <= LEVELS + 1 else self.long_count(word)


SCHEMA = "doc_id long, n_pretokens long, n_tokens long, n_types long"


def token_counts(docs: DataFrame, pieces: dict[str, float] | None = None) -> DataFrame:
    """Pre-tokens, tokens and distinct pre-tokens of each document, one row for each row.

    Pre-tokens are runs of characters that aren't white space, each with a leading
    mark for the space before it. A null or blank text has none, and counts of 0. A
    pre-token of any length is counted whole. Repeated rows are counted each; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    pieces = zipf_pieces() if pieces is None else pieces
    held = docs.sparkSession.sparkContext.broadcast(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = CountTrie(held.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in small_batches(texts, BLOCK_CHARS):
                words = [t.split() for t in texts[i:j]]
                kinds = [set(w) for w in words]
                trie.put(set().union(*kinds))
                known = trie.count.__getitem__
                cols = [map(len, words), (sum(map(known, w)) for w in words), map(len, kinds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], *[pa.array(list(c), pa.int64()) for c in cols]],
                    names=["doc_id", "n_pretokens", "n_tokens", "n_types"],
                )

    return renamed(docs, doc_id="doc_id", text="text").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(count, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
