"""Token ids of whole texts, by the tokenizers library, for packing and binary output."""

from __future__ import annotations

import os
import string
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A worker keeps the ids of words up to about so many bytes, then starts afresh; longer
#: words than MEMO_CHARS aren't kept.
MEMO_BYTES, MEMO_CHARS = 64 << 20, 64
#: What a kept word takes beside its characters and ids.
ENTRY_BYTES = 170
#: Lower-case Latin letters that Unicode's normal form C leaves as they are.
LATIN = "[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f]"
#: Any number of these may follow them in a word: the ASCII punctuation, one pre-token there.
MARKS = string.punctuation
MARK = r"[!-/:-@\[-`{-~]"
#: So many words of Latin letters are encoded as one text.
TOGETHER = 512
#: The ids of so many words are laid out at a time: a long text needs no table of its length.
RUNS = 1 << 16
#: Ends the last piece of each pre-token in the vocabulary.
WORD_END = "</w>"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gathered(values: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values between bounds of the given numbers, one after the other, and their bounds."""
    first, size = bounds[which], np.diff(bounds)[which]
    ends = np.zeros(len(which) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    out = np.empty(ends[-1], values.dtype)
    for i in range(0, len(which), RUNS):
        j = min(i + RUNS, len(which))
        at = np.repeat(first[i:j] - ends[i:j], size[i:j])
        at += np.arange(ends[i], ends[j])
        out[ends[i] : ends[j]] = values[at]
    return out, ends


class Encoder:
    """Ids as unsigned 32-bit numbers.

    The tokenizer drops white space and never merges across it, so the ids of a
    text are those of its words in turn; a word met before isn't encoded again.
    A word of Latin letters and ASCII punctuation after them is encoded as the lower-cased
    letters and the marks, as the tokenizer's own pattern cuts it, so only the two
    are kept. New words of Latin letters are encoded many at a time: each is one pre-token,
    whose last piece the vocabulary marks, so the ids are cut there. If the cuts aren't as
    many as the words (another vocabulary), they are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        pieces = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(pieces.values()) + 1, bool)
        self.ends[[i for p, i in pieces.items() if p.endswith(WORD_END) and p != WORD_END]] = True
        self._start_afresh()

    def _start_afresh(self) -> None:
        """No words kept. memo numbers them; word k has ids[bounds[k] : bounds[k + 1]]."""
        self.memo: dict[str, int] = {}
        self.ids, self.bounds, self.held = np.zeros(0, "<u4"), np.zeros(1, np.int64), 0

    def _encode(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Runs of ids, and how many of them each word has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return [np.fromiter(chain.from_iterable(found), "<u4", int(size.sum()))], [size]

    def _encode_latin(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        runs, sizes = [], []
        for i in range(0, len(words), TOGETHER):
            some = words[i : i + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                runs.append(ids)
                sizes.append(np.diff(cuts, prepend=0))
            else:
                for found, new in zip((runs, sizes), self._encode(some), strict=True):
                    found += new
        return runs, sizes

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and bounds of kept and new words, and the number of each of the given distinct words in them."""
        names = words.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.memo.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(number < 0)
        if not len(missing):
            return self.ids, self.bounds, number
        alike = pc.match_substring_regex(words.take(pa.array(missing)), f"^{LATIN}+$").to_numpy(zero_copy_only=False)
        missing = np.concatenate([missing[alike], missing[~alike]])
        new, n = list(map(names.__getitem__, missing.tolist())), int(alike.sum())
        runs, sizes = (a + b for a, b in zip(self._encode_latin(new[:n]), self._encode(new[n:]), strict=True))
        ids, bounds = np.concatenate(runs), np.concatenate([[0], *sizes]).cumsum()
        number[missing] = len(self.bounds) - 1 + np.arange(len(new))
        found = np.concatenate([self.ids, ids]), np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]]), number
        self._keep(new, ids, bounds)
        return found

    def _keep(self, words: list[str], ids: np.ndarray, bounds: np.ndarray) -> None:
        chars = np.fromiter(map(len, words), np.int64, len(words))
        size = chars + 4 * np.diff(bounds) + ENTRY_BYTES
        kept = np.flatnonzero(chars <= MEMO_CHARS)
        if self.held + int(size[kept].sum()) > MEMO_BYTES:
            self._start_afresh()
            kept = kept[np.cumsum(size[kept]) <= MEMO_BYTES]
        if len(kept) < len(words):
            words = list(map(words.__getitem__, kept.tolist()))
            ids, bounds = gathered(ids, bounds, kept)
        self.memo.update(zip(words, range(len(self.memo), len(self.memo) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
        self.held += int(size[kept].sum())

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words and their bounds."""
        low = pc.utf8_lower(words)
        # the library lower-cases U+0130 to two characters
        latin = pc.and_not(pc.match_substring_regex(low, f"^{LATIN}+{MARK}*$"), pc.match_substring(words, "\u0130"))
        stem = pc.if_else(latin, pc.utf8_rtrim(low, MARKS), words)
        marked = pc.and_(latin, pc.less(pc.binary_length(stem), pc.binary_length(low)))
        marks = pc.replace_substring_regex(low.filter(marked), f"^{LATIN}+", "")
        keys = pa.concat_arrays([stem, marks]).dictionary_encode()
        ids, bounds, number = self._table(keys.dictionary)
        # a marked word's marks come behind its letters
        parts = number[keys.indices.to_numpy()]
        behind = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        ids, bounds = gathered(ids, bounds, np.insert(parts[: len(words)], behind + 1, parts[len(words) :]))
        at = np.arange(len(words) + 1)
        return ids, bounds[at + np.searchsorted(behind, at)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and their bounds: texts are cut at ASCII
        white space, their words numbered, and the ids of distinct words laid out by those numbers."""
        cut = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        words = cut.flatten().dictionary_encode()
        ids, ends = gathered(*self._known(words.dictionary), words.indices.to_numpy())
        return ids, ends[cut.offsets.to_numpy()]

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes."""
        ids, bounds = self.encode(pa.array(texts, pa.large_string()))
        raw, cuts = ids.tobytes(), (4 * bounds).tolist()
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, kept over its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def small_batches(texts: list[str], limit: int = 4 << 20):
    """(first, after the last) of runs of texts of about limit characters."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j
