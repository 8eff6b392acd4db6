"""Exact token counts with the library that owns the vocabulary.

Texts go through Arrow in batches of about as many bytes each, and only lengths come back. White space
never belongs to a token of a vocabulary that drops it, so a long text may be cut there: it is handled
in pieces, and a word that occurs again is looked up instead of being encoded again. The memory of a
task is one text, one batch and a bounded memo.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import keeps_memo, text_groups

BATCH_BYTES = 1 << 20
#: Most words that a task's memo keeps, and the longest it keeps, in bytes; longer ones are encoded in every batch.
MEMO_WORDS = 800_000
MEMO_WORD_BYTES = 64
#: New words handed to the library in one call, as all that it returns is in memory at once.
ENCODE_WORDS = 5_000
_CUT = re.compile(rb"[\x20\x09-\x0D]")
_encoders: dict[str, object] = {}
#: Libraries that encode whole texts; a vocabulary can be used in both ways.
_libraries: dict[str, object] = {}


def vocabulary(name: str) -> str:
    """A path as given, or the place of a file of the installed vocabularies on this machine."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Index(dict):
    """Number of every known word; a new word gets the next number and is noted."""

    def __init__(self):
        self.next, self.fresh = 0, []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = self.next
        self.next += 1
        self.fresh.append(word)
        return number


class WordEncoder:
    """Token ids of texts for vocabularies to which white space is a boundary: each word is encoded once.

    Known words are numbered, so a batch of texts becomes an array of numbers, and ids and lengths are
    gathered from arrays. When the memo is full, the words used least are forgotten.
    """

    def __init__(self, name: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary(name))
        self.memo_words = memo_words
        self._start_anew([], np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64))
        # a character that is one token, to tell where a word's ids end when many are encoded in one call
        self.mark, self.mark_id = next(
            ((c, ids[0]) for c in "€£©®°→|~" if len(ids := self._raw([c])[0]) == 1), (None, None)
        )

    def _start_anew(self, words: list[bytes], ids: np.ndarray, n: np.ndarray, uses: np.ndarray) -> None:
        self.index = _Index()
        self.index.update(zip(words, range(len(words))))
        self.index.next = len(words)
        self.flat, self.n, self.uses = ids, n, uses
        self.start = np.cumsum(n) - n

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words end to end, and how many each has. Words that contain the mark are encoded alone."""
        mark = self.mark.encode() if self.mark else b""
        joint = [i for i, w in enumerate(words) if mark and mark not in w]
        n, parts, where = np.zeros(len(words), np.int64), [], []
        for lo in range(0, len(joint), ENCODE_WORDS):
            some = joint[lo : lo + ENCODE_WORDS]
            runs = [some[i : i + 500] for i in range(0, len(some), 500)]
            for run, ids in zip(runs, self._raw([(b" " + mark + b" ").join([words[i] for i in r]).decode() for r in runs])):
                ids = np.array(ids, "<u4")
                stops = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
                n[run] = np.diff(stops, prepend=-1) - 1
                parts.append(ids[ids != self.mark_id])
                where += run
        alone = [i for i, w in enumerate(words) if not mark or mark in w]
        for i, ids in zip(alone, self._raw([words[i].decode() for i in alone])):
            n[i] = len(ids)
            parts.append(np.array(ids, "<u4"))
            where.append(i)
        # back to the order of the words
        flat = np.concatenate([np.zeros(0, "<u4"), *parts])
        if alone and joint:
            began = np.zeros(len(words), np.int64)
            began[where] = np.cumsum(n[where]) - n[where]
            flat = flat[np.repeat(began - (np.cumsum(n) - n), n) + np.arange(len(flat))]
        return flat, n

    def _numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, and how many words each text has; new words are encoded."""
        split = [t.split() for t in texts]
        sizes = np.array([len(ws) for ws in split], np.int64)
        numbers = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        fresh, self.index.fresh = self.index.fresh, []
        if fresh:
            flat, n = self._encoded(fresh)
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(n) - n))
            self.flat, self.n = np.concatenate((self.flat, flat)), np.concatenate((self.n, n))
            self.uses = np.concatenate((self.uses, np.zeros(len(n), np.int64)))
            for w in fresh:
                if len(w) > MEMO_WORD_BYTES:
                    del self.index[w]
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        return numbers, sizes

    def _forget(self) -> None:
        """Past the limit, keep the half of the words that were used most; their uses count half from now on."""
        if self.index.next <= self.memo_words:
            return
        words = np.array(list(self.index.values()), np.int64)
        names = list(self.index)
        keep = np.sort(np.argsort(-self.uses[words], kind="stable")[: self.memo_words // 2])
        numbers = words[keep]
        n = self.n[numbers]
        heads = np.cumsum(n) - n
        flat = self.flat[np.repeat(self.start[numbers] - heads, n) + np.arange(int(n.sum()))]
        self._start_anew([names[i] for i in keep.tolist()], flat, n, self.uses[numbers] // 2)

    def counts(self, texts: list[bytes], piece_bytes: int = BATCH_BYTES) -> list[int]:
        """Number of tokens of each text; a long one is taken in pieces."""
        if len(texts) == 1 and len(texts[0]) > piece_bytes:
            return [sum(self.counts([p], len(p))[0] for p in pieces(texts[0], piece_bytes))]
        numbers, sizes = self._numbers(texts)
        ends = np.concatenate(([0], np.cumsum(self.n[numbers])))[np.concatenate(([0], np.cumsum(sizes)))]
        self._forget()
        return np.diff(ends).tolist()

    def ids(self, texts: list[bytes], piece_bytes: int = BATCH_BYTES) -> list[bytes]:
        """Ids of each text as bytes; a long one is taken in pieces."""
        if len(texts) == 1 and len(texts[0]) > piece_bytes:
            return [b"".join(self.ids([p], len(p))[0] for p in pieces(texts[0], piece_bytes))]
        numbers, sizes = self._numbers(texts)
        n = self.n[numbers]
        before = np.concatenate(([0], np.cumsum(n)))
        flat = self.flat[np.repeat(self.start[numbers] - before[:-1], n) + np.arange(int(before[-1]))]
        ends = before[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        self._forget()
        return [flat[lo:hi].tobytes() for lo, hi in zip(ends, ends[1:])]


def encoder(name: str) -> WordEncoder:
    if name not in _encoders:
        keeps_memo(_encoders.clear)
        _encoders[name] = WordEncoder(name)
    return _encoders[name]


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """Cut at the last white space before every ``size`` bytes; a word is never cut."""
    at = 0
    while len(text) - at > size:
        stop = max(text.rfind(s, at, at + size) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if stop <= at:
            found = _CUT.search(text, at + size)
            if not found:
                break
            stop = found.start()
        yield text[at:stop]
        at = stop
    yield text[at:]


def whole_counts(name: str, texts: list[bytes]) -> list[int]:
    """Counts for vocabularies to which white space matters: each text is encoded whole."""
    if name not in _libraries:
        keeps_memo(_libraries.clear)
        if name.endswith(".model"):
            import sentencepiece

            _libraries[name] = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            _libraries[name] = Tokenizer.from_file(vocabulary(name))
    library = _libraries[name]
    decoded = [t.decode() for t in texts]
    if name.endswith(".model"):
        return [len(ids) for ids in library.encode(decoded, num_threads=1)]
    return [len(e.ids) for e in library.encode_batch_fast(decoded, add_special_tokens=False)]


def token_counts(
    docs: DataFrame,
    vocabulary_name: str = "word_bpe_49k.json",
    drops_space: bool = True,
    limit: int = 2048,
    key: str = "doc_id",
    text: str = "text",
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row.

    ``drops_space`` says that white space is a safe boundary of the vocabulary. A null text counts as
    empty; a null key, repeated rows and further columns change nothing; no rows give no rows.
    """
    source = docs.select(F.col(key), F.col(text).cast("binary"))
    out_schema = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_groups(batches, batch_bytes):
            texts = [t or b"" for t in texts]
            if drops_space:
                n = encoder(vocabulary_name).counts(texts)
            else:
                n = whole_counts(vocabulary_name, texts)
            rest = pa.RecordBatch.from_pydict({"n_bytes": [len(t) for t in texts], "n_tokens": n}, schema=out_schema)
            yield pa.RecordBatch.from_arrays([keys, *rest.columns], names=["key", "n_bytes", "n_tokens"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    counted = source.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
