"""Removal of repeated passages by sliding spans of sentences.

A text is cut into sentences: after ``.``, ``!`` or ``?`` and at line ends; where so many words have
no such end, after the word whose hash is least among them, so that long sentences are cut at places
that depend on the words around them alone. From every sentence a span runs over several sentences,
until it has ``SPAN_WORDS`` words: a repeated passage of ``SPAN_WORDS + 4 * LONGEST`` words always
holds a whole span, most shorter ones do. Spans are hashed (96 bits, A-Z
lower-cased) and joined globally; a span's first place is that in the document with the smallest
id. Sentences that lie in a span anywhere else are removed, repeats within a document included.

Defined results: a null text is empty; a text with fewer sentences or words than a span is left as
it is; documents with a null id lose only what repeats within them; rows that share an id lose
nothing to each other, and each has its own spans: a span is known by the id and a tag of its text;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_groups

SPAN_WORDS = 16
SPAN_SENTENCES = 2
#: No more words than this are without the end of a sentence.
LONGEST = 10

#: Texts are worked on in groups of about this many bytes.
GROUP_BYTES = 2 << 20

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_STOP = np.isin(np.arange(256), list(b".!?"))

RESULT = "doc_id long, n_sentences long, n_removed long, n_words long, n_removed_words long, text string"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Ranges:
    """Polynomial hashes of ranges of a sequence, modulo 2**64."""

    def __init__(self, values: np.ndarray, factor: int):
        n = len(values) + 1
        power = np.ones(n, np.uint64)
        inverse = np.ones(n, np.uint64)
        power[1:], inverse[1:] = factor, pow(factor, -1, 1 << 64)
        power, self.inverse = np.cumprod(power), np.cumprod(inverse)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((values + np.uint64(1)) * power[:-1])])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed(((self.sums[end] - self.sums[first]) * self.inverse[first]) ^ (end - first).astype(np.uint64))


class Sentences:
    """Sentences and spans of the texts of a group."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        low = np.frombuffer(raw.tobytes().translate(LOWER), np.uint8)
        blank = _SPACE[raw]
        edge = np.diff(blank.astype(np.int8), prepend=np.int8(1))
        self.word_first, self.word_end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(self.word_end) > len(self.word_first):
            self.word_end = self.word_end[1:]
        size = np.array([len(t) + 1 for t in texts], np.int64)
        self.text_first = np.concatenate([[0], np.cumsum(size)])
        self.text_words = np.searchsorted(self.word_first, self.text_first)  # first word of each text
        word = _Ranges(low.astype(np.uint64), 0x9E3779B97F4A7C15).of(self.word_first, self.word_end)
        n = len(word)
        line = np.cumsum(raw == 10)
        last = _STOP[raw[self.word_end - 1]] if n else np.zeros(0, bool)
        if n:
            last[:-1] |= line[self.word_first[1:]] != line[self.word_first[:-1]]
            last[self.text_words[1:][self.text_words[1:] > 0] - 1] = True  # so no window looks across texts
        if n >= LONGEST:
            rank = np.where(last, np.uint64(0), word | np.uint64(1))
            least, place = rank[:n - LONGEST + 1], np.arange(n - LONGEST + 1, dtype=np.int32)
            for k in range(1, LONGEST):  # the first least rank of every window
                other = rank[k:n - LONGEST + 1 + k]
                place = np.where(other < least, np.arange(k, n - LONGEST + 1 + k, dtype=np.int32), place)
                least = np.minimum(least, other)
            last[place] = True
        self.end = np.flatnonzero(last) + 1  # end word of each sentence
        self.first = np.concatenate([[0], self.end[:-1]]) if len(self.end) else self.end
        self.text_sentences = np.searchsorted(self.first, self.text_words)
        owner = np.repeat(np.arange(len(texts)), np.diff(self.text_sentences))
        at = np.arange(len(self.first))
        stop = np.maximum(at + SPAN_SENTENCES - 1, np.searchsorted(self.end, self.first + SPAN_WORDS))
        whole = stop < self.text_sentences[owner + 1] if len(at) else np.zeros(0, bool)
        #: Spans: first sentence, last sentence, text, and two hashes.
        self.span, self.stop, self.owner = at[whole], stop[whole], owner[whole]
        a, b = self.first[self.span], self.end[self.stop] if len(self.stop) else self.stop
        self.h1 = _Ranges(word, 0xD6E8FEB86659FD93).of(a, b)
        self.h2 = _Ranges(_mixed(word), 0xA0761D6478BD642F).of(a, b) >> np.uint64(32)

    def firsts(self) -> np.ndarray:
        """Which spans are the first of their kind in their text."""
        by = np.lexsort((self.span, self.h2, self.h1, self.owner))
        o, a, b = self.owner[by], self.h1[by], self.h2[by]
        new = np.ones(len(by), bool)
        new[1:] = (o[1:] != o[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        out = np.zeros(len(by), bool)
        out[by[new]] = True
        return out


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, tag): the tag tells rows with the same id but different texts apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("tag"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, doc_id, place): the spans of every document, each hash once; the place holds the tag
    of the text above the number of the span's first sentence, in 32 bits each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, texts in text_groups(batches, 1, GROUP_BYTES):
            s = Sentences([t or b"" for t in texts])
            keep = s.firsts()
            ids = group.column(0).take(pa.array(s.owner[keep]))
            tag = group.column(2).to_numpy().astype(np.int64)[s.owner[keep]]
            yield pa.record_batch({
                "h1": pa.array(s.h1[keep].view(np.int64)), "h2": pa.array(s.h2[keep].astype(np.uint32).view(np.int32)),
                "doc_id": ids, "place": pa.array(tag << 32 | (s.span - s.text_sentences[s.owner])[keep])})

    return _tagged(docs, id_col, text_col).mapInArrow(run, "h1 long, h2 int, doc_id long, place long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its sentences and words, how many were removed, and what is left."""
    every = spans(docs, id_col, text_col)
    twice = every.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
    met = every.join(twice, ["h1", "h2"]).where("doc_id > lo").select("doc_id", F.shiftright("place", 32).cast("int").alias("tag"), F.col("place").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("at"))
    later = met.groupBy("doc_id", "tag").agg(F.collect_set("at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, texts in text_groups(batches, 1, GROUP_BYTES):
            texts = [t or b"" for t in texts]
            s = Sentences(texts)
            drop = ~s.firsts()
            # spans that were found elsewhere first, by their place in the text
            place = np.full(len(s.first) + 1, -1, np.int64)
            place[s.span] = np.arange(len(s.span))
            lists = group.column(2)
            flat, owner = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(texts)), [len(x) if x.is_valid else 0 for x in lists])
            at = flat + s.text_sentences[owner]
            own = place[at[at < s.text_sentences[owner + 1]]]
            drop[own[own >= 0]] = True
            edge = np.zeros(len(s.first) + 1, np.int64)
            np.add.at(edge, s.span[drop], 1)
            np.add.at(edge, s.stop[drop] + 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            yield _result(group, texts, s, gone)

    joined = _tagged(docs, id_col, text_col).join(later, ["doc_id", "tag"], "left").select("doc_id", "text", "at")
    return joined.mapInArrow(run, RESULT)


def _result(group: pa.RecordBatch, texts: list[bytes], s: Sentences, gone: np.ndarray) -> pa.RecordBatch:
    n_words = np.diff(s.text_words)
    length = s.end - s.first
    removed, lost, left = [], [], []
    for k, t in enumerate(texts):
        a, b = s.text_sentences[k], s.text_sentences[k + 1]
        own = gone[a:b]
        removed.append(int(own.sum()))
        lost.append(int(length[a:b][own].sum()))
        if not removed[-1]:
            left.append(t)
            continue
        begin = s.word_first[s.first[a:b]] - s.text_first[k]
        begin[0] = 0
        begin = np.append(begin, len(t))
        left.append(b"".join(t[begin[i]:begin[i + 1]] for i in np.flatnonzero(~own)))
    return pa.record_batch({
        "doc_id": group.column(0), "n_sentences": pa.array(np.diff(s.text_sentences)), "n_removed": pa.array(removed, pa.int64()),
        "n_words": pa.array(n_words), "n_removed_words": pa.array(lost, pa.int64()),
        "text": pa.array(left, pa.binary()).cast(pa.string())})
