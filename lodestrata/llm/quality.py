"""Quality rules: counts of a text and its perplexity under a byte n-gram model of its language.

Spark counts byte n-grams (of words in order, with one blank between) per language over all documents; a
modified Kneser-Ney model of each language is estimated from them and stored as sorted arrays of
packed n-grams (eight bits a byte, so the hash is exact) with their log-probabilities and back-off
weights. A document's perplexity is held against its language's band: so many interquartile ranges
below the first and above the third quartile of all documents of that language.

Defined results: a null text has no words; a null language is a language of its own; a document
without words, perplexity or band fails; rows that share an id are judged one by one, and ``keep`` keeps the rows of an
id if any of them is kept; other columns are ignored by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, text_groups, whole_rows

ORDER = 5
#: Bytes of text after which a counting task hands its n-grams on.
FLUSH_BYTES = 4 << 20
#: How far beyond the quartiles of log-perplexity the band of a language reaches, in quartile ranges.
BELOW, ABOVE = 5.0, 5.0
#: The range counts as at least this many log10 units, so that uniform corpora reject nothing.
LEAST_RANGE = 0.02
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated windows

SYMBOLS = b"#*$%&|<>"
#: Which digits a number, an address or a code has says nothing about the language: all count as one.
DIGITS = bytes.maketrans(b"123456789", b"000000000")
BLANK = 32

STATS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log10_perplexity double, row_key long"


# ---- counts of one text


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in three-word windows that the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n:
        return 0
    seen = Counter(windows)
    edge = np.zeros(n + 3, np.int8)
    again = np.fromiter((seen[w] > 1 for w in windows), bool, n)
    for k in range(3):
        edge[k:k + n] |= again
    return int(edge.sum())


def counts(text: bytes | None) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """Words, and (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or b""
    words = text.split()
    inside = b"".join(words)
    chars = len(inside.decode("utf-8", "replace")) if not inside.isascii() else len(inside)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return words, (len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


# ---- n-grams


def plain(words: list[bytes]) -> bytes:
    """A text as it is modelled: its words with one blank between, all digits alike."""
    return b" ".join(words).translate(DIGITS)


def packed(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For the bytes of each text and the blank after it, the n-gram that ends there; and the text
    that each belongs to."""
    pad = b" " * order
    raw = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    at = np.flatnonzero((raw != BLANK) | (np.concatenate([[BLANK], raw[:-1]]) != BLANK))
    gram = np.zeros(len(at), np.uint64)
    for k in range(order - 1, -1, -1):
        gram = gram << np.uint64(8) | raw[at - k].astype(np.uint64)
    return gram, np.repeat(np.arange(len(texts)), [len(t) + 1 if t else 0 for t in texts])


def ngram_counts(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[bytes]] = {}
        size = 0

        def flush():
            for key, texts in held.items():
                gram, _ = packed(texts, order)
                found = pa.array(gram.view(np.int64)).value_counts()
                yield pa.record_batch({"lang": pa.array([key] * len(found), pa.string()), "gram": found.field("values"), "n": found.field("counts")})
            held.clear()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for key, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                own = plain((t.as_py() or b"").split())
                held.setdefault(key, []).append(own)
                size += len(own)
                if size > FLUSH_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# ---- the model


class KneserNey:
    """Interpolated modified Kneser-Ney, as sorted arrays for each order."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, order: int = ORDER):
        by = np.argsort(grams, kind="stable")
        levels = [(grams[by].astype(np.uint64), n[by].astype(np.float64))]
        for k in range(order - 1, 0, -1):
            shorter, kinds = np.unique(levels[0][0] & np.uint64((1 << 8 * k) - 1), return_counts=True)
            levels.insert(0, (shorter, kinds.astype(np.float64)))
        self.order, self.keys, self.logp, self.contexts, self.backoff = order, [], [], [], []
        lower_keys, lower_p = None, None
        for keys, c in levels:
            d = self._discounts(c)
            context = keys >> np.uint64(8)
            starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, np.int64)
            size = np.diff(np.append(starts, len(keys)))
            total = np.add.reduceat(c, starts) if len(keys) else c
            spared = np.choose(np.minimum(c, 3).astype(int), d)
            gamma = np.add.reduceat(spared, starts) / total if len(keys) else c
            below = 1 / 256 if lower_keys is None else lower_p[np.searchsorted(lower_keys, keys & np.uint64((1 << 8 * len(self.keys)) - 1))]
            p = (c - spared) / np.repeat(total, size) + np.repeat(gamma, size) * below
            self.keys.append(keys)
            self.logp.append(np.log10(p).astype(np.float32))
            self.contexts.append(context[starts])
            self.backoff.append(np.log10(gamma).astype(np.float32))
            lower_keys, lower_p = keys, p

    @staticmethod
    def _discounts(c: np.ndarray) -> list[float]:
        n1, n2, n3, n4 = (float((c == k).sum()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 0.75, 3 - 4 * y * n4 / n3 if n3 and n4 else 0.9]
        return [0.0, *(min(max(x, 0.1), k - 0.1) for k, x in enumerate(d, 1))]

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of each n-gram's last byte after the others."""
        out = np.zeros(len(grams))
        open_ = np.arange(len(grams))
        for k in range(self.order, 0, -1):
            if not len(open_):
                return out
            part = grams[open_] & np.uint64((1 << 8 * k) - 1)
            at = np.minimum(np.searchsorted(self.keys[k - 1], part), max(len(self.keys[k - 1]) - 1, 0))
            hit = self.keys[k - 1][at] == part if len(self.keys[k - 1]) else np.zeros(len(part), bool)
            out[open_[hit]] += self.logp[k - 1][at[hit]]
            open_, part = open_[~hit], part[~hit]
            context = part >> np.uint64(8)
            at = np.minimum(np.searchsorted(self.contexts[k - 1], context), max(len(self.contexts[k - 1]) - 1, 0))
            if len(self.contexts[k - 1]):
                known = self.contexts[k - 1][at] == context
                out[open_[known]] += self.backoff[k - 1][at[known]]
        out[open_] += np.log10(1 / 256)
        return out


def models(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER) -> dict[str | None, KneserNey]:
    """A model of each language, from all its n-grams."""
    table = materialize(ngram_counts(docs, lang, text, order), "ngrams")
    found = {}
    for row in table.select("lang").distinct().collect():
        own = table.where(F.col("lang").eqNullSafe(F.lit(row["lang"]))).select("gram", "n").toArrow()
        found[row["lang"]] = KneserNey(own.column("gram").to_numpy().view(np.uint64), own.column("n").to_numpy(), order)
    discard(table)
    return found


def statistics(docs: DataFrame, model: dict, order: int = ORDER) -> DataFrame:
    """Counts and log10-perplexity a byte of every document (columns doc_id, lang, text), and the hash of
    what they follow from, text and language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch, texts in text_groups(batches, 2):
            ids, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own: dict[str | None, list[int]] = {}
            bodies, rows = [], []
            for i, (lang, t) in enumerate(zip(langs, texts, strict=True)):
                words, c = counts(t)
                own.setdefault(lang, []).append(i)
                bodies.append(plain(words))
                rows.append(c)
            log10: list[float | None] = [None] * len(bodies)
            for lang, places in own.items():
                gram, owner = packed([bodies[i] for i in places], order)
                kinds = pa.array(gram.view(np.int64)).dictionary_encode()
                distinct = kinds.dictionary.to_numpy().view(np.uint64)
                by = np.argsort(distinct)
                s = np.empty(len(distinct))
                s[by] = models[lang].score(distinct[by]) if lang in models else np.log10(1 / 256)
                total = np.bincount(owner, weights=s[kinds.indices.to_numpy()], minlength=len(places))
                for i, x, n in zip(places, total, np.bincount(owner, minlength=len(places)), strict=True):
                    log10[i] = -float(x) / int(n) if n else None
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), *(pa.array(c, pa.int64()) for c in cols), pa.array(log10, pa.float64()), batch.column(3)],
                names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log10_perplexity", "row_key"])

    return docs.select("doc_id", "lang", "text", F.xxhash64("lang", "text").alias("row_key")).mapInArrow(run, STATS)


def bands(stats: DataFrame, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """(lang, low, high): each language's band of log10-perplexity, from all its documents of at
    least ``MIN_WORDS`` words."""
    q = stats.where(F.col("n_words") >= MIN_WORDS).groupBy("lang").agg(F.percentile_approx("log10_perplexity", [0.25, 0.75], 10000).alias("q"))
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_RANGE))
    return q.select(F.col("lang").alias("__lang"), F.round(F.col("q")[0] - below * spread, 2).alias("low"), F.round(F.col("q")[1] + above * spread, 2).alias("high"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = BELOW, above: float = ABOVE, with_key: bool = False) -> DataFrame:
    """One row per document: counts, ``base_failed``, perplexity, and ``kept``. ``with_key``: with
    ``row_key`` too, the hash of text and language."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    stats = materialize(statistics(base, models(base)), "quality")
    limits = bands(stats, below, above)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    inside = F.coalesce((F.col("log10_perplexity") >= F.col("low")) & (F.col("log10_perplexity") <= F.col("high")), F.lit(False))
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & inside).alias("kept"),
        F.pow(F.lit(10.0), F.col("log10_perplexity")).alias("perplexity"), *["row_key"] * with_key)


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The documents that are kept, with all their columns. Each row goes by its id, text and language: rows
    that share an id, or have none, share nothing else."""
    good = judge(docs, id_col, text_col, lang_col, with_key=True, **options).where("kept").select(F.col("doc_id").alias("__b"), F.col("row_key").alias("__k")).distinct()
    rows = whole_rows(docs, __id=docs[id_col].cast("long"), __key=F.xxhash64(docs[lang_col], docs[text_col]))
    return rows.join(good, F.col("__id").eqNullSafe(F.col("__b")) & (F.col("__key") == F.col("__k")), "left_semi").select("__row.*")
