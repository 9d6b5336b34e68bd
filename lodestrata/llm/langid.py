"""Language identification of whole and mixed-language texts.

Training counts hashed byte n-grams of words per language. To label a text, the scripts of a word's
letters narrow the languages to those seen with such letters, each word gets a log-likelihood under
each language, and the Viterbi path over words, with a penalty for every change of language, labels
spans. The language with the most letters on the path is the document's.

Defined results: ``und`` with score 0 for a text that is null or has no letter; if nothing could be
learned, ``und`` too; a null language is never learned; ties go to the language that sorts first;
rows that repeat are labelled row by row; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, text_groups

FOLDS, HELD_OUT = 3, 1
#: Slots of the hashed n-gram table; it bounds the model at this many numbers a language.
SLOTS = 1 << 16
#: Ranges of slots that a language's counts are added up in, each by a task of its own.
SLOT_RANGES = 16
#: Log-likelihood that a change of language between two words costs.
SWITCH = 8.0
#: A language is a candidate for a script that at least this share of its letters are in.
SCRIPT_SHARE = 0.002
LETTER = re.compile(rb"[A-Za-z]")
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))

#: Scripts by first code point of a range, as in the Unicode block list. Fixed values.
RANGES = [
    (0x00C0, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "asian"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "none"), (0x2C00, "other"), (0x3000, "none"),
    (0x3040, "kana"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
SCRIPTS = ["none", "latin", *sorted({name for _, name in RANGES} - {"none", "latin"})]


def _script_table() -> np.ndarray:
    """Script number by code point, up to 0xFFFF; what lies above counts as the last place."""
    table = np.full(1 << 16, SCRIPTS.index("none"), np.int8)
    for first, name in RANGES:
        table[first:] = SCRIPTS.index(name)
    for first, last in ((65, 90), (97, 122)):
        table[first:last + 1] = SCRIPTS.index("latin")
    table[[0xD7, 0xF7]] = SCRIPTS.index("none")
    return table


TABLE = _script_table()


class Words:
    """The words of several texts in one byte array, lower-cased, each after a blank."""

    def __init__(self, texts: list[bytes]):
        split = [t.translate(LOWER).split() for t in texts]
        self.count = np.array([len(x) for x in split], np.int64)
        raw = b" " + b"  ".join(w for x in split for w in x) + b"  "
        self.raw = np.frombuffer(raw, np.uint8)
        blank = self.raw == 32
        self.first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        self.after = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashed n-grams of one to four bytes that end in a word or on the blank after it, by place;
        the places, and a row of four slots for each."""
        word = self.raw != 32
        at = np.flatnonzero(word | np.concatenate([[False], word[:-1]]))
        h, rows = np.zeros(len(at), np.uint32), []
        padded = np.concatenate([np.full(4, 32, np.uint8), self.raw])
        for k in range(4):
            h = (h ^ (padded[at + 4 - k].astype(np.uint32) + np.uint32(1 + 256 * k))) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            rows.append(h % np.uint32(SLOTS))
        return at, np.stack(rows, axis=1)

    def scripts(self) -> np.ndarray:
        """Letters of each script in each word."""
        lead = np.flatnonzero((self.raw & 0xC0) != 0x80)
        b = np.concatenate([self.raw, np.zeros(4, np.uint8)]).astype(np.int64)
        one, two, three = b[lead + 1] & 0x3F, b[lead + 2] & 0x3F, b[lead]
        point = np.where(three < 0x80, three, np.where(three < 0xE0, (three & 0x1F) << 6 | one, np.where(three < 0xF0, (three & 0x0F) << 12 | one << 6 | two, 0xFFFF)))
        script = TABLE[point]
        keep = script > 0
        owner = np.searchsorted(self.first, lead[keep], "right") - 1
        flat = np.bincount(owner * len(SCRIPTS) + script[keep], minlength=len(self.first) * len(SCRIPTS))
        return flat.reshape(len(self.first), len(SCRIPTS))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model from all documents of the training folds that have a language: log-probabilities by
    slot, and the share of each script. Each task adds up one table a language; the tables are added
    by language and range of slots as they stream in, so no task takes in a whole language."""
    base = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(F.col(id_col), FOLDS) != HELD_OUT)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    width = 4 * SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for group, texts in text_groups(batches, 1):
            langs = np.array(group.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                words = Words([t or b"" for t, own in zip(texts, langs == lang, strict=True) if own])
                slots, scripts = sums.setdefault(lang, [np.zeros(width, np.int64), np.zeros(len(SCRIPTS), np.int64)])
                rows = words.slots()[1]
                for k in range(4):
                    slots[k * SLOTS:(k + 1) * SLOTS] += np.bincount(rows[:, k], minlength=SLOTS)
                if len(words.first):
                    scripts += words.scripts().sum(0)
        for lang, (slots, scripts) in sums.items():
            at = np.flatnonzero(slots)
            for r, some in enumerate(np.split(at, np.searchsorted(at, np.arange(1, SLOT_RANGES) * width // SLOT_RANGES))):
                yield pa.record_batch({"lang": [lang], "r": pa.array([r], pa.int32()), "at": [some.astype(np.int32).tobytes()], "n": [slots[some].tobytes()], "scripts": [(scripts if r == 0 else scripts * 0).tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[np.ndarray]] = {}
        for batch in batches:
            for lang, r, at, n, scripts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault((lang, r), [np.zeros(width // SLOT_RANGES + 1, np.int64), np.zeros(len(SCRIPTS), np.int64)])
                own[0][np.frombuffer(at, np.int32) - r * width // SLOT_RANGES] += np.frombuffer(n, np.int64)
                own[1] += np.frombuffer(scripts, np.int64)
        for (lang, r), (slots, scripts) in sums.items():
            at = np.flatnonzero(slots)
            yield pa.record_batch({"lang": [lang], "r": pa.array([r], pa.int32()), "at": [(at + r * width // SLOT_RANGES).astype(np.int32).tobytes()], "n": [slots[at].tobytes()], "scripts": [scripts.tobytes()]})

    shape = "lang string, r int, at binary, n binary, scripts binary"
    found = base.mapInArrow(count, shape).repartition("lang", "r").mapInArrow(add, shape).collect()  # rows of bounded size, SLOT_RANGES for each language
    by_lang: dict[str, list] = {}
    for row in found:
        by_lang.setdefault(row["lang"], []).append(row)
    rows = [{"lang": lang, "at": b"".join(x["at"] for x in own), "n": b"".join(x["n"] for x in own), "scripts": sum(np.frombuffer(x["scripts"], np.int64) for x in own).tobytes()} for lang, own in sorted(by_lang.items())]
    table, share = np.zeros((len(rows), 4, SLOTS), np.float32), np.zeros((len(rows), len(SCRIPTS)))
    for i, r in enumerate(rows):
        n = np.zeros(width)
        n[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.int64)
        n = n.reshape(4, SLOTS)
        table[i] = np.log((n + 0.01) / (n.sum(1, keepdims=True) + 0.01 * SLOTS))
        scripts = np.frombuffer(r["scripts"], np.int64)
        share[i] = scripts / max(1, scripts.sum())
    weight = np.array([0.1, 0.2, 0.3, 0.4], np.float32)  # of n-grams of one to four bytes
    return {"langs": [r["lang"] for r in rows], "table": np.ascontiguousarray((table * weight[None, :, None]).transpose(1, 2, 0)), "may": share >= SCRIPT_SHARE}


def viterbi(scores: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of the words of several texts at once. ``scores``: words by languages, texts one
    after another, ``count`` words each."""
    n_langs = scores.shape[1]
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-count, kind="stable")
    start = np.concatenate([[0], np.cumsum(count)])[order]
    length = count[order]
    deepest = int(length[0]) if len(length) else 0
    live_at = np.searchsorted(-length, -np.arange(deepest), "left")  # texts with more than t words
    stay = np.zeros((len(scores), n_langs), bool)
    best = np.zeros(len(scores), np.int16)
    v = np.zeros((len(order), n_langs))
    for t in range(deepest):
        live = live_at[t]
        rows = start[:live] + t
        if t:
            top = v[:live].argmax(1)
            jump = v[np.arange(live), top] - penalty
            keep = v[:live] >= jump[:, None]
            stay[rows], best[rows] = keep, top
            v[:live] = np.where(keep, v[:live], jump[:, None])
        v[:live] += scores[rows]
    last = v.argmax(1) if len(order) else np.zeros(0, np.int64)
    state = last.copy()
    for t in range(deepest - 1, -1, -1):
        live = live_at[t]
        rows = start[:live] + t
        labels[rows] = state[:live]
        if t:
            state[:live] = np.where(stay[rows, state[:live]], state[:live], best[rows])
    return labels


def _label(model: dict, texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, their labels and their letters."""
    words = Words(texts)
    at, rows = words.slots()
    flat = model["table"]
    score = flat[0][rows[:, 0]] + flat[1][rows[:, 1]] + flat[2][rows[:, 2]] + flat[3][rows[:, 3]]
    begin = np.searchsorted(at, words.first)
    per_word = np.add.reduceat(score, begin, axis=0) if len(begin) else np.zeros((0, len(model["langs"])))
    scripts = words.scripts()
    letters = scripts.sum(1)
    may = model["may"][:, scripts.argmax(1)].T
    may |= ~may.any(1, keepdims=True)
    per_word = np.where(may, per_word, -1e6) * (letters > 0)[:, None]
    return words, viterbi(per_word, words.count, SWITCH), letters


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans): score is the share of letters labelled with the
    language; ``spans`` lists (lang, first word, end word)."""
    shared, langs = docs.sparkSession.sparkContext.broadcast(model), model["langs"]
    shape = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,start:int,stop:int>>"
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, texts in text_groups(batches, 1):
            texts = [t or b"" for t in texts]
            names, scores, spans = [], [], []
            if langs:
                words, labels, letters = _label(shared.value, texts)
                ends = np.cumsum(words.count)
                for t, first, last in zip(texts, ends - words.count, ends, strict=True):
                    own = labels[first:last]
                    mass = np.bincount(own, weights=letters[first:last], minlength=len(langs))
                    if not LETTER.search(t) and not any(c.isalpha() for c in t.decode("utf-8", "replace")):
                        names.append("und"), scores.append(0.0), spans.append([])
                        continue
                    top = int(mass.argmax())
                    cut = np.flatnonzero(np.diff(own)) + 1
                    edges = [0, *cut.tolist(), len(own)]
                    names.append(langs[top])
                    scores.append(float(mass[top] / mass.sum()) if mass.sum() else 0.0)
                    spans.append([{"lang": langs[own[a]], "start": a, "stop": b} for a, b in zip(edges[:-1], edges[1:], strict=True)])
            else:
                names, scores, spans = ["und"] * len(texts), [0.0] * len(texts), [[]] * len(texts)
            yield pa.record_batch([group.column(0), pa.array(names), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, shape)
    return made.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "spans")


def identify(docs: DataFrame, **columns: str) -> DataFrame:
    """Train on the training folds, label every document."""
    model = train(docs, **columns)
    columns.pop("lang_col", None)
    return predict(docs, model, **columns)
