"""Benchmark decontamination with suffix arrays over the training text.

Each shard of documents becomes one array of word numbers (words that no benchmark item has are 0,
which nothing matches) and a suffix array over it, sorted as deep as a window is long. Every different test
window is binary-searched in every shard: the range it finds holds all its verbatim occurrences. Ranges of windows
of one length do not overlap, so marking them takes time in proportion to the shard, however often a window
is in the benchmark and a document. Items follow from windows by classes (windows of the same items are one). For the
longest match of a document the words that were hit are sorted together with the items that hit them, by doubling:
the neighbours of a place in that order hold its longest match. No row is shuffled; a shard is bounded
by ``SHARD_WORDS`` (a longer document is a shard of its own) and the benchmark goes out in slices
of at most ``SLICE_WORDS`` words, so neither side has to fit anywhere as a whole.

Defined results: a null text has no words; a null item text has no window; items that share an id
are one item; a null item id is the text ``null``; rows that repeat are judged row by row; other
columns are ignored by ``judge`` and kept by ``remove``; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_rows

WINDOW = 13
#: Words of documents in one suffix array, and words of benchmark items in one broadcast slice.
SHARD_WORDS = 1_500_000
SLICE_WORDS = 500_000
#: Occurrences of windows that are looked at together.
STEP = 2_000_000

#: Bytes to word characters: A-Z fall to a-z, ASCII that is neither letter nor digit to a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

VERDICT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_at long, longest_item string, longest_item_at long, row_key long"
MATCHES = "item_id string, test_offset long, length long, doc_id long, doc_offset long"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class TestSlice:
    """Test suffixes of some items: the numbers of their words, up to a window's length."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.ids = [item for item, _ in items]
        rows, length, owner, offset, full = [], [], [], [], []
        for k, (_, ws) in enumerate(items):
            numbers = [self.vocab[w] for w in ws]
            for j in range(len(numbers)):
                part = numbers[j:j + window]
                rows.append(part + [0] * (window - len(part)))
                length.append(len(part))
                owner.append(k)
                offset.append(j)
                full.append(len(part) == window or j == 0)
        self.rows = np.array(rows, np.int32).reshape(-1, window)
        self.length = np.array(length, np.int64)
        self.owner, self.offset = np.array(owner, np.int64), np.array(offset, np.int64)
        self.words = [ws for _, ws in items]
        self.names = sorted(set(self.ids))
        rank = {item: i for i, item in enumerate(self.names)}
        self.rank = np.array([rank[item] for item in self.ids], np.int64)
        # different windows, the items that each is of, and classes of windows of the same items
        is_window = np.array(full, bool)
        different, own = np.unique(np.column_stack([self.length[is_window], self.rows[is_window]]), axis=0, return_inverse=True) if is_window.any() else (np.zeros((0, window + 1), np.int64), np.zeros(0, np.int64))
        self.window_length, self.windows = different[:, 0].astype(np.int64), different[:, 1:].astype(np.int32)
        pairs = np.unique(np.column_stack([own.ravel(), self.owner[is_window]]), axis=0).reshape(-1, 2)
        self.window_items, self.item_from = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(different) + 1))
        classes: dict[bytes, int] = {}
        self.classes: list[np.ndarray] = []
        self.window_class = np.zeros(len(different), np.int64)
        for w in range(len(different)):
            ranks = np.unique(self.rank[self.window_items[self.item_from[w]:self.item_from[w + 1]]])
            self.window_class[w] = classes.setdefault(ranks.tobytes(), len(classes))
            if len(classes) > len(self.classes):
                self.classes.append(ranks)


class Shard:
    """A suffix array over the documents of one shard, as far as the slice's words go."""

    def __init__(self, docs: list[np.ndarray], depth: int, top: int):
        sizes = np.array([len(d) for d in docs], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # a 0 follows each document
        self.text = np.zeros(int(self.starts[-1]) + depth + 1, np.int32)
        for at, d in zip(self.starts, docs, strict=False):
            self.text[at:at + len(d)] = d
        self.depth = depth
        self.order = self._sorted(np.flatnonzero(self.text), max(1, int(top).bit_length()))

    def _sorted(self, suffixes: np.ndarray, bits: int) -> np.ndarray:
        """Sort suffixes by their first ``depth`` words: one sort by as many words as fit in 64
        bits, then sorts of the runs that are still equal."""
        per = max(1, 63 // bits)

        def key(at: np.ndarray, skip: int) -> np.ndarray:
            out = np.zeros(len(at), np.int64)
            for k in range(per):
                out = (out << bits) | self.text[np.minimum(at + skip + k, len(self.text) - 1)]
            return out
        first = key(suffixes, 0)
        by = np.argsort(first, kind="stable")
        order, keys = suffixes[by], first[by]
        run = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])]) if len(keys) else keys
        for skip in range(per, self.depth, per):
            size = np.bincount(run) if len(run) else run
            tied = np.flatnonzero(size[run] > 1) if len(run) else run
            if not len(tied):
                break
            more = key(order[tied], skip)
            by = np.lexsort((more, run[tied]))
            order[tied], more, old = order[tied][by], more[by], run[tied][by]
            new = np.zeros(len(order), bool)
            new[tied[1:]] = (more[1:] != more[:-1]) & (old[1:] == old[:-1])
            run = np.concatenate([[0], np.cumsum((run[1:] != run[:-1]) | new[1:])])
        return order

    def find(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern the range of the suffix array whose suffixes begin with it."""
        column = np.arange(rows.shape[1])
        used = column < length[:, None]

        def search(after: bool) -> np.ndarray:
            lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.order), np.int64)
            while True:
                live = np.flatnonzero(lo < hi)
                if not len(live):
                    return lo
                mid = (lo[live] + hi[live]) // 2
                here = self.text[np.minimum(self.order[mid][:, None] + column, len(self.text) - 1)]
                differ = (here != rows[live]) & used[live]
                at = differ.argmax(1)
                sign = np.where(differ.any(1), np.sign(here[np.arange(len(live)), at] - rows[live, at]), 0)
                right = (sign < 0) | (sign == 0) & after
                lo[live[right]], hi[live[~right]] = mid[right] + 1, mid[~right]
        return search(False), search(True)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[tuple[int | None, int], bytes, int]]]:
    """Lists of ((id, key), text, number of words) of about ``SHARD_WORDS`` words; texts as blank-separated
    words."""
    shard, held = [], 0
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts, strict=True):
            ws = words_of(text.as_py())
            shard.append(((doc_id, key), b" ".join(ws), len(ws)))
            held += len(ws)
            if held >= SHARD_WORDS:
                yield shard
                shard, held = [], 0
    if shard:
        yield shard


def _each(slices: list) -> Iterator[TestSlice]:
    """The slices, one after another; of several only one is in a worker's memory at a time."""
    for part in slices:
        yield part.value
        if len(slices) > 1:
            part.__dict__.pop("_value", None)  # read again from the worker's disk when its turn comes


def _indexed(group: list[tuple[tuple[int | None, int], bytes, int]], test: TestSlice) -> Shard:
    numbers = [np.fromiter((test.vocab.get(w, 0) for w in text.split()), np.int32, n) for _, text, n in group]
    return Shard(numbers, test.window, len(test.vocab))


#: A verbatim match: minus its length, where it is in the document, the item, and where it is there.
Match = tuple[int, int, str, int]


def _hits(shard: Shard, test: TestSlice) -> tuple[np.ndarray, list[tuple[str, ...]], list[Match | None]]:
    """Which words of the shard lie in an occurrence of a window; the items found in each document, in
    order; and its longest verbatim match of a window or more (the first in the document, the smallest
    item and place there among equals)."""
    n_docs = len(shard.starts) - 1
    items: list[tuple[str, ...]] = [()] * n_docs
    best: list[Match | None] = [None] * n_docs
    edge = np.zeros(len(shard.text) + 1, np.int64)
    whole = edge.copy()
    if not len(test.windows):
        return edge[:-1] > 0, items, best
    lo, hi = shard.find(test.windows, test.window_length)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return edge[:-1] > 0, items, best
    first_name = np.array([c[0] for c in test.classes])
    of_doc: list[np.ndarray] = []
    for some in np.split(found, np.flatnonzero(np.diff(np.cumsum(hi[found] - lo[found]) // STEP)) + 1):
        n = hi[some] - lo[some]
        window = np.repeat(some, n)
        at = shard.order[np.arange(len(window)) + np.repeat(lo[some] - (np.cumsum(n) - n), n)]
        size = test.window_length[window]
        begin, end = np.bincount(at, minlength=len(edge)), np.bincount(at + size, minlength=len(edge))
        edge += begin - end
        full = size == test.window
        whole += np.bincount(at[full], minlength=len(edge)) - np.bincount((at + size)[full], minlength=len(edge))
        doc = np.searchsorted(shard.starts, at, "right") - 1
        of_doc.append(np.unique(doc * len(test.classes) + test.window_class[window]))
        short = np.flatnonzero(~full)  # whole items: nothing is longer unless a full window is there
        name = first_name[test.window_class[window[short]]]
        by = short[np.lexsort((name, at[short], -size[short], doc[short]))]
        for i in by[np.flatnonzero(np.concatenate([[True], doc[by][1:] != doc[by][:-1]]))] if len(by) else ():
            d = int(doc[i])
            match = (-int(size[i]), int(at[i] - shard.starts[d]), test.names[first_name[test.window_class[window[i]]]], 0)
            best[d] = match if best[d] is None else min(best[d], match)
    pairs = np.unique(np.concatenate(of_doc))
    doc, kind = pairs // len(test.classes), pairs % len(test.classes)
    cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    known: dict[bytes, tuple[str, ...]] = {}
    for d, kinds in zip(doc[cuts].tolist(), np.split(kind, cuts[1:]), strict=True):
        key = kinds.tobytes()
        if key not in known:
            known[key] = tuple(test.names[r] for r in np.unique(np.concatenate([test.classes[k] for k in kinds])))
        items[d] = known[key]
    used = np.unique(np.concatenate([test.window_items[test.item_from[w]:test.item_from[w + 1]] for w in found[test.window_length[found] == test.window]] or [np.zeros(0, np.int64)]))
    for d, match in _runs(shard, test, np.cumsum(whole)[:-1] > 0, used):
        best[d] = match if best[d] is None else min(best[d], match)
    return np.cumsum(edge)[:-1] > 0, items, best


def _runs(shard: Shard, test: TestSlice, hit: np.ndarray, used: np.ndarray) -> Iterator[tuple[int, Match]]:
    """(document, longest match) of the documents with words in full windows, which some items have."""
    begin, end = np.flatnonzero(hit & ~np.roll(hit, 1)), np.flatnonzero(hit & ~np.roll(hit, -1)) + 1
    if not len(begin):
        return
    numbers = [np.array([test.vocab[w] for w in test.words[k]], np.int64) for k in used]
    parts = [shard.text[a:b].astype(np.int64) for a, b in zip(begin, end, strict=True)] + numbers
    sizes = np.array([len(x) for x in parts])
    start = np.cumsum(sizes + 1) - sizes - 1
    text = np.empty(int(sizes.sum()) + len(parts), np.int64)
    text[start + sizes] = len(test.vocab) + 1 + np.arange(len(parts))  # every part ends in a word of its own
    for a, x in zip(start, parts, strict=True):
        text[a:a + len(x)] = x
    part = np.repeat(np.arange(len(parts)), sizes + 1)
    offset = np.arange(len(text)) - start[part]
    real, ours = offset < sizes[part], part < len(begin)

    # names of all runs of 1, 2, 4 .. words: equal runs have equal names, in order
    names = [np.unique(text, return_inverse=True)[1].astype(np.int32)]
    longest = min(sizes[:len(begin)].max(), sizes[len(begin):].max())
    while 1 << (len(names) - 1) < longest:
        step = 1 << (len(names) - 1)
        after = np.concatenate([names[-1][step:], np.full(min(step, len(text)), -1, np.int32)])[:len(text)]
        names.append(np.unique(names[-1].astype(np.int64) * (len(text) + 1) + after + 1, return_inverse=True)[1].astype(np.int32))

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from places a and b on."""
        n = np.zeros(len(a), np.int64)
        for level in range(len(names) - 1, -1, -1):
            n += (names[level][a + n] == names[level][b + n]).astype(np.int64) << level
        return n

    order = np.argsort(names[-1], kind="stable")
    order = order[real[order]]
    theirs = order[~ours[order]]
    mine = order[ours[order]]
    left = np.cumsum(~ours[order])[ours[order]]  # the benchmark's places before each of ours
    length = np.maximum(np.where(left > 0, common(mine, theirs[np.maximum(left - 1, 0)]), 0), np.where(left < len(theirs), common(mine, theirs[np.minimum(left, len(theirs) - 1)]), 0))
    where = begin[part[mine]] + offset[mine]
    doc = np.searchsorted(shard.starts, where, "right") - 1
    by = np.lexsort((where, -length, doc))
    top = by[np.concatenate([[True], doc[by][1:] != doc[by][:-1]])]
    top = top[length[top] >= test.window]

    # all places of the benchmark that agree as far: a range around ours
    at, most, lo, hi = mine[top], length[top], np.zeros(len(top), np.int64), left[top]
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) // 2
        good = common(at[live], theirs[mid]) >= most[live]
        hi[live[good]], lo[live[~good]] = mid[good], mid[~good] + 1
    begin_of, lo, hi = lo, left[top], np.full(len(top), len(theirs))
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) // 2
        good = common(at[live], theirs[mid]) >= most[live]
        lo[live[good]], hi[live[~good]] = mid[good] + 1, mid[~good]
    order_of = test.rank[used[part[theirs] - len(begin)]] * (int(sizes.max()) + 1) + offset[theirs]
    least: dict[tuple[int, int], int] = {}
    for i, span in enumerate(zip(begin_of.tolist(), lo.tolist(), strict=True)):
        if span not in least:
            least[span] = int(order_of[span[0]:span[1]].min())
        name, place = divmod(least[span], int(sizes.max()) + 1)
        d = int(doc[top[i]])
        yield d, (-int(most[i]), int(where[top[i]] - shard.starts[d]), test.names[name], place)


def _slices(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> list:
    """Broadcast slices of the benchmark, read to the driver one slice at a time."""
    context, out, part, held = benchmark.sparkSession.sparkContext, [], [], 0
    for item, text in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")), F.col(text_col)).where(F.col(text_col).isNotNull()).toLocalIterator():
        ws = words_of(text.encode())
        if ws:
            part.append((item, ws))
            held += len(ws)
        if held >= SLICE_WORDS:
            out.append(context.broadcast(TestSlice(part, window)))
            part, held = [], 0
    if part or not out:
        out.append(context.broadcast(TestSlice(part, window)))
    return out


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", with_key: bool = False) -> DataFrame:
    """One row per document: how many of its words lie in verbatim benchmark windows, in which items,
    and the longest verbatim match (its words, and where it begins in the document and in which item;
    null if there is none). Contaminated: at least one word in twenty. ``with_key``: with ``row_key`` too,
    the hash of the text."""
    slices = _slices(benchmark, item_col, item_text_col, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _shards(batches):
            hit, found, best = None, [()] * len(group), [None] * len(group)
            hashed: dict[tuple[str, ...], str] = {}
            for test in _each(slices):
                shard = _indexed(group, test)
                now, items, longest = _hits(shard, test)
                hit = now if hit is None else hit | now
                found = [a if not b else b if not a else tuple(sorted({*a, *b})) for a, b in zip(found, items, strict=True)]
                best = [min((x for x in pair if x), default=None) for pair in zip(best, longest, strict=True)]
            for x in found:
                if x not in hashed:
                    hashed[x] = hashlib.sha256(",".join(x).encode()).hexdigest()
            sums = np.concatenate([[0], np.cumsum(hit)])
            n_words = np.array([n for _, _, n in group], np.int64)
            n_hit = sums[shard.starts[:-1] + n_words] - sums[shard.starts[:-1]]
            yield pa.record_batch({
                "doc_id": pa.array([d[0] for d, _, _ in group], pa.int64()),
                "n_words": pa.array(n_words), "n_hit": pa.array(n_hit.astype(np.int64)),
                "n_items": pa.array([len(x) for x in found], pa.int64()),
                "items_sha256": pa.array([hashed[x] for x in found]),
                "contaminated": pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
                "longest": pa.array([x and -x[0] for x in best], pa.int64()), "longest_at": pa.array([x and x[1] for x in best], pa.int64()),
                "longest_item": pa.array([x and x[2] for x in best], pa.string()), "longest_item_at": pa.array([x and x[3] for x in best], pa.int64()),
                "row_key": pa.array([d[1] for d, _, _ in group], pa.int64()),
            })

    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row_key")).mapInArrow(run, VERDICT)
    return each if with_key else each.drop("row_key")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each test suffix its longest verbatim match over all shards and where it is (the smallest
    id and offset among equals); suffixes without a match are left out."""
    slices = _slices(benchmark, item_col, item_text_col, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _shards(batches):
            for test in _each(slices):
                shard = _indexed(group, test)
                if not len(shard.order) or not len(test.rows):
                    continue
                best = _longest(shard, test, [d[0] for d, _, _ in group])
                yield pa.record_batch(dict(zip(["item_id", "test_offset", "length", "doc_id", "doc_offset"], best, strict=True)))

    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("row_key")).mapInArrow(run, MATCHES)
    top = F.min(F.struct((-F.col("length")).alias("l"), "doc_id", "doc_offset"))
    return each.groupBy("item_id", "test_offset").agg(top.alias("t")).select("item_id", "test_offset", (-F.col("t.l")).alias("length"), "t.doc_id", "t.doc_offset")


def _longest(shard: Shard, test: TestSlice, ids: list) -> list[pa.Array]:
    numbers = [np.array([test.vocab[w] for w in ws], np.int32) for ws in test.words]
    lo, hi = shard.find(test.rows, test.length)
    out: list[list] = [[], [], [], [], []]
    for k in range(len(test.rows)):
        suffix, best = numbers[test.owner[k]][test.offset[k]:], (0, 0, 0)
        span = range(max(0, lo[k] - 1), min(len(shard.order), hi[k] + 1))
        for at in shard.order[span.start:span.stop]:
            end = min(len(suffix), len(shard.text) - at)
            differ = np.flatnonzero(shard.text[at:at + end] != suffix[:end])
            n = int(differ[0]) if len(differ) else end
            d = int(np.searchsorted(shard.starts, at, "right")) - 1
            best = min(best, (-n, ids[d] if ids[d] is not None else -1, int(at - shard.starts[d])))
        if best[0]:
            for column, x in zip(out, (test.ids[test.owner[k]], int(test.offset[k]), -best[0], best[1], best[2]), strict=True):
                column.append(x)
    return [pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)]


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns. Each row goes by its id and its
    text: rows that share an id, or have none, share nothing else."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = judge(docs, benchmark, with_key=True, **options).where("contaminated").select(F.col("doc_id").alias("__b"), F.col("row_key").alias("__k")).distinct()
    rows = whole_rows(docs, __id=docs[id_col].cast("long"), __key=F.xxhash64(docs[text_col]))
    return rows.join(bad, F.col("__id").eqNullSafe(F.col("__b")) & (F.col("__key") == F.col("__k")), "left_anti").select("__row.*")
