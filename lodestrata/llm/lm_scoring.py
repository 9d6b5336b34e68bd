"""Language-model scoring by logistic context mixing, over all documents.

A text is its words, lower-cased (A-Z), each followed by a blank, then an end mark. Words are spelt
bit by bit. Each of several contexts (the last one to four bytes, and the word so far) hashes, with
the bits of the current byte, to a slot of a bit predictor; the predictors' logits are added up with
weights that two gates select, and the mixture is refined by an adaptive probability map. The
logarithms add up to the text's probability and to bits per byte.

The last bytes run on over the border of a word, so texts are scored in order. As no context but the
word so far is longer than four bytes, only the first three bytes of a word (its head, with the blank
if it is shorter) see what stands before it, and of that only the last three bytes before the blank.
A token's score is that of its head after these three bytes and that of the rest of its word. Words
and heads are the units that are counted, learned from and spelt, each once in the whole corpus.

Documents are tokenised once, in blocks. Each block hands its units, with their training counts, to
buckets; a bucket adds up the counts of all blocks. Predictors count all training tokens; the number of
their slots follows the bytes of all units, up to ``SLOT_BITS`` for each context, which bounds what is
broadcast. Gate weights and map are learned online from all training tokens, each unit weighing as often
as it occurs (and predicted as if one occurrence had not been counted): buckets are dealt to lanes, whose
number follows the units too; a lane goes through its buckets in order, and lanes are averaged by their
tokens. So the model depends on the documents alone, not on partitions or the order of arrival.

What moves is the blocks' units, never single tokens, and nothing of the size of the vocabulary
reaches the driver. A worker holds one block, one bucket, or the slots of the model at a time.

Defined results: a null text is empty (one token, the end); a null id counts as the empty text when
folds are dealt; rows that repeat are scored row by row and each is learned from; other columns are
ignored; an empty table gives an empty result; with nothing to learn from, all counts are zero.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, materialize_split, text_groups

FOLDS, HELD_OUT = 5, 1
END = b"\xff"  # no byte of UTF-8
#: The three blanks before a text, and a mark beyond three bytes.
START, ONE = 0x202020, 1 << 24
BLANK = 32
LOWER = bytes(b + 32 if 65 <= b <= 90 else BLANK if 9 <= b <= 13 else b for b in range(256))

#: Bytes of a word that see what stands before it.
HEAD = 3
#: Bytes of text in a block; least number of buckets that units are dealt into, and documents per bucket.
BLOCK_BYTES = 16 << 20
BUCKETS, BUCKET_DOCS = 1024, 1 << 14
#: The contexts: this many last bytes, and at last the word so far; with the most slots each may have, as
#: a power of two.
ORDERS = (1, 2, 3, 4)
SLOT_BITS = (16, 19, 21, 22, 22)
CONTEXTS = len(ORDERS) + 1
PAD = max(ORDERS)
#: Bytes of units to a lane, and the most lanes.
LANE_BYTES, LANES = 1 << 22, 256
#: Rate of the online updates and the number of events in one.
RATE, STEP = 0.02, 8192
#: Prior of a predictor's counts; cells of the map along the logit, and their prior weight.
PRIOR, CELLS, CELL_PRIOR = 0.4, 33, 16.0
#: Units are spelt so many bytes at a time.
CHUNK = 1 << 15


# ---- byte strings in arrays


def _strings(data: bytes | np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _parts(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, sizes) of an array of byte strings."""
    strings = pa.concat_arrays([strings])
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset:strings.offset + len(strings) + 1]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    return (data[ends[0]:ends[-1]], np.diff(ends)) if len(strings) else (np.zeros(0, np.uint8), np.zeros(0, np.int32))


def _places(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``first``, ``first + 1`` and so on, ``sizes`` of them, for each."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def _firsts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes, dtype=np.int64) - sizes


# ---- blocks


def _edges(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word its first three bytes (with the blanks after it) and the last three before a
    blank that follows it, in one number; of a word of one byte the first of the last three is 1 << 24."""
    first, out = _firsts(sizes), np.zeros(len(sizes), np.int64)
    end = first + sizes
    for k in range(HEAD, 0, -1):  # a blank stands before the word, and nothing before that
        own = data[np.maximum(end - k, 0)].astype(np.int64)
        out = out << 8 | np.where(sizes >= k, own, np.where(sizes == k - 1, BLANK, 0))
    out += (sizes == 1) * ONE
    for k in range(HEAD):
        out = out << 8 | np.where(sizes > k, data[np.minimum(first + k, len(data) - 1)], BLANK)
    return out


def _heads(tokens: np.ndarray, mark: int, sizes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each token and the end mark (the word of number ``mark``) of each document: the three bytes
    before its blank and its first three, in one number."""
    at = np.full(len(tokens) + len(sizes), mark, np.int64)
    end = np.cumsum(sizes + 1) - 1
    text = np.ones(len(at), bool)
    text[end] = False
    at[text] = tokens
    own = edges[at]
    last = own >> 24
    before = np.concatenate([[START], last[:-1]])[:len(at)]
    again = np.concatenate([[START, START], last[:-2]])[:len(at)]
    first = end - sizes
    before[first] = START
    again[first] = START
    again[first[sizes > 0] + 1] = START
    before = np.where(before >= ONE, (again & 255) << 16 | before & 0xFFFF, before)
    return before << 24 | own & 0xFFFFFF


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _hashed(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte strings, none of them empty."""
    power = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, 0xD6E8FEB86659FD93, np.uint64))
    within = _places(np.zeros(len(sizes), np.int64), sizes)
    return _mixed(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[within], _firsts(sizes)))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers under 2**32, byte by byte and deflated."""
    return zlib.compress(np.ascontiguousarray(numbers.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def _dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of units by bucket, and the bucket of each in this order."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def _head_hashes(heads: np.ndarray) -> np.ndarray:
    return _mixed(heads.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_TEXTS = "docs array<long>, held array<boolean>, n_words array<long>, n_bytes array<long>, tokens binary, edges binary"
_UNITS = "words binary, sizes binary, trained binary, heads binary, first_word long, n_units array<int>, first_head long"
_BLOCKS = f"block long, bucket int, {_TEXTS}, {_UNITS}"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def _shape(columns: str) -> pa.Schema:
    kinds = (x.split() for x in columns.split(", "))
    return pa.schema([(n, pa.list_(_ARROW[t[6:-1]]) if t.startswith("array") else _ARROW[t]) for n, t in kinds])


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Per block one row (bucket -1) with its documents as numbers of words, and a row for each bucket
    with the block's units there and their training counts. Words and heads are numbered in the order of
    buckets, so that a bucket's have numbers that follow each other."""
    part, n = TaskContext.get().partitionId(), 0
    for group, texts in text_groups(batches, 1, BLOCK_BYTES):
        ids = group.column(0).to_pylist()
        size = np.array([len(t or b"") for t in texts], np.int64)
        raw = np.frombuffer((b" ".join(t or b"" for t in texts) + b" ").translate(LOWER), np.uint8)
        blank = raw == BLANK
        edge = np.flatnonzero(np.diff(blank, prepend=True))
        first, end = edge[::2], edge[1::2]
        found = _strings(raw[~blank], end - first).dictionary_encode()
        n_words = np.diff(np.searchsorted(first, np.concatenate([_firsts(size + 1), [len(raw)]])))
        data, sizes = _parts(found.dictionary)
        data, sizes = np.concatenate([np.frombuffer(END, np.uint8), data]), np.concatenate([[len(END)], sizes])
        order, word_bucket = _dealt(_hashed(data, sizes), buckets)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        data, sizes = data[_places(_firsts(sizes)[order], sizes[order])], sizes[order]
        mark, tokens = int(rank[0]), rank[found.indices.to_numpy() + 1]
        edges = _edges(data, sizes)
        held = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % FOLDS == HELD_OUT for i in ids], bool)
        trained = np.bincount(tokens[np.repeat(~held, n_words)], minlength=len(sizes))
        trained[mark] += (~held).sum()
        heads, at = np.unique(_heads(tokens, mark, n_words, edges), return_inverse=True)
        order, head_bucket = _dealt(_head_hashes(heads), buckets)
        head_trained = np.bincount(at[np.repeat(~held, n_words + 1)], minlength=len(heads))[order]
        heads, block = heads[order], part << 24 | n
        n += 1
        yield pa.RecordBatch.from_pylist([{"block": block, "bucket": -1, "docs": ids, "held": held.tolist(), "n_words": n_words.tolist(), "n_bytes": size.tolist(),
                                           "tokens": _packed(np.concatenate([[mark], tokens])), "edges": zlib.compress(edges.tobytes(), 1)}], _shape(_BLOCKS))
        rows, ends = [], np.concatenate([[0], np.cumsum(sizes)])
        for b in np.union1d(word_bucket, head_bucket).tolist():
            (w, x), (h, y) = (np.searchsorted(own, [b, b + 1]).tolist() for own in (word_bucket, head_bucket))
            rows.append({
                "block": block, "bucket": b, "words": data[ends[w]:ends[x]].tobytes(), "sizes": _packed(sizes[w:x]), "trained": _packed(np.concatenate([trained[w:x], head_trained[h:y]])),
                "heads": heads[h:y].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes(), "first_word": w, "n_units": [x - w, y - h], "first_head": h})
        yield pa.RecordBatch.from_pylist(rows, _shape(_BLOCKS))


_VOCAB = "bucket int, words binary, sizes binary, counts binary, heads binary, n_tokens long, n_types long, n_bytes long, blocks array<long>, first_words array<long>, n_words array<int>, first_heads array<long>, n_heads array<int>, places binary"


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[list[dict]]:
    """Rows that follow each other and agree in a column."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0][by] != row[by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _head_numbers(heads: bytes) -> np.ndarray:
    out = np.zeros((len(heads) // (2 * HEAD), 8), np.uint8)
    out[:, 2:] = np.frombuffer(heads, np.uint8).reshape(-1, 2 * HEAD)
    return out.view(">u8").ravel().astype(np.int64)


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket: its distinct words and heads, sorted, with their counts over all blocks, and
    for every block's units the place of each among these (words, then heads)."""
    for rows in _runs(batches, "bucket"):
        n_words, n_heads = [r["n_units"][0] for r in rows], [r["n_units"][1] for r in rows]
        found = _strings(b"".join(r["words"] for r in rows), np.concatenate([_unpacked(r["sizes"]) for r in rows])).dictionary_encode()
        order = pc.array_sort_indices(found.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        data, sizes = _parts(found.dictionary.take(pa.array(order)))
        heads, head_place = np.unique(_head_numbers(b"".join(r["heads"] for r in rows)), return_inverse=True)
        trained = [_unpacked(r["trained"]) for r in rows]
        add = lambda place, weights, n: np.bincount(place, weights=weights, minlength=n).astype(np.int64)
        place = rank[found.indices.to_numpy()]
        counts = add(place, np.concatenate([t[:n] for t, n in zip(trained, n_words, strict=True)]), len(sizes))
        head_counts = add(head_place, np.concatenate([t[n:] for t, n in zip(trained, n_words, strict=True)]), len(heads))
        yield pa.RecordBatch.from_pylist([{
            "bucket": rows[0]["bucket"], "words": data.tobytes(), "sizes": sizes.astype(np.int32).tobytes(), "counts": np.concatenate([counts, head_counts]).tobytes(), "heads": heads.tobytes(),
            "n_tokens": int(counts.sum()), "n_types": int((counts > 0).sum()), "n_bytes": len(data) + HEAD * len(heads), "blocks": [r["block"] for r in rows],
            "first_words": [r["first_word"] for r in rows], "n_words": n_words, "first_heads": [r["first_head"] for r in rows], "n_heads": n_heads,
            "places": _packed(np.concatenate([place, head_place]))}], _shape(_VOCAB))


# ---- the mixing model


class Events:
    """The bits that spell some texts: which text, the bit, the node (the bits of the byte so far, after
    a leading one), and the hash of each context. ``before``: the four bytes before each; the first
    ``skip`` bytes of each are not spelt."""

    def __init__(self, before: np.ndarray, data: np.ndarray, sizes: np.ndarray, skip: np.ndarray):
        total = sizes + PAD
        raw = np.empty(int(total.sum()), np.uint8)
        body = _firsts(total) + PAD
        raw[_places(body - PAD, np.full(len(sizes), PAD))] = before.ravel()
        raw[_places(body, sizes)] = data
        n = sizes - skip
        self.word = np.repeat(np.arange(len(sizes)), n)
        at = _places(body + skip, n)
        wide = raw.astype(np.uint64)
        within = at - body[self.word]
        contexts, h = [], np.zeros(len(at), np.uint64)
        for k in range(1, PAD + 1):
            h = h << np.uint64(8) | wide[at - k]
            if k in ORDERS:
                contexts.append(h + np.uint64(k << 40))
        # the word so far: prefix sums of position-keyed bytes, differences of which are exact
        keyed = (wide + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        keyed = (keyed ^ (keyed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        power = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, 0xD6E8FEB86659FD93, np.uint64))
        place = np.maximum(np.arange(len(raw)) - np.repeat(body, total), 0)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(keyed * power[place])])
        contexts.append((sums[at] - sums[body[self.word]]) ^ within.astype(np.uint64) << np.uint64(56))
        self.hashes = []
        for c in contexts:
            c = c * np.uint64(0x94D049BB133111EB)
            self.hashes.append(((c ^ (c >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32))
        byte = raw[at].astype(np.int32)
        shift = np.arange(7, -1, -1, dtype=np.int32)
        self.bit = (byte[:, None] >> shift & 1).astype(np.int8)
        self.node = (byte[:, None] | 256) >> (shift + 1)

    @classmethod
    def of_units(cls, data: np.ndarray, sizes: np.ndarray, heads: np.ndarray) -> Iterator[tuple[slice, Events]]:
        """(which units, their events) of what words have beyond their heads, and then of heads, in
        parts of about ``CHUNK`` bytes; units are numbered in this order."""
        ends = np.cumsum(sizes, dtype=np.int64)
        first, at = 0, 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(ends, at + CHUNK)))
            stop, size = int(ends[last - 1]), sizes[first:last].astype(np.int64)
            body = np.full(stop - at + len(size), BLANK, np.uint8)
            body[_places(_firsts(size + 1), size)] = data[at:stop]
            yield slice(first, last), cls(np.full((len(size), PAD), BLANK, np.uint8), body, size + 1, np.minimum(HEAD, size + 1))
            first, at = last, stop
        for a in range(0, len(heads), CHUNK // HEAD):
            key = heads[a:a + CHUNK // HEAD].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - 2 * HEAD:]
            own = key[:, HEAD:]
            spelt = np.where((own == BLANK).any(1), (own == BLANK).argmax(1) + 1, HEAD)
            before = np.concatenate([key[:, :HEAD], np.full((len(key), 1), BLANK, np.uint8)], axis=1)
            yield slice(len(sizes) + a, len(sizes) + a + len(key)), cls(before, own[np.arange(HEAD) < spelt[:, None]], spelt, np.zeros(len(key), np.int64))

    @classmethod
    def of_words(cls, words: list[bytes]) -> Events:
        """The events of words in the order of a text, each with the blank after it."""
        before, last = [], b" " * PAD
        for w in words:
            before.append(last)
            last = (last + w + b" ")[-PAD:]
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        return cls(np.frombuffer(b"".join(before), np.uint8), np.frombuffer(b"".join(w + b" " for w in words), np.uint8), sizes, np.zeros(len(words), np.int64))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


class Slots:
    """How many slots each context has, and where an event's are. The table of all contexts is one array."""

    def __init__(self, bits: tuple[int, ...]):
        self.bits = bits
        size = [1 << b for b in bits]
        self.first, self.size = [sum(size[:k]) for k in range(len(size))], sum(size)

    def of(self, e: Events) -> np.ndarray:
        """Contexts by events."""
        out = np.empty((CONTEXTS, e.node.size), np.int64)
        turn = e.node.astype(np.uint32) * np.uint32(0x9E3779B1)
        for k, (h, b) in enumerate(zip(e.hashes, self.bits, strict=True)):
            out[k] = ((h[:, None] + turn) * np.uint32(0x85EBCA6B) >> np.uint32(32 - b)).ravel()
            out[k] += self.first[k]
        return out


class Mixer:
    """The predictors' logits, gate weights and the map. Gate one is the node, gate two the number of
    contexts that say something with the bit's place in the byte."""

    def __init__(self, slots: Slots, logit: np.ndarray | None):
        self.slots, self.logit = slots, logit
        self.by_node = np.full((256, CONTEXTS), 1 / CONTEXTS)
        self.by_depth = np.full((8 * (CONTEXTS + 1), CONTEXTS), 1 / CONTEXTS)
        self.map = np.repeat(squash(np.linspace(-8, 8, CELLS))[None, :], 256, axis=0)

    def gates(self, x: np.ndarray, e: Events) -> tuple[np.ndarray, np.ndarray]:
        return e.node.ravel(), (x != 0).sum(0) * 8 + np.tile(np.arange(8), len(e.word))

    def mixed(self, x: np.ndarray, node: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return sum(x[k] * (self.by_node[node, k] + self.by_depth[depth, k]) for k in range(CONTEXTS))

    @staticmethod
    def cells(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = (np.clip(logit, -8, 8) + 8) * ((CELLS - 1) / 16)
        low = np.minimum(place.astype(np.int64), CELLS - 2)
        return low, place - low

    def ones_probability(self, e: Events) -> np.ndarray:
        """Probability of a one, for each event."""
        x = self.logit[self.slots.of(e)]
        node, depth = self.gates(x, e)
        logit = self.mixed(x, node, depth)
        low, over = self.cells(logit)
        refined = self.map[node, low] * (1 - over) + self.map[node, low + 1] * over
        return np.clip((squash(logit) + refined) / 2, 1e-6, 1 - 1e-6)

    def _logs(self, e: Events, n: int) -> np.ndarray:
        p = self.ones_probability(e)
        bits = np.log10(np.where(e.bit.ravel() == 1, p, 1 - p)).reshape(-1, 8).sum(1)
        return np.bincount(e.word, weights=bits, minlength=n)

    def score(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word of a text, spelt after the words before it and with the
        blank after it."""
        return self._logs(Events.of_words(words), len(words))

    def score_units(self, data: np.ndarray, sizes: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """log10 probability of what each word has beyond its head, and of each head."""
        out = np.zeros(len(sizes) + len(heads))
        for s, e in Events.of_units(data, sizes, heads):
            out[s] = self._logs(e, s.stop - s.start)
        return out


class Learner:
    """Online learning of a mixer's weights and map, from units with their counts."""

    def __init__(self, slots: Slots, zeros: np.ndarray, ones: np.ndarray):
        self.mixer, self.zeros, self.ones = Mixer(slots, None), zeros, ones
        self.squares = [np.zeros_like(self.mixer.by_node), np.zeros_like(self.mixer.by_depth)]
        self.events = np.zeros((2, 256 * CELLS))
        self.tokens = 0

    def inputs(self, e: Events) -> np.ndarray:
        """Logits as if one occurrence of each unit had not been counted."""
        slots, bit = self.mixer.slots.of(e), e.bit.ravel()
        one = np.maximum(self.ones[slots] - bit, 0) + np.float32(PRIOR)
        zero = np.maximum(self.zeros[slots] - (1 - bit), 0) + np.float32(PRIOR)
        return np.log(one / zero)

    def learn(self, data: np.ndarray, sizes: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> None:
        self.tokens += int(counts.sum())
        for s, e in Events.of_units(data, sizes, heads):
            if not len(e.word):  # words that their heads spell wholly
                continue
            x, bit = self.inputs(e), e.bit.ravel()
            node, depth = self.mixer.gates(x, e)
            weight = np.repeat(counts[s][e.word].astype(np.float64), 8)
            logit = np.concatenate([self._step(x[:, a:a + STEP], node[a:a + STEP], depth[a:a + STEP], bit[a:a + STEP], weight[a:a + STEP]) for a in range(0, len(bit), STEP)])
            low, over = Mixer.cells(logit)
            at = node * CELLS + low + (over > 0.5)
            self.events[0] += np.bincount(at, weights=weight, minlength=self.events.shape[1])
            self.events[1] += np.bincount(at, weights=weight * bit, minlength=self.events.shape[1])

    def _step(self, x: np.ndarray, node: np.ndarray, depth: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One update of both gates' weights, by the mean error over the tokens of a few events; the
        logits before it."""
        logit = self.mixer.mixed(x, node, depth)
        err = (bit - squash(logit)) * weight
        for table, square, gate in ((self.mixer.by_node, self.squares[0], node), (self.mixer.by_depth, self.squares[1], depth)):
            n = np.maximum(np.bincount(gate, weights=weight, minlength=len(table)), 1e-9)
            slope = np.stack([np.bincount(gate, weights=err * x[k], minlength=len(table)) for k in range(CONTEXTS)], axis=1) / n[:, None]
            square += slope**2
            table += RATE * slope / np.sqrt(square + 1e-6)
        return logit

    def result(self) -> np.ndarray:
        """Weights times tokens, tokens, and the events of the map: what lanes add up."""
        m = self.mixer
        return np.concatenate([m.by_node.ravel() * self.tokens, m.by_depth.ravel() * self.tokens, [self.tokens], self.events.ravel()])


def _adopt(mixer: Mixer, total: np.ndarray) -> None:
    """Set a mixer's weights and map from the sum of all lanes."""
    a, b = mixer.by_node.size, mixer.by_node.size + mixer.by_depth.size
    if total[b]:
        mixer.by_node, mixer.by_depth = (total[:a] / total[b]).reshape(mixer.by_node.shape), (total[a:b] / total[b]).reshape(mixer.by_depth.shape)
        n, ones = total[b + 1:].reshape(2, 256, CELLS)
        mixer.map = (ones + CELL_PRIOR * mixer.map) / (n + CELL_PRIOR)


#: The table of counts moves in so many ranges.
RANGES = 16


def _units_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, sizes, heads, counts) of the units of a vocabulary row that were trained."""
    data, sizes, heads, counts = np.frombuffer(row["words"], np.uint8), np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["heads"], np.int64), np.frombuffer(row["counts"], np.int64)
    keep = counts > 0
    word, head = keep[:len(sizes)], keep[len(sizes):]
    return data[np.repeat(word, sizes)], sizes[word], heads[head], counts[keep]


def _count_slots(batches: Iterator[pa.RecordBatch], slots: Slots) -> Iterator[pa.RecordBatch]:
    """The bit counts of a partition's training tokens, in ranges of slots."""
    n = None
    for rows in _runs(batches, "bucket"):
        *units, counts = _units_of(rows[0])
        for s, e in Events.of_units(*units):
            n = np.zeros(2 * slots.size) if n is None else n
            weight = np.repeat(counts[s][e.word].astype(np.float64), 8)
            for own in slots.of(e) + e.bit.ravel().astype(np.int64) * slots.size:
                np.add.at(n, own, weight)
    if n is not None:
        n = n.reshape(2, -1)
        for r, cut in enumerate(np.array_split(np.arange(slots.size), RANGES)):
            yield _range(r, n[:, cut[0]:cut[-1] + 1] if len(cut) else n[:, :0])


def _range(r: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"r": pa.array([r], pa.int32()), "n": pa.array([zlib.compress(counts.astype(np.int64).tobytes(), 1)], pa.binary())})


def _add_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by range, one row at a time; rows come sorted by range."""
    last, total = None, None
    for batch in batches:
        for r, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(zlib.decompress(n.as_py()), np.int64)
            if r != last and last is not None:
                yield _range(last, total)
            total = own if r != last else total + own
            last = r
    if last is not None:
        yield _range(last, total)


def train(vocabulary: DataFrame) -> Mixer:
    """The model: bit counts, then weights and map, all from all training tokens. Only arrays whose size
    ``SLOT_BITS`` and ``LANES`` bound come to the driver and go out again."""
    context = vocabulary.sparkSession.sparkContext
    size = int(vocabulary.agg(F.sum("n_bytes")).first()[0] or 0)
    slots = Slots(tuple(min(most, max(12, (8 * size).bit_length())) for most in SLOT_BITS))  # a slot for every bit of a unit
    lanes = min(LANES, max(1, size // LANE_BYTES))
    dealt = vocabulary.select(F.pmod("bucket", F.lit(lanes)).alias("lane"), "bucket", "words", "sizes", "heads", "counts").repartition(lanes, "lane").sortWithinPartitions("lane", "bucket")
    counted = dealt.mapInArrow(lambda batches: _count_slots(batches, slots), "r int, n binary")
    ranges = counted.repartition(RANGES, "r").sortWithinPartitions("r").mapInArrow(_add_ranges, "r int, n binary").collect()
    mixer = Mixer(slots, np.zeros(slots.size, np.float32))
    if not ranges:
        return mixer
    parts = [np.frombuffer(zlib.decompress(row["n"]), np.int64).reshape(2, -1).astype(np.float32) for row in sorted(ranges, key=lambda row: row["r"])]
    zeros, ones = (np.concatenate([p[k] for p in parts]) for k in range(2))
    shared = context.broadcast((zeros, ones))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, own = None, None
        for rows in _runs(batches, "bucket"):
            if rows[0]["lane"] != lane:
                if own is not None:
                    yield _vector(lane, own.result())
                lane, own = rows[0]["lane"], Learner(slots, *shared.value)
            own.learn(*_units_of(rows[0]))
        if own is not None:
            yield _vector(lane, own.result())

    learned = sorted(dealt.mapInArrow(learn, "lane int, n binary").collect(), key=lambda row: row["lane"])
    _adopt(mixer, np.sum([np.frombuffer(row["n"], np.float64) for row in learned], axis=0))
    shared.unpersist()
    mixer.logit = np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))
    return mixer


def _vector(lane: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"lane": pa.array([lane], pa.int32()), "n": pa.array([values.tobytes()], pa.binary())})


# ---- scores

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
_ANSWER = "block long, first_word long, counts binary, word_logs binary, first_head long, head_logs binary"


def _tables(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """The documents of all blocks, the vocabulary, and the number of buckets."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = max(BUCKETS, 1 << (base.count() // BUCKET_DOCS).bit_length())
    rows = base.mapInArrow(lambda batches: _blocks(batches, buckets), _BLOCKS)
    texts, units = materialize_split(rows, "lm-blocks", F.col("bucket") < 0)
    names = lambda columns: [x.split()[0] for x in columns.split(", ")]
    dealt = units.select("block", "bucket", *names(_UNITS)).repartition("bucket").sortWithinPartitions("bucket")
    vocabulary = materialize(dealt.mapInArrow(_vocabulary, _VOCAB), "lm-vocabulary")
    discard(units)
    return texts, vocabulary, buckets


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: token counts, the unigram base score, the model's log10 probability,
    and its bits per byte of the text."""
    texts, vocabulary, buckets = _tables(docs, id_col, text_col)
    size = vocabulary.agg(F.sum("n_tokens"), F.sum("n_types")).first()
    n_tokens, n_types = int(size[0] or 0), int(size[1] or 0)
    mixer = docs.sparkSession.sparkContext.broadcast(train(vocabulary))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "bucket"):
            row, out = rows[0], []
            data, sizes, heads, counts = (np.frombuffer(row[c], t) for c, t in (("words", np.uint8), ("sizes", np.int32), ("heads", np.int64), ("counts", np.int64)))
            logs, places = mixer.value.score_units(data, sizes, heads).astype(np.float32), _unpacked(row["places"])
            word, head = np.split(places, [sum(row["n_words"])])
            a = b = 0
            for block, first_word, n, first_head, m in zip(*(row[c] for c in ("blocks", "first_words", "n_words", "first_heads", "n_heads")), strict=True):
                own, spelt = word[a:a + n], head[b:b + m] + len(sizes)
                a, b = a + n, b + m
                out.append({"block": block, "first_word": first_word, "counts": zlib.compress(counts[own].tobytes(), 1), "word_logs": logs[own].tobytes(), "first_head": first_head, "head_logs": logs[spelt].tobytes()})
            yield pa.RecordBatch.from_pylist(out, _shape(_ANSWER))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "block"):
            yield _scored(rows, n_tokens, n_types, buckets)

    answers = vocabulary.drop("n_tokens", "n_types", "n_bytes").mapInArrow(answer, _ANSWER)
    both = texts.drop("bucket", "first_word", "first_head").unionByName(answers, allowMissingColumns=True).repartition("block").sortWithinPartitions("block")
    found = materialize(both.mapInArrow(merge, RESULT), "lm-scores")
    for table in (texts, vocabulary):
        discard(table)
    mixer.unpersist()
    return found


def _scored(rows: list[dict], n_tokens: int, n_types: int, buckets: int) -> pa.RecordBatch:
    """The documents of one block, from their numbers of words and the answers for its units."""
    text = next(r for r in rows if r["docs"] is not None)
    answers = [r for r in rows if r["docs"] is None]
    joined = lambda column, first, kind, open_=bytes: np.frombuffer(b"".join(open_(r[column]) for r in sorted(answers, key=lambda r: r[first])), kind)
    counts = joined("counts", "first_word", np.int64, zlib.decompress)
    logs = joined("word_logs", "first_word", np.float32).astype(np.float64)
    head_logs = joined("head_logs", "first_head", np.float32).astype(np.float64)
    mark, tokens = np.split(_unpacked(text["tokens"]), [1])
    mark, edges = int(mark[0]), np.frombuffer(zlib.decompress(text["edges"]), np.int64)
    n_words = np.array(text["n_words"], np.int64)
    ends, n_docs = np.cumsum(n_words), len(n_words)
    # added up document by document: differences of long running sums would lose digits
    each = lambda values: np.array([values[b - n:b].sum() for b, n in zip(ends, n_words, strict=True)]).reshape(n_docs)
    base = np.log10((counts + 0.5) / (n_tokens + 0.5 * (n_types + 1)))
    heads, head = np.unique(_heads(tokens, mark, n_words, edges), return_inverse=True)
    order, _ = _dealt(_head_hashes(heads), buckets)
    by_head = np.empty(len(heads))
    by_head[order] = head_logs
    spelt, upto = by_head[head], np.cumsum(n_words + 1)
    score = each(logs[tokens]) + logs[mark] + np.array([spelt[b - n - 1:b].sum() for b, n in zip(upto, n_words, strict=True)]).reshape(n_docs)
    n_bytes = np.maximum(np.array(text["n_bytes"], np.float64), 1)
    return pa.record_batch({
        "doc_id": pa.array(text["docs"], pa.int64()), "held_out": pa.array(text["held"], pa.bool_()), "n_tokens": pa.array(n_words + 1),
        "n_known": pa.array(each((counts > 0)[tokens]).astype(np.int64) + int(counts[mark] > 0)), "train_tokens": pa.array(np.full(n_docs, n_tokens, np.int64)),
        "base_score": pa.array((each(base[tokens]) + base[mark]).astype(np.float64)), "score": pa.array(score.astype(np.float64)), "bits_per_byte": pa.array(-score * np.log2(10) / n_bytes)})


def train_from(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Mixer:
    """Only the model of the training folds of ``docs``, for scoring other texts."""
    texts, vocabulary, _ = _tables(docs, id_col, text_col)
    mixer = train(vocabulary)
    for table in (texts, vocabulary):
        discard(table)
    return mixer
