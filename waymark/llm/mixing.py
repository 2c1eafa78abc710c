"""Language-model scores by online logistic context mixing over hashed contexts.

A text is a sequence of words and a closing end. Every token becomes binary decisions,
each predicted by several hashed-context bit predictors whose log odds a gate's weights mix:

1. If this text has had the last two words before: is the token what followed them then?
   (Kinds by the length of the repetition so far.)
2. Otherwise, the steps down a Huffman tree over cells. A frequent word has a cell of its
   own, others share cells of about equal weight, and one cell holds rare and unknown words.
   Predictors: the node; the node with the last word, with the last two words, and with
   the cells of the last two words. What remains is the word's share of its cell.
3. A word that training hasn't seen is spelt, byte by byte and bit by bit, by predictors of
   the place in the word, the last one to four bytes, and the whole beginning of the word.

The weights are learnt online over every decision of every training text (in 2) and
every distinct training word (in 3), each predicted before it is counted. Within a text, a Bayesian
mixture of experts follows how far the text repeats its own words.

Counts of words are exact and grow with the corpus: the most frequent words (a bounded
number of rows) go to every task, the others are joined. Hashed tables grow up to a
size that memory allows. A text is read in windows of bounded size.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.bits import Learner, Mixer, Shape, merged, slot_bits
from waymark.llm.store import lookup_join, materialise, small_batches, text_or_empty
from waymark.llm.words import Window, Words, lowered, mix, split_words, windows, without_nulls

#: Text of a window; repetitions within a text are looked for in one window.
WINDOW_BYTES = 1 << 20
#: Bound of the words that every task holds, the most frequent ones.
HEAD_WORDS = 1 << 20
CELLS = 128
#: Largest tables, as powers of two: last word, last two words, cells of the last two; and the six of spelling.
WORD_BITS = (22, 22, 21)
SPELLING_BITS = (14, 16, 18, 20, 21, 23)
#: Experts of the mixture within a text: the weight of the text's own words so far.
EXPERTS = (0.0, 0.01, 0.03, 0.1, 0.25, 0.5)
#: Training tokens and distinct words of a learner's task, at least, and the most tasks of a training pass.
TASK_TOKENS, TASK_WORDS, TASKS = 2_000_000, 200_000, 16_384
_MATCHES, _DEPTHS, _LOT = 6, 6, 8192
#: Tokens that are rated at a time; scores don't depend on it.
_RATED = 2048
#: The kind of a decision on a repetition, by the hits before it.
_RUNS = np.array([0, 1, 2, 3, 3, 4, 4, 4, 4, 5], np.int32)
_END = np.uint64(0x2545F4914F6CDD1D)
_START = np.uint64(0x9FB21C651E98DF25)
_K1, _K2, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_A32, _B32 = np.uint32(0x85EBCA6B), np.uint32(0x9E3779B1)
_LN10 = math.log(10)


@dataclass
class Tokens:
    """Tokens of one window: words of several texts, each closed by an end (unless it goes on)."""

    first: np.ndarray
    hashes: np.ndarray
    one: np.ndarray
    two: np.ndarray
    words: Words
    word_at: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def tokens_of(window: Window, before: tuple[np.uint64, np.uint64] = (_START, _START)) -> Tokens:
    """``before``: the last two words, for a window that goes on from another. ``word_at`` is -1 at ends."""
    words = split_words(window.texts, window.at, window.to)
    sizes = np.diff(words.first)
    if window.ends:
        hashes = np.insert(words.hashes, words.first[1:], _END)
        word_at = np.insert(np.arange(len(words.hashes)), words.first[1:], -1)
        sizes = sizes + 1
    else:
        hashes, word_at = words.hashes, np.arange(len(words.hashes))
    first = np.concatenate([[0], np.cumsum(sizes)])
    one, two = np.empty_like(hashes), np.empty_like(hashes)
    one[1:], two[2:] = hashes[:-1], hashes[:-2]
    if len(hashes):
        heads = first[:-1][sizes > 0]
        seconds = first[:-1][sizes > 1] + 1
        one[heads], two[heads], two[seconds] = _START, _START, _START
        if not window.begins:
            one[0], two[0] = before
            two[1:2] = before[0]
    return Tokens(first, hashes, one, two, words, word_at)


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes sorted by (part of the key's bits, index), and whether each has the key of the one before it."""
    bits = np.uint64(max(1, int(len(key)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.sort((mix(key) & ~low) | np.arange(len(key), dtype=np.uint64))
    same = np.concatenate([[False], (packed[1:] ^ packed[:-1]) <= low]) if len(packed) else np.zeros(0, bool)
    return (packed & low).astype(np.int64), same


def repeats(t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: whether the text has had the last two words, whether their follower comes again, and the run of such hits before."""
    owner = t.owner().astype(np.uint64)
    order, same = _grouped((t.one * _K1 + t.two) * _K2 + owner)
    earlier = np.full(len(order), -1)
    earlier[order[1:]] = np.where(same[1:], order[:-1], -1)
    has = earlier >= 0
    hit = has & (t.hashes[earlier] == t.hashes)
    at = np.arange(len(order))
    broken = np.maximum.accumulate(np.where(hit, -1, at))
    return has, hit, at - 1 - np.concatenate([[-1], broken[:-1]])[: len(at)]


def _times(t: Tokens) -> np.ndarray:
    """How often each token has occurred before in its text."""
    order, same = _grouped(t.hashes * _K1 + t.owner().astype(np.uint64))
    at = np.arange(len(order))
    out = np.empty(len(order), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(same, 0, at)) if len(at) else 0
    return out


@dataclass
class Head:
    """The most frequent words in an open-addressed table: count and cell by hash."""

    keys: np.ndarray
    count: np.ndarray
    cell: np.ndarray
    shift: np.uint64
    reach: int

    @staticmethod
    def of(hashes: np.ndarray, count: np.ndarray, cell: np.ndarray) -> Head:
        order = np.argsort(hashes)
        hashes, count, cell = hashes[order], count[order], cell[order]
        bits = max(1, int(2 * len(hashes)).bit_length())
        home = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        at = np.arange(len(hashes))
        place = np.maximum.accumulate(home - at) + at if len(at) else at
        size = max(1 << bits, int(place.max(initial=0)) + 1) + 1
        keys, counts, cells = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.full(size, -1, np.int16)
        keys[place], counts[place], cells[place] = hashes, count, cell
        return Head(keys, counts, cells, np.uint64(64 - bits), int((place - home).max(initial=0)) + 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the table, -1 for words that aren't in it."""
        out = np.full(len(hashes), -1)
        live = np.arange(len(hashes))
        at, looked = (hashes >> self.shift).astype(np.int64), hashes
        for step in range(self.reach):
            key = self.keys.take(at + step, mode="clip")
            hit = key == looked
            out[live[hit]] = at[hit] + step
            on = ~hit & (key != 0)
            if not on.any():
                break
            live, at, looked = live[on], at[on], looked[on]
        return out


@dataclass
class Lexicon:
    """Words, cells, and the tree over cells, from exact counts of the training texts."""

    head: Head
    total: int
    distinct: int
    discount: float
    #: By cell: natural logarithm of its discounted weight; the last cell is that of rare and unknown words.
    log_weight: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    shape: Shape
    log_unknown: float = field(init=False)
    #: The cells' paths one after another, each behind a place for a decision on a repetition: where they start, and nodes, bits and kinds.
    path: np.ndarray = field(init=False)
    steps: tuple[np.ndarray, np.ndarray, np.ndarray] = field(init=False)

    def __post_init__(self):
        cell = np.repeat(np.arange(len(self.length)), self.length + 1)
        self.path = np.cumsum(self.length + 1) - self.length
        depth = np.maximum(np.arange(len(cell)) - self.path[cell], 0)
        self.steps = self.node[cell, depth], self.bit[cell, depth], np.minimum(depth, _DEPTHS - 1).astype(np.int32) + np.int32(_MATCHES)
        free = self.discount * self.distinct
        self.log_unknown = math.log(free) - float(self.log_weight[-1]) if self.distinct else 0.0

    def cells(self, place: np.ndarray) -> np.ndarray:
        """Cells of tokens by their places in the head; others are in the last cell."""
        cell = self.head.cell.take(place)
        return np.where(place >= 0, cell, len(self.length) - 1).astype(np.int32)


def huffman(weights: list[float]) -> list[list[tuple[int, int]]]:
    """Each leaf's path of (inner node, bit) from the root; ties go by number."""
    paths: list[list[tuple[int, int]]] = [[] for _ in weights]
    heap = [(w, i, [i]) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    made = 0
    while len(heap) > 1:
        (a, i, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, leaves in enumerate((left, right)):
            for leaf in leaves:
                paths[leaf].append((made, bit))
        made += 1
        heapq.heappush(heap, (a + b, i, left + right))
    return [p[::-1] for p in paths]


def make_lexicon(hashes: np.ndarray, count: np.ndarray, total: int, distinct: int, discount: float, cells: int = CELLS) -> Lexicon:
    """``hashes`` and ``count``: the most frequent words; the totals are those of all training tokens."""
    order = np.lexsort((hashes, -np.floor(np.log2(np.maximum(count, 1)))))
    hashes, count = hashes[order], count[order].astype(np.int64)
    middle = np.cumsum(count) - count / 2
    drawn = np.floor(middle * cells / max(1, total)).astype(np.int64)
    cell = np.unique(drawn, return_inverse=True)[1] if len(drawn) else drawn
    n = int(cell.max(initial=-1)) + 1
    weight = np.bincount(cell, count - discount, n) if n else np.zeros(0)
    rest = total - count.sum() - discount * (distinct - len(count)) + discount * distinct
    weight = np.append(weight, max(float(rest), 1e-9) if distinct else 1.0)
    paths = huffman(weight.tolist())
    longest = max(1, max(map(len, paths)))
    node, bit = np.zeros((len(paths), longest), np.int32), np.zeros((len(paths), longest), np.uint8)
    for i, path in enumerate(paths):
        for j, (a, b) in enumerate(path):
            node[i, j], bit[i, j] = a + _MATCHES, b
    events = total * 7
    bits = (12, *(slot_bits(events, 12, b) for b in WORD_BITS))
    return Lexicon(
        Head.of(hashes, count, cell.astype(np.int16)), total, distinct, discount, np.log(weight),
        np.array([len(p) for p in paths]), node, bit, Shape(bits, (0.4, 0.4, 0.3, 0.4), _MATCHES + _DEPTHS, (1, 2)),
    )


@dataclass
class Lot:
    """The binary decisions of some tokens, in their order: each one's token, slots in the predictors' tables, kind and bit."""

    tokens: slice
    token: np.ndarray
    slots: list[np.ndarray]
    kind: np.ndarray
    bit: np.ndarray


@dataclass
class Decisions:
    """What the binary decisions of a window's tokens are made from; only those of a lot of tokens are held at a time."""

    count: np.ndarray
    start: np.ndarray
    has: np.ndarray
    hit: np.ndarray
    run: np.ndarray
    contexts: tuple[np.ndarray, np.ndarray, np.ndarray]
    lexicon: Lexicon

    def lots(self, size: int = _LOT) -> Iterator[Lot]:
        nodes, came, kinds = self.lexicon.steps
        for a in range(0, len(self.count), size):
            part = slice(a, min(a + size, len(self.count)))
            count, has = self.count[part], self.has[part]
            first = np.cumsum(count) - count
            token = np.repeat(np.arange(len(count)), count)
            at = (self.start[part] - first).take(token, mode="clip")
            at += np.arange(len(token))
            node, bit, kind = nodes.take(at, mode="clip"), came.take(at, mode="clip"), kinds.take(at, mode="clip")
            match = first[has]
            kind[match] = node[match] = _RUNS[np.minimum(self.run[part][has], len(_RUNS) - 1)]
            bit[match] = self.hit[part][has]
            turned = (node.view(np.uint32) + np.uint32(1)) * _A32
            slots = [node]
            for context, bits in zip(self.contexts, self.lexicon.shape.bits[1:], strict=True):
                slot = context[part].take(token, mode="clip")
                slot += turned
                slot *= _B32
                slot >>= np.uint32(32 - bits)
                slots.append(slot)
            yield Lot(part, token, slots, kind, bit)


def decisions(t: Tokens, lexicon: Lexicon, cell: np.ndarray) -> tuple[Decisions, np.ndarray]:
    """The decisions, and which tokens were told by a repetition alone."""
    has, hit, run = repeats(t)
    # a token's first decision is about the repetition, if it has one; the others go down the tree
    count = np.where(hit, 0, lexicon.length.take(cell)) + has
    start = lexicon.path.take(cell) - has
    before = np.concatenate([[0], cell[:-1] + 1]).astype(np.uint32)[: len(cell)]
    before[t.one == _START] = 0
    two = np.concatenate([[0], before[:-1]]).astype(np.uint32)[: len(cell)]
    two[t.two == _START] = 0
    high = lambda h: (h >> np.uint64(32)).astype(np.uint32)
    contexts = (high(t.one), high(mix(t.one * _K1 + t.two)), (before * np.uint32(1 << 12) + two) * np.uint32(0xC2B2AE35))
    return Decisions(count, start, has, hit, run, contexts, lexicon), hit


class _Reader:
    """Tokens window by window; the last two words go along from one window of a text to the next."""

    def __init__(self) -> None:
        self._last = (_START, _START)

    def read(self, texts: pa.Array) -> Iterator[tuple[Window, Tokens]]:
        for window in windows(without_nulls(texts), WINDOW_BYTES):
            t = tokens_of(window, self._last)
            recent = [*((_START, _START) if window.begins else self._last[::-1]), *t.hashes[-2:]]
            self._last = (recent[-1], recent[-2])
            yield window, t


# ---- words of the training texts


def count_words(texts: DataFrame) -> DataFrame:
    """hash, c, word of every distinct token of a column of texts; the end is an empty word."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate([h for h, _, _ in held])
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        n = np.bincount(back, np.concatenate([n for _, n, _ in held])).astype(np.int64)
        names = pa.concat_arrays([w for _, _, w in held]).take(pa.array(where))
        whole = pa.record_batch([pa.array(distinct.view(np.int64)), pa.array(n), names], names=["hash", "n", "word"])
        for at in range(0, len(distinct), 1 << 16):
            yield whole.slice(at, 1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0
        for batch in batches:
            for window in windows(without_nulls(batch.column(0)), WINDOW_BYTES):
                words = split_words(window.texts, window.at, window.to)
                fresh, where, n = np.unique(words.hashes, return_index=True, return_counts=True)
                held.append((fresh, n, lowered(words, where)))
                size, ends = size + len(fresh), ends + (window.to - window.at) * window.ends
                if size > 1 << 19:
                    yield from flush(held)
                    held, size = [], 0
        if ends:
            held.append((np.array([_END]), np.array([ends]), pa.array([b""], pa.binary())))
        if held:
            yield from flush(held)

    found = texts.mapInArrow(run, "hash long, n long, word binary")
    return materialise(found.groupBy("hash").agg(F.sum("n").alias("c"), F.max("word").alias("word")), "vocabulary", compression="zstd")


def read_lexicon(vocabulary: DataFrame, head_words: int = HEAD_WORDS) -> tuple[Lexicon, int]:
    """The lexicon and the count from which on words are in its head (at most ``head_words``)."""
    grade = F.floor(8 * F.log2("c")).cast("int")
    grades = sorted(vocabulary.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s"), F.min("c").alias("c")).collect(), reverse=True)
    once, twice = (next((r["n"] for r in grades if r["c"] == k), 0) for k in (1, 2))
    distinct, total = sum(r["n"] for r in grades), sum(r["s"] for r in grades)
    least, rows = (grades[0]["c"] + 1 if grades else 1), 0
    for r in grades:
        rows += r["n"]
        if rows > head_words:
            break
        least = r["c"]
    head = vocabulary.where(F.col("c") >= least).select("hash", "c").toArrow()
    discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
    hashes = head.column("hash").to_numpy().view(np.uint64)
    return make_lexicon(hashes, head.column("c").to_numpy(), total, distinct, discount), int(least)


def learn_words(texts: DataFrame, lexicon: Lexicon) -> Mixer:
    """The mixer of the decisions on words, learnt online over all of ``texts``."""
    context = texts.sparkSession.sparkContext
    shared = context.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, reader = shared.value, _Reader()
        learner = Learner(known.shape)
        for batch in batches:
            for _, t in reader.read(batch.column(0)):
                found, _ = decisions(t, known, known.cells(known.head.find(t.hashes)))
                for lot in found.lots():
                    learner.step(lot.slots, lot.kind, lot.bit)
        yield from learner.batches()

    tasks = min(TASKS, max(context.defaultParallelism, lexicon.total // TASK_TOKENS))
    mixer = merged(texts.coalesce(tasks).mapInArrow(run, "block int, data binary"), lexicon.shape)
    shared.unpersist()
    return mixer


# ---- spelling of unknown words


@dataclass
class Spelling:
    """Bytes of many words with their closing spaces, and per byte the hashed contexts."""

    data: np.ndarray
    word: np.ndarray
    contexts: list[np.ndarray]
    kind: np.ndarray

    def slots(self, bit: int, sizes: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
        """Each predictor's slot for the bit of every byte, and the bits."""
        partial = (np.uint64(1) << np.uint64(bit)) | (self.data >> np.uint64(8 - bit))
        turned = partial * _K1
        found = [((c + turned) * _K2) >> np.uint64(64 - b) for c, b in zip(self.contexts, sizes, strict=True)]
        return found, ((self.data >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.uint8)


def spell(words: list[bytes]) -> Spelling:
    joined = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    first = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(joined)) - first[word]
    contexts = [mix(np.minimum(place, 15).astype(np.uint64) + np.uint64(1))]
    recent = np.zeros(len(joined), np.uint64)
    for order in range(1, 5):
        before = np.zeros(len(joined), np.uint64)
        before[order:] = joined[:-order] + np.uint64(1)
        before[place < order] = 0
        recent = recent | (before << np.uint64(9 * (order - 1)))
        contexts.append(mix(recent * np.uint64(8) + np.uint64(order)))
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(joined), _B)]))
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(joined), _INVERSE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((joined + np.uint64(1)) * powers[:-1])])
    start = first[word]
    contexts.append(mix((sums[:-1] - sums[start]) * inverse[start] + place.astype(np.uint64)))
    return Spelling(joined, word, contexts, np.minimum(place, 3).astype(np.int32))


def _lots(words: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, w in enumerate(words):
        if size and size + len(w) + 1 > most:
            yield at, i
            at, size = i, 0
        size += len(w) + 1
    if at < len(words):
        yield at, len(words)


def spelling_shape(distinct: int) -> Shape:
    return Shape(tuple(slot_bits(distinct * 64, 12, b) for b in SPELLING_BITS), (0.4, 0.4, 0.4, 0.3, 0.2, 0.08), 8 * 4, (4, 5))


def learn_spelling(vocabulary: DataFrame, distinct: int) -> Mixer:
    """The mixer of spelling, learnt online over every distinct word of the training texts, each once."""
    shape = spelling_shape(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(shape)
        for batch in batches:
            teach(learner, batch.column(0).to_pylist())
        yield from learner.batches()

    tasks = min(TASKS, max(vocabulary.sparkSession.sparkContext.defaultParallelism, distinct // TASK_WORDS))
    return merged(vocabulary.select("word").coalesce(tasks).mapInArrow(run, "block int, data binary"), shape)


def teach(learner: Learner, words: list[bytes], most: int = 1 << 15) -> None:
    for at, to in _lots(words, most):
        lot = spell(words[at:to])
        for bit in range(8):
            slots, bits = lot.slots(bit, learner.shape.bits)
            learner.step(slots, lot.kind * 8 + np.int32(bit), bits)


def spelt(mixer: Mixer, words: list[bytes]) -> np.ndarray:
    """Each word's natural log probability, its closing space included."""
    out = np.zeros(len(words))
    for at, to in _lots(words, 1 << 17):
        lot = spell(words[at:to])
        cost = np.zeros(len(lot.data))
        for bit in range(8):
            slots, bits = lot.slots(bit, mixer.shape.bits)
            cost += mixer.cost(slots, lot.kind * 8 + np.int32(bit), bits)
        out[at:to] = -np.bincount(lot.word, cost, to - at)
    return out


# ---- scores


@dataclass
class Model:
    lexicon: Lexicon
    words: Mixer
    spelling: Mixer


def fit(texts: DataFrame, head_words: int = HEAD_WORDS) -> tuple[Model, DataFrame]:
    """The model of a column of texts, and the counts (hash, c) of the words that are not in its head."""
    vocabulary = count_words(texts)
    lexicon, least = read_lexicon(vocabulary, head_words)
    model = Model(lexicon, learn_words(texts, lexicon), learn_spelling(vocabulary, lexicon.distinct))
    return model, vocabulary.where(F.col("c") < least).select("hash", "c")


@dataclass
class Part:
    """Sums of one text over its windows; rare words are still to be looked up."""

    tokens: int = 0
    known: int = 0
    base: float = 0.0
    rated: np.ndarray = field(default_factory=lambda: np.zeros(len(EXPERTS)))
    rare: dict[int, list] = field(default_factory=dict)


def rate(model: Model, window: Window, t: Tokens, held_out: np.ndarray, parts: list[Part]) -> None:
    """Add a window to its texts' parts.

    ``rare`` gets, for each word out of the head: how often it occurs, how often the
    experts without and with the text's own words need its probability (the latter
    code a repeated rare word by the text alone), and its spelling, where training may lack it.
    """
    lex = model.lexicon
    place = lex.head.find(t.hashes)
    cell = lex.cells(place)
    found, hit = decisions(t, lex, cell)
    path = np.zeros(len(cell))
    for lot in found.lots(_RATED):
        path[lot.tokens] -= np.bincount(lot.token, model.words.cost(lot.slots, lot.kind, lot.bit), lot.tokens.stop - lot.tokens.start)
    count = np.where(place >= 0, lex.head.count.take(place), 0)
    inside = place >= 0
    share = np.log(np.maximum(count - lex.discount, 1e-300)) - lex.log_weight[cell]
    told = inside & ~hit
    log_p = path + np.where(told, share, 0)
    times, owner = _times(t), t.owner()
    since = np.arange(len(cell)) - t.first[owner]
    own = np.log(np.maximum(times, 1)) - np.log(np.maximum(since, 1))
    texts = len(t.first) - 1
    plain = np.bincount(owner, log_p, texts)
    mixes = np.bincount(owner, ~hit & (since > 0), texts)
    again = np.flatnonzero((times > 0) & ~hit)
    whose, own, here, rare = owner[again], own[again], log_p[again], ~inside[again]
    rated = [plain if not w else plain + mixes * math.log1p(-w) + np.bincount(whose, _gain(here + math.log1p(-w), own + math.log(w), rare), texts) for w in EXPERTS]
    base = np.where(inside, np.log10((count + 1) / (lex.total + 1.0 * (lex.distinct + 1))), 0)
    sums = [*(np.bincount(owner, x, texts) for x in (base, inside)), *rated]
    for i in range(texts):
        part = parts[i]
        part.tokens += int(t.first[i + 1] - t.first[i])
        part.base += sums[0][i]
        part.known += int(sums[1][i])
        part.rated += np.array([s[i] for s in sums[2:]])
    out = np.flatnonzero(~inside)
    if not len(out):
        return
    need = (held_out[owner[out]]) & (lex.distinct > 0) | (lex.distinct == 0)
    spelling = np.zeros(len(out))
    asked = np.flatnonzero(need)
    if len(asked):
        names = _names(t, out[asked])
        fresh, back = np.unique(t.hashes[out[asked]], return_inverse=True)
        first = np.zeros(len(fresh), np.int64)
        first[back[::-1]] = np.arange(len(asked))[::-1]
        spelling[asked] = spelt(model.spelling, [names[i] for i in first])[back]
    once = ~hit[out] & (times[out] == 0)
    for i, h, miss, new, s in zip(owner[out].tolist(), t.hashes[out].view(np.int64).tolist(), (~hit[out]).tolist(), once.tolist(), spelling.tolist(), strict=True):
        row = parts[i].rare.setdefault(h, [0, 0, 0, s])
        row[0] += 1
        row[1] += miss
        row[2] += new


def _gain(path: np.ndarray, own: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """What the text's own words add to a token's path; rare words are coded by them alone."""
    return np.where(rare, own, np.logaddexp(path, own)) - path


def _names(t: Tokens, at: np.ndarray) -> list[bytes]:
    word = t.word_at[at]
    real = np.flatnonzero(word >= 0)
    names = [b""] * len(at)
    for i, name in zip(real.tolist(), lowered(t.words, word[real]).to_pylist(), strict=True):
        names[i] = name
    return names


_EXPERT = [f"e{i}" for i in range(len(EXPERTS))]
_PART = "`row` long, held_out boolean, size long, n_tokens long, n_known long, base double, " + ", ".join(f"{e} double" for e in _EXPERT)
_RARE = "hashes array<long>, n array<int>, misses array<int>, fresh array<int>, spelt array<double>"


def _row_batch(ids: pa.Array, sizes: pa.Array, number: int, held_out: np.ndarray, parts: list[Part]) -> pa.RecordBatch:
    held = [[[k, *v] for k, v in p.rare.items()] for p in parts]
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(h) for h in held])]), pa.int32())
    flat = list(zip(*[r for h in held for r in h], strict=True)) or [[]] * 5
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    arrays = [
        ids, pa.array(number + np.arange(len(parts))), pa.array(held_out), sizes.cast(pa.int64()), pa.array([p.tokens for p in parts], pa.int64()),
        pa.array([p.known for p in parts], pa.int64()), pa.array([p.base for p in parts], pa.float64()),
        *[pa.array([p.rated[e] for p in parts], pa.float64()) for e in range(len(EXPERTS))],
        *[pa.ListArray.from_arrays(offsets, pa.array(c, k)) for c, k in zip(flat, kinds, strict=True)],
    ]
    names = ["id", *(p.split()[0].strip("`") for p in f"{_PART}, {_RARE}".split(", "))]
    return pa.record_batch(arrays, names=names)


SCORES = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def score_documents(docs: DataFrame, train: str = "true", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, over its whole text: token counts, base score, the model's log10 probability and bits per byte.

    ``train`` is an SQL condition on the column ``id``; documents that it is false for
    are held out, and those it is null for train. Null texts count as empty: one token, the end
    (their bits per byte are those of one byte). A very long text is read in windows of a megabyte,
    and repetitions are looked for within a window. Ids of any type pass through, null ones
    too. Without training documents every count is 0 and the model is untaught. An empty
    table gives an empty result; repeated rows are rows like others; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    marked = slim.select("id", "text", (~F.coalesce(F.expr(train), F.lit(True))).alias("held_out"))
    model, rest = fit(marked.where("not held_out").select("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, reader = TaskContext.get().partitionId() << 33, _Reader()
        for batch in batches:
            ids, held_out = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            parts, sizes = [], pc.binary_length(batch.column(1))
            for window, t in reader.read(batch.column(1)):
                rows = window.to - window.at
                if window.begins:
                    parts = [Part() for _ in range(rows)]
                rate(shared.value, window, t, held_out[window.row : window.row + rows], parts)
                if window.ends:
                    yield _row_batch(ids.slice(window.row, rows), sizes.slice(window.row, rows), number, held_out[window.row : window.row + rows], parts)
                    number += rows

    kind = marked.schema["id"].dataType.simpleString()
    rated = materialise(marked.mapInArrow(run, f"id {kind}, {_PART}, {_RARE}"), "rated", compression="zstd")
    shared.unpersist()
    return _finished(rated, rest, model.lexicon, id_col)


def _finished(rated: DataFrame, rest: DataFrame, lexicon: Lexicon, id_col: str) -> DataFrame:
    """Rare words get their counts by a join; then the experts' mean is taken."""
    rare = rated.where(F.size("hashes") > 0).selectExpr(
        "`row`", "inline(arrays_zip(hashes, n, misses, fresh, spelt)) as (hash, n, misses, fresh, spelt)"
    )
    counted = rare.join(rest, "hash", "left")
    weight = float(lexicon.log_weight[-1])
    rarely = F.log(F.greatest(F.col("c") - lexicon.discount, F.lit(1e-300))) - weight
    log_p = F.when(F.col("c").isNotNull(), rarely).otherwise(F.lit(lexicon.log_unknown) + F.col("spelt"))
    base = F.log10((F.coalesce("c", F.lit(0)) + 1) / (lexicon.total + 1.0 * (lexicon.distinct + 1)))
    sums = counted.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).cast("long").alias("r_known"),
        F.sum(base * F.col("n")).alias("r_base"), F.sum(log_p * F.col("misses")).alias("r_all"), F.sum(log_p * F.col("fresh")).alias("r_fresh"),
    )
    joined = lookup_join(rated.drop("hashes", "n", "misses", "fresh", "spelt"), materialise(sums, "rare"), ["row"], "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    logs = F.array(*[F.col(e) + none("r_fresh" if weight else "r_all") for e, weight in zip(_EXPERT, EXPERTS, strict=True)])
    whole = joined.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    spread = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    score = (F.col("top") + F.log(spread / len(EXPERTS))) / _LN10
    whole = whole.withColumn("score", score)
    bits = -F.col("score") * math.log2(10) / F.greatest(F.col("size"), F.lit(1))
    return whole.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("r_known", F.lit(0))).alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"), (F.col("base") + none("r_base")).alias("base_score"), "score", bits.alias("bits_per_byte"),
    )
