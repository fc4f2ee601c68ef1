"""Language-model scores of documents: an attention model on subword ids, fitted to the training fold, and a unigram base.

A text is its words and an end. Attention over the words before, each the mean of its subwords' rows, gives the class of
the next word, which is that of its first subword. Within a class, a word that occurred in training has its discounted
share of the class's tokens; what the discounts leave goes to all words by their subwords, of which the first depends on
the class, and each later one and the word's end on the slot of the subword before it. All counts are those of all
training words. So the words' probabilities after any text sum to 1 at most, and so do those of all texts.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm import attention
from locusmill.llm.common import ROW_ID, Scratch, parts_of, room, split_words, with_row_ids

FOLDS, HELD_OUT = 5, 1
#: What each word's count in its class is discounted by.
DISCOUNT = 0.75
#: Most words whose counts are sent to all workers; those of the others come by a join, to the same scores.
HOT_WORDS = 1 << 17
#: Words that a worker remembers, and their bytes; forgetting changes no result.
CACHE_WORDS, CACHE_BYTES = 300_000, 64 << 20
#: Bytes and number of the documents of pilot(), of which no score depends.
PILOT_BYTES, PILOT_DOCS = 6 << 20, 1500
#: Most frequent first subwords, and one place for all others, that tell subwords apart by what stands beside their words.
CONTEXTS = 128
#: Bytes of text whose words are counted at a time, and cells of a block of counts.
COUNT_BYTES, CELLS = 12 << 20, 1 << 18
#: Training words for each trainer, and trainers at most: by the corpus alone, so that scores don't depend on the cluster.
TRAINER_WORDS, TRAINERS = 3_000_000, 4096
#: Windows of a step, subwords after which their rows are stepped, and the trainers' rate.
STEP, ROWS_AFTER, RATE = 128, 131_072, 1e-3
#: Counts of subwords by the slot before them are smoothed by so many occurrences.
KAPPA = 5.0
BLOCK = 1 << 16


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoding of a file of ranks, and which of its tokens begin with a space."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    edge = np.zeros(max(ranks.values()) + 2, bool)
    for token, i in ranks.items():
        edge[i] = token.startswith(b" ")
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), edge


def vocabulary(path: str) -> int:
    """Subwords, and the end, which is the last number."""
    return len(encoding(path)[1])


#: White space that separates no words, but is white space to the encoding's pattern.
OTHER_SPACE = re.compile(r"[^\S \t\n\v\f\r]")


def encode_words(path: str, words: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of words, each as after a space, one after another, and how many each has.

    Many are encoded at a time, their ends being where a token begins with a space; words that hold other white space
    are encoded one by one, lest they meet their neighbours. Arrow joins them, so no word becomes a Python string.
    """
    enc, edge = encoding(path)
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.string())
    ids, counts = [], []
    for k in range(0, len(words), 5000):
        part = words.slice(k, 5000)
        text = " " + pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(part)], pa.int64()), part), " ")[0].as_py()
        own = enc.encode_to_numpy(text, disallowed_special=()).astype(np.int64) if not OTHER_SPACE.search(text) else np.zeros(0, np.int64)
        at = np.flatnonzero(edge[own])
        if len(at) != len(part):
            each = [enc.encode_ordinary(" " + w) for w in part.to_pylist()]
            own, at = np.array(sum(each, []), dtype=np.int64), np.cumsum([0, *map(len, each[:-1])])
        ids.append(own)
        counts.append(np.diff(np.append(at, len(own))))
    return np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0, np.int64), *counts])


def fold(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass
class Model:
    """All that scoring needs; its size doesn't depend on the corpus."""

    path: str
    end: int
    params: dict[str, np.ndarray]
    #: By subword: its class as the first of a word, and its slot as what stands before another.
    classes: np.ndarray
    slots: np.ndarray
    #: Log probabilities of first subwords in their class, and by slot of later ones, the word's end being the last column.
    begin: np.ndarray | None = None
    cont: np.ndarray | None = None
    #: By class: training tokens, and the share that goes to words by their subwords.
    mass: np.ndarray | None = None
    left: np.ndarray | None = None
    hot: dict[str, int] = field(default_factory=dict)
    train_tokens: int = 0
    vocabulary: int = 0


class Words:
    """Numbers of words, in the order in which they come, with their subwords; the empty word, number 0, is the end.

    The words lie in one Arrow array, in which Arrow finds those of a slice of texts.
    """

    def __init__(self, path: str, model: Model | None = None):
        self.path, self.end, self.model = path, vocabulary(path) - 1, model
        if model:
            self.hot_words, self.hot_counts = pa.array(list(model.hot), pa.string()), np.fromiter([*model.hot.values(), 0], np.float64)
        self.reset()

    def __getitem__(self, word: str) -> int:
        at = pc.index(self.names, word).as_py()
        if at < 0:
            raise KeyError(word)
        return at

    def reset(self) -> None:
        self.names, self.n = pa.array([], pa.string()), 0
        self.start, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat, self.used = np.zeros(1 << 14, np.int64), 0
        self.again = np.zeros(1 << 12, bool)  # came in a later slice, too
        if self.model:
            self.rows = np.zeros((1 << 12, attention.DIM), np.float32)
            self.first, self.within, self.hot = np.zeros(1 << 12, np.int64), np.zeros(1 << 12), np.zeros(1 << 12)  # class, log probability in it, count
        self.add(pa.array([""]))

    def forget(self) -> None:
        """Keep the end and the words that came again, if they are no more than half of what may be remembered."""
        self.again[0] = True
        keep = np.flatnonzero(self.again[: self.n])
        names = self.names.take(pa.array(keep))
        if len(keep) > CACHE_WORDS // 2 or names.nbytes > CACHE_BYTES // 2:
            self.reset()
            return
        self.flat, self.start, self.count = self.subwords(keep)
        self.names, self.n, self.used, self.again = names, len(keep), len(self.flat), np.zeros(len(keep), bool)
        if self.model:
            self.rows, self.first, self.within, self.hot = self.rows[keep], self.first[keep], self.within[keep], self.hot[keep]

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Numbers of the words of texts, each text's followed by the end, and how many there are of each; the distinct
        words, and the place of each word among them (-1: the end)."""
        if self.n > CACHE_WORDS or self.names.nbytes > CACHE_BYTES:
            self.forget()
        flat, lens = split_words(texts, lower=True)
        coded = flat.dictionary_encode()
        names = coded.dictionary.cast(pa.string())
        known = places_in(names, self.names).astype(np.int64)
        new = np.flatnonzero(known < 0)
        self.again[known[known >= 0]] = True
        if len(new):
            known[new] = np.arange(self.n, self.n + len(new))
            self.add(names.take(pa.array(new)))
        lens = lens + 1
        out, at = np.zeros(int(lens.sum()), np.int64), np.full(int(lens.sum()), -1, np.int64)
        here = np.ones(len(out), bool)
        here[np.cumsum(lens) - 1] = False
        at[here] = coded.indices.to_numpy()
        out[here] = known[at[here]]
        return out, lens, names, at

    def add(self, new: pa.Array) -> None:
        n, ends = self.n + len(new), self.n == 0
        self.names = pa.concat_arrays([self.names, new])
        ids, counts = (np.array([self.end]), np.array([1])) if ends else encode_words(self.path, new)
        for name in ("start", "count", "again", *(("rows", "first", "within", "hot") if self.model else ())):
            setattr(self, name, room(getattr(self, name), n))
        self.flat = room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        own = np.cumsum(counts) - counts
        self.start[self.n : n], self.count[self.n : n] = own + self.used, counts
        if self.model:
            m = self.model
            first = m.classes[ids[own]]
            lp = m.cont[m.slots[np.roll(ids, 1)], ids].astype(np.float64)
            lp[own] = m.begin[ids[own]]
            lp = np.add.reduceat(lp, own) + (0 if ends else m.cont[m.slots[ids[own + counts - 1]], -1]) + np.log(m.left[first])
            c = self.hot_counts[places_in(new, self.hot_words)]
            share = np.maximum(c - DISCOUNT, 0) / m.mass[first]
            self.rows[self.n : n], self.first[self.n : n], self.hot[self.n : n] = means(m.params["emb"], ids, own, counts), first, c
            self.within[self.n : n] = np.where(c > 0, np.log(np.maximum(share + np.exp(lp), 1e-300)), lp)
        self.n, self.used = n, self.used + len(ids)

    def subwords(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Subwords of words one after another, where each word's begin, and how many they are."""
        counts = self.count[numbers]
        own = np.cumsum(counts) - counts
        return self.flat[np.arange(int(counts.sum())) + np.repeat(self.start[numbers] - own, counts)], own, counts


def places_in(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each word lies in among, -1 where it doesn't."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy()


def means(emb: np.ndarray, ids: np.ndarray, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means of words' rows of emb: by the subwords' place in the word, and of long words one after another."""
    out = emb.take(ids.take(own), axis=0)
    at = np.flatnonzero((counts > 1) & (counts <= 16))
    for k in range(1, 16):
        if not len(at):
            break
        out[at] += emb.take(ids.take(own[at] + k), axis=0)
        at = at[counts[at] > k + 1]
    at = np.flatnonzero(counts > 16)
    if len(at):
        n = counts[at]
        begin = np.cumsum(n) - n
        out[at] = np.add.reduceat(emb.take(ids.take(np.arange(int(n.sum())) + np.repeat(own[at] - begin, n)), axis=0), begin, axis=0)
    out /= counts[:, None].astype(np.float32)
    return out


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, c) of the texts, once for each COUNT_BYTES of a task's texts; the empty word stands for the end."""

    def counted(texts: pa.Array) -> pa.RecordBatch:
        flat, lens = split_words(texts, lower=True)
        counts = flat.value_counts()
        words, c = counts.field(0), counts.field(1)
        return pa.RecordBatch.from_arrays([pa.concat_arrays([words.cast(pa.string()), pa.array([""])]), pa.concat_arrays([c, pa.array([len(lens)], pa.int64())])], names=["word", "c"])

    held: list[pa.Array] = []
    size = 0
    for batch in batches:
        texts = batch.column(0)
        for lo, hi in parts_of(texts, COUNT_BYTES):
            part = texts.slice(lo, hi - lo)
            own = pc.sum(pc.binary_length(part)).as_py() or 0
            if held and size + own > COUNT_BYTES:
                yield counted(pa.concat_arrays(held))
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield counted(pa.concat_arrays(held))


def packed(n: np.ndarray) -> pa.RecordBatch:
    """Counts as a row for each block of CELLS cells that has any: their places and the counts."""
    at = np.flatnonzero(n)
    ends = np.searchsorted(at, np.arange(0, len(n) + CELLS, CELLS))
    some = np.flatnonzero(np.diff(ends))
    data = [(at[ends[k] : ends[k + 1]] - k * CELLS).astype("<i4").tobytes() + n[at[ends[k] : ends[k + 1]]].astype("<i8").tobytes() for k in some.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, "<i4", n), np.frombuffer(data, "<i8", n, 4 * n)


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks, which come sorted by their number."""

    def whole(block: int, total: np.ndarray) -> pa.RecordBatch:
        return packed(total).set_column(0, "block", pa.array([block], pa.int32()))

    last, total = None, np.zeros(CELLS, np.int64)
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if last is not None and block != last:
                yield whole(last, total)
                total[:] = 0
            last = block
            at, n = unpacked(data)
            total[at] += n
    if last is not None:
        yield whole(last, total)


def summed(df: DataFrame, counter, size: int) -> np.ndarray:
    """The `size` sums of what counter gives, packed, in each task over df; the driver gets each block once."""
    blocks = df.mapInArrow(counter, "block int, data binary").repartition("block").sortWithinPartitions("block").mapInArrow(add_up, "block int, data binary").toArrow()
    out = np.zeros(size)
    for block, data in zip(blocks["block"].to_pylist(), blocks["data"].to_pylist(), strict=True):
        at, n = unpacked(data)
        out[block * CELLS + at] = n
    return out


def count_inside(path: str):
    """Words with counts to the counts of subwords by what follows them in the word: vocabulary * CLASSES cells, an
    id's last being the word's end, then a cell for each id as a word's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, k = vocabulary(path), attention.CLASSES
        n = np.zeros(vocab * (k + 1), np.int64)
        for batch in batches:
            names, c = batch.column(0), batch.column(1).to_numpy()
            plain = pc.not_equal(names, "").to_numpy(zero_copy_only=False)
            n[vocab * k + vocab - 1] += c[~plain].sum()
            ids, counts = encode_words(path, names.filter(pa.array(plain)))
            if not len(ids):
                continue
            c, own = c[plain], np.cumsum(counts) - counts
            after = np.roll(ids, -1) % (k - 1)
            after[own + counts - 1] = k - 1
            np.add.at(n, ids * k + after, np.repeat(c, counts))
            np.add.at(n, vocab * k + ids[own], c)
        yield packed(n)

    return run


def count_beside(path: str, places: np.ndarray):
    """Texts to the counts of subwords by the places of the words' first subwords before and after their own word:
    vocabulary * 2 * CONTEXTS cells. The end stands before a text's first word and after its last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = plain_words(path)
        n, one = np.zeros(len(places) * 2 * CONTEXTS, np.int32), np.int32(1)  # a task's texts are far fewer than 2**31 words
        for batch in batches:
            for lo, hi in parts_of(batch.column(0), 4 << 20):
                numbers, lens, _, _ = words.numbers(batch.column(0).slice(lo, hi - lo))
                place = places[words.flat[words.start[numbers]]]
                ends = np.cumsum(lens) - 1
                before, after = np.roll(place, 1), np.roll(place, -1)
                before[ends - lens + 1] = places[-1]
                after[ends] = place[ends - lens + 1]
                ids, _, counts = words.subwords(numbers)
                np.add.at(n, ids * (2 * CONTEXTS) + np.repeat(before, counts), one)
                np.add.at(n, ids * (2 * CONTEXTS) + CONTEXTS + np.repeat(after, counts), one)
        yield packed(n)

    return run


class Fitter:
    """Adam over the windows of words: at each step for all but the subwords' rows, for these after about ROWS_AFTER subwords."""

    def __init__(self, params: dict[str, np.ndarray], words: Words, classes: np.ndarray):
        self.p, self.words, self.classes = params, words, classes
        self.small = attention.Adam(params, attention.NAMES[1:])
        self.rows = attention.Adam(params, ("emb",))
        self.losses: list[float] = []

    def fit(self, numbers: np.ndarray, lens: np.ndarray, order: np.random.Generator, rate: float) -> None:
        """Every word is the target of one step, once; windows follow each other without overlap."""
        w = attention.windows(numbers, lens, 0, stride=attention.WINDOW)
        first = self.classes[self.words.flat[self.words.start[: self.words.n]]]
        deal = order.permutation(len(w.inputs))
        steps = [deal[k : k + STEP] for k in range(0, len(deal), STEP)]
        turns = min(len(steps), max(1, int(self.words.count[w.inputs].sum()) // ROWS_AFTER))
        for t in range(turns):
            self.turn(w, first, steps[t * len(steps) // turns : (t + 1) * len(steps) // turns], rate)

    def turn(self, w: attention.Windows, first: np.ndarray, steps: list[np.ndarray], rate: float) -> None:
        """Steps with the same subwords' rows, then one of these rows: each distinct word's mean and sum are taken once."""
        inputs = w.inputs[np.concatenate(steps)]
        here = np.zeros(self.words.n, bool)
        here[inputs] = True
        distinct = np.flatnonzero(here)
        place = np.zeros(self.words.n, np.int64)
        place[distinct] = np.arange(len(distinct))
        at = place[inputs]
        ids, own, counts = self.words.subwords(distinct)
        rows = means(self.p["emb"], ids, own, counts)
        g = np.empty((*at.shape, attention.DIM), np.float32)
        k = 0
        for i in steps:
            loss, own_g = attention.gradients(self.p, rows.take(at[k : k + len(i)], axis=0), first[w.targets[i]], w.scored[i])
            self.small.step(own_g, rate)
            self.losses.append(loss)
            g[k : k + len(i)] = own_g["rows"].reshape(len(i), -1, attention.DIM)
            k += len(i)
        each = sums(at.ravel(), g.reshape(-1, attention.DIM), len(distinct)) / counts
        of, emb = np.repeat(np.arange(len(distinct)), counts), np.empty_like(self.p["emb"])
        for k, column in enumerate(each):
            emb[:, k] = np.bincount(ids, column.take(of), len(emb))
        self.rows.step({"emb": emb}, rate)


def sums(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Column by column, the sums of the rows of x by their place, (columns, n)."""
    return np.stack([np.bincount(at, column, n) for column in np.ascontiguousarray(x.T, np.float64)])


def trainer(model, seed: int):
    """Rows (of, text), sorted by it: each trainer `of` streams its whole texts, their ends too, through Adam from the
    sent model's start; gives its weights as blocks of float32 with the number of its words."""

    def weights(of: int, fitter: Fitter, n: int) -> pa.RecordBatch:
        flat = np.concatenate([fitter.p[k].ravel() for k in attention.NAMES])
        parts = [flat[k : k + BLOCK].tobytes() for k in range(0, len(flat), BLOCK)]
        return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([of] * len(parts), pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["block", "of", "n", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = model.value
        words = plain_words(start.path)
        last, fitter, order, n = None, None, None, 0
        held: list[str] = []

        def step() -> None:
            nonlocal n
            numbers, lens, _, _ = words.numbers(pa.array(held, pa.string()))
            fitter.fit(numbers, lens, order, RATE)
            n += len(numbers)
            held.clear()

        size = 0
        for batch in batches:
            for of, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if of != last:
                    if held:
                        step()
                    if fitter:
                        yield weights(last, fitter, n)
                    last, n, size = of, 0, 0
                    fitter = Fitter({k: v.copy() for k, v in start.params.items()}, words, start.classes)
                    order = np.random.Generator(np.random.PCG64(seed + of))
                held.append(text or "")
                size += len(held[-1])
                if size >= 1 << 22:
                    step()
                    size = 0
        if held:
            step()
        if fitter:
            yield weights(last, fitter, n)

    return run


def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted means of the blocks, which come sorted by their number and the trainers'."""
    last, total, mass = None, None, 0
    for batch in batches:
        for b, n, data in zip(*(batch.column(k).to_pylist() for k in ("block", "n", "data")), strict=True):
            if b != last:
                if last is not None:
                    yield mean_block(last, mass, total)
                last, total, mass = b, 0.0, 0
            total = total + n * np.frombuffer(data, np.float32).astype(np.float64)
            mass += n
    if last is not None:
        yield mean_block(last, mass, total)


def mean_block(block: int, mass: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mass], pa.int64()), pa.array([(total / mass).astype(np.float32).tobytes()], pa.binary())], names=["block", "n", "data"])


def count_subwords(model):
    """Words with counts to the counts of subwords, in cells slot * (vocabulary + 1) + id, the slot past all others being
    for first subwords, and the id past all others for words' ends; after these, tokens and words by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        size = len(m.slots) + 1
        n = np.zeros((attention.CLASSES + 1) * size + 2 * attention.CLASSES)
        held: list[pa.RecordBatch] = []

        def add() -> None:
            names, c = pa.concat_arrays([b.column(0) for b in held]), np.concatenate([b.column(1).to_numpy() for b in held]).astype(np.float64)
            plain = pc.not_equal(names, "").to_numpy(zero_copy_only=False)
            ids, k = encode_words(m.path, names.filter(pa.array(plain)))
            c, ends = c[plain], c[~plain].sum()
            end = size - 2
            own = np.cumsum(k) - k
            slot = m.slots[np.roll(ids, 1)]
            slot[own] = attention.CLASSES
            np.add.at(n, slot * size + ids, np.repeat(c, k))
            np.add.at(n, m.slots[ids[own + k - 1]] * size + size - 1, c)
            n[attention.CLASSES * size + end] += ends
            of = np.append(m.classes[ids[own]], [m.classes[end]] * bool(ends)).astype(np.int64)
            n[-2 * attention.CLASSES :] += np.concatenate([np.bincount(of, np.append(c, [ends] * bool(ends)), attention.CLASSES), np.bincount(of, minlength=attention.CLASSES)])
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) > 20_000:
                add()
        if held:
            add()
        yield packed(n)

    return run


def refine(counts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of first subwords in their class, (vocabulary,), and of later ones and the end by slot."""
    first = counts[-1, :-1] + 0.5
    begin = np.log(first / np.bincount(classes, first, attention.CLASSES)[classes])
    plain = counts[:-1].sum(axis=0) + 0.5
    plain = plain / plain.sum()
    cont = np.log((counts[:-1] + KAPPA * plain) / (counts[:-1].sum(axis=1, keepdims=True) + KAPPA))
    return begin.astype(np.float32), cont.astype(np.float32)


def pilot(train: DataFrame, documents: int) -> list[str]:
    """Texts of about PILOT_DOCS training documents in the order of a hash, as many as PILOT_BYTES hold; of a long text a run.

    The hash decides what is taken, whatever the order of the files, and where a run starts. For trying things out:
    fit() takes no sample.
    """
    share, most = min(1.0, PILOT_DOCS / max(1, documents)), max(1, PILOT_BYTES // 64)
    few = train.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text", F.lit(11)).alias("h"))
    few = few.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    place = F.pmod("h", F.greatest(F.length("text") - most + 1, F.lit(1))).cast("int") + 1
    few = few.select("h", F.substring("text", place, F.lit(most)).alias("text")).dropDuplicates(["h"])
    size, last = 0, -(1 << 63)
    for h, n in sorted(map(tuple, few.select("h", F.octet_length("text")).collect())):
        size += n
        if size > PILOT_BYTES:
            break
        last = h
    rows = sorted(map(tuple, few.where(F.col("h") <= F.lit(last)).collect()))
    return [t for _, t in rows]


def start_of(beside: np.ndarray, path: str, inside: np.ndarray | None = None, places: np.ndarray | None = None) -> Model:
    """Classes, slots and weights from which the trainers start, from the counts of all training words (none: untrained).

    The weights are those of a table of classes after subwords, as far as DIM columns hold it; attention starts at nothing.
    """
    vocab, end, k = vocabulary(path), vocabulary(path) - 1, attention.CLASSES
    model = Model(path, end, attention.initial(vocab), np.arange(vocab) % k, np.arange(vocab) % k)
    if not len(beside):
        return model
    first, inside = inside[vocab * k :], inside[: vocab * k].reshape(vocab, k)
    beside = beside.reshape(vocab, 2 * CONTEXTS)
    model.classes = attention.group(beside, first)
    model.slots = attention.group(inside, inside.sum(axis=1))
    mass = np.bincount(model.classes, first, k) + 1.0
    model.params["bias"][:] = np.log(mass / mass.sum())
    # what follows: classes of the frequent ones are known, of the others their shares
    share = np.zeros((CONTEXTS, k))
    np.add.at(share, (places, model.classes), first)
    share = (share + 1e-9 * mass) / (share + 1e-9 * mass).sum(axis=1, keepdims=True)
    near = beside[:, CONTEXTS:] @ share
    n, usual = near.sum(axis=1, keepdims=True), mass / mass.sum()
    near = np.log((near + 16 * usual) / ((n + 16) * usual))
    _, axes = np.linalg.eigh(near.T @ (near * n))
    axes = axes[:, ::-1][:, : attention.DIM]
    rows = near @ axes
    scale = 2 * np.sqrt((rows * rows * n).sum(axis=0) / n.sum()) + 1e-6
    model.params["emb"][:], model.params["out"][:] = np.clip(rows / scale, -3, 3), (axes * scale).T  # rare ones may lie far out
    model.params["pos"] *= np.float32(0.1)
    return model


def fit(docs: DataFrame, scratch: Scratch, path: str | None = None) -> tuple[Model, DataFrame, int]:
    """The model, the training words that are not hot (word, c), and the least count of a hot word.

    All training documents are counted, word by word; their distinct words give the counts of subwords inside words, and
    a second reading of all documents what stands beside words. From these counts come the classes, the slots and the
    weights' start; then trainers, as many as the training words ask for, stream all training documents, each its own
    share in the order of a hash, and their weights are averaged by numbers of words. Nothing comes from a sample, or
    depends on the number of cores or the order in which rows arrive.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    path = path or default_tokenizer()
    vocab, end = vocabulary(path), vocabulary(path) - 1
    train = docs.where(~fold())
    words = train.select("text").mapInArrow(count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))
    words = scratch.keep(words, "words")
    sizes = words.groupBy(F.floor(F.log2("c") * 8).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.sum("c").alias("c")).collect()  # a few hundred rows
    n, v = (sum(r[k] for r in sizes) for k in ("c", "n"))
    least, held = 1 << 62, 0
    for r in sorted(sizes, key=lambda r: -r["size"]):
        held += r["n"]
        if held > HOT_WORDS:
            break
        least = r["least"]
    hot = words.where(F.col("c") >= least).toArrow()  # at most HOT_WORDS rows
    model = start_of(np.zeros(0), path)
    if n:
        inside = summed(words, count_inside(path), vocab * (attention.CLASSES + 1))
        places = np.full(vocab, CONTEXTS - 1)
        top = np.argsort(-inside[-vocab:], kind="stable")[: CONTEXTS - 1]
        places[top] = np.arange(len(top))
        model = start_of(summed(train.select("text"), count_beside(path, places), vocab * 2 * CONTEXTS), path, inside, places)
        tasks = min(TRAINERS, -(-n // TRAINER_WORDS))
        start = sc.broadcast(model)
        mark = F.xxhash64("doc_id", "text", ROW_ID[1])
        parts = train.select(F.pmod(mark, F.lit(tasks)).cast("int").alias("of"), mark.alias("mark"), "text").repartitionById(tasks, "of").sortWithinPartitions("of", "mark")
        fitted = parts.select("of", "text").mapInArrow(trainer(start, 7), "block int, of int, n long, data binary")
        fitted = fitted.repartition("block").sortWithinPartitions("block", "of").mapInArrow(average, "block int, n long, data binary").toArrow()
        blocks = dict(zip(fitted["block"].to_pylist(), fitted["data"].to_pylist(), strict=True))
        flat = np.frombuffer(b"".join(blocks[k] for k in sorted(blocks)), np.float32)
        shapes, at = attention.shapes(vocab), 0
        for name in attention.NAMES:
            size = math.prod(shapes[name])
            model.params[name] = flat[at : at + size].reshape(shapes[name]).copy()
            at += size
    sent = sc.broadcast(Model(path, end, {}, model.classes, model.slots))
    counts = summed(words, count_subwords(sent), (attention.CLASSES + 1) * (vocab + 1) + 2 * attention.CLASSES)
    counts, tokens, types = np.split(counts, [-2 * attention.CLASSES, -attention.CLASSES])
    model.begin, model.cont = refine(counts.reshape(attention.CLASSES + 1, vocab + 1), model.classes)
    model.mass, model.left = np.maximum(tokens, 1), np.where(tokens > 0, DISCOUNT * types / np.maximum(tokens, 1), 1.0)
    model.hot = dict(zip(hot["word"].to_pylist(), hot["c"].to_pylist(), strict=True))
    model.train_tokens, model.vocabulary = n, v
    return model, words.where(F.col("c") < least), least


def score(m: Model, words: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
    """By text: n_tokens, hot tokens, their sums of log10(c + 0.5) and of log10 scores, and its other words, each with
    its natural log probability by subwords, and that of one occurrence in training."""
    numbers, lens, names, at = words.numbers(texts)
    lp = attention.log_scores(m.params, attention.windows(numbers, lens, 0), words.rows, words.first, words.within)
    c = words.hot[numbers]
    is_hot = c > 0
    first = np.cumsum(lens) - lens
    rare = np.flatnonzero(~is_hot)
    own = numbers[rare]
    word = pc.fill_null(names.take(pa.array(at[rare], mask=at[rare] < 0)), "")
    one = lp[rare] - words.within[own] - np.log(m.mass[words.first[own]])
    flat = pa.StructArray.from_arrays([word, pa.array(lp[rare], pa.float64()), pa.array(one, pa.float64())], names=["word", "lp", "one"])
    others = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, np.append(first, len(numbers))), pa.int32()), flat)
    base, own_score = np.where(is_hot, np.log10(c + 0.5), 0), np.where(is_hot, lp, 0)
    return lens, np.add.reduceat(is_hot.astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(own_score, first) / math.log(10), others


_WORDS: dict[str, tuple[Model, Words]] = {}
_PLAIN: dict[str, Words] = {}


def plain_words(path: str) -> Words:
    """The worker's words without a model."""
    if path not in _PLAIN:
        _WORDS.clear()  # of another run
        _PLAIN[path] = Words(path)
    return _PLAIN[path]


def known_words(m: Model) -> Words:
    """The worker's words of this model."""
    if m.path not in _WORDS or _WORDS[m.path][0] is not m:
        _PLAIN.clear()  # training is over
        _WORDS[m.path] = m, Words(m.path, m)
    return _WORDS[m.path][1]


RARE = "array<struct<word:string,lp:double,one:double>>"


def scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        words = known_words(m)
        for batch in batches:
            for lo, hi in parts_of(batch.column(3), 4 << 20):
                part = batch.slice(lo, hi - lo)
                n, known, base, s, others = score(m, words, part.column(3))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *(pa.array(x) for x in (n, known, base, s)), others], names=["doc_id", *ROW_ID, "n_tokens", "hot", "base", "score", "rare"])

    return run


def score_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The fold of crc32(doc_id as text) mod 5 = 1 is held out; rows without an id are trained on. The counts of words that
    are too many to send everywhere come by a join on the words. score is the log10 probability of the words and the
    end (see above); the probabilities of all texts sum to 1 at most. Null and empty texts are the end alone. Without training
    documents both scores are those of untrained models.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "scoring")
    rows = with_row_ids(docs.select("doc_id", "text"), scratch)
    model, words, least = fit(rows, scratch, path)
    sent = spark.sparkContext.broadcast(model)  # fixed tables and at most HOT_WORDS words
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.select("doc_id", *ROW_ID, "text").mapInArrow(scorer(sent), f"doc_id {kind}, {ROW_ID[0]} long, {ROW_ID[1]} long, n_tokens long, hot long, base double, score double, rare {RARE}")
    scored = scratch.keep(scored, "scored")
    rare = scored.select(*ROW_ID, F.inline("rare"))
    counted = rare.join(words, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    own, uni = F.col("lp") / math.log(10), F.col("one") / math.log(10) + F.log10(F.col("c") - DISCOUNT)
    top = F.greatest(own, uni)
    word = F.when(F.col("c") > 0, top + F.log10(F.pow(F.lit(10.0), own - top) + F.pow(F.lit(10.0), uni - top))).otherwise(own)
    rest = counted.groupBy(*ROW_ID).agg(F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("known"), F.sum(F.log10(F.col("c") + 0.5)).alias("more"), F.sum(word).alias("rest"))
    out = scored.drop("rare").join(rest, list(ROW_ID), "left")
    each = math.log10(model.train_tokens + 0.5 * (model.vocabulary + 1))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)
    score_ = F.col("score") + F.coalesce("rest", F.lit(0.0))
    return out.select("doc_id", fold().alias("held_out"), "n_tokens", (F.col("hot") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score_.alias("score"))
