"""Packing documents into sequences of bounded length: bin completion on the histogram of piece lengths."""

from __future__ import annotations

import bisect
import gc
import operator
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm.common import Scratch, parts_of, room, running_total, split_words

CAPACITY, END_ID = 4096, 1
#: Words whose ids a worker remembers; forgetting changes no result.
CACHE_WORDS = 600_000
#: Steps that a search for one filling may take, and decisions that the whole search may revise.
FILL_STEPS, SEARCH_STEPS = 3000, 200


#: Words of one piece whatever comes before: precomposed Latin letters whose lower case is one letter. ASCII marks
#: after such a word are one more piece (but for the apostrophe, which may begin an ending).
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
WORD = re.compile(f"^(?:([{LETTERS}]+)([{re.escape(MARKS)}]*)|(.+))$", re.M)


class WordIds:
    """Little-endian ids of the words between white space, remembered by word in two generations of CACHE_WORDS / 2, or
    by number up to CACHE_WORDS.

    The tokenizer never joins across white space, so a text's ids are its words' ids in a row. New words of plain
    letters go to it many at a time, in lower case, and are told apart by its ends of words; marks at a word's end go
    by themselves, and all other words one by one.
    """

    def __init__(self, path: str, spaced: bool = False):
        """spaced: the tokenizer is byte-level, keeps case and marks words by the space before them, not by their ends."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok, self.spaced = Tokenizer.from_file(path), spaced
        self.tok.encode_special_tokens = spaced
        self.lean = self.tok
        if not spaced:
            self.lean = Tokenizer.from_file(path)  # plain words in lower case need no normaliser, and white space is the only boundary in them
            self.lean.normalizer = None
            self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.edge = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.edge[i] = token.startswith("\u0120") if spaced else token.endswith("</w>")
        #: What stands before a word's ids, if anything; changing it empties the memory.
        self.head: Callable[[bytes], bytes] | None = None
        self.now: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        #: Words by number: where each one's ids begin in flat, and how many there are.
        self.place: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 14, "<u4"), 0
        self.start, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.plain: dict[str, bytes] = {"": b""}
        self.marks: dict[str, bytes] = {"": b""}

    def headed(self, head: Callable[[bytes], bytes] | None) -> None:
        self.head, self.now, self.old = head, {}, {}

    def one(self, word: str, tail: bool = False) -> bytes:
        return np.array(self.tok.encode(" " * (self.spaced and not tail) + word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_plain(self, words: list[str]) -> None:
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            ids = np.array(self.lean.encode_batch_fast([" " * self.spaced + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.append(np.flatnonzero(self.edge[ids])[1:], len(ids)) if self.spaced else np.flatnonzero(self.edge[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                data, at = ids.tobytes(), (4 * ends).tolist()
                self.plain.update(zip(part, (data[i:j] for i, j in zip([0, *at], at, strict=False)), strict=True))
            else:
                self.plain.update((w, self.one(w)) for w in part)

    def prepare(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A mapping that holds all of words."""
        if len(self.now) >= CACHE_WORDS // 2:
            self.now, self.old = {}, self.now
        now, old = self.now, self.old
        new = words.difference(now)
        known = new.intersection(old)
        now.update(zip(known, map(old.__getitem__, known)))
        new = list(new - known)
        if new:
            ids = self.encoded(new)
            now.update(zip(new, map(operator.add, map(self.head, new), ids) if self.head else ids, strict=True))
        return now

    def encoded(self, new: list[bytes]) -> list[bytes]:
        """The ids of words, in their order."""
        if len(self.plain) >= CACHE_WORDS:
            self.plain = {"": b""}
        if len(self.marks) >= 10_000:
            self.marks = {"": b""}
        gc.disable()  # tuples of texts only: nothing to collect, however many
        bases, tails, odd = zip(*WORD.findall(b"\n".join(new).decode("utf-8", "replace")), strict=True)
        gc.enable()
        lower = bases if self.spaced else "\n".join(bases).lower().split("\n")
        self.encode_plain(list(set(lower).difference(self.plain)))
        for tail in set(tails).difference(self.marks):
            self.marks[tail] = self.one(tail, True)
        out = list(map(operator.add, map(self.plain.__getitem__, lower), map(self.marks.__getitem__, tails)))
        if any(odd):
            for i, word in enumerate(odd):
                if word:
                    out[i] = self.one(word)
        return out

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of distinct words, which hold until the next call."""
        if len(self.place) >= CACHE_WORDS:
            self.place, self.used = {}, 0
        out = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(out < 0)
        if len(at):
            new = [words[i] for i in at.tolist()]
            ids, n = self.encoded(new), len(self.place)
            counts, data = np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<u4")
            out[at] = np.arange(n, n + len(new))
            self.place.update(zip(new, range(n, n + len(new)), strict=True))
            self.start, self.count, self.flat = room(self.start, n + len(new)), room(self.count, n + len(new)), room(self.flat, self.used + len(data))
            self.start[n : n + len(new)], self.count[n : n + len(new)] = self.used + np.cumsum(counts) - counts, counts
            self.flat[self.used : self.used + len(data)] = data
            self.used += len(data)
        return out


_WORDS: dict[tuple[str, bool], WordIds] = {}


def word_ids(path: str, spaced: bool = False) -> WordIds:
    if (path, spaced) not in _WORDS:
        _WORDS[path, spaced] = WordIds(path, spaced)
    return _WORDS[path, spaced]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def text_ids(known: WordIds, texts: pa.Array) -> tuple[np.ndarray, list[int]]:
    """Ids of texts one after another, and where each text's begin and the last one's end; each distinct word is looked up once."""
    flat, lens = split_words(texts)
    coded = flat.dictionary_encode()
    at = known.numbers(coded.dictionary.cast(pa.binary()).to_pylist()).take(coded.indices.to_numpy())
    n = known.count.take(at)
    ends = np.append(0, np.cumsum(n))
    where = np.repeat(known.start.take(at) - ends[:-1], n)
    where += np.arange(len(where))
    seq = known.flat.take(where)
    return seq, ends[np.append(0, np.cumsum(lens))].tolist()


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): a document's ids and one end id, cut only where longer than capacity."""
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in parts_of(texts, 4 << 20):
                cols: list[list] = [[], [], [], [], [], []]
                seq, bounds = text_ids(known, texts.slice(lo, hi - lo))
                for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    data = seq[a:b].tobytes() + end
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        for c, v in zip(cols, (doc_ids[lo + i], k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                            c.append(v)
                arrays = [pa.array(c, t) for c, t in zip(cols[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(cols[5], pa.binary())] if with_ids else [])], names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def fillings(sizes: list[int], have: dict[int, int], room: int, steps: int, most: int = 6) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Undominated ways to fill `room` from the lengths at hand, as (waste, ((length, times), ...)), best first.

    The best-fit filling comes first among equals. Larger lengths are tried first; a branch ends when what is left of
    `steps` is used, when nothing fits any more (a filling is then maximal), or when a waste of 0 was found.
    """
    found: dict[tuple, int] = {}
    best = [room + 1]
    left = [steps]

    def go(room: int, top: int, chosen: list[tuple[int, int]]) -> None:
        if left[0] <= 0 or best[0] == 0 and len(found) >= most:
            return
        left[0] -= 1
        i = bisect.bisect_right(sizes, min(room, top)) - 1
        if i < 0 or room < sizes[0]:
            if room <= best[0] or len(found) < most:
                best[0] = min(best[0], room)
                found[tuple(chosen)] = room
            return
        tried = 0
        while i >= 0 and left[0] > 0 and not (best[0] == 0 and tried):
            size = sizes[i]
            times = min(have[size], room // size)
            if times:
                for k in (times, *((times - 1,) if times > 1 and tried == 0 else ())):
                    go(room - k * size, size - 1, [*chosen, (size, k)])
                tried += 1
            i -= 1
        if not tried:
            found[tuple(chosen)] = room
            best[0] = min(best[0], room)

    go(room, room, [])
    ranked = sorted(((w, c) for c, w in found.items()), key=lambda x: (x[0], [(-s, -k) for s, k in x[1]]))
    out: list[tuple[int, tuple]] = []
    for w, c in ranked:
        if not any(dominates(d, c) for _, d in out):
            out.append((w, c))
        if len(out) >= most:
            break
    return out or [(room, ())]


def dominates(a: tuple[tuple[int, int], ...], b: tuple[tuple[int, int], ...]) -> bool:
    """Whether the items of b fit, grouped greedily, into the items of a: then a leaves less room and easier items."""
    bins = sorted((s for s, k in a for _ in range(k)), reverse=True)
    items = sorted((s for s, k in b for _ in range(k)), reverse=True)
    if len(bins) > 24 or len(items) > 24:
        return False
    for x in items:
        i = next((i for i in range(len(bins) - 1, -1, -1) if bins[i] >= x), None)
        if i is None:
            return False
        bins[i] -= x
        bins.sort(reverse=True)
    return True


@dataclass
class Plan:
    """Fillings with the number of sequences that use each."""

    capacity: int
    fills: list[tuple[tuple[tuple[int, int], ...], int]] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(m for _, m in self.fills)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, fill_steps: int = FILL_STEPS, search_steps: int = SEARCH_STEPS) -> Plan:
    """Bin completion on a histogram of lengths (at most `capacity` entries, whatever the number of documents).

    Every decision fills sequences around the largest length left, as many at once as the counts allow. The first
    descent takes the best filling each time and is the incumbent; the search then revises decisions, latest first,
    and gives up a branch when its waste exceeds what an improvement on the incumbent would allow. It ends when the
    incumbent meets the bound ceil(sum / capacity), or after `search_steps` revisions.
    """
    total = sum(s * c for s, c in counts.items())
    bound = max(-(-total // capacity), sum(c for s, c in counts.items() if 2 * s > capacity))
    best: Plan | None = None
    revisions = 0
    stack: list[list] = []  # [alternatives, index, waste so far, decisions before]; have and fills are what follows from it
    have = {s: c for s, c in counts.items() if c}
    fills: list = []

    def spend(fill: tuple[tuple[int, int], ...], times: int) -> None:
        fills.append((fill, times))
        for s, k in fill:
            have[s] -= k * times
            if not have[s]:
                del have[s]

    def undo(depth: int) -> None:
        while len(fills) > depth:
            fill, times = fills.pop()
            for s, k in fill:
                have[s] = have.get(s, 0) + k * times

    def alternatives() -> list[tuple[int, tuple[tuple[int, int], ...], int]]:
        top = max(have)
        rest = dict(have)
        rest[top] -= 1
        rest = {s: c for s, c in rest.items() if c}
        out = []
        for w, c in fillings(sorted(rest), rest, capacity - top, fill_steps, 4 if best else 1):
            use: dict[int, int] = {top: 1}
            for s, k in c:
                use[s] = use.get(s, 0) + k
            out.append((w, tuple(sorted(use.items(), reverse=True)), min(have[s] // k for s, k in use.items())))
        return out

    def descend(waste: int) -> None:
        nonlocal best
        while have:
            allowed = best.sequences * capacity - capacity - total if best else None
            alts = alternatives()
            if allowed is not None and waste + alts[0][0] > allowed:
                return
            stack.append([alts, 0, waste, len(fills)])
            w, fill, m = alts[0]
            spend(fill, m)
            waste += w * m
        found = Plan(capacity, list(fills))
        if best is None or found.sequences < best.sequences:
            best = found

    descend(0)
    while best and best.sequences > bound and stack and revisions < search_steps:
        alts, i, waste, depth = stack.pop()
        undo(depth)
        revisions += 1
        if i == 0 and len(alts) == 1:
            alts = alternatives()
        if i + 1 < len(alts) and waste + alts[i + 1][0] <= best.sequences * capacity - capacity - total:
            w, fill, m = alts[i + 1]
            stack.append([alts, i + 1, waste, depth])
            spend(fill, m)
            descend(waste + w * m)
    return best or Plan(capacity)


def slots(plan: Plan) -> dict[int, np.ndarray]:
    """By length: rows (first rank, times in a sequence, first sequence, offset there), ranks ascending."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    first = 0
    for fill, m in plan.fills:
        at = 0
        for s, k in fill:
            out.setdefault(s, []).append((used.get(s, 0), k, first, at))
            used[s] = used.get(s, 0) + k * m
            at += s * k
        first += m
    return {s: np.array(v, dtype=np.int64) for s, v in out.items()}


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end id; rows that repeat are packed each. Only documents longer than `capacity` are cut.
    The plan is made from the counts of pieces by length, of which there are at most `capacity`; a piece finds its
    place by its rank among the pieces of its length, so no length's pieces have to meet in one task.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = cut_pieces(docs, tokenizer, capacity, end_id).withColumn("one", F.lit(1).cast("long"))
    pieces = scratch.keep(pieces, "cut")  # range-sorting reads its input twice
    ranked = running_total(scratch, pieces, "pieces", [F.xxhash64("doc_id"), F.col("piece"), F.col("ids_crc32")], "one", group="length", out="rank")
    ranked = ranked.drop("one")
    counts = dict(map(tuple, docs.sparkSession.read.parquet(f"{scratch.base}/pieces").groupBy("length").count().collect()))  # at most `capacity` rows
    plan = slots(plan_packing(counts, capacity))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            seq, off = np.zeros(len(df), np.int64), np.zeros(len(df), np.int64)
            rank, length = df["rank"].to_numpy() - 1, df["length"].to_numpy()
            for s in np.unique(length):
                rows = np.flatnonzero(length == s)
                p = plan[int(s)]
                own = p[np.searchsorted(p[:, 0], rank[rows], side="right") - 1]
                q = rank[rows] - own[:, 0]
                seq[rows], off[rows] = own[:, 2] + q // own[:, 1], own[:, 3] + q % own[:, 1] * s
            yield df.drop(columns="rank").assign(sequence_id=seq, offset=off)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
