"""Passages of test items in a corpus, found with one FM-index per training shard.

A shard is a run of documents as word numbers.  Its suffixes are sorted, the Burrows-Wheeler transform goes into a
wavelet matrix of packed bits, and all seeds (runs of ``SEED`` words of an item) are searched
backward at once.  Occurrences are located by stepping to sampled suffix positions.  Around each
occurrence the part of the item about the seed is aligned with the document: substitutions on the diagonal first, then, where words
are missing or extra, a narrow band.  A passage counts from ``PASSAGE`` words on with at most one word in
``ALTERED`` changed; any such passage holds a seed unchanged, so none is missed.  Passages longer than four times that are met as
overlapping ones.  What is found is told in characters of the document's own source.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm.text import word_stretches, words
from vecloom.sources.tables import ship_code

PASSAGE, ALTERED, SEED = 12, 8, 5
#: Words of a shard, and the spacing of kept suffix positions.
SHARD, SAMPLE = 1_000_000, 16
#: Symbols that stand for words no item has, used in turn: they match nothing and keep suffixes apart.
OTHERS = 255
#: Characters of items searched in one pass over the corpus (each task holds them); a larger set takes several passes.
ITEM_CHARS = 64 * 2**20
_BAND = 3
#: The longest passage looked at in one piece, and the words of an item aligned together: such a piece on either side of a seed's place.
_LONGEST = 4 * PASSAGE
_PIECE = 3 * _LONGEST
FOUND = "doc_id bigint, item_id bigint, first_char int, end_char int, matched int"


@dataclass
class Wavelet:
    """Ranks over a sequence of symbols: bit by bit from the highest, zeros moved before ones on each level."""

    bits: list[np.ndarray]
    before: list[np.ndarray]
    zeros: list[int]
    base: np.ndarray

    @classmethod
    def of(cls, seq: np.ndarray, sigma: int) -> Wavelet:
        levels = max(1, int(sigma - 1).bit_length())
        bits, before, zeros, at = [], [], [], seq
        for level in range(levels - 1, -1, -1):
            bit = ((at >> level) & 1).astype(bool)
            packed = np.packbits(np.r_[bit, np.zeros(64 + -len(bit) % 64, bool)], bitorder="little").view(np.uint64)
            bits.append(packed)
            before.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            zeros.append(int(len(bit) - bit.sum()))
            at = np.concatenate([at[~bit], at[bit]])
        tree = cls(bits, before, zeros, np.zeros(sigma, np.int64))
        tree.base = tree._descend(np.arange(sigma), np.zeros(sigma, np.int64))
        return tree

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(len(self.bits)):
            ones = self._ones(level, i)
            i = np.where((c >> (len(self.bits) - 1 - level)) & 1, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``c`` occurs before position ``i``, elementwise."""
        return self._descend(c, i) - self.base[c]


def sort_suffixes(t: np.ndarray, sigma: int) -> np.ndarray:
    """Start positions of the suffixes of ``t`` in order; a suffix that is a prefix of another comes first.

    Sorts by as many symbols as fit 62 bits, then doubles that length among suffixes still alike.
    """
    n, width = len(t), max(1, int(sigma).bit_length())
    step = max(1, 62 // width)
    padded = np.r_[t.astype(np.int64) + 1, np.zeros(step, np.int64)]
    key = np.zeros(n, np.int64)
    for k in range(step):
        key = (key << width) | padded[k : k + n]
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1

    def starts(sorted_key: np.ndarray) -> np.ndarray:
        return np.r_[True, sorted_key[1:] != sorted_key[:-1]]

    new = starts(key[order])
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank[order] = group
    slots = np.flatnonzero(~(new & np.r_[new[1:], True]))
    while len(slots):
        at = order[slots]
        key = (rank[at] << 31) | (rank[np.minimum(at + step, n)] + 1)
        by = np.argsort(key)
        order[slots] = at[by]
        key = key[by]
        new = starts(key)
        rank[order[slots]] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]
        slots = slots[~(new & np.r_[new[1:], True])]
        step *= 2
    return order


class FMIndex:
    """Backward search and location over one sequence of symbols below ``sigma``.

    The last symbol must occur nowhere else, so that suffixes and rotations of the text have the same order.
    """

    def __init__(self, t: np.ndarray, sigma: int, sample: int = SAMPLE):
        order = sort_suffixes(t, sigma)
        self.n = len(t)
        bwt = t[order - 1]
        self.tree, self.bwt = Wavelet.of(bwt, sigma), bwt
        self.starts = np.r_[0, np.cumsum(np.bincount(t, minlength=sigma))]
        kept = order % sample == 0
        self.marks, self.kept = kept, order[kept]
        self.kept_before = np.cumsum(kept) - 1

    def count(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of the patterns (m x length)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for c in patterns.T[::-1]:
            lo, hi = self.starts[c] + self.tree.rank(c, lo), self.starts[c] + self.tree.rank(c, hi)
            hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.marks[at[open_]]
            done = open_[hit]
            out[done] = self.kept[self.kept_before[at[done]]] + steps[done]
            open_ = open_[~hit]
            c = self.bwt[at[open_]]
            at[open_] = self.starts[c] + self.tree.rank(c, at[open_])
            steps[open_] += 1
        return out % self.n


@dataclass
class Items:
    """Test items as word numbers, and their distinct seeds with the places they stand at."""

    ids: np.ndarray
    vocabulary: dict[str, int]
    flat: np.ndarray  # all items' words, one after another
    begin: np.ndarray  # where each item starts in it, and the end
    seeds: np.ndarray
    seed_start: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        vocabulary: dict[str, int] = {}
        ids, texts = [], []
        for item_id, text in rows:
            if item_id is None or not text:
                continue
            texts.append(np.array([vocabulary.setdefault(w, len(vocabulary) + OTHERS + 2) for w in words(text)], np.int64))
            ids.append(item_id)
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.concatenate([*texts, np.zeros(0, np.int64)])
        begin = np.r_[0, np.cumsum(lengths)]
        if len(flat) < SEED:
            return cls(np.array(ids, np.int64), vocabulary, flat, begin, np.zeros((0, SEED), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        every = np.lib.stride_tricks.sliding_window_view(flat, SEED)
        owner = np.repeat(np.arange(len(ids)), lengths)[: len(every)]
        inside = np.flatnonzero(np.arange(len(every)) + SEED <= begin[owner + 1])
        order = inside[np.lexsort(every[inside].T[::-1])]
        new = np.r_[True, (every[order][1:] != every[order][:-1]).any(1)] if len(order) else np.zeros(0, bool)
        return cls(np.array(ids, np.int64), vocabulary, flat, begin, every[order[new]], np.r_[np.flatnonzero(new), len(order)], owner[order], order - begin[owner[order]])


def _passage(hit: np.ndarray) -> np.ndarray:
    """The words of each row of word-by-word matches that lie in a passage, which begins and ends with a match."""
    edges = np.zeros((len(hit), hit.shape[1] + 1), np.int32)
    total = np.concatenate([np.zeros((len(hit), 1), np.int32), np.cumsum(~hit, axis=1, dtype=np.int32)], axis=1)
    for n in range(PASSAGE, min(_LONGEST, hit.shape[1]) + 1):
        few = (total[:, n:] - total[:, :-n]) * ALTERED <= n
        whole = few & hit[:, : hit.shape[1] - n + 1] & hit[:, n - 1 :]
        edges[:, : whole.shape[1]] += whole
        edges[:, n:] -= whole
    return np.cumsum(edges[:, :-1], axis=1) > 0


def _banded(item: np.ndarray, doc: np.ndarray, length: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, first and last item word, first and last place in ``doc``) of passages with words missing or extra.

    ``item`` (m x L), ``doc`` (m x L + 2 band) start on the same diagonal.  best[e] holds, per row and shift, the longest stretch
    that begins with a match and ends here with ``e`` words altered, as 16 times its item words plus the shift it began at.
    """
    m, size = item.shape
    shifts, worst = 2 * _BAND + 1, _LONGEST // ALTERED - 1
    best = np.zeros((worst + 1, m, shifts), np.int32)
    none, one = np.int32(-(2**30)), np.int32(16)
    best[1:] = none
    lead = np.full((m, 1), none, np.int32)
    begin = one + np.arange(shifts, dtype=np.int32)
    out = []
    for a in range(size):
        same = (item[:, a : a + 1] == doc[:, a : a + shifts]) & (a < length)[:, None]
        now = np.full_like(best, none)
        longest, ending = np.zeros(m, np.int32), np.zeros(m, np.int64)
        for e in range(worst + 1):
            grown = np.where(same, best[e] + one if e else np.where(best[e] > 0, best[e] + one, begin), none if e else np.int32(0))
            if e:
                begun = np.where(best[e - 1] > 0, best[e - 1], none)
                dropped = np.concatenate([begun[:, 1:], lead], axis=1)
                grown = np.maximum(grown, np.maximum(begun, dropped) + one)
                added = np.where(now[e - 1] > 0, now[e - 1], none)
                grown = np.maximum(grown, np.concatenate([lead, added[:, :-1]], axis=1))
            now[e] = grown
            whole = np.where(same & (grown >> 4 >= max(PASSAGE, e * ALTERED)), grown, 0)
            at = whole.argmax(1)
            top = whole[np.arange(m), at]
            ending, longest = np.where(top > longest, at, ending), np.maximum(top, longest)
        for row in np.flatnonzero(longest):
            first = a - int(longest[row] >> 4) + 1
            out.append((int(row), first, a, first + int(longest[row] & 15), a + int(ending[row])))
        best = now
    return out


def _joined(stretches: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Stretches (first and last place, first and last item word) of one alignment, those that overlap as one."""
    out: list[list[int]] = []
    for lo, hi, a, z in sorted(stretches):
        if out and lo <= out[-1][1]:
            last = out[-1]
            last[1], last[2], last[3] = max(last[1], hi), min(last[2], a), max(last[3], z)
        else:
            out.append([lo, hi, a, z])
    return out


def search_shard(parts: list[np.ndarray], items: Items) -> list[tuple[int, int, int, int, int]]:
    """(document's place, item_id, first word, last word, words of the item met there) of every passage in the shard's documents."""
    lengths = np.array([len(p) for p in parts])
    ends = np.cumsum(lengths + 1)
    t = np.concatenate([np.r_[p, 0] for p in parts])
    other = t < 0
    t[other] = np.arange(int(other.sum())) % OTHERS + 1
    sigma = len(items.vocabulary) + OTHERS + 3
    t[-1] = sigma - 1  # the end of the text, unlike anything else
    index = FMIndex(t, sigma)
    lo, hi = index.count(items.seeds)
    seen = np.flatnonzero(hi > lo)
    if not len(seen):
        return []
    times = (hi - lo)[seen]
    seed = np.repeat(seen, times)
    rows = np.repeat(lo[seen], times) + np.arange(len(seed)) - np.repeat(np.cumsum(times) - times, times)
    at = index.locate(rows)
    doc = np.searchsorted(ends, at, "right")
    # each place the seed has in an item gives a diagonal
    places = (items.seed_start[1:] - items.seed_start[:-1])[seed]
    which = np.repeat(np.arange(len(seed)), places)
    slot = np.repeat(items.seed_start[seed], places) + np.arange(len(which)) - np.repeat(np.cumsum(places) - places, places)
    item, start = items.seed_item[slot], at[which] - items.seed_at[slot]
    # of an item the piece about the seed: seeds of one diagonal and stretch of the item share it
    piece = items.seed_at[slot] // _LONGEST
    cases = np.unique(np.stack([doc[which], item, start, piece], axis=1), axis=0)
    spans = np.diff(items.begin)
    size = int(min(_PIECE, spans.max()))
    found = []
    for c in range(0, len(cases), 4096):
        d, i, s, piece = cases[c : c + 4096].T
        left = np.maximum(0, np.minimum((piece - 1) * _LONGEST, spans[i] - size))  # the piece's first word in the item
        s = s + left
        first, end = ends[d] - lengths[d] - 1, ends[d] - 1
        pos = s[:, None] + np.arange(-_BAND, size + _BAND)
        inside = (pos >= first[:, None]) & (pos < end[:, None])
        around = np.where(inside, t[np.clip(pos, 0, len(t) - 1)], -2)
        word = left[:, None] + np.arange(size)
        span = np.minimum(size, spans[i] - left)
        goal = np.where(word < spans[i][:, None], items.flat[np.minimum(items.begin[i][:, None] + word, len(items.flat) - 1)], -1)
        hit = (goal == around[:, _BAND : _BAND + size]) & (goal >= 0)
        inside = _passage(hit)
        # words of the item met on some diagonal of the band: too few, and no alignment reaches a passage
        near = hit.copy()
        for shift in range(2 * _BAND + 1):
            near |= (goal == around[:, shift : shift + size]) & (goal >= 0)
        sums = np.concatenate([np.zeros((len(near), 1), np.int32), np.cumsum(near, axis=1, dtype=np.int32)], axis=1)
        window = min(PASSAGE, size)
        stretches = defaultdict(list)
        for k in np.flatnonzero(inside.any(1)):
            turns = np.flatnonzero(np.diff(np.r_[False, inside[k], False]))
            stretches[k] += [(x + _BAND, z - 1 + _BAND, x, z - 1) for x, z in zip(turns[::2], turns[1::2])]
        # passages of one diagonal too: they may go on beyond a missing or extra word
        maybe = np.flatnonzero(((sums[:, window:] - sums[:, :-window]) >= PASSAGE - 2).any(1))
        if len(maybe):
            for row, x, z, lo, hi in _banded(goal[maybe], around[maybe], span[maybe]):
                stretches[maybe[row]].append((lo, hi, x, z))
        for k in sorted(stretches):
            for lo, hi, x, z in _joined(stretches[k]):
                begin = int(s[k] - _BAND + lo - first[k])
                found.append((int(d[k]), int(items.ids[i[k]]), begin, begin + int(hi - lo), int(near[k, x : z + 1].sum())))
    return found


def _shards(items: Items):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_char", pa.int32()), ("end_char", pa.int32()), ("matched", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = items.vocabulary.get
        docs, texts, parts, held = [], [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            rows, places = [], {}
            for k, item, first, last, matched in search_shard(parts, items) if parts else ():
                if k not in places:  # only documents with a passage are traced back to their source
                    places[k] = word_stretches(texts[k], items.vocabulary)[1:]
                rows.append((docs[k], item, places[k][0][first], places[k][1][last], matched))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if doc_id is None or not text.is_valid or len(part := words(source := text.as_py(), items.vocabulary)) < PASSAGE - 2:
                    continue
                docs.append(doc_id)
                texts.append(source)
                parts.append(np.array([get(w, -1) for w in part], np.int64))
                held += len(part)
                if held >= SHARD:
                    yield from done()
                    docs, texts, parts, held = [], [], [], 0
        yield from done()

    return run


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_char, end_char, matched): passages of items in documents, a row for each stretch and diagonal.

    ``first_char`` counts from 0, ``end_char`` is the one after the last, both in ``documents.text`` as it is.  Null and empty
    texts, and texts shorter than a passage, hold none; items shorter than one cannot leak.  Whole documents are searched,
    comments and switched-off blocks too.  The items go to every task; those of more than ``ITEM_CHARS`` characters in
    all are cut by a hash of their id, and each part is one pass over the corpus.
    """
    ship_code(documents.sparkSession)
    lean = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    total = lean.agg(F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0))).first()[0]
    passes = max(1, -(-total // ITEM_CHARS))
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = None
    for p in range(passes):
        block = lean if passes == 1 else lean.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p)
        part = texts.mapInArrow(_shards(Items.of([(r[0], r[1]) for r in block.collect()])), FOUND)
        found = part if found is None else found.unionByName(part)
    return found


def leaked_pairs(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "item_id").distinct()


def removal_spans(found: DataFrame) -> DataFrame:
    """(doc_id, first_char, end_char, n_items): what to cut from a document's text, overlapping and touching stretches merged."""
    order = W.partitionBy("doc_id").orderBy("first_char", "end_char")  # of one document's stretches
    reach = F.max("end_char").over(order.rowsBetween(W.unboundedPreceding, -1))
    runs = found.withColumn("_new", F.when(reach.isNull() | (F.col("first_char") > reach), 1).otherwise(0))
    runs = runs.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "_run").agg(F.min("first_char").alias("first_char"), F.max("end_char").alias("end_char"), F.countDistinct("item_id").alias("n_items")).drop("_run")
