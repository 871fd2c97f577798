"""Abusive, hateful or sexual language: a convolutional classifier over hashed words.

Words are undisguised (macros expanded, spelled-out letters joined, digits and dots inside words undone), hashed to
embeddings, run through filters of several widths, and pooled by their maximum over the whole text, so one passage
decides wherever it stands.  The network is trained in numpy on every reviewed document, read block by block in a task;
thresholds come from held-out folds, one per language where a language has enough reviewed cases.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.curriculum import source_name
from vecloom.llm.text import expand_macros, fold_letters
from vecloom.sources.tables import durable, ship_code, small_enough

#: Buckets of the word hash, size of an embedding, filter widths and filters of each width.
BUCKETS, EMBEDDING, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3, 5), 8
#: Reviewed documents, and words of them, a training holds at a time; it goes through all of them block by block.
BLOCK, BLOCK_WORDS = 1 << 13, 1 << 24
#: Characters hashed together, unless one text has more.
CHARS = 1 << 22
#: Bytes of votes sent to every task, at so many a document; beyond, texts meet their votes in a shuffle.
SHIP_LIMIT, VOTE_BYTES = 64 << 20, 32
#: Log-odds that a document needs at least, whatever the thresholds.
LEAST_ODDS = -0.5
#: Training documents a word must stand in to be learned: two, and one in so many, but never more than the last.
FEWEST, ONE_IN, ENOUGH = 2, 600, 7
#: Abusive documents a language needs for a threshold of its own.
LANGUAGE_CASES = 15
#: Codes of a language (fixed values).
LANGUAGES = {"en": ("en", "eng", "english"), "de": ("de", "deu", "ger", "german"), "fr": ("fr", "fra", "fre", "french")}

_WRAPPED = re.compile(r"(?<=[A-Za-z])-[ \t]*\r?\n[ \t]*%*[ \t]*(?=[a-z])")
_GROUPED = re.compile(r"\{\\(?:rm|em|it|bf|sf|sl|tt|sc)\s+([a-zA-Z]+)\}")
_GAP = max(WIDTHS)
#: Words scored together, and the length of a piece of a longer text.
WORDS = 1 << 17
#: Reviewed documents needed to learn anything.
FEWEST_REVIEWED = 6

#: What a byte counts as: letters as themselves in lower case, the rest as 0; and the letter a digit or sign may disguise.
_LETTERS = np.array([(c | 32) if chr(c).isalpha() and c < 128 else 0 for c in range(256)], np.uint8)
_DISGUISED = np.zeros(256, np.uint8)
_DISGUISED[np.frombuffer(b"013457@$", np.uint8)] = np.frombuffer(b"oieastas", np.uint8)
_JOINERS = np.zeros(256, bool)
_JOINERS[np.frombuffer(b".*_", np.uint8)] = True
_POWERS = np.array([pow(1_000_003, k, 2**32) for k in range(64)], np.uint32)


def language(lang: Column) -> Column:
    """en, de, fr or other, from codes in any case and with regions."""
    code = F.regexp_extract(F.lower(F.trim(F.coalesce(lang, F.lit("")))), r"^([a-z]+)", 1)
    out = F.lit("other")
    for name, codes in LANGUAGES.items():
        out = F.when(code.isin(*codes), name).otherwise(out)
    return out


def plain(text: str) -> str:
    """What needs whole strings: macros, wrapped and discretionary hyphens, letters beyond ASCII."""
    if "\\newcommand" in text or "\\def" in text or "\\providecommand" in text:
        text = expand_macros(text)
    if not text.isascii():
        text = fold_letters(text)
    if "{\\" in text:
        text = _GROUPED.sub(r"\1", text)
    if "\\-" in text:
        text = text.replace("\\-", "")
    if "-\n" in text or "-\r" in text or "- \n" in text:
        text = _WRAPPED.sub("", text)
    return text


def hashed(texts: list[str]) -> list[np.ndarray]:
    """The buckets of the words of each text, by array operations over all bytes at once.

    Commands are left out.  Dots, stars and underscores inside a word are dropped, digits inside one read as the letter they
    resemble, and four or more single letters with blanks between are one word.
    """
    return _buckets_of([plain(t).encode("ascii", "replace") for t in texts])


def _buckets_of(parts: list[bytes]) -> list[np.ndarray]:
    sizes = np.array([len(p) + 8 for p in parts])
    raw = np.frombuffer(b"".join(p + b"        " for p in parts), np.uint8)
    edge = np.cumsum(sizes)
    low = _LETTERS[raw]
    letter = low > 0
    inner = np.zeros(len(raw), bool)
    inner[1:-1] = letter[:-2] & letter[2:]
    odd = _DISGUISED[raw] > 0
    digit = inner & odd
    pair = np.zeros(len(raw), bool)  # two in a row after a letter also disguise a word's end
    pair[1:-1] = letter[:-2] & odd[1:-1] & odd[2:]
    digit |= pair
    digit[1:] |= pair[:-1]
    low = np.where(digit, _DISGUISED[raw], low)
    drop = inner & _JOINERS[raw]
    alone = letter.copy()
    alone[1:] &= ~letter[:-1]
    alone[:-1] &= ~letter[1:]
    blank = np.zeros(len(raw), bool)
    blank[1:-1] = alone[:-2] & alone[2:] & (raw[1:-1] == 32)
    run = np.zeros(len(raw), bool)
    run[:-4] = blank[:-4] & blank[2:-2] & blank[4:]
    if run.any():
        drop[2:] |= run[:-2]
        drop[4:] |= run[:-4]
        drop |= run
    kept = np.flatnonzero(~drop)
    low, raw = low[kept], raw[kept]
    edge = np.searchsorted(kept, edge)
    letter = low > 0
    step = np.diff(letter.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    command = (first > 0) & (raw[np.maximum(first - 1, 0)] == 92)
    at = np.flatnonzero(letter)
    begin = np.repeat(first, last - first)
    weighted = low[at].astype(np.uint32) * _POWERS[np.minimum(at - begin, 63)]
    if not len(first):
        return [np.zeros(0, np.int64) for _ in parts]
    offsets = np.cumsum(last - first) - (last - first)
    code = np.add.reduceat(weighted, offsets).astype(np.uint32)
    code ^= code >> np.uint32(15)
    code *= np.uint32(2_246_822_519)
    code ^= code >> np.uint32(13)
    bucket = (code % np.uint32(BUCKETS - 1)).astype(np.int64) + 1
    first, bucket = first[~command], bucket[~command]
    cuts = np.searchsorted(first, edge)
    return np.split(bucket, cuts[:-1])


@dataclass
class Network:
    embedding: np.ndarray
    filters: list[np.ndarray]  # per width: (width, EMBEDDING, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)  # by language, "" for the others; empty: nothing was learned

    @classmethod
    def fresh(cls, seed: int) -> Network:
        g = np.random.default_rng(seed)
        scale = lambda n: np.float32(1.0 / np.sqrt(n))
        return cls(
            g.standard_normal((BUCKETS, EMBEDDING), np.float32) * np.float32(0.3),
            [g.standard_normal((w, EMBEDDING, FILTERS), np.float32) * scale(w * EMBEDDING) for w in WIDTHS],
            np.zeros(len(WIDTHS) * FILTERS, np.float32), g.standard_normal(len(WIDTHS) * FILTERS, np.float32) * scale(len(WIDTHS) * FILTERS), -1.0,
        )

    def responses(self, ids: np.ndarray) -> np.ndarray:
        """Filter outputs (all filters x positions) of a gap-padded sequence."""
        x = self.embedding[ids]
        x[ids == 0] = 0
        flat = np.concatenate([f.transpose(0, 2, 1).reshape(-1, EMBEDDING) for f in self.filters])  # per width: offsets x filters
        y = flat @ x.T
        out, at = np.empty((len(WIDTHS) * FILTERS, len(ids)), np.float32), 0
        for k, w in enumerate(WIDTHS):
            total = out[k * FILTERS : (k + 1) * FILTERS]
            total[:] = y[at : at + FILTERS]
            for o in range(1, w):
                total[:, :-o] += y[at + o * FILTERS : at + (o + 1) * FILTERS, o:]
            at += w * FILTERS
        return out

    def pooled(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The greatest response of each filter per document, not below 0."""
        return np.maximum(np.maximum.reduceat(self.responses(ids), starts, axis=1).T + self.bias, 0.0)

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """Log-odds of documents; one without words is as one whose words say nothing.

        As many documents as make up ``WORDS`` words are scored together; a longer one is scored in pieces that overlap by the widest filter.
        """
        top = np.empty((len(docs), len(self.bias)), np.float32)
        for a, z in portions([len(d) + 2 * _GAP for d in docs], WORDS):
            if z == a + 1 and len(docs[a]) > WORDS:
                top[a] = self._pooled_long(docs[a])
            else:
                top[a:z] = self.pooled(*laid_out(docs[a:z]))
        return top @ self.out + self.out_bias

    def _pooled_long(self, doc: np.ndarray) -> np.ndarray:
        most = np.full(len(self.bias), -np.inf, np.float32)
        for ids, first, end in pieces(doc):
            most = np.maximum(most, self.responses(ids)[:, first:end].max(1))
        return np.maximum(most + self.bias, 0.0)

    def strongest(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(greatest response of each filter per document, the words from there on, as many as the widest filter sees).

        Documents are taken in portions and pieces as :meth:`scores` takes them.
        """
        top, seen = np.full((len(docs), len(self.bias)), -np.inf, np.float32), np.zeros((len(docs), len(self.bias), _GAP), np.int64)
        every = np.arange(len(self.bias))
        for a, z in portions([len(d) + 2 * _GAP for d in docs], WORDS):
            if z == a + 1 and len(docs[a]) > WORDS:
                parts = [(a, ids, first, end) for ids, first, end in pieces(docs[a])]
            else:
                ids, starts = laid_out(docs[a:z])
                parts = [(a + k, ids, first, end) for k, (first, end) in enumerate(zip(starts, np.r_[starts[1:], len(ids)]))]
            known = None
            for doc, ids, first, end in parts:
                if ids is not known:
                    resp, known = self.responses(ids), ids
                arg = resp[:, first:end].argmax(1) + first
                better = resp[every, arg] > top[doc]
                top[doc, better] = resp[every, arg][better]
                seen[doc, better] = ids[np.minimum(arg[better, None] + np.arange(_GAP), len(ids) - 1)]
        return top, seen


def portions(sizes: Sequence[int], most: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items of at most ``most`` in all (and ``rows`` items); a greater item is alone."""
    a = 0
    while a < len(sizes):
        z, held = a + 1, sizes[a]
        while z < len(sizes) and held + sizes[z] <= most and (rows is None or z < a + rows):
            held += sizes[z]
            z += 1
        yield a, z
        a = z


def pieces(doc: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """A long document in pieces that overlap by the widest filter: (words between gaps, first and end of the positions that count)."""
    for a in range(0, len(doc), WORDS):
        ids = laid_out([doc[a : a + WORDS + _GAP - 1]])[0]
        # positions before and beyond are those of the pieces there
        yield ids, _GAP if a else 0, _GAP + WORDS if a + WORDS < len(doc) else len(ids)


def laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents in one sequence, each between two gaps as wide as the widest filter, and where the gaps before them start.

    No filter reaches from one document, or the gaps about it, to the words of another.
    """
    gap = np.zeros(_GAP, np.int64)
    sizes = np.array([len(d) + 2 * _GAP for d in docs])
    return np.concatenate([p for d in docs for p in (gap, d, gap)]), np.cumsum(sizes) - sizes


class Training:
    """Fits a network to documents that come block by block, by Adam on balanced batches; gradients flow only through each filter's strongest position.

    ``spread``: in how many of all the ``documents`` each word stands.  Each block is gone through at least once, and as often as makes
    ``updates`` over all blocks; the rarer kind comes again until the other is through.  A block with one kind only borrows
    the other from the last that had it.
    """

    def __init__(self, spread: np.ndarray, documents: int, seed: int = 7, updates: int = 400, batch: int = 48, rate: float = 0.01):
        self.net, self.g = Network.fresh(seed), np.random.default_rng(seed + 1)
        # names and other words of only a few documents would be learned by heart: they say nothing, nor do words never seen
        self.common = spread >= max(FEWEST, min(documents // ONE_IN, ENOUGH))
        self.documents, self.updates, self.half, self.rest, self.rate = documents, updates, batch // 2, batch - batch // 2, rate
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self._dense()]
        self.e1, self.e2 = np.zeros_like(self.net.embedding), np.zeros_like(self.net.embedding)
        self.b1 = self.b2 = 0.0
        self.step = 0
        self.last: list[list[tuple[np.ndarray, float]]] = [[], []]  # not abusive, abusive: of the last block that had any
        self.docs: list[np.ndarray] = []
        self.target: list[float] = []
        self.words = 0

    def _dense(self) -> list[np.ndarray]:
        return [*self.net.filters, self.net.bias, self.net.out]

    def add(self, doc: np.ndarray, target: float) -> None:
        if self.docs and (len(self.docs) >= BLOCK or self.words + len(doc) > BLOCK_WORDS):
            self._block()
        self.docs.append(np.where(self.common[doc], doc, 0))
        self.target.append(target)
        self.words += len(doc)

    def _block(self) -> None:
        kinds: list[list[tuple[np.ndarray, float]]] = [[], []]
        for d, t in zip(self.docs, self.target):
            kinds[int(t > 0.5)].append((d, t))
        size = len(self.docs)
        self.last = [new or old for new, old in zip(kinds, self.last)]
        self.docs, self.target, self.words = [], [], 0
        other, abusive = self.last
        if not other or not abusive:  # nothing to tell it from yet
            abusive = other = abusive or other
        count = max(-(-len(kinds[1]) // self.half), -(-len(kinds[0]) // self.rest), -(-self.updates * size // self.documents))
        picks = zip(self._turns(len(abusive), self.half, count), self._turns(len(other), self.rest, count))
        for one, two in picks:
            self._update([*(abusive[k] for k in one), *(other[k] for k in two)])

    def _turns(self, size: int, each: int, count: int) -> np.ndarray:
        """``count`` draws of ``each`` of ``size`` items; none comes again before all have come."""
        rounds = -(-each * count // size)
        return np.concatenate([self.g.permutation(size) for _ in range(rounds)])[: each * count].reshape(count, each)

    def _update(self, pick: list[tuple[np.ndarray, float]]) -> None:
        net, g, rate = self.net, self.g, self.rate
        self.step += 1
        step, target = self.step, np.array([t for _, t in pick])
        chosen = []
        for p, _ in pick:
            d = p.copy()
            d[g.random(len(d)) < 0.1] = 0
            chosen.append(d)
        resp, seen = net.strongest(chosen)
        top = resp + net.bias
        act = np.maximum(top, 0.0)
        keep = (g.random(act.shape) > 0.3) / np.float32(0.7)
        logit = (act * keep) @ net.out + net.out_bias
        err = (1.0 / (1.0 + np.exp(-logit)) - target) / len(pick)
        d_act = err[:, None] * net.out * keep * (top > 0)
        grads = []
        touched, d_emb = [], []
        for k, w in enumerate(WIDTHS):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            window, dk = seen[:, cols, :w], d_act[:, cols].astype(np.float32)  # docs x filters x w
            vec = net.embedding[window] * (window > 0)[..., None]
            grads.append(np.einsum("df,dfwe->wef", dk, vec))
            d_vec = np.einsum("df,wef->dfwe", dk, net.filters[k])
            live = (window > 0) & (dk != 0)[:, :, None]
            touched.append(window[live])
            d_emb.append(d_vec[live])
        grads += [d_act.sum(0).astype(np.float32), ((act * keep).T @ err).astype(np.float32) + np.float32(1e-4) * net.out]
        for p, d, (m, v) in zip(self._dense(), grads, self.moments):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        b = float(err.sum())
        self.b1, self.b2 = 0.9 * self.b1 + 0.1 * b, 0.999 * self.b2 + 0.001 * b * b
        net.out_bias -= rate * (self.b1 / (1 - 0.9**step)) / (np.sqrt(self.b2 / (1 - 0.999**step)) + 1e-7)
        who, back = np.unique(np.concatenate(touched), return_inverse=True)
        grad = np.zeros((len(who), EMBEDDING), np.float32)
        np.add.at(grad, back, np.concatenate(d_emb))
        self.e1[who] += 0.1 * (grad - self.e1[who])
        self.e2[who] += 0.01 * (grad * grad - self.e2[who])
        net.embedding[who] -= rate * self.e1[who] / (np.sqrt(self.e2[who]) + 1e-5)

    def done(self) -> Network:
        """The network, once all documents were added; if all were of one kind, one that takes every document for it."""
        if self.docs:
            self._block()
        other, abusive = self.last
        if not other or not abusive:
            self.net.out[:], self.net.out_bias = 0, 10.0 if abusive else -10.0
            return self.net
        self.net.embedding[~self.common] = 0
        return self.net


def spread_of(docs: Sequence[np.ndarray]) -> np.ndarray:
    """In how many of the documents each word stands."""
    spread = np.zeros(BUCKETS, np.int64)
    for d in docs:
        spread[np.unique(d)] += 1
    return spread


def train(docs: list[np.ndarray], target: np.ndarray, seed: int = 7, updates: int = 400) -> Network:
    """The network of a :class:`Training` on documents in memory."""
    training = Training(spread_of(docs), len(docs), seed, updates)
    for d, t in zip(docs, target):
        training.add(d, t)
    return training.done()


def best_threshold(score: np.ndarray, likely: np.ndarray, least: float = -np.inf) -> float:
    """The cut with the best expected F1 on held-out scores, halfway between neighbouring ones, not below ``least``."""
    order = np.argsort(-score, kind="stable")
    s, y = score[order], likely[order]
    f1 = 2.0 * np.cumsum(y) / (np.arange(1, len(y) + 1) + max(1e-9, y.sum()))
    k = int(f1.argmax())
    return max(least, float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] - 1.0))


def vote_model(yes: np.ndarray, no: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """(log-likelihood ratio of each document's votes, log-odds of the share of abusive documents).

    Expectation-maximisation over the raters' two error rates and the share; reviewers err, and most documents have one vote.
    """
    share, right, wrong = 0.1, 0.85, 0.1
    for _ in range(rounds):
        ratio = yes * np.log(right / wrong) + no * np.log((1 - right) / (1 - wrong))
        p = 1.0 / (1.0 + np.exp(-np.clip(ratio + np.log(share / (1 - share)), -30, 30)))
        share = float(np.clip(p.mean(), 0.005, 0.6))
        right = float(np.clip((p * yes).sum() / max(1e-9, (p * (yes + no)).sum()), 0.6, 0.97))
        wrong = float(np.clip(((1 - p) * yes).sum() / max(1e-9, ((1 - p) * (yes + no)).sum()), 0.005, 0.4))
    ratio = yes * np.log(right / wrong) + no * np.log((1 - right) / (1 - wrong))
    return ratio, float(np.log(share / (1 - share)))


def calibrated(score: np.ndarray, likely: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Held-out scores as log-odds: logistic regression of the likely labels on the score."""
    z = (score - score.mean()) / max(1e-6, score.std())
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * z + b, -30, 30)))
        w, off = np.maximum(p * (1 - p), 1e-4), p - likely
        g, h = np.array([(off * z).sum() + 0.1 * a, off.sum()]), np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum()]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return a * z + b


def cross_scores(docs: list[np.ndarray], likely: np.ndarray, folds: int, updates: int) -> np.ndarray:
    """Scores of every document by a network trained without it."""
    out, fold = np.zeros(len(docs)), np.arange(len(docs)) % folds
    for f in range(folds):
        inner, outer = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(outer):
            part = train([docs[i] for i in inner], likely[inner], seed=11 + f, updates=updates)
            out[outer] = part.scores([docs[i] for i in outer])
    return out


def nothing_learned(rows: int, abusive: int) -> Network:
    """What too few reviews, or reviews all of one kind, teach: nothing (or, if all are voted abusive, everything) is abusive."""
    net = Network.fresh(0)
    net.out[:], net.out_bias = 0, 10.0 if rows >= FEWEST_REVIEWED and abusive == rows else -10.0
    return net


def learned(yes: np.ndarray, no: np.ndarray, langs: np.ndarray, cross: Callable[[np.ndarray], np.ndarray], whole: Callable[[np.ndarray], Network]) -> Network:
    """Train on documents with votes for abusive and against, and calibrate on held-out folds.

    ``cross`` scores each document by a network trained without it on the beliefs given, ``whole`` trains on all.  Votes give a
    first belief per document; networks trained on it score documents they haven't seen, and score and votes
    together give the belief the final network learns.  A single mistaken vote is so outweighed by a text that says
    nothing abusive.  With fewer than ``FEWEST_REVIEWED`` documents, or none of either kind, see :func:`nothing_learned`: no
    thresholds are set, and results say so.
    """
    if len(yes) < FEWEST_REVIEWED or not (yes > no).any() or not (no > yes).any():
        return nothing_learned(len(yes), int((yes > no).sum()))
    ratio, prior = vote_model(yes, no)
    sigmoid = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
    likely = sigmoid(ratio + prior)
    first = cross(np.where(yes > no, np.maximum(likely, 0.55), likely))
    likely = sigmoid(calibrated(first, likely) + ratio)
    held = cross(likely)
    odds = calibrated(held, likely)
    likely = sigmoid(odds + ratio)
    net = whole(likely)
    # below even the least probability a cut would pay off at, too little was learned for a cut there
    least = float(held[odds >= LEAST_ODDS].min()) if (odds >= LEAST_ODDS).any() else float(held.max())
    usual = best_threshold(held, likely, least)
    net.thresholds = {"": usual}
    for lang in set(langs.tolist()):
        at = langs == lang
        if likely[at].sum() >= LANGUAGE_CASES:
            net.thresholds[lang] = best_threshold(held[at], likely[at], least)
    return net


def fit(rows: list[tuple[np.ndarray, str, int, int]], folds: int = 3, updates: int = 400) -> Network:
    """What is :func:`learned` from (hashed words, language, votes for abusive, votes against) in memory."""
    docs = [np.asarray(r[0]) for r in rows]
    yes, no, langs = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float), np.array([r[1] for r in rows])
    return learned(yes, no, langs, lambda target: cross_scores(docs, target, folds, updates), lambda target: train(docs, target, updates=updates))


def verdicts(labels: DataFrame) -> DataFrame:
    """(doc_id, yes, no): votes per document.

    A rater counts once per document and not at all if they contradict themselves; missing votes don't count.
    """
    votes = labels.where("doc_id is not null and abusive in (0, 1)").groupBy("doc_id", "rater").agg(F.avg("abusive").alias("vote"))
    return votes.groupBy("doc_id").agg(F.count_if(F.col("vote") == 1).alias("yes"), F.count_if(F.col("vote") == 0).alias("no")).where("yes + no > 0")


def reviewed(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, doc_id, words, language, yes, no): every document that has a text and votes, its words hashed where the texts lie (two bytes each)."""
    ship_code(documents.sparkSession)
    votes = verdicts(labels).withColumn("h", F.xxhash64("doc_id"))
    if small_enough(votes, VOTE_BYTES, SHIP_LIMIT):
        votes = F.broadcast(votes)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text", language(F.col("lang")).alias("language"))
    both = texts.join(votes, "doc_id").select("h", "doc_id", "text", "language", "yes", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in portions([len(t) for t in b.column(2).to_pylist()], CHARS, 64):
                part = b.slice(a, z - a)
                packed = pa.array([d.astype("<u2").tobytes() for d in hashed(part.column(2).to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:2], packed, *part.columns[3:]], names=["h", "doc_id", "words", "language", "yes", "no"])

    return both.mapInArrow(run, "h bigint, doc_id bigint, words binary, language string, yes bigint, no bigint")


class Reviewed:
    """The reviewed documents as a table in the shared folder, trained on and scored in tasks.

    The driver holds the numbers of each document (place in the table, votes, score), in the order of the hashes, in which trainings
    meet them; the words stay with the tasks.  A training is one task, which reads all its documents in that order and holds a block.
    """

    def __init__(self, documents: DataFrame, labels: DataFrame, folds: int = 3, updates: int = 400):
        self.folds, self.updates = folds, updates
        self.table = durable(reviewed(documents, labels)).withColumn("place", F.monotonically_increasing_id())
        told = self.table.select("place", "h", F.xxhash64("words", "language").alias("tie"), "language", "yes", "no").toArrow()
        place, h, tie, yes, no = (told.column(c).to_numpy() for c in ("place", "h", "tie", "yes", "no"))
        order = np.lexsort((tie, h))
        self.yes, self.no, self.langs = yes[order].astype(float), no[order].astype(float), np.array(told.column("language").to_pylist(), str)[order]
        by_place = np.argsort(place)
        rank = np.empty(len(place), np.int64)
        rank[order] = np.arange(len(place))
        self.context = documents.sparkSession.sparkContext
        self.places = self.context.broadcast((place[by_place], rank[by_place]))
        self.spreads: np.ndarray | None = None

    def _spread(self) -> np.ndarray:
        """In how many documents of each fold each word stands."""
        if self.spreads is None:
            places, folds = self.places, self.folds

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                spread = np.zeros((folds, BUCKETS), np.int64)
                for b in batches:
                    for rank, words in zip(ranks(places, b.column(0)), b.column(1)):
                        spread[rank % folds, np.unique(np.frombuffer(words.as_buffer(), "<u2"))] += 1
                fold, word = np.nonzero(spread)
                yield pa.RecordBatch.from_arrays([pa.array(fold), pa.array(word), pa.array(spread[fold, word])], names=["fold", "word", "n"])

            counts = self.table.select("place", "words").mapInArrow(run, "fold bigint, word bigint, n bigint")
            told = counts.groupBy("fold", "word").agg(F.sum("n").alias("n")).toArrow()
            self.spreads = np.zeros((folds, BUCKETS), np.int64)
            self.spreads[told.column("fold").to_numpy(), told.column("word").to_numpy()] = told.column("n").to_numpy()
        return self.spreads

    def _trained(self, target: np.ndarray, left_out: list[int | None], seed: int) -> list[Network]:
        """A network per training, each of all documents but those of the fold it leaves out."""
        sizes = np.bincount(np.arange(len(target)) % self.folds, minlength=self.folds)
        spreads = self._spread()
        start = [(spreads.sum(0), int(sizes.sum())) if f is None else (spreads.sum(0) - spreads[f], int(sizes.sum() - sizes[f])) for f in left_out]
        places, starts, targets, updates = self.places, self.context.broadcast(start), self.context.broadcast(target), self.updates

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rank = ranks(places, b.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(targets.value[rank]), b.column(1)], names=["rank", "target", "words"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, training = None, None
            packed = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([pickle.dumps(training.done())], pa.binary())], names=["training", "net"])
            for b in batches:
                for k, t, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    if k != at:
                        if training:
                            yield packed()
                        at, training = k, Training(*starts.value[k], seed + k, updates)
                    training.add(np.frombuffer(words.as_py(), "<u2"), t)
            if training:
                yield packed()

        which = F.array(*(F.when(F.lit(f is None) | (F.col("rank") % self.folds != (f or 0)), F.lit(k)) for k, f in enumerate(left_out)))
        rows = self.table.select("place", "words").mapInArrow(told, "rank bigint, target double, words binary")
        spread = rows.withColumn("training", F.explode(F.array_compact(which))).repartitionById(len(left_out), F.col("training"))
        nets = spread.sortWithinPartitions("training", "rank").select("training", "target", "words").mapInArrow(run, "training int, net binary").collect()
        found = {r["training"]: pickle.loads(r["net"]) for r in nets}
        return [found[k] if k in found else Training(*start[k], seed + k).done() for k in range(len(left_out))]

    def cross(self, target: np.ndarray) -> np.ndarray:
        """Scores of every document by a network trained without its fold."""
        folds, places = self.folds, self.places
        nets = self.context.broadcast(self._trained(target, list(range(folds)), 11))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rank, docs = ranks(places, b.column(0)), [np.frombuffer(w.as_py(), "<u2") for w in b.column(1)]
                score = np.zeros(len(docs))
                for f in set((rank % folds).tolist()):
                    of = np.flatnonzero(rank % folds == f)
                    score[of] = nets.value[f].scores([docs[k] for k in of])
                yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(score)], names=["rank", "score"])

        told = self.table.select("place", "words").mapInArrow(run, "rank bigint, score double").toArrow()
        out = np.zeros(len(target))
        out[told.column("rank").to_numpy()] = told.column("score").to_numpy()
        return out

    def whole(self, target: np.ndarray) -> Network:
        return self._trained(target, [None], 7)[0]


def ranks(places: Broadcast, place: pa.Array) -> np.ndarray:
    known, rank = places.value
    return rank[np.searchsorted(known, place.to_numpy())]


def fit_reviewed(documents: DataFrame, labels: DataFrame, folds: int = 3, updates: int = 400) -> Network:
    """What is :func:`learned` from all reviewed documents."""
    known = Reviewed(documents, labels, folds, updates)
    return learned(known.yes, known.no, known.langs, known.cross, known.whole)


def scored(documents: DataFrame, net: Network) -> DataFrame:
    """(doc_id, source, language, score, abusive, threshold): every document's probability and whether it passes the threshold.

    ``threshold`` says which one held: its language's, that of ``all`` documents (where a language has too few reviewed cases for its own),
    or ``none``, if the reviews taught nothing.  Whole texts are scored.  Null and empty texts score as text without words, and
    are never abusive.
    """
    ship_code(documents.sparkSession)
    shipped = documents.sparkSession.sparkContext.broadcast(net)
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("language", pa.string()), ("score", pa.float64()), ("abusive", pa.bool_()), ("threshold", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        usual = model.thresholds.get("", 0.0)
        for b in batches:
            for a in range(0, b.num_rows, 32):
                part = b.slice(a, 32)
                docs = hashed([t or "" for t in part.column(3).to_pylist()])
                logit = model.scores(docs).astype(np.float64)
                langs = part.column(2).to_pylist()
                cut = np.array([model.thresholds.get(x, usual) for x in langs])
                basis = pa.array([x if x in model.thresholds else "all" if model.thresholds else "none" for x in langs])
                full = np.array([len(d) > 0 for d in docs])
                score = 1.0 / (1.0 + np.exp(-np.clip(logit, -50, 50)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(score), pa.array((logit > cut) & full), basis], schema=schema)

    lean = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source")).alias("source"), language(F.col("lang")).alias("language"), "text")
    return lean.mapInArrow(run, "doc_id bigint, source string, language string, score double, abusive boolean, threshold string")


def rates(scores: DataFrame) -> DataFrame:
    """(source, documents, abusive, rate): per source; documents without a source stand under null."""
    return scores.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("abusive").alias("abusive")).withColumn("rate", F.col("abusive") / F.col("documents"))
