"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

Tokens are the letters between white space, lower-cased, what stands between them
dropped (i.d.i-o*t is one token) and single letters in a row joined (i d i o t).
The kernel of a token with a landmark is the gap-weighted subsequence kernel: common
subsequences, each letter or gap they span counting DECAY, divided by the landmark's
own, so inserted letters lower it and endings don't. Landmarks are words and word
beginnings that labelled toxic texts of the sample hold far oftener than others. A
sentence's vector is the largest kernel of its tokens with each landmark, mapped by
the inverse root of the landmarks' kernel matrix. A linear SVM (squared hinge) is
trained on sentences: those of non-toxic texts count against; of a toxic text those
count for that hold a landmark whole, or else the one that scores highest, chosen anew
each round; and each of these also with its kernel values as one and two inserted
letters would leave them. A text's margin is its highest sentence's; the score is the
margin's logistic, fitted on the sample. All of a text is read.

Bounds, all on what is fitted: SAMPLE labelled rows a class, CANDIDATES pieces, LANDMARKS.
At scoring, values under LEAST count as 0 by definition of the features: at LEAST, an
insult with four inserted letters (DECAY ** 4) and no other likeness is left out. Words
are passed over only where the kernel is 0: without a common subsequence of its order.

Defined results: null is the empty text; texts without tokens have the score of an
empty sentence; without both labels in the sample every score is 0; rows that repeat
are scored alike; null doc_ids are scored; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import ids, samples, workers
from textveil.llm import shingles as sh
from textveil.llm.quality import labelled_sample

ORDER = 4  # at least; see order_of()
DECAY = 0.7
WINDOW = 8
LEAST = 0.3  # smaller kernel values count as none: more than three inserted letters
LANDMARKS = 64  # at most: the Nystroem basis
CANDIDATES = 4_000  # pieces of the sample that landmarks are chosen from: those in most toxic texts
SAMPLE = 3_000  # labelled rows of each class, about
CHUNK_BYTES = 1 << 20
WIDTHS = (6, 9, 12, 16, 24, 40)  # words of like lengths are compared together,
PAIRS = 8_192  # so many at a time

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BIT = np.uint32(1) << np.array([(b - 97) % 26 if b < 128 else 26 + b % 6 for b in range(256)], np.uint32)


@dataclass
class Tokens:
    """Tokens of many texts: letters of all, where tokens start, their texts and sentences."""

    letters: np.ndarray
    starts: np.ndarray
    text: np.ndarray
    sentence: np.ndarray  # numbered over all texts
    sentence_text: np.ndarray  # of each sentence


def tokens(texts: list[bytes]) -> Tokens:
    raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    # capitals of Latin-1 in UTF-8: C3 80..9E
    high = np.zeros(len(raw), bool)
    high[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    raw = raw + np.uint8(32) * high
    space, letter = _SPACE[raw], _LETTER[raw]
    text_end = np.cumsum([len(t) + 1 for t in texts])
    stop = (raw == 10) | (np.isin(raw, (33, 46, 63)) & np.r_[space[1:], True])
    sentence = np.cumsum(stop) - stop  # a mark belongs to the sentence it ends
    at = np.flatnonzero(letter)
    word = np.cumsum(space)[at]
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(at)])
    text = np.searchsorted(text_end, at[first], side="right") if len(at) else first
    joined = np.zeros(len(first), bool)
    joined[1:] = (size[1:] == 1) & (size[:-1] == 1) & (text[1:] == text[:-1])
    starts, text = first[~joined], text[~joined]
    n = int(sentence[-1]) + 1 if len(raw) else 0
    sentence_text = np.zeros(n, np.int64)
    sentence_text[sentence] = np.searchsorted(text_end, np.arange(len(raw)), side="right")
    return Tokens(raw[at], starts, text, sentence[at[starts]] if len(starts) else starts, sentence_text)


def kernel(words: np.ndarray, zs: np.ndarray, order: int) -> np.ndarray:
    """Subsequence kernel of each row of words with that of zs: the most that WINDOW
    successive end letters of the word give, so that long words gather no weak matches.

    Rows are padded, words with 0 and zs with 1, which match nothing.
    """
    n, width, m = len(words), words.shape[1], zs.shape[1]
    words, zs = np.ascontiguousarray(words.T), np.ascontiguousarray(zs.T)
    lam = np.float32(DECAY)
    both = lam * lam
    # before[i][j]: weight of the common subsequences one letter shorter that end before letters i and j
    before = np.ones((width + 1, m + 1, n), np.float32)
    match = [[(words[i] == zs[j]) * both for j in range(m)] for i in range(width)]
    for step in range(order - 1):
        after = np.zeros((width + 1, m + 1, n), np.float32)
        for i in range(step, width):
            run = np.zeros(n, np.float32)
            for j in range(step, m):
                run *= lam
                run += before[i, j] * match[i][j]
                np.multiply(after[i, j + 1], lam, out=after[i + 1, j + 1])
                after[i + 1, j + 1] += run
        before = after
    ends = np.zeros((width + 1, n), np.float32)
    for i in range(order - 1, width):
        for j in range(order - 1, m):
            ends[i + 1] += before[i, j] * match[i][j]
    sums = np.cumsum(ends, axis=0)
    return (sums[WINDOW:] - sums[:-WINDOW]).max(axis=0) if width > WINDOW else sums[-1]


def order_of(z: bytes) -> int:
    """Longer landmarks are compared by longer subsequences."""
    return max(ORDER, len(z) - 2)


def _rows(strings: list[bytes], pad: int) -> np.ndarray:
    out = np.full((len(strings), max(map(len, strings))), pad, np.uint8)
    for i, z in enumerate(strings):
        out[i, : len(z)] = np.frombuffer(z, np.uint8)
    return out


def _padded(tok: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    width = int(lengths.max())
    cols = np.arange(width)
    index = np.minimum(starts[:, None] + cols, len(tok) - 1)
    return np.where(cols < lengths[:, None], tok[index], 0).astype(np.uint8)


def _mask(z: bytes) -> int:
    return int(np.bitwise_or.reduce(_BIT[np.frombuffer(z, np.uint8)]))


def _need(z: bytes) -> int:
    """The fewest different letter bits of a subsequence of z that counts."""
    from itertools import combinations

    return min(_mask(bytes(c)).bit_count() for c in combinations(z, min(order_of(z), len(z))))


def _places(z: bytes) -> np.ndarray:
    """Of each byte, the bits of its places in z."""
    out = np.zeros(256, np.uint64)
    for i, b in enumerate(z):
        out[b] |= np.uint64(1) << np.uint64(i)
    return out


def _shares(words: np.ndarray, places: np.ndarray, marks: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """Whether each row of words (padded with 0) and its mark have a common subsequence of
    the mark's order: without one the kernel is 0. A bit of v falls for each letter of the longest."""
    v = np.full(len(words), ~np.uint64(0))
    for column in np.ascontiguousarray(words.T):
        u = v & places[marks, column]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v) >= orders[marks]


@dataclass
class Model:
    landmarks: list[bytes]
    own: np.ndarray = field(default_factory=lambda: np.zeros(0))  # kernel of each with itself
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # on kernel values
    bias: float = -1.0
    slope: float = 0.0
    shift: float = -50.0

    def __post_init__(self) -> None:
        self.masks = [(np.uint32(_mask(z)), _need(z)) for z in self.landmarks]
        self.places = np.array([_places(z) for z in self.landmarks], np.uint64).reshape(-1, 256)
        self.orders = np.array([order_of(z) for z in self.landmarks], np.int64)
        self.rows = _rows(self.landmarks, 1) if self.landmarks else np.zeros((0, 0), np.uint8)

    def sentences(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values of the sentences that have any, and their texts."""
        t = tokens(texts)
        found = np.zeros((len(t.sentence_text), len(self.landmarks)), np.float32)
        if len(t.starts) and self.landmarks:
            lengths = np.diff(np.r_[t.starts, len(t.letters)])
            value = (t.letters.astype(np.uint64) + np.uint64(1)) * sh.powers(sh._P, len(t.letters))
            hashes = np.add.reduceat(value, t.starts) * sh.powers(sh._INVERSE, len(t.letters))[t.starts]
            _, at, back = np.unique(hashes, return_index=True, return_inverse=True)
            starts, sizes = t.starts[at], lengths[at]
            masks = np.bitwise_or.reduceat(_BIT[t.letters], t.starts)[at]
            per_word = np.zeros((len(at), len(self.landmarks)), np.float32)
            near = []
            for k, (mask, need) in enumerate(self.masks):
                near.append(np.flatnonzero((np.bitwise_count(masks & mask) >= need) & (sizes >= self.orders[k])))
            for order in np.unique(self.orders):
                of = np.flatnonzero(self.orders == order)
                mark = np.repeat(of, [len(near[k]) for k in of])
                word = np.concatenate([near[k] for k in of])
                sort = np.argsort(sizes[word], kind="stable")
                mark, word = mark[sort], word[sort]
                mark, word = self._near(t.letters, starts, sizes, mark, word)
                edges = [0, *np.searchsorted(sizes[word], WIDTHS, side="right"), len(word)]
                for low, high in zip(edges, edges[1:], strict=False):
                    for at in range(low, high, PAIRS):
                        w, k = word[at : min(high, at + PAIRS)], mark[at : min(high, at + PAIRS)]
                        rows = self.rows[k]
                        rows = rows[:, : int((rows != 1).sum(axis=1).max())]
                        per_word[w, k] = kernel(_padded(t.letters, starts[w], sizes[w]), rows, int(order)) / self.own[k]
            per_word[per_word < LEAST] = 0
            some = np.flatnonzero(per_word[back].any(axis=1))
            np.maximum.at(found, t.sentence[some], np.minimum(per_word[back[some]], 1.5))
        keep = found.any(axis=1)
        return found[keep], t.sentence_text[keep]

    def _near(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray, mark: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs, in order of their words' sizes, whose kernel isn't 0."""
        keep = np.zeros(len(word), bool)
        edges = [0, *np.searchsorted(sizes[word], WIDTHS, side="right"), len(word)]
        for low, high in zip(edges, edges[1:], strict=False):
            for at in range(low, high, PAIRS):
                to = min(high, at + PAIRS)
                w = word[at:to]
                keep[at:to] = _shares(_padded(letters, starts[w], sizes[w]), self.places, mark[at:to], self.orders)
        return mark[keep], word[keep]

    def score(self, texts: list[bytes]) -> np.ndarray:
        margin = np.full(len(texts), self.bias)
        found, text = self.sentences(texts)
        if len(found):
            np.maximum.at(margin, text, found @ self.weights + self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def _own(z: bytes) -> float:
    return float(kernel(_rows([z], 0), _rows([z], 1), order_of(z))[0])


def candidates(sample: DataFrame) -> DataFrame:
    """(piece, toxic, clean): words and word beginnings with the sample's texts that hold them.

    Near copies count once: of texts with an equal least shingle hash, one stays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for label, text in zip(pdf["label"], pdf["text"], strict=True):
                raw = (text or "").encode()
                least = sh.shingles(*sh.words([raw]))[0]
                t = tokens([raw])
                ends = np.r_[t.starts[1:], len(t.letters)]
                found = set()
                for a, b in zip(t.starts, ends, strict=True):
                    w = t.letters[a:b].tobytes()
                    if len(w) >= ORDER:
                        found |= {w[:n] for n in (4, 5, 6, 7)}
                        if len(w) <= 12:
                            found.add(w)
                yield pd.DataFrame({"label": [label], "least": [int(least.min().astype(np.int64)) if len(least) else 0], "pieces": [[p.decode("latin-1") for p in sorted(found)]]})

    texts = sample.select("label", "text").mapInPandas(workers.lean(run), "label int, least long, pieces array<string>")
    texts = texts.groupBy("label", "least").agg(F.max("pieces").alias("pieces"))
    return texts.select("label", F.explode("pieces").alias("piece")).groupBy("piece").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")
    )


def choose(found: list[tuple[str, int, int]], toxic: int, clean: int, many: int = LANDMARKS) -> list[bytes]:
    """Pieces typical of toxic texts, of each family of beginnings the longest that is as frequent."""
    least = max(3, 0.01 * toxic)
    good = {p: t for p, t, c in found if t >= least and c / max(clean, 1) * 20 <= t / max(toxic, 1)}
    chosen: list[str] = []
    for piece in sorted(good, key=lambda p: (-good[p], p)):
        longest = max((p for p in good if p.startswith(piece) and good[p] >= 0.95 * good[piece]), key=lambda p: (len(p), p))
        if not any(longest.startswith(z[:4]) and (longest.startswith(z) or z.startswith(piece)) for z in chosen):
            chosen.append(longest)
        if len(chosen) == many:
            break
    return [z.encode("latin-1") for z in chosen]


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and bias (last) of the squared-hinge SVM."""
    x = np.column_stack([x, np.ones(len(x))])
    v = np.zeros(x.shape[1])
    reg = np.full(len(v), ridge * weight.sum())
    reg[-1] *= 1e-3
    for _ in range(30):
        slack = 1 - y * (x @ v)
        on = slack > 0
        grad = reg * v - x[on].T @ (weight[on] * y[on] * slack[on])
        step = np.linalg.solve((x[on] * weight[on, None]).T @ x[on] + np.diag(reg), grad)
        v -= step
        if np.abs(step).max() < 1e-9:
            break
    return v


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that fit labels to margins; classes weigh the same."""
    high, low = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (high + 1) / (high + 2), 1 / (low + 2))
    w = np.where(y > 0, 0.5 / high, 0.5 / low)
    x, v = np.column_stack([m, np.ones(len(m))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        v -= np.linalg.solve(h, x.T @ (w * (p - goal)) + 1e-6 * v)
        v = np.clip(v, -40, 40)
    return max(float(v[0]), 1e-3), float(v[1])


def fit(sample: DataFrame) -> Model:
    """Learn from sample (text, label 0 or 1), all of it; it must be bounded."""
    totals = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return Model([])
    pieces = candidates(sample)
    typical = [tuple(r) for r in pieces.filter((F.col("toxic") >= 3) & (F.col("toxic") > F.col("clean"))).orderBy(F.desc("toxic"), "piece").limit(CANDIDATES).collect()]
    landmarks = choose(typical, totals[1], totals[0])
    if not landmarks:
        return Model([])
    model = Model(landmarks)
    model.own = np.array([_own(z) for z in landmarks])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = 0
            for part in sh.chunks(((t or "").encode() for t in pdf["text"]), CHUNK_BYTES):
                found, text = model.sentences(part)
                yield pd.DataFrame({"label": pdf["label"].iloc[at : at + len(part)].to_numpy(), "rows": [found[text == i].astype("<f4").tobytes() for i in range(len(part))]})
                at += len(part)

    got = sorted((r["label"], bytes(r["rows"])) for r in sample.select("label", "text").mapInPandas(workers.lean(run), "label int, rows binary").collect())
    bags = [(label, np.frombuffer(rows, "<f4").reshape(-1, len(landmarks)).astype(float)) for label, rows in got]
    cross = np.array([[kernel(_rows([a], 0), _rows([b], 1), order_of(b))[0] for b in landmarks] for a in landmarks], float)
    cross /= np.sqrt(np.outer(model.own, model.own))
    values, vectors = np.linalg.eigh((cross + cross.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    against = np.concatenate([np.zeros((1, len(landmarks))), *(b for label, b in bags if label == 0)]) @ root
    toxic = [b for label, b in bags if label == 1 and len(b)]
    if not toxic:
        return Model([])
    for around in range(3):
        # of a toxic text, the sentences that hold a landmark whole, or else its best
        picked = [b[b.max(axis=1) >= 0.99] if (b.max(axis=1) >= 0.99).any() else b[[np.argmax(b.sum(axis=1) if not around else b @ model.weights)]] for b in toxic]
        whole = np.concatenate(picked)
        # each once as it stands, once as if a letter, once as if two had been inserted
        best = np.concatenate([whole, DECAY * whole, DECAY**2 * whole]) @ root
        x = np.concatenate([against, best])
        y = np.r_[-np.ones(len(against)), np.ones(len(best))]
        weight = np.where(y > 0, 0.5 / len(best), 0.5 / len(against))
        weight[0] = 0.25  # the empty sentence
        v = _newton(x, y, weight)
        model.weights, model.bias = root @ v[:-1], float(v[-1])
    margins = np.array([max((b @ model.weights).max(initial=0.0), 0.0 if not len(b) else -9e9) + model.bias for _, b in bags])
    model.slope, model.shift = _logistic(margins, np.array([1 if label else -1 for label, _ in bags]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [model.score(part) for part in sh.chunks(((t or "").encode() for t in pdf["text"]), CHUNK_BYTES)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": np.concatenate(got) if got else []})

    rows = docs.select(ids.filled("doc_id"), "text")
    return rows.mapInPandas(workers.lean(run), "doc_id long, score double").withColumn("doc_id", ids.emptied("doc_id"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(labelled_sample(docs, labels, "toxic", SAMPLE))
    found = score(docs, model)
    return found.select("doc_id", samples.held_out("doc_id", 5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
