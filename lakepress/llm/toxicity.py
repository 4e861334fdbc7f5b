"""Toxic spans by a linear-chain conditional random field (operator 4).

Token labels come from labelled documents: word and prefix features whose share of toxic documents is far beyond
chance mark tokens of toxic documents as toxic; other tokens of labelled documents are clean. The field has two
states, a weight for each such feature in the toxic state, a bias and four transitions, fitted by the gradient of
the likelihood (forward-backward). Tokens without any feature are all alike, so the message over a run of L of
them is the L-th power of one 2 x 2 matrix: marginals are exact without a step per token. A logistic fit turns the
marginals of a document (their largest, their sum, their share of words) into its score, and spans with a marginal
of one half or more are its offending offsets.

The classifier is fitted on a bounded sample of labelled rows: at most `toxic_rows` toxic and `clean_rows` clean
ones of at most `row_chars` characters, lowest hashes of the id first; the field itself on at most `field_rows` of
them with at most `field_tokens` tokens. Scoring covers all rows and whole texts.

Defined results: null and empty texts get the score of a text without toxic tokens and no spans; labels of rows that
are missing, null or without a document are ignored; without any toxic and clean training row every score is 0; a
row labelled twice counts as toxic if one label says so. Every row is returned, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .wordhash import ALNUM, Words, mix, slices

PREFIXES = (4, 5, 6, 7, 8, 9, 10)
_WHOLE = np.uint64(0x5BD1E9955BD1E995)


def features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word places, feature hashes): the whole word, and its prefixes of each length in bytes."""
    out = [(np.arange(len(w)), mix(w.hashes() ^ _WHOLE))]
    size = w.end - w.start
    for k in PREFIXES:
        at = np.flatnonzero(size >= k)
        out.append((at, w.span_hash(w.start[at], w.start[at] + k)))
    return out


def words_of(text: str) -> Words:
    return next(slices(pa.array([text], pa.string()), ALNUM, latin=True))


class Field:
    """The fitted model: feature hashes (sorted) and weights, bias, transitions, document calibration."""

    def __init__(self, key: np.ndarray):
        self.key = np.sort(key)
        self.weight = np.full(len(key), 1.0)
        self.bias = -3.0
        self.step = np.array([[0.0, -1.0], [0.0, 0.5]])
        self.doc = np.array([-3.0, 0.0, 0.0, 0.0])
        self.bits = 16
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(self.key >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def active(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word place, feature index) of every feature that the model knows."""
        at_all, of_all = [], []
        if len(self.key):
            for at, h in features(w):
                hit = np.flatnonzero(self.filter[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
                k = np.minimum(np.searchsorted(self.key, h[hit]), len(self.key) - 1)
                ok = self.key[k] == h[hit]
                at_all.append(at[hit[ok]])
                of_all.append(k[ok])
        if not at_all:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(at_all), np.concatenate(of_all)

    def messages(self):
        """Power of the matrix of a token without features, scaled."""
        m = np.exp(self.step) * np.array([1.0, np.exp(self.bias)])
        m = m / np.abs(np.linalg.eigvals(m)).max()

        @lru_cache(maxsize=50_000)
        def power(n: int) -> np.ndarray:
            return np.linalg.matrix_power(m, n)

        return power

    def marginals(self, place: np.ndarray, score: np.ndarray, n: int, power) -> np.ndarray:
        """P(toxic) at the active places (sorted) of a text of n words; score: their summed weights."""
        k = len(place)
        step = np.exp(self.step)
        gaps = np.diff(np.concatenate(([-1], place, [n]))) - 1
        emit = [np.array([1.0, np.exp(min(self.bias + s, 50.0))]) for s in score]
        first = np.array([1.0, np.exp(self.bias)])
        ahead, msg = [], None
        for i in range(k):
            g = int(gaps[i])
            if msg is None:
                v = np.ones(2) if not g else (first @ power(g - 1)) @ step
            else:
                v = (msg @ power(g)) @ step
            msg = v * emit[i]
            msg = msg / msg.sum()
            ahead.append(msg)
        back = power(int(gaps[k])) @ np.ones(2)
        out = np.zeros(k)
        for i in range(k - 1, -1, -1):
            p = ahead[i] * back
            out[i] = p[1] / p.sum()
            back = power(int(gaps[i])) @ (step @ (emit[i] * back))
            back = back / back.sum()
        return out

    def document(self, marg: np.ndarray, n: int) -> np.ndarray:
        total = float(marg.sum())
        return np.array([1.0, float(marg.max()) if len(marg) else 0.0, np.log1p(total), min(1.0, 10 * total / max(n, 1))])

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(x @ self.doc))))

    def scan(self, w: Words, power) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row in slice, active word places, marginals) of rows that have active words."""
        at, of = self.active(w)
        if not len(at):
            return
        place, inv = np.unique(at, return_inverse=True)
        score = np.bincount(inv, self.weight[of])
        row = np.searchsorted(w.at, place, "right") - 1
        cut = np.flatnonzero(np.diff(row)) + 1
        for p, s in zip(np.split(place, cut), np.split(score, cut), strict=True):
            r = int(np.searchsorted(w.at, p[0], "right") - 1)
            yield r, p, self.marginals(p - w.at[r], s, int(w.at[r + 1] - w.at[r]), power)


def telling_features(texts: list[str], toxic: np.ndarray, evidence: float = 11.5) -> np.ndarray:
    """Features in toxic documents beyond chance: n * KL(share || base share) nats of evidence at least."""
    found = []
    for k, t in enumerate(texts):
        u = np.unique(np.concatenate([h for _, h in features(words_of(t))]))
        found.append(u)
    everything = np.concatenate(found) if found else np.zeros(0, np.uint64)
    u, inv = np.unique(everything, return_inverse=True)
    bad = np.bincount(inv, np.repeat(toxic, [len(f) for f in found]), len(u))
    n = np.bincount(inv, minlength=len(u))
    base = toxic.mean()
    p = np.clip(bad / n, 1e-9, 1 - 1e-9)
    kl = n * (p * np.log(p / base) + (1 - p) * np.log((1 - p) / (1 - base)))
    return u[(p > base + 0.6 * (1 - base)) & (kl >= evidence)]


def fit_field(model: Field, texts: list[str], toxic: np.ndarray, rounds: int = 40, most_tokens: int = 1500) -> None:
    """Full-batch gradient ascent; texts are stepped through side by side."""
    seqs = []
    for t, y in zip(texts, toxic, strict=True):
        w = words_of(t)
        at, of = model.active(w)
        if len(w) <= most_tokens and len(w) and (not y or len(at)):
            seqs.append((len(w), at, of, y))
    if not seqs:
        return
    d, steps = len(seqs), max(s[0] for s in seqs)
    gold, inside = np.zeros((d, steps)), np.zeros((d, steps), bool)
    at = np.concatenate([s[1] + i * steps for i, s in enumerate(seqs)])
    of = np.concatenate([s[2] for s in seqs])
    for i, (n, places, _, y) in enumerate(seqs):
        inside[i, :n] = True
        gold[i, places] = y
    pair_gold = np.zeros((2, 2))
    g = gold.astype(int)
    both = inside[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            pair_gold[a, b] = ((g[:, :-1] == a) & (g[:, 1:] == b) & both).sum()
    grad_sq = {"w": np.zeros_like(model.weight), "b": 0.0, "s": np.zeros((2, 2))}
    for _ in range(rounds):
        score = model.bias + np.bincount(at, model.weight[of], d * steps).reshape(d, steps)
        emit = np.stack([np.ones_like(score), np.exp(np.clip(score, -30, 30))], 2)
        move = np.exp(model.step)
        ahead, back = np.zeros((steps, d, 2)), np.ones((steps, d, 2))
        ahead[0] = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
        for t in range(1, steps):
            v = (ahead[t - 1] @ move) * emit[:, t]
            v /= v.sum(1, keepdims=True)
            ahead[t] = np.where(inside[:, t, None], v, ahead[t - 1])
        pair = np.zeros((2, 2))
        for t in range(steps - 1, 0, -1):
            v = emit[:, t] * back[t]
            joint = ahead[t - 1][:, :, None] * move[None] * v[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            pair += joint[inside[:, t]].sum(0)
            b = v @ move.T
            b /= b.sum(1, keepdims=True)
            back[t - 1] = np.where(inside[:, t, None], b, back[t])
        p = ahead * back
        p = (p[:, :, 1] / p.sum(2)).T
        miss = np.where(inside, gold - p, 0.0)
        grads = {"w": np.bincount(of, miss.reshape(-1)[at], len(model.weight)) - 0.1 * model.weight, "b": miss.sum() - 0.01 * model.bias, "s": pair_gold - pair - 0.1 * model.step}
        for k, x in grads.items():
            grad_sq[k] = grad_sq[k] + x**2
        model.weight += 0.5 * grads["w"] / np.sqrt(grad_sq["w"] + 1e-9)
        model.bias += 0.5 * grads["b"] / np.sqrt(grad_sq["b"] + 1e-9)
        model.step = np.clip(model.step + 0.3 * grads["s"] / np.sqrt(grad_sq["s"] + 1e-9), -8, 8)


def fit_documents(model: Field, texts: list[str], toxic: np.ndarray) -> None:
    """Logistic regression on the aggregates, by Newton steps."""
    power, x = model.messages(), []
    for t in texts:
        w = words_of(t)
        marg = [m for _, _, m in model.scan(w, power)]
        x.append(model.document(marg[0] if marg else np.zeros(0), len(w)))
    a, beta = np.array(x), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(4), a.T @ (toxic - p) - 0.05 * beta)
        beta = beta + np.clip(step, -5, 5)
    model.doc = beta


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1200, clean_rows: int = 4800, row_chars: int = 20_000, field_rows: int = 600, field_tokens: int = 1500) -> Field:
    """The model from a bounded sample of labelled rows; labels has doc_id and toxic, only rows to learn from."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    key = F.xxhash64("doc_id")
    picked = known.where("toxic = 1").orderBy(key, "doc_id").limit(toxic_rows).union(known.where("toxic = 0").orderBy(key, "doc_id").limit(clean_rows))
    picked = shared.materialize(picked, "sample")  # toxic_rows + clean_rows small rows at most
    rows = docs.select("doc_id", "text").where(F.length("text") <= row_chars).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("r"))  # of a repeated id always the same row
    rows = sorted(one.select("doc_id", "r.text", "r.toxic").collect())  # bounded by rows and row_chars
    texts, toxic = [r.text for r in rows], np.array([r.toxic for r in rows], float)
    if not len(toxic) or toxic.min() == toxic.max():
        model = Field(np.zeros(0, np.uint64))
        model.doc = np.array([-50.0, 0, 0, 0])
        return model
    model = Field(telling_features(texts, toxic))
    some = [*[i for i, y in enumerate(toxic) if y][: field_rows // 2], *[i for i, y in enumerate(toxic) if not y][: field_rows // 2]]
    fit_field(model, [texts[i] for i in some], toxic[some], most_tokens=field_tokens)
    fit_documents(model, texts, toxic)
    return model


def toxicity(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans, n_toxic, text_hash) per row; spans: start:end of toxic words in code points, end exclusive, comma-joined."""
    shared.prepare(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = model.messages()
        none = model.score(model.document(np.zeros(0), 0))
        for b in batches:
            score, spans, count = np.full(b.num_rows, none), [""] * b.num_rows, np.zeros(b.num_rows, np.int64)
            for w in slices(b.column("text"), ALNUM, latin=True):
                chars = None
                for r, place, marg in model.scan(w, power):
                    i = w.first + r
                    score[i] = model.score(model.document(marg, int(w.at[r + 1] - w.at[r])))
                    bad = place[marg >= 0.5]
                    count[i] = len(bad)
                    if len(bad):
                        chars = w.chars() if chars is None else chars
                        base = chars[w.row_at[r]]
                        spans[i] = ",".join(f"{chars[w.start[k]] - base}:{chars[w.end[k]] - base}" for k in bad)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array(spans, pa.string()), pa.array(count), b.column("text_hash")], names=["doc_id", "score", "spans", "n_toxic", "text_hash"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    return d.mapInArrow(run, "doc_id long, score double, spans string, n_toxic long, text_hash long")


def held_out(doc_id="doc_id"):
    """Rows that no label is learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose score reaches the threshold; each row is judged where it is read, so nothing is joined."""
    model = train(docs, labels.where(~held_out()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = model.messages()
        none = model.score(model.document(np.zeros(0), 0))
        for b in batches:
            score = np.full(b.num_rows, none)
            for w in slices(b.column("text"), ALNUM, latin=True):
                for r, _, marg in model.scan(w, power):
                    score[w.first + r] = model.score(model.document(marg, int(w.at[r + 1] - w.at[r])))
            yield b.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
