"""Quality rules joined by weak supervision (operator 10).

Each rule votes good, bad or abstains. Expectation-maximisation over the counts of vote patterns estimates, without
labels, how often each rule is right for either class and the share of good documents; the posterior probability of
good quality replaces the filter that all rules must pass. The counts are of all documents; there are at most
3**rules patterns, whatever the size of the corpus.

Defined results: null and empty texts have no words, every count is 0, and they fail the base rules; repeated rows
each stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .wordhash import Words, combine, grams, slices

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?"]] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
LETTER = UPPER.copy()
LETTER[0x61:0x7B] = LETTER[0xC3:] = True
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stops", "n_upper", "n_letters", "n_distinct", "n_plain")


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags lie in each row's stretch."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[at[1:]] - c[at[:-1]]


def text_counts(w: Words) -> dict[str, np.ndarray]:
    """All counts but those of lines, for each row of a slice."""
    rows = w.last - w.first
    n = np.diff(w.at)
    inside = np.zeros(len(w.raw) + 1, np.int64)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    inside = np.cumsum(inside[:-1]) > 0
    h = w.hashes()
    row = np.repeat(np.arange(rows), n)
    key = combine([h, row.astype(np.uint64)])
    distinct = np.unique(row[np.unique(key, return_index=True)[1]], return_counts=True) if len(h) else (np.zeros(0, int), np.zeros(0, int))
    n_distinct = np.zeros(rows, np.int64)
    n_distinct[distinct[0]] = distinct[1]
    repeated = np.zeros(len(h) + 1, np.int64)
    g = grams(h, WINDOW)
    if len(g):
        whole = np.flatnonzero(row[: len(g)] == row[WINDOW - 1 :])
        key = combine([g[whole], row[whole].astype(np.uint64)])
        _, inv, many = np.unique(key, return_inverse=True, return_counts=True)
        twice = whole[many[inv] > 1]
        np.add.at(repeated, twice, 1)
        np.add.at(repeated, twice + WINDOW, -1)
    letters = np.zeros(len(w.raw) + 1, np.int64)
    np.cumsum(LETTER[w.raw] | ((w.raw & 0xC0) == 0x80), out=letters[1:])
    plain = 10 * (letters[w.end] - letters[w.start]) >= 7 * (w.end - w.start)
    return {
        "n_words": n,
        "word_chars": _per_row(inside & ((w.raw & 0xC0) != 0x80), w.row_at),
        "n_symbols": _per_row(SYMBOLS[w.raw], w.row_at),
        "n_repeat_words": _per_row(np.cumsum(repeated[:-1]) > 0, w.at),
        "n_stops": _per_row(STOPS[w.raw[w.end - 1]] if len(h) else np.zeros(0, bool), w.at),
        "n_upper": _per_row(UPPER[w.raw], w.row_at),
        "n_letters": _per_row(LETTER[w.raw], w.row_at),
        "n_distinct": n_distinct,
        "n_plain": _per_row(plain, w.at),
    }


def line_counts(text: str | None) -> tuple[int, int]:
    """(lines with a word, of them those equal to an earlier line)"""
    if not text:
        return 0, 0
    if "\n" not in text:
        return int(bool(text.strip(" \t\n\r\v\f"))), 0
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\v\f")]
    return len(lines), len(lines) - len(set(lines))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts: dict[str, list] = {}
        for w in slices(b.column("text"), lower=False):
            for k, x in text_counts(w).items():
                parts.setdefault(k, []).append(x)
        lines = [line_counts(t) for t in b.column("text").to_pylist()]
        cols = {k: np.concatenate(v) for k, v in parts.items()}
        cols |= {"n_lines": np.array([x[0] for x in lines], np.int64), "n_dup_lines": np.array([x[1] for x in lines], np.int64)}
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(cols[k] if k in cols else np.zeros(b.num_rows, np.int64), pa.int64()) for k in COUNTS]], names=["doc_id", *COUNTS])


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    shared.prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def _vote(bad: str, good: str):
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


def rules() -> dict:
    """Name to vote: 1 good, -1 bad, 0 abstains."""
    return {
        "length": _vote("n_words < 10", "n_words >= 60"),
        "symbols": _vote("n_symbols > 0.1 * n_words", "n_symbols < 0.02 * n_words"),
        "lines": _vote("n_dup_lines > 0.3 * n_lines", "n_lines > 2 AND n_dup_lines = 0"),
        "repeats": _vote("n_repeat_words > 0.2 * n_words", "n_repeat_words < 0.05 * n_words AND n_words >= 20"),
        "word_length": _vote("n_words > 0 AND (word_chars < 2.5 * n_words OR word_chars > 12 * n_words)", "word_chars BETWEEN 3 * n_words AND 9 * n_words AND n_words >= 20"),
        "stops": _vote("n_words >= 30 AND n_stops < 0.01 * n_words", "n_stops BETWEEN 0.03 * n_words AND 0.4 * n_words"),
        "capitals": _vote("n_upper > 0.3 * n_letters", "n_letters > 50 AND n_upper < 0.15 * n_letters"),
        "letters": _vote("n_letters < 0.5 * word_chars", "n_letters > 0.8 * word_chars AND n_words >= 20"),
        "density": _vote("n_symbols > 0.05 * word_chars", "word_chars > 0 AND n_symbols < 0.005 * word_chars"),
        "plain": _vote("n_words >= 20 AND n_plain < 0.7 * n_words", "n_words >= 20 AND n_plain > 0.9 * n_words"),
        "variety": _vote("n_words >= 30 AND n_distinct < 0.2 * n_words", "n_words >= 30 AND (n_distinct > 0.5 * n_words OR n_distinct > 200)"),
    }


def fit_rules(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200, strength: float = 4.0) -> tuple[float, np.ndarray]:
    """(prior of good, table[rule, class, vote + 1]) by expectation-maximisation over (votes, count).

    Starts from rules whose bad votes weigh more than their good ones; pseudo-counts of a twentieth of the documents
    keep that start where data are few, and the classes from changing places.
    """
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    k = votes.shape[1]
    start = np.array([[0.4, 0.25, 0.35], [0.03, 0.27, 0.7]])  # class bad, good; vote bad, none, good
    table, prior = np.repeat(start[None], k, 0), 0.8
    pseudo = strength * start + 0.05 * n.sum() * start
    for _ in range(rounds):
        good = posterior(votes, prior, table)
        new = np.zeros_like(table)
        for v in (0, 1, 2):
            hit = votes == v - 1
            new[:, 1, v] = (hit * (n * good)[:, None]).sum(0)
            new[:, 0, v] = (hit * (n * (1 - good))[:, None]).sum(0)
        new += pseudo[None]
        new /= new.sum(2, keepdims=True)
        prior_new = ((n * good).sum() + 8) / (n.sum() + 10)
        done = np.abs(new - table).max() < 1e-9
        table, prior = new, prior_new
        if done:
            break
    return prior, table


def posterior(votes: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    odds = np.full(len(votes), np.log(prior / (1 - prior)))
    for j in range(votes.shape[1]):
        said = table[j, :, votes[:, j] + 1]
        odds += np.where(votes[:, j] == 0, 0.0, np.log(said[:, 1] / said[:, 0]))  # who abstains says nothing
    return 1 / (1 + np.exp(-odds))


def quality(docs: DataFrame, threshold: float = 0.5, **cols) -> DataFrame:
    """Counts, base_failed, p_good and kept per row of docs."""
    spark = docs.sparkSession
    counts = shared.materialize(document_counts(docs, **cols), "counts")
    voted = counts.select("*", *[v.alias(f"v_{k}") for k, v in rules().items()])
    names = [f"v_{k}" for k in rules()]
    seen = voted.groupBy(*names).count().collect()  # at most 3**rules rows
    if seen:
        pats = [(tuple(r[c] for c in names), r["count"]) for r in seen]
        prior, table = fit_rules(pats)
        post = posterior(np.array([p for p, _ in pats]), prior, table)
        by = spark.createDataFrame([(*p, float(x)) for (p, _), x in zip(pats, post, strict=True)], ", ".join(f"{c} int" for c in names) + ", p_good double")
        voted = voted.join(F.broadcast(by), names, "left")
    else:
        voted = voted.withColumn("p_good", F.lit(None).cast("double"))
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("p_good") >= threshold)).alias("kept"), "p_good")
