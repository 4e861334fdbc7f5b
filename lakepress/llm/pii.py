"""Personal data by bootstrapped contextual extraction (operator 2).

Base kinds are found by their fixed forms and are the seeds. Looser forms of the same kinds (an address written with
"(at)", a number without its check digit or country code) are candidates. The one or two words before a seed or
candidate are its lexical patterns. Spark scores the graph of patterns and instances in rounds: a pattern is as good
as the mean of its instances' belief (with two more that are none), and it is accepted if enough of its instances are
believed and if it tells: of all places in the corpus where its words stand, a share must lead to an instance. Seeds
stay certain; another instance is as good as its accepted patterns together say. Instances that one round finds
support patterns in the next, so patterns are found that no seed ever follows. Candidates behind patterns that are
accepted at last become spans beside the base ones.

Defined results: null and empty texts have no spans; repeated rows each get their own; ids may be null; spans are in
code points, end exclusive. Base matches are leftmost and do not overlap within a kind; those that fail their test
are dropped and not tried again. Searches take time in proportion to a text's length, however long its runs.
Instances and patterns are told apart whole; one that is very long is named by its digest.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .bitmaps import bitmap, within
from .wordhash import ALNUM, combine, slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can start only where a run of digits starts: inside the run it would end the same way
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]")
_LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)*")
_LOOSE_NUMBER = re.compile(r"(?<![A-Za-z0-9.-])\(?[0-9](?:[ ().-]{0,2}[0-9]){5,}(?![A-Za-z0-9])")
_WORD = re.compile(r"[^\W_]+")
#: Longer instances and patterns are named by their digest.
NAME = 200


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed forms, by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() < 40 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Looser forms that touch no base span."""
    taken = sorted((a, b) for _, a, b in base)
    out = []

    starts, ends = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))

    def free(a: int, b: int) -> bool:
        k = bisect.bisect_left(starts, b)  # base spans that begin before b: the furthest end of them
        return not k or ends[k - 1] <= a

    if "@" in text or "at" in text:
        out += [("email", *m.span()) for m in _LOOSE_EMAIL.finditer(text) if free(*m.span())]
    for m in _LOOSE_NUMBER.finditer(text):
        s, n = m[0], len(_digits(m[0]))
        kind = "ip" if s.count(".") == 3 and n <= 12 and " " not in s else "card" if 13 <= n <= 19 else "phone" if 7 <= n <= 12 else None
        if kind and free(*m.span()):
            out.append((kind, *m.span()))
    return out


def named(s: str) -> str:
    return s if len(s) <= NAME else "sha256:" + hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def patterns(text: str, places: list[int]) -> list[list[str]]:
    """For each place in ascending order the one and two words before it, in lower case; the text is gone through once."""
    out, words, last, two = [], _WORD.finditer(text), None, None
    ahead = next(words, None)
    for at in places:
        while ahead is not None and ahead.end() <= at:
            two, last, ahead = last, ahead[0].lower(), next(words, None)
        out.append([named(x) for x in ([last] if last else []) + ([f"{two} {last}"] if two else [])])
    return out


MENTION = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("instance", T.StringType()), T.StructField("seed", T.BooleanType()), T.StructField("patterns", T.ArrayType(T.StringType()))])
FOUND = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("base", T.StringType()), T.StructField("mentions", T.ArrayType(MENTION))])


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))]))
    for b in batches:
        bases, mentions = [], []
        for t in b.column("text").to_pylist():
            if not t or not _ANY.search(t):
                bases.append("")
                mentions.append(None)
                continue
            base = base_spans(t)
            loose = candidates(t, base)
            bases.append(join(base))
            every = sorted(((a, e, k, s) for s, spans in ((True, base), (False, loose)) for k, a, e in spans))
            before = patterns(t, [a for a, *_ in every])
            mentions.append([{"kind": k, "start": a, "end": e, "instance": named(t[a:e].lower()), "seed": s, "patterns": p} for (a, e, k, s), p in zip(every, before, strict=True)])
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("text_hash"), pa.array(bases, pa.string()), pa.array(mentions, kind)], names=["row", "doc_id", "text_hash", "base", "mentions"])


def join(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{e}" for k, a, e in spans)


def _windows(texts: pa.Array) -> Iterator[np.ndarray]:
    """Hashes of all words and pairs of words, slice by slice."""
    for w in slices(texts, ALNUM, latin=True):
        h = w.hashes()
        yield combine([h], 1)
        if len(h) > 1:
            yield combine([h[:-1], h[1:]], 2)


def _occurrences(bits: int, packed: bytes):
    """How often windows stand in the batches' texts that may be wanted ones, as the bitmap has them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.frombuffer(packed, np.uint8)
        for b in batches:
            found = []
            for g in _windows(b.column("text")):
                found.append(g[within(g, bits, there)])
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return run


def _pattern_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = [pattern_hash(p) for p in b.column("pattern").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("pattern"), pa.array(h, pa.int64())], names=["pattern", "key"])


def pattern_hash(p: str) -> int | None:
    """The hash of a pattern's window; none for a pattern that is named by its digest."""
    w = next(slices(pa.array([p]), ALNUM, latin=True)).hashes()
    return int(combine([w[i : i + 1] for i in range(len(w))], len(w)).view(np.int64)[0]) if 1 <= len(w) <= 2 and len(p) <= NAME else None


def standings(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, standing): how often each pattern's words stand in the corpus (text), counted in one pass."""
    keys = shared.materialize(edges.select("pattern").distinct().mapInArrow(_pattern_hashes, "pattern string, key long").where("key IS NOT NULL"), "patterns")
    bits, packed = bitmap(keys, keys.count())
    counts = texts.mapInArrow(_occurrences(bits, packed), "h long, n long").groupBy("h").agg(F.sum("n").alias("standing"))
    return shared.materialize(keys.join(counts.hint("merge"), F.col("key") == F.col("h")).select("pattern", "standing"), "standing")


def score_patterns(edges: DataFrame, standing: DataFrame, confidence: float, seeds: int, telling: float, rounds: int) -> DataFrame:
    """(kind, pattern, confidence, n_seeds, n_mentions) of the patterns accepted after some rounds.

    edges: (kind, pattern, instance, seed, n); n_seeds counts instances believed at least to a half, seeds or not.
    """
    edges = shared.materialize(edges.join(standing.hint("merge"), "pattern"), "edges")
    beliefs = edges.groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    good = None
    for _ in range(rounds):
        scored = edges.join(beliefs.hint("merge"), ["kind", "instance"]).groupBy("kind", "pattern").agg(
            (F.sum("belief") / (F.count("*") + 2)).alias("confidence"), F.count(F.when(F.col("belief") >= 0.5, 1)).alias("n_seeds"), F.sum("n").alias("n_mentions"), F.max("standing").alias("standing")
        )
        good = shared.materialize(scored.where((F.col("confidence") >= confidence) & (F.col("n_seeds") >= seeds) & (F.col("n_mentions") >= telling * F.col("standing"))), "good")
        doubt = F.exp(F.sum(F.log(1 - F.least(F.lit(0.95), F.col("confidence")))))
        after = edges.join(good.select("kind", "pattern", "confidence").hint("merge"), ["kind", "pattern"], "left").groupBy("kind", "instance")
        beliefs = shared.materialize(after.agg(F.when(F.max(F.col("seed").cast("int")) == 1, 1.0).otherwise((1 - F.coalesce(doubt, F.lit(1.0))) * 0.95).alias("belief")), "beliefs")
    return good


def find_personal_data(docs: DataFrame, confidence: float = 0.6, seeds: int = 3, telling: float = 0.3, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, patterns): rows has row, doc_id, text_hash, base and spans; patterns the accepted ones."""
    spark = docs.sparkSession
    shared.prepare(spark)
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    found = shared.materialize(d.mapInArrow(_find, FOUND), "found")
    mentions = found.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    edges = mentions.select("kind", "instance", "seed", F.explode("patterns").alias("pattern")).groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = shared.materialize(edges, "edges")
    # only patterns with enough instances can ever be accepted
    able = edges.groupBy("kind", "pattern").count().where(F.col("count") >= seeds).select("kind", "pattern")
    able = shared.materialize(edges.join(able.hint("merge"), ["kind", "pattern"], "left_semi"), "able")
    good = score_patterns(able, standings(able, docs.select(F.col(text_col).alias("text"))), confidence, seeds, telling, rounds)
    new = mentions.where("NOT seed").select("row", "kind", "start", "end", F.explode("patterns").alias("pattern")).join(good.select("kind", "pattern").hint("merge"), ["kind", "pattern"], "left_semi")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    new = shared.materialize(new.select("row", "kind", "start", "end").distinct(), "new")
    spans = mentions.where("seed").select("row", "kind", "start", "end").join(new.select("row").distinct().hint("merge"), "row", "left_semi").union(new)
    spans = spans.select("row", F.struct(rank.alias("r"), "start", "end", "kind").alias("s")).groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("s"))
    spans = spans.select("row", F.array_join(F.transform("s", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",").alias("more"))
    return found.join(spans.hint("merge"), "row", "left").select("row", "doc_id", "text_hash", "base", F.coalesce("more", "base").alias("spans")), good


def mask(text: str, spans: str) -> str:
    """text with each span (overlapping ones together) replaced by its kind in angle brackets."""
    todo = sorted((int(a), int(e), k) for k, a, e in (s.split(":") for s in spans.split(",")))
    out, at = [], 0
    for a, e, k in todo:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def without_personal_data(docs: DataFrame, **how) -> DataFrame:
    """docs with personal data masked in text, and n_chars, where it is there, made to fit; other columns stay as they are."""
    rows, _ = find_personal_data(docs, **how)
    some = shared.materialize(rows.where("spans <> ''").select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"]), "spans")
    schema = docs.schema
    names, at = schema.names, shared.free(docs, "spans")
    i, h = shared.free(docs, "row_id"), shared.free(docs, "row_hash")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h))
    clean, maybe = shared.by_bucket(docs, some)
    hit = maybe.join(some.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("spans").alias(at)).hint("merge"), on, "left").drop(i, h)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, text = b.column(at).to_pylist(), b.column("text")
            if any(spans):
                new = [mask(t, s) if s else t for t, s in zip(text.to_pylist(), spans, strict=True)]
                b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(new, text.type))
                if "n_chars" in names:
                    k = b.schema.get_field_index("n_chars")
                    n = [len(t) if s else old for t, s, old in zip(new, spans, b.column(k).to_pylist(), strict=True)]
                    b = b.set_column(k, "n_chars", pa.array(n, b.schema.field(k).type))
            yield b.select(names)

    return clean.unionByName(hit.mapInArrow(run, schema))
