"""N-gram Jaccard join with token-combination prefixes (operator 1).

A document's tokens are its distinct word n-grams. All tokens get one global order: those whose bucket in a
corpus-wide count sketch is ordinary come first, those in outstanding buckets (frequent tokens) last, each by hash.
Two sets with Jaccard >= t share a token in their prefixes of n - ceil(t n) + 1 tokens. While a prefix holds rare
tokens only, each is indexed alone. Where it runs into the frequent class it is extended, and pairs of frequent
tokens of one sub-class are indexed in place of single ones: with p_c tokens of sub-class c, a document that shares
no pair with a partner shares at most one token in each sub-class, so the extension goes on until the rare tokens
and the sum of (p_c - 1) reach the plain prefix length. The sub-classes depend on the set's size, so every set is
indexed for its size band and the next: sizes of linked sets differ by one band at most. Entries of equal keys give
candidates, filtered by size, by position and by a parity sketch of the sets (its differing bits are at most the
tokens that differ, so it drops no link); exact overlaps of the hashed sets decide.

Sets that are equal are one node throughout. Candidates come in two rounds: first each entry with its two neighbours
in an order of its key's own, then only pairs whose nodes the first round's links have not joined yet. So a group of copies does
not give all its pairs, no cap is set, and no link between components is lost.

Nothing that grows with the corpus is broadcast: joins of nodes, pairs and texts are sort-merge joins at every size.
Hot keys are known from the count sketch before anything is shuffled: a key's entries are dealt over as many salts as
its tokens' counts ask for (`HOT_ROWS` each), and in the second round one side of such a key is dealt by salt and size
band while the other is sent to all its salts. A node with many partners is dealt by salts of the partner's hash.

Defined results: null or empty texts and texts without words have the empty set, are linked with nothing and are
their own component; fewer than n words are one token; rows with a null id are kept, and their id is never the
smallest; repeated rows each stay. An empty table gives an empty result. Tokens are 64-bit hashes: the sets are
compared exactly as hashed. Columns beside id and text are not looked at. Thresholds num / den from 0.25 up are
supported (`ngram_jaccard_join` refuses others).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .wordhash import NOT_SPACE, Words, combine, grams, slices

#: Buckets of the count sketch (a power of two): 4 bytes each in a task, one bit each when sent to all.
SKETCH_BITS = 22
CHUNK_BITS = 16
#: 64-bit words of the parity sketch; it tells sets of up to twice as many tokens as it has bits apart.
SKETCH_WORDS = 8
SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
SCAN = ["doc_id", "text_hash", "n_shingles", "node", "wide", "chunk", "counts", *SKETCH]
#: Sets of more tokens also have a wide sketch of one to two bits a token: the other one cannot tell them apart.
WIDE_FROM = 64 * SKETCH_WORDS
#: Entries of one key that one salt gets, as the count sketch has them.
HOT_ROWS = 20_000
#: Partners of a node that one task gets together with its set.
SALT_ROWS = 256


def token_sets(words: Words, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of word n-grams) for every row of a slice."""
    h = words.hashes()
    g = grams(h, n)
    for r in range(words.last - words.first):
        a, b = words.at[r], words.at[r + 1]
        if b - a >= n:
            s = np.sort(g[a : b - n + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = combine([h[i : i + 1] for i in range(a, b)], n + 1000 * (b - a))
        else:
            s = h[:0]
        yield words.first + r, s


def node_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def parity(s: np.ndarray, bits: int = 64 * SKETCH_WORDS) -> np.ndarray:
    """Bit by bit, whether an odd number of tokens falls on it; equal for equal sets.

    bits is a power of two; the two halves of a sketch, combined by exclusive or, are the sketch of half the bits.
    """
    odd = np.bincount(((s >> np.uint64(13)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def wide_parity(s: np.ndarray) -> np.ndarray | None:
    return parity(s, 1 << len(s).bit_length()) if len(s) > WIDE_FROM else None


def least(num: int, den: int, n: int) -> int:
    """Smallest overlap of a set of n with any linked one."""
    return -(-num * n // den)


def _scan(n: int, bits: int):
    """Per row its node; at the end of each partition, the counts of its tokens by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        held: list[np.ndarray] = []
        size = 0

        def count() -> None:
            nonlocal size
            if held:
                np.add(counts, np.bincount(np.concatenate(held), minlength=1 << bits), out=counts, casting="unsafe")
            held.clear()
            size = 0

        for b in batches:
            sizes, nodes, wide, sketch = np.zeros(b.num_rows, np.int64), [], [], np.zeros((b.num_rows, SKETCH_WORDS), np.int64)
            for w in slices(b.column("text")):
                for r, s in token_sets(w, n):
                    sizes[r] = len(s)
                    nodes.append(node_of(s))
                    wide.append(wide_parity(s))
                    if len(s):
                        sketch[r] = parity(s)
                        held.append((s >> np.uint64(64 - bits)).astype(np.int32))
                        size += len(s)
                if size > 1 << 21:
                    count()
            none = pa.nulls(b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(sizes), pa.array(nodes, pa.binary()), pa.array(wide, pa.list_(pa.int64())), none, pa.nulls(b.num_rows, pa.binary()), *[pa.array(c) for c in sketch.T]], names=SCAN)
        count()
        width = 1 << min(CHUNK_BITS, bits)
        for k in range(len(counts) // width):
            part = counts[k * width : (k + 1) * width]
            if part.any():
                one = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([one, one, one, pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.int64())), pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary()), *[one] * SKETCH_WORDS], names=SCAN)

    return run


def _outstanding(hot_rows: int):
    """Sum the counts of each chunk of buckets; mark those far above the chunk's median, and give salts to hot ones."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("chunk").to_pylist(), b.column("counts"), strict=True):
                x = np.frombuffer(zlib.decompress(c.as_py()), np.uint32).astype(np.uint64)
                sums[k] = sums[k] + x if k in sums else x
        for k, x in sums.items():
            mid = float(np.median(x))
            marks = np.packbits(x > mid + 6 * math.sqrt(mid) + 30)
            salts = np.clip(np.ceil((x - mid) / hot_rows), 1, 30_000).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([marks.tobytes()], pa.binary()), pa.array([zlib.compress(salts.tobytes(), 1)], pa.binary())], names=["chunk", "marks", "salts"])

    return run


def prefix_entries(s: np.ndarray, frequent: np.ndarray, num: int, den: int, salts: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(key, lead, rest, salts) of a set's entries: at most `lead` tokens are shared up to the entry, `rest` tokens follow.

    salts: how many each token's bucket asks for (null: one); a pair's key is no more frequent than either token.
    """
    n = len(s)
    p = n - least(num, den, n) + 1
    salts = np.ones(n, np.int64) if salts is None else salts
    rare = s[~frequent]
    out = [(k, 1, n - i - 1, m) for i, (k, m) in enumerate(zip(rare[:p].view(np.int64).tolist(), salts[~frequent][:p].tolist(), strict=True))]
    if len(rare) >= p:
        return out
    often = s[frequent]
    step = math.log(den / num)
    own = int(math.log(n) / step)
    for band in (own, own + 1):
        classes = max(1, int(math.exp((band - 1) * step) / 4))
        kind = ((often >> np.uint64(7)) % np.uint64(classes)).astype(np.int64).tolist()
        first, second, lead, rest = [], [], [], []
        by: dict[int, list[int]] = {}
        got = len(rare)
        for i, c in enumerate(kind):
            before = by.setdefault(c, [])
            for j in before:
                first.append(j)
                second.append(i)
                lead.append(len(by) + 1)
                rest.append(n - len(rare) - i - 1)
            got += bool(before)
            before.append(i)
            if got >= p:
                break
        if got < p:  # cannot be for the sizes that `joinable` lets in
            raise AssertionError(f"prefix of {n} tokens too short")
        if first:
            key = combine([often[first], often[second]], 7919 * (band + 1)).view(np.int64)
            deal = salts[frequent]
            out += zip(key.tolist(), lead, rest, np.minimum(deal[first], deal[second]).tolist(), strict=True)
    return out


def _entries(n: int, num: int, den: int, marks: bytes, salts: dict[int, bytes], bits: int):
    smallest = next(k for k in range(1, 10_000) if num * (k + 1) <= den * k)  # smaller sets link with equal ones only

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(np.frombuffer(marks, np.uint8)).astype(bool)
        width = 1 << min(CHUNK_BITS, bits)
        deal = np.ones(1 << bits, np.uint16)
        for k, packed in salts.items():
            deal[k * width : (k + 1) * width] = np.frombuffer(zlib.decompress(packed), np.uint16)
        seen: set[bytes] = set()
        for b in batches:
            rows, nodes, sizes = [], [], []
            for w in slices(b.column("text")):
                for _, s in token_sets(w, n):
                    if len(s) < smallest or (node := node_of(s)) in seen:
                        continue
                    if len(seen) < 200_000:  # what this task has indexed already is left out; the rest is found out below
                        seen.add(node)
                    bucket = (s >> np.uint64(64 - bits)).astype(np.int64)
                    new = prefix_entries(s, often[bucket], num, den, deal[bucket])
                    rows += new
                    nodes += [node] * len(new)
                    sizes += [len(s)] * len(new)
                if len(rows) > 100_000:
                    yield _batch(rows, nodes, sizes)
                    rows, nodes, sizes = [], [], []
            if rows:
                yield _batch(rows, nodes, sizes)

    return run


def _batch(rows: list[tuple[int, int, int, int]], nodes: list[bytes], sizes: list[int]) -> pa.RecordBatch:
    key, lead, rest, salts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), pa.array(lead, pa.int32()), pa.array(rest, pa.int32()), pa.array(salts, pa.int32())], names=["key", "node", "n", "lead", "rest", "salts"]
    )


def _verify(n: int, num: int, den: int):
    """Rows sorted by (a, salt, b): a's own text comes first with b null, then its partners' texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            u, v = [], []
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for w in slices(batch.column("text")):
                for r, s in token_sets(w, n):
                    if b[r] is None:
                        of, mine = a[r], s
                        continue
                    if a[r] != of:
                        raise AssertionError("a pair without its own text")
                    at = np.searchsorted(mine, s)
                    both = int((mine[np.minimum(at, len(mine) - 1)] == s).sum())
                    if den * both >= num * (len(mine) + len(s) - both):
                        u.append(a[r])
                        v.append(b[r])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return run


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough.

    Texts travel, not sets: they take less than half of the room. One row stands for each node; its text meets all
    that need it in one join, and goes from there to the pairs' tasks.
    """
    pairs = shared.materialize(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.count("*").alias("degree"))
    ends = ends.join(nodes.select("node", F.col("rep.text_hash").alias("h"), F.col("rep.doc_id").alias("i")).hint("merge"), "node")
    ends = shared.materialize(ends, "ends")
    for k in ("a", "b"):
        pairs = pairs.join(ends.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("degree", "h", "i")]).hint("merge"), k)
    # the end with more partners is a: its text travels once for them all
    turn = (F.col("degree_b") > F.col("degree_a")) | ((F.col("degree_b") == F.col("degree_a")) & (F.col("b") < F.col("a")))
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    pairs = pairs.select(*[pick(f"{c}{x}", f"{c}{y}").alias(f"{c}{x}") for c in ("", "degree_", "h_", "i_") for x, y in (("a", "b"), ("b", "a"))])
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("degree_a") / SALT_ROWS)).cast("int")
    salted = shared.materialize(pairs.withColumn("salt", salt), "salted")
    none = F.lit(None).cast("binary")
    need = salted.select(F.col("h_a").alias("h"), F.col("i_a").alias("i"), "a", "salt", none.alias("b")).distinct().union(salted.select("h_b", "i_b", "a", "salt", "b"))
    rows = docs.join(need.hint("merge"), (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("i"))).select("a", "salt", "b", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return shared.materialize(rows.mapInArrow(_verify(n, num, den), "u binary, v binary"), "links")


def _may_link(num: int, den: int, x: str, y: str):
    """Size and position filters for two entries of a key."""
    need = F.ceil(num * (F.col(f"{x}n") + F.col(f"{y}n")) / F.lit(num + den))
    size = F.least(f"{x}n", f"{y}n") * den >= F.greatest(f"{x}n", f"{y}n") * num
    place = F.least(f"{x}lead", f"{y}lead") + F.least(f"{x}rest", f"{y}rest") >= need - F.lit(1e-6)
    return size & place


def _sketch_allows(num: int, den: int, x: str, y: str, n: str):
    """Bits that differ are at most the tokens that linked sets of these sizes may differ in."""
    both = F.col(f"{x}{n}") + F.col(f"{y}{n}")
    differ = sum((F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in SKETCH[1:]), F.bit_count(F.col(f"{x}{SKETCH[0]}").bitwiseXOR(F.col(f"{y}{SKETCH[0]}"))))
    return differ <= both - 2 * F.ceil(num * both / F.lit(num + den) - F.lit(1e-6))


def _alike(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) of nodes those that their sketches allow."""
    of = lambda k: nodes.select(F.col("node").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("size", *SKETCH)])
    return pairs.join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b").where(_sketch_allows(num, den, "a_", "b_", "size")).select("a", "b")


def _wide_alike(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) of nodes those that their wide sketches allow; where a node has none, the pair stays.

    A wide sketch takes about a twentieth of its text's room, and stands in for it where it shows that a pair is no link.
    """
    large = nodes.where("wide IS NOT NULL").select("node", "size", "wide")
    for k in ("a", "b"):
        pairs = pairs.join(large.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), F.col("wide").alias(f"{k}_wide")).hint("merge"), k, "left")
    words = F.least(F.size("a_wide"), F.size("b_wide"))
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda w: F.when(F.size(w) > words, F.zip_with(F.slice(w, F.lit(1), words), F.slice(w, words + 1, words), xor)).otherwise(F.col(w))
    differ = F.aggregate(F.zip_with(fold("a_wide"), fold("b_wide"), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda s, x: s + x)
    both = F.col("a_size") + F.col("b_size")
    none = F.col("a_wide").isNull() | F.col("b_wide").isNull() | (F.greatest(F.size("a_wide"), F.size("b_wide")) > 2 * words)
    return pairs.where(none | (differ <= both - 2 * F.ceil(num * both / F.lit(num + den) - F.lit(1e-6)))).select("a", "b")


def ngram_jaccard_join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, node, component, text_hash) for each row of docs, links where den * |a & b| >= num * |a | b|.

    node is a digest of the token set (null if empty): rows of one node have equal sets; component is the smallest
    node of those that links reach. See the module for the method.
    """
    if not den <= 4 * num <= 4 * den:
        raise ValueError("similarity must be from 0.25 to 1")
    spark = docs.sparkSession
    shared.prepare(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    scan = shared.materialize(d.mapInArrow(_scan(n, SKETCH_BITS), "doc_id long, text_hash long, n_shingles long, node binary, wide array<long>, chunk int, counts binary, " + ", ".join(f"{c} long" for c in SKETCH)), "scan")
    summary = scan.where("chunk IS NULL").select("doc_id", "text_hash", "n_shingles", "node", "wide", *SKETCH)
    nodes = summary.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.max("n_shingles").alias("size"), F.count("*").alias("copies"), F.max("wide").alias("wide"), *[F.max(c).alias(c) for c in SKETCH])
    nodes = shared.materialize(nodes, "nodes")
    chunk = 1 << min(CHUNK_BITS, SKETCH_BITS)
    marks, salts = bytearray((1 << SKETCH_BITS) // 8), {}
    sums = scan.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").mapInArrow(_outstanding(HOT_ROWS), "chunk int, marks binary, salts binary")
    for r in sums.collect():  # a bit and two packed bytes for each bucket: nine megabytes at any size, most often under one
        marks[r.chunk * chunk // 8 : (r.chunk + 1) * chunk // 8] = r.marks
        salts[r.chunk] = bytes(r.salts)

    entries = d.select("text").mapInArrow(_entries(n, num, den, bytes(marks), salts, SKETCH_BITS), "key long, node binary, n int, lead int, rest int, salts int")
    entries = entries.withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("node"), F.col("salts"))).otherwise(0).cast("int"))
    # another order under every key, so that a node meets other partners under each
    order = Window.partitionBy("key", "salt").orderBy(F.xxhash64("key", "node"), "node")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = {f"{p}_{c}": F.lead(c, k).over(order) for p, k in (("next", 1), ("far", 2)) for c in ("node", "n", "lead", "rest")}
    entries = entries.select("*", F.lag("node").over(order).alias("before"), F.first("node").over(whole).alias("f"), F.last("node").over(whole).alias("l"), (F.count("*").over(whole) > 2).alias("many"), *[x.alias(c) for c, x in ahead.items()])
    entries = shared.materialize(entries.where("salts > 1 OR f <> l").drop("f", "l"), "entries")

    met = [entries.where(f"node <> {p}_node").where(_may_link(num, den, "", f"{p}_")).select(F.least("node", f"{p}_node").alias("a"), F.greatest("node", f"{p}_node").alias("b")) for p in ("next", "far")]
    tried = met[0].union(met[1]).distinct()
    # what a key of two nodes can give is tried hereby; only keys of more are joined below
    tried = shared.materialize(_wide_alike(_alike(tried, nodes, num, den), nodes, num, den), "tried")
    links = _links(tried, d, nodes, n, num, den)
    parts = shared.connected_components(links)

    left = entries.where("(many OR salts > 1) AND (before IS NULL OR before <> node)").select("key", "salt", "salts", "node", "n", "lead", "rest")
    left = left.join(parts.hint("merge"), "node", "left").join(nodes.select("node", *SKETCH).hint("merge"), "node")
    left = left.withColumn("part", F.coalesce("component", "node")).drop("component")
    # linked sets are at most one size band apart; only hot keys are dealt by bands
    band = F.when(F.col("salts") > 1, F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9) if num < den else F.col("n")).otherwise(0).cast("int")
    left = left.withColumn("band", band)
    x = left.select("key", "salt", "band", *[F.col(c).alias(f"x_{c}") for c in ("node", "n", "lead", "rest", "part", *SKETCH)])
    y = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("band", F.explode(F.when(F.col("salts") > 1, F.array("band", F.col("band") - 1)).otherwise(F.array("band"))))
    y = y.select("key", "salt", "band", *[F.col(c).alias(f"y_{c}") for c in ("node", "n", "lead", "rest", "part", *SKETCH)])
    on = (x.key == y.key) & (x.salt == y.salt) & (x.band == y.band) & (F.col("x_part") != F.col("y_part")) & ((F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_node") < F.col("y_node"))))
    more = x.join(y.hint("merge"), on & _may_link(num, den, "x_", "y_") & _sketch_allows(num, den, "x_", "y_", "n")).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    more = _links(_wide_alike(more.join(tried.hint("merge"), ["a", "b"], "left_anti"), nodes, num, den), d, nodes, n, num, den)

    parts = shared.connected_components(links.union(more))
    labelled = nodes.select("node", "least_id").join(parts.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = shared.materialize(labelled.select("node", "component", F.col("least_id")), "labelled")
    least_ids = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_node = labelled.join(least_ids, "component").select("node", "component", "component_id")
    by_node = shared.materialize(by_node, "by_node")
    out = shared.join_ones(summary.drop("wide", *SKETCH), by_node, "node", shared.hot_keys(nodes, "node", "copies"))
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node", "component", "text_hash")


def near_duplicate_filter(docs: DataFrame, **how) -> DataFrame:
    """docs without all but one document of each group: the one with the smallest id (then text hash) stays.

    Rows are told apart by id and text, so a text of its own stays whatever else has its id; a row repeated whole is
    cut to one. Rows with an empty set or a null id are kept. Columns of docs stay as they are, whatever their names.
    """
    found = shared.materialize(ngram_jaccard_join(docs, **how).where("node IS NOT NULL AND doc_id IS NOT NULL").select("component", "doc_id", "text_hash"), "found")
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("s"), F.count("*").alias("rows"))
    first = shared.materialize(first.select("s.*", "rows"), "first")
    gone = found.select("doc_id", "text_hash").distinct().join(first.select("doc_id", "text_hash").hint("merge"), ["doc_id", "text_hash"], "left_anti")
    kept = shared.without_rows(docs, gone)
    again = found.groupBy("doc_id", "text_hash").count().where("count > 1").join(first.select("doc_id", "text_hash").hint("merge"), ["doc_id", "text_hash"], "left_semi").select("doc_id", "text_hash")
    again = shared.materialize(again, "again")
    if again.isEmpty():
        return kept
    once = shared.with_row_key(kept, again, "left_semi").dropDuplicates(["doc_id", "text"])
    return shared.with_row_key(kept, again, "left_anti").unionByName(once)
