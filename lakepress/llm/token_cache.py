"""Token counts by a digest cache (operator 6).

The key of a count is the SHA-256 of the normalised content together with a digest of the tokenizer's file and
handling. Digests of all rows are joined with the stored counts; of those that miss, one row each is encoded, the
new counts are appended to the cache, and all rows get their counts from it. Only keys meet in the grouping. Texts stay
where they are read, but for those whose digest shares a bucket with a digest that has copies or is stored already:
only these can be left out, and they are joined with the misses. Digests with very many copies, of which there can only
be few, get their counts by a broadcast; so copies are no hot group.

The normaliser keeps what a tokenizer can tell apart, so it only takes null for the empty text.
Within a task, counts of white-space-led units are kept: in a vocabulary where the space mark occurs only at the
front of a piece, no merge crosses the front of a run of marks, and a text's count is the sum over its units. The
vocabulary is tested for that; otherwise whole texts are encoded.

Defined results: null and empty texts count 0 tokens; every row stays, repeated ones too; an empty table gives an
empty result and appends nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SCHEMA = "digest string, tokenizer string, n_tokens long"
#: Buckets of digests: those with copies go to all tasks as numbers.
BUCKETS = 1 << 20
#: Units kept with their counts in one task.
MEMO = 1_000_000


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of how it is applied."""
    h = hashlib.sha256(b"counts-1:")
    with open(path, "rb") as f:
        for part in iter(lambda: f.read(1 << 20), b""):
            h.update(part)
    return h.hexdigest()


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """What counts the tokens of a list of texts."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    probe = "  Ａé \t x\n "
    apart = mark in pieces and all(mark not in p.lstrip(mark) for p in pieces)
    apart = apart and sp.normalize(probe) == mark + probe.replace(" ", mark)
    if not apart:
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    memo: dict[str, int] = {mark: 1}
    units = re.compile(f"{mark}+[^{mark}]*").findall

    def by_units(texts: list[str]) -> list[int]:
        out = []
        for at in range(0, len(texts), 100):
            parts = [units(mark + t.replace(" ", mark)) if t else [] for t in texts[at : at + 100]]
            if len(memo) > MEMO:
                memo.clear()
                memo[mark] = 1
            new = list(set().union(*parts) - memo.keys())
            memo.update(zip(new, map(len, sp.encode([u[1:] for u in new], num_threads=1)), strict=True))  # the library puts a mark in front
            out += [sum(map(memo.__getitem__, p)) for p in parts]
        return out

    return by_units


def _count(local: Callable[[], str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(local())
        for b in batches:
            n = count([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def cached_token_counts(docs: DataFrame, path: str, cache: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs; cache is the folder of the stored counts."""
    spark = docs.sparkSession
    shared.prepare(spark)
    version = tokenizer_version(path)
    local = shared.ship(spark, path)
    content = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.sha2(content, 256).alias("digest"), content.alias("text"))
    keys = shared.materialize(keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "keys")
    try:
        stored = spark.read.schema(SCHEMA).parquet(cache)
        stored.limit(0).count()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], SCHEMA)
    known = stored.where(F.col("tokenizer") == version).select("digest").distinct().withColumn("known", F.lit(True))
    groups = keys.groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies")).join(known.hint("merge"), "digest", "left")
    groups = shared.materialize(groups, "groups")
    bucket = F.pmod(F.xxhash64("digest"), F.lit(BUCKETS))
    unsure = F.broadcast(groups.where("copies > 1 OR known").select(bucket.alias("bucket")).distinct())  # BUCKETS rows at most
    dealt = keyed.select("doc_id", "digest", "text", bucket.alias("bucket"))
    misses = groups.where("known IS NULL").select("digest", "least_id").hint("merge")
    at_home = dealt.join(unsure, "bucket", "left_anti").select("digest", "text")
    moved = dealt.join(unsure, "bucket", "left_semi").join(misses, "digest").where(F.col("doc_id").eqNullSafe(F.col("least_id"))).select("digest", "text")
    new = at_home.union(moved).mapInArrow(_count(local), "digest string, n_tokens long")
    new.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens")).select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # concurrent runs may have stored one twice
    counts = shared.materialize(counts, "counts")
    out = shared.join_ones(keys, counts, "digest", shared.hot_keys(groups, "digest", "copies"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
