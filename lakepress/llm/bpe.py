"""Byte-level BPE encoding and decoding (operator 3).

Each pre-token is a doubly linked list of symbols; a priority queue holds the mergeable neighbours by merge rank,
then place. A popped entry whose symbols have changed meanwhile is stale and skipped. Decoding concatenates the
vocabulary's byte strings. Ids of pre-tokens seen before are kept in a bounded table, so merges run once per
distinct pre-token and task.

Special tokens inside texts become their ids, as the tokenizers library does by default. Defined results: null
and empty texts give no ids and the empty string; very long words cost n log n; every row is kept as it is.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Pre-tokens kept with their ids in one task.
MEMO = 800_000
#: Marks a symbol that has been merged into its left neighbour.
GONE = -1
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class BytePairCoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab = model["vocab"]
        self.start = [vocab[letters[b]] for b in range(256)]
        #: Rank by pair (left id * 2**20 + right id), and the id that each rank makes.
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        for rank, m in enumerate(model["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[x] << 20 | vocab[y]] = rank
            self.made.append(vocab[x + y])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.find = regex.compile(PATTERN).findall
        names = sorted(self.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.memo: dict[str, tuple[int, ...]] = {}

    def word(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token. A queue entry is rank * 2**32 + place; it is stale if that rank's pair no longer stands there."""
        start, merges = self.start, self.merges
        ids = [start[b] for b in piece.encode()]
        n = len(ids)
        queue = [rank << 32 | i for i in range(n - 1) if (rank := merges.get(ids[i] << 20 | ids[i + 1])) is not None]
        if not queue:
            return tuple(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        made, pop, push = self.made, heapq.heappop, heapq.heappush
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if j < 0 or merges.get(ids[i] << 20 | ids[j]) != rank:
                continue  # stale
            ids[i] = new = made[rank]
            ids[j], k = GONE, after[j]
            after[i], after[j] = k, -1
            if k >= 0:
                before[k] = i
                if (rank := merges.get(new << 20 | ids[k])) is not None:
                    push(queue, rank << 32 | i)
            if (h := before[i]) >= 0 and (rank := merges.get(ids[h] << 20 | new)) is not None:
                push(queue, rank << 32 | h)
        return tuple([x for x in ids if x != GONE])

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo = self.memo
        parts = self.split(text) if self.split and any(s in text for s in self.special) else [text]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            for piece in self.find(part):
                ids = memo.get(piece)
                if ids is None:
                    ids = self.word(piece)
                    if len(piece) <= 64:
                        if len(memo) >= MEMO:
                            memo.clear()
                        memo[piece] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def bpe_encode_decode(docs: DataFrame, path: str, text_col: str = "text", decoded: bool = True) -> DataFrame:
    """docs with ids (array of int), n_tokens (long) and, if asked for, decoded (string) as its last columns.

    A name that docs has already gets underscores behind it; docs' own column stays.
    """
    shared.prepare(docs.sparkSession)
    local = shared.ship(docs.sparkSession, path)
    name = lambda c: shared.free(docs, c)
    new = [T.StructField(name("ids"), T.ArrayType(T.IntegerType())), T.StructField(name("n_tokens"), T.LongType())] + [T.StructField(name("decoded"), T.StringType())] * decoded
    schema = T.StructType(docs.schema.fields + new)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BytePairCoder(local())
        for whole in batches:
            step = max(1, min(whole.num_rows, 250))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                flat, ends, texts = [], [0], []
                for t in b.column(text_col).to_pylist():
                    ids = coder.encode(t) if t else []
                    if decoded:
                        texts.append(coder.decode(ids))
                    flat.append(np.array(ids, np.int32))
                    ends.append(ends[-1] + len(ids))
                at_ = np.array(ends)
                values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
                cols = [pa.ListArray.from_arrays(pa.array(at_, pa.int32()), values), pa.array(np.diff(at_), pa.int64())] + [pa.array(texts, pa.string())] * decoded
                yield pa.RecordBatch.from_arrays(list(b.columns) + cols, names=b.schema.names + [f.name for f in new])

    return docs.mapInArrow(run, schema)


def ids_digest(ids) -> F.Column:
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
