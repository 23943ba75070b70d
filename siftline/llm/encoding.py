"""Problem 6: the token ids of every text by a public byte-level BPE.

Pair occurrence index: the distinct pieces of a batch of texts (what the tokenizer's pattern cuts
texts into) are laid out one after another as symbols, and each adjacent pair that some merge joins
is mapped to all its places. The ranks that occur are then applied in ascending order, each at all
its places at once; a merge changes only the neighbouring pairs, whose places are added to the
lists of their ranks. A piece is merged once per task, however often it occurs.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.storage import table, without_copies

#: Where the vocabulary files of public tokenizers are; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that byte_bpe_50k cuts a text with before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A task forgets its merged pieces beyond so many.
REMEMBERED = 1_000_000


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable
    Latin-1 characters stand for themselves, the other bytes take the characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@dataclass
class Merges:
    """A byte-level BPE: the id of each byte, and for each pair of ids (left << 32 | right, sorted)
    the rank of its merge and the id that it makes."""

    byte_ids: np.ndarray
    pairs: np.ndarray
    ranks: np.ndarray
    made: np.ndarray

    @classmethod
    def load(cls, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Merges:
        """Reads a tokenizers JSON file whose model is a byte-level BPE. Runs on the driver; what it
        gives is bounded by the vocabulary and is broadcast."""
        with open(f"{folder}/{name}.json", encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{name} is no byte-level BPE")
        vocab = spec["model"]["vocab"]
        byte_ids = np.zeros(256, np.int64)
        for symbol, b in _byte_symbols().items():
            byte_ids[b] = vocab[symbol]
        rows = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            rows.append((vocab[left] << 32 | vocab[right], rank, vocab[left + right]))
        rows.sort()
        pairs, ranks, made = (np.array(c, np.int64) for c in zip(*rows))
        return cls(byte_ids, pairs, ranks, made)

    def parts(self) -> tuple[np.ndarray, ...]:
        """Its arrays, to broadcast: executors need not have this class."""
        return self.byte_ids, self.pairs, self.ranks, self.made


class PairIndexEncoder:
    """Encodes texts; keeps the ids of the pieces it has met."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.split = regex.compile(PATTERN).findall
        self.rank_of = dict(zip(merges.pairs.tolist(), merges.ranks.tolist()))
        by_rank = np.argsort(merges.ranks)
        self.left = (merges.pairs >> 32)[by_rank].tolist()
        self.right = (merges.pairs & 0xFFFFFFFF)[by_rank].tolist()
        self.made = merges.made[by_rank].tolist()
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = [np.empty(0, np.int32)]
        self.sizes = [np.empty(0, np.int64)]

    def learn(self, pieces: list[str]) -> None:
        """Merges all the pieces together and keeps their ids."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.merges.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(symbols)
        ends = np.cumsum(size)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends - 1] = -1
        before[ends - size] = -1
        # the index: rank -> places, first of the raw bytes
        at = np.flatnonzero(following >= 0)
        keys = symbols[at] << 32 | symbols[at + 1]
        spot = np.minimum(np.searchsorted(self.merges.pairs, keys), len(self.merges.pairs) - 1)
        known = self.merges.pairs[spot] == keys
        at, rank = at[known], self.merges.ranks[spot[known]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        firsts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else np.empty(0, int)
        places = {int(rank[a]): at[a:b].tolist() for a, b in zip(firsts, np.r_[firsts[1:], len(rank)])}
        sym, nxt, prv = symbols.tolist(), following.tolist(), before.tolist()
        rank_of, active = self.rank_of.get, list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, new = self.left[r], self.right[r], self.made[r]
            for p in sorted(places.pop(r)):
                q = nxt[p]
                if sym[p] != a or q < 0 or sym[q] != b:
                    continue  # an earlier merge took one of the two
                sym[p], sym[q] = new, -1
                nxt[p] = after = nxt[q]
                if after >= 0:
                    prv[after] = p
                    if (k := rank_of(new << 32 | sym[after])) is not None:
                        if k in places:
                            places[k].append(p)
                        else:
                            places[k] = [p]
                            heapq.heappush(active, k)
                if (left := prv[p]) >= 0 and (k := rank_of(sym[left] << 32 | new)) is not None:
                    if k in places:
                        places[k].append(left)
                    else:
                        places[k] = [left]
                        heapq.heappush(active, k)
        done = np.array(sym, np.int64)
        alive = done >= 0
        for k, piece in enumerate(pieces, len(self.place)):
            self.place[piece] = k
        self.ids.append(done[alive].astype(np.int32))
        self.sizes.append(np.add.reduceat(alive.astype(np.int64), ends - size) if n else np.empty(0, np.int64))

    def places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts as places among the known ones, and the number of pieces of each text."""
        if len(self.place) > REMEMBERED:
            self.forget()
        cut = [self.split(t) if t else [] for t in texts]
        if new := {p for pieces in cut for p in pieces}.difference(self.place):
            self.learn(list(new))
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        get = self.place.__getitem__
        where = np.fromiter((k for pieces in cut for k in map(get, pieces)), np.int64, int(count.sum()))
        return where, count

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        where, count = self.places(texts)
        self.sizes = [np.concatenate(self.sizes)]
        total = np.concatenate([[0], np.cumsum(self.sizes[0][where])])
        ends = np.cumsum(count)
        return total[ends] - total[ends - count]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text begins (one more than texts)."""
        where, count = self.places(texts)
        self.ids, self.sizes = [np.concatenate(self.ids)], [np.concatenate(self.sizes)]
        size = self.sizes[0]
        begin = np.cumsum(size) - size
        own = size[where]
        total = np.concatenate([[0], np.cumsum(own)])
        flat = self.ids[0][np.arange(total[-1]) + np.repeat(begin[where] - total[:-1], own)]
        return flat, total[np.concatenate([[0], np.cumsum(count)])]


#: Texts encoded together. Batches that Spark sends are cut to this number, so memory stays bounded.
TOGETHER = 2000


def encode_texts(df: DataFrame, id_col: str, text_col: str, *, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id_col, ids array<int>): one row per value of ``id_col``.

    The text is taken exactly as it stands; strings of special tokens in it are ordinary text. A null
    text and an empty one give an empty list. Rows delivered twice count once; a null id is a value
    like others. Other columns are ignored.
    """
    spark = df.sparkSession
    known = spark.sparkContext.broadcast(Merges.load(tokenizer, folder).parts())
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairIndexEncoder(Merges(*known.value))
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(lo, TOGETHER)
                flat, begin = encoder.encode(some.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), ids], [id_col, "ids"])

    rows = without_copies(df.select(id_col, text_col), id_col)
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(batches: Iterator[pa.RecordBatch], merges: Merges) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of (id, text) and the number of tokens of each row."""
    encoder = PairIndexEncoder(merges)
    for batch in batches:
        for lo in range(0, batch.num_rows, TOGETHER):
            some = batch.slice(lo, TOGETHER)
            yield some, encoder.counts(some.column(1).to_pylist())


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of documents by byte_bpe_50k."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")
