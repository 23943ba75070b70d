"""Problem 2: records whose texts share most of their word shingles.

T-occurrence search by DivideSkip (Li, Lu and Lu 2008), spread over a cluster.

A text is the set of its shingles (so many tokens in a row), each a 40-bit hash. Two texts are
linked if the Jaccard similarity of their sets is at least the threshold, that is, if they share
T = ceil(threshold / (1 + threshold) * (n + m)) of their n and m shingles: if one occurs in T of the
inverted lists of the other.

1. *Divide.* Each set orders its shingles by the estimated length of their inverted lists, then by
   hash: one order for all sets. The L longest lists are set aside, the others are its short lists.
   L = T / (1 + mu * log2 M), with M the longest list and T the least overlap with any partner. The
   estimates come from a histogram of all shingles over hash ranges, whose size is fixed; any
   estimate gives right results.
2. *Merge the short lists, counting.* Their postings are spread by shingle and packed in blobs; the
   lists of a partition are merged by columns, and each meeting of two sets counts. The counts of a
   pair are summed over all partitions. Take the one of two sets whose short lists end first in the
   common order: its short lists hold the other set only where that one has the shingle among its
   short ones, so the count is exactly the number of its short lists that hold the partner. The pair
   goes on if this number reaches T - L.
3. *Probe the long lists.* The sets of the pairs that are left are inverted: each partition holds
   the lists of its own records, sorted. The first set's L long lists are probed for the partner by
   binary search. Count and hits are the exact overlap.

Bounds end chance meetings before they are counted, and none can end a pair that is similar enough,
nor one of its meetings: the sizes; what may stand before and after a meeting in both sets; and a
sketch of each set, of 1.5 to 3 bits an element, which bounds the overlap from above.

A short list beyond HOT postings (or 16 times the mean of a range of the histogram) is split: its
sets fall in groups by their hash, and each two groups meet in a task of their own.

Texts with equal sets form one class: a task sends a class once, however many copies it has, and
links are found between classes. Nothing about single texts reaches the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.fold import runs, tokens_of_run
from siftline.functions.text import tokens_sql
from siftline.operators.components import connected_components
from siftline.storage import materialize, partitions, table

#: Shingles are hashes of 5 bytes; the first 20 to 24 bits name a range of the histogram: as many ranges
#: as there are texts, between these bounds.
GRAM_BYTES, LEAST_BITS, MOST_BITS, CHUNKS = 5, 20, 24, 64
#: How much the length of the longest list counts against setting lists aside.
MU = 0.004
#: Bits of the sketch that bounds the overlap of two sets, for sets of up to 1 / 1.5 as many elements;
#: the bits double with the size of the set.
SKETCH_BITS, BITS_PER_ELEMENT = 384, 1.5
#: Places of shingles are sent up to this one; a later place bounds nothing, which loses no pair.
PLACES = 65535
#: Postings beyond which a list is split, and groups that it is split into at most.
HOT, MOST_GROUPS = 8192, 4095
#: Lists of up to so many postings are merged together with those of the same length, longer ones in blocks
#: of so many postings.
AT_ONCE = 64
#: Postings that a partition of the merge holds on average at most.
PER_PARTITION = 4_000_000
#: A task forgets the hashes of words, and the classes it has sent, beyond so many.
REMEMBERED = 2_000_000
#: Pairs held by a task of the merge before repeated ones are dropped.
PAIRS_HELD = 4_000_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def least_partner(n, threshold: float):
    """The least overlap of a set of n elements with any partner: T."""
    return np.ceil(np.asarray(n) * threshold - 1e-9).astype(np.int64)


class Shingler:
    """Makes the shingle sets of texts. Word hashes are kept from text to text."""

    def __init__(self, width: int, min_tokens: int):
        self.width, self.least = width, max(min_tokens, width)
        self.known: dict[bytes, tuple[int, ...]] = {}

    def words(self, text: str | None) -> np.ndarray:
        found, known = runs(text), self.known
        try:
            hashes = [known[r] for r in found]
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for r in found:
                if r not in known:
                    words = [r] if r.isalnum() else tokens_of_run(r)
                    own = tuple(xxhash.xxh64_intdigest(w) for w in words)
                    known[r] = own[0] if len(own) == 1 else own
            hashes = [known[r] for r in found]
        try:
            return np.array(hashes, np.uint64)
        except (TypeError, ValueError):
            flat = [y for x in hashes for y in ((x,) if type(x) is int else x)]
            return np.array(flat, np.uint64)

    def sets(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """For each text its sorted set, or None if it has too few tokens."""
        words = [self.words(t) for t in texts]
        long_enough = [i for i, w in enumerate(words) if len(w) >= self.least]
        out: list[np.ndarray | None] = [None] * len(texts)
        if not long_enough:
            return out
        flat = np.concatenate([words[i] for i in long_enough])
        size = np.array([len(words[i]) for i in long_enough])
        owner = np.repeat(np.arange(len(size)), size)
        count = len(flat) - self.width + 1
        with np.errstate(over="ignore"):
            h = np.zeros(count, np.uint64)
            for k in range(self.width):
                h = (h ^ flat[k : k + count]) * _A
                h ^= h >> np.uint64(29)
            h *= _B
            h ^= h >> np.uint64(32)
        inside = owner[:count] == owner[self.width - 1 :]
        gram, owner = h[inside] >> np.uint64(64 - 8 * GRAM_BYTES), owner[:count][inside]
        order = np.argsort(gram, kind="stable")
        order = order[np.argsort(owner[order], kind="stable")]
        gram, owner = gram[order], owner[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
        gram, owner = gram[new], owner[new]
        ends = np.searchsorted(owner, np.arange(len(size) + 1))
        for k, i in enumerate(long_enough):
            out[i] = gram[ends[k] : ends[k + 1]]
        return out


def pack(grams: np.ndarray) -> bytes:
    """A sorted set as bytes, highest byte first."""
    return grams.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - GRAM_BYTES :].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // GRAM_BYTES, 8), np.uint8)
    wide[:, 8 - GRAM_BYTES :] = np.frombuffer(blob, np.uint8).reshape(-1, GRAM_BYTES)
    return wide.view(">u8").ravel().astype(np.uint64)


def unpack_all(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The elements of many sets in a row, and the size of each set."""
    return unpack(b"".join(blobs)), np.array([len(b) // GRAM_BYTES for b in blobs], np.int64)


_SETS = pa.schema([("id", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("grams", pa.binary())])


def shingle_sets(df: DataFrame, id_col: str, text_col: str, width: int, min_tokens: int) -> DataFrame:
    """(id, sig, n, grams): sig names the class of texts with equal sets; a task gives the set of a
    class once, and null for its further copies. Texts with too few tokens have no row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sent = Shingler(width, min_tokens), set()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 1000):
                rows: tuple[list, list, list, list] = ([], [], [], [])
                for k, own in enumerate(shingler.sets(texts[lo : lo + 1000]), lo):
                    if own is None:
                        continue
                    blob = pack(own)
                    sig = xxhash.xxh64_intdigest(blob) - 2**63
                    first = sig not in sent
                    if first:
                        if len(sent) > REMEMBERED:
                            sent.clear()
                        sent.add(sig)
                    for column, x in zip(rows, (ids[k].as_py(), sig, len(own), blob if first else None)):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, _SETS)], schema=_SETS)

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        make, "id long, sig long, n int, grams binary"
    )


@dataclass
class Lengths:
    """Estimated lengths of the inverted lists: of each hash range a class, 8 to each doubling; one byte a range."""

    classes: np.ndarray
    bits: int

    def of(self, grams: np.ndarray) -> np.ndarray:
        """The class of each shingle's list."""
        return self.classes[(grams >> np.uint64(8 * GRAM_BYTES - self.bits)).astype(np.int64)]

    def postings(self) -> float:
        """About how many postings all lists have together."""
        return float((2.0 ** (self.classes[self.classes > 0] / 8) - 1).sum())

    def parts(self) -> tuple[np.ndarray, int]:
        """Its parts, to broadcast: executors need not have this class."""
        return self.classes, self.bits

    def groups(self, hot: int) -> np.ndarray:
        """For each class the number of groups that its lists are split into; 1 for no split."""
        most = max(hot, 16 * self.postings() / len(self.classes))
        return np.minimum(np.ceil(2.0 ** (np.arange(256) / 8) / most), MOST_GROUPS).astype(np.int64)


def list_lengths(sets: DataFrame) -> Lengths:
    """Partial histograms are summed in CHUNKS pieces on the executors; what the driver collects and
    broadcasts has at most 2^MOST_BITS bytes whatever the size of the collection."""
    bits = min(max(LEAST_BITS, math.ceil(math.log2(max(1, sets.count())))), MOST_BITS)
    per = 2**bits // CHUNKS

    def count(batches):
        total = np.zeros(2**bits, np.int64)
        for batch in batches:
            blobs = [b for b in batch.column(0).to_pylist() if b]
            if blobs:
                grams, _ = unpack_all(blobs)
                total += np.bincount((grams >> np.uint64(8 * GRAM_BYTES - bits)).astype(np.int64), minlength=2**bits)
        if total.any():
            parts = [zlib.compress(total[k * per : (k + 1) * per].tobytes(), 1) for k in range(CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(blob), np.int64)
        parts = [np.minimum(np.log2(sums[k] + 1.0) * 8, 255).astype(np.uint8).tobytes() for k in sums]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    summed = sets.select("grams").where("grams is not null").mapInArrow(count, schema)
    out = np.zeros(2**bits, np.uint8)
    n = min(CHUNKS, partitions(sets.sparkSession))
    for row in summed.repartition(n, "chunk").mapInArrow(add, schema).collect():
        out[row.chunk * per : (row.chunk + 1) * per] = np.frombuffer(row.counts, np.uint8)
    return Lengths(out, bits)


def sketch_levels(size: np.ndarray) -> np.ndarray:
    """How often the bits of the sketches of sets of these sizes are doubled."""
    return np.ceil(np.log2(np.maximum(size * BITS_PER_ELEMENT / SKETCH_BITS, 1)) - 1e-9).astype(np.int64)


def sketches(grams: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set its sketch of 64-bit words, all in a row, and the number of its words.

    A bit is the parity of the number of elements that fall on it, so two sets that share an element
    differ by nothing for it. A sketch of twice the bits folds to the shorter one: its halves xored.
    """
    bits = SKETCH_BITS << sketch_levels(size)
    begin = np.cumsum(bits) - bits
    with np.errstate(over="ignore"):
        spread = (grams * _C >> np.uint64(32)).astype(np.int64)
    bit = np.repeat(begin, size) + spread % np.repeat(bits, size)
    parity = (np.bincount(bit, minlength=int(bits.sum())) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.uint64), bits // 64


@dataclass
class Divided:
    """Sets in the common order of their shingles: owner, gram and place of each element, and of each set
    the number of its long lists and its pivot, the last element of its short lists in that order."""

    owner: np.ndarray
    gram: np.ndarray
    place: np.ndarray
    kind: np.ndarray
    long: np.ndarray
    pivot: np.ndarray


def divide(grams: np.ndarray, size: np.ndarray, lengths: Lengths, threshold: float, mu: float = MU) -> Divided:
    """Divides the lists of each set (``size`` elements each, one after another) in short and long ones."""
    owner = np.repeat(np.arange(len(size)), size)
    kind = lengths.of(grams).astype(np.int64)
    order = np.lexsort((grams, kind, owner))
    grams, kind = grams[order], kind[order]
    begin = np.cumsum(size) - size
    least = least_partner(size, threshold)
    long = np.minimum(least - 1, np.floor(least / (1 + mu * kind[begin + size - 1] / 8)).astype(np.int64))
    last = begin + size - long - 1
    pivot = kind[last] << 8 * GRAM_BYTES | grams[last].astype(np.int64)
    return Divided(owner, grams, np.arange(len(grams)) - np.repeat(begin, size), kind, long, pivot)


def _spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * _A
        return (x ^ x >> np.uint64(29)) * _B >> np.uint64(20)


_GRAM = np.uint64(2 ** (8 * GRAM_BYTES) - 1)


def short_postings(sets: DataFrame, lengths: Lengths, threshold: float, parts: int, hot: int = HOT) -> DataFrame:
    """(part, blob): the postings of each set's short lists, packed by the partition of the list.

    Those of a list that is split are sent to one cell for each group that their own group meets.
    """
    known = sets.sparkSession.sparkContext.broadcast(lengths.parts())

    def send(batches):
        lengths = Lengths(*known.value)
        groups = lengths.groups(hot)
        for batch in batches:
            full = batch.filter(batch.column(1).is_valid())
            for lo in range(0, full.num_rows, 4000):
                some = full.slice(lo, 4000)
                sig = some.column(0).to_numpy().astype(np.int64)
                if not len(sig):
                    continue
                grams, size = unpack_all(some.column(1).to_pylist())
                sketch, words = sketches(grams, size)
                first_word = np.cumsum(words) - words
                d = divide(grams, size, lengths, threshold)
                keep = d.place < (size - d.long)[d.owner]
                own, place, key = d.owner[keep], np.minimum(d.place[keep], PLACES), d.gram[keep]
                split = groups[d.kind[keep]]
                side = np.zeros(len(own), np.uint8)
                if (many := split > 1).any():
                    n = split[many]
                    group = (_spread(sig[own[many]]) % n.astype(np.uint64)).astype(np.int64)
                    other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    group = np.repeat(group, n)
                    cell = (np.minimum(group, other) + 1) << 12 | np.maximum(group, other) + 1
                    cold = ~many
                    own = np.r_[own[cold], np.repeat(own[many], n)]
                    place = np.r_[place[cold], np.repeat(place[many], n)]
                    key = np.r_[key[cold], np.repeat(key[many], n) | cell.astype(np.uint64) << np.uint64(8 * GRAM_BYTES)]
                    side = np.r_[side[cold], (group > other).astype(np.uint8)]
                part = (_spread(key) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((own, part))
                own, place, key, side, part = own[order], place[order], key[order], side[order], part[order]
                ends = np.flatnonzero(np.r_[part[1:] != part[:-1], True]) + 1
                out_part, out_blob = [], []
                for a, b in zip(np.r_[0, ends[:-1]], ends):
                    sets_here, postings = np.unique(own[a:b], return_counts=True)
                    own_words = words[sets_here]
                    at = np.repeat(first_word[sets_here] - np.cumsum(own_words) + own_words, own_words)
                    own_sketch = sketch[at + np.arange(len(at))]
                    in_cells = bool((key[a:b] > _GRAM).any())
                    columns = [
                        np.array([len(sets_here), b - a, len(own_sketch), in_cells], np.int64), sig[sets_here], own_sketch, d.pivot[sets_here],
                        size[sets_here].astype(np.int32), d.long[sets_here].astype(np.int32), postings.astype(np.int32),
                        (key[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key[a:b] >> np.uint64(32)).astype(np.uint32 if in_cells else np.uint8), place[a:b].astype(np.uint16),
                    ]
                    if in_cells:
                        columns.append(side[a:b])
                    out_part.append(int(part[a]))
                    out_blob.append(b"".join(x.tobytes() for x in columns))
                yield pa.RecordBatch.from_arrays([pa.array(out_part, pa.int32()), pa.array(out_blob, pa.binary())], ["part", "blob"])

    return sets.select("sig", "grams").where("grams is not null").mapInArrow(send, "part int, blob binary")


@dataclass
class Postings:
    """What one partition of the merge holds: of its sets, and of their postings in its lists.

    A list is named by key: its shingle, and above it the cell of a list that is split. side says in
    which group of the cell a set is. sketch[level] has a row of words for each set of at least that
    level, row[level] its number.
    """

    sig: np.ndarray
    size: np.ndarray
    long: np.ndarray
    pivot: np.ndarray
    level: np.ndarray
    sketch: list[np.ndarray]
    row: list[np.ndarray]
    key: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    side: np.ndarray

    @classmethod
    def read(cls, blobs: list[bytes]) -> Postings:
        columns: list[list[np.ndarray]] = [[] for _ in range(9)]
        base = 0
        for blob in blobs:
            n, m, w, in_cells = np.frombuffer(blob, np.int64, 4)
            at, got = 32, []
            kinds = ((np.int64, n), (np.uint64, w), (np.int64, n), (np.int32, n), (np.int32, n), (np.int32, n), (np.uint32, m), (np.uint32 if in_cells else np.uint8, m), (np.uint16, m))
            for kind, count in (*kinds, *([(np.uint8, m)] if in_cells else [])):
                got.append(np.frombuffer(blob, kind, count, at))
                at += got[-1].nbytes
            sig, sketch, pivot, size, long, postings, low, high, place = got[:9]
            key = high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
            side = got[9] if in_cells else np.zeros(m, np.uint8)
            owner = np.repeat(np.arange(base, base + n), postings)
            for column, x in zip(columns, (sig, sketch, pivot, size, long, key, owner, place, side)):
                column.append(x)
            base += n
        sig, sketch, pivot, size, long, key, owner, place, side = map(np.concatenate, columns)
        # a class that several tasks sent counts once
        words = (SKETCH_BITS << sketch_levels(size)) // 64
        unique, first, inverse = np.unique(sig, return_index=True, return_inverse=True)
        begin = (np.cumsum(words) - words)[first]
        size, owner = size[first].astype(np.int64), inverse[owner]
        level = sketch_levels(size)
        sketches, rows = [], []
        for k in range(int(level.max(initial=0)) + 1):
            have = np.flatnonzero(level >= k)
            row = np.full(len(unique), -1)
            row[have] = np.arange(len(have))
            matrix = np.zeros((len(have), SKETCH_BITS // 64 << k), np.uint64)
            for j in range(k, int(level.max(initial=0)) + 1):
                these = np.flatnonzero(level == j)
                full = sketch[begin[these][:, None] + np.arange(SKETCH_BITS // 64 << j)]
                matrix[row[these]] = np.bitwise_xor.reduce(full.reshape(len(these), 1 << (j - k), matrix.shape[1]), axis=1)
            sketches.append(matrix)
            rows.append(row)
        order = np.lexsort((owner, size[owner], key))
        key, owner, place, side = key[order], owner[order], place[order].astype(np.int64), side[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
        return cls(unique, size, long[first].astype(np.int64), pivot[first], level, sketches, rows, key[new], owner[new], place[new], side[new])


class Meetings:
    """Counts the meetings of the pairs of sets that no bound excludes."""

    def __init__(self, p: Postings, threshold: float):
        self.p, self.slack, self.share = p, (1 - threshold) / (1 + threshold), threshold / (1 + threshold)
        self.cross = p.key >> np.uint64(8 * GRAM_BYTES + 12) != p.key >> np.uint64(8 * GRAM_BYTES) & np.uint64(0xFFF)
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.held = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Meetings of the postings i with the postings j, which the first level of the sketches didn't end."""
        p = self.p
        for lo in range(0, len(i), 100_000):
            x, y = i[lo : lo + 100_000], j[lo : lo + 100_000]
            a, b = p.owner[x], p.owner[y]
            most = np.minimum(p.place[x], p.place[y]) + np.minimum(p.size[a] - p.place[x], p.size[b] - p.place[y])
            shown = (p.place[x] < PLACES) & (p.place[y] < PLACES)
            fine = (~shown | (most >= self.share * (p.size[a] + p.size[b]) - 1e-6)) & ((p.side[x] != p.side[y]) | ~self.cross[x])
            a, b = a[fine], b[fine]
            for k in range(1, len(p.sketch)):  # both have a sketch of this level
                finer = (p.level[a] >= k) & (p.level[b] >= k)
                self._count(a[~finer], b[~finer])
                a, b = a[finer], b[finer]
                matrix, row = p.sketch[k], p.row[k]
                differ = np.bitwise_count(matrix[row[a]] ^ matrix[row[b]]).sum(axis=1, dtype=np.int64)
                fine = differ <= self.slack * (p.size[a] + p.size[b]) + 1e-6
                a, b = a[fine], b[fine]
            self._count(a, b)

    def _count(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            keys, times = np.unique(np.minimum(a, b) * len(self.p.sig) + np.maximum(a, b), return_counts=True)
            self.keys.append(keys)
            self.times.append(times)
            self.held += len(keys)
            if self.held > PAIRS_HELD:
                self.sum()
                self.held = 0

    def sum(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs and their meetings."""
        if not self.keys:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        self.keys, self.times = [keys[first]], [np.add.reduceat(times, first)]
        return self.keys[0] // len(self.p.sig), self.keys[0] % len(self.p.sig), self.times[0]


def merge_short_lists(p: Postings, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places in p.sig that no bound excludes, and in how many lists of p they meet.

    Every list is in order of set size. All lists of one length up to AT_ONCE are stacked, and in round
    d each posting meets the one d places after it. In longer lists blocks of postings meet all that
    follow, up to the size of their largest partner. Sizes and the first level of the sketches are
    compared for all that meet, the other bounds for what is left.
    """
    found = Meetings(p, threshold)
    if not len(p.key):
        return found.sum()
    slack = (found.slack * p.size + 1e-6).astype(np.float32)
    most = p.size / threshold + 1e-6
    first_row = p.row[0]
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    held = 0

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal held
        left.append(i)
        right.append(j)
        held += len(i)
        if held > 200_000:
            flush()

    def flush() -> None:
        nonlocal held
        if left:
            found.add(np.concatenate(left), np.concatenate(right))
        left.clear()
        right.clear()
        held = 0

    ends = np.flatnonzero(np.r_[p.key[1:] != p.key[:-1], True]) + 1
    starts = np.r_[0, ends[:-1]]
    length = ends - starts
    for n in range(2, min(AT_ONCE, int(length.max())) + 1):
        own = starts[length == n]
        for lo in range(0, len(own), max(1, 16384 // n)):
            at = own[lo : lo + max(1, 16384 // n), None] + np.arange(n)
            sets = p.owner[at]
            words = np.ascontiguousarray(p.sketch[0][first_row[sets]].transpose(2, 0, 1))
            size, upto, loose = p.size[sets], most[sets], slack[sets]
            for d in range(1, n):
                differ = np.bitwise_count(words[:, :, :-d] ^ words[:, :, d:]).sum(axis=0, dtype=np.uint16)
                g, k = np.nonzero((differ <= loose[:, :-d] + loose[:, d:]) & (size[:, d:] <= upto[:, :-d]))
                if len(g):
                    keep(at[g, k], at[g, k + d])
    for a, b in zip(starts[length > AT_ONCE].tolist(), ends[length > AT_ONCE].tolist()):
        sets = p.owner[a:b]
        words = np.ascontiguousarray(p.sketch[0][first_row[sets]].T)
        size, loose = p.size[sets], slack[sets]
        last = np.searchsorted(size, most[sets], side="right")
        for lo in range(0, b - a, AT_ONCE):
            hi = min(lo + AT_ONCE, b - a)
            for c in range(lo, int(last[hi - 1]), 4096):
                e = min(c + 4096, int(last[hi - 1]))
                differ = np.zeros((hi - lo, e - c), np.uint16)
                for w in words:
                    differ += np.bitwise_count(w[lo:hi, None] ^ w[None, c:e])
                rows, columns = np.nonzero(differ <= loose[lo:hi, None] + loose[None, c:e])
                i, j = rows + lo, columns + c
                fine = (j > i) & (j < last[i])
                keep(i[fine] + a, j[fine] + a)
    flush()
    return found.sum()


_PAIRS = "sig_a long, sig_b long, n_a int, n_b int, short int, least int"


def candidates(postings: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(sig_a, sig_b, n_a, n_b, short, least): pairs of classes that may be similar enough; a is the one whose
    short lists end first, short the number of them that hold b, least the overlap that is needed."""
    share = threshold / (1 + threshold)

    def merge(batches):
        blobs = [b for batch in batches for b in batch.column(1).to_pylist()]
        if not blobs:
            return
        p = Postings.read(blobs)
        x, y, times = merge_short_lists(p, threshold)
        first = (p.pivot[x] < p.pivot[y]) | ((p.pivot[x] == p.pivot[y]) & (p.sig[x] < p.sig[y]))
        x, y = np.where(first, x, y), np.where(first, y, x)
        least = np.ceil(share * (p.size[x] + p.size[y]) - 1e-6)
        for lo in range(0, len(x), 50_000):
            a, b, own = x[lo : lo + 50_000], y[lo : lo + 50_000], slice(lo, lo + 50_000)
            columns = (p.sig[a], p.sig[b], p.size[a].astype(np.int32), p.size[b].astype(np.int32), times[own].astype(np.int32), least[own].astype(np.int32), p.long[a].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sig_a", "sig_b", "n_a", "n_b", "short", "least", "long"])

    met = postings.repartitionById(parts, F.col("part")).mapInArrow(merge, _PAIRS + ", long int")
    each = [F.first(c).alias(c) for c in ("n_a", "n_b")] + [F.sum("short").cast("int").alias("short")] + [F.first(c).alias(c) for c in ("least", "long")]
    return met.groupBy("sig_a", "sig_b").agg(*each).where("short >= least - long").drop("long")


def probe(pairs: DataFrame, sets: DataFrame, lengths: Lengths, threshold: float, parts: int) -> DataFrame:
    """(sig_a, sig_b, similarity): the pairs that have the overlap which is needed.

    The sets of the pairs are inverted by the partition of their sig, so that a long list, however
    long, is held in pieces by all partitions. A probe is a pair with the long lists of its first
    set; it goes to the partition of the second.
    """
    spark = sets.sparkSession
    known = spark.sparkContext.broadcast(lengths.parts())
    needed = pairs.select(F.explode(F.array("sig_a", "sig_b")).alias("sig")).distinct()
    held = (
        sets.select("sig", "grams").where("grams is not null").join(needed, "sig", "left_semi")
        .groupBy("sig").agg(F.first("grams").alias("grams"))
    )
    schema = "part int, sig_a long, sig_b long, short int, least int, n_both int, grams binary"

    def lists_of(batches):
        """The long lists of the first set of each pair."""
        lengths = Lengths(*known.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                some = batch.slice(lo, 4000)
                grams, size = unpack_all(some.column("grams").to_pylist())
                d = divide(grams, size, lengths, threshold)
                keep = d.place >= (size - d.long)[d.owner]
                own, grams = d.owner[keep], d.gram[keep]
                ends = np.searchsorted(own, np.arange(len(size) + 1))
                blobs = [pack(grams[ends[k] : ends[k + 1]]) for k in range(len(size))]
                yield pa.RecordBatch.from_arrays([*[some.column(c) for c in ("part", "sig_a", "sig_b", "short", "least", "n_both")], pa.array(blobs, pa.binary())], schema=_PROBE)

    part = lambda sig: F.pmod(F.xxhash64(sig), F.lit(parts)).cast("int").alias("part")
    asked = pairs.join(held.withColumnRenamed("sig", "sig_a"), "sig_a").select(part("sig_b"), "sig_a", "sig_b", "short", "least", (F.col("n_a") + F.col("n_b")).alias("n_both"), "grams")
    probes = asked.mapInArrow(lists_of, schema)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    lists = held.select(part("sig"), none("sig_a", "long"), F.col("sig").alias("sig_b"), none("short", "int"), none("least", "int"), none("n_both", "int"), "grams")

    def search(batches):
        listed, waiting = [], []
        for batch in batches:
            is_list = batch.column("sig_a").is_null()
            listed.append(batch.filter(is_list))
            waiting.append(batch.filter(batch.column("sig_a").is_valid()))
        records = [(s, g) for b in listed for s, g in zip(b.column("sig_b").to_pylist(), b.column("grams").to_pylist())]
        if not records:
            return
        records.sort(key=lambda r: r[0])
        sig = np.array([s for s, _ in records], np.int64)
        grams, size = unpack_all([g for _, g in records])
        inverted, at = np.unique(grams, return_inverse=True)  # the lists of this partition
        entries = np.sort(at << 32 | np.repeat(np.arange(len(sig)), size))  # each in order of its records
        for batch in waiting:
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                grams, size = unpack_all(some.column("grams").to_pylist())
                record = np.searchsorted(sig, some.column("sig_b").to_numpy())
                which = np.minimum(np.searchsorted(inverted, grams), len(inverted) - 1)
                want = which << 32 | np.repeat(record, size)
                spot = np.minimum(np.searchsorted(entries, want), len(entries) - 1)
                hit = (inverted[which] == grams) & (entries[spot] == want)
                total = np.r_[0, np.cumsum(hit)]
                ends = np.cumsum(size)
                both = some.column("short").to_numpy() + total[ends] - total[ends - size]
                alike = both / (some.column("n_both").to_numpy() - both)
                fine = pa.array((both >= some.column("least").to_numpy()) & (alike >= threshold - 1e-12))
                yield pa.RecordBatch.from_arrays([some.column("sig_a").filter(fine), some.column("sig_b").filter(fine), pa.array(alike).filter(fine)], ["sig_a", "sig_b", "similarity"])

    return probes.unionByName(lists).repartitionById(parts, F.col("part")).mapInArrow(search, "sig_a long, sig_b long, similarity double")


_PROBE = pa.schema([("part", pa.int32()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("short", pa.int32()), ("least", pa.int32()), ("n_both", pa.int32()), ("grams", pa.binary())])


@dataclass
class Links:
    """members (id, sig): each text of at least the least length and its class;
    links (sig_a, sig_b, similarity): pairs of different classes that are similar enough."""

    members: DataFrame
    links: DataFrame


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, *, threshold: float = 0.8, width: int = 5, min_tokens: int = 5, hot: int = HOT
) -> Links:
    """Links between all texts whose shingle sets have at least ``threshold`` of their union in common.

    Null, empty and short texts (fewer than ``min_tokens`` tokens, or than one shingle) belong to no
    class. Rows delivered twice, and rows with a null id, count once and not at all. Further columns
    of ``df``, whatever their names, are ignored. An empty table gives two empty tables. Lists of more
    than ``hot`` postings are split.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    sets = materialize(
        shingle_sets(df.where(F.col(id_col).isNotNull()), id_col, text_col, width, min_tokens), "shingle-sets"
    )
    lengths = list_lengths(sets)
    parts = max(partitions(df.sparkSession), math.ceil(lengths.postings() / PER_PARTITION))
    postings = short_postings(sets, lengths, threshold, parts, hot)
    pairs = materialize(candidates(postings, threshold, parts), "near-duplicate-candidates")
    links = materialize(probe(pairs, sets, lengths, threshold, parts), "near-duplicate-links")
    return Links(sets.select("id", "sig").distinct(), links)


def linked_pairs(found: Links) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all linked pairs, copies included. The result can be large:
    k copies have k(k-1)/2 pairs; use ``groups`` where these aren't needed."""
    m = found.members
    copied = m.groupBy("sig").count().where("count > 1").select("sig")
    copies = m.join(copied, "sig", "left_semi")
    same = copies.select("sig", F.col("id").alias("doc_a")).join(copies.select("sig", F.col("id").alias("doc_b")), "sig").where("doc_a < doc_b").select("doc_a", "doc_b")
    other = found.links.join(m.select(F.col("sig").alias("sig_a"), F.col("id").alias("a")), "sig_a").join(
        m.select(F.col("sig").alias("sig_b"), F.col("id").alias("b")), "sig_b"
    )
    return same.unionByName(other.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")))


def groups(found: Links) -> DataFrame:
    """(id, class_id, group_id, n_links): one row per text that is long enough. class_id is the
    least id of the texts with the same set, group_id that of all texts reachable by links, n_links
    the number of other classes that the text's class is linked to."""
    m = found.members
    classes = m.groupBy("sig").agg(F.min("id").alias("class_id"))
    ends = found.links.select(F.explode(F.array("sig_a", "sig_b")).alias("sig"))
    degree = ends.groupBy("sig").agg(F.count("*").alias("n_links"))
    edges = (
        found.links.join(classes.select(F.col("sig").alias("sig_a"), F.col("class_id").alias("src")), "sig_a")
        .join(classes.select(F.col("sig").alias("sig_b"), F.col("class_id").alias("dst")), "sig_b")
        .select("src", "dst")
    )
    component = connected_components(edges).select(F.col("node").alias("class_id"), "component")
    known = classes.join(degree, "sig", "left").join(component, "class_id", "left")
    return m.join(known, "sig").select(
        "id", "class_id",
        F.coalesce("component", "class_id").alias("group_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
    )


def _of_docs(spark: SparkSession, sf_dir: str) -> Links:
    return near_duplicates(table(spark, sf_dir, "docs"), "doc_id", "body", threshold=0.6, width=3, min_tokens=20)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_a, doc_b) of docs: bodies of at least 20 tokens with at least 0.6 of their 3-token shingles in common."""
    return linked_pairs(_of_docs(spark, sf_dir))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page of docs with at least 20 tokens, its class of equal texts and its group of near-duplicates."""
    return groups(_of_docs(spark, sf_dir)).withColumnRenamed("id", "doc_id")


_SHINGLES_SQL = f"""
tk AS (SELECT DISTINCT doc_id, {tokens_sql("body")} AS t FROM docs WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM tk WHERE len(t) >= 20)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
found AS (SELECT doc_a, doc_b, k = x.n AND k = y.n AS same FROM p JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE 10 * k >= 6 * (x.n + y.n - k))"""

SQL = {
    "p2_found": f"WITH {_SHINGLES_SQL} SELECT doc_a, doc_b FROM found",
    "p2_groups": f"""WITH RECURSIVE {_SHINGLES_SQL},
class AS (SELECT n.doc_id, coalesce(min(f.doc_a), n.doc_id) AS class_id FROM n LEFT JOIN found f ON f.same AND f.doc_b = n.doc_id GROUP BY n.doc_id),
e AS (SELECT DISTINCT x.class_id AS src, y.class_id AS dst FROM found JOIN class x ON x.doc_id = doc_a JOIN class y ON y.doc_id = doc_b WHERE NOT same),
both_ways AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
reached(node, other) AS (SELECT DISTINCT class_id, class_id FROM class UNION SELECT r.node, b.dst FROM reached r JOIN both_ways b ON b.src = r.other)
SELECT c.doc_id, c.class_id, g.group_id, coalesce(l.n_links, 0) AS n_links FROM class c JOIN (SELECT node, min(other) AS group_id FROM reached GROUP BY node) g ON g.node = c.class_id
LEFT JOIN (SELECT src, count(*) AS n_links FROM both_ways GROUP BY src) l ON l.src = c.class_id""",
}
