"""Dense vectors: an encoder, exact nearest neighbours for batches of queries, blends with authority."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.config import DEFAULTS, Settings
from siftline.functions.fold import stem, tokenize
from siftline.functions.numbers import rounded
from siftline.functions.text import STOP_WORDS
from siftline.operators.search import top
from siftline.storage import materialize

#: Vectors in a block of the collection, queries in a block, and bytes of queries sent to all tasks at once.
BLOCK, QUERY_BLOCK, QUERY_BYTES = 4096, 512, 64_000_000


def hashed(text: str | None, dim: int, stop: frozenset[str]) -> np.ndarray:
    """Signed feature hashing of a text's stems, of length 1; zeros for a text without any."""
    v = np.zeros(dim)
    for token in tokenize(text):
        if token not in stop and len(token) > 1:
            h = xxhash.xxh64_intdigest(stem(token))
            v[h % dim] += 1.0 if h >> 63 else -1.0
    norm = np.sqrt(v @ v)
    return (v / norm if norm else v).astype(np.float32)


def encode(df: DataFrame, id_col: str, text_col: str, *, dim: int = DEFAULTS.embedding_dim) -> DataFrame:
    """(id_col, embedding array<float>). Any model that maps texts to vectors can stand in for the hashing:
    this one needs no download and gives the same vectors everywhere."""
    stop = frozenset(STOP_WORDS)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [hashed(t, dim, stop) for t in batch.column(1).to_pylist()]
            flat = pa.array(np.concatenate(vectors) if vectors else np.empty(0, np.float32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * dim, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id_col, "embedding"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, embedding array<float>")


def page_texts(docs: DataFrame, body_chars: int | None = None) -> DataFrame:
    """(doc_id, text): what of a page is encoded: title, description and body, or the first ``body_chars``
    characters of it, for models that read no more."""
    part = lambda c: F.coalesce(c, F.lit(""))
    body = part("body") if body_chars is None else F.substring(part("body"), 1, body_chars)
    return docs.select("doc_id", F.concat_ws(" ", part("title"), part("description"), body).alias("text"))


def build(docs: DataFrame, vectors: DataFrame | None = None, *, dim: int = DEFAULTS.embedding_dim, body_chars: int | None = None) -> DataFrame:
    """``vectors`` and those of the pages that had none; null vectors are made anew."""
    texts = page_texts(docs, body_chars)
    if vectors is None:
        return encode(texts, "doc_id", "text", dim=dim)
    held = vectors.where(F.col("embedding").isNotNull())
    return held.select("doc_id", "embedding").unionByName(encode(texts.join(held, "doc_id", "left_anti"), "doc_id", "text", dim=dim))


def put(vectors: DataFrame, changed: DataFrame) -> DataFrame:
    """``vectors`` with those of ``changed`` in the place of the ones they had. Of several changes of one page the
    last by ``changed_at`` holds, if there is such a column, else the greatest vector; null vectors delete."""
    at = [F.col("changed_at")] if "changed_at" in changed.columns else []
    last = changed.groupBy("doc_id").agg(F.max_by("embedding", F.struct(*at, F.col("embedding"))).alias("embedding"))
    return vectors.join(last, "doc_id", "left_anti").select("doc_id", "embedding").unionByName(last.where("embedding is not null"))


def valid(vectors: DataFrame, dim: int) -> DataFrame:
    """Without vectors that are null, of another length, or that hold a null or something that is no number."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & whole)


def usual_length(vectors: DataFrame) -> int:
    """The length of most vectors; the greater of those equally frequent, 0 if there are none."""
    row = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    return row.n if row else 0


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int, *, query_id: str = "query_id", doc_id: str = "doc_id", dim: int | None = None) -> DataFrame:
    """(query_id, rank, doc_id, score): for each query vector the k vectors of greatest inner product.

    Exact. The stated query set is gathered in rounds of at most QUERY_BYTES and sent to all tasks once;
    each task multiplies it with the vectors it reads, block by block, and gives the k best it has met
    for each query, so the vectors never move. Vectors are taken to be of length 1; those that aren't
    ``valid`` are left out on both sides, with ``dim`` by default the usual length. Ties go by doc_id. No
    vectors give no rows.
    """
    dim = usual_length(vectors) if dim is None else dim
    asked = valid(queries.select(F.col(query_id).cast("long").alias("query_id"), "embedding"), dim)
    rows = valid(vectors.select(F.col(doc_id).cast("long").alias("doc_id"), "embedding"), dim)
    rounds = max(1, math.ceil(asked.count() * max(dim, 1) * 4 / QUERY_BYTES))
    out = None
    for r in range(rounds):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r) if rounds > 1 else asked
        table = some.toArrow().combine_chunks()  # of bounded size
        found = _nearest(rows, table["query_id"].combine_chunks().to_numpy(), _matrix(table["embedding"].combine_chunks(), dim) if dim else np.empty((0, 0), np.float32), k, dim)
        out = found if out is None else out.unionByName(found)
    return top(out, k)


def _nearest(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, dim: int, lists: np.ndarray | None = None) -> DataFrame:
    """The k best of each task and those that tie with the last, with rounded scores. With ``lists``, the numbers of the
    lists of each query, only vectors in them are compared with it."""
    known = vectors.sparkSession.sparkContext.broadcast((ids, queries, lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, lists = known.value
        q = q.astype(np.float64)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        least = np.full(len(q_ids), -np.inf)  # the k-th best so far
        held = 0

        def prune() -> None:
            nonlocal held
            if not held:
                return
            at, doc, score = (np.concatenate(c) for c in zip(*kept))
            order = np.lexsort((doc, -score, at))
            at, doc, score = at[order], doc[order], score[order]
            begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            size = np.diff(np.r_[begin, len(at)])
            full = size >= k
            least[at[begin[full]]] = score[begin[full] + k - 1]
            fine = score >= least[at]
            kept[:] = [(at[fine], doc[fine], score[fine])]
            held = int(fine.sum())

        for batch in batches:
            for lo in range(0, batch.num_rows if len(q_ids) else 0, BLOCK):
                some = batch.slice(lo, BLOCK)
                docs, v = some.column("doc_id").to_numpy(), _matrix(some.column("embedding"), dim).astype(np.float64)
                if lists is None:
                    parts = [(np.arange(len(q_ids)), slice(None))]
                else:
                    own = some.column("list").to_numpy()
                    parts = [(np.flatnonzero((lists == x).any(axis=1)), np.flatnonzero(own == x)) for x in np.unique(own)]
                for asking, these in parts:
                    for first in range(0, len(asking), QUERY_BLOCK):
                        who = asking[first : first + QUERY_BLOCK]
                        raw = q[who] @ v[these].T
                        score = np.copysign(np.floor(np.abs(raw) * 1e6 + 0.5) / 1e6, raw)
                        at, which = np.nonzero(score >= least[who, None])
                        kept.append((who[at], docs[these][which], score[at, which]))
                        held += len(at)
                        if held > 2_000_000:
                            prune()
                if kept:
                    prune()
        for at, doc, score in kept:
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(doc), pa.array(score)], ["query_id", "doc_id", "score"])

    columns = ["doc_id", "embedding"] if lists is None else ["list", "doc_id", "embedding"]
    return vectors.select(*columns).mapInArrow(run, "query_id long, doc_id long, score double")


#: Vectors that the lists of an inverted file are fitted on at most, lists at most, and rounds of the fit.
SAMPLE, MOST_LISTS, ROUNDS = 50_000, 4096, 12
#: Share of the ten nearest that an index must find by default, and vectors of the sample that this is measured with.
RECALL, MEASURED = 0.95, 200


@dataclass
class VectorIndex:
    """An inverted file: centroids, and ``rows`` (list, doc_id, embedding), written in order of the lists. Every valid
    vector is in it; vectors that aren't of the index's length are left out."""

    centroids: np.ndarray
    rows: DataFrame
    #: Lists to look at by default: so many hold RECALL of the nearest vectors, as measured on the sample.
    probes: int

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


def index_vectors(vectors: DataFrame, *, doc_id: str = "doc_id", dim: int | None = None, lists: int | None = None, sample: int = SAMPLE, seed: int = 1) -> VectorIndex:
    """Fits centroids on at most ``sample`` vectors, those of least hash of their id, on the driver, and puts every vector
    in the list of its nearest centroid. By default there are 2 * sqrt(n) lists of n vectors."""
    dim = usual_length(vectors) if dim is None else dim
    own = valid(vectors.select(F.col(doc_id).cast("long").alias("doc_id"), "embedding"), dim)
    some = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("embedding").toArrow().combine_chunks()
    x = _matrix(some["embedding"].combine_chunks(), dim) if len(some) else np.zeros((1, max(dim, 1)), np.float32)
    n = lists or min(MOST_LISTS, max(1, round(2 * math.sqrt(own.count()))))
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:n]]
    for _ in range(ROUNDS):
        near = _closest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    known = vectors.sparkSession.sparkContext.broadcast(c)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _closest(_matrix(batch.column(1), dim), known.value) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns], ["list", "doc_id", "embedding"])

    put_in = own.mapInArrow(assign, "list int, doc_id long, embedding array<float>")
    # ranges may cut a list, so a list that many vectors fall in is in several files
    asked = x[rng.permutation(len(x))[:MEASURED]]
    nearest = np.argsort(-(asked @ x.T), axis=1)[:, :10]
    order = np.argsort(np.argsort(-(asked @ c.T), axis=1), axis=1)  # the place of each list for each of them
    places = np.sort(np.take_along_axis(order, _closest(x, c)[nearest], axis=1).ravel())
    probes = int(places[min(len(places) - 1, math.ceil(RECALL * len(places)))]) + 1
    return VectorIndex(c, materialize(put_in.repartitionByRange("list", "doc_id").sortWithinPartitions("list"), "vector-index"), probes)


def _closest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[lo : lo + BLOCK] @ centroids.T).argmax(axis=1) for lo in range(0, len(x), BLOCK)]) if len(x) else np.empty(0, np.int64)


def approximate_top(queries: DataFrame, index: VectorIndex, k: int, *, probes: int | None = None, query_id: str = "query_id") -> DataFrame:
    """``cosine_top`` over the lists of each query's ``probes`` nearest centroids only, by default as many as the index
    asks for. With as many probes as lists it is exact."""
    asked = valid(queries.select(F.col(query_id).cast("long").alias("query_id"), "embedding"), index.dim)
    rounds = max(1, math.ceil(asked.count() * index.dim * 4 / QUERY_BYTES))
    out = None
    for r in range(rounds):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r) if rounds > 1 else asked
        table = some.toArrow().combine_chunks()  # of bounded size
        ids = table["query_id"].combine_chunks().to_numpy()
        q = _matrix(table["embedding"].combine_chunks(), index.dim) if len(ids) else np.empty((0, index.dim), np.float32)
        n = min(probes or index.probes, len(index.centroids))
        near = np.argpartition(-(q @ index.centroids.T), n - 1, axis=1)[:, :n] if len(ids) else np.empty((0, n), int)
        wanted = np.unique(near).tolist()
        rows = index.rows.where(F.col("list").isin(wanted)) if len(wanted) <= 1000 else index.rows
        found = _nearest(rows, ids, q, k, index.dim, near)
        out = found if out is None else out.unionByName(found)
    return top(out, k)


def semantic_search(similar: DataFrame, docs: DataFrame, *, domain: str | None = None, limit: int | None = 50, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, rank, doc_id, score) from the nearest pages (query_id, doc_id, score) of each query.

    The domain is looked at after the nearest pages are found, so fewer than ``limit`` may be left. The
    score is the cosine blended with the PageRank, divided by the greatest of the query's pages.
    """
    facts = docs.select("doc_id", "domain", F.coalesce("pagerank_score", F.lit(0.0)).alias("pr"))
    hits = similar.select("query_id", "doc_id", "score").join(facts, "doc_id")
    if domain:
        hits = hits.where(F.call_function("ilike", F.col("domain"), F.lit(f"%{domain}%")))
    # at most the nearest pages of one query
    most = F.max("pr").over(Window.partitionBy("query_id"))
    w = settings.semantic_pagerank_weight
    score = (1.0 - w) * F.col("score") + w * F.col("pr") / F.when(most == 0.0, 1.0).otherwise(most)
    return top(hits.select("query_id", "doc_id", rounded(score, 4).alias("score")), limit)
