"""Problem 3: pages that hold nothing but keywords, links or product tags.

The rank-frequency curve of a page: its words by falling frequency, log frequency against log rank.
Windows over each page's counts give the ranks, sums over them the slope of the fitted line and the
residual spread around it. A third measure is the divergence from same-language prose of about the
same length: the Kullback-Leibler divergence of how often the page has each kind of word pair (known to
prose with content words, with function words only, unknown beside a function word, ...) from how
often prose of the language and length has it. Each measure, and the repetition among the anchors of
the links that leave a page, is compared with that of pages with prose, of the same language and
length; so far as there are few of those, with all. A page that is extreme in slope, residual or
divergence, or in its anchors, is a suspect. An exact check follows: a suspect is a case if it has at
most one real sentence and, besides, words enough that are no sentence.

Pages in languages without samples are compared by their curves, and their sentences are told by shape.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm import prose
from siftline.storage import materialize, table, without_copies

#: Deviations from prose, in robust standard deviations, at which a page is a suspect.
SLOPE_Z, SPREAD_Z, DIVERGENCE_Z, ANCHOR_Z = 5.0, 5.0, 10.0, 10.0
#: Pages with so many real sentences are prose: what the others are compared with.
PROSE_SENTENCES = 3
#: Real sentences that a case may have, and words besides them that it must have.
MOST_SENTENCES, LEAST_KEYWORDS = 1, 15
#: As many pages with prose of all languages and lengths are added to those of a language and length, which
#: smooths what few pages say.
PEERS = 30
#: Pairs of words of same-language prose that are added to those of each page, which smooths short pages.
PRIOR_PAIRS = 5
#: The least deviation that counts as a standard deviation of each measure.
LEAST_SIGMA = {"slope": 0.02, "spread": 0.02, "divergence": 0.005, "repetition": 0.02}

#: The accuracy of sketches of quantiles, and the share of values before and after a quantile, five times the
#: sketch's error, between which it is looked for.
SKETCH, MARGIN = 1000, 0.005

TOGETHER = 1000
_PAGE = pa.schema(
    [("lang", pa.string()), ("n_words", pa.int64()), ("n_real", pa.int64()), ("keywords", pa.int64()), ("kinds", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("types", pa.list_(pa.int32()))]
)


def page_words(texts: list[str | None], model: dict) -> list[tuple]:
    """For each text: its language, words, real sentences, words outside them, word pairs of each kind, and
    how many different words have each count. No language and no kinds in a language without samples."""
    s = prose.Sentences(texts, model)
    real = s.real()
    n = len(texts)
    words = np.bincount(s.owner, s.size, n).astype(int)
    n_real = np.bincount(s.owner, real, n).astype(int)
    real_words = np.bincount(s.owner, s.size * real, n).astype(int)
    kinds = np.stack([np.bincount(s.owner, s.kinds[:, k], n) for k in range(prose.KINDS)], axis=1).astype(int) if n else []
    langs = np.zeros((len(model["langs"]), n))
    for i in range(len(langs)):
        langs[i] = np.bincount(s.owner, s.known[i], n)
    out = []
    for k in range(n):
        lang = model["langs"][int(langs[:, k].argmax())] if len(langs) and langs[:, k].any() else None
        counted = Counter(s.tokens[k])
        for mark in prose.MARKS:
            counted.pop(mark, None)
        spectrum = Counter(counted.values())
        own = (int(n_real[k]), int(words[k] - real_words[k]), kinds[k].tolist())
        if prose.may_be_foreign(texts[k], own[0]) and (lines := prose.foreign(texts[k], model)):
            lang, own = None, (sum(c for c, _ in lines), max(0, int(words[k]) - sum(w for _, w in lines)), None)
        out.append((lang, int(words[k]), *own, list(spectrum), list(spectrum.values())))
    return out


def profiles(pages: DataFrame, id_col: str, url_col: str, text_col: str, samples: DataFrame) -> DataFrame:
    """(id, url, lang, n_words, n_real, keywords, kinds, counts, types): the words of each page."""
    known = pages.sparkSession.sparkContext.broadcast(prose.load(samples))
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(lo, TOGETHER)
                rows = page_words(some.column(2).to_pylist(), known.value)
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _PAGE)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *columns], ["id", "url", *_PAGE.names])

    rows = without_copies(pages.select(id_col, url_col, text_col), id_col)
    return rows.mapInArrow(
        run, f"id {kind}, url string, lang string, n_words long, n_real long, keywords long, kinds array<long>, counts array<int>, types array<int>"
    )


def curves(pages: DataFrame) -> DataFrame:
    """(id, slope, spread): the line through each page's rank-frequency curve. Words with the same
    count share their mean rank and weigh as many. Null for pages whose words all have one count."""
    steps = pages.select("id", F.explode(F.arrays_zip("counts", "types")).alias("s")).select("id", "s.counts", F.col("s.types").cast("double").alias("w"))
    falling = Window.partitionBy("id").orderBy(F.col("counts").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = steps.withColumn("upto", F.sum("w").over(falling))
    x, y, w = F.log(F.col("upto") - (F.col("w") - 1) / 2), F.log("counts"), F.col("w")
    sums = ranked.groupBy("id").agg(
        F.sum(w).alias("n"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * x * y).alias("xy"), F.sum(w * y * y).alias("yy")
    )
    c = F.col
    var_x = c("n") * c("xx") - c("x") * c("x")
    cov = c("n") * c("xy") - c("x") * c("y")
    fitted = sums.withColumn("slope", F.when(var_x > 1e-9, cov / var_x))
    error = (c("yy") - c("y") * c("y") / c("n") - c("slope") * cov / c("n")) / c("n")
    return fitted.select("id", "slope", F.sqrt(F.greatest(error, F.lit(0.0))).alias("spread"))


def anchor_repetition(links: DataFrame) -> DataFrame:
    """(url, repetition): of the pages that links leave, the share of their links whose anchor another of
    their links has too. Anchors are counted per page first, so a page with very many links costs
    one row per anchor and task. Null and blank anchors don't count; links repeated with the same
    target and anchor count once."""
    anchors = links.select("source_url", "target_url", F.lower(F.trim("anchor_text")).alias("a")).where("a <> '' and source_url is not null").distinct()
    per = anchors.groupBy("source_url", "a").agg(F.count("*").alias("n"))
    sums = per.groupBy(F.col("source_url").alias("url")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    return sums.select("url", (1 - F.col("kinds") / F.col("n")).alias("repetition"))


MEASURES = ["slope", "spread", "divergence", "repetition"]


def blended(pages: DataFrame, own: DataFrame, everywhere: DataFrame, columns: list[str]) -> DataFrame:
    """``pages`` with each of ``columns`` from ``own`` (l, b, n, columns), the row of the page's language and
    length, and from the one row ``everywhere``, weighing as much as PEERS pages. Both are as many rows as
    languages times lengths, and are broadcast."""
    own = own.select("l", "b", F.col("n").alias("__n"), *[F.col(c).alias(f"__own_{c}") for c in columns])
    everywhere = everywhere.select(*[F.col(c).alias(f"__all_{c}") for c in columns])
    both = pages.join(F.broadcast(own), pages.lang.eqNullSafe(F.col("l")) & (pages.bin == F.col("b")), "left").crossJoin(F.broadcast(everywhere))

    def blend(c: str) -> Column:
        weigh = lambda x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise((F.col("__n") * x + PEERS * y) / (F.col("__n") + PEERS))
        # where own is null, all of everywhere
        return F.coalesce(F.zip_with(F.coalesce(f"__own_{c}", F.array_repeat(F.lit(None).cast("double"), F.size(f"__all_{c}"))), F.col(f"__all_{c}"), weigh), F.col(f"__own_{c}")).alias(c)

    return both.select(*pages.columns, *[blend(c) for c in columns])


def quantiles(df: DataFrame, keys: list[str], measures: list[str], shares: list[float]) -> DataFrame:
    """(keys, n, q_ of each measure): the rows of each group, which may have null keys, and, of its values of a measure
    that aren't null, those at the places ceil(share * values), the least being 1; null if there are none.

    They are exact. A sketch of all rows gives limits MARGIN of the values before and after each place; the values
    between them are counted and sorted, those before counted only. The result is one row a group, and is written.
    """
    k = len(shares)
    around = [min(1.0, max(0.0, s + d)) for s in shares for d in (-MARGIN, MARGIN)]
    sketches = [x for m in measures for x in (F.count(m).alias(f"n_{m}"), F.percentile_approx(m, F.array(*map(F.lit, around)), SKETCH).alias(f"r_{m}"))]
    rough = materialize(df.groupBy(*keys).agg(F.count("*").alias("n"), *sketches), "rough-quantiles")
    same = lambda other: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(other[f"__{c}"]) for c in keys])
    limits = rough.select(*[F.col(c).alias(f"__{c}") for c in keys], *[c for m in measures for c in (f"n_{m}", f"r_{m}")])
    marks = []
    for j, m in enumerate(measures):
        for i, share in enumerate(shares):
            low, high = F.col(f"r_{m}")[2 * i], F.col(f"r_{m}")[2 * i + 1]
            place = F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(share) * F.col(f"n_{m}")))
            mark = F.struct(F.lit(j * k + i).alias("q"), place.alias("place"), F.when(F.col(m) >= low, F.col(m)).alias("value"))
            marks.append(F.when((low < high) & (F.col(m) <= high), mark))
    near = df.join(F.broadcast(limits), same(limits)).select(*keys, F.explode(F.array(*marks)).alias("mark")).where("mark is not null").select(*keys, "mark.*")
    counted = near.groupBy(*keys, "q", "place", "value").agg(F.count("*").alias("c"))
    # values before the limits are null, which comes first
    upto = F.sum("c").over(Window.partitionBy(*keys, "q").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = counted.withColumn("upto", upto).where("upto >= place").groupBy(*keys, "q").agg(F.min("value").alias("value"))
    found = found.groupBy(*[F.col(c).alias(f"__{c}") for c in keys]).agg(F.map_from_entries(F.collect_list(F.struct("q", "value"))).alias("found"))
    # where both limits are one value, it is that
    at = lambda m, j, i: F.coalesce(F.col("found")[j * k + i], F.col(f"r_{m}")[2 * i])
    each = [F.when(F.col(f"n_{m}") > 0, F.array(*[at(m, j, i) for i in range(k)])).alias(f"q_{m}") for j, m in enumerate(measures)]
    return materialize(rough.join(F.broadcast(found), same(found), "left").select(*keys, "n", *each), "quantiles")


def compared(pages: DataFrame) -> DataFrame:
    """``pages`` with divergence and z_ columns: how far each measure is from that of prose of the language and length."""
    pages = pages.withColumn("bin", F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int"))
    groups = [F.col("lang").alias("l"), F.col("bin").alias("b")]
    prose_pages = lambda df: df.where(F.col("n_real") >= PROSE_SENTENCES)
    each = range(prose.KINDS)
    shares = F.array(*[(F.coalesce(F.sum(F.col("kinds")[k]), F.lit(0)) + 1.0) / (F.coalesce(F.sum(F.aggregate("kinds", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)) + prose.KINDS) for k in each]).alias("usual")
    with_kinds = prose_pages(pages).where("kinds is not null")
    pages = blended(pages, with_kinds.groupBy(*groups).agg(F.count("*").alias("n"), shares), with_kinds.agg(shares), ["usual"])
    total = F.aggregate("kinds", F.lit(0).cast("long"), lambda a, x: a + x)
    p = [F.col("usual")[k] for k in each]
    q = [(F.col("kinds")[k] + PRIOR_PAIRS * p[k]) / (total + PRIOR_PAIRS) for k in each]
    divergence = reduce(lambda a, b: a + b, [q[k] * F.log(q[k] / p[k]) for k in each])
    pages = pages.withColumn("divergence", divergence).drop("kinds", "usual")
    # each page counts in the group of its language and length, and in that of all
    own, everyone = F.struct(*groups, F.lit(False).alias("all")), F.struct(F.lit(None).cast("string").alias("l"), F.lit(None).cast("int").alias("b"), F.lit(True).alias("all"))
    peers = prose_pages(pages).select(F.explode(F.array(own, everyone)).alias("group"), *MEASURES).select("group.*", *MEASURES)
    quartiles = quantiles(peers, ["l", "b", "all"], MEASURES, [0.25, 0.5, 0.75])
    columns = [f"q_{m}" for m in MEASURES]
    pages = blended(pages, quartiles.where("not all"), quartiles.where("all").agg(*[F.first(c).alias(c) for c in columns]), columns)

    def z(m: str) -> Column:
        q = F.col(f"q_{m}")
        return F.coalesce((F.col(m) - q[1]) / F.greatest((q[2] - q[0]) / 1.349, F.lit(LEAST_SIGMA[m])), F.lit(0.0)).alias(f"z_{m}")

    return pages.select(*[c for c in pages.columns if not c.startswith("q_")], *[z(m) for m in MEASURES])


def judged_pages(pages: DataFrame, id_col: str, url_col: str, text_col: str, links: DataFrame, samples: DataFrame) -> DataFrame:
    """(id_col, lang, n_words, n_real, keywords, slope, spread, divergence, repetition, z_ of each, suspect,
    found): one row per value of ``id_col``.

    ``links`` has source_url, target_url and anchor_text; ``samples`` has sample_id, lang and text of
    graded prose. Null, empty and wordless texts have no curve and are never found. Rows delivered
    twice count once; a null id is a value like others. Where no page has prose, or samples are empty,
    nothing can be compared: the z_ columns are 0 and nothing is found.
    """
    own = materialize(profiles(pages, id_col, url_col, text_col, samples), "page-words")
    c = curves(own).withColumnRenamed("id", "__id")
    measured = own.drop("counts", "types").join(c, own.id.eqNullSafe(c["__id"]), "left").drop("__id")
    z = compared(materialize(measured.join(anchor_repetition(links), "url", "left").drop("url"), "page-measures"))
    suspect = (F.abs("z_slope") >= SLOPE_Z) | (F.col("z_spread") >= SPREAD_Z) | (F.col("z_divergence") >= DIVERGENCE_Z) | (F.col("z_repetition") >= ANCHOR_Z)
    found = suspect & (F.col("n_real") <= MOST_SENTENCES) & (F.col("keywords") >= LEAST_KEYWORDS)
    return z.drop("bin").withColumns({"suspect": suspect, "found": found}).withColumnRenamed("id", id_col)


def of_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_pages(table(spark, sf_dir, "docs"), "doc_id", "url", "body", table(spark, sf_dir, "links"), table(spark, sf_dir, "reading_samples"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id) of the pages of docs that hold nothing but keywords, links or product tags."""
    return of_docs(spark, sf_dir).where("found").select("doc_id")


def p3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every page of docs."""
    rounded = ["slope", "spread", "divergence", "repetition", *[f"z_{m}" for m in MEASURES]]
    return of_docs(spark, sf_dir).withColumns({c: F.round(c, 6) for c in rounded})
