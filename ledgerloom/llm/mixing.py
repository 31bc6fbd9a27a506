"""Mixing sources to target weights by Poisson replication, in DataFrame functions.

Each row of a source gets a number of copies drawn from a Poisson distribution whose
mean is the source's target repetition rate. The draw inverts the distribution at a
uniform number made from a hash of seed, id and draw, so any retry repeats it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._shared import fresh, written

#: A mean above this is drawn as a sum of independent Poisson numbers of equal means.
MAX_MEAN = 64.0
#: exp(-64) * 64**k / k! is below 1e-20 from here on; a sum that rounding keeps below u, under 2**-52 from 1, ends here.
MAX_COPIES = 192
#: With more sources their distributions are joined by a shuffle; as many take 8 MB at a mean of 1, 80 MB at most.
BROADCAST_SOURCES = 50_000
#: Partitions that rows with equal keys go to, at most.
SPREAD = 1024


def uniform(seed: int, *parts: Column) -> Column:
    """In [0, 1): the first 52 bits of an MD5 of seed and parts."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def cumulative(mean: Column) -> Column:
    """Cumulative probabilities of a Poisson distribution from 0 on, up to the first that no draw reaches."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("totals"))
    last = lambda s: F.element_at(s["totals"], -1)
    step = lambda s, j: F.when(
        last(s) < 1.0, F.struct((s["p"] * mean / j).alias("p"), F.concat(s["totals"], F.array(last(s) + s["p"] * mean / j)).alias("totals"))
    ).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_COPIES - 1)), start, step, lambda s: s["totals"])


def inverted(totals: Column, u: Column) -> Column:
    """The least k whose cumulative probability exceeds u."""
    return F.size(F.filter(totals, lambda t: t <= u))


def rates(df: DataFrame, weights: Mapping[str, float] | None, alpha: float, source_col: str, rows: float | None) -> tuple[DataFrame, int]:
    """source, rate (target weight / share of rows, times rows out / rows in) and the number of sources."""
    counts = written(df.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n")), "sources")
    if weights is None:
        weight = F.pow("n", F.lit(alpha))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("source")] if pairs else F.lit(None), F.lit(0.0))
    n, w, sources = counts.agg(F.sum("n"), F.sum(weight), F.count("*")).first()
    scale = (float(n) if rows is None else rows) / w if w else 0.0
    return counts.select("source", (weight * scale / F.col("n")).alias("rate")), sources


def mix_sources(
    df: DataFrame,
    weights: Mapping[str, float] | None = None,
    alpha: float = 0.5,
    seed: int = 17,
    rows: float | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """df's rows, each repeated by its Poisson count, in a global random order, with
    copy_no (from 0) and mix_key added, in place of columns so named.

    weights: target share of each source (those not named get none); without it the
    shares follow the source's rows to the power alpha. The expected number of rows is
    ``rows``, or that of df. A null source is a source. A row draws by its id, one
    without an id by a hash of its text, or by none if df has no text_col. Repeated rows
    draw alike. Whole texts are copied, null or empty alike. An empty table gives none.
    df should be read from files, as rows that are alike are dealt by their place in them.
    """
    source, parts, totals, copies, spread = fresh(df, "mix_source", "mix_parts", "mix_totals", "mix_copies", "mix_spread")
    known, sources = rates(df, weights, alpha, source_col, rows)
    share = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_MEAN).cast("int"))
    # Worked out once a source, not once a row.
    known = known.select(F.col("source").alias(source), share.alias(parts), cumulative(F.col("rate") / share).alias(totals))
    few = sources <= BROADCAST_SOURCES
    joined = df.join(F.broadcast(known) if few else known, df[source_col].eqNullSafe(F.col(source)), "left")
    # Places in a file are the same for a task that is tried again, those after a shuffle aren't.
    joined = joined if few else written(joined, "rated")
    text = F.xxhash64(text_col) if text_col in df.columns else F.lit(0)
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), text.cast("string")))
    draws = F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda i: inverted(F.col(totals), uniform(seed, own, i)))
    counted = joined.withColumn(copies, F.aggregate(draws, F.lit(0), lambda a, b: a + b)).where(F.col(copies) > 0)
    kept = [c for c in df.columns if c.lower() not in ("copy_no", "mix_key")]
    copied = counted.select(*kept, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias("copy_no"))
    keyed = copied.withColumn("mix_key", F.xxhash64(F.lit(seed), own, text, "copy_no"))
    # Rows that are alike in all these still go to many partitions.
    dealt = keyed.withColumn(spread, F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
    return dealt.repartition("mix_key", spread).sortWithinPartitions("mix_key").select(*kept, "copy_no", "mix_key")
