"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each shingle is hashed once: the first two hexadecimal digits of its MD5 are its bin, the
bin keeps its smallest hash, and of that the last digit (four bits) is stored. An empty
bin takes over another's (optimal densification): it probes the bins in a random order
of its own and takes the first that isn't empty, so that two documents with the same
bins take the same. Two unequal hashes agree in four bits once in sixteen times; the
likeness corrects for that.

The next document of ``edited`` is found without a global sort: quantiles of the ids cut
the table into buckets, each sorted by itself, and the first row of each bucket is also
dealt to the bucket before it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._shared import fresh, written

SHINGLE = 5
BINS = 256
#: Probes by 2-universal hashes of the bin; after them the smallest MD5 of both bins' numbers decides.
PROBES = 48
#: Chance that unequal hashes agree in their last four bits.
CHANCE = 1 / 16
#: Cuts of the ids, at most, and bytes of text between two cuts, if more than the cuts allow they are cut evenly.
QUANTILES, BUCKET_BYTES, MAX_BUCKETS = 4096, 4 << 20, 1 << 18
_LAST_ID = 2**63 - 1


def _probe(bin_no: Column, attempt: int) -> Column:
    """The bin that an empty one probes at an attempt."""
    digits = hashlib.md5(str(attempt).encode()).hexdigest()
    return (bin_no * F.lit(int(digits[:2], 16) | 1) + F.lit(int(digits[2:4], 16))).bitwiseAND(F.lit(BINS - 1))


def _array(numbers: list[int]) -> Column:
    """A literal array, small in the plan."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """MD5 of n consecutive words joined by a space; of the whole sequence if it is
    shorter; none without words."""

    def of(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
        hashes = F.transform(starts, lambda i: F.md5(F.concat_ws(" ", *(F.get(words, i + k) for k in range(n))).cast("binary")))
        return F.when(F.size(words) > 0, hashes).otherwise(F.array().cast("array<string>"))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _bound(words, of)


def _bound(value: Column, body) -> Column:
    """body(value), with value worked out once: lambda bodies would repeat it for each item."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprint(text: Column) -> Column:
    """Four bits for each bin, as array<tinyint>; empty for a text without words. Equal
    texts have equal fingerprints."""
    marks = F.split(F.lit(",".join(f"{j:02x}" for j in range(BINS))), ",")

    # A bin's mark stands before its hashes when sorted, so its smallest follows the mark.
    def lowest(ordered: Column) -> Column:
        at = F.filter(F.transform(ordered, lambda h, i: F.when(F.octet_length(h) == 2, i + 1)), lambda i: i.isNotNull())
        last = lambda h: F.when(F.octet_length(h) > 2, (F.instr(F.lit("0123456789abcdef"), F.substring(h, 32, 1)) - 1).cast("tinyint"))
        return F.transform(at, lambda i: last(F.get(ordered, i)))

    def filled(bits: Column) -> Column:
        def rest(j: Column) -> Column:
            ranks = F.transform(bits, lambda d, s: F.when(d.isNotNull(), F.struct(F.md5(F.concat_ws("~", j.cast("string"), s.cast("string")).cast("binary")).alias("rank"), d.alias("bits"))))
            return F.array_min(ranks)["bits"]

        return F.transform(bits, lambda d, j: F.coalesce(d, *(F.get(bits, _probe(j, t)) for t in range(PROBES)), rest(j)))

    def of(found: Column) -> Column:
        return F.when(F.size(found) > 0, _bound(_bound(F.sort_array(F.concat(marks, found)), lowest), filled)).otherwise(F.array().cast("array<tinyint>"))

    return _bound(shingles(text), of)


def printed(bits: Column) -> Column:
    """A fingerprint as a string, a hexadecimal digit for each bin."""
    return F.array_join(F.transform(bits, lambda b: F.substring(F.lit("0123456789abcdef"), b + 1, F.lit(1))), "")


def likeness(a: Column, b: Column) -> Column:
    """An estimate of the share of shingles that two texts have in common, from 0 to 1.
    Two texts without words are alike, one without is like no other."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    corrected = F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - F.lit(CHANCE)) / F.lit(1 - CHANCE))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(corrected)


class _Buckets:
    """Buckets that follow the order of (id, hash): by quantiles of the ids, cut evenly
    between two of them if need be, and by the hash within an id of several quantiles."""

    def __init__(self, ids: DataFrame, size: str):
        """ids: id, which isn't null, and its text's bytes."""
        total, cuts = ids.agg(F.sum(size), F.percentile_approx("id", [k / QUANTILES for k in range(QUANTILES + 1)], 10 * QUANTILES)).first()
        wanted = min(MAX_BUCKETS, max(64, (total or 0) // BUCKET_BYTES))
        cuts = (cuts or [0])[:: max(1, QUANTILES // wanted)]
        self.parts = -(-wanted // len(cuts))
        self.bounds = sorted(set(cuts))
        self.repeats = [cuts.count(b) for b in self.bounds] if len(self.bounds) < len(cuts) else [1] * len(cuts)

    def of(self, key: Column, digest: Column) -> Column:
        """Ascending with key and digest."""
        n = len(self.bounds)
        bounds = F.split(F.lit(",".join(map(str, self.bounds))), ",").cast("array<long>")
        repeats = _array(self.repeats)

        def below(bounds: Column) -> Column:
            """How many bounds are below the key, by bisection."""
            steps = [1 << k for k in reversed(range(n.bit_length()))]
            return F.aggregate(_array(steps), F.lit(0), lambda lo, step: F.when((lo + step <= n) & (F.get(bounds, lo + step - 1) < key), lo + step).otherwise(lo))

        def placed(slot: Column) -> Column:
            copies = F.coalesce(F.get(repeats, slot), F.lit(1))
            hot = (copies > 1) & (F.get(bounds, slot) == key)
            low, high = F.get(bounds, slot - 1).cast("double"), F.get(bounds, slot).cast("double")
            even = F.coalesce((key.cast("double") - low) / (high - low), F.lit(0.0)) * self.parts
            by_hash = (digest.cast("double") / F.lit(2.0**64) + 0.5) * (copies * self.parts)
            part = F.least(F.greatest(F.floor(F.when(hot, by_hash).otherwise(even)), F.lit(0)), F.when(hot, copies * self.parts - 1).otherwise(self.parts - 1))
            return (slot * 2 + hot.cast("int")).cast("long") * (1 << 40) + part

        return _bound(_bound(bounds, below), placed)


def edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, n_chars, text, edited, fingerprint, next_fingerprint.

    Edited is the text with its last n_chars // 2 code points replaced by the first as
    many (or all) of the next row in the order of ids, of texts' hashes within an id;
    the last is followed by the first. A null text is empty; a null id comes last. The
    only row follows itself. Other columns aren't read; an empty table gives none.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"key": F.coalesce(F.col("id").cast("long"), F.lit(_LAST_ID)), "digest": F.xxhash64("text")})
    buckets = _Buckets(rows.select(F.col("key").alias("id"), F.octet_length("text").alias("size")), "size")
    placed = rows.withColumn("bucket", buckets.of(F.col("key"), F.col("digest")))
    # At most two buckets for each of MAX_BUCKETS, so these rows have a bound: they are broadcast.
    heads = written(placed.groupBy("bucket").agg(F.min(F.struct("key", "digest")).alias("head")), "heads")
    before = F.coalesce(F.lag("bucket").over(Window.orderBy("bucket")), F.max("bucket").over(Window.partitionBy()))
    heads = heads.select("bucket", "head", before.alias("before"))
    dealt = placed.withColumn("fingerprint", fingerprint(F.col("text")))
    dealt = dealt.join(F.broadcast(heads), "bucket", "left")
    own, extra = (F.struct(F.col(c).alias("at"), F.lit(k).alias("extra")) for k, c in enumerate(("bucket", "before")))
    is_head = F.struct("key", "digest") == F.col("head")
    dealt = dealt.withColumn("to", F.explode(F.when(is_head, F.array(own, extra)).otherwise(F.array(own))))
    order = Window.partitionBy("to.at").orderBy("to.extra", "key", "digest")
    following = F.lead(F.struct("text", "fingerprint")).over(order)
    found = dealt.select("id", "text", "fingerprint", "to", following.alias("following")).where("to.extra = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    text = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("following.text"), F.lit(1), half))
    return found.select(F.col("id").alias(id_col), n.cast("long").alias("n_chars"), "text", text.alias("edited"), "fingerprint", F.col("following.fingerprint").alias("next_fingerprint"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df, with its columns and its fingerprint; a null text is empty."""
    (name,) = fresh(df, "fingerprint")
    return df.withColumn(name, fingerprint(F.col(text_col)))
