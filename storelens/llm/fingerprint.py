"""Document fingerprints by one-permutation MinHash (operator 7, DataFrame operations only).

Every five-word shingle is hashed once; the top bits choose one of ``BINS``
bins and each bin keeps its smallest hash. An empty bin copies the first
non-empty bin of its own fixed pseudo-random probe sequence (optimal
densification: all empty bins draw independently). ``BITS`` low-order bits of
each bin's hash are stored, one hex digit per bin. The share of equal digits, corrected for
chance agreement, estimates the Jaccard similarity of the shingle sets.

Words are `[^\\x20\\x09-\\x0D]+` of the lower-cased text; fewer than five words
make one shingle. Nothing is shuffled to make fingerprints.

Defined results: null and empty texts, and texts without words, have the empty
fingerprint; two empty ones have likeness 1, an empty one and another 0; equal
texts have equal fingerprints; repeated rows get the same one each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storelens.llm.common import table

BINS = 256
BITS = 4
WORDS = 5
#: (multiplier, offset) of the first probes of an empty bin, modulo a prime; then all bins in hashed order
_PRIME = 65_537
PROBES = [(pow(75, 2 * t + 3, _PRIME), pow(75, 5 * t + 11, _PRIME)) for t in range(8)]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column) -> Column:
    """Hashes of the text's five-word shingles (with repeats), array<bigint>."""
    words = F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+", -1), "")

    def hashes(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - WORDS),
                           lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WORDS)]))
        return (F.when(F.size(w) >= WORDS, many)
                .when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "), F.size(w))))
                .otherwise(F.array().cast("array<bigint>")))

    return _let(words, hashes)


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BINS.bit_length() + 1).cast("int") + BINS // 2


def _least(sorted_hashes: Column) -> Column:
    """The smallest hash of every non-empty bin, in bin order."""
    return F.filter(sorted_hashes, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(sorted_hashes, i - 1))))


def _densified(least: Column) -> Column:
    """``BINS`` low-bit values from the non-empty bins (array<tinyint>); empty stays empty."""
    none = F.lit(None).cast("bigint")

    def spread(f: Column) -> Column:
        gaps = F.flatten(F.transform(f, lambda x, j: F.concat(
            F.array_repeat(none, _bin(x) - F.when(j == 0, -1).otherwise(_bin(F.get(f, j - 1))) - 1), F.array(x))))
        return F.concat(gaps, F.array_repeat(none, BINS - 1 - _bin(F.element_at(f, -1))))

    def fill(b: Column) -> Column:
        def one(i: Column) -> Column:
            probes = [F.get(b, ((i * m + c) % _PRIME % BINS).cast("int")) for m, c in PROBES]
            rest = F.array_min(F.transform(least, lambda x: F.struct(F.xxhash64(i, _bin(x)).alias("p"), x.alias("x"))))["x"]
            # ten low digits in turn, so that copies of one hash in many bins agree by chance independently
            x = F.call_function("shiftrightunsigned", F.coalesce(F.get(b, i), *probes, rest), i % 10 * BITS)
            return x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("tinyint")
        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), one)

    return F.when(F.size(least) > 0, _let(spread(least), fill)).otherwise(F.array().cast("array<tinyint>"))


def with_digits(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add column ``out``: the fingerprint as array<tinyint>, one low-bit value per bin."""
    return (df.withColumn("_h", shingle_hashes(F.col(text_col)))
            .withColumn("_h", F.sort_array("_h"))
            .withColumn("_h", _least(F.col("_h")))
            .withColumn(out, _densified(F.col("_h"))).drop("_h"))


def packed(digits: Column) -> Column:
    """The fingerprint as hex text, BITS bits per bin."""
    return F.array_join(F.transform(digits, lambda d: F.substring(F.lit("0123456789abcdef"), d.cast("int") + 1, 1)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two digit arrays, corrected for agreement by chance."""
    chance = 1.0 / (1 << BITS)
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return (F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double"))
            .otherwise(F.greatest(F.lit(0.0), (same / float(BINS) - chance) / (1 - chance))))


def _below(bounds: list[int], value: Column, equal: bool) -> Column:
    """How many of the sorted bounds are less than (or equal to) a value, by binary search."""
    arr = F.expr(f"cast(split('{','.join(map(str, bounds))}', ',') as array<bigint>)") if bounds else F.array().cast("array<bigint>")
    steps = [1 << k for k in range(len(bounds).bit_length(), -1, -1)]
    fits = (lambda x: x <= value) if equal else (lambda x: x < value)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(
        (at + s <= len(bounds)) & fits(F.get(arr, at + s - 1)), at + s).otherwise(at))


def with_next(docs: DataFrame, carry: list[str], id_col: str = "doc_id", tie: str = "_tie") -> DataFrame:
    """Each row with ``next_<c>`` of the next row in descending id order; after the last comes the first.

    Rows are dealt once, into ranges of ids between approximate quantiles; a
    much repeated id spreads over its quantiles by ``tie``. Each range also gets
    the first row of the range after it, so that no row needs a second exchange.
    Null ids come last.
    """
    n = max(1, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    shares = ",".join(str(i / n) for i in range(1, n)) or "0.5"
    cuts = docs.select(key.alias("k")).agg(F.expr(f"percentile_approx(k, array({shares}), {50 * n})").alias("q")).first().q or []
    if n == 1:
        cuts = []
    lo, hi = _below(cuts, F.col("_key"), False), _below(cuts, F.col("_key"), True)
    spread = F.floor((hi - lo + 1) * (F.shiftrightunsigned(tie, 1).cast("double") / float(1 << 63))).cast("int")
    rows = docs.withColumn("_key", key).withColumn("_range", lo + F.least(F.greatest(spread, F.lit(0)), hi - lo))
    rank = F.struct(F.col(id_col).isNotNull().alias("a"), F.col("_key").alias("b"),
                    F.shiftrightunsigned(tie, 1).alias("c"), F.col(tie).alias("d"))
    # a range's first row also goes to the range above it, the topmost one to the lowest range; one row per range
    heads = rows.select("_range", rank.alias("r")).groupBy("_range").agg(F.max("r").alias("r"))
    above = F.coalesce(F.lead("_range").over(Window.orderBy("_range")), F.min("_range").over(Window.partitionBy()))
    extra = F.broadcast(heads.select(F.col("r.b").alias("_hk"), F.col("r.d").alias("_hd"), above.alias("_to")))
    dealt = (rows.join(extra, (F.col("_key") == F.col("_hk")) & (F.col(tie) == F.col("_hd")), "left")
             .withColumn("_copy", F.explode(F.when(F.col("_to").isNull(), F.array(F.lit(False)))
                                            .otherwise(F.array(F.lit(False), F.lit(True)))))
             .withColumn("_range", F.when(F.col("_copy"), F.col("_to")).otherwise(F.col("_range"))))
    w = Window.partitionBy("_range").orderBy("_copy", F.col(id_col).desc_nulls_last(),
                                             F.shiftrightunsigned(tie, 1).desc(), F.col(tie).desc())
    return (dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry])
            .where(~F.col("_copy")).select(*docs.columns, *[f"next_{c}" for c in carry]))


def op7_oph_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    docs = docs.withColumn("_tie", F.xxhash64("body"))
    found = with_next(with_digits(docs, "body", "digits"), ["body", "digits"])
    k = F.floor(F.length("body") / 3).cast("int")
    found = found.withColumn("edited", F.concat(F.expr("substring(body, 1, length(body) - cast(floor(length(body) / 3) as int))"),
                                                F.substring(F.col("next_body"), F.lit(1), k)))
    found = found.select("doc_id", F.length("body").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                         "digits", "next_digits", "edited")
    found = with_digits(found, "edited", "edited_digits")
    return found.select("doc_id", "n_chars", "edited_sha256", packed(F.col("digits")).alias("fingerprint"),
                        packed(F.col("edited_digits")).alias("edited_fingerprint"),
                        likeness(F.col("digits"), F.col("edited_digits")).alias("near_edited"),
                        likeness(F.col("digits"), F.col("next_digits")).alias("near_next"))
