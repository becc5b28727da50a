"""Document fingerprints by I-Match with randomised lexicons.

Terms of a text count only if their inverse document frequency lies in a band; the distinct
ones are sorted and hashed. One such hash breaks with the first changed term, so a
fingerprint also hashes what falls into randomised subsets of the lexicon. The subsets of
level l keep one term in 2 ** l each; a text uses the two levels at which a subset holds
about one of its terms, so texts of any length get subsets that survive small changes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelmill.session import stored

_SUBSETS = 24
_LEVEL_MAX = 30
#: Stands among the words of every text, so that texts without a term in the band stay.
_MARK = ""


def words_of(text: Column) -> Column:
    """Distinct lower-cased words of a text, and the mark."""
    return F.array_distinct(F.concat(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), F.array(F.lit(_MARK))))


def lexicon(docs: DataFrame, text_col: str = "text", low_share: float = 0.002, high_share: float = 0.05) -> DataFrame:
    """(term, df): hashes of terms found in `low_share` to `high_share` of all rows, and in two at least.

    The band of document frequencies is one of inverse document frequencies, from
    -log(high_share) to -log(low_share). A term of the band takes up low_share * rows
    occurrences at least, so there are at most (mean distinct terms of a text) / low_share
    of them, however many rows there are.
    """
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    count = rows.count()
    terms = rows.select(F.explode(words_of(F.col("text"))).alias("word")).where(F.col("word") != _MARK)
    counted = terms.groupBy(F.xxhash64("word").alias("term")).agg(F.count("*").alias("df"))
    return counted.where((F.col("df") >= max(2.0, low_share * count)) & (F.col("df") <= max(2.0, high_share * count)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def cells_of(terms: Column) -> Column:
    """"level.subset=hash" for each used subset that holds a term; `terms` are distinct and sorted."""
    level = F.when(F.size(terms) > 0, F.least(F.lit(_LEVEL_MAX), F.round(F.log2(F.size(terms).cast("double"))).cast("int"))).otherwise(0)

    def numbered(number: Column) -> Column:
        return F.struct(number.alias("level"), (F.call_function("shiftleft", F.lit(1).cast("long"), number) - 1).alias("mask"))

    def of_level(at: Column) -> Column:
        subset = lambda t: F.shiftrightunsigned(t, 7).bitwiseAND(at["mask"])
        kept = F.filter(F.transform(terms, lambda t: F.struct(subset(t).alias("s"), t.alias("t"))), lambda x: x["s"] < _SUBSETS)

        def hashed(kept: Column) -> Column:
            used = F.array_sort(F.array_distinct(F.transform(kept, lambda x: x["s"])))
            own = lambda s: F.transform(F.filter(kept, lambda x: x["s"] == s), lambda x: x["t"])
            return F.transform(used, lambda s: F.concat(at["level"].cast("string"), F.lit("."), s.cast("string"), F.lit("="), F.substring(F.hex(F.xxhash64(own(s))), 1, 10)))

        return _let(kept, hashed)

    return _let(level, lambda n: F.flatten(F.transform(F.array(numbered(n), numbered(n + 1)), of_level)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subset hashes, among subsets of common levels that either text uses; 0 to 1."""
    level = lambda c: F.substring_index(c, ".", 1)
    common = F.array_intersect(F.transform(a, level), F.transform(b, level))
    in_common = lambda cells: F.filter(cells, lambda c: F.array_contains(common, level(c)))
    name = lambda c: F.substring_index(c, "=", 1)
    either = F.size(F.array_union(F.transform(in_common(a), name), F.transform(in_common(b), name)))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)


def _bucket(ids: Column, bounds: list[int]) -> tuple[Column, Column]:
    """Number of the last bound up to an id, by two short scans, and whether the id is that bound."""
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.size(F.filter(F.array(*[F.lit(g[0]).cast("long") for g in groups]), lambda x: x <= ids))
    fine = F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups]), F.greatest(coarse, F.lit(1)))
    inside = F.size(F.filter(fine, lambda x: x <= ids))
    return F.greatest(F.lit(0), (coarse - 1) * step + inside - 1), F.element_at(fine, F.greatest(inside, F.lit(1))) == ids


def neighbours(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int, max_buckets: int) -> tuple[DataFrame, int]:
    """(bucket, id, text, ghost): rows dealt into ranges of ids, each with the first row of the next range as a ghost.

    A window over a bucket then sees for each of its rows the row that follows in the whole
    table; the last bucket's ghost is the first row of all.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("id").alias("first")).first()
    if size["first"] is None:
        return rows.select(F.lit(0).alias("bucket"), "doc_id", "id", "text", F.lit(False).alias("ghost")), 1
    count = max(1, min(max_buckets, -(-(size["bytes"] or 0) // bucket_bytes)))
    cuts = rows.agg(F.percentile_approx("id", [i / count for i in range(1, count)] or [0.5], max(10_000, 20 * count)).alias("cuts")).first()["cuts"]
    bounds = sorted({size["first"], *(cuts if count > 1 else [])})
    bucket, is_bound = _bucket(F.col("id"), bounds)
    placed = rows.withColumn("bucket", bucket)
    # A bound is an id of the table: the first of its bucket, so the next of the bucket before.
    twice = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost")), F.struct(F.pmod(F.col("bucket") - 1, F.lit(len(bounds))).alias("bucket"), F.lit(True).alias("ghost")))
    once = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost")))
    return placed.withColumn("at", F.explode(F.when(is_bound, twice).otherwise(once))).select("at.bucket", "doc_id", "id", "text", "at.ghost"), len(bounds)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low_share: float = 0.002, high_share: float = 0.05, bucket_bytes: int = 4_000_000, max_buckets: int = 100_000,
) -> DataFrame:
    """Fingerprint of each text and of its edited form, and how alike fingerprints are.

    The edited form has its last quarter of code points replaced by the first as many of the
    row that follows by id (the first row follows the last). Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint is the hash of all band terms, then those of the used subsets. Null texts
    are empty, texts without a band term have the hash of the lower-cased text for one; rows of
    equal id follow one another by text, null ids come first, an empty table gives an empty
    result.
    """
    # Bounded by mean distinct terms / low_share rows: see `lexicon`.
    known = stored(lexicon(docs, text_col, low_share, high_share), "lexicon").select("term")
    marked = known.unionByName(docs.sparkSession.range(1).select(F.xxhash64(F.lit(_MARK)).alias("term")))
    placed, _ = neighbours(docs, id_col, text_col, bucket_bytes, max_buckets)
    order = Window.partitionBy("bucket").orderBy("ghost", "id", "text")
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - quarter).cast("int")), F.substring(F.col("next"), F.lit(1), quarter))
    rows = (
        placed.withColumn("next", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))
        .withColumn("edited", F.when(~F.col("ghost"), F.coalesce(edited, F.col("text"))).otherwise(""))
        .select(
            "bucket", "place", "ghost", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("form"),
        )
    )
    terms = rows.select(
        "bucket", "place", "ghost", "doc_id", "n_chars", "edited_sha256", F.col("form.which").alias("which"), F.xxhash64(F.lower("form.t")).alias("plain"),
        F.explode(words_of(F.col("form.t"))).alias("word"),
    ).withColumn("term", F.xxhash64("word"))
    # What a row says of its text is carried by its mark alone.
    of_mark = lambda c: F.when(F.col("word") == _MARK, c)
    found = terms.join(F.broadcast(marked), "term").select(
        "bucket", "place", "which", F.when(F.col("word") != _MARK, F.col("term")).alias("term"), of_mark(F.col("plain")).alias("plain"),
        of_mark(F.struct("ghost", "doc_id", "n_chars", "edited_sha256")).alias("about"),
    )
    of = lambda which, c: F.when(F.col("which") == which, F.col(c))
    # A bucket's rows are together already, so this grouping moves nothing.
    grouped = found.groupBy("bucket", "place").agg(
        F.sort_array(F.collect_list(of(0, "term"))).alias("own"), F.sort_array(F.collect_list(of(1, "term"))).alias("other"),
        F.max(of(0, "plain")).alias("own_plain"), F.max(of(1, "plain")).alias("other_plain"), F.max(of(0, "about")).alias("about"),
    )
    base = lambda t, plain: F.when(F.size(t) > 0, F.concat(F.lit("terms:"), F.hex(F.xxhash64(t)))).otherwise(F.concat(F.lit("text:"), F.hex(plain)))
    print_of = lambda t, plain: F.concat(F.array(base(F.col(t), F.col(plain))), cells_of(F.col(t)))
    printed = grouped.select("bucket", "place", "about", print_of("own", "own_plain").alias("own"), print_of("other", "other_plain").alias("other"))
    follows = printed.withColumn("next", F.coalesce(F.lead("own").over(Window.partitionBy("bucket").orderBy("place")), F.col("own")))

    def near(a: str, b: str) -> Column:
        rest = lambda c: F.slice(F.col(c), 2, F.greatest(F.size(c) - 1, F.lit(1)))
        return F.when(F.col(a)[0] == F.col(b)[0], 1.0).otherwise(likeness(rest(a), rest(b)))

    return follows.where(~F.col("about.ghost")).select(
        "about.doc_id", "about.n_chars", "about.edited_sha256", F.array_join("own", ",").alias("fingerprint"), F.array_join("other", ",").alias("edited_fingerprint"),
        near("own", "other").alias("near_edited"), near("own", "next").alias("near_next"),
    )


def op3_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited forms."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
