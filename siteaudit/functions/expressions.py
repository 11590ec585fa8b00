"""Column expressions that reports, summaries and comparisons share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, DoubleType, FloatType, IntegerType, LongType

#: Fixed values.
NOT_CRAWLED, INDEXABLE = "Not crawled", "Indexable"
REDIRECTED, CLIENT_ERROR, SERVER_ERROR = "Non-indexable: redirected", "Non-indexable: client error", "Non-indexable: server error"
NOINDEX, CANONICALISED = "Non-indexable: noindex", "Non-indexable: canonicalised"
GENERIC_ANCHORS = ("click here", "here", "read more", "more", "link", "this", "learn more", "find out more", "continue", "details", "go", "download", "click")
SHINGLE, BANDS, BAND_BITS, NEAR = 3, 8, 8, 7
TITLE_PIXELS, DESCRIPTION_PIXELS = 561, 985


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def directive(token: str, meta: Column, header: Column) -> Column:
    return F.lower(F.concat(F.coalesce(meta, F.lit("")), F.lit(" "), F.coalesce(header, F.lit("")))).contains(token)


def no_header(name: str, headers: Column) -> Column:
    return headers.isNull() | ~F.lower(headers).contains(f'"{name}"')


def is_html(content_type: Column) -> Column:
    return F.coalesce(content_type.ilike("text/html%"), F.lit(False))


def indexability(status: Column, meta: Column, header: Column, canonical_id: Column, url_id: Column) -> Column:
    """The ladder: the first rung that holds names the row."""
    return (
        F.when(status.isNull(), NOT_CRAWLED)
        .when(status.between(300, 399), REDIRECTED)
        .when(status.between(400, 499), CLIENT_ERROR)
        .when((status == 0) | (status >= 500), SERVER_ERROR)
        .when(directive("noindex", meta, header), NOINDEX)
        .when(canonical_id != url_id, CANONICALISED)
        .otherwise(INDEXABLE)
    )


def non_indexable(label: Column) -> Column:
    return ~label.isin(INDEXABLE, NOT_CRAWLED)


def status_ink(status: Column) -> Column:
    """How a status is shown: errors as critical, redirects as a warning."""
    return F.when((status == 0) | (status >= 400), "critical").when(status.between(300, 399), "warning")


def indexability_ink(label: Column) -> Column:
    return F.when(label != INDEXABLE, "critical")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhashes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash): the 64-bit SimHash of each text's three-word shingles, weighted by repeats;
    NULL for fewer words. Keys are unique. The votes are 64 sums over exploded shingles, which run
    as compiled code and are summed up in part before they are shuffled."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    cut = rows.select(F.col(key), words.alias("ws"))
    shingles = F.when(F.size("ws") >= SHINGLE, F.transform(F.sequence(F.lit(1), F.size("ws") - SHINGLE + 1), lambda i: F.concat_ws(" ", *[F.element_at("ws", i + k) for k in range(SHINGLE)])))
    # the outer form: the other's inferred filter would cut the words again for every shingle
    each = cut.select(key, F.explode_outer(shingles).alias("s")).select(key, F.conv(F.substring(F.sha2("s", 256), 1, 16), 16, -10).cast("bigint").alias("h"))
    bit = lambda b: F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1).cast("bigint"))
    voted = each.groupBy(key).agg(F.count("h").alias("n"), *[F.sum(bit(b)).alias(f"b{b}") for b in range(64)])
    ones = [F.when(F.col(f"b{b}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")) for b in range(64)]
    return voted.select(key, F.when(F.col("n") > 0, reduce(lambda a, b: a.bitwiseOR(b), ones)).alias("simhash"))


def bands(fingerprint: Column) -> Column:
    """(band, value) of all eight bands, low bits first."""
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(fingerprint, BAND_BITS * i).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int").alias("value")) for i in range(BANDS)])


def display(c: Column, kind: DataType) -> Column:
    """The text a report shows: whole doubles without a fraction, blobs as their first eight bytes
    in hex, NULL as NULL."""
    if isinstance(kind, BinaryType):
        return F.lower(F.hex(F.substring(c, 1, 8)))
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    if isinstance(kind, (IntegerType, LongType)):
        return c.cast("string")
    return c.cast("string")
