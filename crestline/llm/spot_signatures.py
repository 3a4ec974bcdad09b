"""Document fingerprints by spot signatures, with DataFrame functions only.

Where content words follow a common word, that word (the anchor) and the next content words make a
signature; boilerplate of few common words leaves few, running text leaves many.  A fingerprint is
the ordered set of a text's signatures.  Two fingerprints can be alike only as far as their lengths
are, so lengths are put into partitions whose neighbours alone can reach a wanted likeness, and
only sets that pass are intersected.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from crestline.llm.staging import staged

#: Common words of English, French, German, Spanish, Italian, Portuguese and Dutch that begin a chain.  Fixed values.
ANCHORS = (
    "a an and are as at be by for from had has have he her his in is it its not of on or that the their they this to was were which with you "
    "au aux ce dans des du elle en est et il la le les leur mais ne nous par pas plus pour que qui se son sur un une vous "
    "als auch auf aus bei das dem den der die ein eine einer es ich im ist mit nach nicht sich sie sind und von war wie zu "
    "al como con de del el ella ha hay lo los las mas no para pero por su sus y ya che di gli non per sono come della "
    "com da do dos ele ela mais nao não os uma het een niet van voor op te zijn"
).split()
#: Content words of a chain; hexadecimal digits of an md5 that stand for it.
CHAIN, DIGITS = 2, 15


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def signatures(text: Column, anchors: Sequence[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """Ordered distinct hashes (the first ``DIGITS`` digits of md5) of (anchor, next ``chain`` content words).

    Words are runs of letters and digits in lower case; content words are those that are no anchors.  The
    beginning of the text counts as an anchor, and a chain may end with the text, so every text with a
    content word has a signature.  Null has none.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    paired = let(words, lambda w: F.arrays_zip(w.alias("word"), F.concat(F.array(F.lit("")), w).alias("before")))
    content = F.filter(paired, lambda p: p["word"].isNotNull() & ~p["word"].isin(*anchors))

    def chained(c: Column) -> Column:
        later = [F.slice(c["word"], F.lit(k + 1), F.greatest(F.size(c) - k, F.lit(0))) for k in range(1, chain)]
        spots = F.arrays_zip(c["before"].alias("before"), c["word"].alias("w0"), *[x.alias(f"w{k}") for k, x in enumerate(later, 1)])
        joined = lambda p: F.concat_ws("|", p["before"], *[F.coalesce(p[f"w{k}"], F.lit("")) for k in range(chain)])
        hashed = lambda p: F.conv(F.substring(F.md5(joined(p)), 1, DIGITS), 16, 10).cast("long")
        return F.transform(F.filter(spots, lambda p: (p["before"] == "") | p["before"].isin(*anchors)), hashed)

    return F.sort_array(F.array_distinct(let(content, chained)))


def length_partition(n: Column, least: float) -> Column:
    """Partition of a set of n elements: sets with a Jaccard likeness of ``least`` lie in the same or in neighbouring ones."""
    return F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / -math.log(least) + 1e-9).cast("int")


def pruned_jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Share of common elements of two ordered sets; two empty sets are alike.

    With ``least``, null where lengths alone, or lengths and the ends of both sets, show that it is not reached.
    """
    m, n = F.size(a), F.size(b)
    apart = (m == 0) | (n == 0) | (F.element_at(a, -1) < F.element_at(b, 1)) | (F.element_at(b, -1) < F.element_at(a, 1))
    common = F.size(F.array_intersect(a, b)).cast("double")
    value = F.when((m == 0) & (n == 0), 1.0).when(F.when((m == 0) | (n == 0), True).otherwise(apart), 0.0).otherwise(common / (m + n - common))
    if not least:
        return value
    near = F.abs(length_partition(m, least) - length_partition(n, least)) <= 1
    return F.when(near & (F.least(m, n) >= least * F.greatest(m, n)), F.when(value >= least, value))


def successors(rows: DataFrame, order: Sequence[str], key: str) -> DataFrame:
    """Each row's ``key`` with the ``key`` of the next in ``order`` (``next``), the first after the last; ``key`` is one of ``order``.

    Rows are sorted by ranges; only the first row of each range goes to the task that links the ranges.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_r", F.spark_partition_id())
    ranged = staged(ranged, "ranges")
    within = Window.partitionBy("_r").orderBy(*order)
    linked = ranged.select(F.col(key), F.lead(key).over(within).alias("next"), "_r")
    heads = ranged.groupBy("_r").agg(F.min(F.struct(*order))[key].alias("head"))
    heads = heads.select("_r", F.coalesce(F.lead("head").over(Window.orderBy("_r")), F.first("head").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    return linked.join(heads, "_r").select(key, F.coalesce("next", "head").alias("next"))


def fingerprint(signs: Column) -> Column:
    """Signatures as text: ``DIGITS`` hexadecimal digits each, in order."""
    return F.array_join(F.transform(signs, lambda s: F.lpad(F.lower(F.hex(s)), DIGITS, "0")), "")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = 4) -> DataFrame:
    """One row per document: ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text has its last 1/``share`` code points replaced by as many of the next document's
    first (all, if it has fewer), by ascending key, nulls last, then by text hash; after the last comes
    the first.  A null text is empty; texts without content words have the empty fingerprint, and
    two of these are alike by 1.  Repeated rows of key and text are one document in this order and
    keep a row each; an empty table gives no rows; other columns are not read.

    Texts are shuffled once, by the hash of key and text; the order is made from keys and lengths.
    """
    named = docs.select(F.col(key).alias("d"), F.coalesce(text, F.lit("")).alias("t"))
    named = named.withColumn("h", F.xxhash64("t")).withColumn("k", F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("d").cast("string"), F.lit("")), "t"), 256)))
    light = named.groupBy("k").agg(F.first("d").alias("d"), F.first("h").alias("h"), F.first(F.length("t")).alias("n"))
    light = staged(light.withColumn("last", F.col("d").isNull()), "keys")
    after = successors(light.select("k", "d", "h", "last"), ["last", "d", "h", "k"], "k")
    # what a document owes to the one before it
    need = light.select("k", "d", F.floor(F.col("n") / share).cast("int").alias("need"))
    owed = after.join(need, "k").select(F.col("next").alias("k"), F.struct("k", "d", "need").alias("to"))
    # both joins read these columns and no others, so that they share one exchange of the texts
    texts = named.select("k", "t", signatures(F.col("t")).alias("s"))
    given = texts.join(owed, "k").select("to.*", F.substring("t", F.lit(1), F.col("to.need")).alias("given"), F.col("s").alias("next_s"))
    given = given.groupBy("k").agg(*[F.first(c).alias(c) for c in ("d", "given", "next_s", "need")])
    both = texts.join(given, "k").withColumn("n", F.length("t"))
    both = both.withColumn("edited", F.concat(F.substring("t", F.lit(1), F.col("n") - F.col("need")), "given"))
    both = both.withColumn("e", signatures(F.col("edited")))
    return both.select(
        F.col("d").alias(key), F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), fingerprint(F.col("s")).alias("fingerprint"),
        fingerprint(F.col("e")).alias("edited_fingerprint"), pruned_jaccard(F.col("s"), F.col("e")).alias("near_edited"), pruned_jaccard(F.col("s"), F.col("next_s")).alias("near_next"),
    )
