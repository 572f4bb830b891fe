"""Document fingerprints by winnowing, in built-in functions only.

A token is a run of up to 16 letters, a run of up to 16 digits, or a run of up to 16
other characters that are no blanks. A gram is ``gram`` consecutive tokens, hashed; of
every ``window`` consecutive grams the one with the least hash is kept, the
rightmost of equals, together with its position. Two texts that share ``gram +
window - 1`` tokens therefore share a kept gram, and kept positions are at most
``window`` apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import written
from tablelens.plans.arranged import PART, Arranged

GRAM, WINDOW = 4, 8
TOKEN = r"[\p{L}\p{M}]{1,16}|\p{N}{1,16}|[^\s\p{L}\p{M}\p{N}]{1,16}"
#: Bits for the position of a gram; positions are counted modulo their range.
_PLACE_BITS = 24
_PLACES = (1 << _PLACE_BITS) - 1
_NO_ID = -(2**63)


def _stage(rows: DataFrame, name: str, column: Column) -> DataFrame:
    """``rows`` with a column that is computed once. The explode keeps the optimizer
    from putting its expression into every use, which may be inside a lambda."""
    return rows.select("*", F.explode(F.array(column)).alias(name))


def kept_grams(
    rows: DataFrame, text: str, grams: str = "grams", gram: int = GRAM, window: int = WINDOW
) -> DataFrame:
    """``rows`` with the array ``grams``: the kept grams as ``position << 32 | hash``,
    ascending. Each row is worked on alone and nothing is shuffled. A NULL text counts
    as empty and has none; grams at the end of a text are shorter, and a text of less
    than a window is one window.
    """
    kept = rows.columns
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    rows = _stage(rows, "_h", F.transform(tokens, lambda t: F.xxhash64(t)))
    # Of equal hashes the larger place gives the smaller value: the rightmost wins.
    # Behind the end there are NULLs, which neither hash nor least take in.
    value = F.transform(
        "_h",
        lambda h, i: F.xxhash64(h, *[F.get("_h", i + j) for j in range(1, gram)])
        .bitwiseAND(F.lit((2**63 - 1) & ~_PLACES))
        .bitwiseOR((F.lit(_PLACES) - i.bitwiseAND(F.lit(_PLACES))).cast("long")),
    )
    rows = _stage(rows, "_least", value)
    n, reach = F.size("_h"), 1
    while reach < window:
        step = min(reach, window - reach)
        later = F.slice("_least", F.lit(step + 1), F.greatest(n - step, F.lit(0)))
        doubled = F.zip_with("_least", later, lambda a, b: F.least(a, b))
        rows = _stage(rows, "_next", doubled).drop("_least").withColumnRenamed("_next", "_least")
        reach += step
    whole = F.slice("_least", F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    places = F.lit(_PLACES).cast("long")
    found = F.transform(
        F.array_distinct(whole),
        lambda v: F.shiftleft(places - v.bitwiseAND(places), 32).bitwiseOR(F.shiftrightunsigned(v, 31)),
    )
    return _stage(rows, grams, F.array_sort(found)).select(*kept, grams)


def fingerprint(grams: Column) -> Column:
    """Ten hexadecimal digits for each kept gram: two for the distance from the last
    kept position (from -1 for the first), eight for the hash."""

    def packed(g, i):
        before = F.coalesce(F.shiftright(F.get(grams, i - 1), 32), F.lit(-1))
        return F.shiftleft(F.shiftright(g, 32) - before, 32).bitwiseOR(g.bitwiseAND(F.lit(0xFFFFFFFF)))

    return F.array_join(F.transform(F.transform(grams, packed), lambda v: F.lpad(F.hex(v), 10, "0")), "")


def hashes(grams: Column) -> Column:
    """The distinct hashes of kept grams."""
    return F.array_distinct(F.transform(grams, lambda g: g.bitwiseAND(F.lit(0xFFFFFFFF))))


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two sets of hashes: size of the intersection by that of the union;
    1 for two empty sets."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(1.0))


def next_ids(ids: DataFrame, id: str = "doc_id") -> DataFrame:
    """``(doc_id, next_id)`` for distinct ids: the next smaller one, NULL being the
    smallest; after the smallest the largest."""
    own = Window.partitionBy(PART).orderBy(id)
    table = Arranged(ids.select(id).distinct(), [], [id]).table
    # One row per range from here on.
    ends = table.groupBy(PART).agg(F.max(F.struct(id)).getField(id).alias("_last"))
    ends = ends.select(F.lead(PART).over(Window.orderBy(PART)).alias("_after"), F.col("_last"))
    largest = table.agg(F.max(F.struct(id)).getField(id).alias("_largest"))
    first = F.row_number().over(own) == 1
    within = table.select(PART, id, F.lag(id).over(own).alias("_lag"), first.alias("_first"))
    # Ranges are as few as shuffle partitions, so the joins broadcast a row for each and one row.
    joined = within.join(F.broadcast(ends), F.col(PART) == F.col("_after"), "left").join(F.broadcast(largest))
    before = F.when(~F.col("_first"), F.col("_lag")).when(F.col("_after").isNotNull(), F.col("_last"))
    return joined.select(id, before.otherwise(F.col("_largest")).alias("next_id"))


def compare_edited(documents: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    The edited text has the last third of the characters replaced by as many from the
    start of the next document (all of it, if shorter), in descending order of id;
    after the last comes the first, so a single document is its own next. A NULL text
    is empty. Ids are integers; a NULL id is an id, the last one. Rows that share an id
    are documents of their own, in descending order of a hash of the text, for which the table is
    sorted and written once. An empty table gives no rows; other columns are not read. The result is ``(doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next)``; a likeness is that of
    the sets of hashes.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ids = written(rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.char_length("text")).alias("n_chars")))
    if not ids.where("n > 1").isEmpty():
        ordered = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        numbered = written(ordered.withColumn("row", F.monotonically_increasing_id()))
        found = compare_edited(numbered.select(F.col("row").alias("doc_id"), "text"), gram, window)
        names = numbered.select("row", F.col("doc_id").alias("own_id")).join(found, F.col("row") == found.doc_id)
        return names.select(F.col("own_id").alias("doc_id"), *[c for c in found.columns if c != "doc_id"])

    def key(name: str) -> Column:  # a NULL would join nothing
        return F.coalesce(F.col(name), F.lit(_NO_ID))

    thirds = ids.select(key("doc_id").alias("key"), F.floor(F.col("n_chars") / 3).cast("int").alias("third"))
    links = written(next_ids(ids).select(key("doc_id").alias("key"), key("next_id").alias("next")).join(thirds, "key"))
    keyed = rows.select(key("doc_id").alias("id"), "text")
    following = keyed.join(links, F.col("id") == F.col("next")).select("key", "third", "text")
    following = kept_grams(following, "text", "grams", gram, window).select(
        "key",
        "third",
        F.expr("substring(text, 1, third)").alias("head"),
        hashes(F.col("grams")).alias("next_hashes"),
    )
    edited = F.expr("concat(substring(text, 1, char_length(text) - third), head)")
    both = _stage(keyed.join(following, F.col("id") == F.col("key")), "edited", edited)
    found = kept_grams(both, "text", "grams", gram, window)
    found = found.select("id", F.char_length("text").cast("long").alias("n_chars"), "edited", "next_hashes", "grams")
    found = kept_grams(found, "edited", "edited_grams", gram, window)
    own = _stage(found, "own_hashes", hashes(F.col("grams")))
    return own.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("grams")).alias("fingerprint"),
        fingerprint(F.col("edited_grams")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), hashes(F.col("edited_grams"))).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
    )
