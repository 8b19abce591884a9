"""Rows whose text contains any needle of a table, of any number of needles.

A list of `contains` tests joined by OR grows the plan with the list and reads every needle for every row. Here each
needle is anchored at one of its pieces of three characters (at itself where it is shorter). Wherever a text holds that
piece, the stretch that the needle would take up there is cut out of the text and looked up among the needles by equality,
so a needle meets only texts that hold it, however many hold its pieces.

Needles of one kind (piece, characters before it, length) share the stretches cut out for it. All places of the pieces are
counted first, and each needle takes the kind with the fewest places for each needle that could share it. A needle with
a piece that stands nowhere is not looked up. The needles' pieces and kinds are written once, so that Spark chooses the joins
by measured size; there is no nested loop. Texts are compared once however many rows hold them; a long text is first cut
into parts that overlap by the longest needle, as the rows of its places carry the text with them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.session import stored

PIECE = 3
#: kept for callers; stretches are looked up by equality, so a piece of many texts needs no shards
SHARD_TEXTS = 200_000
#: characters of a part of a long text beyond the length of the longest needle
PART = 1_000
_KIND = ["_piece", "_before", "_length"]


def _pieces(text: str, size: int) -> Column:
    """The pieces of one size, one from each character on: the match looks ahead, so they overlap."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1))


def _places(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """The columns of the texts, _at (characters before the piece), _piece: every place of every piece."""
    return reduce(DataFrame.unionByName, [texts.select("*", F.posexplode(_pieces("_text", n)).alias("_at", "_piece")) for n in sizes])


def _anchored(texts: DataFrame, needles: DataFrame, sizes: list[int]) -> DataFrame:
    """Each needle with the kind that it is looked up by; those with a piece that no text holds are left out."""
    length = F.char_length("_needle")
    own = F.when(length < PIECE, F.array("_needle")).otherwise(_pieces("_needle", PIECE))
    asked = stored(needles.select("_needle", length.alias("_length"), F.posexplode(own).alias("_before", "_piece")), "asked")
    wanted = stored(asked.select("_piece").distinct(), "pieces")
    counts = _places(texts, sizes).join(wanted, "_piece", "left_semi").groupBy("_piece").agg(F.count("*").alias("_n"))
    kinds = asked.groupBy(*_KIND).agg(F.count("*").alias("_needles")).join(counts, "_piece", "left")
    # costs are compared by their power of two, and ties go to the first place, so that needles agree on few kinds
    cost = F.struct(
        F.col("_n").isNotNull().alias("stands"), F.floor(F.log2(F.col("_n") / F.col("_needles"))).alias("power"),
        F.col("_before").alias("before"), F.col("_piece").alias("piece"),
    )
    priced = kinds.select(*_KIND, cost.alias("_cost"))
    chosen = asked.join(priced, _KIND).groupBy("_needle", "_length").agg(F.min("_cost").alias("_least"))
    return chosen.filter("_least.stands").select(
        "_needle", F.col("_least.piece").alias("_piece"), F.col("_least.before").alias("_before"), "_length"
    )


def matching_texts(texts: DataFrame, needles: DataFrame, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """The distinct non-null values of the one column of `texts` that contain a value of the one column of `needles`.

    Null needles match nothing, an empty needle every text. Both are compared character by character, case included.
    """
    (text,), (needle,) = texts.columns, needles.columns
    texts = texts.select(F.col(text).alias("_text")).filter("_text IS NOT NULL").distinct()
    needles = needles.select(F.col(needle).alias("_needle")).filter("_needle IS NOT NULL").distinct()
    length = F.char_length("_needle")
    lengths = needles.groupBy(F.least(length, F.lit(PIECE)).alias("n")).agg(F.max(length).alias("most")).collect()
    sizes = sorted(r["n"] for r in lengths)  # of 0, 1, 2 and 3
    if 0 in sizes:
        return texts.select(F.col("_text").alias(text))
    if not sizes:
        return texts.select(F.col("_text").alias(text)).filter(F.lit(False))
    texts = stored(texts, "texts")
    most = max(r["most"] for r in lengths)
    parts = _parts(texts, most)
    chosen = stored(_anchored(parts, needles, sizes), "needles")
    kinds = stored(chosen.select(*_KIND).distinct(), "kinds")
    stretch = F.substr("_text", F.col("_at") - F.col("_before") + 1, F.col("_length"))
    cut = _places(parts, sizes).join(kinds, "_piece").filter("_at >= _before").select("_text", "_long", stretch.alias("_needle"))
    met = cut.join(chosen.select("_needle"), "_needle", "left_semi")
    met = met.select(F.when(F.col("_long").isNull(), F.col("_text")).alias("_text"), "_long").distinct()
    if not _any_long(texts, most):
        return met.select(F.col("_text").alias(text))
    met = stored(met, "met")
    named = met.filter("_long IS NOT NULL").select("_long")
    long = texts.filter(_is_long(most)).join(named, F.sha2("_text", 256) == F.col("_long"), "left_semi")
    return met.filter("_long IS NULL").select("_text").unionByName(long).select(F.col("_text").alias(text))


def _is_long(most: int) -> Column:
    return F.char_length("_text") > PART + most


def _any_long(texts: DataFrame, most: int) -> bool:
    return not texts.filter(_is_long(most)).isEmpty()


def _parts(texts: DataFrame, most: int) -> DataFrame:
    """_text, _long: short texts, and the parts of long ones with the hash of the whole text.

    A part is PART characters and the longest needle long and begins PART characters after the one before it, so each
    stretch of a needle's length lies whole in a part.
    """
    if not _any_long(texts, most):
        return texts.select("_text", F.lit(None).cast("string").alias("_long"))
    starts = F.sequence(F.lit(1), F.char_length("_text"), F.lit(PART))
    cut = F.transform(starts, lambda at: F.substr("_text", at, F.lit(PART + most)))
    return texts.select(
        F.explode(F.when(_is_long(most), cut).otherwise(F.array("_text"))).alias("_text"),
        F.when(_is_long(most), F.sha2("_text", 256)).alias("_long"),
    )


def with_needles(rows: DataFrame, col: str, needles: DataFrame, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """The rows whose `col` contains a needle."""
    found = matching_texts(rows.select(col), needles, shard_texts).withColumnRenamed(col, "_found")
    return rows.join(found, F.col(col) == F.col("_found"), "left_semi")


def without_needles(rows: DataFrame, col: str, needles: DataFrame, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """The rows whose `col` contains no needle; a null contains none."""
    found = matching_texts(rows.select(col), needles, shard_texts).withColumnRenamed(col, "_found")
    return rows.join(found, F.col(col) == F.col("_found"), "left_anti")
