"""Line dedup: a deletion-neighbourhood join, in DataFrame operations alone.

Lines (trimmed) within one edit (a character put in, left out or replaced) of an earlier line go; the earliest stays. Two lines
are within one edit if they are equal, if leaving out the same place of both gives equal variants (a replaced character), or
if leaving out a place of one gives the other. So a line emits its variants with one character left out as hashed keys,
and itself whole, and equal keys join: of each key the earliest line is the only partner that the others need, so no bucket
is expanded into pairs. Partners are verified by edit distance on the texts.

Equal lines are one from the start, by 128 bits of hash. A line can only have a partner if it shares its first or its second
half (cut by the length of the shorter of the two) with another line, so only such lines emit variants. Long lines emit them
piece by piece: cut into up to PIECES pieces, all but one must be shared, and that one emits the variants.

Defined cases: a null text stays null and has no lines; blank lines stay; lines of any length are compared, so of two lines of one character
the later goes (lines shorter than least_chars, if that is raised, are only compared for equality); earliest is by (doc_id, a hash of the text,
line number), nulls first; rows that share doc_id and text keep the same lines; other columns stay, whatever their names, and columns
named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexil.llm.shared import cut, release

LEAST_CHARS = 1
PIECES, PIECE_CHARS = 64, 16
#: So many rows of three numbers may be sent to every task (24 MB); more are joined by a shuffle.
SENT_ROWS = 1_000_000
#: Characters that trimming takes off a line.
BLANKS = " \t\r\x0b\x0c"


def _bounded(df: DataFrame) -> DataFrame:
    """df, to be sent to every task only if its rows, counted, are few."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def _trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, doc (hash of the text), line (number from 0), text, h1, h2 of all lines that aren't blank."""
    split = docs.select("doc_id", F.xxhash64("text").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    split = split.select("doc_id", "doc", "line", _trimmed(F.col("raw")).alias("text")).where("text <> ''")
    return split.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(2), "text")})


def _halves(longer: int) -> list[Column]:
    """Hashes of both halves of a line that is the longer one of a pair, or not."""
    first, second = f"cast(floor((n - {longer}) / 2) as int)", f"cast(n - {longer} - floor((n - {longer}) / 2) as int)"
    return [F.xxhash64(F.lit(side), F.col("n") - longer, F.expr(f"{side}(text, {size})")) for side, size in (("left", first), ("right", second))]


def first_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """h1, h2, at (first place), halves (null for short lines) of each distinct line."""
    lines = _lines(docs.select("doc_id", "text")).withColumn("n", F.char_length("text"))
    lines = lines.withColumn("halves", F.when(F.col("n") >= least_chars, F.array(*_halves(0), *_halves(1))))
    return lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "doc", "line")).alias("at"), F.first("halves").alias("halves"))


def _shared(df: DataFrame, key: str) -> DataFrame:
    """The rows of df (key, longer, ...) whose key another row has, one of the rows not being in the longer line's role."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.min("longer").alias("least")).where("k > 1 and least = 0")
    return df.join(groups.select(key), key, "left_semi")


def close_texts(docs: DataFrame, first: DataFrame) -> DataFrame:
    """at, text, n of the distinct lines that share a half with another."""
    halves = first.select("h1", "h2", F.posexplode("halves").alias("k", "half")).select("h1", "h2", "half", F.floor(F.col("k") / 2).alias("longer"))
    near = cut(_shared(halves, "half").select("h1", "h2").distinct())
    texts = _lines(docs.select("doc_id", "text")).select("h1", "h2", "text").join(_bounded(near), ["h1", "h2"], "left_semi")
    texts = texts.groupBy("h1", "h2").agg(F.first("text").alias("text"))
    return texts.join(first.select("h1", "h2", "at"), ["h1", "h2"]).select("at", "text", F.char_length("text").alias("n"))


def variants(some: DataFrame) -> DataFrame:
    """at, place (0: nothing left out), variant (hashed key) of all lines of some (at, text, n)."""
    short = some.where(F.col("n") <= 2 * PIECE_CHARS).select("at", F.lit(0).cast("long").alias("rest"), F.col("text").alias("piece"))
    # The longest of the short lines are also cut as the shorter ones of pairs, to meet those one character longer.
    roles = F.when(F.col("n") > 2 * PIECE_CHARS, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    long = some.where(F.col("n") >= 2 * PIECE_CHARS).withColumn("longer", F.explode(roles)).withColumn("m", F.col("n") - F.col("longer"))
    long = long.withColumn("pieces", F.least(F.lit(PIECES), F.ceil(F.col("m") / PIECE_CHARS)).cast("long"))
    long = long.withColumn("j", F.explode(F.expr("sequence(0L, pieces - 1)")))
    long = long.withColumns({"start": F.expr("cast(j * m div pieces as int)"), "tail": F.expr("cast(m - (j + 1) * m div pieces as int)")})
    rest = F.xxhash64("m", "j", F.expr("left(text, start)"), F.expr("right(text, tail)"))
    long = _shared(long.select("at", "longer", rest.alias("rest"), F.expr("substring(text, start + 1, n - tail - start)").alias("piece")), "rest")
    each = F.expr("transform(sequence(0, char_length(piece)), i -> struct(i as place, xxhash64(rest, if(i = 0, piece, concat(left(piece, i - 1), substring(piece, i + 1)))) as variant))")
    return short.unionByName(long.select("at", "rest", "piece")).select("at", F.inline(each))


def earlier_partners(some: DataFrame) -> DataFrame:
    """at of the lines of some (at, text, n) that have an earlier line within one edit."""
    emitted = cut(variants(some))
    whole, less = emitted.where("place = 0").select("variant", "at"), emitted.where("place > 0")
    # Replaced characters: same variant, same place.
    same = less.groupBy("variant", "place").agg(F.min("at").alias("other"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    found = [less.join(same, ["variant", "place"]).select("at", "other")]
    # One character more or less: the variant is the other line as a whole.
    found.append(less.join(whole.withColumnRenamed("at", "other"), "variant").select("at", "other"))
    found.append(whole.join(less.groupBy("variant").agg(F.min("at").alias("other")), "variant").select("at", "other"))
    pairs = found[0].unionByName(found[1]).unionByName(found[2]).where("other < at").distinct()
    texts = some.select("at", "text")
    pairs = pairs.join(texts, "at").join(texts.toDF("other", "other_text"), "other")
    return pairs.where(F.levenshtein("text", "other_text", 1) >= 0).select("at").distinct()


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, max_edits: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) with text rebuilt from the lines that stay; adds n_lines and n_kept (lines that aren't blank)."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    release(docs.sparkSession)
    first = cut(first_lines(docs, least_chars))
    kept = first.select("at")
    if max_edits:
        some = cut(close_texts(docs, first))
        kept = kept.join(earlier_partners(some), "at", "left_anti")
    kept = kept.select("at.*").groupBy("doc_id", "doc").agg(F.collect_list("line").alias("kept")).toDF("id", "doc", "kept")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    # All columns of docs travel as one, so that no name of theirs can clash.
    rest = docs.select(F.struct(*(docs[c] for c in columns)).alias("row"))
    full = rest.join(kept, F.col("row.doc_id").eqNullSafe(F.col("id")) & F.xxhash64("row.text").eqNullSafe(F.col("doc")), "left")
    none = F.expr("cast(array() as array<int>)")
    full = full.select("row", F.split("row.text", "\n", -1).alias("lines"), F.coalesce("kept", none).alias("kept"))
    blank = F.filter(F.transform("lines", lambda x, i: F.when(_trimmed(x) == "", i)), lambda i: i.isNotNull())
    full = full.withColumn("blank", F.coalesce(blank, none))
    order = F.array_sort(F.concat("kept", "blank"))
    text = F.when(F.col("row.text").isNotNull(), F.array_join(F.transform(order, lambda i: F.get("lines", i)), "\n"))
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size("lines") - F.size("blank"))
    out = [text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in columns]
    return full.select(*out, n_lines.alias("n_lines"), F.size("kept").alias("n_kept"))
