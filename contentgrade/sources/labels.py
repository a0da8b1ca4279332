"""Human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contentgrade.functions.urls import label_url_key


_NO_ARRAY = "labels must be a JSON array"


def _signs(text: Column, signs: str) -> Column:
    """How many characters of a text are among the given ones."""
    return F.length(F.regexp_replace(text, f"[^{signs}]", ""))


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """The objects of files that each hold one JSON array: ``file, pos, entry``, in any order.

    A file is cut behind each ``}`` by the text source, so a large one is read by as many
    tasks as any text file, also if it is one line. What a piece means depends on what stands
    before it: the number of quotes tells whether it begins inside a string, and the brackets
    outside of strings how deep it is. A block of a file sums up both for either beginning, one row
    per block carries them on to the next blocks, and within a block they are running sums. An object of
    the array ends with the piece that brings the depth back to one. Pieces are then put
    together per object, so no row is larger than an object and what stands between
    it and the one before. ``pos`` grows in the order of the file.
    """
    source = spark.read.option("lineSep", "}").text(path)
    meta = F.col("_metadata")
    pieces = source.select(
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    # No escape reaches beyond a piece: behind a backslash a brace isn't JSON.
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = pieces.withColumns({"_plain": plain, "_odd": _signs(plain, '"') % 2})

    def inside(begins: Column) -> Column:
        """The change of depth of a piece, with the brace behind it."""
        whole = F.concat(F.when(begins == 1, F.lit('"')).otherwise(F.lit("")), "_plain")
        bare = F.regexp_replace(whole, r'"[^"]*+(?:"|\z)', "")
        closed = F.when((begins + F.col("_odd")) % 2 == 0, 1).otherwise(0)
        return _signs(bare, r"\[{") - _signs(bare, r"\]") - closed

    in_block = Window.partitionBy("file", "block").orderBy("id")
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    # The state of a piece, and the changes of depth, if the block begins outside or inside of a string.
    begun = quotes.withColumns(
        {"_state": F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2, "_rank": F.row_number().over(in_block)}
    ).withColumns({"_out": inside(F.col("_state")), "_in": inside(1 - F.col("_state"))})
    blocks = begun.groupBy("file", "block").agg(
        F.sum("_odd").alias("odd"), F.sum("_out").alias("out"), F.sum("_in").alias("in")
    )
    # One row per block of a file from here on.
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    started = blocks.withColumn("_from", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    change = F.when(F.col("_from") == 0, F.col("out")).otherwise(F.col("in"))
    carried = started.select(
        "file",
        "block",
        "_from",
        F.coalesce(F.sum(change).over(earlier), F.lit(0)).alias("_deep"),
        # The last piece has no brace behind it, so a whole array ends one below where it began.
        (F.sum(change).over(Window.partitionBy("file")) == -1).alias("_whole"),
    )
    known = begun.join(carried, ["file", "block"])
    step = F.when(F.col("_from") == 0, F.col("_out")).otherwise(F.col("_in"))
    depth = F.col("_deep") + F.sum(step).over(in_block)
    quoted = (F.col("_from") + F.col("_state") + F.col("_odd")) % 2 == 1
    # Every piece takes a byte, so a block's places end before those of the next begin.
    place = F.when((depth == 1) & ~quoted, F.col("block") + F.col("_rank"))
    ends = known.select("file", "block", "id", "_rank", "_whole", "value", place.alias("_end"))
    following = in_block.rowsBetween(0, Window.unboundedFollowing)
    later = Window.partitionBy("file").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    firsts = ends.groupBy("file", "block").agg(F.min("_end").alias("first")).select(
        "file", "block", F.min("first").over(later).alias("_next")
    )
    owned = ends.withColumn("_own", F.min("_end").over(following)).join(firsts, ["file", "block"]).select(
        "file", F.coalesce("_own", "_next").alias("pos"), "_whole", F.struct("block", "_rank", "value").alias("piece")
    )
    entries = owned.groupBy("file", "pos", "_whole").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    text = F.array_join(F.col("pieces")["value"], "}")
    first = (F.col("pieces")[0]["block"] == 0) & (F.col("pieces")[0]["_rank"] == 1)
    joined = entries.select(
        "file",
        "pos",
        "_whole",
        first.alias("_first"),
        F.when(F.col("pos").isNull(), text).otherwise(F.concat(text, F.lit("}"))).alias("_text"),
    )
    # What follows the last object has to close the array.
    rest = F.when(F.col("pos").isNull(), F.regexp_extract("_text", r"(?s)\A(.*)\]\s*\z", 1)).otherwise(F.col("_text"))
    opens = F.when(F.col("_first"), r"\A\s*\[").otherwise(F.when(F.col("pos").isNull(), r"\A\s*[,\]]").otherwise(r"\A\s*,"))
    closes = F.col("pos").isNotNull() | F.col("_text").rlike(r"\]\s*\z")
    parsed = F.from_json(F.concat(F.lit("["), F.regexp_replace(rest, r"\A\s*[\[,]", ""), F.lit("]")), "array<string>")
    good = F.col("_whole") & F.regexp_like("_text", opens) & closes & parsed.isNotNull()
    entry = F.when(good, F.try_element_at(parsed, F.lit(-1))).otherwise(F.raise_error(F.lit(_NO_ARRAY)).cast("string"))
    return joined.select("file", "pos", entry.alias("entry"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels from files that each hold a JSON array of ``{"url", "target_score"}``.

    Entries that are no objects or lack a url or a score are skipped; a score of 0 counts, and
    true and false are 1 and 0. A score that is no number is an error.
    Of entries whose urls agree after normalising, the last one wins, in the order of file
    name and position. ``path`` may be one file or a folder of many, of any size. Anything but an array,
    and input without a valid entry, is an error.
    """
    rows = array_objects(spark, path).filter(F.col("entry").rlike(r"\A\s*\{"))
    fields = rows.select(
        "file",
        "pos",
        F.get_json_object("entry", "$.url").alias("url"),
        F.get_json_object("entry", "$.target_score").alias("score"),
        F.schema_of_variant(F.try_variant_get(F.try_parse_json("entry"), "$.target_score", "variant")).alias("kind"),
    ).filter((F.coalesce("url", F.lit("")) != "") & F.col("score").isNotNull())
    number = F.when(F.col("kind") == "BOOLEAN", (F.col("score") == "true").cast("double")).otherwise(
        F.trim("score").try_cast("double")
    )
    wrong = F.raise_error(F.concat(F.lit("not a score: "), "score")).cast("double")
    labels = unique_labels(fields.select("file", "pos", "url", F.coalesce(number, wrong).alias("target_score")))
    if labels.isEmpty():
        raise ValueError("no valid label entry")
    return labels


def unique_labels(entries: DataFrame) -> DataFrame:
    """One row per normalised url, ``url_key, url, target_score, pos``; the last entry wins.

    Expects ``url, target_score, pos`` and, for labels from several files, ``file``.
    """
    order = F.struct("file", "pos") if "file" in entries.columns else F.col("pos")
    return (
        entries.groupBy(label_url_key(F.col("url")).alias("url_key"))
        .agg(F.max_by(F.struct("url", "target_score", "pos"), order).alias("last"))
        .select("url_key", "last.*")
    )
