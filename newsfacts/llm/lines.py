"""Line dedup by winnowing, in DataFrame functions only.

Lines are hashed. Of each window of ``run`` consecutive lines the smallest hash is selected with its position, and only
these positions are kept, with the hashes of the lines around them. Any repeated run of at least ``run`` lines has a
selected position at the same place in each occurrence. Positions are joined on their hash; where it occurs again, the
match is extended line by line to both sides, as far as the windows whose minimum it is. Windows that follow one another
chain to the maximal repeated run. Every line of a window that occurred earlier, in the order of (id, line), is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfacts.llm.store import stored


def line_dedup(docs: DataFrame, run: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_removed, text): each row of ``docs`` without later repetitions of runs of lines.

    Lines end at ``\\n`` and are compared as they are; blank ones are skipped when windows are formed
    and stay, unless they lie inside a deleted run. Runs shorter than ``run`` lines that are not blank
    are never deleted. The first occurrence stays, by id (nulls last), then by the text's hash for
    rows of one id, then by line. Rows that agree in id and text count as one text and come back as often
    as they came in, treated alike. A null text has no lines and comes back null; an empty one has one. An
    empty table gives no rows. Extra columns are not read.

    A selected position is its hash, its place and the hashes of at most ``2 * run - 1`` lines; texts do not move. A
    fingerprint or window of a third of all texts is reduced to its earliest place by a partial aggregate before any
    shuffle; no pairs are formed.
    """
    lines = F.split("text", "\n", -1)
    kept = F.filter(
        F.transform("lines", lambda x, i: F.struct(i.alias("at"), x.alias("line"))),
        lambda x: F.length(F.trim(F.regexp_replace(x["line"], r"\s", ""))) > 0)

    def least(seen, start):
        """The smallest hash of a window and its index; the first of equal ones."""
        return F.array_min(F.transform(
            F.slice(seen, start + 1, run), lambda x, j: F.struct(x["hash"].alias("hash"), (start + j).alias("index"))))

    # A window minimum is chosen once, however many windows it is the minimum of.
    minima = F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size("kept") - run), lambda i: least(F.col("kept"), i)))

    def with_context(m):
        start = F.greatest(m["index"] - (run - 1), F.lit(0))
        return F.struct(
            m["hash"].alias("finger"), m["index"].alias("at"), (m["index"] - start).alias("left"),
            F.slice("kept", start + 1, m["index"] - start + run).alias("around"))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn(
        "version", F.xxhash64("text"))
    chosen = stored(
        rows.withColumn("lines", lines).withColumn("kept", kept)
        .select("id", "version", F.transform("kept", lambda x: F.struct(
            x["at"].alias("at"), F.xxhash64(x["line"]).alias("hash"))).alias("kept"))
        .filter(F.size("kept") >= run)
        .select("id", "version", F.explode(F.transform(minima, with_context)).alias("m"))
        .select("id", "version", "m.*"), "lines-minima")

    def place(at: str):
        return F.struct(F.col("id").isNull().alias("last"), "id", "version", at)

    repeated = chosen.groupBy("finger").agg(
        F.min(place("at")).alias("low"), F.max(place("at")).alias("high")).filter("low <> high").select("finger")
    # Extension both ways, line by line: the windows around a fingerprint of which it is the minimum. Equal windows
    # have it at the same distance, so each is met exactly once.
    starts = F.filter(
        F.sequence(F.greatest(F.col("left") - (run - 1), F.lit(0)), F.least(F.col("left"), F.size("around") - run)),
        lambda i: least(F.col("around"), i)["index"] == F.col("left"))
    windows = F.transform(starts, lambda i: F.struct(
        F.xxhash64(F.transform(F.slice("around", i + 1, run), lambda x: x["hash"])).alias("whole"),
        F.element_at("around", i + 1)["at"].alias("begin"),
        F.element_at("around", i + run)["at"].alias("end")))
    shared = chosen.join(repeated, "finger", "left_semi").select(
        "id", "version", F.explode(windows).alias("w")).select("id", "version", "w.*")
    first = shared.groupBy("whole").agg(
        F.min(place("begin")).alias("first"), F.max(place("begin")).alias("high")).filter(
        "first <> high").select("whole", "first")
    later = shared.join(first, "whole").filter(place("begin") != F.col("first"))
    # One entry per deleted window of a text, so no longer than the text.
    spans = later.groupBy("id", "version").agg(
        F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans"))
    joined = rows.alias("r").join(
        spans.alias("s"), F.col("r.id").eqNullSafe(F.col("s.id")) & F.col("r.version").eqNullSafe(
            F.col("s.version")), "left").select("r.id", "r.text", "s.spans")
    gone = F.flatten(F.transform("spans", lambda s: F.sequence(s["begin"], s["end"])))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    out = joined.withColumn("lines", F.split("text", "\n", -1)).withColumn(
        "left", F.when(F.col("spans").isNull(), F.col("lines")).otherwise(
            F.transform(F.array_except(every, gone), lambda i: F.element_at("lines", i + 1))))
    return out.select(
        F.col("id").alias(id_col), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join("left", "\n").alias("text"))
