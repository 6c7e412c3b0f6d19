"""Line deduplication across documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import LOWER, UPPER
from .shared import discard, flag_maybe_in, free_names, staged

#: ASCII white space: [\x20\x09-\x0D].
_WHITE = " \t\n\x0b\x0c\r"


def _key(line, min_chars: int):
    """A hash of the normalised line (MD5), or null if that is shorter than min_chars."""
    bare = F.btrim(line, F.lit(_WHITE))
    return F.when((F.length(line) >= min_chars) & (F.length(bare) >= min_chars), F.unhex(F.md5(F.translate(bare, UPPER, LOWER))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, counts: tuple[str, str] = ("_n_lines", "_n_dropped")) -> DataFrame:
    """docs with its columns, text without its repeated lines, and two counts: lines before dropping, lines dropped.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of min_chars code points
    or more that occur in min_docs documents or more lose all their lines, except in the document with the
    largest id that has the key. Keys are hashed (128 bits) once for each line and written out; each counts once a
    document, summed before the shuffle. Lines of frequent keys come back as positions, and only texts that lose
    lines, found by a bit array of fixed size, are shuffled to meet them.

    Null and empty texts are one empty line, and stay null or empty. A row is a document: rows that repeat an id count
    one by one, and keep a line alike. A null id counts as smaller than any other; if all documents that have a key
    have null ids, all of them keep it. Other columns stay as they are, whatever their names; those named as the two
    counts are replaced.
    """
    docs = docs.drop(*counts)
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    owner = F.col(id_col).cast("long")
    row = F.xxhash64(owner, F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(owner.alias("d"), row.alias("r"), F.transform(lines, lambda x: _key(x, min_chars)).alias("keys"))
    keyed = staged(keyed.where(F.exists("keys", lambda k: k.isNotNull())), "line_keys")

    once = keyed.select("d", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
    frequent = once.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("d").alias("last")).where(F.col("c") >= min_docs)
    frequent = staged(frequent.select("key", "last"), "frequent_lines")
    each = keyed.select("d", "r", F.posexplode("keys").alias("pos", "key")).where("key is not null")
    hits = each.join(frequent, "key").where(~F.col("d").eqNullSafe(F.col("last")))
    drops = staged(hits.groupBy("r", "d").agg(F.sort_array(F.collect_set("pos")).alias("drop")), "dropped_lines")
    discard(keyed, frequent)

    mark, dropped, other, of = free_names(docs, "_loses", "_drop", "_d", "_r")
    flagged = flag_maybe_in(docs, row, drops.select(F.col("r").alias("key")), drops.count(), mark)
    size = F.size(lines).cast("long")
    whole = flagged.where(~F.col(mark)).select(*docs.columns, size.alias(counts[0]), F.lit(0).cast("long").alias(counts[1]))
    found = drops.select(F.col("r").alias(of), F.col("d").alias(other), F.col("drop").alias(dropped))
    some = flagged.where(F.col(mark)).join(found, (row == F.col(of)) & owner.eqNullSafe(F.col(other)), "left")
    edges = F.concat(F.array(F.lit(-1)), F.col(dropped), F.array(F.size(lines)))
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(dropped)),
            lambda i: F.slice(lines, F.get(edges, i) + 2, F.get(edges, i + 1) - F.get(edges, i) - 1),
        )
    )
    text = F.when(F.col(dropped).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias(text_col)
    n = F.when(F.col(dropped).isNull(), 0).otherwise(F.size(dropped)).cast("long")
    cut = some.select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns], size.alias(counts[0]), n.alias(counts[1]))
    return whole.unionByName(cut)
