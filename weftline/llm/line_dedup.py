"""Line deduplication with DataFrame functions only.

Lines are exploded as 128-bit hashes of their normalised form, each document counting once for a hash; hashes found in
at least ``min_docs`` documents are joined back, and every text is reassembled from its other lines in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import SPACES, ascii_lower, materialize, row_key, small, text_of


def _keys(lines: Column, min_chars: int) -> Column:
    """struct(a, b, at, first) of each line whose key counts: 128 bits of the key, the line's place, and whether it is the
    key's first line.

    Lines are put in the order of their keys for that; the transforms are nested so that nothing is computed twice.
    """
    keys = F.transform(F.transform(lines, lambda x: F.btrim(x, F.lit(SPACES))), ascii_lower)

    def hashed(k: Column, i: Column) -> Column:
        own = F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(17), k).alias("b"), i.alias("at"))
        return F.when(F.length(k) >= min_chars, own)

    def marked(ordered: Column) -> Column:
        def one(h: Column, j: Column) -> Column:
            last = F.get(ordered, j - 1)
            first = (j == 0) | (last["a"] != h["a"]) | (last["b"] != h["b"])
            return F.struct(h["a"].alias("a"), h["b"].alias("b"), h["at"].alias("at"), first.alias("first"))

        return F.transform(ordered, one)

    ordered = F.sort_array(F.filter(F.transform(keys, hashed), lambda h: h.isNotNull()))
    return F.transform(F.array(ordered), marked)[0]


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with text_col rebuilt without its frequent lines, and n_lines (before) and n_dropped (long) appended.

    A key is the line without ASCII white space at both ends and with A-Z lower-cased. Every row counts as a document of
    its own, repeated ids and repeated rows included. A null or empty text is one empty line; keys shorter than
    min_chars are never dropped, so blank lines stay. A text that loses all its lines becomes empty. An empty table
    gives an empty table. Columns of the input named n_lines or n_dropped are replaced; all others pass through.
    """
    held = docs.drop("n_lines", "n_dropped")
    lines = F.split(text_of(text_col), "\n", -1)
    keyed = held.select("*", *row_key(F.col(id_col), text_of(text_col)))
    hashed = keyed.select("__k1", "__k2", F.explode(_keys(lines, min_chars)).alias("__h")).select("__k1", "__k2", "__h.*")
    hashed = materialize(hashed, "line-hashes")  # two steps read it, so texts are taken apart once

    counted = hashed.where("first").groupBy("a", "b").agg(F.count(F.lit(1)).alias("__n"))
    frequent = materialize(counted.where(F.col("__n") >= min_docs).select("a", "b"), "frequent-lines")

    found = hashed.drop("first").join(small(frequent), ["a", "b"])
    per_row = found.groupBy("__k1", "__k2").agg(F.collect_list("at").alias("__drop"))

    def rest(ls: Column) -> Column:
        """The lines whose places aren't dropped; places are found by hash."""
        kept = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__drop"))
        text = F.array_join(F.transform(kept, lambda i: F.get(ls, i)), "\n")
        return F.struct(
            F.size(ls).cast("long").alias("n"),
            F.when(F.col("__drop").isNull(), 0).otherwise(F.size(ls) - F.size(kept)).cast("long").alias("gone"),
            F.when(F.col("__drop").isNull(), text_of(text_col)).otherwise(text).alias("text"),
        )

    joined = keyed.join(per_row.hint("merge"), ["__k1", "__k2"], "left")
    out = joined.select(*held.columns, F.transform(F.array(lines), rest)[0].alias("__rest"))
    kept = [F.col("__rest.text").alias(c) if c == text_col else F.col(c) for c in held.columns]
    return out.select(*kept, F.col("__rest.n").alias("n_lines"), F.col("__rest.gone").alias("n_dropped"))
