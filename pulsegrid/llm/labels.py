"""Which rows a model may learn from, and bounded samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import unused


def held_out(doc_id: str | Column, mod: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has that remainder. Rows without an id are held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string")), F.lit(mod)) == remainder, F.lit(True))


def lowest(df: DataFrame, key: Column, k: int) -> DataFrame:
    """One row for each of the ``k`` distinct keys of the lowest hash; which of a key's rows is not said, so columns should follow from it.

    Keys that cannot be among them go before anything moves, by the share that k is of
    all distinct keys (estimated within some percent, of which twice as many stay), so that
    neither repeated rows nor the input's size change how many are found, and no task
    or driver sees k rows of every partition.
    """
    h = unused("hash", df.columns)
    n = df.agg(F.approx_count_distinct(key)).first()[0]
    rows, wanted = df.withColumn(h, F.xxhash64(key)), 2 * k + 64
    if n > 2 * wanted:
        rows = rows.where(F.col(h) < int(-(2**63) + 2**64 * (wanted / n)))
    return rows.dropDuplicates([h]).orderBy(h).limit(k).drop(h)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, mod: int, remainder: int, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """At most ``per_class`` distinct (text, label) pairs of each label, chosen by hash, from rows that are not held out.

    Only texts of at most ``max_chars`` serve to learn, so the sample's size on the
    driver is bounded.  Repeated and contradictory label rows: the largest label counts;
    null ids, labels and texts teach nothing.  Equal texts of different ids count once.
    """
    y = labels.where(F.col(target).isin(0, 1) & ~held_out("doc_id", mod, remainder)).groupBy("doc_id").agg(F.max(target).alias("_y"))
    own = docs.select("doc_id", "text").where(~held_out("doc_id", mod, remainder) & (F.length("text") <= max_chars) & (F.length("text") > 0))
    picked = []
    for label in (0, 1):
        ids = y.where(F.col("_y") == label)
        # the ids are chosen before texts move: twice as many as asked for, as copies are dropped afterwards
        some = lowest(ids, F.col("doc_id"), 2 * per_class)
        rows = own.join(F.broadcast(some), "doc_id").select("text").groupBy(F.xxhash64("text").alias("_h")).agg(F.min("text").alias("text")).orderBy("_h").limit(per_class).collect()
        picked += [(r["text"], label) for r in rows]
    return picked
