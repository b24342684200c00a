"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's texts, dealt to shards and ordered by seeded hash, form one stream of
words per shard, cut into blocks of ``block`` words.  The mix's blocks go to sources
by the highest quotients target / (2 k + 1), then within a source to its shards
likewise (by their sizes), which gives integer quotas.  A shard repeats its whole
stream as often as its quota holds it and takes the rest as single blocks, chosen by
a seeded permutation that needs no sort.  All of it is DataFrame expressions.

Nothing is sorted in one task but the streams of shards and a few contested quotients:
the quotient of the last seat is found by narrowing, one aggregate a step, whatever the
number of sources or shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import drop, lookup, numbered, written

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3  # times that a source, shard or document may be taken
SHARD_DOCS = 2000
COPIES = 10_000  # equal rows made at once
# Multipliers of the permutation; the first that does not divide the number of blocks serves.
PRIMES = (1_000_003, 1_000_033, 1_000_037)
WAYS = 32  # parts into which a step of the narrowing cuts an interval
FEW = 4096  # contested quotients of a group that are ranked by a sort


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_targets(sizes: DataFrame) -> DataFrame:
    """Written (source, source_size, docs, weight, target) from (source, size) rows.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share all words;
    targets stop at CAP times their source's size, the excess reshared by weight until
    none is above: a round caps all sources below the present level, which only rises.
    """
    per = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "place", F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.pmod("place", F.lit(3)) + 1).drop("place")
    exact = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("decimal(38,0)")
    capped, state = F.lit(False), None
    while True:
        got = per.agg(F.sum("source_size"), F.sum(F.when(capped, F.col("source_size")).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        rest, weight = (got[0] or 0) - CAP * (got[1] or 0), got[2] or 0
        if (rest, weight) == state:
            break
        state = (rest, weight)
        capped = exact(F.col("source_size") * CAP) * exact(weight) < exact(rest) * exact(F.col("weight"))
    target = F.when(capped, CAP * F.col("source_size").cast("double")).otherwise(F.lit(float(rest)) * F.col("weight") / F.lit(float(max(weight, 1))))
    return written(per.withColumn("target", target), "targets")


def _narrowed(rows: DataFrame, state: DataFrame, count) -> DataFrame:
    """``state`` with intervals that hold the entry number ``want`` from above and FEW others, or no number between their ends, written.

    rows: ``group`` and values; ``count(cut)`` gives how many of a row's entries are at
    least ``cut``.  state: group, want, lo, hi, at_lo, at_hi, with at_hi < want <= at_lo
    entries at hi and lo.  A step cuts each open interval in WAYS parts by one aggregate.
    """
    state, marks = written(state, "state"), [f"c{j}" for j in range(1, WAYS)]
    cut = lambda j: F.col("lo") * F.pow(F.col("hi") / F.col("lo"), F.lit(j / WAYS))
    inner = (F.col("lo") < cut(WAYS // 2)) & (cut(WAYS // 2) < F.col("hi"))
    while True:
        wide = (F.col("at_lo") - F.col("at_hi") > FEW) & inner
        todo = state.where(wide)
        if todo.isEmpty():
            return state
        counted = rows.join(lookup(todo.select("group", "lo", "hi")), "group").groupBy("group").agg(*[F.sum(count(cut(j))).alias(f"c{j}") for j in range(1, WAYS)])
        both = state.join(lookup(counted), "group", "left")
        cuts = F.array(F.col("lo"), *[cut(j) for j in range(1, WAYS)], F.col("hi"))
        counts = F.array(F.col("at_lo"), *marks, F.col("at_hi"))
        k = F.size(F.filter(counts, lambda c: c >= F.col("want")))  # counts fall, and the first one suffices
        moved = F.struct(F.element_at(cuts, k).alias("lo"), F.element_at(cuts, k + 1).alias("hi"), F.element_at(counts, k).alias("at_lo"), F.element_at(counts, k + 1).alias("at_hi"))
        kept = F.struct("lo", "hi", "at_lo", "at_hi")
        new = written(both.select("group", "want", F.when(F.col("c1").isNotNull(), moved).otherwise(kept).alias("s")).select("group", "want", "s.*"), "state")
        drop(state)
        state = new


def sainte_lague(parties: DataFrame, within: list[str], weight: str, seats: str, most: str) -> DataFrame:
    """Adds ``quota``: each party's seats by highest quotients weight / (2 k + 1), ``seats`` in each group, ``most`` at most for a party.

    Equal quotients go by hash of the party.  Parties without weight get none; where
    the seats exceed what all may take, each takes its most.
    """
    id_ = F.xxhash64(*parties.columns)
    rows = parties.select(
        F.struct(*parties.columns).alias("party"), F.xxhash64(*[F.col(c) for c in within], F.lit(0)).alias("group"), id_.alias("id"), (id_ / 2.0**64 + 1.5).alias("u"), F.col(weight).cast("double").alias("w"),
        F.when(F.col(weight) > 0, F.col(most)).otherwise(0).cast("long").alias("m"), F.col(seats).alias("seats"),
    )
    rows = written(rows, "parties")
    live = rows.where("m > 0").select("group", "w", "m", "u")
    q = lambda k: F.col("w") / (2 * k + 1)

    def count(cut):
        n = F.floor((F.col("w") / cut + 1) / 2)  # but for rounding, quotients from cut on
        n = n + F.when(q(n) >= cut, 1).otherwise(0) - F.when((n > 0) & (q(n - 1) < cut), 1).otherwise(0)
        return F.least(F.col("m"), n)

    groups = rows.groupBy("group").agg(F.sum("m").alias("all"), F.max("seats").alias("seats"), F.max("w").alias("top"), F.min(F.when(F.col("m") > 0, q(F.col("m") - 1))).alias("least"))
    first = groups.where("seats > 0 and all > 0").select("group", F.least("seats", "all").cast("long").alias("want"), F.col("least").alias("lo"), (F.col("top") * 2).alias("hi"), F.col("all").alias("at_lo"), F.lit(0).cast("long").alias("at_hi"))
    state = _narrowed(live, first, count)
    # seats from hi on are won; those between lo and hi are contested, a row each
    near = rows.join(lookup(state), "group").withColumn("sure", count(F.col("hi"))).withColumn("maybe", count(F.col("lo")))
    contested = near.where("maybe > sure").select("group", "id", "u", "w", "want", "at_hi", F.explode(F.sequence("sure", F.col("maybe") - 1)).alias("k")).withColumn("q", q(F.col("k")))
    ties = state.where(F.col("at_lo") - F.col("at_hi") > FEW)  # so many equal ones
    if not ties.isEmpty():
        flat = written(contested.join(lookup(ties.select("group")), "group", "left_semi").select("group", "u"), "ties")
        one = ties.select("group", (F.col("want") - F.col("at_hi")).alias("want"), F.lit(0.5).alias("lo"), F.lit(2.5).alias("hi"), (F.col("at_lo") - F.col("at_hi")).alias("at_lo"), F.lit(0).cast("long").alias("at_hi"))
        cuts = _narrowed(flat, one, lambda cut: (F.col("u") >= cut).cast("long"))
        contested = contested.join(lookup(cuts.select("group", F.col("lo").alias("u_lo"), F.col("hi").alias("u_hi"), F.col("at_hi").alias("u_won"))), "group", "left")
    else:
        contested = contested.withColumn("u_lo", F.lit(0.0)).withColumn("u_hi", F.lit(3.0)).withColumn("u_won", F.lit(0).cast("long"))
    by_hash = F.col("u_lo").isNotNull()
    open_ = contested.where(~by_hash | ((F.col("u") >= F.col("u_lo")) & (F.col("u") < F.col("u_hi"))))
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("q"), F.desc("u"), "k"))
    won = open_.withColumn("rank", rank).where(F.col("rank") <= F.col("want") - F.col("at_hi") - F.coalesce("u_won", F.lit(0))).select("group", "id")
    won = won.unionByName(contested.where(F.col("u") >= F.col("u_hi")).select("group", "id")).groupBy("group", "id").agg(F.count("*").alias("extra"))
    sure = rows.join(lookup(state.select("group", "hi")), "group", "left").withColumn("sure", F.when((F.col("m") > 0) & F.col("hi").isNotNull(), count(F.col("hi"))).otherwise(0))
    return sure.join(won, ["group", "id"], "left").select("party.*", (F.col("sure") + F.coalesce("extra", F.lit(0))).cast("long").alias("quota"))


def mix(docs: DataFrame, targets=cyclic_targets, block: int = 16, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted), passes, source.

    ``targets`` maps (source, size) rows to (source, source_size, docs, target).  Null and
    empty texts have size 0 and give nothing; a null source is a source.  Repeated rows
    count each.  The same rows and seed give the same result, however they are dealt.
    """
    each = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    # rows that are the same here are counted and numbered, so that however many there are, they lie in many shards
    same = each.groupBy("doc_id", "source", "size").agg((F.count("*") - 1).alias("last"))
    some = same.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(COPIES).cast("long"))))
    sizes = written(some.select("doc_id", "source", "size", F.explode(F.sequence("lo", F.least("last", F.col("lo") + COPIES - 1))).alias("copy")), "sizes")
    by_source = targets(sizes.select("source", "size"))

    total = by_source.agg(F.sum("target")).first()[0] or 0.0
    # no source may get more than CAP times its blocks, and shards round up, so this bound holds below
    parties = by_source.select("source", "target", F.lit(int(total / block + 0.5)).cast("long").alias("seats"), (CAP * F.ceil(F.col("source_size") / block)).cast("long").alias("most"))
    quotas = sainte_lague(parties, [], "target", "seats", "most").select(F.col("source").alias("q_source"), F.col("quota").alias("source_quota"))
    known = by_source.join(quotas, F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source")
    known = written(known.withColumn("shards", F.ceil(F.col("docs") / SHARD_DOCS).cast("long")), "quotas")
    drop(by_source)
    few = lookup(known)

    placed = sizes.join(few.withColumnRenamed("source", "k_source"), F.col("source").eqNullSafe(F.col("k_source"))).drop("k_source")
    placed = placed.withColumn("key", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"), F.col("copy"))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("key")), F.col("shards")))
    per = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota"))
    per = per.withColumn("blocks", F.ceil(F.col("words") / block).cast("long")).withColumn("most", CAP * F.col("blocks"))
    per = written(sainte_lague(per, ["source"], "words", "source_quota", "most"), "shards")
    n = F.col("blocks")
    step = F.when(n % PRIMES[0] != 0, PRIMES[0]).when(n % PRIMES[1] != 0, PRIMES[1]).otherwise(PRIMES[2]).cast("long")
    per = per.select(
        F.col("source").alias("s_source"), F.col("shard").alias("s_shard"), "blocks", F.when(n > 0, F.floor(F.col("quota") / n)).otherwise(0).cast("long").alias("passes"),
        F.when(n > 0, F.col("quota") % n).otherwise(0).alias("extra"), step.alias("step"), F.when(n > 0, F.pmod(F.xxhash64(F.lit(seed + 2), F.col("source"), F.col("shard")), n)).otherwise(0).alias("start"),
    )

    stream = Window.partitionBy("source", "shard").orderBy("key", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("hi", F.sum("size").over(stream)).withColumn("lo", F.col("hi") - F.col("size"))
    joined = placed.join(lookup(per), F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shard") == F.col("s_shard")))
    first, last = F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block)
    chosen = F.expr(
        f"aggregate(sequence(cast(floor(lo / {block}) as bigint), cast(floor((hi - 1) / {block}) as bigint)), cast(0 as bigint), (t, k) -> t + if((k * step + start) % blocks < extra, least(hi, (k + 1) * {block}) - greatest(lo, k * {block}), cast(0 as bigint)))"
    )
    taken = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.col("passes") * F.col("size") + F.when((F.col("extra") > 0) & (last >= first), chosen).otherwise(0))
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "passes", "source")
