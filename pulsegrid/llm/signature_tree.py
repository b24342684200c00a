"""Exact n-gram Jaccard join by signature trees.

Nodes of the join are distinct texts.  Two texts link when
``den * |A & B| >= num * |A | B|`` over their sets of word shingles.

1. *Nodes*: distinct texts (by md5), each with its set size, its smallest shingle
   hashes, and a signature, a bitmap of its shingles.  A sketch of fixed size
   counts how many texts hold each bucket of shingles.
2. *Stars*: texts that share one of their smallest shingles are checked against
   the smallest text of that group.  This is linear in the group, finds nearly
   all links of groups of copies, and yields provisional components.
3. *Prefix groups*: a text's ``n - ceil(n * num / den) + 1`` least common shingles;
   linked texts share at least one, whatever order ranks "common".  At the first
   that a pair shares, what follows bounds the overlap, and so the partner's size
   (``cap``).  A shingle of very many texts has a group for each range of sizes, with
   the texts of the range below.  Groups that lie within one component are settled
   and go, as do texts that no other of the group suits in size.
4. *Signature trees*: the texts of each other group, ordered by size, form a tree
   whose nodes hold OR-ed and AND-ed bitmaps and the range of sizes.  A dual
   traversal drops node pairs whose largest possible overlap is too small, and
   those inside one component; at the leaves, pairs are held to their own bitmaps.
   Large groups are dealt to tasks in pairs of blocks, of which only those are made
   whose sizes and caps allow a link.
5. Surviving pairs are checked on the whole sets, streaming per left text.  In a
   group of many alike texts nearly all pairs survive, but most links only repeat
   what others say.  So a round takes each text's likeliest ``FIRST`` pairs; what
   they link becomes one component, and the next round, with eight times as many,
   looks at pairs between components only.  The rounds end when none was put off.

Every link between different components is found: steps 3 to 5 lose nothing, and
step 2 only merges what is linked.  Hashes of 64 bits stand for shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .scratch import drop, free, unused, written
from .textkernel import U64, Words, mix, shingle_sets, slices

SKETCH_BITS, SKETCH_MOST = 20, 24  # of the sketch: for up to 2 ** 18 rows, and whatever the input's size
HOT = 17  # level (logarithm of texts) from which a shingle's group is cut by sizes
_CHUNK = 4096  # counters in a row of the sketch
LEAF, BLOCK = 16, 512
FIRST = 2
#: Rows (of two longs or so) up to which a lookup table is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
#: Ids (one long each) up to which a semi-join is by broadcast.
BROADCAST_IDS = 2_000_000


def lookup(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast only if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def need(n: np.ndarray | int, num: int, den: int):
    """Least overlap of a set of n with any set it links to."""
    return (num * n + den - 1) // den


def cap(n: np.ndarray | int, rank: np.ndarray | int, num: int, den: int):
    """Largest set that a set of n links to, if the first element that both have is number ``rank`` (from 0) of the n: they share n - rank at most."""
    return (n - rank) * (num + den) // num - n


def signature(hashes: np.ndarray) -> bytes:
    """Bitmap with a power of two of bits, about twice as many as shingles (64 to 8192)."""
    bits = min(8192, max(64, 1 << int(2 * len(hashes) - 1).bit_length()))
    out = np.zeros(bits // 64, U64)
    at = hashes & U64(bits - 1)
    np.bitwise_or.at(out, (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
    return out.tobytes()


def fold(sig: np.ndarray, words: int) -> np.ndarray:
    """A longer signature (last axis) folded to ``words`` words; bits that met are OR-ed."""
    if sig.shape[-1] == words:
        return sig
    return np.bitwise_or.reduce(sig.reshape(*sig.shape[:-1], -1, words), axis=-2)


# ---------------------------------------------------------------- trees


class Node:
    """A node over members lo..hi of a group that is sorted by size."""

    __slots__ = ("lo", "hi", "least", "most", "any", "all", "kids", "comp", "rows")

    def __init__(self, lo, hi, sizes, sigs, comps):
        self.lo, self.hi = lo, hi
        self.least, self.most = int(sizes[lo]), int(sizes[hi - 1])
        own = comps[lo:hi]
        self.comp = int(own[0]) if (own == own[0]).all() else None
        if hi - lo <= LEAF:
            self.kids = ()
            words = min(len(s) for s in sigs[lo:hi])
            self.rows = rows = np.stack([fold(s, words) for s in sigs[lo:hi]])
            self.any, self.all = np.bitwise_or.reduce(rows, 0), np.bitwise_and.reduce(rows, 0)
        else:
            mid = (lo + hi) // 2
            self.kids = (Node(lo, mid, sizes, sigs, comps), Node(mid, hi, sizes, sigs, comps))
            words = min(len(k.any) for k in self.kids)
            self.any = fold(self.kids[0].any, words) | fold(self.kids[1].any, words)
            # bits that all members have remain common after folding; others may become so, which only loosens the bound
            self.all = fold(self.kids[0].all, words) & fold(self.kids[1].all, words)


def _apart(x: Node, y: Node, num: int, den: int) -> bool:
    """Whether no member of x can link to a member of y."""
    if den * min(x.most, y.most) < num * max(x.least, y.least):
        return True
    words = min(len(x.any), len(y.any))
    xa, ya = fold(x.any, words), fold(y.any, words)
    least = -(-num * (x.least + y.least) // (num + den))
    return x.most - int(np.bitwise_count(fold(x.all, words) & ~ya).sum()) < least or y.most - int(np.bitwise_count(fold(y.all, words) & ~xa).sum()) < least


def leaf_pairs(x: Node, y: Node, sizes, caps, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of two leaves whose largest possible overlap, by sizes, caps and bitmaps, suffices, and how alike their bitmaps are."""
    words = min(x.rows.shape[1], y.rows.shape[1])
    s, t = fold(x.rows, words)[:, None, :], fold(y.rows, words)[None, :, :]
    a, b = sizes[x.lo : x.hi, None], sizes[None, y.lo : y.hi]
    both, own_s, own_t = (np.bitwise_count(v).sum(-1, dtype=np.int64) for v in (s & t, s & ~t, t & ~s))
    least = -(-num * (a + b) // (num + den))
    ok = (den * np.minimum(a, b) >= num * np.maximum(a, b)) & (a - own_s >= least) & (b - own_t >= least)
    ok &= (a <= caps[None, y.lo : y.hi]) & (b <= caps[x.lo : x.hi, None])
    i, j = np.nonzero(ok)
    if x is y:
        i, j = i[i < j], j[i < j]
    return i + x.lo, j + y.lo, both[i, j] / np.maximum(1, both[i, j] + own_s[i, j] + own_t[i, j])


def candidates(sizes: np.ndarray, caps: np.ndarray, sigs: list[np.ndarray], comps: np.ndarray, left: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs of one group (sorted by size) that may link and lie in different components, with their likeness.

    ``caps`` are the largest sizes of partners.  ``left`` marks members of the left block: where both blocks differ, only pairs across them are wanted.
    """
    across = left.any() and not left.all()
    root = Node(0, len(sizes), sizes, sigs, comps)
    stack = [(root, root)]
    while stack:
        x, y = stack.pop()
        if x.comp is not None and x.comp == y.comp:
            continue
        if x is not y and _apart(x, y, num, den):
            continue
        if not x.kids and not y.kids:
            i, j, like = leaf_pairs(x, y, sizes, caps, num, den)
            keep = comps[i] != comps[j]
            if across:
                keep &= left[i] != left[j]
            if keep.any():
                yield i[keep], j[keep], like[keep]
        elif x is y:
            p, q = x.kids
            stack += [(p, p), (q, q), (p, q)]
        elif x.kids and (not y.kids or x.hi - x.lo >= y.hi - y.lo):
            stack += [(k, y) for k in x.kids]
        else:
            stack += [(x, k) for k in y.kids]


def likeliest(i: np.ndarray, j: np.ndarray, like: np.ndarray, limit: int) -> np.ndarray:
    """Marks of the pairs that are among the ``limit`` likeliest of either member."""
    keep = np.zeros(len(i), bool)
    for own in (i, j):
        order = np.lexsort((j, i, -like, own))
        start = np.searchsorted(own[order], own[order])
        keep[order[np.arange(len(own)) - start < limit]] = True
    return keep


# ---------------------------------------------------------------- stages


def _nodes(texts: DataFrame, size: int, bits: int) -> DataFrame:
    """Written table: a row per distinct text with words, and rows of the chunks of a sketch of 2 ** bits counters (those have no text)."""

    def run(batches):
        sketch = np.zeros(1 << bits, np.uint32)
        for part, buf, off in slices(batches, "text"):
            vals, first = shingle_sets(Words(buf, off), size)
            at, n = np.unique(vals >> U64(64 - bits), return_counts=True)
            sketch[at.astype(np.int64)] += n.astype(np.uint32)
            own = [vals[first[i] : first[i + 1]] for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("tk"), part.column("text"), pa.array(np.diff(first), pa.int64()), pa.array([v[:3].astype(np.int64) for v in own], pa.list_(pa.int64())),
                    pa.array([signature(v) if len(v) else b"" for v in own], pa.binary()), pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary()),
                ],
                names=["tk", "text", "n", "mins", "sig", "chunk", "counts"],
            )
        filled = [k for k in range(len(sketch) // _CHUNK) if sketch[k * _CHUNK : (k + 1) * _CHUNK].any()]
        none = len(filled)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(none, pa.binary()), pa.nulls(none, pa.string()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.list_(pa.int64())), pa.nulls(none, pa.binary()),
                pa.array(filled, pa.int32()), pa.array([sketch[k * _CHUNK : (k + 1) * _CHUNK].tobytes() for k in filled], pa.binary()),
            ],
            names=["tk", "text", "n", "mins", "sig", "chunk", "counts"],
        )

    made = texts.mapInArrow(run, "tk binary, text string, n bigint, mins array<bigint>, sig binary, chunk int, counts binary")
    return written(made.withColumn("nid", F.monotonically_increasing_id()), "nodes")


def _heat(nodes: DataFrame, bits: int) -> np.ndarray:
    """Base-2 logarithm of each bucket's count: a byte per bucket, 2 ** SKETCH_MOST at most."""

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.uint32).astype(np.uint64)
        level = [np.ceil(np.log2(s.astype(float) + 1)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(level, pa.binary())], names=["chunk", "level"])

    heat = np.zeros(1 << bits, np.uint8)
    chunks = nodes.where("chunk is not null").select("chunk", "counts").repartition(16, "chunk")
    for r in chunks.mapInArrow(total, "chunk int, level binary").collect():  # at most 2 ** SKETCH_MOST bytes
        heat[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(bytes(r["level"]), np.uint8)
    return heat


def _verified(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of ``nid`` that link, written. Each left text's pairs are streamed past its set, in several tasks where they are many."""
    pairs = written(pairs.distinct(), "pairs")
    n = pairs.count()
    per = pairs.groupBy("a").agg(F.ceil(F.count("*") / 512).alias("ways"))
    salted = written(pairs.join(lookup(per, n), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("ways")).alias("salt")), "salted")
    right = salted.select("a", "salt", F.col("b").alias("nid"), F.lit(1).alias("side"))
    lefts = salted.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("nid"), F.lit(0).alias("side"))
    wanted = right.unionByName(lefts)
    ids = written(wanted.select("nid").distinct(), "ids")
    few = ids.count()
    own = texts.select("nid", "text").join(F.broadcast(ids) if few <= BROADCAST_IDS else ids, "nid", "left_semi")
    joined = own.join(lookup(wanted, 2 * n), "nid")
    dealt = joined.repartition("a", "salt").sortWithinPartitions("a", "salt", "side", "nid")

    def run(batches):
        key, held = None, None
        for part, buf, off in slices(batches, "text"):
            vals, first = shingle_sets(Words(buf, off), size)
            a, salt, side, nid = (part.column(c).to_numpy() for c in ("a", "salt", "side", "nid"))
            linked = []
            for i in range(part.num_rows):
                own = vals[first[i] : first[i + 1]]
                if side[i] == 0:
                    key, held = (a[i], salt[i]), own
                elif key == (a[i], salt[i]) and len(own) and len(held):
                    at = np.searchsorted(held, own)
                    both = int((held[np.minimum(at, len(held) - 1)] == own).sum())
                    if den * both >= num * (len(own) + len(held) - both):
                        linked.append(i)
            take = np.array(linked, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[take], pa.int64()), pa.array(nid[take], pa.int64())], names=["a", "b"])

    out = written(dealt.mapInArrow(run, "a bigint, b bigint"), "links")
    drop(pairs, salted, ids)
    return out


def _stars(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of the smallest text that has a smallest shingle and each other text that has it, where the sizes allow a link."""
    keys = nodes.where("n > 0").select("nid", "n", F.explode("mins").alias("key"))
    heads = keys.groupBy("key").agg(F.min(F.struct("nid", "n")).alias("head"), F.count("*").alias("c")).where("c > 1").select("key", "head")
    sized = keys.join(heads, "key").where(den * F.least("n", "head.n") >= num * F.greatest("n", "head.n"))
    return sized.where("nid <> head.nid").select(F.col("head.nid").alias("a"), F.col("nid").alias("b"))


def _prefix_groups(nodes: DataFrame, comps: DataFrame, n_comps: int, heat: np.ndarray, size: int, num: int, den: int) -> DataFrame:
    """(key, nid, n, cap) of the prefix groups that hold two components or more, less those texts that no other suits in size."""
    bits = U64(64 - int(len(heat)).bit_length() + 1)
    width = np.log(den / num) * 1.0001  # linked sizes lie in one range of this width or in two neighbouring ones
    shared = nodes.sparkSession.sparkContext.broadcast(heat)

    def run(batches):
        heat = shared.value
        for part, buf, off in slices(batches, "text"):
            vals, first = shingle_sets(Words(buf, off), size)
            nid = part.column("nid").to_numpy()
            counts = np.diff(first)
            rows = np.repeat(np.arange(len(counts)), counts)
            level = heat[(vals >> bits).astype(np.int64)]
            order = np.lexsort((vals, level, rows))
            rank = np.arange(len(vals)) - first[:-1][rows]
            keep = rank < (counts - need(counts, num, den) + 1)[rows]
            at = order[keep]  # rows are contiguous in the order, so ranks hold for it
            own = rows[keep]
            caps = np.minimum(cap(counts[own], rank[keep], num, den), (1 << 32) - 1)  # no text has as many
            key, both = vals[at], counts[own] << 32 | caps
            hot = np.flatnonzero(level[at] >= HOT)
            if len(hot):  # a group for each range of sizes, which also takes in the range below
                span = (np.log(counts[own[hot]]) / width).astype(np.int64).astype(U64)
                above = mix(key[hot] ^ mix(span + U64(2)))
                key[hot] = mix(key[hot] ^ mix(span + U64(1)))
                key, own, both = np.concatenate((key, above)), np.concatenate((own, own[hot])), np.concatenate((both, both[hot]))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(nid[own], pa.int64()), pa.array(both, pa.int64())], names=["key", "nid", "both"])

    keys = nodes.where("n > 0").select("nid", "text").mapInArrow(run, "key bigint, nid bigint, both bigint")
    tagged = keys.join(lookup(comps, n_comps), F.col("nid") == F.col("node"), "left").select("key", "nid", "both", F.coalesce("component", "nid").alias("component"))
    # dealt by key here and not by the window, so that n and cap travel as one column
    tagged = tagged.repartition("key").select("key", "nid", F.shiftright("both", 32).alias("n"), F.col("both").bitwiseAND((1 << 32) - 1).alias("cap"), "component")
    by_size = Window.partitionBy("key").orderBy("n", "nid")
    whole = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_size.rowsBetween(Window.unboundedPreceding, -1)
    mixed = tagged.withColumn("lo", F.min("component").over(whole)).withColumn("hi", F.max("component").over(whole)).withColumn("reach", F.max("cap").over(before)).withColumn("more", F.lead("n").over(by_size)).where("lo <> hi")
    # a partner is an earlier text whose cap reaches this size, or a later one below this cap, of which the next is the smallest
    return mixed.where("coalesce(reach >= n, false) or coalesce(more <= cap, false)").select("key", "nid", "n", "cap")


def _reach(placed: DataFrame, num: int, den: int) -> DataFrame:
    """(key, block, least, most): the blocks that a block of a group of several can meet, itself included; a row per block."""
    blocks = placed.where("last > 0").groupBy("key", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("cap").alias("cap"))
    other = blocks.select("key", F.col("block").alias("b"), F.col("low").alias("b_low"))
    pairs = blocks.join(other, "key").where((F.col("b") >= F.col("block")) & ((F.col("b") == F.col("block")) | ((F.col("b_low") <= F.col("cap")) & (den * F.col("high") >= num * F.col("b_low"))))).select("key", "block", "b")
    up = pairs.groupBy("key", "block").agg(F.max("b").alias("most"))
    down = pairs.groupBy("key", F.col("b").alias("block")).agg(F.min("block").alias("least"))
    return up.join(down, ["key", "block"])


def _tree_pairs(groups: DataFrame, comps: DataFrame, n_comps: int, nodes: DataFrame, num: int, den: int, limit: int) -> DataFrame:
    """(a, b) of the likeliest pairs between components, written; rows with a null name the groups (b: key) where pairs were put off."""
    by_size = Window.partitionBy("key").orderBy("n", "nid")
    whole = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tagged = groups.join(lookup(comps, n_comps), F.col("nid") == F.col("node"), "left").select("key", "nid", "n", "cap", F.coalesce("component", "nid").alias("component"))
    mixed = tagged.withColumn("lo", F.min("component").over(whole)).withColumn("hi", F.max("component").over(whole)).where("lo <> hi")
    placed = mixed.withColumn("block", F.floor((F.row_number().over(by_size) - 1) / BLOCK)).withColumn("last", F.max("block").over(whole))
    reach = written(_reach(placed, num, den), "reach")
    paired = placed.join(lookup(reach, reach.count()), ["key", "block"], "left").withColumn("other", F.explode(F.sequence(F.coalesce("least", "block"), F.coalesce("most", "block"))))
    paired = paired.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "nid", "component", "n", "cap", (F.col("block") <= F.col("other")).alias("left"))
    paired = paired.join(nodes.where("n > 0").select("nid", "sig"), "nid")
    dealt = paired.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "nid")

    def solve(key, rows):
        nid, comp, n, cap, sig, left = rows
        if (comp == comp[0]).all():
            return
        order = np.argsort(n, kind="stable")
        nid, comp, n, cap, left = nid[order], comp[order], n[order], cap[order], left[order]
        found = list(candidates(n, cap, [np.frombuffer(sig[k], U64) for k in order], comp, left, num, den))
        if found:
            i, j, like = (np.concatenate(x) for x in zip(*found, strict=True))
            keep = likeliest(i, j, like, limit)
            yield np.minimum(nid[i[keep]], nid[j[keep]]), np.maximum(nid[i[keep]], nid[j[keep]]), [] if keep.all() else [key]

    def run(batches):
        def out(found):
            a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
            late = [k for f in found for k in f[2]]
            a, b = pa.array(a, pa.int64()), pa.array(b, pa.int64())
            if late:
                a, b = pa.concat_arrays([a, pa.nulls(len(late), pa.int64())]), pa.concat_arrays([b, pa.array(late, pa.int64())])
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        held, key = [], None  # at most two blocks of rows
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy() for c in ("key", "i", "j")])
            cols = [b.column(c).to_numpy() for c in ("nid", "component", "n", "cap")] + [np.array(b.column("sig").to_pylist(), object), b.column("left").to_numpy(zero_copy_only=False)]
            cut = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
            found = []
            for lo, hi in zip([0, *cut], [*cut, b.num_rows], strict=True):
                mine = tuple(k[:, lo])
                if held and mine != key:
                    found += solve(int(key[0]), [np.concatenate(x) for x in zip(*held, strict=True)])
                    held = []
                key = mine
                held.append([c[lo:hi] for c in cols])
            yield out(found)
        if held:
            yield out(list(solve(int(key[0]), [np.concatenate(x) for x in zip(*held, strict=True)])))

    out = written(dealt.mapInArrow(run, "a bigint, b bigint"), "candidates")
    drop(reach)
    return out


def _between(links: DataFrame, comps: DataFrame, n_comps: int, nodes: DataFrame, heat: np.ndarray, size: int, num: int, den: int) -> tuple[DataFrame, int]:
    """Components after all links between the stars' components, round by round."""
    texts = nodes.where("n > 0")
    groups = written(_prefix_groups(nodes, comps, n_comps, heat, size, num, den), "groups")
    free(nodes.sparkSession)
    limit, failed, found = FIRST, None, [links]
    while True:
        got = _tree_pairs(groups, comps, n_comps, nodes, num, den, limit)
        late = written(got.where("a is null").select(F.col("b").alias("key")).distinct(), "late")
        n_late = late.count()
        pairs = got.where("a is not null").distinct()
        if failed is not None:
            pairs = pairs.join(failed, ["a", "b"], "left_anti")
        pairs = written(pairs, "untried")
        linked = _verified(pairs, texts, size, num, den)
        if not linked.isEmpty():
            found.append(linked)
            old, comps = comps, components(union(found))
            n_comps = comps.count()
            drop(old)
        if not n_late:
            drop(groups, got, late, pairs, failed, *found)
            return comps, n_comps
        wrong = pairs.join(linked, ["a", "b"], "left_anti")
        old, failed = failed, written(wrong if failed is None else failed.unionByName(wrong), "failed")
        before, groups = groups, written(groups.join(lookup(late, n_late), "key", "left_semi"), "groups")
        drop(got, late, pairs, old, before)
        limit *= 8


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def jaccard_classes(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct text with words: tk (md5 of the text), n_shingles, component_id, and first_tk, the text of the document of that id.

    Where all ids of a component are null, its ``component_id`` is null and the least tk stands for it.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("tk"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bits = min(SKETCH_MOST, max(SKETCH_BITS, (4 * docs.count()).bit_length()))
    nodes = _nodes(rows.groupBy("tk").agg(F.min("text").alias("text")), shingle, bits)
    free(docs.sparkSession)
    heat = _heat(nodes, bits)
    texts = nodes.where("n > 0")

    links = _verified(_stars(nodes, num, den), texts, shingle, num, den)
    comps = components(links)
    n_comps = comps.count()
    comps, n_comps = _between(links, comps, n_comps, nodes, heat, shingle, num, den)

    known = texts.select("tk", "nid", "n").join(lookup(comps, n_comps), F.col("nid") == F.col("node"), "left").select("tk", "n", F.coalesce("component", "nid").alias("component"))
    least = rows.groupBy("tk").agg(F.min("doc_id").alias("own"))
    named = known.join(least, "tk")
    ids = named.groupBy("component").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "tk")).alias("first"))
    out = written(named.join(ids, "component").select("tk", F.col("n").alias("n_shingles"), F.col("first.own").alias("component_id"), F.col("first.tk").alias("first_tk")), "classes")
    drop(nodes, comps)
    return out


def text_key(text: str = "text"):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def jaccard_components(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Two documents link when ``den * intersection >= num * union`` over their sets of
    ``shingle``-word shingles (A-Z lower-cased).  A shorter text is one shingle; a text
    without words, or null, has none, links with nothing and is its own component.
    Exact copies always link.  Repeated rows each get a row.  Where all ids of a
    component are null, its ``component_id`` is null.  Other columns play no part.
    """
    classes = jaccard_classes(docs, shingle, num, den, doc_id, text)
    out = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("tk")).join(classes, "tk", "left")
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.when(F.col("n_shingles").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_per_component(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, that stand for their components: those with the smallest id.

    Texts without words stay.  Of repeated rows one stays, and where a component has no
    id at all, one row of its least text key.
    """
    classes = jaccard_classes(docs, shingle, num, den, doc_id, text)
    cols = docs.columns
    tk, first, least = (unused(x, cols) for x in ("tk", "first", "least"))
    few = classes.select(F.col("tk").alias(tk), F.col("component_id").alias(least), F.col("first_tk").alias(first))
    marked = docs.withColumn(tk, text_key(text)).join(few, tk, "left")
    empty = marked.where(F.col(first).isNull())
    # rows that share id and text may differ elsewhere: the one of the lowest hash stays, so that reruns agree
    same = marked.where((F.col(tk) == F.col(first)) & F.col(doc_id).eqNullSafe(F.col(least)))
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = same.groupBy(first).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in cols]), F.xxhash64(*hashed)).alias(tk)).select(f"{tk}.*")
    return empty.select(*cols).unionByName(one)
