"""Edit-aware token counts.

A document's pre-tokens are grouped into leaves of a segment tree, each with its
bytes and tokens; inner nodes hold sums.  An edit re-encodes only pre-tokens that it
can change: from the last pre-token that ends before it (its look-ahead may reach the
edit) until a boundary of the new text falls on an old one behind the edit, from
where on the old pre-tokens hold.  Then the touched leaf's path of sums is updated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import unused

LEAF = 64
MARGIN = 4  # the pattern looks no further than this beyond a pre-token, white space apart
CACHE = 200_000


def default_vocabulary() -> tuple[str, str]:
    """Path of a byte-level BPE's ranks and its pre-token pattern."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


class Counter:
    """Tokens of single pre-tokens, remembered in a bounded cache."""

    def __init__(self, vocabulary: str | bytes, pattern: str):
        """``vocabulary``: a file of ranks, or what it holds."""
        if isinstance(vocabulary, str):
            with open(vocabulary, "rb") as f:
                vocabulary = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.ranks, self.cache = ranks, {}

    def tokens(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = 1 if piece.encode() in self.ranks else len(self.encoding.encode_ordinary(piece))
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[piece] = n
        return n

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def pieces(self, text: str, start: int = 0) -> Iterator[str]:
        for m in self.pattern.finditer(text, start):
            yield m.group()


class Tree:
    """Segment tree over leaves [(lengths of pre-tokens, their tokens)]; node 1 is the root, sums are (characters, tokens, pre-tokens)."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter = text, counter
        self.encoded = 0  # pre-tokens encoded so far
        leaves, lengths, tokens = [], [], []
        get, count = counter.cache.get, counter.tokens
        for p in counter.pieces(text):
            lengths.append(len(p))
            tokens.append(get(p) or count(p))
            if len(lengths) == LEAF:
                leaves.append((lengths, tokens))
                self.encoded += LEAF
                lengths, tokens = [], []
        if lengths or not leaves:
            leaves.append((lengths, tokens))
            self.encoded += len(lengths)
        self._build(leaves)

    def _build(self, leaves) -> None:
        self.leaves = leaves
        size = 1
        while size < len(leaves):
            size *= 2
        self.size = size
        self.sums = [(0, 0, 0)] * (2 * size)
        for i, leaf in enumerate(leaves):
            self.sums[size + i] = (sum(leaf[0]), sum(leaf[1]), len(leaf[0]))
        for i in range(size - 1, 0, -1):
            self._add(i)

    def _add(self, i: int) -> None:
        a, b = self.sums[2 * i], self.sums[2 * i + 1]
        self.sums[i] = (a[0] + b[0], a[1] + b[1], a[2] + b[2])

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    @property
    def depth(self) -> int:
        return self.size.bit_length()

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one beyond the end) and the leaf's first character."""
        i, base = 1, 0
        while i < self.size:
            left = self.sums[2 * i][0]
            if char < base + left or not self.sums[2 * i + 1][2]:
                i = 2 * i
            else:
                base, i = base + left, 2 * i + 1
        return i - self.size, base

    def _restart(self, start: int) -> tuple[int, int, int]:
        """Leaf, index and first character of the pre-token from which on an edit at ``start`` may matter.

        What ends MARGIN characters before it or earlier stands, unless it is white
        space, whose look-ahead can reach the end of its run.
        """
        limit = start - MARGIN
        leaf, base = self._leaf_at(limit) if limit > 0 else (0, 0)
        while True:
            at, found = base, None
            for k, n in enumerate(self.leaves[leaf][0], 1):
                if at + n > limit:
                    break
                if self.text[at : at + n].strip():
                    found = (leaf, k, at + n)
                at += n
            if found or leaf == 0:
                return found or (0, 0, 0)
            leaf -= 1
            base -= self.sums[self.size + leaf][0]

    def _set(self, leaf: int, value) -> None:
        self.leaves[leaf] = value
        i = self.size + leaf
        self.sums[i] = (sum(value[0]), sum(value[1]), len(value[0]))
        while i > 1:
            i //= 2
            self._add(i)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replaces text[start:end]; returns how many pre-tokens were encoded anew."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        leaf, k, at = self._restart(start)
        head = (self.leaves[leaf][0][:k], self.leaves[leaf][1][:k])
        old_leaf, old_k, old_at = leaf, k, at  # the first old pre-token that is not yet passed
        lengths, tokens, met = [], [], False
        for p in self.counter.pieces(text, at):
            lengths.append(len(p))
            tokens.append(self.counter.tokens(p))
            at += len(p)
            if at - shift < end or at < start + len(new):
                continue
            while old_at < at - shift and old_leaf < len(self.leaves):
                if old_k < len(self.leaves[old_leaf][0]):
                    old_at += self.leaves[old_leaf][0][old_k]
                    old_k += 1
                else:
                    old_leaf, old_k = old_leaf + 1, 0
            if old_at == at - shift:
                met = True
                break
        if not met or old_leaf >= len(self.leaves):
            old_leaf, old_k = len(self.leaves) - 1, len(self.leaves[-1][0])
        rest = self.leaves[old_leaf]
        merged = (head[0] + lengths + rest[0][old_k:], head[1] + tokens + rest[1][old_k:])
        self.text = text
        self._set(leaf, merged)
        for between in range(leaf + 1, old_leaf + 1):
            self._set(between, ([], []))
        if len(merged[0]) > 16 * LEAF:  # a leaf that grew much is dealt out again
            parts = [(merged[0][i : i + LEAF], merged[1][i : i + LEAF]) for i in range(0, len(merged[0]), LEAF)]
            self._build([x for x in self.leaves[:leaf] if x[0]] + parts + [x for x in self.leaves[leaf + 1 :] if x[0]])
        self.encoded += len(lengths)
        return len(lengths)


def edited_counts(docs: DataFrame, edits: str, vocabulary: tuple[str, str] | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Token counts before and after each row's edits.

    ``edits`` names a column array<struct<start:int, stop:int, new:string>>, applied in
    order, offsets in characters of the text as it stands; offsets beyond its end mean
    its end, a null replacement is empty, null edits are none.  Returns ``keep`` columns
    (all others by default) and n_tokens, n_tokens_after, n_pretokens, n_reencoded.  A
    null text is empty.  Repeated rows each get a row.
    """
    made = ["n_tokens", "n_tokens_after", "n_pretokens", "n_reencoded"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text, edits, *made)]
    whole = unused("text", keep)
    changes = unused("edits", [*keep, whole])
    src = docs.select(*keep, F.col(text).alias(whole), F.col(edits).alias(changes))
    path, pattern = vocabulary or default_vocabulary()
    with open(path, "rb") as f:  # read once here: executors need no file of their own
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        counter = Counter(shared.value, pattern)
        for b in batches:
            rows = []
            for t, es in zip(b.column(whole), b.column(changes), strict=True):
                tree = Tree(t.as_py() or "", counter)
                n, first = tree.n_tokens, tree.encoded
                again = sum(tree.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "") for e in es.as_py() or [] if e)
                rows.append((n, tree.n_tokens, first, again))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=keep + made)

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name not in (whole, changes)] + [f"{m} bigint" for m in made])
    return src.mapInArrow(run, fields)
