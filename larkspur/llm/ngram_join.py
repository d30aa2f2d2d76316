"""N-gram Jaccard join by prefix trees, and the near-duplicate classes it gives.

A document is the set of its distinct word shingles.  Sets are put into one
global order (how often a token occurs by a fixed-size histogram over all
documents, then the token's hash).  Two sets with a Jaccard similarity of at least t share a
token within their prefixes in that order, so documents meet by prefix tokens;
whoever meets is compared in compressed prefix trees, down which many sets go together.

A token shared by k documents doesn't give k(k-1)/2 pairs.  First all are
compared with one pivot (the least digest).  When the links found so have been
merged, those in other components are compared with further pivots, another one for each
token and round.  At last members of components that are still different and met under
a token are compared with each other, in tiles.  Every pair that could link is thus either
compared or already in one component, so the components are exact.

Similar sets share not one prefix token but many: of two sets of equal size and t = 3/4, one
in nine of their tokens.  Who meets others under fewer tokens than a pair needs is left out of that pair.
Before sets are sent anywhere, parity signatures (a few bits per token) bound the
symmetric difference of a pair from below; who can't link by it is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import lean, materialize, named, part_of, release
from .wordhash import set_digest, shingles, slices, word_hashes

#: Counters of the histogram that orders the tokens: 1 MB whatever the input.
COUNTERS = 1 << 18
_PART = 1024
#: Tokens of the sets in one block, about; pairs of no more than FEW_TOKENS in all are dealt by their first alone.
BLOCK_TOKENS, FEW_TOKENS = 200_000, 4_000_000
#: Rows of a token in one tile of the last round.
TILE = 4096
#: Bits of a signature: the power of two from so many times the set's size on.
BITS_PER_TOKEN = 4
#: Rounds with further pivots, at most, before components are compared in tiles; a round
#: that links less than this share of the rows that it had is the last, and none is held where
#: the rows left make at most so many pairs each.
PIVOT_ROUNDS, WORTH, CHEAP = 4, 0.005, 64
#: Rows of a token in one group of the first round: a token that is far more frequent is dealt to several.
SPLIT = 2048
#: Groups to which the rows of such a token are dealt where they meet one row of it.
SALTS = 16
#: Least shared tokens of a row that go with it, so that a pair comes out under its first one only.
FIRST_TOKENS = 8
#: Tokens of at most so many rows are paired by a join, of more rows in tiles with signatures.
FEW = 16


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


class PrefixTree:
    """A compressed trie of token arrays in one global order.

    A node holds a run of tokens, shared by all sets below it, and the least and
    greatest size of these sets.
    """

    __slots__ = ("children", "depth", "least", "most", "run", "sets")

    def __init__(self, run: np.ndarray, depth: int, size: int) -> None:
        self.run, self.depth = run, depth  # depth: tokens up to the end of the run
        self.children: dict[int, PrefixTree] = {}
        self.sets: list[tuple[int, int]] = []
        self.least = self.most = size

    @classmethod
    def build(cls, sets: list[tuple[int, np.ndarray]]) -> PrefixTree:
        root = cls(np.zeros(0, dtype=np.uint64), 0, len(sets[0][1]) if sets else 0)
        for key, tokens in sets:
            root._insert(key, tokens)
        return root

    def _insert(self, key: int, tokens: np.ndarray) -> None:
        node, at, size = self, 0, len(tokens)
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            if at == size:
                node.sets.append((key, size))
                return
            child = node.children.get(int(tokens[at]))
            if child is None:
                leaf = PrefixTree(tokens[at:], size, size)
                leaf.sets.append((key, size))
                node.children[int(tokens[at])] = leaf
                return
            width = min(len(child.run), size - at)
            differ = child.run[:width] != tokens[at : at + width]
            same = int(differ.argmax()) if differ.any() else width
            if same < len(child.run):  # the run parts here
                upper = PrefixTree(child.run[:same], child.depth - len(child.run) + same, child.least)
                upper.most = child.most
                child.run = child.run[same:]
                upper.children[int(child.run[0])] = child
                node.children[int(tokens[at])] = child = upper
            node, at = child, at + same

    def join(self, probes: list[np.ndarray], num: int, den: int) -> Iterator[tuple[int, int, int]]:
        """(place of the probe, key, overlap) of all sets whose overlap with a probe is at least num/den of both sizes' sum.

        All probes go down the tree together.  What a run shares with each of them is counted once for all sets
        below it, by an index from tokens to probes; a probe leaves a subtree where even full agreement of all that remains
        can't reach the overlap that its smallest set needs.
        """
        sizes = np.array([len(p) for p in probes], dtype=np.int64)
        index: dict[int, list[int]] = {}
        for i, tokens in enumerate(probes):
            for token in tokens.tolist():
                index.setdefault(token, []).append(i)
        stack = [(self, np.arange(len(probes)), np.zeros(len(probes), dtype=np.int64))]
        while stack:
            node, active, overlap = stack.pop()
            shared = [i for token in node.run.tolist() if token in index for i in index[token]]
            if shared:
                overlap = overlap + np.bincount(shared, minlength=len(probes))[active]
            need = -(-(num * (sizes[active] + node.least)) // den)
            keep = overlap + np.minimum(node.most - node.depth, sizes[active] - overlap) >= need
            active, overlap = active[keep], overlap[keep]
            if not len(active):
                continue
            for key, other in node.sets:
                for i in np.flatnonzero(den * overlap >= num * (sizes[active] + other)):
                    yield int(active[i]), key, int(overlap[i])
            stack += [(child, active, overlap) for child in node.children.values()]


class Order:
    """The global order: bucket count, then hash.  Immutable and of fixed size."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        hot = max(SPLIT, 4 * int(counts.mean()))
        self.groups = np.where(counts > hot, -(-counts // SPLIT), 1).astype(np.int64)

    def salts(self, tokens: np.ndarray, digest: int) -> np.ndarray:
        """The group in which a set meets others under each token; -1 where a token has only one."""
        groups = self.groups[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)]
        return np.where(groups > 1, (digest & ((1 << 62) - 1)) % groups, -1).astype(np.int32)

    def sort(self, tokens: np.ndarray) -> np.ndarray:
        """tokens: distinct and ascending."""
        return tokens[np.argsort(self.counts[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")]


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    words, at = word_hashes(batch.column("text"))
    for i in range(batch.num_rows):
        yield shingles(words[at[i] : at[i + 1]], width)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to a few MB of text each."""
    for batch in batches:
        yield from slices(batch, size=2 << 20)


def signature(tokens: np.ndarray) -> bytes:
    """Parities of the number of tokens in each of a power of two of cells."""
    size = 64
    while size < BITS_PER_TOKEN * len(tokens):
        size <<= 1
    cells = np.bincount(((tokens >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(cells.astype(np.uint8), bitorder="little").tobytes()


def fold(words: np.ndarray, size: int) -> np.ndarray:
    """Signatures (rows of 64-bit words) with half the cells, until there are `size` words."""
    while words.shape[-1] > size:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def allowed(n1, n2, t: Fraction):
    """The greatest symmetric difference of sets that link."""
    return n1 + n2 + 2 * (-(t.numerator * (n1 + n2)) // (t.denominator + t.numerator))


def _nodes_and_counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, dtype=np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
        for batch in _parts(batches):
            node, size, sig, pending = [], [], [], []
            for tokens in _sets(batch, width):
                node.append(set_digest(tokens) if len(tokens) else None)
                sig.append(signature(tokens) if len(tokens) else None)
                size.append(len(tokens))
                pending.append(tokens)
                if len(tokens) > 1 << 16 or len(pending) >= 256:
                    counts += np.bincount((np.concatenate(pending) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
                    pending = []
            if pending:
                counts += np.bincount((np.concatenate(pending) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            n = len(node)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        parts = range(0, COUNTERS, _PART)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.int64()), pa.nulls(len(parts), pa.binary()), pa.array([i // _PART for i in parts], pa.int32()), pa.array([counts[i : i + _PART].tobytes() for i in parts], pa.binary())], schema=schema)

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task's histogram parts, before and after the shuffle."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            counts = np.frombuffer(counts, dtype=np.int64)
            total[part] = total[part] + counts if part in total else counts
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])


def _prefixes(width: int, order, t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets of this task: copies within it go once
        for batch in _parts(batches):
            out = {k: [] for k in ("token", "salt", "node", "n", "pos")}
            for tokens in _sets(batch, width):
                n = len(tokens)
                if not n or (digest := set_digest(tokens)) in seen:
                    continue
                seen.add(digest)
                p = n - ceil_div(t.numerator * n, t.denominator) + 1
                first = order.value.sort(tokens)[:p]
                out["token"].append(first.view(np.int64))
                out["salt"].append(order.value.salts(first, digest))
                out["node"].append(np.full(p, digest, dtype=np.int64))
                out["n"].append(np.full(p, n, dtype=np.int32))
                out["pos"].append(np.arange(p, dtype=np.int32))
            if out["token"]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out.values()], names=list(out))

    return run


def _may_link(n1, p1, n2, p2, t: Fraction):
    """Whether sizes and places of a shared prefix token allow a link."""
    small, big = np.minimum(n1, n2), np.maximum(n1, n2)
    need = -(-(t.numerator * (n1 + n2)) // (t.denominator + t.numerator))
    bound = 1 + np.minimum(n1 - p1, n2 - p2) - 1 + np.minimum(p1, p2)
    return (t.denominator * small >= t.numerator * big) & (bound >= need)


def least_shared(n1, n2, t: Fraction):
    """Prefix tokens that two sets share at least if they link.

    Up to n - need of a set's tokens aren't common, so the first p + need - n common
    ones lie in its prefix of p tokens; the lesser of both numbers lies in both prefixes.
    """
    num, den = t.numerator, t.denominator
    need = -(-(num * (n1 + n2)) // (num + den))
    return np.minimum(need + 1 + (-num * n1) // den, need + 1 + (-num * n2) // den)


def least_shared_sql(n1: str, n2: str, t: Fraction) -> str:
    num, den = t.numerator, t.denominator
    need = f"(({num} * ({n1} + {n2}) + {num + den - 1}) div {num + den})"
    return f"least({need} + 1 - (({num} * {n1} + {den - 1}) div {den}), {need} + 1 - (({num} * {n2} + {den - 1}) div {den}))"


def _stars(t: Fraction):
    """Rows sorted by token, salt and node, of groups with two nodes or more: each row with its group's first (the pivot).

    A row comes out when the next one is known; what is kept is one pivot and
    one row, however many rows a group has.  All rows of a token with several groups
    come out, with `hot` and `more`: they meet again in the next rounds.
    """
    names = ("token", "salt", "node", "n", "pos")
    schema = pa.schema([("a", pa.int64()), ("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("na", pa.int32()), ("meet", pa.bool_()), ("more", pa.bool_()), ("hot", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.zeros(0, dtype=np.int64) for k in names}  # the last row, before it its pivot if that is another
        third = False  # whether the held row is its group's third or later

        def out(x, take, pivot, more):
            i, j = np.flatnonzero(take), pivot[take]
            meet = (i != j) & _may_link(x["n"][i], x["pos"][i], x["n"][j], x["pos"][j], t)
            cols = [x["node"][j], x["token"][i], x["node"][i], x["n"][i].astype(np.int32), x["pos"][i].astype(np.int32), x["n"][j].astype(np.int32), meet, (more[i] & (i != j)) | (x["salt"][i] >= 0), x["salt"][i] >= 0]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            x = {k: np.concatenate([held[k], batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)]) for k in names}
            first = np.ones(len(x["token"]), dtype=bool)
            first[1:] = (x["token"][1:] != x["token"][:-1]) | (x["salt"][1:] != x["salt"][:-1])
            again = ~first
            again[1:] &= x["node"][1:] == x["node"][:-1]
            again[0] = False
            kept = len(held["token"])
            x = {k: v[~again] for k, v in x.items()}
            first = first[~again]
            n = len(first)
            pivot = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            place = np.arange(n) - pivot
            if kept == 2 and third:
                place[1] = 2
            more = place >= 2
            more[:-1] |= (place[:-1] == 1) & ~first[1:]
            last = n - 1
            take = ~first
            take[:-1] |= ~first[1:]  # pivots, too
            take |= x["salt"] >= 0
            if kept == 2:
                take[0] = False  # this one came out before
            take[last] = False
            if take.any():
                yield out(x, take, pivot, more)
            third = bool(place[last] >= 2)
            keep = [last] if pivot[last] == last else [pivot[last], last]
            held = {k: v[keep] for k, v in x.items()}
        n = len(held["token"])
        if n == 2 or (n and held["salt"][0] >= 0):
            yield out(held, np.arange(n) == n - 1, np.zeros(n, dtype=np.int64), np.full(n, third))

    return run


def _near(t: Fraction):
    """Of pairs a, node, n, na, sig_a, sig, shared_a, shared those that may link by shared tokens and signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            n1, n2, c1, c2 = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("na", "n", "shared_a", "shared"))
            enough = np.minimum(c1, c2) >= least_shared(n1, n2, t)
            batch, most = batch.filter(pa.array(enough)), allowed(n1, n2, t)[enough]
            for x, y, m in zip(batch.column("sig_a"), batch.column("sig"), most, strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                size = min(len(x), len(y))
                keep.append(bool(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum() <= m))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "node", "n", "na"])

    return run


def _tile_pairs(t: Fraction):
    """Rows sorted by token and tile pair: pairs of different components that may link by size, place and signature.

    A group has the rows of two tiles at most; a pair of rows of the same tile comes from
    the group of that tile with itself.
    """
    schema = pa.schema([("a", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("na", pa.int32())])

    def pairs(rows: list[tuple]) -> Iterator[tuple]:
        token = rows[0][0]
        before = {r[3]: {x for x in r[9] if x < token} for r in rows}
        by_size: dict[int, list[tuple]] = {}
        for row in rows:
            by_size.setdefault(len(row[7]), []).append(row)
        packed = {k: (np.frombuffer(b"".join(r[7] for r in v), dtype=np.uint64).reshape(len(v), -1), *(np.array([r[i] for r in v], dtype=np.int64) for i in (3, 4, 5, 6, 8, 10))) for k, v in by_size.items()}
        for size, (sig, node, n, pos, root, tile, shared) in packed.items():
            for other in (x for x in packed if x <= size):
                sig2, node2, n2, pos2, root2, tile2, shared2 = packed[other]
                own = fold(sig, sig2.shape[1])
                for i in range(len(node)):
                    m = (root2 != root[i]) & _may_link(n[i], pos[i], n2, pos2, t) & (np.minimum(shared[i], shared2) >= least_shared(n[i], n2, t))
                    if rows[0][1] != rows[0][2]:
                        m &= tile2 != tile[i]
                    if other == size:
                        m[: i + 1] = False
                    at = np.flatnonzero(m)
                    at = at[np.bitwise_count(sig2[at] ^ own[i]).sum(axis=1) <= allowed(n[i], n2[at], t)]
                    mine = before[int(node[i])]
                    for j in at:
                        if not mine.isdisjoint(before[int(node2[j])]):
                            continue  # it comes out under a lesser token
                        x, y = (int(node[i]), int(n[i])), (int(node2[j]), int(n2[j]))
                        (a, na), (b, nb) = (x, y) if x < y else (y, x)
                        yield a, b, nb, na

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("token", "i", "j", "node", "n", "pos", "root", "sig", "tile", "firsts", "shared")
        group: list[tuple] = []
        out: set[tuple] = set()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*sorted(out), strict=True)) or [(), (), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if group and group[0][:3] != row[:3]:
                    out.update(pairs(group))
                    group = []
                    if len(out) > 50_000:
                        yield flush()
                group.append(row)
        if group:
            out.update(pairs(group))
        yield flush()

    return run


def _tokens_of(width: int, order, wanted):
    """(node, tokens) of the documents whose id may be wanted; of a set of this task once."""
    schema = pa.schema([("node", pa.int64()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _parts(x.filter(pa.array(wanted.value.has(x.column("key").to_numpy(zero_copy_only=False)))) for x in batches):
            node, tokens = [], []
            for found in _sets(batch, width):
                if len(found) and (digest := set_digest(found)) not in seen:
                    seen.add(digest)
                    node.append(digest)
                    tokens.append(order.value.sort(found).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(tokens, pa.binary())], schema=schema)

    return run


class Bits:
    """A set of hashed keys, of at most MOST bits: it may hold too many, never too few."""

    MOST = 1 << 26

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame, n: int) -> Bits:
        """keys: one column of at most n hashes (long)."""
        size = 1 << 16
        while size < cls.MOST and size < 16 * n:
            size <<= 1
        bit = F.pmod(F.col(keys.columns[0]), F.lit(size))
        rows = keys.select(F.shiftright(bit, 6).cast("int").alias("w"), (bit % 64).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).collect()
        words = np.zeros(size // 64, dtype=np.int64)
        for r in rows:
            words[r["w"]] = r["bits"]
        return cls(words)

    def has(self, keys: np.ndarray) -> np.ndarray:
        bit = keys & np.int64(64 * len(self.words) - 1)
        return (self.words[bit >> 6] >> (bit & 63)) & 1 == 1


def _compare(t: Fraction):
    """Links between the probes and the sets of a block: so many of them that all that link, directly or through others of the block, are connected."""
    num, den = t.numerator, t.denominator + t.numerator

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        sets = {int(k): np.frombuffer(v, dtype=np.uint64) for k, v in zip(block["node"], block["tokens"], strict=True)}
        nodes = sorted({int(k) for k in block["node"][block["probe"]]})
        root = {k: k for k in sets}

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        found = []
        for i, other, _ in PrefixTree.build(sorted(sets.items())).join([sets[k] for k in nodes], num, den):
            a, b = find(nodes[i]), find(other)
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((nodes[i], other))
        return pd.DataFrame({"u": np.array([x for x, _ in found], dtype=np.int64), "v": np.array([y for _, y in found], dtype=np.int64)})

    return run


def _written(pairs: DataFrame, name: str) -> DataFrame:
    """Pairs, written, with their number and the tokens of the sets to be compared."""
    return materialize(pairs, name, n=F.count("*"), tokens=F.coalesce(F.sum("n"), F.lit(0)))


class NgramJoin:
    """Jaccard self-join of documents on word shingles.

    documents: doc_id (integer) and text; further columns are ignored.  Null and
    empty texts, and texts of white space, have an empty set and link with
    nothing.  A row without doc_id takes no part in links.  Rows with equal sets
    are one node, whatever their number.  Digests have 64 bits: among n different
    sets two coincide with a chance of about n*n/2^65.
    """

    def __init__(self, documents: DataFrame, threshold: Fraction = Fraction(3, 4), width: int = 5) -> None:
        self.t, self.width = Fraction(threshold), width
        self.docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("key"))
        self.spark = documents.sparkSession
        first = materialize(self.docs.mapInArrow(lean(_nodes_and_counts(width)), "doc_id long, key long, node long, n long, sig binary, part int, counts binary"), "nodes")
        #: doc_id, key (a hash of the text), node (null for an empty set), n of every row.
        self.nodes = first.where("part IS NULL").select("doc_id", "key", "node", "n")
        #: node, its signature and the least doc_id that has it.
        self.firsts = first.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.first("sig").alias("sig"), F.min("doc_id").alias("doc_id"))
        kind = "part int, counts binary"
        parts = first.where("part IS NOT NULL").select("part", "counts").mapInArrow(lean(_add_counts), kind).repartition(16, "part").mapInArrow(lean(_add_counts), kind).collect()
        counts = np.zeros(COUNTERS, dtype=np.int64)
        for part, found in parts:
            counts[part * _PART : (part + 1) * _PART] += np.frombuffer(found, dtype=np.int64)
        self.order = self.spark.sparkContext.broadcast(Order(counts))

    def roots(self) -> DataFrame:
        """(node, root) of every node with a link: the components of all links."""
        rows = self.docs.where("doc_id IS NOT NULL").mapInArrow(lean(_prefixes(self.width, self.order, self.t)), "token long, salt int, node long, n int, pos int")
        kind = "a long, token long, node long, n int, pos int, na int, meet boolean, more boolean, hot boolean"
        met = materialize(rows.repartition(F.col("token"), F.col("salt")).sortWithinPartitions("token", "salt", "node").mapInArrow(lean(_stars(self.t)), kind), "met")
        #: node, sig, doc_id and the number of the prefix tokens under which the node meets others.
        self.known = materialize(self.firsts.join(met.groupBy("node").agg(F.count("*").cast("int").alias("shared")), "node"), "known")
        self.sets: list[DataFrame] = []
        links = self._verified(self._near(met.where("meet").select("a", "node", "n", "na")))
        roots = connected_components(links)
        rest, tokens = self._mixed(met.where("more").select("token", "node", "n", "pos", "hot"), roots, 0)
        release(met, links)
        num, den = self.t.numerator, self.t.denominator
        need = F.ceil(F.expr(f"({num} * (n + p.n)) / {num + den}D"))
        bound = F.expr("least(n - pos, p.n - p.pos) + least(pos, p.pos)")
        for turn in range(PIVOT_ROUNDS):
            had = tokens.size["rows"]
            if tokens.size["pairs"] <= CHEAP * had:
                break
            star = self._dealt(rest, tokens.select("token", "hot", "p")).where(F.expr(f"root <> p.root AND {den} * least(n, p.n) >= {num} * greatest(n, p.n)") & (bound >= need))
            near = self._near(star.select(F.col("p.node").alias("a"), "node", "n", F.col("p.n").alias("na")))
            if near.stats["n"] < WORTH * had:
                break  # what these few pairs link is found in the tiles
            further = self._verified(near)
            if not further.stats["n"]:
                break
            before = rest, tokens
            roots = connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(further))
            rest, tokens = self._mixed(self._dealt(rest.drop("root"), tokens.select("token", "hot")), roots, turn + 1)
            release(*before, further)
            if further.stats["n"] < WORTH * had:
                break
        if not tokens.size["rows"]:
            return roots
        rest = self._dealt(rest, tokens.select("token", "hot", "k")).join(self.known.select("node", "shared"), "node")
        x, y = rest.where(F.col("k") <= FEW).alias("x"), rest.where(F.col("k") <= FEW).alias("y")
        need = F.ceil(F.expr(f"({num} * (x.n + y.n)) / {num + den}D"))
        bound = F.expr("least(x.n - x.pos, y.n - y.pos) + least(x.pos, y.pos)")
        fits = F.expr(f"x.token = y.token AND x.root <> y.root AND x.node < y.node AND {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) AND least(x.shared, y.shared) >= {least_shared_sql('x.n', 'y.n', self.t)}")
        few = self._near(x.join(y, fits & (bound >= need)).select(F.col("x.node").alias("a"), F.col("y.node").alias("node"), F.col("y.n").alias("n"), F.col("x.n").alias("na")))
        many = rest.where(F.col("k") > FEW).withColumn("tiles", F.ceil(F.col("k") / F.lit(TILE)).cast("int"))
        firsts = many.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("token")), 1, FIRST_TOKENS).alias("firsts"))
        many = many.join(self.known.select("node", "sig").join(firsts, "node"), "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles").cast("long")).cast("int"))
        columns = ["node", "n", "pos", "root", "sig", "tile", "firsts", "shared"]
        many = many.select("token", *columns, F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        many = many.select("token", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), *columns)
        many = many.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "node").mapInArrow(lean(_tile_pairs(self.t)), "a long, node long, n int, na int")
        pairs = _written(few.unionByName(many).distinct(), "pairs")
        release(few)
        if not pairs.stats["n"]:
            return roots
        further = self._verified(pairs)
        return connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(further)) if further.stats["n"] else roots

    def _dealt(self, rows: DataFrame, tokens: DataFrame) -> DataFrame:
        """rows joined with tokens, one row each: the rows of a hot token are dealt to SALTS groups, which the adaptive skew join can cut further."""
        salted = tokens.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0)))).drop("hot")
        return rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).otherwise(0)).join(salted, ["token", "salt"]).drop("salt")

    def _mixed(self, rows: DataFrame, roots: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """rows with each node's root, and the tokens under which different components meet: their number of rows k and a pivot p.

        The `size` of the tokens has their rows and the pairs that these make.
        """
        rows = materialize(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rest")
        pivot = F.min_by(F.struct("node", "n", "pos", "root"), F.xxhash64("node", "token", F.lit(turn))).alias("p")
        tokens = rows.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("k"), F.max("hot").alias("hot"), pivot).where("low <> high").select("token", "k", "hot", "p")
        tokens = materialize(tokens, "mixed", rows=F.sum("k"), pairs=F.sum(F.expr("k * (k - 1) / 2")))
        tokens.size = {k: v or 0 for k, v in tokens.stats.items()}
        return rows, tokens

    def _near(self, pairs: DataFrame) -> DataFrame:
        """pairs: a, node, n, na, some of them several times.  Those that may link by their signatures, once each."""
        own = self.known.select("node", "sig", "shared")
        pairs = pairs.repartition("node").groupBy("a", "node").agg(F.max("n").alias("n"), F.max("na").alias("na"))  # dealt as the join wants it
        known = pairs.join(own, "node").join(own.withColumnsRenamed({"node": "a", "sig": "sig_a", "shared": "shared_a"}), "a")
        return _written(known.mapInArrow(lean(_near(self.t)), "a long, node long, n int, na int"), "near")

    def _sets(self, members: DataFrame, n: int) -> DataFrame:
        """(node, tokens in the global order) of all nodes of `members`, at most n, and maybe others; a text is tokenised once for all comparisons.

        A row may come twice.
        """
        new = members.select("node").distinct()
        for known in self.sets:
            new = new.join(known.select("node"), "node", "left_anti")
        key = F.xxhash64("doc_id").alias("key")
        bits = Bits.of(self.known.select("node", "doc_id").join(new, "node", "left_semi").select(key), n)
        if bits.words.any():
            wanted = self.spark.sparkContext.broadcast(bits)
            self.sets.append(materialize(self.docs.where("doc_id IS NOT NULL").select(key, "text").mapInArrow(lean(_tokens_of(self.width, self.order, wanted)), "node long, tokens binary"), "sets"))
        return reduce(DataFrame.unionByName, self.sets)

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """pairs: a, node, n (size of node's set), written.  Links that connect all of them that link.

        Pairs are dealt to blocks of about BLOCK_TOKENS by a (by a and node where one a has more); a block has one prefix tree
        of all its sets, which all its a go through together.
        """
        if not pairs.stats["n"]:
            return materialize(self.spark.createDataFrame([], "u long, v long"), "links", n=F.count("*"))
        blocks = F.lit(-(-int(pairs.stats["tokens"]) // BLOCK_TOKENS))
        if pairs.stats["tokens"] <= FEW_TOKENS:
            spread = pairs.select("a", "node", F.pmod(F.xxhash64("a"), blocks).alias("block"))
        else:
            shares = pairs.groupBy("a").agg(F.ceil(F.sum("n") / F.lit(BLOCK_TOKENS)).cast("int").alias("shares"))
            share = F.pmod(F.xxhash64("node"), F.col("shares").cast("long"))
            spread = pairs.join(shares, "a").select("a", "node", F.pmod(F.xxhash64(F.col("a"), share), blocks).alias("block"))
        members = spread.select("block", "node", F.lit(False).alias("probe")).unionByName(spread.select("block", F.col("a").alias("node"), F.lit(True).alias("probe")))
        members = members.groupBy("block", "node").agg(F.max("probe").alias("probe"))
        found = members.join(self._sets(members, 2 * pairs.stats["n"]), "node").groupBy("block").applyInPandas(_compare(self.t), "u long, v long")
        links = materialize(found, "links", n=F.count("*"))
        release(pairs)
        return links

    def classes(self) -> DataFrame:
        """doc_id, key, n_shingles, component_id (least doc_id of the class) of every row."""
        docs = self.nodes.join(self.roots(), "node", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("root", "node").alias("root"))
        docs = materialize(docs, "docs")
        least = materialize(docs.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
        linked = docs.where("root IS NOT NULL AND doc_id IS NOT NULL").join(least, "root").select("doc_id", "key", "n_shingles", "component_id")
        return linked.unionByName(docs.where("root IS NULL OR doc_id IS NULL").select("doc_id", "key", "n_shingles", F.col("doc_id").alias("component_id")))


def near_duplicate_classes(documents: DataFrame, threshold: Fraction = Fraction(3, 4), width: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.  See NgramJoin for nulls, empties and repeats."""
    return NgramJoin(documents, threshold, width).classes().drop("key")


def drop_near_duplicates(documents: DataFrame, threshold: Fraction = Fraction(3, 4), width: int = 5) -> DataFrame:
    """documents without all but the least doc_id of each class; columns as they are.

    Rows that repeat a kept doc_id and text all stay; rows without doc_id stay.
    """
    gone = NgramJoin(documents, threshold, width).classes().where("doc_id <> component_id").select("doc_id", "key").distinct()
    rows = documents.select(F.struct(*named(documents.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    return rows.join(gone, ["doc_id", "key"], "left_anti").select(*[part_of("row", c) for c in documents.columns])
