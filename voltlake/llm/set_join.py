"""Exact Jaccard self-join of word-shingle sets by pigeonhole over a partitioned universe.

Sets of sizes lo..hi form a band. Two sets of a band with Jaccard similarity t or more differ in at most
H = 2 * hi * (1 - t) / (1 + t) shingles, so if the universe of shingles is hashed into more than H segments, they
agree wholly on one. A set is indexed by the hash of its subset in each segment of its own band and, as bands are wide
enough for partners to lie in the next band at most, of the band above where its size can have partners there.

Allocation: agreeing on a segment counts one unit, agreeing up to one deletion two; any allocation of more units than
a set can differ from its partners finds every pair. All segments start with one unit, and each set takes back
those it can spare from its largest groups (`_allocate`). Where sets that share a segment turn out to be unrelated
and would cost more comparisons than entries for one-deletion neighbourhoods of other segments, those sets give the
costly segment nothing and cheap segments two units (`_reallocate`).

Verification compares whole sets of 64-bit shingle hashes. Copies are compared as one set. In a group of sets that
share a segment, each is first compared with one partner. What is then in different components is compared chunk by
chunk, first within chunks and then between them, where the largest component of a group need not meet itself. A piece
of work returns a spanning forest of likely links, which are verified. Where one is wrong, its tree alone, which is never
larger than the piece, is compared by ends of hashes, then by whole sets. No step writes all pairs.

Rules: a null or blank text has no shingles, size 0, and is linked with nothing; it is its own component. With fewer
words than a shingle has, the whole sequence is the one shingle. Rows without doc_id come back with a null
component and no links. Repeated ids fall into one component by their smallest row. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_of, slots, staged
from .graph import components

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
BAND_OF = "int(shiftrightunsigned(sig, 56))"
WIDTH = 1.25  # of a band: its largest size over its smallest


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(32))) * A
    x = (x ^ (x >> np.uint64(29))) * B
    return x ^ (x >> np.uint64(32))


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, lower-cased in A-Z only."""
    words = raw.lower().split()  # bytes: splits at space and 09-0D, lowers ASCII
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for i in range(min(width, len(h))):
        out = mix(out + h[i : i + n]) * C
    return np.unique(mix(out))


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least num / den."""

    num: int
    den: int

    def reach(self, hi: int) -> int:
        """Most shingles in which two linked sets of at most `hi` can differ."""
        return 2 * hi * (self.den - self.num) // (self.den + self.num)

    def compatible(self, n: Column, m: Column) -> Column:
        return self.den * F.least(n, m) >= self.num * F.greatest(n, m)

    def spare(self, hi: int) -> int:
        """Segments beyond those the pigeonhole needs: so many of a set may be empty without being indexed."""
        return (self.reach(hi) + 9) // 10

    def segments(self, hi: int) -> int:
        return self.reach(hi) + 1 + self.spare(hi)

    def bands(self, n: int) -> list[tuple[int, int, int]]:
        """(band, segments, spare ones) that index a set of n shingles."""
        lo, band = 1, 0
        while (hi := max(lo, int(lo * WIDTH))) < n:
            lo, band = hi + 1, band + 1
        above = max(hi + 1, int((hi + 1) * WIDTH))
        out = [(band, self.segments(hi), self.spare(hi))]
        if self.den * n >= self.num * (hi + 1):
            out.append((band + 1, self.segments(above), self.spare(above)))
        return out


def _segment_bounds(s: np.ndarray, m: int) -> np.ndarray:
    """Places in the sorted set where the m segments, equal ranges of the hash, begin and end."""
    return np.searchsorted((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32), np.arange(m + 1))


def _signatures(s: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each segment's subset of a set, and its size."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s * C))])
    at = _segment_bounds(s, m)
    return _key(sums[at[1:]] - sums[at[:-1]], band, np.arange(m, dtype=np.uint64)), np.diff(at)


def _index(s: np.ndarray, threshold: Threshold) -> tuple[np.ndarray, int, int]:
    """The hashes that index a set: of its segments that aren't empty, or of all if more are empty than are spare.
    With them, how many are empty in its own band and in the one above.

    Two sets that both leave out empty segments still agree on one that is indexed, as at most the spare ones are
    empty in both.
    """
    out, empty = [np.empty(0, np.uint64)], [0, 0]
    for k, (band, m, spare) in enumerate(threshold.bands(len(s)) if len(s) else ()):
        sig, size = _signatures(s, band, m)
        empty[k] = int((size == 0).sum())
        out.append(sig if empty[k] > spare else sig[size > 0])
    return np.concatenate(out), *empty


def _key(sums: np.ndarray, band: int, segment: np.ndarray) -> np.ndarray:
    """Hash of segment subsets, the band in the top eight bits."""
    h = mix(sums + mix((segment + np.uint64(band << 32)) * B))
    return (h >> np.uint64(8)) | np.uint64(band << 56)


SIGNED = "kind int, bucket int, ids binary, sigs binary, n bigint, k1 bigint, k2 bigint, e0 bigint, e1 bigint, doc_id bigint"
MEMBER, ENTRY, SHARED = 0, 1, 2


def _signed_rows(kind: int, **cols) -> pa.RecordBatch:
    size = max(len(c) for c in cols.values())
    kinds = {"bucket": pa.int32(), "ids": pa.binary(), "sigs": pa.binary()}
    names = [c.split()[0] for c in SIGNED.split(", ")][1:]
    out = [pa.array(cols.get(c, [None] * size), kinds.get(c, pa.int64())) for c in names]
    return pa.RecordBatch.from_arrays([pa.array([kind] * size, pa.int32()), *out], ["kind", *names])


def _sign(threshold: Threshold, width: int, buckets: int):
    """Of a batch: a row per document with its size and the hash of its set, and its index entries.

    Entries are packed into one row per bucket of hashes. A hash that several documents of a batch share is sent to
    its bucket once, with the smallest document; the others are known to share it and go past the buckets.
    """

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            n, k1, k2, sigs, e0, e1 = [], [], [], [], [], []
            for raw in b.column(1).to_pylist():
                s = shingle_set(raw, width)
                n.append(len(s))
                k1.append(mix(s * A).sum(dtype=np.uint64))
                k2.append(mix(s * B).sum(dtype=np.uint64))
                for out, value in zip((sigs, e0, e1), _index(s, threshold), strict=True):
                    out.append(value)
            if not ids:
                continue
            signed = lambda k: np.array(k, np.uint64).view(np.int64)
            yield _signed_rows(MEMBER, n=n, k1=signed(k1), k2=signed(k2), e0=e0, e1=e1, doc_id=ids)
            named = [k for k, i in enumerate(ids) if i is not None]
            sig = np.concatenate([np.empty(0, np.uint64), *(sigs[k] for k in named)])
            doc = np.repeat(np.array([ids[k] for k in named], np.int64), [len(sigs[k]) for k in named])
            order = np.lexsort((doc, sig))
            sig, doc = sig[order], doc[order]
            again = np.concatenate([[False], sig[1:] == sig[:-1]]) if len(sig) else np.empty(0, bool)
            yield _signed_rows(SHARED, k1=sig[again].view(np.int64), doc_id=doc[again])
            own = np.concatenate([again[1:], [False]])[~again] if len(sig) else again  # others of the batch share it
            sig, doc = sig[~again], doc[~again]
            yield _signed_rows(SHARED, k1=sig[own].view(np.int64), doc_id=doc[own])
            bucket = (sig % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = [k for k in range(buckets) if cuts[k] < cuts[k + 1]]
            parts = [order[cuts[k] : cuts[k + 1]] for k in used]
            yield _signed_rows(ENTRY, bucket=used, ids=[doc[p].tobytes() for p in parts], sigs=[sig[p].tobytes() for p in parts])

    return run


def _share(batches):
    """Of the entries of a bucket, those whose hash another batch has too; all other rows as they are."""
    held: list[tuple[bytes, bytes]] = []
    bucket = None

    def shared():
        sig = np.concatenate([np.frombuffer(s, np.uint64) for s, _ in held])
        doc = np.concatenate([np.frombuffer(d, np.int64) for _, d in held])
        order = np.argsort(sig, kind="stable")
        sig, doc = sig[order], doc[order]
        same = sig[1:] == sig[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        return _signed_rows(SHARED, k1=sig[keep].view(np.int64), doc_id=doc[keep])

    for b in batches:
        entry = pc.equal(b.column("kind"), ENTRY)
        yield b.filter(pc.invert(entry))
        b = b.filter(entry)
        for key, ids, sigs in zip(*(b.column(c).to_pylist() for c in ("bucket", "ids", "sigs")), strict=True):
            if key != bucket and held:
                yield shared()
                held.clear()
            bucket = key
            held.append((sigs, ids))
    if held:
        yield shared()


def _sets(width: int, threshold: Threshold):
    """Whole set, its size, the last 4 bytes of its hashes, sorted, and, for each of its bands, the profile: 2 bytes of every segment's hash, then its size (255 at most)."""

    def run(batches):
        for b in batches:
            sets, n, ends, bands, profiles = [], [], [], [], []
            for raw in b.column(1).to_pylist():
                s = shingle_set(raw, width)
                mine = threshold.bands(len(s)) if len(s) else []
                sets.append(s.tobytes())
                n.append(len(s))
                ends.append(np.unique(s.astype(np.uint32)).tobytes())
                bands.append([band for band, _, _ in mine])
                profiles.append([])
                for band, m, _ in mine:
                    sig, size = _signatures(s, band, m)
                    profiles[-1].append(sig.astype(np.uint16).tobytes() + np.minimum(size, 255).astype(np.uint8).tobytes())
            cols = [pa.array(sets, pa.binary()), pa.array(n, pa.int64()), pa.array(ends, pa.binary()), pa.array(bands, pa.list_(pa.int32())), pa.array(profiles, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["d", "shingles", "n", "ends", "bands", "profiles"])

    return run


def _verify(threshold: Threshold):
    def run(batches):
        for b in batches:
            pairs = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in pairs]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    one = pairs.join(sets.select(F.col("d").alias("b"), F.col("shingles").alias("y")), "b")
    two = one.join(sets.select(F.col("d").alias("a"), F.col("shingles").alias("x")), "a")
    return two.select("a", "b", "x", "y").mapInArrow(_verify(threshold), "a bigint, b bigint")


def _runs(batches, keys: int):
    """Runs of rows with equal first columns, as tables; the input is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        cuts = [0, *new.tolist(), len(b)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[i] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _common(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values of each of the others are in x, which is sorted; none of the others is empty."""
    every = np.concatenate(others)
    held = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
    return np.add.reduceat(held, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)


def _linked(x: np.ndarray, y: np.ndarray, threshold: Threshold) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return threshold.den * both >= threshold.num * (len(x) + len(y) - both)


LIKELY = "tree bigint, a array<bigint>, b array<bigint>, members array<bigint>"


def _compare(threshold: Threshold, detail: str):
    """Links of a piece of work that join its components to each other: a spanning forest, never all pairs.

    Two segments whose hashes differ hold at least one shingle of difference, two if they are of equal size, and
    never fewer than their sizes differ by. Of the pairs that this bound leaves, a set returns the one with the least
    difference to each other component of the piece, and the components become one. With `ENDS` a pair must also share
    enough ends of hashes, as a shingle in both sets has its end in both; with `WHOLE` it must be linked.

    A row is a tree of the forest: its links and all its sets. Two sets of a piece in different trees aren't linked.
    """

    def run(batches):
        for t in _runs(batches, 3):
            d, n, comp, chunk, full = (t.column(c).to_numpy() for c in ("d", "n", "component", "chunk", "full"))
            root = np.unique(comp, return_inverse=True)[1]
            i, j, within = (t.column(c)[0].as_py() for c in ("i", "j", "within"))
            left, other = np.flatnonzero(chunk == i), np.flatnonzero((chunk == j) & (chunk != i))
            if not len(left) or (root == root[0]).all():
                continue
            table = np.stack([np.frombuffer(p, np.uint8) for p in t.column("profile").to_pylist()])
            m = table.shape[1] // 3
            sig, size = np.ascontiguousarray(table[:, : 2 * m]).view(np.uint16), table[:, 2 * m :].astype(np.int16)
            whole = [np.frombuffer(x, np.uint64) for x in t.column(WHOLE).to_pylist()] if detail == WHOLE else None
            ends = whole if detail == WHOLE else [np.frombuffer(x, np.uint32) for x in t.column(ENDS).to_pylist()] if detail == ENDS else []
            found: list[tuple[int, int]] = []
            for x in left:
                y = np.concatenate([left[d[left] > d[x]], other]) if within else other
                y = y[(root[y] != root[x]) & (full[y] | full[x])]
                low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                y = y[threshold.den * low >= threshold.num * high]
                if not len(y):
                    continue
                gap = np.abs(size[y] - size[x])
                gap = np.where(gap, gap, 2) * (sig[y] != sig[x])
                reach = (n[x] + n[y]) * (threshold.den - threshold.num) // (threshold.den + threshold.num)
                gap = gap.sum(axis=1)
                y, gap = y[gap <= reach], gap[gap <= reach]
                if detail != PROFILE and len(y):
                    both = _common(ends[x], [ends[k] for k in y])
                    both += (n[x] - len(ends[x])) if detail == ENDS else 0  # ends that several hashes share
                    may = both * (threshold.num + threshold.den) >= threshold.num * (n[x] + n[y])
                    y, gap = y[may], -both[may]
                for k in y[np.argsort(gap, kind="stable")].tolist():
                    if root[k] != root[x] and (whole is None or _linked(whole[x], whole[k], threshold)):
                        found.append((int(x), k))
                        root[root == root[k]] = root[x]
            band = t.column("sig")[0].as_py() >> 56 & 255
            trees: dict[int, list[tuple[int, int]]] = {}
            for pair in found:
                trees.setdefault(int(root[pair[0]]), []).append(pair)
            for r, pairs in trees.items():
                members = np.unique(d[root == r])
                tree = _key(mix(members.view(np.uint64) * A).sum(dtype=np.uint64, keepdims=True), band, np.full(1, 1 << 30, np.uint64)).view(np.int64)
                a, b = np.sort(d[np.array(pairs)], axis=1).T
                lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (a, b, members)]
                yield pa.RecordBatch.from_arrays([pa.array(tree), *lists], ["tree", "a", "b", "members"])

    return run


CHUNK = 1024  # rows of a group that meet in one piece of work; larger groups are compared chunk by chunk
CHUNK_SHINGLES = 2 << 20  # of a chunk, about, if its sets are long


def _chunks(k: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(k / CHUNK), F.ceil(shingles / CHUNK_SHINGLES), F.lit(1)).cast("int")


def _place(chunks: str | Column) -> Column:
    return F.pmod(F.xxhash64("d"), chunks).cast("int")


def _different(rows: DataFrame) -> DataFrame:
    """`rows` less groups with the very members of another group."""
    groups = rows.groupBy("sig").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("d", "full").cast("decimal(38,0)")).alias("x"), F.min("d").alias("y"), F.max("d").alias("z")
    )
    # The band stays apart, as profiles are compared within it.
    one = groups.groupBy(F.expr(BAND_OF), "k", "x", "y", "z").agg(F.min("sig").alias("sig"), F.max("shingles").alias("shingles"))
    return rows.join(one.select("sig", "k", "shingles"), "sig")


def _within_chunks(rows: DataFrame) -> DataFrame:
    """`rows` with their pieces of work: the chunks i and j that meet, and whether sets of chunk i meet each other."""
    rows = _different(rows).withColumn("chunk", _place(_chunks(F.col("k"), F.col("shingles"))))
    return rows.withColumns({"i": F.col("chunk"), "j": F.col("chunk"), "within": F.lit(True)})


def _between_chunks(rows: DataFrame) -> DataFrame:
    """As `_within_chunks`, for all pairs of a group. Its largest component is cut apart from the rest, as it is settled
    within itself: chunks of the rest meet each other and those of the component, the first of them with themselves."""
    parts = rows.groupBy("sig", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    top = parts.groupBy("sig").agg(F.max(F.struct("k", "s", "component")).alias("top"), F.sum("k").alias("all_k"), F.sum("s").alias("all_s"))
    top = top.select(
        "sig",
        F.col("top.component").alias("most"),
        _chunks(F.col("top.k"), F.col("top.s")).alias("inner"),
        _chunks(F.col("all_k") - F.col("top.k"), F.col("all_s") - F.col("top.s")).alias("rest"),
    )
    rows = _different(rows).join(top, "sig").withColumn("settled", F.col("component") == F.col("most"))
    rows = rows.withColumn("chunk", F.when(F.col("settled"), F.col("rest") + _place("inner")).otherwise(_place("rest")))
    last = F.when(F.col("settled"), F.col("rest")).otherwise(F.col("rest") + F.col("inner")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last))).where("chunk != other")
    rows = rows.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    return rows.withColumn("within", F.col("j") == F.col("rest"))


PROFILE, ENDS, WHOLE = "profile", "ends", "shingles"  # what the sets of a piece of work are compared by


def _likely(rows: DataFrame, profiles: DataFrame, threshold: Threshold, detail: str = PROFILE) -> DataFrame:
    """Trees of pairs from the pieces of work `rows` that may be linked, with `WHOLE` that are."""
    rows = rows.withColumn("band", F.expr(BAND_OF)).join(profiles, ["d", "band"])
    rows = rows.select("sig", "i", "j", "within", "chunk", "d", "n", "component", "full", *{PROFILE, detail})
    rows = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return rows.mapInArrow(_compare(threshold, detail), LIKELY)


def _pairs(likely: DataFrame) -> DataFrame:
    return likely.select("tree", F.explode(F.arrays_zip("a", "b")).alias("p")).select("tree", "p.a", "p.b")


def _failed(likely: DataFrame, good: DataFrame) -> DataFrame:
    """(sig, d): the sets of trees with a pair that isn't linked, which stood for others of the tree."""
    wrong = _pairs(likely).join(good, ["a", "b"], "left_anti").select("tree").distinct()
    return likely.join(wrong, "tree").select(F.col("tree").alias("sig"), F.explode("members").alias("d")).distinct()


ROW_COST = 500  # a shuffled index entry costs as much as so many comparisons of segments


def _segment_rows(threshold: Threshold):
    def run(batches):
        for b in batches:
            for d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = np.frombuffer(raw, np.uint64)
                for band, m, _ in threshold.bands(len(s)):
                    sig = _signatures(s, band, m)[0].view(np.int64)
                    cols = [np.full(m, d, np.int64), np.full(m, band, np.int32), np.arange(m, dtype=np.int32), np.full(m, m, np.int32), sig]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["d", "band", "segment", "m", "sig"])

    return run


def _neighbourhoods(threshold: Threshold):
    """Hashes of the upgraded segments of a set, `full`, and of those segments less any one shingle. Segments that differ
    in one shingle agree whole against less one; two that agree less one each differ in two, which counts for nothing."""

    def run(batches):
        for b in batches:
            for d, raw, band, segments in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = np.frombuffer(raw, np.uint64)
                parts = mix(s * C)
                at = _segment_bounds(s, next(m for k, m, _ in threshold.bands(len(s)) if k == band))
                out, full = [], []
                for g in segments:
                    part = parts[at[g] : at[g + 1]]
                    out.append(_key(np.append(part.sum(dtype=np.uint64), part.sum(dtype=np.uint64) - part), band, np.array([g + (1 << 31)], np.uint64)))
                    full.append(np.arange(len(part) + 1) == 0)
                sig, full = np.concatenate(out).view(np.int64), np.concatenate(full)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.full(len(sig), d, np.int64)), pa.array(full)], ["sig", "d", "full"])

    return run


def _reallocate(mixed: DataFrame, sets: DataFrame, threshold: Threshold, row_cost: float) -> DataFrame:
    """Replace the groups that cost more to compare than to index anew.

    In each band the segments T with the costliest groups, at most half of all, may get nothing; as many of the
    cheapest others, U in order of cost, get two units. A set that lies in h costly groups of T is entered under the
    one-deletion neighbourhoods of the first h segments of U. Two sets that share s costly groups have s <= h in both,
    lose s units and gain s, so the pigeonhole still holds.
    """
    groups = mixed.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).withColumn("band", F.expr(BAND_OF)).join(_band_table(mixed, threshold), "band")
    # k sets cost k * k / 2 comparisons of m segments, or k entries for each of the shingles of two segments.
    costly = staged(groups.where(F.col("k") * F.col("m") > row_cost * 4 * (F.col("hi") / F.col("m") + 1)).select("sig", "k"), "costly")
    if costly.isEmpty():
        return mixed
    reps = mixed.join(costly.select("sig"), "sig", "left_semi").select("d").distinct()
    rows = sets.select("d", "shingles").join(reps, "d", "left_semi").mapInArrow(_segment_rows(threshold), "d bigint, band int, segment int, m int, sig bigint")
    rows = staged(rows.join(mixed.select("sig", "d"), ["sig", "d"]).join(costly, "sig"), "segments")
    # One row per band and segment: bounded by the largest set, not by the number of sets.
    costs = rows.groupBy("band", "segment", "m").agg(F.sum("k").alias("cost"))
    order = Window.partitionBy("band")
    costs = costs.withColumn("rank", F.row_number().over(order.orderBy(F.desc("cost"), "segment")))
    skipped = costs.where("rank <= m div 2").select("band", "segment")
    every = costs.select("band", "m").distinct().select("band", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("segment"))
    rest = every.join(skipped, ["band", "segment"], "left_anti").join(costs.select("band", "segment", "cost"), ["band", "segment"], "left")
    ranked = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("cost", F.lit(0)), "segment"))), lambda x: x["segment"])
    upgraded = rest.groupBy("band").agg(ranked.alias("order"))
    gone = staged(rows.join(skipped, ["band", "segment"]).select("sig", "d", "band"), "costly-groups")
    new = gone.groupBy("d", "band").count().join(upgraded, "band").join(sets.select("d", "shingles"), "d")
    new = new.select("d", "shingles", "band", F.slice("order", F.lit(1), F.col("count").cast("int")).alias("segments"))
    entries = new.mapInArrow(_neighbourhoods(threshold), "sig bigint, d bigint, full boolean")
    entries = entries.join(mixed.select("d", "n", "component").distinct(), "d").select("sig", "d", "n", "component", "full")
    kept = mixed.select("sig", "d", "n", "component", "full").join(gone.select("sig").distinct(), "sig", "left_anti")
    return _mixed(kept.unionByName(entries))


def _band_table(df: DataFrame, threshold: Threshold) -> DataFrame:
    """band, lo, hi, segments m, spare, reach: one row per band, all that fit the hashes."""
    lo, rows = 1, []
    for band in range(256):
        hi = max(lo, int(lo * WIDTH))
        if hi < 1 << 40:
            rows.append((band, lo, hi, threshold.segments(hi), threshold.spare(hi), threshold.reach(hi)))
        lo = hi + 1
    names = ("band int", "lo bigint", "hi bigint", "m bigint", "spare bigint", "reach bigint")
    return F.broadcast(df.sparkSession.createDataFrame(rows, ", ".join(names)))


def _allocate(groups: DataFrame, member: DataFrame, threshold: Threshold) -> DataFrame:
    """Take sets out of the groups they can do without, the largest first.

    A set differs from any partner in at most h shingles and at most e segments are empty in both, so they share
    m - h - e indexed segments or more. Leaving out one fewer than that, in the same order of group size for all
    sets, keeps the smallest group that two partners share. Most sets that share a passage and no more leave all.
    """
    sizes = groups.groupBy("sig").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    empty = member.where("doc_id = rep").select(F.col("rep").alias("d"), "e0", "e1").dropDuplicates(["d"])
    rows = groups.join(sizes, "sig").join(empty, "d").withColumn("band", F.expr(BAND_OF)).join(_band_table(groups, threshold), "band")
    partner = F.least("hi", F.expr(f"n * {threshold.den} div {threshold.num}"))
    differ = F.floor((F.col("n") + partner) * (threshold.den - threshold.num) / (threshold.den + threshold.num))
    absent = F.least("spare", F.when(F.col("n") >= F.col("lo"), F.col("e0")).otherwise(F.col("e1")))
    order = Window.partitionBy("d", "band").orderBy(F.desc("k"), "sig")
    rows = rows.withColumn("spared", F.col("m") - differ - absent - 1).withColumn("place", F.row_number().over(order))
    return rows.where("place > spared").select("sig", "d", "n")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of groups that hold more than one component and a set by its whole segment."""
    groups = rows.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("full").alias("z"))
    groups = groups.where("x < y AND z").select("sig")
    return rows.join(groups, "sig")


def _across(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(sig, d, n, full, component) of the groups with sets of several components."""
    rows = groups.select("sig", "d", "n", "full").join(found.withColumnRenamed("node", "d"), "d", "left")
    return staged(_mixed(rows.withColumn("component", F.coalesce("component", "d"))), "mixed-groups")


def _joined(found: DataFrame, good: DataFrame) -> DataFrame:
    """(node, component) after the links `good`: only the components they join are named anew."""
    nodes = good.select(F.col("a").alias("node")).unionByName(good.select(F.col("b").alias("node"))).distinct()
    nodes = nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    ends = [nodes.withColumnsRenamed({"node": x, "component": y}) for x, y in (("a", "x"), ("b", "y"))]
    edges = staged(good.join(ends[0], "a").join(ends[1], "b").select("x", "y").where("x != y").distinct(), "joins")
    if edges.isEmpty():
        return found
    named = components(edges, "x", "y").select(F.col("node").alias("component"), F.col("component").alias("new"))
    every = found.unionByName(nodes).distinct()
    return staged(every.join(named, "component", "left").select("node", F.coalesce("new", "component").alias("component")), "components")


def linked_components(
    docs: DataFrame, num: int = 9, den: int = 10, width: int = 3, row_cost: float = ROW_COST
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; sets of `width`-word shingles link at similarity num / den."""
    t = Threshold(num, den)
    signed = documents_of(docs).mapInArrow(_sign(t, width, 4 * slots(docs.sparkSession)), SIGNED)
    # Rows without a bucket are dealt evenly.
    signed = signed.repartition(F.coalesce(F.col("bucket"), F.xxhash64("doc_id", "k1"))).sortWithinPartitions("bucket")
    signed = staged(signed.mapInArrow(_share, SIGNED), "signatures")
    rows = signed.where(F.col("kind") == MEMBER).select("doc_id", "n", "k1", "k2", "e0", "e1")
    classes = rows.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    member = staged(
        rows.join(staged(classes, "classes"), ["n", "k1", "k2"], "left").select("doc_id", "n", "e0", "e1", F.coalesce("rep", "doc_id").alias("rep")), "members"
    )

    # Sets that share a segment with another set: (sig, d, n).
    shared = signed.where(F.col("kind") == SHARED).select("doc_id", F.col("k1").alias("sig"))
    named = shared.join(member.where("doc_id IS NOT NULL").select("doc_id", "rep", "n").distinct(), "doc_id")
    groups = staged(named.select("sig", F.col("rep").alias("d"), "n").distinct(), "segment-groups")
    groups = staged(_allocate(groups, member, t), "segment-groups")
    first = groups.groupBy("sig").agg(F.min(F.struct("d", "n")).alias("first"), F.max("d").alias("last")).where("first.d < last")
    groups = staged(groups.join(first.select("sig", "first"), "sig"), "segment-groups")

    # Written first, so that its size is known and the join can spare shuffling the texts where it is small.
    ids = staged(groups.select(F.col("d").alias("doc_id")).distinct(), "set-ids")
    sets = documents_of(docs).join(ids, "doc_id").dropDuplicates(["doc_id"])
    sets = staged(sets.mapInArrow(_sets(width, t), "d bigint, shingles binary, n bigint, ends binary, bands array<int>, profiles array<binary>"), "sets")
    profiles = sets.select("d", F.explode(F.arrays_zip("bands", "profiles")).alias("p"))
    profiles = profiles.select("d", F.col("p.bands").alias("band"), F.col("p.profiles").alias("profile"))

    stars = groups.where(F.col("d") != F.col("first.d")).where(t.compatible(F.col("n"), F.col("first.n")))
    stars = stars.select(F.col("first.d").alias("a"), F.col("d").alias("b")).distinct()
    found = staged(components(staged(_verified(stars, sets, t), "links")), "components")
    mixed = _reallocate(_across(groups.withColumn("full", F.lit(True)), found), sets, t, row_cost)
    mixed = staged(mixed.select("sig", "d", "n", "full", "component"), "mixed-groups")
    reached = mixed.drop("component")
    # Within chunks first: what they join is one component where chunks meet, so that few links are left to find there.
    failed = []
    for pieces in (_within_chunks, _between_chunks):
        if pieces is _between_chunks:
            large = reached.groupBy("sig").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
            large = large.where((F.col("k") > CHUNK) | (F.col("s") > CHUNK_SHINGLES)).select("sig")
            mixed = _across(reached.join(large, "sig", "left_semi"), found)
            if mixed.isEmpty():
                break
        likely = staged(_likely(pieces(mixed), profiles, t), "likely-pairs")
        good = staged(_verified(_pairs(likely).select("a", "b").distinct(), sets, t), "links")
        failed.append(_failed(likely, good))
        found = _joined(found, good)
    # A likely pair that isn't linked stood for others of its tree, which is compared again by more: at last by whole
    # sets, where no pair is wrong.
    sizes = sets.select("d", "n")
    for detail in (ENDS, WHOLE):
        trees = failed[0] if len(failed) == 1 else failed[0].unionByName(failed[1]).distinct()
        trees = _across(trees.join(sizes, "d").withColumn("full", F.lit(True)), found)
        if trees.isEmpty():
            break
        whole = trees.withColumns({"i": F.lit(0), "j": F.lit(0), "chunk": F.lit(0), "within": F.lit(True)})
        likely = staged(_likely(whole, profiles.join(sets.select("d", detail), "d"), t, detail), "likely-pairs")
        good = _pairs(likely).select("a", "b").distinct()
        if detail == ENDS:
            good = staged(_verified(good, sets, t), "links")
            failed = [_failed(likely, good)]
        found = _joined(found, good)
    return member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id")
    )
