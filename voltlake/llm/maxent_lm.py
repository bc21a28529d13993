"""Hashed maximum-entropy language model with class-factored softmax.

Every word falls into one of 256 slots, 16 classes of 16: the most frequent of 65,536 hash bins have slots of their
own, the others share. A word's probability is that of its class given the words before, that of its slot given
class and words before, and that of the word in its slot by count. The first two are maximum-entropy models over
hashed features: the word before, the two words before, and the word before that alone (the skip feature). Weights
are rows of 16 numbers at the hash of a feature (for slots: feature and class), so all words share a bounded table.

Training is by distributed gradient updates: tasks add up observed and expected counts of every weight over whole
training texts, the sums meet in one update per weight, `rate * log((observed + prior) / (expected + prior))`, the
gradient step in the log domain. At the first round the weights are zero, so the expectation of a class is its share of
a row's tokens, and that of a slot the sum over the classes seen in the row of their tokens times the slot's share of
that class. The driver holds the tables, whose size is fixed. Word counts are packed postings over all texts, see
`postings`; words never reach the driver.

The base score is the add-one unigram model. Rules: a null text counts as empty, whose one token is the end. Rows
without doc_id are held out. With nothing to learn from, all words are unknown and the model is uniform over slots.
Repeated rows are learned from and scored each time. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import postings
from .common import documents_of, staged
from .set_join import _runs, mix

END = b"\n"  # no word holds white space
BINS = 1 << 16
N_CLASS = N_MEMBER = 16
FEATURES = 3
ROWS = (1 << 14, 1 << 15)  # of a feature's weights for classes and for slots
PRIOR, RATES = 20.0, (0.5, 0.4)
SWEEP = 1 << 13  # tokens that are scored at once: their numbers stay in a core's cache
BOUND = 20.0  # of a weight
PIECE = 2048  # rows of a table that travel together
KEYS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(True)).alias("held_out")


def tokens(raw: bytes) -> list[bytes]:
    words = raw.lower().split()
    words.append(END)
    return words


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


@dataclass
class Shape:
    """Slots of the hash bins and the probabilities of classes and slots without context."""

    slot: np.ndarray
    log_class: np.ndarray
    log_member: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Shape:
        order = np.argsort(-counts, kind="stable")
        n = N_CLASS * N_MEMBER
        slot = np.zeros(BINS, np.int64)
        own = n // 2
        slot[order[:own]] = np.arange(own)
        rest = np.arange(BINS - own)
        around = rest % (2 * (n - own))
        slot[order[own:]] = own + np.where(around < n - own, around, 2 * (n - own) - 1 - around)  # heavy bins meet light ones
        mass = np.bincount(slot, counts, n).reshape(N_CLASS, N_MEMBER) + 1.0
        log_class, log_member = np.log(mass.sum(axis=1) / mass.sum()), np.log(mass / mass.sum(axis=1, keepdims=True))
        return Shape(slot, log_class.astype(np.float32), log_member.astype(np.float32))

    def slots_of(self, h: np.ndarray) -> np.ndarray:
        return self.slot[(h & np.uint64(BINS - 1)).astype(np.int64)]


class Sweep:
    """Rows of weights and outcomes of a run of tokens of one batch."""

    def __init__(self, shape: Shape, h: np.ndarray, first: np.ndarray):
        """`first`: where documents begin."""
        before, skip = np.roll(h, 1), np.roll(h, 2)
        before[first] = 0
        skip[first] = 0
        second = first + 1
        skip[second[second < len(h)]] = 0
        slot = shape.slots_of(h)
        self.kind, self.member = slot // N_MEMBER, slot % N_MEMBER
        seen = [mix(before * KEYS[0] + KEYS[3]), mix(before * KEYS[1] + mix(skip * KEYS[2])), mix(skip * KEYS[2] + KEYS[0])]
        shift = [np.uint64(64 - (r.bit_length() - 1)) for r in ROWS]
        within = self.kind.astype(np.uint64) * KEYS[1]
        self.rows = [[(s >> shift[0]).astype(np.int64) for s in seen], [(mix(s + within) >> shift[1]).astype(np.int64) for s in seen]]
        self.outcome = [self.kind, self.member]


def logits(shape: Shape, weights: list[np.ndarray], s: Sweep, level: int, a: int, b: int) -> np.ndarray:
    """Unnormalised log weights of the 16 outcomes at tokens a..b. Weights are bounded, so their exponentials are too."""
    x = np.tile(shape.log_class, (b - a, 1)) if level == 0 else shape.log_member[s.kind[a:b]]
    for table, rows in zip(weights[level], s.rows[level], strict=True):
        x += np.take(table, rows[a:b], axis=0)
    return x


def chances(shape: Shape, weights: list[np.ndarray], s: Sweep, level: int) -> np.ndarray:
    """Probabilities, one row per outcome and one column per token."""
    out = np.empty((N_CLASS, len(s.kind)), np.float32)
    for a in range(0, len(s.kind), SWEEP):
        b = min(a + SWEEP, len(s.kind))
        x = np.exp(logits(shape, weights, s, level, a, b))
        x /= x.sum(axis=1, keepdims=True)
        out[:, a:b] = x.T
    return out


def _sequence(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    words = [tokens(raw) for raw in raws]
    n = np.array([len(w) for w in words], np.int64)
    h = np.concatenate([np.empty(0, np.uint64), *map(_hashed, words)])
    return h, np.cumsum(n) - n, words


def _bins(batches):
    n = np.zeros(BINS, np.int64)
    for b in batches:
        h = _sequence(b.column(1).to_pylist())[0]
        n += np.bincount((h & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bin", "n"])


def _counts(shape_of, weights_of):
    """Observed and expected counts of every weight. Without weights, the expectation follows from the counts of classes."""

    def run(batches):
        shape, weights = shape_of.value, weights_of.value if weights_of else None
        seen = [np.zeros((FEATURES, r * N_CLASS), np.float32) for r in ROWS]
        meant = [np.zeros((N_CLASS, FEATURES, r), np.float64) for r in ROWS] if weights else None
        # Tokens of each class by row of a slot's weights: the hash lets several classes meet in one row.
        within = None if weights else np.zeros((FEATURES, ROWS[1] * N_CLASS), np.float64)
        for batch in batches:
            h, first, _ = _sequence(batch.column(1).to_pylist())
            if not len(h):
                continue
            s = Sweep(shape, h, first)
            for f in range(FEATURES if within is not None else 0):
                within[f] += np.bincount(s.rows[1][f] * N_CLASS + s.kind, minlength=ROWS[1] * N_CLASS)
            for level in (0, 1):
                for f in range(FEATURES):
                    seen[level][f] += np.bincount(s.rows[level][f] * N_CLASS + s.outcome[level], minlength=ROWS[level] * N_CLASS)
                for o, p in enumerate(chances(shape, weights, s, level) if weights else ()):
                    p = p.astype(np.float64)
                    for f in range(FEATURES):
                        meant[level][o, f] += np.bincount(s.rows[level][f], p, ROWS[level])
        for level in (0, 1):
            table = seen[level].reshape(FEATURES * ROWS[level], N_CLASS)
            if weights:
                expected = meant[level].transpose(1, 2, 0).reshape(table.shape)
            elif level == 0:
                expected = table.sum(axis=1, keepdims=True) * np.exp(shape.log_class)
            else:
                expected = within.reshape(table.shape) @ np.exp(shape.log_member)
            table = np.concatenate([table, expected], axis=1)
            for k in range(0, len(table), PIECE):
                body = zlib.compress(table[k : k + PIECE].astype("<f4").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([k], pa.int32()), pa.array([body], pa.binary())], ["level", "at", "body"])

    return run


def _sum(batches):
    for t in _runs(batches, 2):
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), "<f4").astype(np.float64) for x in t.column("body"))
        yield pa.RecordBatch.from_arrays([t.column("level").slice(0, 1).combine_chunks(), t.column("at").slice(0, 1).combine_chunks(), pa.array([total.astype("<f4").tobytes()], pa.binary())], ["level", "at", "body"])


@dataclass
class Model:
    shape: Shape
    weights: list[np.ndarray]

    def log10_slots(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each token's class and slot in context."""
        s, out = Sweep(self.shape, h, first), np.zeros(len(h))
        for a in range(0, len(h), SWEEP):
            b = min(a + SWEEP, len(h))
            for level in (0, 1):
                x = logits(self.shape, self.weights, s, level, a, b)
                out[a:b] += x[np.arange(b - a), s.outcome[level][a:b]] - np.log(np.exp(x).sum(axis=1))
        return out / np.log(10)


def train(docs: DataFrame) -> Model:
    """One closed-form round and one gradient round over all training texts per further rate."""
    sc = docs.sparkSession.sparkContext
    rows = documents_of(docs.where(~held_out()))
    bins = rows.mapInArrow(_bins, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BINS)
    counts[bins.column("bin").to_numpy()] = bins.column("n").to_numpy()
    shape = Shape.of(counts)
    weights = [np.zeros((FEATURES, r, N_CLASS), np.float32) for r in ROWS]
    for step, rate in enumerate(RATES):
        shared = sc.broadcast(weights) if step else None
        summed = rows.mapInArrow(_counts(sc.broadcast(shape), shared), "level int, at int, body binary")
        summed = summed.repartition("level", "at").sortWithinPartitions("level", "at").mapInArrow(_sum, "level int, at int, body binary")
        tables = [np.zeros((FEATURES * r, N_CLASS * 2), np.float64) for r in ROWS]
        for row in summed.toArrow().to_pylist():
            part = np.frombuffer(row["body"], "<f4").reshape(-1, tables[row["level"]].shape[1])
            tables[row["level"]][row["at"] : row["at"] + len(part)] += part
        for level in (0, 1):
            seen, meant = tables[level][:, :N_CLASS], tables[level][:, N_CLASS:]
            # The prior stands on both sides, so it only holds weights of few tokens back; for slots it is the classes' average.
            usual = np.exp(shape.log_class) if level == 0 else np.exp(shape.log_member).mean(axis=0)
            change = rate * np.log((seen + PRIOR * usual) / (meant + PRIOR * usual))
            weights[level] = np.clip(weights[level] + change.reshape(weights[level].shape), -BOUND, BOUND).astype(np.float32)
    return Model(shape, weights)


def _block(model_of):
    def per_block(b: pa.RecordBatch):
        raws, out = b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
        h, first, words = _sequence(raws)
        score = model_of.value.log10_slots(h, first)
        score = np.add.reduceat(score, first) if len(first) else np.zeros(0)
        n = pa.array([len(w) for w in words], pa.int64())
        head = postings.head_of({"doc_id": b.column(0), "held_out": b.column(2), "n_tokens": n, "slots": pa.array(score)})
        return words, head, (~out).astype(np.int64)

    return per_block


def _add_totals(known: dict[bytes, int], words: bytes, body: bytes) -> None:
    for w, n in zip(postings.words_of(words), postings.totals_of(body).tolist(), strict=True):
        if n:
            known[w] = known.get(w, 0) + n


def _slot_sums(model_of):
    """Tokens and distinct words of every slot, over the training words of a bucket."""

    def run(batches):
        total = np.zeros((N_CLASS * N_MEMBER, 2), np.int64)

        def add(known: dict[bytes, int]) -> None:
            slot = model_of.value.shape.slots_of(_hashed(list(known)))
            np.add.at(total, (slot, 0), np.fromiter(known.values(), np.int64, len(known)))
            np.add.at(total, (slot, 1), 1)

        bucket, known = None, {}
        for b in batches:
            for key, words, body in zip(*(b.column(c).to_pylist() for c in ("bucket", "words", "body")), strict=True):
                if key != bucket:
                    add(known)
                    bucket, known = key, {}
                _add_totals(known, words, body)
        add(known)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total[:, 0]), pa.array(total[:, 1])], ["slot", "n", "v"])

    return run


def _values(model_of, rest: np.ndarray):
    """Per document: known tokens, sum of log10(c + 1), and sum of the log10 mass of the words' slots."""

    def run(batches):
        bucket, known = None, {}
        for b in batches:
            out = []
            for key, kind, block, words, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == postings.HEAD:
                    out.append((block, b"", b"", body))
                    continue
                if key != bucket:
                    bucket, known = key, {}
                if kind == postings.TOTALS:
                    _add_totals(known, words, body)
                    continue
                words = postings.words_of(words)
                c = np.fromiter((known.get(w, 0) for w in words), np.float64, len(words))
                slot = model_of.value.shape.slots_of(_hashed(words))
                out.append(postings.partial_row(block, body, np.stack([c > 0, np.log10(c + 1), rest[slot]], axis=1)))
            if out:
                yield postings.partial(out)

    return run


def _finish(train_tokens: int, distinct: int):
    def run(batches):
        for t in _runs(batches, 1):
            kept, (known, counted, mass) = postings.summed(t, 3)
            n = kept["n_tokens"].to_numpy()
            cols = {
                "doc_id": kept["doc_id"],
                "held_out": kept["held_out"],
                "n_tokens": kept["n_tokens"],
                "n_known": pa.array(np.rint(known).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(n), train_tokens, np.int64)),
                "base_score": pa.array(counted - n * np.log10(train_tokens + distinct + 1)),
                "score": pa.array(kept["slots"].to_numpy() + counted - mass),
            }
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed size
    rows = documents_of(docs).select("doc_id", "text", held_out())
    rows = staged(postings.blocks(rows, _block(shared)), "postings")
    totals = postings.by_bucket(rows.where(F.col("kind") == postings.TOTALS)).mapInArrow(_slot_sums(shared), "slot bigint, n bigint, v bigint")
    sums = totals.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toArrow()
    n, v = np.zeros(N_CLASS * N_MEMBER, np.int64), np.zeros(N_CLASS * N_MEMBER, np.int64)
    n[sums.column("slot").to_numpy()], v[sums.column("slot").to_numpy()] = sums.column("n").to_numpy(), sums.column("v").to_numpy()
    # Unknown words of a slot share one count, as they do in the base model.
    parts = postings.by_bucket(rows).mapInArrow(_values(shared, np.log10(n + v + 1)), postings.PARTIAL)
    return postings.by_block(parts).mapInArrow(_finish(int(n.sum()), int(v.sum())), RESULT)
