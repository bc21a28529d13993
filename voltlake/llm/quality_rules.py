"""Quality rules: fixed counts of a text, and a hashed n-gram logistic regression trained on labelled quality rows.

*Features.* A text is hashed words, pairs of neighbouring words and runs of four characters, each family into its own
range of `2 ** BITS` buckets. A feature is the root of its share among its family, so each family has length one
whatever the length of the text.

*Training.* About `LABELLED` documents of each label are learned from: those whose id hashes below a share found from
the counts of both labels. A fixed number of shards, dealt by a hash of the text, hold them; in every round each shard
runs passes of gradient steps from the common weights in an order fixed by that hash, and the weights of the shards are
averaged. A quarter of the sample is kept out of it and fits the calibration, a slope and an offset on the raw score
(Platt's), weighted so that both labels count as often as they do among all labelled documents.

*Verdict.* A document that passes the base rule stays if its calibrated probability of good quality reaches `KEEP`.
Documents are scored in Arrow batches; weights are of fixed size.

Rules: a null text has no words and fails the base rule; so does an empty one. Labels other than 0 and 1, null ids and
ids labelled both ways teach nothing; repeated labels count once, repeated documents each time. With no document of one
of the labels nothing is learned: the probability is null and the base rule decides alone. An empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import decode, documents_of, prepare, staged

BITS = 15  # of a family's buckets
FAMILIES = 3
SIZE = FAMILIES << BITS
LABELLED = 4000  # documents learned from for each label, about
SHARDS, ROUNDS, PASSES = 16, 3, 3
RATE, SHRINK = 4.0, 1e-5
CALIBRATION = 4  # one in so many sampled documents calibrates
KEEP = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50  # words; percent of words in repeated windows
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
MEMO_BYTES = 8 << 20
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words(dict):
    """Numbers of words, their hashes, and how many bytes they take; cleared between texts once that is too much."""

    def __init__(self):
        self.bytes, self.hashes = 0, []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        self.bytes += len(word) + 100
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if self.bytes > MEMO_BYTES:
            self.clear()
            self.__init__()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of three that are found twice or more, the first one included."""
    if len(ids) < 4:
        return 0
    _, pair = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1] << 32 | ids[2:], return_inverse=True, return_counts=True)
    found = count[window] > 1
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : len(found) + i] |= found
    return int(covered.sum())


def base_counts(raw: bytes, words: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    b = np.frombuffer(raw, np.uint8)
    chars = int(((b & 0xC0) != 0x80).sum()) - int(BLANK[b].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), chars, int(SYMBOLS[b].sum()), len(lines) - len(set(lines)), repeated_words(ids)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def _roots(h: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a family of 64-bit hashes."""
    at = (h >> np.uint64(64 - BITS)).astype(np.int64)
    if len(at) < 4000:
        at, n = np.unique(at, return_counts=True)
    else:
        n = np.bincount(at, minlength=1 << BITS)
        at = np.flatnonzero(n)
        n = n[at]
    return at + (family << BITS), np.sqrt(n / max(1, len(h)))


def features(raw: bytes, ids: np.ndarray, memo: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features."""
    h = np.fromiter((memo.hashes[i] for i in ids.tolist()), np.uint64, len(ids))
    letters = np.frombuffer(decode(raw).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    run = letters[:-3] | letters[1:-2] << np.uint64(21) | letters[2:-1] << np.uint64(42)
    run = (run * M1 ^ letters[3:]) * M2
    run = (run ^ run >> np.uint64(31)) * M1
    parts = [_roots(h * M1, 0), _roots((h[:-1] * M1 ^ h[1:]) * M2, 1), _roots(run, 2)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class Model:
    """Weights, and slope and offset of the calibration."""

    def __init__(self, weights: np.ndarray, slope: float, offset: float):
        self.weights, self.slope, self.offset = weights, slope, offset

    def probability(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(_sigmoid(self.slope * (self.weights[at] @ x) + self.offset))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_calibration(score: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's calibration by Newton steps, on targets drawn in from 0 and 1."""
    n1, n0 = max(1, int(good.sum())), max(1, int((1 - good).sum()))
    target = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([score, np.ones(len(score))], axis=1)
    loss = lambda t: float(weight @ (np.logaddexp(0, x @ t) - target * (x @ t)))
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ theta)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - target)))
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def _described(batches):
    """Shard, order, label and features of labelled documents."""
    memo = Words()
    for b in batches:
        out = []
        for raw, good in zip(b.column("text").to_pylist(), b.column("good").to_pylist(), strict=True):
            at, x = features(raw, memo.numbers(raw.split()), memo)
            h = xxhash.xxh3_64_intdigest(raw)
            out.append((h % SHARDS, h // SHARDS % CALIBRATION == 0, h >> 2, good, at.astype("<i4").tobytes(), x.astype("<f4").tobytes()))
        if out:
            kinds = [pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["shard", "kept_out", "place", "good", "at", "x"])


def _steps(weights: np.ndarray, share: dict[int, float]):
    """Passes of gradient steps over one shard. A shard holds a part of the bounded sample."""

    def run(t: pa.Table) -> pa.Table:
        w = weights.copy()
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("place", "good", "at", "x")), strict=True))
        rows = [(good, np.frombuffer(at, "<i4"), np.frombuffer(x, "<f4").astype(np.float64)) for _, good, at, x in rows]
        total, steps = np.zeros_like(w), 0
        for n in range(PASSES):
            rate = RATE / (1 + n)
            for good, at, x in rows:
                w[at] -= rate * share[good] * (_sigmoid(w[at] @ x) - good) * x
            w *= 1 - SHRINK * rate * len(rows)
            total += w
            steps += 1
        return pa.table({"weights": pa.array([(total / steps).astype("<f8").tobytes()], pa.binary())})

    return run


def _raw_scores(weights: np.ndarray):
    def run(batches):
        for b in batches:
            score = [float(weights[np.frombuffer(at, "<i4")] @ np.frombuffer(x, "<f4")) for at, x in zip(b.column("at").to_pylist(), b.column("x").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("good"), pa.array(score, pa.float64())], ["good", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | None:
    """Learn from `labels` (doc_id, quality 0 or 1). The driver receives one weight vector a shard, of fixed size, and
    two numbers for each calibrating document."""
    spark = prepare(docs.sparkSession)
    ids = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    ids = ids.agg(F.min("quality").cast("int").alias("good"), F.max("quality").alias("other")).where("good = other").drop("other")
    ids = staged(ids, "labelled")
    count = {r.good: r.n for r in ids.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(count) < 2:
        return None
    below = F.when(F.col("good") == 1, labelled / count[1]).otherwise(labelled / count[0])
    sample = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < below * (1 << 20))
    # Some 2 * labelled ids and labels: a proven bound.
    rows = documents_of(docs).join(F.broadcast(sample), "doc_id").select("text", "good")
    rows = staged(rows.mapInArrow(_described, "shard int, kept_out boolean, place bigint, good int, at binary, x binary"), "described")
    learned = {r.good: r.n for r in rows.where("NOT kept_out").groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(learned) < 2:
        return None
    # Both labels weigh the same in training.
    share = {g: sum(learned.values()) / (2 * n) for g, n in learned.items()}
    weights = np.zeros(SIZE)
    for _ in range(ROUNDS):
        got = rows.where("NOT kept_out").groupBy("shard").applyInArrow(_steps(weights, share), "weights binary").toArrow()
        weights = np.mean([np.frombuffer(w, "<f8") for w in sorted(got.column(0).to_pylist())], axis=0)
    seen = rows.where("kept_out").mapInArrow(_raw_scores(weights), "good int, score double").toArrow()
    good, score = seen.column(0).to_numpy(), seen.column(1).to_numpy()
    if len(set(good.tolist())) < 2:
        return Model(weights, 1.0, 0.0)
    weight = np.where(good == 1, count[1] / max(1, good.sum()), count[0] / max(1, (1 - good).sum()))
    return Model(weights, *fit_calibration(score, good, weight * len(good) / weight.sum()))


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, p_good double"


def judge(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """Counts, base rule, verdict and the probability of good quality for every row of `docs`."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE numbers

    def run(batches):
        memo, model = Words(), shared.value
        for b in batches:
            out = []
            for raw in b.column("text").to_pylist():
                words = raw.split()
                ids = memo.numbers(words)
                counts = base_counts(raw, words, ids)
                failed = base_failed(counts[0], counts[4])
                p = model.probability(*features(raw, ids, memo)) if model and words else None
                out.append((*counts, failed, not failed and (p is None or p >= keep), p))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return documents_of(docs).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """The rows of `docs`, all columns, that `judge` keeps."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        memo, model = Words(), shared.value
        for b in batches:
            stay = []
            for raw in b.column(at).cast(pa.binary()).to_pylist():
                words = (raw or b"").split()
                ids = memo.numbers(words)
                good = len(words) >= LEAST_WORDS and not base_failed(len(words), repeated_words(ids))
                stay.append(good and (model is None or model.probability(*features(raw, ids, memo)) >= keep))
            yield b.filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
