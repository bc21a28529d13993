"""Secret scan: candidates by shape and context, false positives removed by a random forest.

A candidate is a run of 16 or more token characters, or a value of 8 or more characters assigned to something, with
the padding at its end but never with the name before it: NAME=value, NAME:value and ?name=value yield the value. The
forest sees its length, its character transitions, how much of it the corpus's own letter trigrams cover and how much
words of a dictionary do (the words of 4 to 16 letters that make up at least `WORD_SHARE` of all in the corpus), whether it looks like part of a path or address, whether it has the form of a known key or lies in a private key block, and the
words around it. It learns from labelled findings, by default from the clear cases of the corpus itself. Secrets are
known key forms, private key blocks, and values assigned to a secret-bearing name that are no code or path: mixed of
letters and digits, or of any length and letters if the name stands right before them. Plain are only candidates with a
sign of it: word-like, all digits, in a path or address, or after a plain name such as commit. All others are left
unlabelled. Every labelled finding is learned with and without its neighbours, so that shape alone can decide.

The forest is fitted on at most `LABELLED` findings of each label, those with the smallest hashes. The trigram
table and the dictionary count all texts. Scanning is one pass over whole texts without a shuffle.

Rules: null and empty texts have no findings. If the corpus has no labelled finding of one of the labels, the rule
that labels clear cases decides alone. Repeated rows and ids are scanned row by row. Offsets count bytes of the
text's UTF-8. Redaction replaces each secret by `REDACTED` and keeps all rows and columns.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import decode, documents_of, prepare, staged

LABELLED = 5000  # labelled findings per label that the forest is fitted on
TREES, DEPTH, LEAF = 40, 8, 3
ORDERS = 1 << 56  # of findings
REDACTED = b"[secret removed]"
SECRET_NAMES = (b"api", b"auth", b"bearer", b"credential", b"key", b"pass", b"private", b"pwd", b"secret", b"token")
PLAIN_NAMES = (b"checksum", b"commit", b"digest", b"hash", b"md5", b"revision", b"sha", b"uuid", b"version")
FEATURES = (
    "length digits upper class_changes distinct entropy transition coverage dictionary slashes dots brackets known address assigned quoted secret_name"
    " plain_name named block"
).split()
NEIGHBOURS = slice(FEATURES.index("address"), len(FEATURES))

# '=' belongs to a token only as padding at its end: elsewhere it parts a name from its value.
_RUN = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/=_-]))?")
_VALUE = re.compile(rb"[:=][ \t]*[\"']?([^\s\"'=:]{8,}(?:={1,2}(?![^\s\"'&#,;)\]}]))?)")
# Names that end in a secret's: api_key, db.password, tokenValue. Keywords, authors and max_tokens do not.
_NAMED = re.compile(
    rb"(?:key|token|secret|password|passwd|passphrase|pass|pwd|credentials?|auth|bearer)(?:[_.-]?(?:id|value|string|[0-9]+))?[\"']?[ \t]*([:=])[ \t]*([\"']?)$"
)
# Keys that show what they are. Those of several parts with dots are candidates as a whole.
_DOTTED = rb"(?<![A-Za-z0-9_-])(?:eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|ya29\.[A-Za-z0-9_-]{20,})"
_PARTS = re.compile(_DOTTED)
_KNOWN = re.compile(
    _DOTTED + rb"|(?<![A-Za-z0-9])(?:A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[oprsu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}"
    rb"|xox[abeoprs]-[A-Za-z0-9-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"
    # Passes over short parts for good, so that a text is read once however often such a key seems to begin.
    rb"|(?<![_-])sk-(?:[_-]*+[A-Za-z0-9]{1,19}+(?![A-Za-z0-9]))*+[_-]*+[A-Za-z0-9]{20}[A-Za-z0-9_-]*+|AIza[A-Za-z0-9_-]{35}"
    rb"|npm_[A-Za-z0-9]{36}|pypi-[A-Za-z0-9_-]{50,}|hf_[A-Za-z0-9]{30,})"
)
_BEGIN = re.compile(rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BREAK = re.compile(rb"(?:\s|\\[nrt])*")
_LINES = re.compile(rb"\n|(?:\\r)?\\n")
_LINE = re.compile(rb"[A-Za-z-]+: .*|[A-Za-z0-9+/=]*")
_CUT = re.compile(rb"(?:[A-Za-z0-9+/]{16,}={0,2}(?:\s|\\[nrt])*)+(?:[A-Za-z0-9+/]+=={0,1})?")
_QUERY = re.compile(rb"[?&][^\s\"'?&=]*=$")
# Letters 1..26 whatever their case, digits 27, other ASCII 0, further bytes 28.
_KIND = np.array([0] * 128 + [28] * 128, np.int64)
_KIND[48:58] = 27
_KIND[65:91] = _KIND[97:123] = np.arange(1, 27)
_N = 29


def _trigrams(raw: bytes) -> np.ndarray:
    k = _KIND[np.frombuffer(raw, np.uint8)]
    return k[:-2] * (_N * _N) + k[1:-1] * _N + k[2:]


WORD = re.compile(rb"[a-z]{4,16}")
WORD_SHARE = 2e-5  # of all words of the corpus: what a word of the dictionary makes up, so it has 50,000 words at most
HELD_WORDS = 200_000  # distinct words a task counts before it hands them on


def dictionary_share(value: bytes, words: frozenset[bytes]) -> float:
    """Share of a candidate's characters in words of the dictionary, the longest one taken from each place on."""
    covered, lowered = 0, value.lower()
    for run in re.finditer(rb"[a-z]{4,}", lowered):
        at, end = run.span()
        while at + 4 <= end:
            size = next((n for n in range(min(16, end - at), 3, -1) if lowered[at : at + n] in words), 0)
            covered += size
            at += size or 1
    return covered / len(value)


def _count_words(batches):
    """Counts of the words of 4 to 16 letters."""
    n: Counter[bytes] = Counter()

    def counted():
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for raw in b.column(1).to_pylist():
            n.update(WORD.findall(raw.lower()))
            if len(n) > HELD_WORDS:
                yield counted()
                n.clear()
    yield counted()


def _count(batches):
    n = np.zeros(_N**3, np.int64)
    for b in batches:
        for raw in b.column(1).to_pylist():
            if len(raw) > 2:
                n += np.bincount(_trigrams(raw), minlength=_N**3) if len(raw) > 2000 else 0
                if len(raw) <= 2000:
                    np.add.at(n, _trigrams(raw), 1)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["gram", "n"])


@dataclass
class Letters:
    """What is usual in the corpus: log probability of a character after another, the trigrams in use, frequent words."""

    transition: np.ndarray
    usual: np.ndarray
    words: frozenset[bytes] = frozenset()

    @staticmethod
    def of(docs: DataFrame) -> Letters:
        """Counted over all texts; the driver receives one number per trigram of 29 character kinds, and the dictionary."""
        got = documents_of(docs).mapInArrow(_count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(_N**3)
        n[got.column("gram").to_numpy()] = got.column("n").to_numpy()
        pairs = n.reshape(_N, _N, _N).sum(axis=2) + 1
        words = documents_of(docs).mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        words = staged(words, "word-counts")
        total = words.agg(F.sum("n")).first()[0] or 0
        frequent = words.where(F.col("n") >= WORD_SHARE * total).select("word").toArrow().column(0).to_pylist()
        return Letters(np.log(pairs / pairs.sum(axis=1, keepdims=True)), n >= 1e-5 * max(1.0, n.sum()), frozenset(frequent))


def _values(raw: bytes):
    """Spans of assigned values; a parameter of an address ends where the next one begins."""
    for m in _VALUE.finditer(raw):
        i, j = m.span(1)
        if _QUERY.search(raw, max(0, i - 64), i):
            j = i + min(k for k in (raw.find(b"&", i, j) - i, raw.find(b"#", i, j) - i, j - i) if k >= 0)
        if j - i >= 8:
            yield i, j


def blocks(raw: bytes) -> list[tuple[int, int]]:
    """Spans of the bodies of private key blocks: to the end mark, or as far as lines of base64 go if none belongs to it."""
    out = []
    begins = list(_BEGIN.finditer(raw)) if b"-----BEGIN " in raw else []
    limits = [*(m.start() for m in begins[1:]), len(raw)]
    for m, limit in zip(begins, limits, strict=False):
        i = _BREAK.match(raw, m.end()).end()
        end = raw.find(b"-----END ", i, limit)
        if end < 0 or not all(_LINE.fullmatch(line.strip(b" \t\r>#*|\"',\\")) for line in _LINES.split(raw[i:end])):
            cut = _CUT.match(raw, i, limit)
            end = cut.end() if cut else i
        body = raw[i:end].rstrip()
        while body.endswith((b"\\n", b"\\r", b"\\t")):
            body = body[:-2].rstrip()
        if body:
            out.append((i, i + len(body)))
    return out


def candidates(raw: bytes) -> list[tuple[int, int]]:
    """Byte spans of a text that may be secrets, in order, none within another. A private key block is one of them."""
    return [(i, j) for i, j, _ in _candidates(raw)]


def _candidates(raw: bytes) -> list[tuple[int, int, bool]]:
    """`candidates`, and whether each is the body of a private key block."""
    whole = blocks(raw)
    spans = {m.span() for m in _RUN.finditer(raw)} | set(_values(raw))
    if any(p in raw for p in (b"eyJ", b"SG.", b"ya29.")):
        spans |= {m.span() for m in _PARTS.finditer(raw)}
    if whole:
        starts, ends = np.array(whole).T
        # Marks and lines of a block are no candidates beside it: a span may neither begin in it nor reach into it.
        spans = {(i, j) for i, j in spans if (k := int(np.searchsorted(ends, i, "right"))) == len(ends) or j <= starts[k]}
    out: list[tuple[int, int, bool]] = []
    for i, j, block in sorted([(i, j, False) for i, j in spans] + [(i, j, True) for i, j in whole], key=lambda s: (s[0], -s[1])):
        if not out or i >= out[-1][1]:
            out.append((i, j, block))
    return out


def features(raw: bytes, i: int, j: int, letters: Letters, block: bool = False) -> list[float]:
    """`named` is 2 if a secret's name stands right before with '=' or a quote, 1 with a colon alone, as in prose."""
    value = raw[i:j]
    b = np.frombuffer(value, np.uint8)
    kind = _KIND[b]
    share = np.bincount(b)
    share = share[share > 0] / len(b)
    upper = (b >= 65) & (b <= 90)
    group = np.where(kind == 27, 0, np.where(upper, 1, np.where((kind > 0) & (kind < 27), 2, 3)))
    before, after = raw[max(0, i - 48) : i].lower(), raw[j : j + 8]
    near = before.split(b"\n")[-1]
    grams = _trigrams(value) if len(b) > 2 else np.zeros(0, np.int64)
    assigned = re.search(rb"[:=]\s*[\"']?$", near) is not None
    named = _NAMED.search(near)
    return [
        float(len(b)),
        float((kind == 27).mean()),
        float(upper.mean()),
        float((group[1:] != group[:-1]).mean()) if len(b) > 1 else 0.0,
        len(share) / len(b),
        float(-(share * np.log2(share)).sum()),
        float(letters.transition[kind[:-1], kind[1:]].mean()) if len(b) > 1 else 0.0,
        float(letters.usual[grams].mean()) if len(grams) else 0.0,
        dictionary_share(value, letters.words),
        value.count(b"/") / len(b),
        value.count(b".") / len(b),
        sum(map(value.count, b"()[]{}<>$*")) / len(b),
        float(_KNOWN.search(value) is not None),
        float(b"://" in near or b"www." in near or near.endswith((b"/", b"\\", b"@")) or after.startswith((b"/", b"@"))),
        float(assigned),
        float(near.endswith((b'"', b"'")) and after[:1] in (b'"', b"'")),
        float(any(n in near for n in SECRET_NAMES)),
        float(any(n in near for n in PLAIN_NAMES)),
        0.0 if named is None else 1.0 + float(named[1] == b"=" or named[2] != b""),
        float(block),
    ]


def clear_case(x: np.ndarray) -> np.ndarray:
    """1 for a clear secret, 0 for a clear non-secret, -1 for neither, by rows of features."""
    at = {n: x[:, k] for k, n in enumerate(FEATURES)}
    mixed = (at["digits"] > 0.1) & (at["digits"] < 0.95) & (at["entropy"] > 2.5)
    number = at["digits"] >= 0.95
    words = (at["coverage"] >= 0.7) & (at["digits"] <= 0.1)
    path = words & ((at["slashes"] > 0) | (at["dots"] > 0))
    shown = (at["known"] > 0) | (at["block"] > 0)
    assigned = (at["assigned"] > 0) & (at["secret_name"] > 0)
    value = (at["plain_name"] == 0) & (at["brackets"] == 0) & (at["entropy"] > 2) & ~number & ~path
    named = (at["named"] > 0) & value & (mixed | ~words | (at["named"] == 2))
    secret = shown | named | (assigned & value & mixed & (at["length"] >= 16))
    sign = words | number | (at["plain_name"] > 0) | (((at["slashes"] > 0) | (at["address"] > 0)) & (at["coverage"] >= 0.4))
    plain = sign & ~assigned & (at["named"] == 0) & ((at["secret_name"] == 0) | words)
    return np.where(secret, 1, np.where(plain, 0, -1))


def _rows(b: pa.RecordBatch, at: int, letters: Letters) -> tuple[list[tuple[int, int, int]], np.ndarray, list[bytes]]:
    """Candidates (row, start, end) of a batch, their features and the texts."""
    raws = [raw or b"" for raw in b.column(at).cast(pa.binary()).to_pylist()]
    spans = [(r, *span) for r, raw in enumerate(raws) for span in _candidates(raw)]
    x = np.array([features(raws[r], i, j, letters, block) for r, i, j, block in spans], np.float64).reshape(len(spans), len(FEATURES))
    return [span[:3] for span in spans], x, raws


# A tree: per node feature (-1 at a leaf), threshold, right child (the left one follows the node), share of secrets.
Tree = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def grow(x: np.ndarray, y: np.ndarray, seed: int) -> Tree:
    """One tree on a bootstrap sample; each split takes the best of a few random features and thresholds."""
    rng = np.random.default_rng(seed)
    sample = rng.integers(0, len(y), len(y))
    x, y = x[sample], y[sample]
    nodes: list[list[float]] = []

    def impurity(part: np.ndarray) -> float:
        p = part.mean()
        return len(part) * p * (1 - p)

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        part = y[rows]
        nodes.append([-1, 0.0, 0, part.mean()])
        if depth == DEPTH or len(rows) < 2 * LEAF or part.min() == part.max():
            return me
        best = (impurity(part) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], 5, replace=False):
            values = x[rows, f]
            for cut in rng.choice(values, 8):
                low = values <= cut
                if LEAF <= low.sum() <= len(rows) - LEAF:
                    best = min(best, (impurity(part[low]) + impurity(part[~low]), int(f), float(cut)))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            node(rows[low], depth + 1)
            nodes[me][:3] = [best[1], best[2], node(rows[~low], depth + 1)]
        return me

    node(np.arange(len(y)), 0)
    feature, cut, right, share = (np.array(c) for c in zip(*nodes, strict=True))
    return feature.astype(np.int64), cut, right.astype(np.int64), share


@dataclass
class Forest:
    letters: Letters
    trees: list[Tree]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves that each row reaches; the clear-case rule where there are no trees."""
        if not self.trees:
            return (clear_case(x) == 1).astype(float)
        total = np.zeros(len(x))
        for feature, cut, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                down = np.where(x[np.arange(len(x)), f] <= cut[at], at + 1, right[at])
                at = np.where(f < 0, at, down)
            total += share[at]
        return total / len(self.trees)


def labelled_findings(docs: DataFrame, letters: Letters) -> DataFrame:
    """(label, order, x): the clear cases of a corpus with their features, in an order that is a hash."""
    shared = docs.sparkSession.sparkContext.broadcast(letters)

    def run(batches):
        for b in batches:
            spans, x, raws = _rows(b, 1, shared.value)
            label = clear_case(x)
            keep = np.flatnonzero(label >= 0)
            order = [int.from_bytes(hashlib.blake2b(raws[r][i:j] + b"%d" % i, digest_size=7).digest()) for r, i, j in (spans[k] for k in keep)]
            cols = [pa.array(label[keep].astype(np.int32)), pa.array(order, pa.int64()), pa.array(list(x[keep]), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, ["label", "order", "x"])

    return documents_of(docs).mapInArrow(run, "label int, order bigint, x array<double>")


def train(docs: DataFrame, findings: DataFrame | None = None, bound: int = LABELLED) -> Forest:
    """Fit the forest on labelled findings (label, order, x), by default those of `labelled_findings`.

    At most `bound` findings per label reach the driver, those with the smallest `order`, an even hash below 2**56;
    equal findings count once. The trees grow as tasks, each on the whole sample.
    """
    spark = prepare(docs.sparkSession)
    letters = Letters.of(docs)
    findings = labelled_findings(docs, letters) if findings is None else findings.select("label", "order", "x")
    findings = staged(findings.dropDuplicates(["label", "order", "x"]), "labelled-findings")
    count = {r["label"]: r["count"] for r in findings.groupBy("label").count().collect()}
    # Hashes are even, so below this one lie `bound` findings and some; the least of them are taken.
    below = {k: ORDERS if n <= 2 * bound else int(ORDERS * (bound + 8 * bound**0.5) / n) for k, n in count.items()}
    sample = [findings.where((F.col("label") == k) & (F.col("order") < below.get(k, 0))).orderBy("order", "x").limit(bound).collect() for k in (0, 1)]
    if not all(sample):
        return Forest(letters, [])
    x = np.array([r["x"] for part in sample for r in part])
    y = np.array([r["label"] for part in sample for r in part], np.float64)
    # Both labels weigh the same, so that few secrets stand against many plain runs.
    again = np.concatenate([np.resize(np.flatnonzero(y == k), max(map(len, sample))) for k in (0, 1)])
    x, y = x[again], y[again]
    alone = x.copy()
    alone[:, NEIGHBOURS] = 0
    shared = spark.sparkContext.broadcast((np.concatenate([x, alone]), np.concatenate([y, y])))

    def run(batches):
        for b in batches:
            for seed in b.column(0).to_pylist():
                parts = grow(*shared.value, seed)
                yield pa.RecordBatch.from_arrays([pa.array([seed]), *(pa.array([p.tolist()]) for p in parts)], ["seed", "f", "c", "r", "s"])

    grown = spark.range(0, TREES, 1, 8).mapInArrow(run, "seed bigint, f array<bigint>, c array<double>, r array<bigint>, s array<double>").collect()
    return Forest(letters, [tuple(np.array(v) for v in row[1:]) for row in sorted(grown)])


def scan(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """One row per secret found: doc_id, start, length, value_sha256, score. The value itself is not repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            spans, x, raws = _rows(b, 1, shared.value.letters)
            score = shared.value.score(x)
            ids = b.column(0).to_pylist()
            out = [(ids[r], i, j - i, hashlib.sha256(raws[r][i:j]).hexdigest(), float(s)) for (r, i, j), s in zip(spans, score, strict=True) if s >= least]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "value_sha256", "score"])

    return documents_of(docs).mapInArrow(run, "doc_id bigint, start bigint, length bigint, value_sha256 string, score double")


def redact(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """`docs` with the secrets in `text` replaced; `n_chars`, if there, follows the new text. All rows and columns stay."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            spans, x, raws = _rows(b, at, shared.value.letters)
            found: dict[int, list[tuple[int, int]]] = {}
            for (r, i, j), s in zip(spans, shared.value.score(x), strict=True):
                if s >= least:
                    found.setdefault(r, []).append((i, j))
            if not found:
                yield b
                continue
            cols = list(b.columns)
            texts = cols[at].to_pylist()
            counts = cols[count].to_pylist() if count is not None else None
            for r, parts in found.items():
                out, last = [], 0
                for i, j in parts:
                    out += [raws[r][last:i], REDACTED]
                    last = j
                texts[r] = decode(b"".join([*out, raws[r][last:]]))
                if counts is not None:
                    counts[r] = len(texts[r])
            cols[at] = pa.array(texts, cols[at].type)
            if counts is not None:
                cols[count] = pa.array(counts, cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
