import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.util import documents, lower
from voltlake.llm import language_id, maxent_lm, packing, piece_bpe, secret_scan, token_counts
from voltlake.llm.tokenizers import byte_bpe_ids

BYTE_BPE, PIECE_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "Hello, hello world!\n\n  two  blanks "), (5, "日本語 👍🏽 ñandú\t\x00x"), (6, "a" * 30_000),
    (7, "<|endoftext|> and <s> <0x0A> ▁"), (8, "word " * 5000), (8, "word " * 5000), (None, "no id"), (9, "it's 1234 \r\n end"),
]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def by_row(frame, key="doc_id"):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_packing_places_every_id_once(spark):
    pieces = packing.pack(documents(spark, TEXTS), BYTE_BPE, 256, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in TEXTS}
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32
        docs[p.doc_id].append((p.start, ids.tolist(), p.doc_tokens))
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    twice = docs.pop(8)  # two rows bear this id
    assert sorted(x for _, ids, _ in twice for x in ids) == sorted(2 * want.pop(8))
    assert {i: [x for _, ids, _ in sorted(parts) for x in ids] for i, parts in docs.items()} == want
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 1 - sum(p.length for p in pieces) / (256 * len(sequences))
    assert padding < 0.02


def test_byte_ids_of_long_runs():
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    runs = [" " * 1_000_000 + "a", "\n" * 1_000_000, "\n" * 2_000_000 + "x", "\t" * 300_000 + " b", "a" + " \n" * 200_000, " " * 10_000, "b" + " " * 10_001 + "c", "\x1c" * 20_000 + "a", "\u3000" * 20_000 + "!", "7" * 100_000]
    for text in [*runs, "start " + " " * 12_000 + "<|endoftext|>" + "\n" * 12_000 + " end"]:
        assert byte_bpe_ids(BYTE_BPE, text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text[:20])


def test_packing_of_a_long_run(spark):
    rows = [(1, " " * 1_000_000 + "a"), (2, "\n" * 1_000_000), (3, "plain text")]
    pieces = packing.pack(documents(spark, rows), BYTE_BPE).collect()
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    for i, text in rows:
        want = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces if p.doc_id == i)
        assert [(n, c, t) for _, n, c, t in mine] == [(n, zlib.crc32(want[s : s + n].tobytes()), len(want)) for s, n, _, _ in mine]
        assert sum(n for _, n, _, _ in mine) == len(want)


def test_packed_sequences_hold_the_ids(spark):
    pieces = packing.pack(documents(spark, TEXTS[:5]), BYTE_BPE, 64, keep_ids=True)
    whole = {r.sequence_id: (r.n_tokens, r.ids) for r in packing.sequences(pieces).collect()}
    for p in pieces.collect():
        n, ids = whole[p.sequence_id]
        assert len(ids) == 4 * n and ids[4 * p.offset : 4 * (p.offset + p.length)] == p.ids


def test_packing_of_nothing(spark):
    assert packing.pack(documents(spark, []), BYTE_BPE).collect() == []


@pytest.mark.parametrize("capacity", [1, 2, 64, 2048])
def test_cut_covers_and_fits_the_classes(capacity):
    sizes = packing.class_sizes(capacity)
    for n in [1, 2, 3, capacity - 1, capacity, capacity + 1, 5 * capacity + 7]:
        parts = packing.cut(n, capacity, sizes)
        assert sum(parts) == n and set(parts) <= set(sizes.tolist())


def test_language_id_held_out_accuracy(small):
    model = language_id.train(small)
    rows = language_id.identify(small, model).join(small.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_language_id_finds_both_languages_of_a_mixture(spark, small):
    model = language_id.train(small)
    text = {r.lang: r.text for r in small.where("length(text) > 3000").collect()}
    a, b = text["en"][:3000], text["fr"][:1500]
    found = model.mixture(f"{a}\n{b}".encode())
    assert set(found) == {"en", "fr"} and 0.5 < found["en"] < 0.8


def test_language_id_against_a_search_of_all_mixtures(small):
    """The language set and its shares, against the best of all sets with shares in steps of a twentieth."""
    model = language_id.train(small)
    rows = small.where("length(text) > 4000").collect()
    text = {r.lang: r.text for r in rows}
    langs = sorted(model.langs)
    cuts = [(2000,), (1500, 1500), (2400, 600), (1000, 1000, 1000)]
    for i, parts in enumerate(cuts * 2):
        used = [langs[(i + j) % len(langs)] for j in range(len(parts))]
        raw = "\n".join(text[x][:n] for x, n in zip(used, parts, strict=True)).encode()
        at, n = language_id.trigram_counts(raw)
        p, penalty = model.p[at], 1.5 * math.log(n.sum() + 1)
        best = (-math.inf, ())
        for shares in itertools.product(range(21), repeat=len(langs)):
            if sum(shares) == 20:
                value = n @ np.log(p @ (np.array(shares) / 20)) - penalty * sum(x > 0 for x in shares)
                best = max(best, (value, shares))
        want = {model.langs[j]: x / 20 for j, x in enumerate(best[1]) if x}
        got = model.mixture(raw)
        assert set(got) == set(want) == set(used)
        assert all(abs(got[x] - want[x]) < 0.06 for x in got)


def test_texts_in_no_learned_language_go(spark, small):
    model = language_id.train(small)
    other = [
        "Ennen vanhaan kylän väki kokoontui iltaisin järven rannalle, jossa vanhukset kertoivat tarinoita menneistä ajoista ja nuoret lauloivat",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są obdarzeni rozumem i sumieniem",
        "Все люди рождаются свободными и равными в своём достоинстве и правах, они наделены разумом и совестью",
        "xq zvkj qqwz jxkv wqzx kkjq vzxw qjkz xvwq zkqj",
    ]
    strange = documents(spark, [(i, " ".join([x] * 6)) for i, x in enumerate(other)])
    assert language_id.keep_identified(strange, model, 0.3).collect() == []
    clean = small.where(F.col("text").rlike("[A-Za-z]"))
    assert language_id.keep_identified(clean, model, 0.3).count() >= 0.995 * clean.count()


def test_language_id_edge_rows(spark):
    rows = [(i, "the cat sat on the mat" if i % 2 else "le chat est sur la table", "en" if i % 2 else "fr") for i in range(40)]
    edge = [(100, None, "en"), (101, "", None), (102, "123 ... !", "fr"), (None, "the mat", "en"), (103, "the cat", None), (104, "ЖЖЖ", None), (104, "the " * 60_000, None)]
    model = language_id.train(documents(spark, rows + edge))
    got = by_row(language_id.identify(documents(spark, edge), model).select("doc_id", "held_out", "lang_pred"))
    assert {(g[0], g[2]) for g in got if g[0] != 104} == {(100, "und"), (101, "und"), (102, "und"), (None, "en"), (103, "en")}
    assert len(got) == len(edge) and all(g[1] for g in got if g[0] is None)
    kept = language_id.keep_identified(documents(spark, edge), model)
    assert kept.columns == documents(spark, []).columns and {r.doc_id for r in kept.collect()} >= {None, 103}
    empty = language_id.train(documents(spark, []))
    assert empty.langs == [] and {r.lang_pred for r in language_id.identify(documents(spark, edge), empty).collect()} == {"und"}
    assert language_id.identify(documents(spark, []), empty).collect() == []


def secret_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioutnrs") for _ in range(rng.randrange(2, 24)))
    code = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows, truth = [], set()
    for i in range(300):
        words = [word() for _ in range(60)]
        if i % 5 == 0:
            value = code()
            words[30] = f'token = "{value}"'
            truth.add((i, value))
        if i % 7 == 0:
            words[10] = f"commit {code()} in src/{word()}/{word()}.py"
        rows.append((i, " ".join(words)))
    return rows, truth


def test_secret_scan_finds_planted_secrets_and_leaves_the_rest(spark):
    rows, truth = secret_rows()
    docs = documents(spark, rows)
    forest = secret_scan.train(docs)
    assert len(forest.trees) == secret_scan.TREES
    text = dict(rows)
    got = {(r.doc_id, text[r.doc_id].encode()[r.start : r.start + r.length].decode()) for r in secret_scan.scan(docs, forest).collect()}
    assert truth <= got and not any(re.fullmatch("[a-z]+", v) for _, v in got)
    clean = {r.doc_id: r for r in secret_scan.redact(docs, forest).collect()}
    assert len(clean) == len(rows)
    for i, value in truth:
        assert value not in clean[i].text and "[secret removed]" in clean[i].text and clean[i].n_chars == len(clean[i].text)
    untouched = set(text) - {i for i, _ in got}
    assert all(clean[i].text == text[i] for i in untouched)


def test_secret_patterns_read_a_text_once():
    for part in (b"sk-", b"sk-abc_", b"sk_", b"-sk-" + b"a" * 19, b"ghp_", b"eyJaaaaaaaa.", b"glpat-x", b"= "):
        started = time.process_time()
        raw = part * (1_000_000 // len(part))
        secret_scan._KNOWN.search(raw)
        secret_scan.candidates(raw)
        assert time.process_time() - started < 3, part
    known = lambda raw: secret_scan._KNOWN.search(raw) is not None
    assert known(b"sk-" + b"aB3" * 8) and known(b"sk-proj-ab_cd-" + b"x1" * 10 + b"-_") and known(b"x sk-" + b"a" * 20)
    assert not known(b"sk-" + b"a" * 19) and not known(b"sk-ab-" + b"c" * 19 + b"-d") and not known(b"risk-" + b"a" * 30)


def test_dictionary_share_takes_the_longest_words(spark):
    words = frozenset([b"pass", b"password", b"horse", b"ords"])
    assert secret_scan.dictionary_share(b"Password-horse1", words) == 13 / 15
    assert secret_scan.dictionary_share(b"xpassx.pas", words) == 0.4 and secret_scan.dictionary_share(b"123", words) == 0
    letters = secret_scan.Letters.of(documents(spark, [(i, "common words here " * 20 + f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300)] + [(None, None)]))
    counts = Counter(w for i in range(300) for w in ["common", "words", "here"] * 20)
    assert set(w.decode() for w in letters.words) >= set(counts) and len(letters.words) <= 1 / secret_scan.WORD_SHARE


def test_secret_sample_takes_the_smallest_hashes(spark):
    rng = random.Random(1)
    rows = [(i % 2, rng.randrange(1 << 56), [float(i % 2)] * len(secret_scan.FEATURES)) for i in range(4000)]
    findings = spark.createDataFrame(rows + rows[:1000] * 2, "label int, order bigint, x array<double>")
    forest = secret_scan.train(documents(spark, [(1, "text")]), findings, 50)
    assert len(forest.trees) == secret_scan.TREES
    assert forest.score(np.array([[0.0] * len(secret_scan.FEATURES), [1.0] * len(secret_scan.FEATURES)])).round().tolist() == [0, 1]


def test_secret_scan_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, 'key = "a1b2c3d4e5f6a7b8c9d0"'), (3, 'é token: "a1b2c3d4e5f6a7b8c9d0" é'), (3, "x" * 200_000), (4, "plain words only")]
    docs = documents(spark, rows)
    forest = secret_scan.train(docs)
    found = secret_scan.scan(docs, forest).collect()
    assert {(r.doc_id, r.length) for r in found} >= {(None, 20), (3, 20)} and len(found) < 4
    assert sorted(str(r.text) for r in secret_scan.redact(docs, forest).collect())[0] == ""
    none = documents(spark, [])
    forest = secret_scan.train(none)
    assert forest.trees == [] and secret_scan.scan(none, forest).collect() == [] and secret_scan.redact(none, forest).collect() == []


UNQUOTED = ("export API_KEY={}", "aws_secret_access_key={}", "AUTH_TOKEN:{}", "password = {}", "get https://host.example/v1?token={}&page=2", "secret: {}")


@pytest.mark.parametrize("form", UNQUOTED)
@pytest.mark.parametrize("value", ["24be64d09a1c77f3e5b2", "wJa1rXU7nF3MI/K7MD5NG+bPx", "QUJ1REV2R0h3SktNTU5PUA=="])
def test_secret_candidates_of_unquoted_assignments_are_the_values(form, value):
    raw = form.format(value).encode()
    spans = [(i, j) for i, j in secret_scan.candidates(raw) if value.encode()[:8] in raw[i:j]]
    assert [raw[i:j].decode() for i, j in spans] == [value]
    letters = secret_scan.Letters(np.zeros((secret_scan._N,) * 2), np.zeros(secret_scan._N**3, bool))
    x = np.array([secret_scan.features(raw, *spans[0], letters)])
    at = dict(zip(secret_scan.FEATURES, x[0], strict=True))
    assert at["assigned"] == at["secret_name"] == 1
    assert secret_scan.clear_case(x).tolist() == [1]


def test_secret_scan_finds_unquoted_assignments(spark):
    rows, _ = secret_rows()
    rng, truth = random.Random(6), set()
    for k, (i, text) in enumerate(rows):
        if i % 5 == 1:
            value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            truth.add((i, value))
            rows[k] = (i, f"{text}\n{UNQUOTED[i // 5 % len(UNQUOTED)].format(value)}\n{text}")
    docs, text = documents(spark, rows), dict(rows)
    forest = secret_scan.train(docs)
    got = {(r.doc_id, text[r.doc_id].encode()[r.start : r.start + r.length].decode()) for r in secret_scan.scan(docs, forest).collect()}
    assert truth <= got
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs, forest).collect()}
    assert not any(value in clean[i] for i, value in truth)


def bare_secret_rows():
    """Secrets that no name on their line tells of, and short or letter-only values; words, paths and commits beside them."""
    rng = random.Random(7)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    upper, lower_case = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    base64 = upper + lower_case + "0123456789+/"
    rows, truth = secret_rows()
    for k, (i, text) in enumerate(rows):
        kind, value = i % 6, None
        if kind == 0:
            value = form = "AK" + "IA" + pick(upper + "0123456789", 16)
        elif kind == 1:
            value = form = "gh" + "p_" + pick(upper + lower_case + "0123456789", 36)
        elif kind == 2:
            value = "\n".join([*(pick(base64, 64) for _ in range(12)), pick(base64, 9)])
            form = f"-----BEGIN RSA PRIVATE" + f" KEY-----\n{value}\n-----END RSA PRIVATE KEY-----"
        elif kind == 3:
            value = pick(lower_case + "0123456789", 7) + "7x"
            form = f"password={value}"
        elif kind == 4:
            value = pick(upper + lower_case, 24)
            form = f'"api_key": "{value}"'
        if value:
            truth.add((i, value))
            rows[k] = (i, f"{text}\n{form}\n{text}")
    return rows, truth


def test_secret_scan_finds_bare_keys_key_blocks_and_short_values(spark):
    rows, truth = bare_secret_rows()
    docs, text = documents(spark, rows), dict(rows)
    forest = secret_scan.train(docs)
    assert len(forest.trees) == secret_scan.TREES
    got = {(r.doc_id, text[r.doc_id].encode()[r.start : r.start + r.length].decode()) for r in secret_scan.scan(docs, forest).collect()}
    assert truth <= got and not any(re.fullmatch("[aeioutnrs]+", v) or "src/" in v for _, v in got)
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs, forest).collect()}
    assert not any(line in clean[i] for i, value in truth for line in value.split("\n"))


def test_secret_labels_need_evidence():
    letters = secret_scan.Letters(np.zeros((secret_scan._N,) * 2), np.zeros(secret_scan._N**3, bool))
    letters.usual[secret_scan._trigrams(b"the words of a correcthorsebatterystaple in voltlake/operators/somewhere.py")] = True

    def label(text, part):
        raw = text.encode()
        span = next(s for s in secret_scan._candidates(raw) if part.encode() in raw[s[0] : s[1]])
        return int(secret_scan.clear_case(np.array([secret_scan.features(raw, *span[:2], letters, span[2])]))[0])

    assert label("a correcthorsebatterystaple", "horse") == 0 and label("see voltlake/operators/somewhere.py", "voltlake") == 0
    assert label("commit 24be64d09a1c77f3e5b2", "24be") == 0 and label("no 4516744854574821", "4516") == 0
    assert label("x 24be64d09a1c77f3e5b2 y", "24be") == label("x kQzXvWpLmRtYbNsD y", "kQz") == -1
    assert label("password=kq7xw92z", "kq7") == label('token = "kQzXvWpLmRtYbNsD"', "kQz") == label("password=correcthorsebatterystaple", "horse") == 1
    assert label("keywords: correcthorsebatterystaple", "horse") < 1 and label("token = os.environ[kq7xw92z]", "kq7") < 1
    body = "MIIEpAIBAAKCAQEA7x2Y\\nq9Zk"
    for end in ("\\n-----END PRIVATE KEY-----", ""):
        raw = ('"private_key": "-----BEGIN PRIVATE' + f' KEY-----\\n{body}{end}"').encode()
        assert any(block and raw[i:j].startswith(b"MIIE") for i, j, block in secret_scan._candidates(raw))
    assert secret_scan.blocks(b"-----BEGIN PRIVATE" + b" KEY-----\nis how it starts, and\n-----END PRIVATE KEY----- how it ends") == []


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)


def random_texts(n):
    rng = random.Random(3)
    parts = ["a", "b", "the", "  ", " ", "\n", "é", "ß", "1", "2", "!", ".", "▁", "中", "\t", "ing", "<", ">", "ñ", "0x", "er", "token"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_piece_ids_equal_the_library(library):
    model = piece_bpe.PieceModel(PIECE_BPE)
    for text in [t or "" for _, t in TEXTS] + random_texts(1500):
        ids = [1, *library.encode(text), 2]
        got = model.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert model.decode(got) == library.decode(ids)


def test_any_ids_decode_as_in_the_library(library):
    model, rng = piece_bpe.PieceModel(PIECE_BPE), random.Random(4)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(259)]) for _ in range(rng.randrange(12))]
        if 0 not in ids:  # the unknown piece has a text of its own
            assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


def test_encoded_documents(spark, library):
    got = piece_bpe.encode_documents(documents(spark, TEXTS), PIECE_BPE, keep=True).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded) for r in got) == sorted(
        (str(i), len(library.encode(t or "")) + 2, library.decode(library.encode(t or ""))) for i, t in TEXTS
    )
    assert piece_bpe.encode_documents(documents(spark, []), PIECE_BPE).collect() == []


def test_token_counts_equal_the_library(spark, library):
    rows = TEXTS + [(100 + i, t) for i, t in enumerate(random_texts(200))]
    got = token_counts.token_counts(documents(spark, rows).repartition(3), PIECE_BPE, 100).collect()
    want = [(str(i), len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t in rows]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(want)
    assert token_counts.token_counts(documents(spark, []), PIECE_BPE).collect() == []


def brute_base(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\n"] for _, t in rows]
    held = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(x for w, h in zip(words, held, strict=True) if not h for x in w)
    n, v = sum(c.values()), len(c)
    return [
        (str(i), h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        for (i, _), h, w in zip(rows, held, words, strict=True)
    ]


def test_base_scores_against_brute_force(spark):
    docs = documents(spark, TEXTS).repartition(3)
    got = sorted(maxent_lm.score_documents(docs, maxent_lm.train(docs)).collect(), key=lambda r: (str(r.doc_id), r.base_score))
    for r, want in zip(got, sorted(brute_base(TEXTS), key=lambda w: (w[0], w[5])), strict=True):
        assert (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:5]
        assert r.base_score == pytest.approx(want[5], abs=1e-6) and math.isfinite(r.score)


def test_model_beats_its_base_on_held_out_texts(small):
    rows = [r for r in maxent_lm.score_documents(small, maxent_lm.train(small)).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


class Held:
    """A broadcast variable without Spark."""

    def __init__(self, value):
        self.value = value


def test_first_round_expects_what_a_sweep_at_zero_weights_does():
    rng = np.random.default_rng(8)
    text = " ".join(f"w{k}" for k in np.minimum(rng.zipf(1.3, 4000), 600)).encode()
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text[:999]])], ["doc_id", "text"])
    counts = np.zeros(maxent_lm.BINS)
    bins = next(iter(maxent_lm._bins([batch])))
    counts[bins.column("bin").to_numpy()] = bins.column("n").to_numpy()
    shape = Held(maxent_lm.Shape.of(counts))
    zero = Held([np.zeros((maxent_lm.FEATURES, r, maxent_lm.N_CLASS), np.float32) for r in maxent_lm.ROWS])
    first, swept = (
        [np.frombuffer(zlib.decompress(b.column("body")[0].as_py()), "<f4") for b in maxent_lm._counts(shape, w)([batch])] for w in (None, zero)
    )
    assert len(first) == len(swept) > 0
    for a, b in zip(first, swept, strict=True):
        assert a.shape == b.shape and a == pytest.approx(b, rel=1e-3, abs=1e-3)


def test_words_without_context_keep_their_share(spark):
    rng = np.random.default_rng(9)
    share = 1 / np.arange(1, 31)
    words = [f"w{k}" for k in range(30)]
    model = maxent_lm.train(documents(spark, [(i, " ".join(rng.choice(words, 800, p=share / share.sum()))) for i in range(60)]))
    drawn = rng.choice(words, 6000, p=share / share.sum()).tolist()
    h = maxent_lm._hashed([w.encode() for w in drawn])
    got = model.log10_slots(h, np.array([0]))
    slot = model.shape.slots_of(h)
    plain = (model.shape.log_class[slot // 16] + model.shape.log_member[slot // 16, slot % 16]) / math.log(10)
    for w in words[:10]:
        at = np.array([x == w for x in drawn])
        assert got[at].mean() == pytest.approx(plain[at].mean(), abs=0.05)


def test_slot_probabilities_sum_to_one(spark):
    model = maxent_lm.train(documents(spark, [(i, "a b c a b d " * (i + 1)) for i in range(20)]))
    h = maxent_lm._hashed([b"a", b"b", b"zz", maxent_lm.END])
    sweep = maxent_lm.Sweep(model.shape, h, np.array([0]))
    for level in (0, 1):
        p = maxent_lm.chances(model.shape, model.weights, sweep, level)
        assert p.shape == (16, 4) and p.sum(axis=0) == pytest.approx(np.ones(4), abs=1e-4)


def test_model_of_nothing(spark):
    none = documents(spark, [])
    model = maxent_lm.train(none)
    assert maxent_lm.score_documents(none, model).collect() == []
    assert len(maxent_lm.score_documents(documents(spark, [(1, "a b")]), model).collect()) == 1
