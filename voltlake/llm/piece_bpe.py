"""Exact encoding and decoding with a merge-type (BPE) piece model.

Merging the best pair again and again is what the model defines; it is found here by backtracking. At each place
the longest piece comes first (Aho-Corasick gives the longest match at every place in one sweep), and is taken if
it is compatible with the piece before it: merging the two pieces' joint text again gives just these two. Else the
next shorter piece is tried, then the piece before is taken back. As the merge result of every prefix is unique, a
place that failed once fails always; a bitfield keeps such places, so the time is linear in the text.

No piece of the model crosses from a word to the blank or mark after it, so texts fall into independent pre-tokens,
each encoded once per worker while it stays in a bounded memory. Characters without a piece become bytes.

Rules: a null text counts as empty, whose ids are begin and end alone. Malformed UTF-8 is read as U+FFFD. Repeated
rows and rows without doc_id give rows of their own; an empty table gives none.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import itertools
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import decode, documents_of

BLANK = "▁"
MEMORY = 500_000  # pre-tokens whose ids a worker remembers

codecs.register_error("byte_by_byte", lambda e: ("�", e.start + 1))


class PieceModel:
    """Pieces of a model file, and the two directions."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i] and not sp.is_byte(i)}
        self.score = [sp.get_score(i) for i in range(size)]
        self.known = {p for p in self.ids if len(p) == 1}
        if any(c not in self.known for p in self.ids for c in p):
            raise ValueError("a piece holds a character that is no piece itself")
        self.split = self._splitter()
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        #: For each piece the longest piece that is a proper prefix of it.
        self.shorter = [next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), None) for p in self.pieces]
        self.pairs: dict[int, bool] = {}
        self.size = [len(p) for p in self.pieces]
        self.text_of = ["", *self.pieces[1:]]
        self.memory: dict[str, bytes] = {}
        text = {i: p.replace(BLANK, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.text = [text.get(i, b"") for i in range(size)]

    def _splitter(self) -> re.Pattern | None:
        """A pattern for pre-tokens: runs of openers with what follows them, and line ends.

        Openers are the largest set of characters, none a letter, that no piece has after a character outside the
        set. A piece can't cross from what is no opener to an opener, so texts may be cut there.
        """
        pairs = {p for piece in self.ids for p in itertools.pairwise(piece)}
        openers = {c for c in self.known if not c.isalpha()}
        while inside := {b for a, b in pairs if a not in openers and b in openers}:
            openers -= inside
        if BLANK not in openers or "\n" in self.known:
            return None
        some = re.escape("".join(sorted(openers)))
        return re.compile(f"[{some}]+[^{some}\n]*|[^{some}\n]+|\n")

    def merge(self, text: str) -> list[int]:
        """Merge the best pair, leftmost of equals, until no two neighbours form a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return [self.ids[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: int, i: int) -> bool:
        """Whether merging leaves piece i, and the piece before it next to it, as they are. Piece 0 is no text."""
        if len(self.pairs) > MEMORY:
            self.pairs.clear()
        text = self.text_of[before] + self.pieces[i]
        good = self.pairs[before << 20 | i] = self.merge(text) == ([before, i] if before else [i])
        return good and (not before or self.pairs.get(i, False) or self.fits(0, i))

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        n = len(text)
        longest: list[int | None] = [None] * n
        for last, (i, size) in self.automaton.iter(text):
            longest[last - size + 1] = i  # ends come in order, so the longest stays
        failed = bytearray((n >> 3) + 1)
        size, shorter, known, fits = self.size, self.shorter, self.pairs, self.fits
        out: list[int] = []
        at, before, i = 0, 0, longest[0]  # no text is before the first piece, which piece 0 stands for
        while at < n:
            while i is not None:
                end = at + size[i]
                if not failed[end >> 3] >> (end & 7) & 1:
                    good = known.get(before << 20 | i)
                    if fits(before, i) if good is None else good:
                        break
                i = shorter[i]
            if i is None:
                failed[at >> 3] |= 1 << (at & 7)
                i = out.pop()
                at -= size[i]
                before = out[-1] if out else 0
                i = shorter[i]
            else:
                out.append(i)
                before, at = i, end
                i = longest[at] if at < n else None
        return out

    def encode_part(self, part: str) -> list[int]:
        """Ids of a pre-token; characters without a piece become bytes."""
        if self.known.issuperset(part):
            return self.backtrack(part)
        out: list[int] = []
        for known, run in itertools.groupby(part, self.known.__contains__):
            run = "".join(run)
            out += self.backtrack(run) if known else [self.bytes[b] for b in run.encode()]
        return out

    def parts(self, text: str) -> list[str]:
        """Pre-tokens of a text; merging never crosses their borders."""
        if not text:
            return []
        text = BLANK + text.replace(" ", BLANK)
        return self.split.findall(text) if self.split else [text]

    def part_ids(self, part: str) -> bytes:
        """Ids of a pre-token as little-endian 32-bit numbers."""
        if len(self.memory) > MEMORY:
            self.memory.clear()
        ids = self.encode_part(part)
        ids = self.memory[part] = struct.pack(f"<{len(ids)}I", *ids)
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text with begin and end, as little-endian 32-bit numbers."""
        get, make = self.memory.get, self.part_ids
        body = [get(p) or make(p) for p in self.parts(text)]
        return b"".join([self.begin.to_bytes(4, "little"), *body, self.end.to_bytes(4, "little")])

    def decode(self, ids: bytes) -> str:
        """Text of ids: blanks restored, the first one dropped, bytes joined, malformed ones replaced one by one."""
        ids = np.frombuffer(ids, "<u4").tolist()
        raw = b"".join(map(self.text.__getitem__, ids))
        if self.pieces[next((i for i in ids if self.text[i]), 0)].startswith(BLANK):
            raw = raw[1:]
        return raw.decode("utf-8", "byte_by_byte")


@functools.cache
def piece_model(path: str) -> PieceModel:
    """The model, once per worker."""
    return PieceModel(path)


def encode_documents(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ids and decoded, of every whole text."""
    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if keep:
        kinds |= {"ids": pa.binary(), "decoded": pa.string()}
        schema += ", ids binary, decoded string"

    def run(batches):
        model = piece_model(path)
        for b in batches:
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = model.encode(decode(raw))
                text = model.decode(ids)
                row = (doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                rows.append(row + (ids, text) * keep)
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))

    return documents_of(docs).mapInArrow(run, schema)
