"""Byte-level BPE ids from a tokenizer file named by its path."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import tiktoken

# The pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_char() -> dict[str, int]:
    """The vocabulary file writes printable bytes as themselves and the others as the characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(printable))
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


@functools.cache
def byte_bpe(path: str) -> tiktoken.Encoding:
    """The encoder of a `tokenizers` byte-level BPE file: same ids, found several times faster.

    Ids follow the order of merges, so they serve as ranks. Added tokens are matched inside texts, which is the
    library's default.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = _byte_of_char()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: White space as the pattern means it. A run of so many characters is encoded by itself, as the engine of the pattern
#: keeps a state for every character it may have to give back.
LONG_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def byte_bpe_ids(path: str, text: str) -> np.ndarray:
    """Ids of a whole text.

    The pattern makes one pre-token of a run of white space, less its last character if more text follows, so long
    runs are cut out at those borders.
    """
    encoder, parts, at = byte_bpe(path), [], 0
    for run in LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        parts.append(encoder.encode_to_numpy(text[at : run.start()], allowed_special="all"))
        parts.append(np.array(encoder._encode_single_piece(text[run.start() : end]), np.uint32))
        at = end
    parts.append(encoder.encode_to_numpy(text[at:], allowed_special="all"))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]
