"""A byte-level BPE vocabulary file as an encoder, a table of token bytes and a splitter, loaded once per process."""

from __future__ import annotations

import functools
import json

import numpy as np
import tiktoken
from tokenizers import Tokenizer

DEFAULT_FILE = "byte_bpe_50k.json"
# The word pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(DEFAULT_FILE))


def _byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the other bytes as U+0100 onward."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parsed = json.load(file)
        letters = _byte_of_letter()
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        ranks = {bytes(letters[c] for c in text): i for text, i in parsed["model"]["vocab"].items() if text not in self.special}
        self.encoding = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.size = max(*ranks.values(), *self.special.values(), -1) + 1
        self.bytes_of = [b""] * self.size
        for token, i in [*ranks.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = token
        self.decimal_of = [str(i) for i in range(self.size)]
        self.path = path

    @functools.cached_property
    def _splitter(self):
        """Only long texts need it."""
        return Tokenizer.from_file(self.path).pre_tokenizer

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode(text, allowed_special="all")

    def encode_array(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens of bytes that the pattern does not split."""
        return self.encoding._encode_single_piece(word)

    def word_starts(self, text: str) -> list[int]:
        return [span[0] for _, span in self._splitter.pre_tokenize_str(text)]

    def decode(self, ids) -> str:
        """Bytes that are not UTF-8 become U+FFFD; ids outside the vocabulary are left out, as are special-free gaps."""
        table, known = self.bytes_of, np.asarray(ids, dtype=np.int64)
        known = known[(known >= 0) & (known < self.size)]
        return b"".join([table[i] for i in known.tolist()]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)
