"""Token ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import re

import numpy as np

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
# Texts of these characters only, without a special token's string, are split alike by both libraries.
PLAIN = re.compile("[\x00-\x7F\u00A0-\u024F\u2010-\u2026\u20AC]*")
SPECIAL = "<|"


class Encoder:
    """The ids that ``tokenizers`` gives for the vocabulary file, without special tokens added.

    Plain texts are encoded from the rank file of the same vocabulary, which gives the same ids in a quarter
    of the time; all other texts go through ``tokenizers`` itself. Both files are opened when first needed.
    """

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None) -> None:
        import public_tokenizers

        self._vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
        self._ranks = ranks or public_tokenizers.path(RANKS)
        self._pattern = public_tokenizers.PATTERN
        self._fast = self._full = None

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text or not PLAIN.fullmatch(text):
            return self.full_ids(text)
        if self._fast is None:
            import tiktoken

            with open(self._ranks, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding("ranks", pat_str=self._pattern, mergeable_ranks=ranks, special_tokens={})
        return self._fast.encode_to_numpy(text, disallowed_special=())

    def full_ids(self, text: str) -> np.ndarray:
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self._vocabulary)
        return np.array(self._full.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
