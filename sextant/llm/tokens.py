"""Token ids of the public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import json
from functools import cache

import numpy as np

VOCABULARY = "byte_bpe_50k"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def plain(path: str, special: bool = True):
    """The tokenizer of a ``tokenizers`` file as it is; without ``special``, strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    if not special:
        out.encode_special_tokens = True
    return out


@cache
def _fast(path: str, file: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(file, encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"] if x["special"]}
    ranks = {k: v for k, v in ranks.items() if v not in special.values()}
    return tiktoken.Encoding("sextant", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """Ids of whole texts. The same vocabulary read as ranks is several times as fast on one core as the tokenizers
    file and gives the same ids (a test holds them together); the file is used where the ranks' reader gives up.

    Strings of special tokens in a text get the special ids, as the file has it, or are ordinary text without ``special``.
    """

    def __init__(self, name: str = VOCABULARY, special: bool = True):
        import public_tokenizers

        self.json, self.special = vocabulary_path(f"{name}.json"), special
        self.fast = _fast(vocabulary_path(f"{name}.tiktoken"), self.json, public_tokenizers.PATTERN)

    def __call__(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all" if self.special else set(), disallowed_special=()), dtype="<u4")
        except BaseException as e:  # a panic of the engine on a very long run is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return np.array(plain(self.json, self.special).encode(text, add_special_tokens=False).ids, dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return self.fast.decode_bytes([int(x) for x in ids])
