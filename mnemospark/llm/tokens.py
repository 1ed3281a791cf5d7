"""Fast exact encoding with a word-level byte-pair vocabulary, for use inside Arrow batches.

Words repeat far more often than they are new, so each is merged once and its ids are looked up after that. A word is
merged with an end byte that no UTF-8 text holds; as the ids of single end pieces are lower than any merge's, the order
of merges is the vocabulary's own. Texts with characters for which the normaliser's rules differ between libraries are
encoded by the tokenizer itself.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array

import numpy as np

# Letters, numbers and white space of the blocks that take the fast way.
_LETTER = "a-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \u0085  -     "
# No letter or number begins an apostrophe's suffix, so the frequent classes come first.
_WORDS = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_OTHER = re.compile("[^\x00-ɏ -⁯₠-₿]")
_END = b"\xff"
#: Words whose ids a process keeps; beyond it starts anew.
CACHE_WORDS = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    def __init__(self, merge, dtype):
        super().__init__()
        self.merge, self.code = merge, {2: "H", 4: "I"}[dtype.itemsize]

    def __missing__(self, word: str) -> bytes:
        ids = array(self.code, self.merge(word.encode() + _END))
        if sys.byteorder == "big":
            ids.byteswap()
        ids = ids.tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """encode(text) gives the ids of a text as bytes of little-endian dtype, without special tokens."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = False
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, special = spec["model"]["vocab"], [x["content"] for x in spec["added_tokens"]]
        self.dtype = np.dtype("<u2") if self.whole.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.vocab_size = self.whole.get_vocab_size()
        #: A text that spells a special token is left to the tokenizer.
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        suffix = spec["model"].get("end_of_word_suffix")
        self.words = None
        if suffix == "</w>":
            letters = _byte_letters()
            ranks = {}
            for token, rank in vocab.items():
                ended = token.endswith(suffix)
                body = token[: -len(suffix)] if ended else token
                if all(c in letters for c in body) and token not in special:
                    ranks[bytes(letters[c] for c in body) + _END * ended] = rank
            self.words = _Words(tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece, self.dtype)

    def encode(self, text: str) -> bytes:
        short = text.isascii()  # then it is normal, and all of it takes the fast way
        plain = text.lower() if short else unicodedata.normalize("NFC", text).lower()
        if self.words is None or not short and _OTHER.search(plain) or self.special is not None and self.special.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self.words.__getitem__, _WORDS.findall(plain)))


def encoder(path: str) -> Encoder:
    """The worker process's encoder for this file, kept between tasks."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_kept_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
