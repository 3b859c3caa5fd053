"""Token ids of whole texts by the file of a byte-level pair tokenizer.

The ids are those the tokenizers library gives for the file. Where the file describes a plain
byte-level tokenizer whose merges rank like their ids, the same merges run in tiktoken, which needs
less time; the tests hold both to the same ids. Files set up otherwise, and texts that hold one of
a file's added tokens, go to the tokenizers library itself."""

from __future__ import annotations

import json
import re

import numpy as np

from wayfold.llm.arrays import by_value

by_value(__name__)

#: Fixed value: how such a tokenizer splits a text before it merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """The characters that name bytes in such a file: printable ones themselves, the others from 256 on."""
    plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(rest)}


def ranks(told: dict) -> dict[bytes, int] | None:
    """Bytes of every token and its id, or None where ids don't rank merges in order."""
    model, first = told.get("model") or {}, told.get("pre_tokenizer") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if (model.get("type") != "BPE" or any(model.get(k) for k in odd) or told.get("normalizer") or told.get("post_processor") or first.get("type") != "ByteLevel" or not first.get("use_regex") or first.get("add_prefix_space")):
        return None
    names, vocab = byte_names(), model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab["".join(m)] for m in merges]
    if made != sorted(made) or len(vocab) != 256 + len(merges) or any(vocab[c] >= min(made, default=256) for c in names):
        return None
    return {bytes(names[c] for c in token): i for token, i in vocab.items()}


class TextEncoder:
    def __init__(self, file: str):
        from tokenizers import Tokenizer
        self.whole, self.merges = Tokenizer.from_file(file), None
        with open(file, encoding="utf-8") as f:
            told = json.load(f)
        if found := ranks(told):
            import tiktoken
            self.merges = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=found, special_tokens={})
        added = [t["content"] for t in told.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added))) if added else re.compile("(?!)")

    def ids(self, text: str) -> np.ndarray:
        if self.merges and not self.added.search(text):
            return self.merges.encode_to_numpy(text, disallowed_special=())
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and the number of ids of each."""
        runs = [self.ids(t) for t in texts]
        return np.concatenate(runs) if runs else np.empty(0, "<u4"), np.fromiter(map(len, runs), np.int64, len(runs))


_ENCODERS: dict = {}


def encoder(file: str) -> TextEncoder:
    """The worker's encoder of a tokenizer file."""
    if file not in _ENCODERS:
        _ENCODERS[file] = TextEncoder(file)
    return _ENCODERS[file]
