"""Ids of whole texts by a byte-level BPE tokenizer file, without encoding a word twice.

A byte-level BPE splits a text by its pattern before it merges anything, and a space that
is followed by other than white space always begins a new piece. So a text may be cut in
front of such spaces, and each distinct cut (a word with what clings to it) is encoded
once per worker and looked up afterwards. Texts in which a space meets further white space
are encoded whole.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the split pattern of byte-level BPE files that say ``use_regex``.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept by a worker; beyond that it starts anew.
CACHE_WORDS = 600_000


def _byte_characters() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Encoder:
    """Encodes columns of texts; one per worker and tokenizer file."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [token["content"] for token in spec["added_tokens"]]
        self.cache: dict[str, bytes] = {}
        self.fast = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict):
        """A faster encoder of the same vocabulary, if its ids are the ranks of its merges."""
        import tiktoken

        splits = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or splits.get("type") != "ByteLevel" or splits.get("add_prefix_space"):
            return None
        characters = _byte_characters()
        added = {token["content"] for token in spec["added_tokens"]}
        vocabulary = {k: v for k, v in spec["model"]["vocab"].items() if k not in added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
            return None
        ranks = {bytes(characters[c] for c in token): rank for token, rank in vocabulary.items()}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, texts: list[str]) -> list[bytes]:
        if self.fast is None:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        made = []
        for text in texts:
            if any(token in text for token in self.special):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = self.fast.encode_ordinary(text)
            made.append(array("I", ids).tobytes())
        return made

    def _known(self, words: list[str]) -> list[bytes]:
        cache = self.cache
        new = [w for w in words if w not in cache]
        if new:
            if len(cache) + len(new) > CACHE_WORDS:
                cache.clear()
                new = words
            cache.update(zip(new, self._ids(new), strict=True))
        return [cache[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin (one more at the end)."""
        texts = pc.fill_null(texts, "")
        cuts = pc.split_pattern(texts, " ")
        bounds = cuts.offsets.to_numpy().astype(np.int64)
        bounds, values = bounds - bounds[0], cuts.flatten()
        encoded = values.dictionary_encode()
        codes = encoded.indices.to_numpy().astype(np.int64)
        distinct = encoded.dictionary.to_pylist()
        open_ended = np.array([not w or w[0].isspace() for w in distinct], bool)
        # The first cut has no space before it, and may begin with any white space.
        heads = bounds[:-1]
        odd = open_ended[codes]
        odd[heads] = False
        whole = np.add.reduceat(odd, heads) > 0 if len(heads) else np.zeros(0, bool)
        first = values.take(pa.array(heads)).to_pylist()
        rows = np.flatnonzero(whole)
        known = [
            *self._known([" " + w for w in distinct]),
            *self._known(first),
            *self._ids(texts.take(pa.array(rows)).to_pylist()),
        ]
        codes[heads] = len(distinct) + np.arange(len(heads))
        sizes = np.array([len(k) // 4 for k in known], np.int64)
        starts = np.r_[0, np.cumsum(sizes)]
        flat = np.frombuffer(b"".join(known), np.uint32)
        row = np.repeat(np.arange(len(heads)), np.diff(bounds))
        keep = ~whole[row]
        keep[heads[rows]] = True
        codes[heads[rows]] = len(distinct) + len(first) + np.arange(len(rows))
        codes, row = codes[keep], row[keep]
        taken = sizes[codes]
        ends = np.cumsum(taken)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(starts[codes] - (ends - taken), taken) + np.arange(total)]
        per_row = np.bincount(row, weights=taken, minlength=len(heads)).astype(np.int64)
        return ids, np.r_[0, np.cumsum(per_row)]
