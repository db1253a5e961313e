"""Token ids of whole texts, with the ids of repeated words kept per Python worker.

The vocabulary's normaliser and splitter never look across ASCII white space, so the ids of a
text are the ids of its words, one after the other. A batch is split by Arrow, its distinct words are
numbered, and words of letters lose their case and the ASCII punctuation behind them, which is looked
up by itself; the ids of all texts are then gathered by number. A worker keeps the ids of what it has
looked up and encodes what is new in a batch at once. When the store holds ``KEPT_WORDS``, it becomes the
older one and a new one is begun, into which what is looked up again is taken over.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT_WORDS = 300_000
# The character by which byte-level vocabularies write a byte (printable ones stand for themselves)
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
# Letters that have no other normal form but their lower case, and ASCII punctuation behind them
_LETTERS = "^(?P<core>[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<tail>[!-/:-@\\[-`{-~]*)$"
_ENCODERS: dict[str, Encoder] = {}


def _as_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.ids: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(words, add_special_tokens=False)
        return [_as_bytes(e.ids) for e in found]

    def _learn(self, new: list[str], simple: list[bool]) -> None:
        """Keep the ids of new keys; ``simple`` ones are letters in lower case."""
        ids, tokenize = self.ids, self.tok.model.tokenize
        whole = [w for w, s in zip(new, simple, strict=True) if not s]
        ids.update(zip(whole, self._encode(whole), strict=True))
        for core, s in zip(new, simple, strict=True):
            if s:
                # letters of ASCII stand for their own bytes
                spelt = core if core.isascii() else core.encode().decode("latin-1").translate(_BYTE_CHARS)
                ids[core] = _as_bytes([p.id for p in tokenize(spelt)])

    def _found(self, keys: pa.Array, simple: np.ndarray) -> list[bytes]:
        """Ids of each key; a key may stand there more than once."""
        listed = keys.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.ids.get, listed))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = {listed[i]: i for i in missing}
            known = {w: self.older[w] for w in new if w in self.older}
            self.ids.update(known)
            new = {w: i for w, i in new.items() if w not in known}
            self._learn(list(new), simple[np.fromiter(new.values(), np.int64, len(new))].tolist())
            for i in missing:
                found[i] = self.ids[listed[i]]
        return found

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Per text its ids as little-endian 32-bit integers; a missing text counts as empty."""
        if not len(texts):
            return []
        if len(self.ids) > KEPT_WORDS:
            self.older, self.ids = self.ids, {"": b""}
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(column.fill_null(""))
        numbered = split.flatten().dictionary_encode()
        words, at = numbered.dictionary, numbered.indices.to_numpy()
        # letters with ASCII punctuation behind them are split there by the vocabulary's own pattern
        parts = pc.extract_regex(words, _LETTERS)
        simple = parts.is_valid()
        tails = pc.if_else(simple, parts.field("tail"), "").dictionary_encode()
        found = self._found(pc.if_else(simple, pc.utf8_lower(parts.field("core")), words), simple.to_numpy(zero_copy_only=False))
        behind = self._found(tails.dictionary, np.zeros(len(tails.dictionary), bool))
        flat = np.frombuffer(b"".join([*found, *behind]), "<u4")
        length = np.fromiter(map(len, [*found, *behind]), np.int64, len(found) + len(behind)) // 4
        start = np.cumsum(length) - length
        # every id of every word of the batch and of what stands behind it, by its place in ``flat``
        unit = np.stack([at, (len(found) + tails.indices.to_numpy())[at]], axis=1).ravel()
        n = length[unit]
        ends = np.cumsum(n)
        out = flat[np.repeat(start[unit] - (ends - n), n) + np.arange(n.sum())].tobytes()
        cut = 4 * np.r_[0, ends][2 * split.offsets.to_numpy().astype(np.int64)]
        return [out[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
