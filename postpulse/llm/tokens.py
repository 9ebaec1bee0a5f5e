"""Encoding with the tokenizers library, one call per distinct chunk.

A tokenizer whose pre-tokenizer never joins text across a blank encodes a text as the
concatenation of its blank-separated words. Workers keep the ids of the chunks they have
met (bounded by ``MEMO`` bytes, then forgotten), and hand only new chunks to the
library, many per call. Texts go through whole; nothing is cut or skipped.
"""

from __future__ import annotations

import importlib
import json
import os
import re

import numpy as np

MEMO = 130 << 20     # bytes held for chunks
ENTRY = 190          # of them for an entry beside its characters and ids
JOINED = 64          # new pieces per library call

#: Characters whose lower case and NFC form Python and the library give alike: printable
#: ASCII, blanks and the composed Latin letters up to U+017F, without U+0130.
PLAIN = re.compile("[ -~\t-\rÀ-ÖØ-öø-įı-ſ]*")
BLANK = re.compile("[ \t-\r]+")
#: The tokenizer's own word pattern, over those characters.
PIECE = re.compile("[a-zÀ-ÖØ-öø-ſ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|"
                   "[^\\sa-z0-9À-ÖØ-öø-ſ]+")
PIECE_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files are; a full path is taken as it is."""
    return name if os.path.isabs(name) else importlib.import_module("public_tokenizers").path(name)


def word_rule(config: dict) -> str:
    """The pattern of a pre-tokenizer that drops blanks and isolates what it matches, else ''."""
    pre = config.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
        return first["pattern"].get("Regex", "")
    return ""


class WordEncoder:
    """Ids of whole texts as little-endian 32-bit words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        rule = word_rule(config)
        self.apart = "\\s" in rule
        suffix = config["model"].get("end_of_word_suffix")
        self.pieces_known = rule == PIECE_RULE and bool(suffix)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        if suffix:
            self.ends_word[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.special = [t["content"].lower() for t in config.get("added_tokens", [])]
        self.ids: dict[str, bytes] = {}
        self.held = 0

    def vocabulary_bits(self) -> int:
        return max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        if not self.apart:
            return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(
                texts, add_special_tokens=False)]
        split = list(map(self._chunks, texts))
        self._learn({c for cs in split for c in cs if c not in self.ids})
        got = self.ids.__getitem__
        out = [np.frombuffer(b"".join(map(got, cs)), dtype="<u4") for cs in split]
        if self.held > MEMO:
            self.ids, self.held = {}, 0
        return out

    def _chunks(self, text: str) -> list[str]:
        """Pre-tokens where Python finds them as the library does, else words after a blank."""
        lower = text.lower()
        if self.pieces_known and not any(s in lower for s in self.special):
            if PLAIN.fullmatch(text):
                return PIECE.findall(lower)
            out = []
            for word in BLANK.split(text):
                out += PIECE.findall(word.lower()) if PLAIN.fullmatch(word) else [" " + word]
            return out
        return [" " + word for word in BLANK.split(text)]

    def _learn(self, fresh: set[str]) -> None:
        pieces = [c for c in fresh if c[0] != " "]
        groups = [pieces[i:i + JOINED] for i in range(0, len(pieces), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(
                [" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4   # each piece ends in one such id
            data, at = ids.tobytes(), 0
            for p, end in zip(group, ends.tolist(), strict=True):
                self._keep(p, data[at:end])
                at = end
        words = [c for c in fresh if c[0] == " "]
        for c, e in zip(words, self.tokenizer.encode_batch_fast(
                [c[1:] for c in words], add_special_tokens=False)):
            self._keep(c, np.array(e.ids, dtype="<u4").tobytes())

    def _keep(self, chunk: str, ids: bytes) -> None:
        self.ids[chunk] = ids
        self.held += ENTRY + len(chunk) * (1 if chunk.isascii() else 2) + len(ids)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
