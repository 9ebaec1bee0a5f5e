"""SentencePiece models on the tokenizers library.

``parse_model`` reads the model protobuf; ``rebuild`` makes a tokenizers pipeline of it:
the normaliser (precompiled map, extra blanks, dummy prefix), the metaspace marker, the
unigram scores or the BPE merges that the scores imply, byte fallback, and the decoder.
``check_parity`` compares it with the sentencepiece library.

When no piece has the marker after another character, no merge or best path crosses the
start of a marked run, so a text is the concatenation of such runs ("chunks"). Workers
then hand each new chunk to the library once, in multithreaded batches, and look the
rest up; every new chunk is also encoded by sentencepiece, and a text has parity when
all of its chunks do. Other models are encoded and compared text by text.

Defined results: null and empty texts have no ids, parity and round trip hold; a round
trip compares the decoded ids with the normalised text; repeated rows give repeated rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from postpulse.llm.common import id_and_text, map_frames

MARK = "▁"
#: Piece types and model types of the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MEMO = 200 << 20     # bytes held for chunks, and as many for groups of ids
ENTRY = 250          # of them for an entry beside its characters and ids
JOINED = 64          # new chunks per library call


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protobuf message; sub-messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = data[at:at + 8], at + 8
        elif kind == 2:
            n = varint()
            value, at = data[at:at + n], at + n
        elif kind == 5:
            value, at = struct.unpack("<f", data[at:at + 4])[0], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_marker: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_blanks: bool = True
    escape_blanks: bool = True

    def ids(self) -> dict[str, int]:
        return {p: i for i, (p, _, _) in enumerate(self.pieces)}

    def unknown(self) -> int:
        return next(i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN)

    def chunked(self) -> bool:
        """Whether runs that start with the marker are encoded independently."""
        return (not self.suffix_marker and not self.charsmap and not self.squeeze_blanks
                and not any(t == USER for _, _, t in self.pieces)
                and not any(MARK in p.lstrip(MARK) for p, _, t in self.pieces if t == NORMAL))


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            part = dict(fields(value))
            model.pieces.append((part[1].decode("utf-8"), part.get(2, 0.0), part.get(3, NORMAL)))
        elif number == 2:
            part = dict(fields(value))
            model.kind = part.get(3, UNIGRAM)
            model.suffix_marker = bool(part.get(24, 0))
            model.byte_fallback = bool(part.get(35, 0))
        elif number == 3:
            part = dict(fields(value))
            model.charsmap = part.get(2, b"")
            model.dummy_prefix = bool(part.get(3, 1))
            model.squeeze_blanks = bool(part.get(4, 1))
            model.escape_blanks = bool(part.get(5, 1))
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """Every split of a normal piece into two known pieces, best-scored pieces first."""
    ids = {p: i for i, (p, _, t) in enumerate(model.pieces) if t in (NORMAL, USER)}
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL and len(piece) > 1:
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in ids and b in ids:
                    found.append((-score, ids[piece], ids[a], ids[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def rebuild(model: Model):
    """A tokenizers pipeline that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers
    if model.kind == BPE:
        core = models.BPE(model.ids(), merges_of(model), unk_token=model.pieces[model.unknown()][0],
                          fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown(),
                              model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_blanks:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if model.escape_blanks:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence(steps)
    if model.chunked():
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"),
                                                       "removed", invert=True)
    tokenizer.decoder = decoder(model, strip=model.dummy_prefix)
    return tokenizer


def decoder(model, strip: bool):
    from tokenizers import decoders
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    return decoders.Sequence(undo + [decoders.Strip(" ", 1, 0)] if strip else undo)


class Backend:
    """Encoder, decoder and parity check of one model file."""

    CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def __init__(self, data: bytes):
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model = parse_model(data)
        self.tokenizer = rebuild(self.model)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.known: dict[str, bytes] = {}          # ids of chunks
        self.apart: set[str] = set()               # chunks without parity
        self.held = 0
        self.texts: dict[bytes, str] = {}          # of groups of ids
        self.held_texts = 0
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        # blanks in a piece's text; a piece that could hide one counts as two
        self.blanks = np.array([2 if t in (UNKNOWN, CONTROL) or p == "<0x20>" or " " in p
                                else p.count(MARK) for p, _, t in self.model.pieces])
        self.bytes_of = [self._bytes(p, t) for p, _, t in self.model.pieces]
        # bytes of the normalised text that an id stands for; unknown ones end the count
        self.width_of = np.array([1 if t == BYTE else len(p.encode()) if t != UNKNOWN else 1 << 40
                                  for p, _, t in self.model.pieces])
        self.chunked = self.model.chunked()
        self.core = Tokenizer(self.tokenizer.model)     # takes text that is normalised already
        if self.chunked:
            self.core.pre_tokenizer = self.tokenizer.pre_tokenizer
        self.core.decoder = decoder(self.model, strip=False)

    def _bytes(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return piece.replace(MARK, " ").encode() if kind != UNKNOWN else " ⁇ ".encode()

    def normal(self, text: str) -> str:
        if self.chunked:
            text = text.replace(" ", MARK) if self.model.escape_blanks else text
            return MARK + text if self.model.dummy_prefix and text else text
        return self.tokenizer.normalizer.normalize_str(text)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool]]:
        """(ids, parity) of each text."""
        texts = [t or "" for t in texts]
        if not self.chunked:
            mine = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [(np.array(a.ids, "<u4"), a.ids == b)
                    for a, b in zip(mine, self.other.encode(texts))]
        chunks = [self.CHUNK.findall(self.normal(t)) for t in texts]
        self._learn(set(chain.from_iterable(chunks)).difference(self.known))
        got = self.known.__getitem__
        out = [(np.frombuffer(b"".join(map(got, cs)), "<u4"), self.apart.isdisjoint(cs))
               for cs in chunks]
        if self.held > MEMO:
            self.known, self.apart, self.held = {}, set(), 0
        return out

    def _learn(self, fresh: set[str]) -> None:
        """Encode new chunks by both libraries, ``JOINED`` of them per text.

        The text after the dummy prefix is what sentencepiece gets, so a group starts with the
        marker; the ids of a chunk are those that spell its bytes.
        """
        prefix = MARK if self.model.dummy_prefix else ""
        # a chunk of markers alone would run into the next one
        marked = [c for c in fresh if c.startswith(prefix) and c.strip(MARK)]
        groups = [marked[i:i + JOINED] for i in range(0, len(marked), JOINED)]
        texts = ["".join(g)[len(prefix):].replace(MARK, " ") for g in groups]
        mine = self.core.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)
        for group, a, b in zip(groups, mine, self.other.encode(texts, num_threads=1)):
            ids = np.array(a.ids, "<u4")
            sizes = [len(c.encode("utf-8", "surrogatepass")) for c in group]
            ends = np.searchsorted(np.cumsum(self.width_of[ids]), np.cumsum(sizes)) + 1
            if a.ids == b and ends[-1] == len(ids):
                at = 0
                for c, end in zip(group, ends.tolist()):
                    self._keep(c, ids[at:end], True)
                    at = end
            else:
                self._learn_alone(group)
        self._learn_alone([c for c in fresh if c not in self.known])

    def _learn_alone(self, chunks: list[str]) -> None:
        prefix = MARK if self.model.dummy_prefix else ""
        for c in chunks:
            ids = self.core.encode(c, add_special_tokens=False).ids
            # the prefix alone is no text of its own, so there is nothing to compare
            same = c == prefix or ids == self.other.encode(c[len(prefix):].replace(MARK, " "))
            self._keep(c, np.array(ids, "<u4"), same)

    def _keep(self, chunk: str, ids: np.ndarray, same: bool) -> None:
        self.known[chunk] = ids.tobytes()
        if not (same and self.spells_chunk(chunk, ids)):
            self.apart.add(chunk)
        self.held += ENTRY + 2 * len(chunk) + 4 * len(ids)     # the marker is a two-byte character

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_batch([ids])[0]

    def decode_batch(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of id sequences, by the rebuilt decoder.

        Only bytes that follow each other are decoded together, and no byte begins with the
        marker: a sequence decodes as its groups from one such piece to the next do. Groups met
        before are looked up.
        """
        if not self.chunked:
            return self.tokenizer.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)
        groups = []
        for one in ids:
            raw, edge = one.tobytes(), (4 * np.flatnonzero(self.begins[one])).tolist()
            if len(one) and (not edge or edge[0]):
                edge.insert(0, 0)
            groups.append([raw[a:b] for a, b in zip(edge, [*edge[1:], len(raw)])])
        self._read(list(set(chain.from_iterable(groups)).difference(self.texts)))
        out = ["".join(map(self.texts.__getitem__, gs)) for gs in groups]
        if self.held_texts > MEMO:
            self.texts, self.held_texts = {}, 0
        return [t[1:] if self.model.dummy_prefix and t.startswith(" ") else t for t in out]

    def _read(self, fresh: list[bytes]) -> None:
        """Decode new groups. Those with one blank, at their start, go ``JOINED`` to a call: the
        text of such a call falls apart at its blanks."""
        if not fresh:
            return
        ids = np.frombuffer(b"".join(fresh), "<u4")
        at = np.concatenate([[0], np.cumsum([len(g) // 4 for g in fresh])[:-1]])
        one = (np.add.reduceat(self.blanks[ids], at) == 1) & self.begins[ids[at]]
        easy = [g for g, o in zip(fresh, one.tolist()) if o]
        calls = [easy[i:i + JOINED] for i in range(0, len(easy), JOINED)]
        texts = self.core.decode_batch([np.frombuffer(b"".join(c), "<u4").tolist() for c in calls],
                                       skip_special_tokens=False)
        for call, text in zip(calls, texts):
            words = text.split(" ")
            if len(words) == len(call) + 1 and not words[0]:
                self._hold(call, [" " + w for w in words[1:]])
        rest = [g for g in fresh if g not in self.texts]
        self._hold(rest, self.core.decode_batch(
            [np.frombuffer(g, "<u4").tolist() for g in rest], skip_special_tokens=False))

    def _hold(self, groups: list[bytes], texts: list[str]) -> None:
        self.texts.update(zip(groups, texts))
        self.held_texts += sum(ENTRY + len(g) + 2 * len(t) for g, t in zip(groups, texts))

    def round_trips(self, texts: list[str | None], ids: list[np.ndarray]) -> list[bool]:
        """Whether the rebuilt decoder gives each normalised text back, without the dummy prefix."""
        prefix = 1 if self.model.dummy_prefix else 0
        want = (self.normal(t or "").replace(MARK, " ")[prefix:] for t in texts)
        return [a == b for a, b in zip(self.decode_batch(ids), want)]

    def spells_chunk(self, chunk: str, ids: np.ndarray) -> bool:
        """Whether the pieces of the ids are the chunk of normalised text, byte for byte."""
        pieces = self.bytes_of
        return b"".join([pieces[i] for i in ids.tolist()]) == chunk.replace(MARK, " ").encode(
            "utf-8", "surrogatepass")

    def spells(self, text: str | None, ids: np.ndarray) -> bool:
        """The same for a whole text."""
        return self.spells_chunk(self.normal(text or ""), ids)


def check_parity(data: bytes, texts: list[str]) -> list[int]:
    """Positions of the texts whose whole-text encodings differ between the libraries."""
    backend = Backend(data)
    mine = backend.tokenizer.encode_batch(texts, add_special_tokens=False)
    return [i for i, (a, b) in enumerate(zip(mine, backend.other.encode(texts))) if a.ids != b]


_backends: dict[str, Backend] = {}


def backend(path: str) -> Backend:
    """This worker's backend for a model file of the installed vocabulary package."""
    if path not in _backends:
        with open(path, "rb") as f:
            _backends[path] = Backend(f.read())
    return _backends[path]


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, parity, round_trip per row; whole texts, one narrow pass."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend(path)
        for pdf in frames:
            for lo in range(0, len(pdf), 500):
                cut = pdf.iloc[lo:lo + 500]
                texts = [t if isinstance(t, str) else None for t in cut["text"]]
                got = model.encode(texts)
                yield pd.DataFrame({
                    "doc_id": cut["doc_id"].values,
                    "n_tokens": [len(i) for i, _ in got],
                    "ids_crc32": [zlib.crc32(i.tobytes()) for i, _ in got],
                    "parity": [p for _, p in got],
                    "round_trip": model.round_trips(texts, [i for i, _ in got]),
                    "ids": [i.tobytes() for i, _ in got]})

    return map_frames(
        id_and_text(df, id_col, text_col), run, "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean, "
             "ids binary")
