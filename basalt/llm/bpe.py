"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never lie inside an encoded token, since
every merge result is a token.  Such pairs are certain cuts: the parts between them are encoded
independently and their ids concatenated, which gives the ids of the whole.  The parts are short
and repeat, so they are kept in bounded caches; a long unbroken text costs no more than its parts.
Merges within a part are the tokenizers library's BPE model; pre-tokenization, special tokens,
cuts and decoding are done here.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.models import BPE

from .common import release, slices

#: The pattern of byte-level BPE pre-tokenization.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and digits newer than those that the tokenizers library knows, as first and last code point;
#: it takes them for neither.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
    (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Bytes in each of the two generations of a cache, entries' own overhead included, and the longest key kept.
CACHE_BYTES, LONGEST_KEY = 12 << 20, 64
#: What an entry costs beside the characters of its key and value: two objects and its place in the table.
ENTRY = 200
#: Rows that are worked on at a time, so that what is made of a batch stays small.
ROWS = 256
#: Texts whose UTF-8 bytes stay at or below this lead byte hold only code points up to U+023F.
LATIN = 0xC8


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class _Cache(dict):
    """Values made once; of two generations, the older is dropped when the younger holds CACHE_BYTES.

    Long keys are never kept: they hardly repeat, and one of them could outweigh thousands.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.held = make, {}, 0

    def __missing__(self, key):
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= LONGEST_KEY:
            if self.held >= CACHE_BYTES:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[key] = out
            self.held += ENTRY + 2 * len(key) + len(out)
        return out

    def empty(self) -> None:
        self.clear()
        self.old, self.held = {}, 0


def latin_pattern() -> re.Pattern:
    """PATTERN for texts of code points up to U+023F, with its classes written out."""
    chars = [chr(c) for c in range(0x240)]
    cls = lambda p: "".join(re.escape(c) for c in chars if regex.match(p, c))
    l, n, s = cls(r"\p{L}"), cls(r"\p{N}"), cls(r"\s")
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{l}]+| ?[{n}]+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+")


class ForcedBoundaryBpe:
    """An encoder and decoder over the contents of a tokenizer JSON file."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        if model["type"] != "BPE" or (j.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or j.get("normalizer"):
            raise ValueError("only byte-level BPE vocabularies without a normalizer are supported")
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in j.get("added_tokens", [])}
        self.alphabet = byte_alphabet()
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.model = BPE(vocab=model["vocab"], merges=pairs, cache_capacity=0)
        self.token = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        inside = np.zeros(65536, bool)
        for t in self.ids:
            if len(t) > 1:
                b = np.frombuffer(t, np.uint8).astype(np.int32)
                inside[b[:-1] * 256 + b[1:]] = True
        self.cut = (~inside).tobytes()  # the certain cuts: 1 at 256 * first byte + second byte
        self.prefix = bool(j["pre_tokenizer"].get("add_prefix_space"))
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        cls = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NEWER)
        self.newer, self.latin, self.words = regex.compile(f"[{cls}]"), latin_pattern(), regex.compile(PATTERN)
        strict = PATTERN.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|[NEWER])").replace(r"\p{L}+", r"(?:(?![NEWER])\p{L})+").replace(r"\p{N}+", r"(?:(?![NEWER])\p{N})+").replace("NEWER", cls)
        self.strict = regex.compile(strict)
        self.parts = _Cache(self._part)
        self.pieces = _Cache(self._piece)

    def _part(self, part: bytes) -> bytes:
        """The ids of a part without certain cuts, by its merges alone."""
        shown = "".join([self.alphabet[b] for b in part])
        return struct.pack(f"<{len(t := self.model.tokenize(shown))}I", *[x.id for x in t])

    def _piece(self, piece: str) -> bytes:
        """The ids of one pre-token as bytes, from its independently encoded parts."""
        raw, cut = piece.encode(), self.cut
        at = [k + 1 for k, (a, b) in enumerate(zip(raw, raw[1:])) if cut[a << 8 | b]]
        if not at:
            return self._part(raw)  # the whole piece is one part, kept as a piece
        return b"".join([self.parts[raw[x:y]] for x, y in zip([0, *at], [*at, len(raw)])])

    def _plain(self, text: str) -> bytes:
        if text.isascii() or np.frombuffer(text.encode(), np.uint8).max() <= LATIN:
            words = self.latin
        else:
            words = self.strict if self.newer.search(text) else self.words
        return b"".join(map(self.pieces.__getitem__, words.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.prefix and text and not text.startswith(" "):
            text = " " + text
        if self.split is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(np.array([self.special[s]], "<u4").tobytes() if s in self.special else self._plain(s) for s in self.split.split(text) if s)

    def forget(self) -> None:
        """Empty the caches, so that a worker that is kept for later stages does not hold them."""
        self.parts.empty()
        self.pieces.empty()

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_OPEN: dict[str, ForcedBoundaryBpe] = {}


def encoder(spec: str) -> ForcedBoundaryBpe:
    """One encoder for each Python worker and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = ForcedBoundaryBpe(spec)
    return _OPEN[key]


def encode_documents(docs: DataFrame, vocabulary: str | None = None, text: str = "text", ids: str = "token_ids", decoded: str | None = None, digest: bool = False) -> DataFrame:
    """Every column of docs with `ids` (binary: little-endian uint32) and, if named, `decoded`.

    Null text: no ids and an empty decoded text.  Existing columns named like the new ones are
    replaced.  With digest=True the columns are n_tokens, ids_sha256 and decoded_sha256 instead:
    ids and texts stay on the executors.  The vocabulary file (of fixed size) is read once by the
    driver and broadcast; there is no shuffle, and a lost executor's rows are just encoded again.
    """
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} if digest else {ids: "binary"} | ({decoded: "string"} if decoded else {})
    keep = [c for c in docs.columns if c not in made and not (digest and c == text)]
    shared = text in keep  # the text crosses to Python once, also where it is a column of the result
    base = docs.select(*keep) if shared else docs.select(*keep, docs[text].alias("__text"))
    at = keep.index(text) if shared else len(keep)
    schema = docs.select(*keep).schema
    for c, kind in made.items():
        schema = schema.add(c, kind)
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value)
        for batch in slices(batches, ROWS):
            cols: list[list] = [[] for _ in made]
            for t in batch.column(at):
                coded = bpe.encode(t.as_py() or "")
                if digest:
                    row = (len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(bpe.decode(coded).encode()).hexdigest())
                else:
                    row = (coded, bpe.decode(coded)) if decoded else (coded,)
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(c, kinds[k]) for c, k in zip(cols, made.values()))], names=[*keep, *made])
        bpe.forget()
        release()

    return base.mapInArrow(run, schema)
