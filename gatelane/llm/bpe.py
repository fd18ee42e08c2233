"""Byte-level BPE by forced-boundary splitting.

No merge can cross two neighbouring bytes that stand side by side in no token of the
vocabulary, so every such pair is a certain cut: the pieces on both sides are encoded
independently and their ids concatenated. The table of such pairs is computed from the
vocabulary, and used twice.

* In the text, where the cut is one for the pre-tokenizer too: between a letter and a space,
  a line end or a mark; between a mark and a space or a line end; around a single line end
  before a letter. A cut never parts a run of white space nor a contraction. Letters and
  marks for which the table has no certain cut there are left out when the pattern is built.
  The fragments between cuts are looked up in a table of bounded size, or encoded.
* In a fragment: the library's own pre-tokenizer gives its pieces in byte characters (a word
  of letters is one piece); each piece is cut at all forced pairs, and what is left goes
  through the library's merges.

Decoding joins the tokens' bytes and reads them as UTF-8, putting U+FFFD for broken sequences.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 200_000  # fragments in each of the two generations a worker remembers
CACHED_LENGTH = 48  # longer fragments are encoded each time
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
MARKS = ".,;:!?"
ENDS = " \n" + "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class ForcedBoundaryCodec:
    """Encodes and decodes as the library does for the same vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        tokenizer = Tokenizer.from_file(path)
        self.model, self.pre = tokenizer.model, tokenizer.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        known = [(t, i) for t, i in spec["model"]["vocab"].items() if t not in self.special]
        pairs = {t[i : i + 2] for t, _ in known for i in range(len(t) - 1)}
        characters = byte_characters()
        back = {c: b for b, c in enumerate(characters)}
        joined = np.zeros((256, 256), bool)
        for one, two in pairs:
            joined[back[one], back[two]] = True
        self.joined, self.pairs = joined, {tuple(p) for p in pairs}
        self.mapped = {b: c for b, c in enumerate(characters)}
        last = lambda c: c.encode()[-1]
        free = lambda c, ends: not any(joined[last(c), ord(e)] for e in ends)
        letters = "".join(chr(c) for c in (*range(0x41, 0x7B), *range(0xC0, 0x250)) if chr(c).isalpha() and free(chr(c), ENDS))
        marks = "".join(m for m in MARKS if free(m, " \n"))
        starts = "".join(c for c in letters if not joined[0x0A, c.encode()[0]])
        some = lambda cs: f"[{re.escape(cs)}]" if cs else r"[^\s\S]"
        self.cut = re.compile(
            rf" ?{some(letters)}+(?={some(ENDS)}|\Z)"
            rf"|{some(marks)}(?=[ \n])"
            rf"|(?<={some(letters + marks)})\n(?={some(starts)})"
            rf"|.+?(?=(?<={some(letters + marks)})[ \n]|\Z)",
            re.DOTALL,
        )
        self.word = re.compile(rf" ?{some(letters)}+\Z")
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.bytes_of = [b""] * (max([i for _, i in known] + list(self.special.values())) + 1)
        for token, i in known:
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.fresh: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, piece: str) -> list[str]:
        """Cut at every forced pair. ``piece`` is in byte characters."""
        if self.pairs.issuperset(zip(piece, piece[1:])):
            return [piece]
        cuts = [0, *[i for i in range(1, len(piece)) if (piece[i - 1], piece[i]) not in self.pairs], len(piece)]
        return [piece[a:b] for a, b in zip(cuts, cuts[1:])]

    def fragment(self, text: str) -> bytes:
        if self.word.match(text):
            whole = [text.encode().decode("latin-1").translate(self.mapped)]
        else:
            whole = [piece for piece, _ in self.pre.pre_tokenize_str(text)]
        ids = [token.id for piece in whole for part in self.pieces(piece) for token in self.model.tokenize(part)]
        return array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes()

    def _missing(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self.fragment(part)
        if len(part) <= CACHED_LENGTH:
            if len(self.fresh) >= CACHE:
                self.fresh, self.older = {}, self.fresh
            self.fresh[part] = ids
        return ids

    def _plain(self, text: str) -> list[bytes]:
        return [self.fresh.get(part) or self._missing(part) for part in self.cut.findall(text)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.split_special is None or not any(s in text for s in self.special):
            return b"".join(self._plain(text))
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out.extend(self._plain(part))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryCodec:
    """One per worker process."""
    return ForcedBoundaryCodec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, ident: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids`` per row; ``ids`` packs little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. Strings of special tokens in a text become
    those tokens, as in the library. Without ``path`` each worker asks the installed
    package for its file. Other columns are not read; repeated rows stay.
    """
    kind = docs.schema[ident].dataType.simpleString()

    def run(batches):
        own = codec(path or default_path())
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(ident).alias("doc_id"), text).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded`` to the rows of ``encode``; null ids decode to an empty text."""
    names = encoded.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema] + ["decoded string"])

    def run(batches):
        own = codec(path or default_path())
        for batch in batches:
            packed = batch.column(names.index("ids")).to_pylist()
            texts = pa.array([own.decode(np.frombuffer(i or b"", "<u4")) for i in packed], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()
