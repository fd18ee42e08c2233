"""Removal of long repeated word sequences through a compacted de Bruijn graph of tokens.

Every ``WIDTH`` consecutive words of a document are an edge of the graph, from their first to their
last ``WIDTH`` - 1 words. Consecutive edges of a document that share their minimizer (the ``MINIMIZER``
words with the smallest hash, leftmost of equals) are kept together as one piece, a path of the graph with its source
coordinates; equal edges have the same minimizer at the same place, so they lie in pieces of one key. A text of
n words has about n / 14 pieces.

1. Pieces are counted by content. A piece that occurs twice or more repeats as a whole.
2. Compaction, by one join over the different repeated pieces: a piece continues another if it always follows it
   and nothing else ever follows that one. Documents are finite and each occurrence of a piece goes on
   the same way, so such chains have no cycles and start alike in every document: read in document order, they are the
   nonbranching paths, without pointer jumping.
3. Source coordinates verify: the words of every path occurrence are read again and hashed to 128 bits; spans equal in that
   digest are removed.
4. A piece that occurs once, but whose minimizer has other pieces, branches somewhere inside: its edges are read
   from their coordinates too and verified one by one, against one copy of each piece of that minimizer.

What repeats inside one document is merged there first, so a document has at most one row per different piece.
The hashes of steps 1 and 2 only choose what is read again; a word goes only if 128-bit digests of the words agree.
"""

from __future__ import annotations

from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank, discard, written
from .suffix_core import mix
from .words import Words

WIDTH = 35
MINIMIZER = 8
_PLACE = np.uint64((1 << 20) - 1)
_CHUNK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
NONE = 0  # in place of a neighbouring piece: there is none, or not always the same
PIECES = "d1 bigint, d2 bigint, key bigint, piece bigint, first int, last int, n int, before bigint, after bigint"


def _names(ident: str, text: str) -> tuple[Column, Column]:
    """Two hashes name a document; rows equal in identifier and text share a name, and an answer."""
    return F.xxhash64(F.lit(1), F.col(ident)), F.xxhash64(F.lit(2), blank(text), F.col(ident))


def sequence_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, base: np.uint64, longest: int) -> np.ndarray:
    """Hash of the words from ``begin`` to ``end`` (at most ``longest``) of each stretch."""
    out = mix((end - begin).astype(np.uint64) + base)
    for i in range(longest):
        going = begin + i < end
        if going.all():
            out = mix(out * base + hashes[begin + i])
        else:
            some = np.flatnonzero(going)
            if not len(some):
                break
            out[some] = mix(out[some] * base + hashes[begin[some] + i])
    return out


def minimizers(keys: np.ndarray, reach: int) -> np.ndarray:
    """For each place the leftmost place of the smallest of the ``reach`` keys from it on; ``reach`` - 1 fewer places."""
    out = []
    for base in range(0, len(keys) - reach + 1, _CHUNK):
        part = keys[base : base + _CHUNK + reach - 1]
        ranked = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        padded = np.full(-(-len(part) // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(part)] = ranked
        blocks = padded.reshape(-1, reach)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = len(part) - reach + 1
        least = np.minimum(behind[:count], ahead[reach - 1 : reach - 1 + count])
        out.append((least & _PLACE).astype(np.int64) + base)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def pieces_of(words: Words, width: int = WIDTH, size: int = MINIMIZER):
    """``text, key, piece, first, last`` of all pieces of a batch, in order; words counted from their text's first one."""
    starts = words.first_word()
    hashes = words.hashes()
    count = len(words) - width + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 5
    short = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        short = mix(short * _BASE + hashes[i : i + len(short)])
    anchor = minimizers(short, width - size + 1)
    text = words.text[:count]
    inside = words.text[:count] == words.text[width - 1 :]  # edges that cross into the next text are none
    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]])
    head = np.flatnonzero(fresh & inside)
    upto = np.concatenate([np.flatnonzero(fresh), [count]])
    last = upto[np.searchsorted(upto, head, "right")] - 1
    # The last edge of a text may be followed by edges that cross its end under the same minimizer.
    last = np.minimum(last, starts[text[head] + 1] - width)
    at = anchor[head]
    shift = mix((at - head).astype(np.uint64) * _OTHER + np.uint64(7))
    piece = sequence_hashes(hashes * _OTHER, head, last + width, _OTHER, 2 * width) ^ shift
    return text[head], short[at], piece, head - starts[text[head]], last - starts[text[head]]


def _joined(words: Words, text: int, starts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words of a text joined by one space, and the place where each begins (one more entry: where a next one would)."""
    low, high = starts[text], starts[text + 1]
    found = words.data[words.offsets[text] : words.offsets[text + 1]].tobytes().split()
    sizes = words.end[low:high] - words.begin[low:high]
    return b" ".join(found), np.concatenate([[0], np.cumsum(sizes + 1)])


def _rows(columns, kinds) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(columns, kinds)]


def _digest(body: bytes, place, first: int, end: int) -> bytes:
    return blake2b(body[place[first] : place[end] - 1], digest_size=16).digest()


def _inside(words: Words, order, heads, times, text, first, last, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches that repeat inside their own text, verified there and merged: the texts, and begin and end as two columns."""
    starts, found, body = words.first_word(), {}, None
    for k in np.flatnonzero(times > 1).tolist():
        places = order[heads[k] : heads[k] + times[k]]
        own = int(text[places[0]])
        if body is None or body[0] != own:
            body = own, *_joined(words, own, starts)
        spans = [(a, b + width) for a, b in zip(first[places].tolist(), last[places].tolist())]
        digests = [_digest(*body[1:], *span) for span in spans]
        often = {d for d, m in Counter(digests).items() if m > 1}
        found.setdefault(own, []).extend(s for s, d in zip(spans, digests) if d in often)
    of, out = [], []
    for own, spans in found.items():
        merged = merge(sorted(spans))
        of += [own] * len(merged)
        out += merged
    return np.array(of, np.int64), np.array(out, np.int64).reshape(-1, 2)


def merge(spans) -> list[list[int]]:
    """Sorted half-open ranges without overlap or touch."""
    out: list[list[int]] = []
    for begin, end in spans:
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def pieces(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``PIECES``: one row per document and different piece.

    ``n`` counts it in the document, ``first`` and ``last`` are its first edges there, ``before`` and ``after`` the pieces
    around it if these are the same at all its places in the document, else ``NONE``. Rows with a null key give the words, from
    ``first`` to before ``last``, that repeat inside the document.
    """

    def run(batches):
        for batch in batches:
            words = Words(batch.column(2))
            text, key, piece, first, last = pieces_of(words, width)
            signed = piece.view(np.int64)
            n = len(text)
            same_prev = np.zeros(n, bool)
            if n > 1:
                same_prev[1:] = (text[1:] == text[:-1])
            same_next = np.concatenate([same_prev[1:], [False]]) if n else same_prev
            before, after = np.where(same_prev, np.roll(signed, 1), NONE), np.where(same_next, np.roll(signed, -1), NONE)
            order = np.lexsort((np.arange(n), piece, key, text))
            fresh = np.ones(n, bool)
            if n > 1:
                a, b = order[1:], order[:-1]
                fresh[1:] = (text[a] != text[b]) | (key[a] != key[b]) | (piece[a] != piece[b])
            heads = np.flatnonzero(fresh)
            times = np.diff(np.concatenate([heads, [n]]))
            one = order[heads]
            for side in (before, after):
                if n:
                    low, high = (f.reduceat(side[order], heads) for f in (np.minimum, np.maximum))
                    side[one] = np.where(low == high, low, NONE)
            inner_of, inner = _inside(words, order, heads, times, text, first, last, width)
            none = pa.nulls(len(inner), pa.int64())
            take = pa.array(np.concatenate([text[one], inner_of]))
            longs = lambda c: pa.concat_arrays([pa.array(c[one], pa.int64()), none])
            ints = lambda c, i: pa.array(np.concatenate([c, inner[:, i]]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take), batch.column(1).take(take), longs(key.view(np.int64)), longs(signed), ints(first[one], 0), ints(last[one], 1),
                    ints(times, 1), longs(before), longs(after),
                ],
                [f.split()[0] for f in PIECES.split(", ")],
            )

    return docs.select("d1", "d2", "body").mapInArrow(run, PIECES)


def evidence(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """``digest, d1, d2, begin, end``: digests of what is read again from its source coordinates.

    ``rows(d1, d2, body, parts)``; a part with ``whole`` is a span of words, others are a range of edges.
    """

    def run(batches):
        for batch in batches:
            words = Words(batch.column(2))
            starts = words.first_word()
            lists = batch.column(3)
            flat, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            firsts, lasts, wholes = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last", "whole"))
            of, digests, begins, ends = [], [], [], []
            for i in range(len(lists)):
                body, place = _joined(words, i, starts)
                place, seen = place.tolist(), set()
                for first, last, whole in zip(firsts[at[i] : at[i + 1]].tolist(), lasts[at[i] : at[i + 1]].tolist(), wholes[at[i] : at[i + 1]].tolist()):
                    spans = [(first, last + width)] if whole else [(j, j + width) for j in range(first, last + 1)]
                    for a, b in spans:
                        if (a, b) not in seen:  # a place is evidence once
                            seen.add((a, b))
                            digests.append(_digest(body, place, a, b))
                            begins.append(a)
                            ends.append(b)
                of += [i] * len(seen)
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), batch.column(0).take(take), batch.column(1).take(take), *_rows((begins, ends), (pa.int32(), pa.int32()))],
                ["digest", "d1", "d2", "begin", "end"],
            )

    return rows.select("d1", "d2", "body", "parts").mapInArrow(run, "digest binary, d1 bigint, d2 bigint, begin int, end int")


def classes(found: DataFrame) -> DataFrame:
    """The different pieces: how often they occur, one place, and for repeated ones the pieces around them if these are always the same."""
    always = lambda c: F.when((F.sum("n") > 1) & (F.min(c) == F.max(c)) & (F.min(c) != NONE), F.min(c))
    # The columns of the place come from one row, whichever is first; any place will do.
    return found.filter("key IS NOT NULL").groupBy("key", "piece").agg(
        F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("d1", "d2", "first", "last")], always("before").alias("before"), always("after").alias("after")
    )


def compacted(kinds: DataFrame) -> DataFrame:
    """``key, piece, goes_on`` of the repeated pieces; ``goes_on``: it only ever prolongs the piece before it."""
    often = kinds.filter("n > 1")
    earlier = often.filter("after IS NOT NULL").select(F.col("piece").alias("before"), F.col("after").alias("piece")).distinct()
    return often.select("key", "piece", "before").join(earlier.withColumn("goes_on", F.lit(True)), ["piece", "before"], "left").select(
        "key", "piece", F.coalesce("goes_on", F.lit(False)).alias("goes_on")
    )


def paths(found: DataFrame, kinds: DataFrame) -> DataFrame:
    """``d1, d2, first, last``: the edges of every occurrence of a compacted path, read along its document.

    A path begins at a piece that does not go on, or after a gap.
    """
    placed = found.filter("key IS NOT NULL").select("d1", "d2", "key", "piece", "first", "last").join(compacted(kinds), ["key", "piece"])
    # At most the different pieces of one document; rows equal in identifier and text fall together.
    listed = placed.groupBy("d1", "d2").agg(F.array_sort(F.collect_set(F.struct("first", "last", "goes_on"))).alias("l"))

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            first, last, on = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("first", "last", "goes_on"))
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            fresh = np.ones(len(of), bool)
            if len(of):
                fresh[1:] = ~on[1:].astype(bool) | (of[1:] != of[:-1]) | (first[1:] != last[:-1] + 1)
            heads = np.flatnonzero(fresh)
            tails = np.concatenate([heads[1:], [len(of)]]) - 1
            take = pa.array(of[heads])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(first[heads]), pa.array(last[tails])], ["d1", "d2", "first", "last"]
            )

    return listed.mapInArrow(run, "d1 bigint, d2 bigint, first int, last int")


def repeated_spans(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``d1, d2, begin, end``: word ranges of each document made of ``width``-word sequences that also start elsewhere, as a written table."""
    one, two = _names(ident, text)
    keyed = docs.select(one.alias("d1"), two.alias("d2"), blank(text).cast("binary").alias("body"))
    found = written(pieces(keyed, width), "pieces")
    kinds = written(classes(found), "piece-kinds")
    whole = paths(found, kinds).withColumn("whole", F.lit(True))
    # One place of every piece of a minimizer that has several, to compare edge by edge.
    several = kinds.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    branching = kinds.join(several, "key").select("d1", "d2", "first", "last", F.lit(False).alias("whole"))
    per_doc = written(
        whole.unionByName(branching).groupBy("d1", "d2").agg(F.collect_set(F.struct("first", "last", "whole")).alias("parts")), "read-again"
    )
    here = written(found.filter("key IS NULL").select("d1", "d2", F.col("first").alias("begin"), F.col("last").alias("end")), "inside-texts")
    discard(found, kinds)
    proof = written(evidence(keyed.join(per_doc, ["d1", "d2"]), width), "evidence")
    twice = proof.groupBy("digest").agg(F.count("*").alias("m")).filter("m > 1").select("digest")
    out = written(proof.join(twice, "digest").select("d1", "d2", "begin", "end").unionByName(here).distinct(), "repeated-words")
    discard(here, per_doc, proof)
    return out


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row ``doc_id, n_words, spans`` (removed ranges of words) and ``kept`` (the other words, joined by one space).

    Every word covered by ``width`` consecutive words of one document that also start anywhere else goes, the same document and
    first occurrences included; sequences never cross documents. Null and empty texts have no words, texts under
    ``width`` words stay. Rows equal in identifier and text are documents of their own, hence copies of each
    other. An empty table gives no rows. Other columns are not read.
    """
    kind = docs.schema[ident].dataType.simpleString()
    kinds = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    found = repeated_spans(docs, ident, text, width)
    per_doc = written(found.groupBy("d1", "d2").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("parts")), "word-spans")
    discard(found)
    one, two = _names(ident, text)
    rows = docs.select(one.alias("d1"), two.alias("d2"), F.col(ident).alias("ident"), blank(text).cast("binary").alias("body"))
    rows = rows.join(per_doc, ["d1", "d2"], "left").select("ident", "body", "parts")

    def cut(batches):
        for batch in batches:
            sizes, spans, kept = [], [], []
            for body, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words, merged = body.split(), merge((p["begin"], p["end"]) for p in parts or ())
                edges = [0, *(e for span in merged for e in span), len(words)]
                sizes.append(len(words))
                spans.append([{"begin": a, "end": b} for a, b in merged])
                kept.append(b" ".join(w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kinds), pa.array(kept, pa.binary())],
                ["doc_id", "n_words", "spans", "kept"],
            )

    return rows.mapInArrow(cut, f"doc_id {kind}, n_words bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary")
