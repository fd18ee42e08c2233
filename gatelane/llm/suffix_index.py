"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

A text's suffixes are taken at its anchors (``suffix_core``): places chosen by content, so that
any two equal strings of ``span`` bytes have an anchor at the same place. A suffix begins
``context_of(span)`` bytes before its anchor. A batch of documents becomes one suffix array, cut into
key ranges: its suffixes in the order of their first ``HEAD`` bytes (those that agree in them in the order
of a hash of the ``2 * context_of(span)`` bytes around the anchor), each with the length of the prefix
that it shares with the one before it. A new batch is merge-scanned with every existing level:
batch and levels run past each other in one order, and neighbours that agree in all those bytes are
candidates for a long match. Where the batch meets a level of its own size, the same
scan writes their union as the next level, so a family over n batches has at most log2(n) + 1 levels
and rewrites a suffix log2(n) times. Levels can be saved, opened again and added to.

Candidates are then settled exactly, by hash equality and counting only, so that a passage
in a third of all documents costs no more than any other:

1. The windows that share an anchor form a run. A run whose whole bytes occur twice repeats.
2. The other runs of a key that holds several runs are cut into bands of ``BAND`` windows. A band
   whose common bytes occur once has no match; of the rest the few bytes on both sides are at hand,
3. and its windows are counted one by one.

All keys compared at the end have 128 bits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import suffix_core as core
from .common import discard, numbered, written

SPAN = core.SPAN
BAND = 16
BATCHES = 4
HEAD = 32  # bytes of a suffix that its order follows


def _names(ident: str, text: str) -> tuple[Column, Column]:
    """Two hashes name a document; rows equal in identifier and text share a name, and an answer."""
    return F.xxhash64(F.lit(1), F.col(ident)), F.xxhash64(F.lit(2), F.coalesce(F.col(text), F.lit("")), F.col(ident))


def _keyed(docs: DataFrame, ident: str, text: str) -> DataFrame:
    one, two = _names(ident, text)
    return docs.select(one.alias("d1"), two.alias("d2"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"))


def anchors(keyed: DataFrame, span: int = SPAN) -> DataFrame:
    """``d1, d2, head, key, run, place, stop``: one row per run of windows with a common anchor.

    ``head`` holds the first bytes of the suffix, ``key`` hashes the bytes around the anchor, ``run`` all bytes of the
    run's windows; ``place`` packs the first window, the anchor's and the last window's distance from it. A stretch
    known to repeat inside its document has null head and hashes, its begin as ``place`` and its end as ``stop``
    (null for the others).
    """
    context = core.context_of(span)
    width = min(HEAD, 2 * context)

    def run(batches):
        for batch in batches:
            rows, heads, known_of, known = [], [], [], []
            for i, body in enumerate(batch.column(2)):
                text = np.frombuffer(body.as_buffer(), np.uint8)
                at, first, last, repeats = core.runs(text, span)
                known_of += [i] * len(repeats)
                known += repeats
                if len(at):
                    hashes = core.Hashes(text)
                    key = hashes.of(at - context, at + context)
                    whole = hashes.of(first, last + span) ^ core.mix((at - first).astype(np.uint64))
                    rows.append((np.full(len(at), i), key, whole, first << 20 | (at - first) << 10 | (last - first)))
                    heads.append(np.lib.stride_tricks.sliding_window_view(text, width)[at - context])
            of, key, whole, place = (np.concatenate(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
            take = pa.array(np.concatenate([of, np.array(known_of, np.int64)]))
            empty = pa.nulls(len(known), pa.int64())
            hashed = [pa.concat_arrays([pa.array(c.astype(np.uint64).view(np.int64)), empty]) for c in (key, whole)]
            head = _binary(np.concatenate(heads) if heads else np.zeros((0, width), np.uint8))
            begin, end = np.array(known, np.int64).reshape(-1, 2).T
            places = pa.array(np.concatenate([place, begin]))
            stops = pa.concat_arrays([pa.nulls(len(place), pa.int64()), pa.array(end)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.concat_arrays([head, pa.nulls(len(known), pa.binary())]), *hashed, places, stops],
                ["d1", "d2", "head", "key", "run", "place", "stop"],
            )

    schema = "d1 bigint, d2 bigint, head binary, key bigint, run bigint, place bigint, stop bigint"
    return keyed.select("d1", "d2", "body").mapInArrow(run, schema)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value per row of bytes."""
    offsets = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _byte_rows(column: pa.Array) -> np.ndarray:
    """Rows of bytes of a binary column whose values have one length."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data.reshape(len(column), int(offsets[1] - offsets[0]))


def _merge_scan(batches):
    """One range of ``head, key, n`` in that order, from all arrays that meet: one row per suffix with its shared prefix.

    ``n`` is 0 in arrays that are only looked at; their own suffixes do not come out. A suffix
    that also stands in one of them counts as seen twice at least.
    """
    kept = None  # the last suffix, which the next batch may go on with
    above = None  # head of the last suffix that came out

    def out(heads, keys, seen, only):
        nonlocal above
        own = seen > 0
        heads, keys, seen = heads[own], keys[own], np.where(only & (seen > 0), np.maximum(seen, 2), seen)[own]
        if not len(heads):
            return None
        before = np.concatenate([heads[:1] if above is None else above, heads[:-1]])
        differ = np.concatenate([heads != before, np.ones((len(heads), 1), bool)], axis=1)
        shared = pa.array(differ.argmax(1).astype(np.int32), mask=np.arange(len(heads)) < (above is None))
        above = heads[-1:]
        return pa.RecordBatch.from_arrays([_binary(heads), pa.array(keys), pa.array(seen), shared], ["head", "key", "n", "lcp"])

    for batch in batches:
        if not batch.num_rows:
            continue
        heads, keys, n = _byte_rows(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        only = n == 0
        if kept:
            heads, keys, n, only = (np.concatenate(c) for c in zip(kept, (heads, keys, n, only)))
        starts = np.flatnonzero(np.concatenate([[True], (heads[1:] != heads[:-1]).any(1) | (keys[1:] != keys[:-1])]))
        found = heads[starts], keys[starts], np.add.reduceat(n, starts), np.logical_or.reduceat(only, starts)
        kept = tuple(c[-1:] for c in found)
        ready = out(*(c[:-1] for c in found))
        if ready:
            yield ready
    if kept and (ready := out(*kept)):
        yield ready


class Family:
    """Suffix arrays of geometrically growing sizes; ``add`` merge-scans a batch with all of them.

    A level has ``head, key, n, lcp``: suffixes in order inside each of its files, how often each
    was seen (two at least where it also stands in an older level), and the bytes of its head that the one
    before it has too (null for the first of a file).
    """

    def __init__(self, levels: dict[int, DataFrame] | None = None):
        self.levels = dict(levels or {})
        self._own: list[DataFrame] = []

    def add(self, suffixes: DataFrame) -> None:
        """``suffixes`` has ``key`` and, where order and shared prefixes matter, ``head``; other columns are not read."""
        head = F.col("head") if "head" in suffixes.columns else F.lit(b"")
        # Counted before they meet in one order: a suffix in a third of all documents is one row there.
        rows = suffixes.select(head.alias("head"), "key").groupBy("head", "key").agg(F.count("*").alias("n"))
        size = 0
        while size in self.levels:
            size += 1
        for at, level in self.levels.items():
            rows = rows.unionByName(level.select("head", "key", F.col("n") if at < size else F.lit(0).cast("long").alias("n")))
        ordered = rows.repartitionByRange("head", "key").sortWithinPartitions("head", "key")
        merged = written(ordered.mapInArrow(_merge_scan, "head binary, key bigint, n bigint, lcp int"), f"level-{size}")
        spent = [self.levels.pop(at) for at in range(size)]
        discard(*(level for level in spent if any(level is own for own in self._own)))
        self._own = [own for own in self._own if all(own is not level for level in spent)] + [merged]
        self.levels[size] = merged

    def add_documents(self, docs: DataFrame, ident: str = "doc_id", text: str = "text", span: int = SPAN) -> None:
        """A batch of documents; all batches of a family need one ``span``."""
        suffixes = anchors(_keyed(docs, ident, text).filter(F.octet_length("body") >= span), span)
        self.add(suffixes.filter("key IS NOT NULL"))

    def repeated(self) -> DataFrame:
        """Keys of the suffixes seen twice or more in what was added so far, read off the levels."""
        found = [level.filter("n > 1").select("key") for level in self.levels.values()]
        keys = found[0]
        for more in found[1:]:
            keys = keys.unionByName(more)
        return keys.distinct()

    def save(self, folder: str) -> None:
        """Write the levels below ``folder``, one folder each; a folder that has levels already is refused."""
        for size, level in self.levels.items():
            level.write.parquet(f"{folder}/level-{size}")

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Family:
        """A saved family. Its files stay as they are when more is added; save the result to another folder."""
        home = spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = [f.getPath().getName() for f in home.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(home)]
        sizes = sorted(int(name[6:]) for name in found if re.fullmatch(r"level-\d+", name))
        return cls({size: spark.read.parquet(f"{folder}/level-{size}") for size in sizes})

    def close(self) -> None:
        """Delete the levels that were written here and not saved."""
        discard(*self._own)
        self._own = []


def _bands(rows: DataFrame, span: int) -> DataFrame:
    """Runs with their documents' bytes to bands.

    ``rows(d1, d2, body, runs)`` where ``runs`` lists ``(place, known)``. Out come
    ``band, d1, d2, base, low, high, known, before, after``: window ``j`` of the band, from ``low``
    to ``high``, starts at ``base - j``.
    """

    def run(batches):
        for batch in batches:
            out_of, parts, before, after = [], [], [], []
            lists = batch.column(3)
            flat, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            places = flat.field("place").to_numpy(zero_copy_only=False)
            knowns = flat.field("known").to_numpy(zero_copy_only=False)
            for i, body in enumerate(batch.column(2)):
                data = body.as_buffer().to_pybytes()
                text = np.frombuffer(data, np.uint8)
                hashes = core.Hashes(text)
                place, known = places[at[i] : at[i + 1]], knowns[at[i] : at[i + 1]]
                first = place >> 20
                anchor = first + (place >> 10 & 1023)
                last = first + (place & 1023)
                low, high = (anchor - last) // BAND, (anchor - first) // BAND  # bands by distance to the anchor
                counts = high - low + 1
                own = np.repeat(np.arange(len(place)), counts)
                band = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + low[own]
                base = anchor[own] - band * BAND
                common = hashes.of(base, base + span - BAND + 1) ^ core.mix((band + 1).astype(np.uint64))
                least = np.maximum(base - last[own], 0)
                most = np.minimum(base - first[own], BAND - 1)
                out_of.append(np.full(len(own), i))
                parts.append((common.view(np.int64), base, least, most, known[own]))
                for b in base.tolist():
                    before.append(data[max(b - BAND + 1, 0) : b])
                    after.append(data[b + span - BAND + 1 : b + span])
            take = pa.array(np.concatenate(out_of) if out_of else np.zeros(0, np.int64))
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
            common, base, least, most, known = (pa.array(c).cast(t) for c, t in zip(columns, types))
            yield pa.RecordBatch.from_arrays(
                [common, batch.column(0).take(take), batch.column(1).take(take), base, least, most, known,
                 pa.array(before, pa.binary()), pa.array(after, pa.binary())],
                ["band", "d1", "d2", "base", "low", "high", "known", "before", "after"],
            )

    schema = "band bigint, d1 bigint, d2 bigint, base int, low int, high int, known boolean, before binary, after binary"
    return rows.select("d1", "d2", "body", "runs").mapInArrow(run, schema)


def repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", batches: int = BATCHES, span: int = SPAN) -> DataFrame:
    """``d1, d2, begin, end``: stretches of each document made of ``span``-byte strings that also start elsewhere, as a written table.

    Stretches may overlap. Intermediate tables are deleted once what reads them is written.
    """
    keyed = _keyed(docs, ident, text)
    suffixes = written(anchors(keyed.filter(F.octet_length("body") >= span), span), "suffixes")
    indexed = suffixes.filter("key IS NOT NULL")
    family = Family()
    for i in range(batches):
        family.add(indexed.filter(F.pmod("d1", F.lit(batches)) == i))
    candidates = written(indexed.drop("head", "stop").join(family.repeated(), "key"), "candidates")
    inside = written(suffixes.filter("key IS NULL").select("d1", "d2", F.col("place").alias("begin"), F.col("stop").alias("end")), "inside")
    family.close()
    discard(suffixes)
    # 1. Runs that occur twice as a whole.
    classes = written(candidates.groupBy("key", "run").agg(F.count("*").alias("n"), F.min(F.struct("d1", "d2", "place")).alias("one")), "runs")
    often = classes.filter("n > 1").select("key", "run")
    first = F.shiftright("place", 20)
    whole = candidates.join(often, ["key", "run"]).select(
        "d1", "d2", first.alias("begin"), (first + F.col("place").bitwiseAND(1023) + span).alias("end")
    )
    # 2. Bands of the other runs, and of one copy of each run they may match.
    several = written(classes.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"), "several")
    open_runs = classes.join(several, "key").select("one.d1", "one.d2", F.struct(F.col("one.place").alias("place"), (F.col("n") > 1).alias("known")).alias("r"))
    per_doc = open_runs.groupBy("d1", "d2").agg(F.collect_list("r").alias("runs"))  # at most the runs of one document
    bands = written(_bands(keyed.join(per_doc, ["d1", "d2"]), span), "bands")
    shared = written(bands.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1").select("band"), "shared")
    # 3. Windows of the bands that are left.
    near = bands.join(shared, "band")
    windows = written(
        near.select("band", "d1", "d2", "base", "known", "before", "after", F.explode(F.sequence("low", "high")).alias("j")).select(
            "band", "d1", "d2", "known", (F.col("base") - F.col("j")).cast("long").alias("begin"),
            F.xxhash64(
                "j", F.expr("substring(before, length(before) - j + 1, j)"), F.expr(f"substring(after, 1, {BAND - 1} - j)")
            ).alias("edge"),
        ),
        "windows",
    )
    discard(bands, shared, several)
    twice = written(windows.groupBy("band", "edge").agg(F.count("*").alias("m")).filter("m > 1").select("band", "edge"), "twice")
    single = windows.filter("NOT known").join(twice, ["band", "edge"]).select("d1", "d2", "begin", (F.col("begin") + span).alias("end"))
    found = written(whole.unionByName(single).unionByName(inside).distinct(), "found")
    discard(candidates, classes, windows, twice, inside)
    return found


def _with_parts(docs: DataFrame, ident: str, text: str, batches: int, span: int) -> DataFrame:
    """``docs`` with ``_parts``, the sorted list of repeated stretches of each (null: none)."""
    found = repeats(docs, ident, text, batches, span)
    # At most the stretches of one document in a list; a table of its own, so that the join can split hot keys.
    per_doc = written(
        found.groupBy("d1", "d2").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("_parts")), "parts"
    ).withColumnsRenamed({"d1": "_d1", "d2": "_d2"})
    discard(found)
    one, two = _names(ident, text)
    return docs.withColumns({"_one": one, "_two": two}).join(
        per_doc, (F.col("_one") == F.col("_d1")) & (F.col("_two") == F.col("_d2")), "left"
    ).drop("_one", "_two", "_d1", "_d2")


def _merged(parts: list[dict] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for part in parts or ():
        if out and part["begin"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], part["end"])
        else:
            out.append([part["begin"], part["end"]])
    return out


def _rest(body: bytes, spans: list[list[int]]) -> bytes:
    edges = [0, *(e for span in spans for e in span), len(body)]
    return b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", batches: int = BATCHES, span: int = SPAN) -> DataFrame:
    """Per row the identifier, ``n_bytes``, ``spans`` (removed runs as begin and end) and ``kept`` (remaining bytes).

    Every byte covered by a string of ``span`` bytes that also starts anywhere else goes, first
    occurrences too; matches never cross documents. A null text is empty. Texts under
    ``span`` bytes stay as they are. Rows equal in identifier and text are documents of
    their own, hence copies of each other. Other columns are not read.
    """
    kind = docs.schema[ident].dataType.simpleString()
    kinds = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def cut(batches):
        for batch in batches:
            sizes, spans, kept = [], [], []
            for body, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                merged = _merged(parts)
                sizes.append(len(body))
                spans.append([{"begin": b, "end": e} for b, e in merged])
                kept.append(_rest(body, merged))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kinds), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    rows = _with_parts(docs.select(ident, text), ident, text, batches, span)
    return rows.select(F.col(ident).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body"), "_parts").mapInArrow(
        cut, f"doc_id {kind}, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary"
    )


def cut_texts(docs: DataFrame, ident: str = "doc_id", text: str = "text", length: str = "n_chars", batches: int = BATCHES, span: int = SPAN) -> DataFrame:
    """``docs`` with the bytes of repeated ``span``-byte strings cut out of the texts, and ``length`` (if there is such a column) counted anew.

    A character of which only some bytes were cut goes whole. Texts without repeats,
    null ones included, stay as they are.
    """
    inner, (own_ident, own_text) = numbered(docs, ident, text)
    names, schema = inner.columns, inner.schema
    at, number = names.index(own_text), docs.columns.index(length) if length in docs.columns else None

    def cut(batches):
        for batch in batches:
            columns = list(batch.columns[: len(names)])
            bodies, counts = columns[at].to_pylist(), columns[number].to_pylist() if number is not None else None
            for i, parts in enumerate(batch.column(len(names)).to_pylist()):
                if parts:
                    bodies[i] = _rest(bodies[i].encode(), _merged(parts)).decode("utf-8", "ignore")
                    if counts is not None:
                        counts[i] = len(bodies[i])
            columns[at] = pa.array(bodies, columns[at].type)
            if counts is not None:
                columns[number] = pa.array(counts, columns[number].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return _with_parts(inner, own_ident, own_text, batches, span).select(*names, "_parts").mapInArrow(cut, schema).toDF(*docs.columns)
