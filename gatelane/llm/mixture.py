"""Mixing sources to target weights by a min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern (the set
of their sources); patterns and sources form a small flow network, solved on the driver:

* a pattern offers its words once for free, a second time at cost one, a third time at cost
  two (convex, so repetition is used last and evenly);
* a pattern may serve each of its sources; a source takes up to its target.

What flows out of a pattern is turned into documents: whole passes over all of them, and for
the rest the first documents in a seeded order. The order is scanned in hash cells, so a source
holding a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import seeded_key
from ..operators.prefix import running_totals
from ..session import dimension
from .common import blank, numbered, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
PASSES = 3
# The flow network lives on the driver: more distinct source sets than this are refused, not cut.
MAX_PATTERNS = 200_000


def word_count(text: str | Column) -> Column:
    return F.regexp_count(blank(text), F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights: list[float], total: int, passes: int = PASSES) -> list[float]:
    """Shares of ``total`` by weight; none above ``passes`` times its size, the excess reshared by weight."""
    out, left, open_ = [0.0] * len(sizes), total, set(range(len(sizes)))
    while open_:
        level = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] * level > passes * sizes[i]]
        if not above:
            for i in open_:
                out[i] = weights[i] * level
            break
        for i in above:
            out[i] = float(passes * sizes[i])
            left -= passes * sizes[i]
            open_.discard(i)
    return out


def min_cost_flow(supply: list[int], serves: list[list[int]], demand: list[int], passes: int = PASSES) -> list[dict[int, int]]:
    """Words each pattern gives each source: largest possible flow at least cost.

    Only the arcs from the start cost something (pass ``e`` of a pattern costs ``e``), and a path leaves the
    start once. So shortest paths come in order of the pass they begin with: the flow is made as large as it gets
    with first passes, then with second ones, and so on, each time by blocking flows in layers. Integers
    only, so the result is exact and the same on every run.
    """
    n, m = len(supply), len(demand)
    start, end = n + m, n + m + 1
    to: list[int] = []  # an arc and its reverse are neighbours
    room: list[int] = []
    at: list[list[int]] = [[] for _ in range(n + m + 2)]

    def add(a, b, capacity):
        at[a].append(len(to))
        at[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((capacity, 0))

    for p in range(n):
        add(start, p, 0)
    for p, words in enumerate(supply):
        for s in serves[p]:
            add(p, n + s, passes * words)
    for s, words in enumerate(demand):
        add(n + s, end, words)

    def layers():
        level = [-1] * (n + m + 2)
        level[start], waiting = 0, deque([start])
        while waiting:
            a = waiting.popleft()
            for k in at[a]:
                if room[k] and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    waiting.append(to[k])
        return level

    def block(level):
        tried, path, a = [0] * (n + m + 2), [], start
        while True:
            if a == end:
                push = min(room[k] for k in path)
                for k in path:
                    room[k] -= push
                    room[k ^ 1] += push
                cut = next(i for i, k in enumerate(path) if not room[k])
                a = to[path[cut] ^ 1]
                del path[cut:]
            while tried[a] < len(at[a]):
                k = at[a][tried[a]]
                if room[k] and level[to[k]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(at[a]):
                path.append(k)
                a = to[k]
            elif a == start:
                return
            else:
                a = to[path.pop() ^ 1]
                tried[a] += 1

    for _ in range(passes):
        for p, words in enumerate(supply):
            room[2 * p] += words
        while (level := layers())[end] >= 0:
            block(level)
    flows: list[dict[int, int]] = [{} for _ in range(n)]
    for p in range(n):
        for k in at[p]:
            if k % 2 == 0 and room[k + 1]:
                flows[p][to[k] - n] = room[k + 1]
    return flows


@dataclass
class Mix:
    """``documents``: the rows with ``size``, ``pattern`` and ``taken``. ``patterns``: members to key. ``sources``: (source, size, target). ``flows``: (members, source, words)."""

    documents: DataFrame
    patterns: dict[tuple, str]
    sources: list[tuple[str | None, int, float]]
    flows: list[tuple[tuple, str | None, int]]


def mix(
    docs: DataFrame, ident: str, members: Column, size: Column, weights: tuple[float, ...] = WEIGHTS, passes: int = PASSES, seed: int = 5,
) -> Mix:
    """Choose how many words of each document the mix takes.

    ``members`` is an array of source names (null is a source of its own, the last in order;
    an empty array belongs nowhere and is taken zero times). Sources in code point order get
    ``weights`` cyclically. A document's ``taken`` is a whole multiple of its size, at most
    ``passes`` times. Documents of one pattern differ by one pass at most; which get the
    further pass is decided by a seeded hash of ``ident`` (equal and null identifiers tie and
    are ordered by size). A pattern's words are met to within half a document.
    """
    spark = docs.sparkSession
    rows = written(
        docs.select(F.col(ident).alias("doc_id"), F.array_sort(F.array_distinct(members)).alias("members"), size.alias("size"))
        .withColumn("pattern", F.to_json("members")),
        "mix-rows",
    )
    groups = rows.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(groups) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} distinct source sets; merge sources first")
    groups.sort(key=lambda g: g["pattern"])
    names = sorted({s for g in groups for s in g["members"]}, key=lambda s: (s is None, s or ""))
    place = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for g in groups:
        for s in g["members"]:
            sizes[place[s]] += g["words"]
    total = sum(g["words"] for g in groups)
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], total, passes)
    supply = [g["words"] for g in groups]
    flows = min_cost_flow(supply, [[place[s] for s in g["members"]] for g in groups], [int(t) for t in goals], passes)
    given = [sum(f.values()) for f in flows]
    plan = pa.table({
        "pattern": pa.array([g["pattern"] for g in groups], pa.string()),
        "whole": pa.array([f // w if w else 0 for f, w in zip(given, supply)], pa.int64()),
        "rest": pa.array([f % w if w else 0 for f, w in zip(given, supply)], pa.int64()),
    })
    keyed = rows.drop("members").withColumn("key", seeded_key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    ordered = running_totals(keyed, ["pattern"], ["key", "doc_id", "size"], F.col("size"), F.substring("key", 1, 3))
    further = (2 * F.col("running") - F.col("size") <= 2 * F.col("rest")) & (F.col("rest") > 0)
    taken = ordered.join(dimension(spark, plan), "pattern").withColumn(
        "taken", F.col("size") * (F.col("whole") + further.cast("long"))
    )
    return Mix(
        taken.select("doc_id", "pattern", "size", "taken"),
        {tuple(g["members"]): g["pattern"] for g in groups},
        [(s, sizes[i], goals[i]) for i, s in enumerate(names)],
        [(tuple(g["members"]), names[s], words) for g, f in zip(groups, flows) for s, words in sorted(f.items())],
    )


def mix_by_source(docs: DataFrame, ident: str = "doc_id", source: str = "source", size: Column | None = None, seed: int = 5) -> DataFrame:
    """Documents of one source each: ``doc_id, pattern, size, source_size, target, taken``.

    Size is the number of words of the whole text (null: none) unless given. A null source
    counts as a source. Repeated rows are decided one by one; other columns are not read.
    """
    done = mix(docs, ident, F.array(source), word_count("text") if size is None else size, seed=seed)
    facts = pa.table({
        "pattern": pa.array([done.patterns[(s,)] for s, _, _ in done.sources], pa.string()),
        "source_size": pa.array([n for _, n, _ in done.sources], pa.int64()),
        "target": pa.array([t for _, _, t in done.sources], pa.float64()),
    })
    joined = done.documents.join(dimension(docs.sparkSession, facts), "pattern")
    return joined.select("doc_id", "pattern", "size", "source_size", "target", "taken")


def take(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", seed: int = 5) -> DataFrame:
    """The mix itself: each row as many times as it is taken; columns stay as they are.

    Rows that agree in identifier, source and text are one document whose words are summed:
    all or none of them are taken, equally often. Texts without a word are never taken.
    """
    inner, (ident, source, text) = numbered(docs, ident, source, text)
    keyed = inner.withColumn("_unit", F.xxhash64(ident, source, text))
    units = keyed.select("_unit", source, word_count(text).alias("_words")).groupBy("_unit", source).agg(F.sum("_words").alias("_words"))
    done = mix_by_source(units, "_unit", source, F.col("_words"), seed)
    times = done.filter("taken > 0").select(
        F.col("doc_id").alias("_of"), F.get_json_object("pattern", "$[0]").alias("_source"), F.expr("int(taken div size)").alias("_times")
    )
    same = (F.col("_unit") == F.col("_of")) & F.col(source).eqNullSafe(F.col("_source"))
    copies = keyed.join(times, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return copies.select(*inner.columns).toDF(*docs.columns)
