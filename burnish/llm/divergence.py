"""Source divergence audit through a frequent-pattern tree of term rows.

A term's row lists the sources of a language that hold it, in their order, each with its share. The value of a
pair of sources is a sum over all terms: the value of two absent terms times the number of terms, what each
source's own shares change against an absent partner, and a correction where both hold the term. The corrections
come from the tree: rows that begin alike share its path, a node counts the terms that pass through it, and each
pair of a node and an ancestor is corrected once, times that count. Rows are sorted over all tasks, so that each
task walks its part of the tree with the path in hand. All numbers are whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from burnish.llm.common import lean, sized
from burnish.sources.shared import written

LEAST_DOCUMENTS = 10
MOST_RANK = 10
UNIT = 1_000_000_000  # shares are whole numbers of this part
ENTRIES = 300_000  # counts a task holds before it hands them on
CHUNK = 1 << 22  # bytes of a text that are cut into terms at a time
LANE = 1024  # sources of a language that one task pairs with all others

# Letters a-z and all bytes of other characters stay, A-Z become a-z, the rest parts terms.
_TERM_BYTES = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_lists(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order: runs of ASCII letters and of characters beyond ASCII, A-Z in lower case."""
    data = text.encode().translate(_TERM_BYTES)
    while len(data) > CHUNK:
        cut = data.rfind(b" ", 0, CHUNK)
        cut = cut if cut >= 0 else data.find(b" ")
        if cut < 0:
            break
        yield data[:cut].split()
        data = data[cut:]
    yield data.split()


COUNTED = "lang string, source string, term string, n long, docs long"
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
    keys = [(*key, len(found)) for key, (found, _) in groups.items()]
    terms = [t for found, _ in groups.values() for t in found]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([lang for lang, _, many in keys for _ in range(many)], pa.string()),
            pa.array([source for _, source, many in keys for _ in range(many)], pa.string()),
            pa.array(terms, pa.binary()).cast(pa.string()),
            pa.array([n for found, _ in groups.values() for n in found.values()], pa.int64()),
            pa.array([held[t] for found, held in groups.values() for t in found], pa.int64()),
        ],
        schema=_COUNTED,
    )


@lean
def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0
    for batch in batches:
        for lang, source, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            found, held = groups.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(found), set()
            for terms in term_lists(text):
                found.update(terms)
                own.update(terms)
            held.update(own)
            entries += len(found) - before
            if entries > ENTRIES:
                yield _counted(groups)
                groups, entries = {}, 0
    if groups:
        yield _counted(groups)


def _share(n: Column, size: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / size), in decimals that hold any count."""
    return (1 + F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), size.cast("decimal(20,0)"))).cast("long")


def value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _value(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


PATH = "array<struct<place:int,p:long,z:long>>"
CORRECTED = "lang string, a int, b int, value long"


def corrections(rows: list[tuple[list[int], list[int], list[int]]], times: np.ndarray) -> dict[tuple[int, int], int]:
    """Corrections by pair of places, from rows (places, shares, shares of an absent term) sorted as in the tree.

    A node starts where a row leaves the path of the row before it; it counts all rows until one leaves it.
    """
    depths = np.array([len(r[0]) for r in rows], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(depths)))
    place, p, z = (np.fromiter((x for r in rows for x in r[k]), dtype=np.int64, count=starts[-1]) for k in range(3))
    depth = np.arange(starts[-1]) - np.repeat(starts[:-1], depths)
    # how many places of its path each row has in common with the row before
    common = np.zeros(len(rows), dtype=np.int64)
    for i in range(1, len(rows)):
        (a, b, _), (c, d, _) = rows[i - 1], rows[i]
        n = 0
        for own in zip(a, b, c, d, strict=False):
            if own[0] != own[2] or own[1] != own[3]:
                break
            n += 1
        common[i] = n
    # the terms of each new node: all rows up to the next one that has less in common than the node's depth
    new = depth >= np.repeat(common, depths)
    sums = np.concatenate(([0], np.cumsum(times)))
    count = np.zeros(starts[-1], dtype=np.int64)
    path: list[tuple[int, int]] = []  # (flat position, row) of the open nodes
    for i in range(len(rows)):
        while len(path) > common[i]:
            at, row = path.pop()
            count[at] = sums[i] - sums[row]
        path += [(int(starts[i]) + d, i) for d in range(len(path), int(depths[i]))]
    for at, row in path:
        count[at] = sums[-1] - sums[row]
    found: dict[tuple[int, int], int] = {}
    nodes = np.flatnonzero(new)
    for up in range(1, int(depths.max(initial=0))):
        nodes = nodes[depth[nodes] >= up]
        if not len(nodes):
            break
        over = nodes - up
        both = _value(p[over], p[nodes]) - _value(p[over], z[nodes]) - _value(z[over], p[nodes]) + _value(z[over], z[nodes])
        both *= count[nodes]
        order = np.lexsort((place[nodes], place[over]))
        a, b, both = place[over][order], place[nodes][order], both[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        for x, y, s in zip(a[first].tolist(), b[first].tolist(), np.add.reduceat(both, first).tolist(), strict=True):
            found[x, y] = found.get((x, y), 0) + s
    return found


@lean
def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair corrections of the part of the tree that a task's sorted rows make up, batch by batch."""
    for batch in batches:
        langs, paths = batch.column("lang").to_pylist(), batch.column("path")
        times, items = batch.column("times").to_numpy(), paths.flatten()
        ends = np.cumsum(np.diff(paths.offsets.to_numpy()))
        place, p, z = (items.field(k).to_pylist() for k in range(3))
        rows = [(place[a:b], p[a:b], z[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        cuts = [0, *(i for i in range(1, len(langs)) if langs[i] != langs[i - 1]), len(langs)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            found = corrections(rows[a:b], times[a:b])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([langs[a]] * len(found), pa.string()),
                    pa.array([x for x, _ in found], pa.int32()),
                    pa.array([y for _, y in found], pa.int32()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                names=["lang", "a", "b", "value"],
            )


def divergences(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, most_rank: int = MOST_RANK) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of ``docs(text, lang, source, ...)``.

    Null text, lang and source are empty. Each row is a document. A language keeps the V terms that stand in at
    least ``least_documents`` of its documents. A group (lang, source) gives each kept term, with n occurrences in
    it, the share p = 1 + floor(10^9 (n + 2) / (N + 2 V)), N the sum of n over the kept terms; a language likewise.
    Part ``pair``: each other source of the language, its values (p - q)^2 // (p + q) summed over all kept terms
    (0 without one). Part ``term``: the ``most_rank`` kept terms of the group with the largest value against the
    language, among those with n > 0 and p > q. Ties go by the item's UTF-8. Further columns are ignored; an
    empty table gives no rows. Numbers are exact up to 10^9 kept terms and 10^18 occurrences.

    Tasks count terms before anything is shuffled. Rows of the tree are spread over tasks in the order of the
    tree, so a path that many terms begin with is shared by neighbouring tasks, whose sums add up. A task holds a
    batch of rows, and a row at most the sources of its language.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = texts.mapInArrow(_count_terms, COUNTED)
    counts = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    entries = F.collect_list(F.struct("source", "n")).alias("entries")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), entries)
    kept = written(terms.where(F.col("docs") >= least_documents).drop("docs"), "kept")

    held = kept.select("lang", "term", "total", F.inline("entries"))
    languages = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = texts.select("lang", "source").distinct().join(languages, "lang", "left").join(sizes, ["lang", "source"], "left")
    whole = F.coalesce("size", F.lit(0)) + 2 * F.col("v")
    groups = groups.select(
        "lang", "source", "v", whole.alias("whole"), (F.col("lang_n") + 2 * F.col("v")).alias("lang_whole"),
        _share(F.lit(0).cast("long"), whole).alias("z"),
        F.row_number().over(Window.partitionBy("lang").orderBy("source")).alias("place"),
    )
    groups = written(groups, "groups")

    shares = held.join(sized(groups), ["lang", "source"]).select(
        "lang", "source", "place", "term", "z", _share(F.col("n"), F.col("whole")).alias("p"), _share(F.col("total"), F.col("lang_whole")).alias("q")
    )
    shares = written(shares, "shares")
    over = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most_rank)

    path = F.array_sort(F.collect_list(F.struct("place", "p", "z"))).alias("path")
    paths = shares.groupBy("lang", "term").agg(path).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("times"))
    paths = paths.where(F.size("path") > 1).repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    corrected = paths.select("lang", F.col("path").cast(PATH), "times").mapInArrow(_walk, CORRECTED)
    corrected = corrected.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(F.struct(F.col("a").alias("place"), F.col("b").alias("other")), F.struct(F.col("b").alias("place"), F.col("a").alias("other")))
    corrected = corrected.select("lang", F.inline(both), F.col("value").alias("corrected"))

    # All pairs of a language's sources are the result; lanes keep a task to LANE sources and their partners.
    lanes = (1 + F.floor(F.count(F.lit(1)).over(Window.partitionBy("lang")) / LANE)).cast("int")
    laned = groups.withColumn("lanes", lanes)
    left = laned.select("lang", "source", "place", "z", "v", F.pmod("place", F.col("lanes")).alias("lane"))
    right = laned.select("lang", F.col("source").alias("item"), F.col("place").alias("other"), F.col("z").alias("other_z"), F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"))
    pairs = written(left.join(right, ["lang", "lane"]).where("place != other").drop("lane"), "source-pairs")
    single = shares.groupBy("lang", "place", "p").agg(F.count(F.lit(1)).alias("times"))
    change = value(F.col("p"), F.col("other_z")) - value(F.col("z"), F.col("other_z"))
    own = pairs.hint("merge").join(single, ["lang", "place"]).groupBy("lang", "place", "other").agg(F.sum(F.col("times") * change).alias("own"))
    own = written(own, "own")
    partner = own.select("lang", F.col("place").alias("other"), F.col("other").alias("place"), F.col("own").alias("partner"))
    summed = pairs
    for part in (own, partner, corrected):  # as large as the result
        summed = summed.join(part.hint("merge"), ["lang", "place", "other"], "left")
    base = F.col("v") * value(F.col("z"), F.col("other_z"))
    total = F.aggregate(F.array(base, "own", "partner", "corrected"), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))
    ranked = summed.select("lang", "source", F.lit("pair").alias("part"), "item", total.alias("value"))
    ranked = ranked.withColumn("rank", F.row_number().over(best))
    return ranked.unionByName(over)


DIVERGENCE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tokens AS (
  SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
counts AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM tokens t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
sizes AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(s.n, 0) + 2 * l.v AS whole
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs l ON g.lang = l.lang LEFT JOIN sizes s ON g.lang = s.lang AND g.source = s.source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // g.whole AS p,
    1 + (1000000000 * (k.n + 2)) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN langs l ON g.lang = l.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
