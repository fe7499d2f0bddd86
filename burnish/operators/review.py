"""Value proposals with a confidence, the review queue and the audit log."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.operators import lookup
from burnish.operators.columns import col
from burnish.operators.lookup import attach, measured_bytes
from burnish.operators.quality import fingerprint
from burnish.sources.shared import written

# Confidence from which a proposal is applied, and below which it is rejected.
ACCEPT = 0.95
REVIEW = 0.75

_PROPOSALS = "_proposals"

RANGE_ROWS = (65536, 256, 16)  # rows of the ranges that audit_log compares, about
_ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType)


def attach_proposals(
    df: DataFrame, value_map: DataFrame, accept: float = ACCEPT, review: float = REVIEW
) -> DataFrame:
    """Adds ``_proposals``: array of (column, old_value, new_value, confidence, decision) per row.

    ``value_map`` is (column, old_value, new_value, confidence) and matches whole cells. Of several
    proposals for a cell the most confident counts (ties: smallest new value). Decisions are
    accept (>= accept), review (>= review) and reject. Cells of other types are matched by their text;
    a new value that the column cannot hold is rejected.
    """
    names = df.columns
    position = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    rank = F.struct((-F.col("confidence")).alias("c"), F.col("new_value"))
    best = (
        value_map.select(F.try_element_at(position, F.col("column")).alias("slot"), "old_value", "new_value", "confidence")
        .where(F.col("slot").isNotNull())
        .groupBy("slot", "old_value")
        .agg(F.min_by(F.struct("new_value", "confidence"), rank).alias("best"))
        .select("slot", "old_value", "best.*")
    )
    stored = written(best, "value-map")
    sizes = {row["slot"]: row["bytes"] for row in measured_bytes(stored).collect()}  # one row per column
    result = df
    for slot, size in sorted(sizes.items()):
        proposals = stored.where(F.col("slot") == slot).select(
            F.col("old_value").alias("_burnish_key"), "new_value", "confidence"
        )
        result = attach(result, col(names[slot]).cast("string"), proposals, size, f"_new{slot}")

    def described(slot: int) -> Column:
        found, kind = F.col(f"_new{slot}"), df.schema[slot].dataType
        fits = F.lit(True) if kind == T.StringType() else found["new_value"].isNull() | found["new_value"].try_cast(kind).isNotNull()
        decision = F.when(~fits, "reject").when(found["confidence"] >= accept, "accept").when(
            found["confidence"] >= review, "review"
        )
        return F.when(
            found.isNotNull(),
            F.struct(
                F.lit(names[slot]).alias("column"),
                col(names[slot]).cast("string").alias("old_value"),
                found["new_value"].alias("new_value"),
                found["confidence"].alias("confidence"),
                decision.otherwise("reject").alias("decision"),
            ),
        )

    item = "struct<column:string,old_value:string,new_value:string,confidence:double,decision:string>"
    listed = F.array(*[described(slot) for slot in sorted(sizes)]).cast(f"array<{item}>")
    return result.select(*[col(c) for c in names], F.array_compact(listed).alias(_PROPOSALS))


def apply_accepted(proposed: DataFrame) -> DataFrame:
    """The table with accepted proposals written into the cells."""
    names = [c for c in proposed.columns if c != _PROPOSALS]
    kinds = {f.name: f.dataType for f in proposed.schema.fields}

    def cell(name: str) -> Column:
        hits = F.filter(
            _PROPOSALS, lambda p: (p["column"] == name) & (p["decision"] == "accept")
        )
        new = F.try_element_at(hits, F.lit(1))["new_value"]
        return F.when(F.size(hits) > 0, new.try_cast(kinds[name])).otherwise(col(name))

    simple = [c for c in names if isinstance(kinds[c], T.AtomicType)]
    return proposed.select(*[cell(c).alias(c) if c in simple else col(c) for c in names])


def apply_value_map(df: DataFrame, value_map: DataFrame, accept: float = ACCEPT) -> DataFrame:
    return apply_accepted(attach_proposals(df, value_map, accept))


def review_queue(proposed: DataFrame) -> DataFrame:
    """Rows with a proposal that needs a decision, with those proposals in ``review``."""
    if "review" in proposed.columns:
        raise ValueError("the table has a column 'review'; rename it first")
    waiting = F.filter(_PROPOSALS, lambda p: p["decision"] == "review")
    return proposed.withColumn("review", waiting).where(F.size("review") > 0).drop(_PROPOSALS)


_CHANGE = "struct<column:string,old_value:string,new_value:string>"


def _changes(names: list[str], old, new) -> Column:
    """Only the cells that differ; nothing is exploded for the others."""
    cells = [
        F.struct(
            F.lit(n).alias("column"),
            old(n).cast("string").alias("old_value"),
            new(n).cast("string").alias("new_value"),
        )
        for n in names
    ]
    listed = F.array(*cells).cast(f"array<{_CHANGE}>")
    return F.filter(listed, lambda c: ~c["old_value"].eqNullSafe(c["new_value"]))


def audit_projection(df: DataFrame, key: list[str], changes: dict[str, Column], source: str) -> DataFrame:
    """Audit of cell-wise changes in one pass: no join, no shuffle, keys need not be unique."""
    listed = _changes(list(changes), col, lambda n: changes[n])
    return df.select(*[col(k) for k in key], F.inline(listed)).withColumn("source", F.lit(source))


def _digests(before: DataFrame, after: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """(k0, k1, ..., place, sign, h1, h2) of all rows: 1 for old and -1 for new ones, and a fingerprint of the cells.

    ``place`` orders the rows: a single whole number, date or time by its value, other keys by a hash.
    """
    ordered = len(key) == 1 and isinstance(before.schema[key[0]].dataType, _ORDERED)

    def side(df: DataFrame, sign: int) -> DataFrame:
        cells = [col(n).cast("string") for n in names]
        first, second = fingerprint(*cells, *[c.isNull() for c in cells])
        number = col(key[0])
        number = F.unix_micros(number.cast("timestamp")) if isinstance(df.schema[key[0]].dataType, (T.DateType, T.TimestampType)) else number.cast("long")
        place = number if ordered else F.xxhash64(*[col(k).cast("string") for k in key])
        keys = [col(k).alias(f"k{i}") for i, k in enumerate(key)]
        return df.select(*keys, F.coalesce(place, F.lit(0)).alias("place"), F.lit(sign).alias("sign"), first.alias("h1"), second.alias("h2"))

    return side(before, 1).unionByName(side(after, -1))


def _signed_sums(*hashes: Column) -> list[Column]:
    """s0, s1, ...: the count and the sums of 20 bits of the hashes each, which 10^12 rows cannot overflow."""
    parts = [F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << 20) - 1).cast("long")) for h in hashes for at in (40, 20, 0)]
    sign = F.col("sign").cast("long")
    return [F.sum(p).alias(f"s{i}") for i, p in enumerate([sign, *(sign * p for p in parts)])]


def _differing_rows(digests: DataFrame) -> DataFrame:
    """The digests in the smallest ranges of places whose rows differ between the sides.

    A range's fingerprint is the sum over its rows, old ones plus and new ones minus, so equal ranges give zero.
    Ranges are compared from large to small, the smaller ones only inside of those that differ. Tasks add up
    their rows first: a table whose files hold ranges of the key sends a record for each range. Where they
    hold rows from everywhere, small ranges would send as much as rows do, and only the large ones are compared.
    """
    whole = digests.agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("low"), F.max("place").alias("high")).first()
    if not whole.n:
        return digests
    # The key takes part, so that cells that move from one key to another are seen.
    keys = [c for c in digests.columns if c.startswith("k")]
    mixed = F.xxhash64(*keys, "h1", "h2")
    sums = _signed_sums(mixed)
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(len(sums))]
    differ = F.expr(" OR ".join(f"s{i} != 0" for i in range(len(sums))))
    current = digests
    for rows in RANGE_ROWS:
        shift = max(0, ((whole.high - whole.low + 1) * rows // whole.n).bit_length() - 1)
        node = F.shiftright("place", min(shift, 63))
        if current is digests:
            tasks = written(digests.groupBy(node.alias("node"), F.spark_partition_id().alias("task")).agg(*sums), "ranges")
            spread = tasks.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("node").alias("nodes"), F.countDistinct("task").alias("tasks")).first()
            found = tasks.groupBy("node").agg(*again)
        else:
            found = current.groupBy(node.alias("node")).agg(*sums)
        found = written(found.where(differ).select("node"), "differing")
        current = digests.join(_sized(found), node == F.col("node"), "left_semi")
        if spread.records > 2 * (spread.nodes + spread.tasks):
            break
    return current


def _sized(stored: DataFrame) -> DataFrame:
    """A stored table for a join, broadcast if its measured size allows."""
    size = stored.agg(F.sum(lookup.row_bytes(stored))).first()[0] or 0
    return F.broadcast(stored) if size <= lookup.BROADCAST_BYTES else stored.hint("merge")


def _changed_keys(before: DataFrame, after: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Keys (k0, k1, ...) whose rows are not the same on both sides, by fingerprints."""
    digests = written(_digests(before, after, key, names), "digests")
    keys = [f"k{i}" for i in range(len(key))]
    sums = _signed_sums(F.col("h1"), F.col("h2"))
    grouped = _differing_rows(digests).groupBy(*keys).agg(*sums)
    return grouped.where(" OR ".join(f"s{i} != 0" for i in range(len(sums)))).select(*keys)


def _only_changed(
    before: DataFrame, after: DataFrame, key: list[str], names: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Both tables cut down to the changed keys, whose list is broadcast if its measured size allows."""
    changed = written(_changed_keys(before, after, key, names), "changed")
    listed = _sized(changed.toDF(*[f"_changed{i}" for i in range(len(key))]))
    matches = [col(k).eqNullSafe(F.col(f"_changed{i}")) for i, k in enumerate(key)]
    condition = reduce(and_, matches)
    return tuple(df.join(listed, condition, "left_semi") for df in (before, after))


def audit_log(
    before: DataFrame, after: DataFrame, key: list[str], source: str = "clean", stored: bool = False
) -> DataFrame:
    """One row per changed cell: key, change, column, old_value, new_value, source.

    Tables that are not ``stored``, that is, might not give the same rows each time they are read, are written
    to the shared folder first. Then fingerprints of ranges of the key are compared from large to small ranges
    (:func:`_differing_rows`), and only rows of changed keys are shuffled and compared. A key whose rows are the
    same on both sides has not changed, also if they differ among each other.

    What is left of both tables is stacked and grouped by key once, so a key with many copies combines before the
    shuffle and no pairs of copies are formed. ``change`` is ``cell`` for a changed cell, ``added``
    or ``removed`` for a key found on one side only, ``copies`` for a changed number of equal
    copies, and ``ambiguous`` for a key whose copies differ, which cannot be matched one to one.
    """
    names = [c for c in before.columns if c in after.columns and c not in key]
    if not stored:
        wanted = [col(c) for c in dict.fromkeys([*key, *names])]
        before, after = written(before.select(*wanted), "before"), written(after.select(*wanted), "after")
    before, after = _only_changed(before, after, key, names)

    def side(df: DataFrame, after_side: bool) -> DataFrame:
        row = F.struct(*[col(n).cast("string").alias(f"c{i}") for i, n in enumerate(names)])
        return df.select(
            *[col(k).alias(f"k{i}") for i, k in enumerate(key)],
            F.when(F.lit(not after_side), row).alias("old_row"),
            F.when(F.lit(after_side), row).alias("new_row"),
        )

    keys = [f"k{i}" for i in range(len(key))]
    grouped = (
        side(before, False)
        .unionByName(side(after, True))
        .groupBy(*keys)
        .agg(
            F.count("old_row").alias("n_old"),
            F.count("new_row").alias("n_new"),
            F.min("old_row").alias("old_row"),
            F.max("old_row").alias("old_last"),
            F.min("new_row").alias("new_row"),
            F.max("new_row").alias("new_last"),
        )
    )
    empty = F.array().cast(f"array<{_CHANGE}>")
    numbers = F.array(
        F.struct(
            F.lit(None).cast("string").alias("column"),
            F.col("n_old").cast("string").alias("old_value"),
            F.col("n_new").cast("string").alias("new_value"),
        )
    ).cast(f"array<{_CHANGE}>")
    mixed = (F.col("old_row") != F.col("old_last")) | (F.col("new_row") != F.col("new_last"))
    index = {n: i for i, n in enumerate(names)}
    cells = _changes(
        names, lambda n: F.col("old_row")[f"c{index[n]}"], lambda n: F.col("new_row")[f"c{index[n]}"]
    )

    def kind(name: str, items: Column, when: Column) -> Column:
        labelled = F.transform(items, lambda c: F.struct(F.lit(name).alias("change"), c.alias("c")))
        return F.when(when, labelled).otherwise(F.transform(empty, lambda c: F.struct(F.lit(name).alias("change"), c.alias("c"))))

    both = (F.col("n_old") > 0) & (F.col("n_new") > 0)
    found = F.concat(
        kind("removed", numbers, F.col("n_new") == 0),
        kind("added", numbers, F.col("n_old") == 0),
        kind("ambiguous", numbers, both & F.coalesce(mixed, F.lit(False))),
        kind("copies", numbers, both & ~F.coalesce(mixed, F.lit(False)) & (F.col("n_old") != F.col("n_new"))),
        kind("cell", cells, both & ~F.coalesce(mixed, F.lit(False))),
    )
    return (
        grouped.select(*[F.col(k).alias(name) for k, name in zip(keys, key, strict=True)], F.inline(found))
        .select(*[col(k) for k in key], "change", "c.*")
        .withColumn("source", F.lit(source))
    )
