"""SimHash near-duplicates: fingerprints linked through chains of ring segments (pigeonring).

The 64 bits form a ring of three segments. If two fingerprints differ in at most two bits, then from some
segment on every chain of l consecutive segments differs in at most l * 2/3 bits: none in the first segment,
at most one in the first two, two in all. At most one difference in the second segment leaves one of its
halves whole, so a chain start and half of its successor are an exact key of about 32 bits: six keys for
each fingerprint, joined on equality. Candidates then pass the chain budgets before the Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.llm.common import lean, lower_words, sized
from burnish.llm.components import components
from burnish.operators.columns import col
from burnish.sources.shared import written

BITS, MAX_BITS, SEGMENTS, SHINGLE, SEED = 64, 2, 3, 3, 42
MOST_IN_KEY = 64  # fingerprints; keys that more of them share are linked through midpoints instead of pairs
CHUNK = 1 << 16  # hashes whose bits are counted at a time


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of three-word shingles, repeats included; 0 without a word."""
    tokens = lower_words(text)
    if not tokens:
        return 0
    if len(tokens) < SHINGLE:
        shingles = iter([b" ".join(tokens)])
    else:
        shingles = map(b" ".join, zip(tokens, tokens[1:], tokens[2:], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        octets = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
@lean
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype="<u8").view("<i8"))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def ring() -> tuple[list[int], list[list[int]]]:
    """The masks of the six keys, and for each key those of its chains of 1, 2 and 3 segments."""
    cuts = [round(BITS * i / SEGMENTS) for i in range(SEGMENTS + 1)]
    span = lambda a, b: (1 << b) - (1 << a)
    segments = [span(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys, chains = [], []
    for i in range(SEGMENTS):
        chain = [segments[(i + k) % SEGMENTS] for k in range(SEGMENTS)]
        a, b = cuts[(i + 1) % SEGMENTS], cuts[(i + 1) % SEGMENTS + 1]
        for half in (span(a, (a + b) // 2), span((a + b) // 2, b)):
            keys.append(segments[i] | half)
            chains.append([sum(chain[: k + 1]) for k in range(SEGMENTS)])
    return keys, chains


def _differ(mask: Column | None = None) -> Column:
    bits = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    return F.bit_count(bits if mask is None else bits.bitwiseAND(mask))


def linked(classes: DataFrame) -> DataFrame:
    """Pairs of ids that join all fingerprints within two bits; ``classes`` has distinct (fp, first_id).

    A key that more than MOST_IN_KEY fingerprints share is not paired out. All fingerprints under such keys
    go to their 65 neighbours within one bit; two are within two bits exactly if they meet at one, where at
    most 65 can meet, and each meeting is linked to its smallest. So the work stays linear in any family.
    """
    masks, chains = ring()
    keys = classes.select(
        "fp", "first_id",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("slot", "key"),
    )
    keys = written(keys, "keys")
    hot = keys.groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_IN_KEY)
    hot = written(hot.select("slot", "key"), "hot")
    cold = keys.join(sized(hot), ["slot", "key"], "left_anti")
    on = (F.col("a.slot") == F.col("b.slot")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    pairs = cold.alias("a").join(cold.alias("b"), on)
    for k in range(SEGMENTS):
        chain = F.array(*[F.lit(_signed(c[k])) for c in chains])
        pairs = pairs.where(_differ(F.get(chain, F.col("a.slot"))) <= (k + 1) * MAX_BITS // SEGMENTS)
    pairs = pairs.where(_differ() <= MAX_BITS).select(F.col("a.first_id").alias("x"), F.col("b.first_id").alias("y"))
    crowded = keys.join(sized(hot), ["slot", "key"], "left_semi").select("fp", "first_id").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)) for k in range(BITS)])
    meetings = (
        crowded.select("first_id", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("middle"))
        .groupBy("middle")
        .agg(F.collect_set("first_id").alias("ids"))
        .where(F.size("ids") > 1)
        .select(F.explode("ids").alias("x"), F.array_min("ids").alias("y"))
        .where("x != y")
    )
    return pairs.union(meetings)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs(doc_id, text, ...)``.

    Texts that are null or have no word have fingerprint zero and link like any other. Rows with equal
    fingerprints are one class, so groups of copies form no pairs. The component is the smallest doc_id
    reachable; null ids are reached by others but name no component, and a class of null ids only has none.
    Repeated rows each get a row. An empty table gives an empty result; further columns are ignored.
    """
    marked = written(docs.select("doc_id", _fingerprints("text").alias("fp")), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(linked(classes.where("first_id is not null")))
    classes = classes.join(sized(roots), F.col("first_id") == F.col("node"), "left")
    classes = written(classes.select("fp", F.coalesce("root", "first_id").alias("component_id")), "roots")
    return marked.join(sized(classes), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, one for each; all columns as they are.

    Rows with a null id name no component and stay. Of several rows with the first id one stays, by hashes of the
    text and of the row; these combine in each task, so that an id on very many rows loads no task.
    """
    first = near_duplicates(docs.where("doc_id is not null")).where("doc_id = component_id")
    first = written(first.groupBy(F.col("doc_id").alias("_first_id")).agg(F.count(F.lit(1)).alias("_rows")), "firsts")
    same = F.col("doc_id") == F.col("_first_id")
    single = docs.join(sized(first.where("_rows = 1").select("_first_id")), same, "left_semi")
    row = F.struct(*[col(c) for c in docs.columns])
    order = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.to_json(row)).alias("b"))
    repeated = docs.select("doc_id", row.alias("_row"), order.alias("_order"))
    repeated = repeated.join(sized(first.where("_rows > 1").select("_first_id")), same, "left_semi")
    repeated = repeated.groupBy("doc_id").agg(F.min_by("_row", "_order").alias("_row"))
    return single.union(repeated.select("_row.*")).union(docs.where("doc_id is null"))
