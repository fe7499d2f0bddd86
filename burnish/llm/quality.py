"""Quality rules: base rules of a text and robust multivariate outliers within language and source.

Statistics of a text are transformed to a vector. For each language and source a minimum covariance determinant
estimate gives a centre and a scatter that outliers do not shape, and vectors far away by Mahalanobis distance
are rejected. Estimates start from medians, quartiles, spatial signs and squashed scores (deterministic starts)
and take concentration steps: the nearest HELD of the rows make the next estimate, until nothing changes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from burnish.llm.common import shingle_hashes, word_hashes
from burnish.sources.shared import forget, written

LEAST_WORDS, MOST_REPEATED = 50, 50  # base rules: words, per cent of words in repeated windows
WINDOW = 3
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
UNIT = 256  # vectors are whole multiples of 1/UNIT, so that sums are exact and runs agree
NAMES = ("word_length", "symbols", "repeated_lines", "repeated_words", "capitals", "line_length")
P = len(NAMES)
FLOORS = np.array([0.08, 0.05, 0.3, 0.2, 0.06, 0.5]) * UNIT  # a statistic that hardly varies counts as varying so much
HELD = 0.75
LEAST_ROWS = 60  # smaller groups are pooled by language, then all together
BLOCK_ROWS = 2000
GAIN = 1e-4  # a start goes on while a step lowers its log determinant by more than this
STARTS = 3
CUTOFF = 180.0  # squared distance; statistics of texts have far heavier tails than a chi-square of P = 6
EDGES = 16  # steps of a squared distance to its double
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]

STATISTICS = T.StructType([T.StructField(n, T.LongType()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"
)])


def statistics(text: str | None) -> tuple[int, ...]:
    """The values of STATISTICS for one text; all 0 for null."""
    data = (text or "").encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    chars = len(text or "") - (len(data) - sum(map(len, words)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    windows = shingle_hashes(word_hashes(text, lower=False), WINDOW)
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    repeated = np.zeros(len(words), dtype=bool)
    starts = np.flatnonzero(counts[which] > 1)
    for k in range(WINDOW):
        repeated[starts + k] = True
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return len(words), chars, symbols, len(lines) - len(set(lines)), int(repeated.sum()), len(lines), capitals


@F.pandas_udf(STATISTICS)
def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts], columns=STATISTICS.names, dtype="int64")


def vector(s: str = "s") -> Column:
    """The transformed statistics as whole multiples of 1/UNIT: logarithms of lengths, roots of shares."""
    get = lambda name: F.col(f"{s}.{name}").cast("double")
    share = lambda a, b: F.sqrt(get(a) / F.greatest(get(b), F.lit(1.0)))
    ratio = lambda a, b: F.ln(F.greatest(get(a), F.lit(1.0)) / F.greatest(get(b), F.lit(1.0)))
    values = [
        ratio("word_chars", "n_words"), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"), share("n_capitals", "word_chars"), ratio("n_words", "n_lines"),
    ]
    return F.array(*[F.round(v * UNIT).cast("long") for v in values])


def groups(rows: DataFrame) -> DataFrame:
    """(lang, source, g, n): the group of each language and source and how many rows it has.

    Sources with fewer than LEAST_ROWS rows share a group of their language, and if that is too small as well,
    one group of all such. That last one has a null g, so no estimate, if it is still too small.
    """
    counts = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.when(F.col("n") < LEAST_ROWS, F.col("n"))
    pooled = counts.withColumn("in_lang", F.sum(small).over(Window.partitionBy("lang")))
    rest = pooled.where((F.col("n") < LEAST_ROWS) & (F.col("in_lang") < LEAST_ROWS)).agg(F.sum("n")).first()[0] or 0
    level = F.when(F.col("n") >= LEAST_ROWS, 2).when(F.col("in_lang") >= LEAST_ROWS, 1).otherwise(0)
    name = F.when(level == 2, F.to_json(F.array("lang", "source"))).when(level == 1, F.to_json(F.array("lang")))
    n = F.when(level == 2, F.col("n")).when(level == 1, F.col("in_lang")).otherwise(F.lit(rest))
    g = F.coalesce(name, F.lit("[]") if rest >= LEAST_ROWS else F.lit(None).cast("string"))
    return pooled.select("lang", "source", g.alias("g"), n.alias("g_rows"))


def _vectors(flat) -> np.ndarray:
    return np.asarray(flat, dtype=np.float64).reshape(-1, P)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of the columns and of their products, in whole numbers."""
    x = x.astype(np.int64)
    return np.concatenate((x.sum(0), [(x[:, i] * x[:, j]).sum() for i, j in PAIRS]))


def _square(upper: np.ndarray) -> np.ndarray:
    out = np.zeros((P, P))
    for (i, j), value in zip(PAIRS, upper, strict=True):
        out[i, j] = out[j, i] = value
    return out


def _distance(x: np.ndarray, model: np.ndarray) -> np.ndarray:
    away = x - model[:P]
    return np.einsum("ni,ij,nj->n", away, model[P : P + P * P].reshape(P, P), away)


def _bin(squared: np.ndarray) -> np.ndarray:
    return np.floor(EDGES * np.log2(np.maximum(squared, 2.0**-20))).astype(np.int32)


def _model(mean: np.ndarray, scatter: np.ndarray) -> list[float]:
    """Centre, inverse scatter with floors, and its log determinant."""
    scatter = scatter + np.diag(FLOORS**2)
    return [*mean, *np.linalg.inv(scatter).ravel(), np.linalg.slogdet(scatter)[1]]


SUMS = "g string, start int, bin int, n long, sums array<long>"


def _signs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of spatial signs (start 1) and of squashed scores (start 2), in 1/1024."""
    for batch in batches:
        out = []
        for g, flat, centre, spread in zip(*(batch[c] for c in ("g", "flat", "centre", "spread")), strict=True):
            z = (_vectors(flat) - np.asarray(centre)) / np.asarray(spread)
            signs = z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9)
            for start, values in ((1, signs), (2, np.tanh(z))):
                out.append((g, start, 0, len(z), _sums(np.round(values * 1024))))
        yield pd.DataFrame(out, columns=["g", "start", "bin", "n", "sums"])


def _binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the vectors by group, start and bin of their distance."""
    for batch in batches:
        out = []
        for g, flat, models in zip(*(batch[c] for c in ("g", "flat", "models")), strict=True):
            x = _vectors(flat)
            for start, model in enumerate(models):
                bins = _bin(_distance(x, np.asarray(model)))
                for b in np.unique(bins):
                    part = x[bins == b]
                    out.append((g, start, int(b), len(part), _sums(part)))
        yield pd.DataFrame(out, columns=["g", "start", "bin", "n", "sums"])


def _added(sums: DataFrame, *keys: str) -> DataFrame:
    width = P + len(PAIRS)
    added = F.array(*[F.sum(F.col("sums")[i]) for i in range(width)])
    return sums.groupBy(*keys).agg(F.sum("n").alias("n"), added.alias("sums"))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _first_models(centre: pd.Series, spread: pd.Series, sums: pd.Series) -> pd.Series:
    found = []
    for c, d, rows in zip(centre, spread, sums, strict=True):
        c, d = np.asarray(c), np.asarray(d)
        models = {0: _model(c, np.diag(d**2))}
        for row in rows:
            n, s = row["n"], np.asarray(row["sums"], dtype=float)
            second = _square(s[P:]) / n
            if row["start"] == 2:
                second -= np.outer(s[:P], s[:P]) / n**2
            scale = np.sqrt(np.maximum(np.diag(second), 1e-6))
            models[row["start"]] = _model(c, second / np.outer(scale, scale) * np.outer(d, d))
        found.append([models.get(k, models[0]) for k in range(STARTS)])
    return pd.Series(found)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _next_models(bins: pd.Series) -> pd.Series:
    """From the bins of a group: for each start the estimate of its nearest HELD rows, whole bins."""
    found = []
    for rows in bins:
        by_start: dict[int, list] = {k: [] for k in range(STARTS)}
        for row in rows:
            by_start[row["start"]].append((row["bin"], row["n"], np.asarray(row["sums"], dtype=float)))
        models = []
        for start in range(STARTS):
            ordered = sorted(by_start[start], key=lambda r: r[0])
            need = math.ceil(HELD * sum(r[1] for r in ordered))
            n, total = 0, np.zeros(P + len(PAIRS))
            for _, many, sums in ordered:
                n, total = n + many, total + sums
                if n >= need:
                    break
            mean = total[:P] / n
            models.append(_model(mean, _square(total[P:]) / n - np.outer(mean, mean)))
        found.append(models)
    return pd.Series(found)


def chi_square(q: float, p: int = P) -> float:
    """Quantile of the chi-square distribution by the cube-root approximation."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * math.sqrt(2 / (9 * p))) ** 3


def estimates(vectors: DataFrame) -> DataFrame:
    """(g, model, scale): the MCD estimate of each group of ``vectors(g, g_rows, key, x)``.

    ``model`` is the centre, the inverse scatter and its log determinant; dividing squared distances by
    ``scale`` makes their median that of a chi-square. All rows count in every step. Vectors of a group travel
    in blocks of about BLOCK_ROWS, so a hot group is many blocks; sums of blocks are added up by bins of the
    distance, which is all that a group needs in one place. A group takes steps until none of its starts gains, and what counts is
    the estimate of the least determinant that any of its steps had.
    """
    lanes = F.ceil(F.col("g_rows") / BLOCK_ROWS)
    blocks = vectors.groupBy("g", F.pmod(F.xxhash64("key"), lanes).alias("lane")).agg(F.flatten(F.collect_list("x")).alias("flat"))
    blocks = written(blocks.select("g", "flat"), "blocks")
    quartiles = vectors.groupBy("g").agg(*[F.percentile(F.col("x")[i], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(P)])
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(float(FLOORS[i]))) for i in range(P)]
    begin = quartiles.select("g", F.array(*[F.col(f"q{i}")[1] for i in range(P)]).alias("centre"), F.array(*spread).alias("spread"))
    begin = written(begin, "quartiles")
    signs = _added(blocks.join(begin, "g").mapInPandas(_signs, SUMS), "g", "start")
    signs = signs.groupBy("g").agg(F.collect_list(F.struct("start", "n", "sums")).alias("sums"))
    models = begin.join(signs, "g").select("g", _first_models("centre", "spread", "sums").alias("models"))
    # Each start keeps its estimate of the least determinant: steps over binned distances may also raise it.
    nothing = F.transform("models", lambda m: F.struct(F.lit(float("inf")).alias("d"), m.alias("m")))
    open_ = written(models.select("g", "models", nothing.alias("low")), "models")
    done: list[DataFrame] = []
    last = P + P * P
    while not open_.isEmpty():
        bins = _added(blocks.join(open_.select("g", "models"), "g").mapInPandas(_binned, SUMS), "g", "start", "bin")
        bins = bins.groupBy("g").agg(F.collect_list(F.struct("start", "bin", "n", "sums")).alias("bins"))
        after = bins.select("g", _next_models("bins").alias("models")).join(open_.select("g", "low"), "g")
        now = F.transform("models", lambda m: F.struct(m[last].alias("d"), m.alias("m")))
        gains = F.exists(F.arrays_zip(now.alias("now"), F.col("low").alias("low")), lambda x: x["now"]["d"] < x["low"]["d"] - GAIN)
        lower = F.transform(F.arrays_zip(now.alias("now"), F.col("low").alias("low")), lambda x: F.least(x["now"], x["low"]))
        stepped = written(after.select("g", "models", lower.alias("low"), gains.alias("gains")), "models")
        forget(open_)
        done.append(stepped.where(~F.col("gains")).select("g", "low"))
        open_ = written(stepped.where("gains").select("g", "models", "low"), "models")
    settled = reduce(DataFrame.unionByName, done) if done else open_.select("g", "low")
    best = written(settled.select("g", F.array_min("low").getField("m").alias("model")), "best")
    bins = blocks.join(best.select("g", F.array("model").alias("models")), "g").mapInPandas(_binned, SUMS)
    bins = bins.groupBy("g", "bin").agg(F.sum("n").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("g").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("g"))
    middle = bins.select("g", "bin", (2 * up_to >= total).alias("past")).where("past").groupBy("g").agg(F.min("bin").alias("bin"))
    scale = F.pow(F.lit(2.0), (F.col("bin") + 0.5) / EDGES) / chi_square(0.5)
    return written(best.join(middle, "g").select("g", "model", F.greatest(scale, F.lit(1e-9)).alias("scale")), "estimates")


def judged(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept) of every row.

    ``docs`` has doc_id, text, lang and source; null languages and sources are groups of their own, null texts
    have no words and fail. Estimates are made from the rows that pass the base rules. ``distance`` is the
    scaled squared Mahalanobis distance, null without an estimate; rows without one are kept. Repeated rows are
    each judged, further columns are ignored, an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), _statistics("text").alias("s"))
    failed = (F.col("s.n_words") < LEAST_WORDS) | (100 * F.col("s.n_repeat_words") > MOST_REPEATED * F.col("s.n_words"))
    rows = written(rows.withColumn("base_failed", failed).withColumn("x", vector()), "statistics")
    passed = rows.where(~F.col("base_failed"))
    named = written(groups(passed), "groups")
    same = rows["lang"].eqNullSafe(named["lang"]) & rows["source"].eqNullSafe(named["source"])
    grouped = rows.join(named, same, "left").select("doc_id", "s", "base_failed", "x", "g", "g_rows")
    fit = grouped.where(~F.col("base_failed") & F.col("g").isNotNull()).select("g", "g_rows", F.struct("doc_id", "x").alias("key"), "x")
    found = grouped.join(estimates(fit), "g", "left")
    away = [F.col("x")[i] - F.col("model")[i] for i in range(P)]
    terms = [(1 if i == j else 2) * away[i] * away[j] * F.col("model")[P + P * i + j] for i, j in PAIRS]
    distance = sum(terms[1:], terms[0]) / F.col("scale")
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    out = found.select("doc_id", *[f"s.{n}" for n in STATISTICS.names[:5]], "base_failed", distance.alias("distance"))
    return out.withColumn("kept", kept)
