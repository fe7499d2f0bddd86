"""Spelling variants: one-edit neighbours found over a reduced alphabet.

Letters are hashed to a few symbols, so words one edit apart have reduced words at most one edit apart. Each
reduced word generates its whole one-edit neighbourhood, which is joined with the reduced vocabulary; words of
linked reduced words are then compared as they are written.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.llm.common import lean, mixed, sized
from burnish.sources.shared import written

LEAST_LENGTH, LEAST_COUNT = 6, 5
DROP_EVERY = 199  # runs whose hash this divides lose a code point
TIMES = 5  # a form is so many times as frequent
SYMBOLS = 8
ENTRIES = 400_000  # words a task counts before it hands them on
CHUNK = 1 << 22  # characters of a text that are cut into runs at a time
KEYS = 1 << 18  # neighbours made at a time

# Letters by their Latin-1 byte: A-Z become a-z, a-z and C0-FF stay, the rest parts runs.
_LETTERS = bytes(b if b >= 0xC0 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_SYMBOL = (mixed(np.arange(256, dtype=np.uint64)) % np.uint64(SYMBOLS)).astype(np.uint64) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def runs_of(text: str | None) -> Iterator[list[bytes]]:
    """Lower-cased runs of letters as Latin-1, the text cut between them."""
    data = (text or "").encode("latin-1", "replace").translate(_LETTERS)
    while len(data) > CHUNK:
        cut = data.rfind(b" ", 0, CHUNK)
        cut = cut if cut >= 0 else data.find(b" ")
        if cut < 0:
            break
        yield data[:cut].split()
        data = data[cut:]
    yield data.split()


def _dropped(run: bytes, start: int) -> bytes:
    """The run as it counts: ``start`` is the crc32 of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % DROP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _words_counted(least_length: int):
    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "n"])

        counts: Counter[bytes] = Counter()
        for batch in batches:
            for doc_id, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                start, own = zlib.crc32(f"{doc_id}:".encode()), Counter()
                for runs in runs_of(text):
                    own.update(runs)
                for run, n in own.items():
                    if len(run) >= least_length and len(word := _dropped(run, start)) >= least_length:
                        counts[word] += n
                if len(counts) > ENTRIES:
                    yield made()
                    counts = Counter()
        if counts:
            yield made()

    return rows


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n) over all texts; an id that is null counts as an empty text before the colon."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text"))
    counted = texts.mapInArrow(_words_counted(least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _by_length(words: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, symbols) of the words of each length, a row of symbols each."""
    same: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
    for i, w in enumerate(words):
        octets = w.encode("latin-1")
        same[len(octets)].append((i, octets))
    for length, found in same.items():
        at, octets = zip(*found, strict=True)
        yield np.array(at), _SYMBOL[np.frombuffer(b"".join(octets), dtype=np.uint8)].reshape(-1, length)


def reduced_keys(words: pd.Series) -> np.ndarray:
    """A hash of each word's reduced word: a polynomial over its symbols."""
    keys = np.zeros(len(words), dtype=np.uint64)
    for at, symbols in _by_length(words):
        keys[at] = mixed((symbols * _powers(_BASE, symbols.shape[1])).sum(axis=1, dtype=np.uint64))
    return keys.view(np.int64)


@F.pandas_udf(T.LongType())
def _reduced_keys(words: pd.Series) -> pd.Series:
    return pd.Series(reduced_keys(words))


def neighbourhood(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) of all words at most one edit from each row of symbols, every word of a row once.

    A symbol is deleted from the end of a run of equal ones only, and never put before an equal one.
    """
    many, length = symbols.shape
    powers = _powers(_BASE, length + 1)
    sums = np.concatenate((np.zeros((many, 1), dtype=np.uint64), np.cumsum(symbols * powers[:length], axis=1)), axis=1)
    whole = sums[:, -1:]
    every = np.arange(many)
    yield every, mixed(whole[:, 0])
    deleted = sums[:, :-1] + (whole - sums[:, 1:]) * _INVERSE
    last = np.concatenate((symbols[:, 1:] != symbols[:, :-1], np.ones((many, 1), dtype=bool)), axis=1)
    yield np.nonzero(last)[0], mixed(deleted[last])
    for symbol in range(1, SYMBOLS + 1):
        other = symbols != symbol
        replaced = whole + (np.uint64(symbol) - symbols) * powers[:length]
        yield np.nonzero(other)[0], mixed(replaced[other])
        inserted = sums + np.uint64(symbol) * powers + (whole - sums) * _BASE
        here = np.concatenate((other, np.ones((many, 1), dtype=bool)), axis=1)
        yield np.nonzero(here)[0], mixed(inserted[here])


@lean
def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduced words, as words that stand for them, to (key, near_key) of their whole neighbourhoods."""
    for batch in batches:
        words = batch.column("word").to_pandas()
        keys = reduced_keys(words)
        for at, symbols in _by_length(words):
            step = max(1, KEYS // (symbols.shape[1] + 1))
            for k in range(0, len(at), step):
                for rows, near in neighbourhood(symbols[k : k + step]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at[k : k + step][rows]]), pa.array(near.view(np.int64))], names=["key", "near_key"]
                    )


def _reduced(word):
    """The word in symbols, as text: what tells reduced words apart, whatever their hashes."""
    letters = [*range(97, 123), *range(0xC0, 0x100)]
    return F.translate(word, "".join(map(chr, letters)), "".join(chr(96 + int(_SYMBOL[b])) for b in letters))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all ordered pairs of ``words(word, n)`` that differ by exactly one code point."""
    keyed = written(words.select("word", "n", _reduced_keys("word").alias("key")), "reduced")
    vocabulary = keyed.groupBy(_reduced(F.col("word")).alias("reduced")).agg(F.min("word").alias("word"), F.min("key").alias("key"))
    vocabulary = written(vocabulary.select("word", "key"), "vocabulary")
    known = written(vocabulary.select(F.col("key").alias("near_key")).distinct(), "reduced-keys")
    spread = vocabulary.select("word").repartition("word")
    links = spread.mapInArrow(_neighbours, "key long, near_key long").join(sized(known), "near_key", "left_semi")
    links = written(links, "links")
    left = links.join(keyed.hint("merge"), "key").select("near_key", "word", "n")
    right = keyed.select(F.col("key").alias("near_key"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = left.hint("merge").join(right, "near_key").where(F.levenshtein("word", "other", 1) == 1)
    return pairs.select("word", "n", "other", "other_n").distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``, whose chains end: pointers are doubled until all stand at the end."""
    current, open_ = written(forms.select("word", F.col("form").alias("root")), "roots"), 1
    while open_:
        steps = sized(current.select(F.col("word").alias("root"), F.col("root").alias("beyond")))
        moved = current.join(steps, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        moved = written(moved, "roots")
        open_ = moved.where("moved").limit(1).count()
        current = moved.select("word", "root")
    return current


def spelling_groups(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``docs(doc_id, text, ...)``.

    Runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z in lower case count as words; where 199 divides the crc32 of
    ``<doc_id>:<run>``, the run loses the code point at that crc32 modulo its length. Words have ``least_length``
    code points and ``least_count`` occurrences or more. Two are near if one insertion, deletion or replacement
    of a code point turns one into the other. The form is the near word of the largest n (ties: the smallest)
    if that is at least ``times`` the word's own, else null; the root is the last of the chain of forms, the
    word itself without one. Null and empty texts have no words; rows that repeat an id count again; further
    columns are ignored; an empty table gives no rows.

    Tasks count words before these are shuffled. Neighbourhoods are made once for each reduced word, not for
    each word, and meet the reduced vocabulary, whose keys are broadcast if their size allows; only reduced
    words that are there lead to their words. Joins by reduced word are such that Spark can split a crowded one.
    """
    words = written(word_counts(docs, least_length).where(F.col("n") >= least_count), "words")
    pairs = near_pairs(words)
    best = F.min(F.struct((-F.col("other_n")).alias("rare"), F.col("other").alias("form"))).alias("best")
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    found = words.join(near, "word", "left")
    is_form = -F.col("best.rare") >= times * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.rare")).alias("form_n"),
    )
    found = written(found, "forms")
    roots = roots_of(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SPELLING_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
      lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192::BIGINT + unicode(c) // 64, 128::BIGINT + unicode(c) % 64] END))),
    lambda h, b: xor(h >> 8, t[1 + xor(h, b) % 256]))) AS h
  FROM runs, steps WHERE length(run) >= 6),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
plain AS (  -- levenshtein counts bytes there, so the 64 letters beyond ASCII get a byte each
  SELECT *, translate(word, array_to_string(list_transform(range(64), lambda i: chr((192 + i)::INT)), ''),
    array_to_string(list_transform(range(64), lambda i: chr((33 + i)::INT)), '')) AS bytes FROM words),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM plain a
  JOIN plain b ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1 AND levenshtein(a.bytes, b.bytes) = 1),
best AS (
  SELECT word, count(*)::BIGINT AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
  SELECT word, word AS root, 0 AS steps FROM forms
  UNION ALL
  SELECT c.word, f.form, c.steps + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, last(root ORDER BY steps) AS root FROM chain GROUP BY word) c ON f.word = c.word
"""
