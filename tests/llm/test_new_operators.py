"""Operators 11 to 13 against plain versions, and on odd and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest

from burnish.llm import divergence, lines, spelling
from burnish.operators import lookup

WHITE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(params=[True, False], ids=["broadcast", "shuffle"])
def any_size(request, monkeypatch):
    """Both ways of every join whose table is broadcast only if it is small."""
    if not request.param:
        monkeypatch.setattr(lookup, "BROADCAST_BYTES", -1)


# -- 11 source divergence


def plain_divergences(rows, least, most=10):
    """Straight from the definition: rows of (text, lang, source)."""
    groups, documents = defaultdict(Counter), Counter()
    for text, lang, source in rows:
        text, lang, source = (x or "" for x in (text, lang, source))
        spaced = "".join(c if c in "abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in text.translate(LOWER))
        terms = [t for t in spaced.split(" ") if t]
        groups[lang, source].update(terms)
        documents.update((lang, t) for t in set(terms))
    found = set()
    for lang in {g[0] for g in groups}:
        sources = sorted(s for g, s in groups if g == lang)
        kept = sorted(t for g, t in documents if g == lang and documents[g, t] >= least)

        def shares(counts, kept=kept):
            whole = sum(counts[t] for t in kept) + 2 * len(kept)
            return [1 + 10**9 * (counts[t] + 2) // whole for t in kept]

        of_lang = shares(sum((groups[lang, s] for s in sources), Counter()))
        values = lambda p, q: [(a - b) ** 2 // (a + b) for a, b in zip(p, q, strict=True)]
        for s in sources:
            own = shares(groups[lang, s])
            pairs = [(-sum(values(own, shares(groups[lang, o]))), o.encode(), o) for o in sources if o != s]
            found |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)}
            high = [(-v, t.encode(), t) for t, v, p, q in zip(kept, values(own, of_lang), own, of_lang, strict=True) if groups[lang, s][t] and p > q]
            found |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(high)[:most], 1)}
    return found


def got_divergences(frame, **options):
    return {tuple(r) for r in divergence.divergences(frame, **options).select("lang", "source", "part", "item", "value", "rank").collect()}


def test_divergences(spark, monkeypatch):
    draw = random.Random(11)
    words = [f"w{''.join(draw.choices('abcd', k=3))}" for _ in range(60)] + ["É", "日本", "x" * 9]
    rows = [
        (" ".join(draw.choices(words, k=draw.randrange(40))) + draw.choice(["", "A1b-C", "\n\x00z"]), draw.choice(["en", "de", None, ""]), draw.choice([*"abcdefg", None]))
        for _ in range(300)
    ]
    rows += [(None, "fr", "only"), ("", "fr", "other"), ("alone", "it", "single")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert got_divergences(frame) == plain_divergences(rows, 10)
    monkeypatch.setattr(divergence, "LANE", 2)
    assert got_divergences(frame, least_documents=3) == plain_divergences(rows, 3)


def test_terms_of_chunks(monkeypatch):
    text = "Ab cé日 x1y  Zz" * 40
    whole = [t for part in divergence.term_lists(text) for t in part]
    monkeypatch.setattr(divergence, "CHUNK", 16)
    assert [t for part in divergence.term_lists(text) for t in part] == whole
    assert [t for part in divergence.term_lists("é" * 100) for t in part] == ["é".encode() * 100]


def test_counts_are_handed_on(spark, monkeypatch):
    rows = [(f"a b c{chr(97 + i % 9)} d", "en", f"s{i % 3}") for i in range(60)]
    monkeypatch.setattr(divergence, "ENTRIES", 4)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in ([r[1] for r in rows], [r[2] for r in rows], [r[0] for r in rows])], names=["lang", "source", "text"])
    made = list(divergence._count_terms(iter([batch])))
    sums = Counter()
    for part in made:
        for r in part.to_pylist():
            sums[r["source"], r["term"], "n"] += r["n"]
            sums[r["source"], r["term"], "docs"] += r["docs"]
    assert len(made) > 3 and sums["s0", "a", "n"] == sums["s0", "a", "docs"] == 20


def test_tree_shares_paths():
    """Each node is corrected once per ancestor: the sums are those of all rows by themselves."""
    draw = np.random.default_rng(5)
    z = draw.integers(1, 50, 8).tolist()
    rows = sorted({tuple((s, int(p)) for s, p in enumerate(draw.integers(0, 4, 8)) if p) for _ in range(200)})
    times = draw.integers(1, 9, len(rows))
    value = lambda p, q: (p - q) ** 2 // (p + q)
    want = Counter()
    for row, n in zip(rows, times.tolist(), strict=True):
        for i, (a, p) in enumerate(row):
            for b, q in row[i + 1 :]:
                want[a, b] += n * (value(p, q) - value(p, z[b]) - value(z[a], q) + value(z[a], z[b]))
    made = divergence.corrections([([s for s, _ in r], [p for _, p in r], [z[s] for s, _ in r]) for r in rows], times)
    assert made == dict(want)


def test_divergences_odd(odd, empty):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert got_divergences(odd, least_documents=2) == plain_divergences(rows, 2)
    assert got_divergences(empty) == set()


# -- 12 lines


def plain_lines(rows, least):
    key = lambda line: line.strip(WHITE).translate(LOWER)
    holders = defaultdict(set)
    for doc_id, text in rows:
        who = ("id", doc_id) if doc_id is not None else ("text", text)
        for line in (text or "").split("\n"):
            holders[key(line)].add(who)
    gone = {k for k, who in holders.items() if k and len(who) >= least}
    made = []
    for doc_id, text in rows:
        split = (text or "").split("\n")
        left = [line for line in split if key(line) not in gone]
        made.append((doc_id, "\n".join(left), len(split), len(split) - len(left)))
    return made


def got_lines(frame, **options):
    return [(r.row.doc_id, r.kept, r.n_lines, r.n_dropped) for r in lines.without_common_lines(frame, **options).collect()]


def test_lines(spark, any_size):
    draw = random.Random(12)
    common = ["Home | About", "ÀB", "ab", "  x\t", "", " ", "a "]
    rows = []
    for i in range(400):
        own = [draw.choice([*common, f"line {draw.randrange(120)}", f"own {i}"]) for _ in range(draw.randrange(12))]
        own = [draw.choice([x, x.upper() if x.isascii() else x, f" {x}\r", f"\x0b{x} "]) for x in own]
        rows.append((draw.choice([i, i, i, 7, None]), draw.choice(["\n".join(own), "\n".join(own) + "\n", None, ""])))
    rows += [(1000 + i % 3, "only thrice\nkept") for i in range(60)]  # sixty rows, three documents
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter(got_lines(frame))
    assert got == Counter(plain_lines(rows, 10)) and any("only thrice" in k[1] for k in got)


def test_line_hash_is_the_querys(spark):
    text = "A\nb"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    made = lines.without_common_lines(frame).selectExpr("sha2(kept, 256) AS h").first()
    assert made.h == hashlib.sha256(text.encode()).hexdigest()


def test_lines_odd(odd, empty, any_size):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for least in (1, 2, 10):
        assert Counter(got_lines(odd, least_documents=least)) == Counter(plain_lines(rows, least))
    made = lines.without_common_lines(odd)
    assert made.select("row.*").columns == odd.columns
    assert lines.without_common_lines(empty).count() == 0


# -- 13 spelling


def near(a, b):
    """By one code point: cut what both begin and end with."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def plain_groups(rows, least_length=6, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        spaced = "".join(c if c.isascii() and c.isalpha() or 0xC0 <= ord(c) <= 0xFF else " " for c in text or "")
        for run in spaced.translate(LOWER).split(" "):
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                at = h % len(run)
                counts[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    forms, many = {}, {}
    for w, n in words.items():
        around = sorted((-m, o) for o, m in words.items() if near(w, o))
        many[w] = len(around)
        forms[w] = around[0][1] if around and -around[0][0] >= 5 * n else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return {(w, forms[w], root(w), n, many[w], words.get(forms[w])) for w, n in words.items()}


def got_groups(frame, **options):
    rows = spelling.spelling_groups(frame, **options).collect()
    found = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def test_spelling(spark, any_size):
    draw = random.Random(13)
    rows = []
    stems = ["".join(draw.choices("abcdeéü", k=draw.randrange(5, 9))) for _ in range(25)] + ["aaaaaa", "ÉCOLES", "x" * 300]
    for i in range(500):
        words = []
        for _ in range(draw.randrange(30)):
            w = draw.choice(stems) if draw.random() < 0.8 else stems[0]
            if draw.random() < 0.25:
                at = draw.randrange(len(w))
                w = draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice("abxé") + w[at + 1 :], w[:at] + draw.choice("abx") + w[at:]])
            words.append(draw.choice([w, w.title(), w + "1", "日" + w]))
        rows.append((draw.choice([i, 3, None]), draw.choice([" ".join(words), "-".join(words), None])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups(rows)
    assert got_groups(frame) == want
    assert len(want) > 40 and any(f for _, f, *_ in want)


def test_chains_of_forms(spark):
    """Each word of a chain is five times as frequent as the one before; all have the last as root."""
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb"]
    rows = [(1, " ".join(w for i, w in enumerate(chain) for _ in range(6 * 5**i)))]
    found = {w: (f, r) for w, f, r, *_ in got_groups(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert all(found[w] == (o, chain[-1]) for w, o in pairwise(chain)) and found[chain[-1]] == (None, chain[-1])


def test_neighbourhoods_are_whole_and_unique():
    draw = np.random.default_rng(2)
    for length in (1, 2, 5):
        symbols = draw.integers(1, 3, (6, length)).astype(np.uint64)
        made = defaultdict(list)
        for rows, keys in spelling.neighbourhood(symbols):
            for i, k in zip(rows.tolist(), keys.tolist(), strict=True):
                made[i].append(k)
        key = lambda w: int(spelling.mixed((np.array(w, dtype=np.uint64) * spelling._powers(spelling._BASE, len(w))).sum(keepdims=True, dtype=np.uint64))[0])
        for i, row in enumerate(symbols.tolist()):
            around = {tuple(row)} | {tuple(row[:k] + row[k + 1 :]) for k in range(length)}
            for s in range(1, spelling.SYMBOLS + 1):
                around |= {tuple(row[:k] + [s] + row[k + 1 :]) for k in range(length)} | {tuple(row[:k] + [s] + row[k:]) for k in range(length + 1)}
            assert len(made[i]) == len(set(made[i])) == len(around)
            assert set(made[i]) == {key(list(w)) if w else 0 for w in around}


def test_spelling_odd(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got_groups(odd, least_length=4, least_count=1) == plain_groups(rows, 4, 1)
    assert got_groups(empty) == set()
