"""Every dealt operator against a plain version, and on odd and empty tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from burnish.llm import common, encoding, language, licenses, mixing, mtree, packing, passages, quality, simhash, toxicity, warc
from burnish.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_large_ids_beside_nulls(spark):
    big = (1 << 60) + 1
    frame = spark.createDataFrame([(big, "a b c"), (None, None)], "doc_id long, text string")
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    for made in (packing.packed(frame), licenses.licensed(frame), toxicity.scores(frame, nothing), simhash.near_duplicates(frame)):
        assert {r.doc_id for r in made.collect()} == {big, None}
    pages = frame.selectExpr("doc_id AS page_id", "text AS url", "text AS html")
    assert {r.page_id for r in warc.archived(pages).collect()} == {big, None}


def documents(n=None):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return rows[:n]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def found(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


# -- shared helpers


def test_words_and_hashes(monkeypatch):
    text = "Ab c D\x0b\x1fE f ab\nÉx éx  "
    assert [w.decode() for w in common.words(text)] == WORD.findall(text)
    a = common.word_hashes("Ab ab x AB Éx éx")
    assert a[0] == a[1] == a[3] != a[2] and a[4] != a[5]
    assert len(set(common.word_hashes("Ab ab", lower=False).tolist())) == 2
    long = " ".join(d["text"] for d in documents(40))
    whole = common.word_hashes(long)
    monkeypatch.setattr(common, "CHUNK", 97)
    assert (common.word_hashes(long) == whole).all() and len(whole) == len(WORD.findall(long))


def test_components(spark):
    draw = random.Random(3)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame([*pairs, (None, 5)], "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 quality


def plain_statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, dups = set(), 0
    for line in lines:
        dups += line in seen
        seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(inside)


def test_statistics():
    texts = [d["text"] for d in documents()] + [None, "", "a\na\n\na b a b a b\r", "é # é # é #"]
    for text in texts:
        assert quality.statistics(text)[:5] == plain_statistics(text)


def test_mcd_finds_planted_outliers(spark):
    draw = np.random.default_rng(1)
    good = draw.normal([1.6, 0, 0, 0, 0.3, 4], [0.1, 0.02, 0.02, 0.02, 0.1, 0.5], (400, 6))
    bad = draw.normal([1.6, 0.9, 0, 0.9, 0.9, 1], 0.05, (90, 6))
    rows = [("g", 490, i, np.round(v * quality.UNIT).astype(int).tolist()) for i, v in enumerate(np.concatenate((good, bad)))]
    frame = spark.createDataFrame(rows, "g string, g_rows long, key long, x array<long>")
    made = quality.estimates(frame).first()
    distance = quality._distance(np.array([r[3] for r in rows], float), np.array(made.model)) / made.scale
    assert (distance[:400] < 60).all() and (distance[400:] > quality.CUTOFF).all()
    # a determinant no larger than that of any plain run of concentration steps from random starts
    x = np.array([r[3] for r in rows], float)
    best = math.inf
    for _ in range(20):
        own = draw.choice(len(x), 12, replace=False)
        for _ in range(15):
            scatter = np.cov(x[own].T, bias=True) + np.diag(quality.FLOORS**2)
            away = x - x[own].mean(0)
            own = np.argsort(np.einsum("ni,ij,nj->n", away, np.linalg.inv(scatter), away))[: math.ceil(0.75 * len(x))]
        best = min(best, np.linalg.slogdet(np.cov(x[own].T, bias=True) + np.diag(quality.FLOORS**2))[1])
    assert made.model[-1] <= best + 0.1


def test_quality_odd(odd, empty):
    rows = quality.judged(odd).collect()
    assert len(rows) == 10 and quality.judged(empty).count() == 0
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)


def test_estimates_of_groups_that_cycle_stop(spark):
    """Steps end for every group, also where binned distances never settle; the least determinant is kept."""
    draw = np.random.default_rng(8)
    rows = []
    for g in range(12):
        x = np.round(draw.normal([1.6, 0, 0, 0, 0.3, 4], draw.uniform(0.01, 1.2, 6), (60 + 40 * g, 6)) * quality.UNIT).astype(int)
        rows += [(f"g{g}", len(x), i, v.tolist()) for i, v in enumerate(x)]
    made = quality.estimates(spark.createDataFrame(rows, "g string, g_rows long, key long, x array<long>")).collect()
    assert len(made) == 12 and all(np.isfinite(r.model).all() and r.scale > 0 for r in made)


def test_verdicts_are_those_of_a_plain_estimate(spark):
    """Kept and rejected by exact concentration steps over all rows of a group, from many random starts."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("etaoinshrdlu", k=draw.randrange(2, 9)))
    line = lambda: " ".join(word() for _ in range(draw.randrange(8, 14))).capitalize() + "."
    junk = [lambda: "# $$ %% || " * 3 + line(), lambda: line().upper() + " <&> *** ### ", lambda: "a b c $ " * 2 + line()]
    texts = ["\n".join(line() for _ in range(draw.randrange(8, 20))) for _ in range(300)]
    texts += ["\n".join(draw.choice(junk)() for _ in range(14)) for _ in range(40)] + ["too short", None]
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = found(quality.judged(frame))
    vectors = frame.withColumn("s", quality._statistics("text")).select("doc_id", quality.vector().alias("x")).collect()
    use = [r.doc_id for r in vectors if not got[r.doc_id]["base_failed"]]
    x = np.array([r.x for r in vectors if not got[r.doc_id]["base_failed"]], dtype=float)
    best, centre, inverse = math.inf, None, None
    numbers = np.random.default_rng(3)
    for _ in range(60):
        own = numbers.choice(len(x), 10, replace=False)
        for _ in range(30):
            scatter = np.cov(x[own].T, bias=True) + np.diag(quality.FLOORS**2)
            away = x - x[own].mean(0)
            squared = np.einsum("ni,ij,nj->n", away, np.linalg.inv(scatter), away)
            own = np.argsort(squared)[: math.ceil(quality.HELD * len(x))]
        scatter = np.cov(x[own].T, bias=True) + np.diag(quality.FLOORS**2)
        if np.linalg.slogdet(scatter)[1] < best:
            best, centre, inverse = np.linalg.slogdet(scatter)[1], x[own].mean(0), np.linalg.inv(scatter)
    away = x - centre
    squared = np.einsum("ni,ij,nj->n", away, inverse, away)
    squared *= quality.chi_square(0.5) / np.median(squared)
    sure = [(i, d <= quality.CUTOFF) for i, d in zip(use, squared, strict=True) if not 0.8 < d / quality.CUTOFF < 1.25]
    assert len(sure) > 0.9 * len(use) and {k for _, k in sure} == {True, False}
    assert [got[i]["kept"] for i, _ in sure] == [k for _, k in sure]
    assert not got[len(texts) - 1]["kept"] and not got[len(texts) - 2]["kept"]


# -- 2 language


def test_language_is_the_smallest_by_hand(spark, docs):
    """Every text compressed with each learned dictionary, one by one: the smallest wins, narrow margins reject."""
    dictionaries = language.learn(docs)
    rows = found(language.languages(docs))
    for d in documents(120):
        letters = any(c.isalpha() for c in d["text"] or "")
        by = {}
        for lang, content in dictionaries.items():
            encoder = language.compressors({lang: content})[0]
            data = (d["text"] or "").lower().encode()
            by[lang] = sum(len(encoder.compress(data[i : i + language.BLOCK])) for i in range(0, len(data), language.BLOCK))
        order = sorted(by.values())
        got = rows[d["doc_id"]]
        if not letters:
            assert (got["lang_pred"], got["rejected"]) == ("und", True)
            continue
        assert by[got["lang_pred"]] == order[0]
        assert got["rejected"] == (order[1] - order[0] < max(1, language.NARROW * order[1]))


def test_language(spark, docs, odd, empty):
    rows = found(language.languages(docs))
    truth = {d["doc_id"]: d["lang"] for d in documents()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [i for i, r in rows.items() if r["held_out"]]
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    strange = language.languages(odd).collect()
    assert len(strange) == 10 and {r.lang_pred for r in strange if r.doc_id in (2, 3, 4, 6)} == {"und"}
    assert language.languages(empty).count() == 0
    assert language.with_known_language(odd).columns == odd.columns


# -- 3 toxicity


def test_network_gradients():
    network = toxicity.Network.start([{b"ab", b"cde", b"fgh"}] * 8)
    network.weights = {k: (v.astype(np.float64) if k in ("words", "grams") else v.astype(np.float64) + 0.05) for k, v in network.weights.items()}
    inputs = np.random.default_rng(0).standard_normal((3, toxicity.INPUT))
    at = np.array([[0, 1, 2, 1], [2, 0, -1, -1]])
    weigh = np.array([1.0, -2.0])
    _, saved = network.forward(network.gates(inputs), at, keep=True)
    grads, d_inputs = network.backward(inputs, at, saved, weigh)
    for name in ("Wf", "Ub", "cb", "A", "a", "o", "Uf"):
        for spot in list(np.ndindex(network.weights[name].shape))[::7]:
            w, e = network.weights[name], 1e-3
            w[spot] += e
            up = network.forward(network.gates(inputs), at) @ weigh
            w[spot] -= 2 * e
            down = network.forward(network.gates(inputs), at) @ weigh
            w[spot] += e
            assert abs((up - down) / (2 * e) - grads[name][spot]) < 2e-3, (name, spot)
    assert d_inputs.shape == inputs.shape


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        starts = toxicity.window_starts(n)
        assert {i for s in starts for i in range(s, min(s + toxicity.WINDOW, n))} == set(range(n))


def test_windows_hold_phrases_whole():
    for n in (17, 31, 33, 48, 57, 100, 1000):
        starts = toxicity.window_starts(n)
        assert all(any(s <= i and i + 17 <= s + toxicity.WINDOW for s in starts) for i in range(n - 16))


def plain_height(network, text):
    """The highest window of a text, one window, word and n-gram at a time."""
    w, sigmoid = network.weights, lambda x: 1 / (1 + np.exp(-x))
    words = [x.encode() for x in re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]", " ", text.lower()).split()]
    rows = {int(k): i for i, k in enumerate(network.gram_keys, 1)}

    def vector(word):
        marked = b"^" + word + b"$"
        grams = [rows.get(int.from_bytes(marked[i : i + n], "little") | n << 56, 0) for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]
        return w["words"][network.word_rows.get(word, 0)] + np.mean([w["grams"][g] for g in grams], axis=0)

    def states(vectors, way):
        h, size, out = np.zeros(toxicity.HIDDEN), toxicity.HIDDEN, []
        for x in vectors:
            gate, inner = x @ w["W" + way] + w["c" + way], h @ w["U" + way]
            z, r = sigmoid(gate[:size] + inner[:size]), sigmoid(gate[size : 2 * size] + inner[size : 2 * size])
            h = z * h + (1 - z) * np.tanh(gate[2 * size :] + r * inner[2 * size :])
            out.append(h)
        return out

    heights = []
    for start in sorted({*range(0, max(len(words) - 32, 0), 16), max(len(words) - 32, 0)}):
        vectors = [vector(x) for x in words[start : start + 32]]
        both = [np.concatenate(pair) for pair in zip(states(vectors, "f"), states(vectors[::-1], "b")[::-1], strict=True)]
        weigh = np.array([np.exp(np.tanh(s @ w["A"]) @ w["a"]) for s in both])
        context = sum((x * s for x, s in zip(weigh / weigh.sum(), both, strict=True)), np.zeros(2 * toxicity.HIDDEN)) if both else np.zeros(2 * toxicity.HIDDEN)
        heights.append(float(context @ w["o"] + w["q"][0]))
    return max(heights), len(heights)


def test_whole_scores_against_a_plain_network(docs):
    network = toxicity.Network.start([set(toxicity.tokens(d["text"])) for d in documents(60)])
    draw = np.random.default_rng(4)
    network.weights = {k: (v + 0.3 * draw.standard_normal(v.shape)).astype(np.float32) for k, v in network.weights.items()}
    network.scale, network.shift, network.spread = 0.7, -0.2, 0.9
    texts = [d["text"] or "" for d in documents(25)] + ["", "one", " ".join(f"wort{i % 91}" for i in range(700)), "\u00c9t\u00e9 l\u2019\u00e9t\u00e9!"]
    plain = [plain_height(network, t) for t in texts]
    made = next(toxicity._scored(network)(iter([pd.DataFrame({"doc_id": range(len(texts)), "held_out": False, "text": texts})])))
    expected = [1 / (1 + math.exp(-(0.7 * (h - 0.9 * math.log(n)) - 0.2))) for h, n in plain]
    assert np.allclose(made["score"], expected, atol=1e-4) and max(n for _, n in plain) > 40


def test_heights_of_many_clean_windows_are_no_evidence():
    draw = np.random.default_rng(9)
    windows = np.array([1, 3, 10, 30, 100, 300] * 200)
    clean = np.array([draw.exponential(1.3, n).max() for n in windows])
    assert abs(toxicity.gumbel_spread(clean, windows) - 1.3) < 0.15
    toxic = 9 + draw.exponential(1.3, 400)
    network = toxicity.Network.start([])
    rows = [(0, h, n) for h, n in zip(clean, windows, strict=True)] + [(1, h + 1.3 * math.log(n), n) for h, n in zip(toxic, windows[:400], strict=True)]
    toxicity.calibrate(network, pd.DataFrame(rows, columns=["toxic", "highest", "windows"]))
    level = network.score(np.array([3 * 1.3]), np.array([1.0]))[0]
    for n in (1, 10, 300):  # that high by chance: 0.05, whatever the number of windows
        of_n = clean[windows == n]
        assert abs((network.score(of_n, np.full(len(of_n), n)) >= level).mean() - 0.05) < 0.05
    assert (network.score(clean[windows == 300], np.ones(200)) >= level).mean() > 0.9  # if not corrected
    assert toxicity.gumbel_spread(np.array([1.0]), np.array([1.0])) == 0


def test_toxicity(spark, odd, empty, monkeypatch):
    draw = random.Random(5)
    plain = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(500):
        words = [draw.choice(plain) for _ in range(draw.randrange(5, 120))]
        if i % 4 == 0:
            words.insert(draw.randrange(len(words)), "nasty" + draw.choice(["er", "est", "ly", ""]))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.scores(frame.drop("toxic"), frame.drop("text")).toPandas().sort_values("doc_id")
    held = got[got.held_out]
    assert (held.predicted == (held.doc_id % 4 == 0)).mean() > 0.9
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scores(odd, nothing).count() == 10 and toxicity.scores(empty, nothing).count() == 0


# -- 4 simhash


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [words] if 0 < len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles if s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a[1] ^ prints[j][1]).bit_count() <= 2:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    smallest = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            smallest[root(i)] = min(doc_id, smallest.get(root(i), doc_id))
    return {doc_id: smallest.get(root(i)) for i, (doc_id, _) in enumerate(prints)}


def test_simhash(docs, odd, empty):
    prints = [(d["doc_id"], plain_fingerprint(d["text"])) for d in documents()]
    want, got = plain_components(prints), found(simhash.near_duplicates(docs))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", want[i]) for i, p in prints}
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.doc_id in (2, 3, 4) or r.fingerprint == "0" * 16} == {2}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 5, 6]


@pytest.mark.parametrize("most", [1, 64])
def test_links_of_crowded_and_spread_fingerprints(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_IN_KEY", most)
    draw = random.Random(most)
    prints = set()
    for _ in range(6):
        centre = draw.getrandbits(64)
        prints |= {centre ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(4))) for _ in range(40)}
    prints = [(i, p % (1 << 64)) for i, p in enumerate(sorted(prints))]
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in prints]
    links = simhash.linked(spark.createDataFrame(signed, "fp long, first_id long"))
    roots = {r.node: r.root for r in components(links).collect()}
    assert {i: roots.get(i, i) for i, _ in prints} == plain_components(prints)


# -- 5 packing


def test_plan_is_best_fit():
    draw = random.Random(9)
    lengths = [draw.choice([1, 2, 3, 5, 8, 13, 21, 34, 55, 64]) for _ in range(500)]
    rows = sorted(packing.plan(Counter(lengths), 64))
    room, seen = [], Counter()
    for n in sorted(lengths, reverse=True):  # one piece after the other
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(64 - n)
    placed = {}
    for n in lengths:
        row = [r for r in rows if r[0] == n and r[1] <= seen[n]][-1]
        nth = seen[n] - row[1]
        placed.setdefault(row[2] + nth // row[3], []).append((row[4] + nth % row[3] * n, n))
        seen[n] += 1
    assert len(placed) == len(room)
    for spans in placed.values():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at <= 64


def test_packing(docs, odd, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for frame, rows in ((docs, documents()), (odd, [r.asDict() for r in odd.collect()])):
        want = []
        for d in rows:
            ids = [*full.encode(d["text"] or "", add_special_tokens=False).ids, 2]
            first = len(ids) % 1024 or 1024
            cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                want.append((d["doc_id"], piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
        got = packing.packed(frame).collect()
        key = lambda x: [(-1 if v is None else v) for v in x]
        assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
        places = {}
        for r in got:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for spans in places.values():
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:], strict=False)) and min(spans)[0] == 0
            assert sum(n for _, n in spans) <= 1024
    assert packing.packed(empty).count() == 0


def test_both_encoders_agree():
    encoder, draw = encoding.Encoder(), random.Random(2)
    pool = [*map(chr, range(0x20, 0x7F)), *"\n\t\r\x0b\x00\x1c", *map(chr, range(0xA0, 0x250)), *"‐–—‘’“”…€", " ", "  ", "'s", "ing"]
    for _ in range(300):
        text = "".join(draw.choice(pool) for _ in range(60))
        assert encoding.PLAIN.fullmatch(text) and (encoder.ids(text) == encoder.full_ids(text)).all(), text
    assert encoder.ids("a <|endoftext|> b").tolist() == encoder.full_ids("a <|endoftext|> b").tolist()
    assert encoder.ids("日本 test").tolist() == encoder.full_ids("日本 test").tolist()


# -- 6 mixing


def test_targets_and_taken(spark, docs, odd, empty):
    rows = mixing.mixture(docs, keep=["doc_id", "source"]).select("row.*", "size", "source_size", "target", "taken").collect()
    sizes = {d["doc_id"]: len(WORD.findall(d["text"])) for d in documents()}
    assert {r.doc_id: r.size for r in rows} == sizes
    sources = sorted({r.source for r in rows})
    total = {s: sum(r.size for r in rows if r.source == s) for s in sources}
    left, share, weight = float(sum(total.values())), dict.fromkeys(sources, 0.0), {s: 1 + i % 3 for i, s in enumerate(sources)}
    free = set(sources)
    while left > 1e-6 and free:
        by, over = left / sum(weight[s] for s in free), 0.0
        for s in list(free):
            share[s] += by * weight[s]
            if share[s] > 3 * total[s]:
                over += share[s] - 3 * total[s]
                share[s] = 3 * total[s]
                free.discard(s)
        left = over
    for r in rows:
        assert r.target == pytest.approx(share[r.source]) and r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
    for s in sources:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - share[s]) <= max(r.size for r in mine) / 2 + 1
    again = mixing.mixture(docs.repartition(7), keep=["doc_id"]).select("row.doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in rows}
    assert mixing.mixture(odd).count() == 10 and mixing.mixture(empty).count() == 0


# -- 7 licences


def test_licenses(spark, docs, odd, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    extra = [
        (9001, "x Mit  License mit license. general public-license GENERAL PUBLIC LICENSE apache license"),
        (9002, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
        (9003, "foo bar. Licensed under CC BY-NC 4.0. baz"),
    ]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = found(licenses.licensed(frame))
    for doc_id, text in [(d["doc_id"], d["text"]) for d in documents()] + extra:
        words, places, labels = word.findall(lower(text)), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[doc_id]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert got[9002]["labels"] == "mit" and got[9003]["labels"] == "cc-by-nc" and got[9002]["base_labels"] == ""
    assert licenses.licensed(odd).count() == 10 and licenses.licensed(empty).count() == 0


def aligned(words, idf):
    """Labels of templates that stand anywhere, and the best share: every template at every shift, without an index."""
    line, labels, best = b" " + b" ".join(words) + b" ", set(), 0.0
    for label, text, phrases in licenses.TEMPLATES:
        template = licenses.license_words(text)
        keys = [b" ".join(licenses.license_words(p)) for p in phrases]
        if not all(b" " + k + b" " in line for k in keys):
            continue
        for shift in range(-len(template), len(words) + 1):
            near = b" " + b" ".join(words[max(0, shift - licenses.DRIFT) : max(0, shift + len(template) + licenses.DRIFT)])
            if not all(b" " + k in near + b" " for k in keys):
                continue
            weight = hit = 0.0
            for i, w in enumerate(template):
                weight += idf[w] + 0.1
                around = {words[k] for k in range(shift + i - 2, shift + i + 3) if 0 <= k < len(words)}
                hit += (idf[w] + 0.1) * (w in around)
            if hit / weight >= licenses.LEAST_COVERED:
                labels.add(label)
                best = max(best, hit / weight)
    return labels, best


def test_license_labels_against_an_aligner(spark, docs):
    draw = random.Random(3)
    plain = "the of and to in this is a software copy use with for any notice terms work".split()
    rows = [(d["doc_id"], d["text"]) for d in documents(60)]
    parts = [text for _, text, _ in licenses.TEMPLATES]
    for i in range(120):
        pieces = []
        for text in draw.sample(parts, draw.choice([0, 1, 1, 2, 3])):
            words = text.split()
            for _ in range(draw.choice([0, 0, 1, 3, 6])):  # edits
                at = draw.randrange(len(words))
                words[at : at + draw.choice([0, 1])] = draw.choice([[], [draw.choice(plain)]])
                words = words or ["x"]
            pieces += [draw.choice(plain) for _ in range(draw.randrange(0, 30))] + words
        rows.append((10_000 + i, " ".join(pieces + draw.choices(plain, k=draw.randrange(0, 40)))))
    whole = "\n\n".join(text for label, text, _ in licenses.TEMPLATES if label.startswith("bsd"))
    rows.append((20_000, f"Copyright (c) 2020, Somebody\n\n{whole}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got, idf = found(licenses.licensed(frame)), licenses.weights(frame)
    for doc_id, text in rows:
        labels, best = aligned(licenses.license_words(text), idf)
        r = got[doc_id]
        base = {x for x in r["base_labels"].split(",") if x}
        assert r["labels"] == ",".join(sorted(base | labels)), (doc_id, text)
        assert abs(r["score"] - max(best, licenses.BASE_SCORE if base else 0)) < 0.2
    assert got[20_000]["labels"] == "bsd,bsd-3-clause"


# -- 8 top-k


def test_top_k_of_repeated_ids(spark):
    """Every row is a candidate and a query by itself, also where ids repeat."""
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [5.0, 0.0]), (2, [3.0, 0.0]), (0, [0.0, 1.0]), (1, [5.0, 0.0])]
    got = [tuple(r) for r in mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).orderBy("rank").collect()]
    unit = 1024 * 1024
    assert got == [(0, 1, 1, 5 * unit), (0, 2, 1, 5 * unit), (0, 3, 2, 3 * unit), (0, 4, 1, unit)]


def _plain_top_k(valid, k=10):
    want = set()
    for q in (i for i in valid if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(valid[q], v, strict=False)), i) for i, v in valid.items() if i != q)
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)}
    return want


def test_top_k(spark):
    draw = np.random.default_rng(4)
    base = draw.standard_normal((700, 6)).round(2)
    base[100:400] = base[100]  # copies, so ties
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(700, None), (800, [1.0, None, 0.0]), (900, [float("nan")] * 6), (1000, [float("inf")] * 6), (1100, []), (1200, [3.0]), (None, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    valid = {i: [math.floor(1024 * x) for x in v] for i, v in rows[:700]} | {1100: [], 1200: [3072]}
    assert {tuple(r) for r in mtree.top_k(frame).collect()} == _plain_top_k(valid)
    assert mtree.top_k(frame.where("vec_id < 0")).count() == 0 and mtree.top_k(frame.where("vec_id = 0")).count() == 0


def test_top_k_over_cells_of_cells(spark, monkeypatch):
    """Small pages, so that cells are split twice and copies by hash, over several nodes, lanes and blocks."""
    monkeypatch.setattr(mtree, "PAGE_ROWS", 16)
    monkeypatch.setattr(mtree, "QUERIES", 4)
    monkeypatch.setattr(mtree, "SPLIT_ROWS", 100)
    draw = np.random.default_rng(5)
    base = draw.standard_normal((3000, 4)).round(2) + 6 * draw.integers(0, 3, (3000, 1))
    base[::3] = base[0]  # a third are copies
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    pages = mtree._pages(mtree.integers(frame, "vec_id", "embedding").withColumn("row", F.col("vec_id")), 4).select("cell", "ids").collect()
    assert sorted(i for p in pages for i in p["ids"]) == list(range(3000))
    assert max(len(p["ids"]) for p in pages) < 64 and max(p["cell"] for p in pages) >= mtree.PIVOTS**2
    assert {tuple(r) for r in mtree.top_k(frame).collect()} == _plain_top_k({i: [math.floor(1024 * x) for x in v] for i, v in enumerate(base)})


def test_top_k_of_empty_vectors_and_clashing_names(spark):
    """Only empty vectors: all scores are 0 and ids decide. Further columns of any name are ignored."""
    frame = spark.createDataFrame([(i, [], i, "x", 1) for i in (0, 5, 3, 100)], "vec_id long, embedding array<float>, row long, page string, cell int")
    assert {tuple(r) for r in mtree.top_k(frame, k=2).collect()} == {(0, 1, 3, 0), (0, 2, 5, 0), (100, 1, 0, 0), (100, 2, 3, 0)}


def test_limits_of_nodes_hold():
    """No bound lies below a score, and each member of a leaf is within its radius."""
    draw = np.random.default_rng(6)
    v = draw.integers(-900, 900, (300, 5)).astype(float)
    balls = np.abs(draw.integers(0, 200, 300)).astype(float)
    inside = v[:, None] + draw.uniform(-1, 1, (300, 20, 5)) * balls[:, None, None] / np.sqrt(5)
    tops = np.maximum((inside**2).sum(2).max(1), (v * v).sum(1))
    order, stored = mtree._node(v, balls, tops)
    node = mtree._Node(pd.Series(stored), 5)
    queries = draw.integers(-900, 900, (40, 5)).astype(float)
    best = np.einsum("qd,nmd->qnm", queries, inside[order]).max(2)
    assert (node.member_limits(queries, np.full(40, -np.inf)) >= best).all()
    least = np.sort(best, axis=1)[:, -10]
    limits = node.member_limits(queries, least)
    assert (limits[best >= least[:, None]] > -np.inf).all() and (limits == -np.inf).mean() > 0.3


# -- 9 WARC


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 700)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 1500)
    body = "é" * 50
    rows = [(i, f"http://x/{i} \r\ny", body if i % 3 else f"<p>{i}</p>" * i) for i in range(40)]
    rows += [(50, None, None), (51, "u", ""), (None, "u", body), (52, "u", "x" * 300_000), (1, "again", body)]
    path = str(tmp_path / "out")
    warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path)
    index = warc.read_index(spark, path).collect()
    assert len(index) == len(rows)
    bundles = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()}
    assert len(bundles) > 1
    for r in index:  # each record by its place alone
        data = bundles[r.bundle]
        plain = warc.frame(data, warc.seek_table(data)[r.frame])
        fields, block, end = warc.parsed(plain, r.frame_offset)
        assert end - r.frame_offset == r.record_bytes and fields["WARC-Type"] == r.record_type
        html = next(h for i, _, h in rows if i == r.page_id)
        payload = (html or "").encode()
        assert r.payload_bytes == len(payload)
        copy = payload == body.encode() and r.page_id != 1
        assert (r.record_type, r.refers_to) == (("revisit", 1) if copy else ("response", None))
        if not copy:
            assert block.endswith(b"\r\n\r\n" + payload)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(none).count() == 0


# -- 10 passages


def test_compact_windows_group_all_subsequences():
    draw = np.random.default_rng(6)
    hashes = draw.integers(0, 40, 60).astype(np.uint64)
    windows = passages.compact_windows(hashes, 5)
    for i in range(60):
        for j in range(i + 4, 60):
            inside = [w for w in windows if w[0] <= i <= w[1] <= j <= w[2]]
            assert len(inside) == 1 and hashes[inside[0][1]] == hashes[i : j + 1].min()
    assert set(passages.sliding_minima(hashes, 5).tolist()) == {int(hashes[c]) for _, c, _ in windows}


def test_passages(spark, odd, empty):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(7))
    passage, short = [word() for _ in range(56)], [word() for _ in range(30)]
    changed = passage[:28] + ["changed"] + passage[29:]
    rows = []
    for i in range(40):
        middle = passage if i in (3, 8, 20) else changed if i == 30 else short if i % 2 else []
        rows.append((i, " ".join([word() for _ in range(80)] + middle + [word() for _ in range(80)])))
    frame = spark.createDataFrame([*rows, (None, " ".join(passage))], "doc_id long, text string")
    got = found(passages.repeated_passages(frame))
    assert set(got) == {3, 8, 20, 30}
    assert all((r["start_word"], r["n_words"], r["class_id"]) == (80, 56, 3) for r in got.values())
    assert got[3]["n_later"] == 0 and got[8]["n_later"] == 52 and got[30]["n_shared"] == 47
    cut = found(passages.without_repeats(frame.where("doc_id is not null")))
    for i, text in rows:
        words = text.split()
        want = words[:80] + words[136:] if i in (8, 20, 30) else words
        assert cut[i]["text"].split() == want
    strange = passages.repeated_passages(odd).collect()
    assert {(r.doc_id, r.class_id) for r in strange} == {(5, 5), (7, 5)}
    assert passages.repeated_passages(empty).count() == 0
    kept = passages.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == 10


def test_stretches_are_all_that_are_similar():
    draw = np.random.default_rng(12)
    for _ in range(600):
        n, least = int(draw.integers(0, 36)), int(draw.integers(1, 12))
        shared = draw.random(n) < draw.choice([0.3, 0.6, 0.75, 0.8, 0.9])
        valid = [
            (a, b) for a in range(n) for b in range(a + least, n + 1)
            if shared[a] and shared[b - 1] and 5 * int(shared[a:b].sum()) >= 4 * (b - a)
        ]
        want = [(a, b) for a, b in valid if not any((c, d) != (a, b) and c <= a and b <= d for c, d in valid)]
        assert passages.similar_stretches(shared, least) == want


def test_one_long_edit_keeps_the_passage(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(7))
    passage = [word() for _ in range(105)]
    changed = passage[:49] + [word() for _ in range(7)] + passage[56:]
    around = [[word() for _ in range(80)] for _ in range(4)]
    rows = [(1, " ".join(around[0] + passage + around[1])), (2, " ".join(around[2] + changed + around[3]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.repeated_passages(frame).collect()
    assert {(r.doc_id, r.start_word, r.n_words, r.n_shared, r.class_id) for r in got} == {(1, 80, 105, 90, 1), (2, 80, 105, 90, 1)}
    cut = found(passages.without_repeats(frame))
    assert cut[1]["text"] == rows[0][1] and cut[2]["text"].split() == around[2] + around[3]


def test_thousands_of_templated_lines(spark):
    assert passages.similar_stretches(np.tile([True] * 6 + [False] * 5, 5000), 46) == []
    rows = [(i, "\n".join(f"a b c d e f g h i j value{i}x{n}" for n in range(5000))) for i in (1, 2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert passages.repeated_passages(frame).count() == 0
    assert {r.text for r in passages.without_repeats(frame).collect()} == {text for _, text in rows}


def test_cut_keeps_the_rest():
    assert passages._cut(" a  b\nc d ", [(1, 3)]) == " a  d "
    assert passages._cut("a b c", [(0, 3)]) == ""
