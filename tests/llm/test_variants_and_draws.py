"""Spelling variants, importance resampling and SimHash near-duplicates against brute force, and their odd cases."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from itertools import combinations
from zlib import crc32

import numpy as np
import pytest
import xxhash

from quadrat.llm import importance_resampling, simhash_anchors, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(rows):
    """The smallest id of each component of rows (id, fingerprint)."""
    known = sorted({f for _, f in rows})
    root = {f: f for f in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(known, 2):
        if (a ^ b).bit_count() <= 4 and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    first = {}
    for i, f in rows:
        if i is not None:
            first[find(f)] = min(i, first.get(find(f), i))
    return {f: first.get(find(f)) for f in known}


def test_simhash(spark, docs, texts, empty):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    want = smallest(rows)
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_anchors.simhash_components(docs).collect())
    assert got == sorted((i, f"{f:016x}", want[f]) for i, f in rows)
    assert simhash_anchors.simhash_components(empty).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "one two"), (5, ""), (3, "one two"), (None, "alone")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in simhash_anchors.simhash_components(nulls).collect()} == {(None, 5), (None, 3), (5, 5), (3, 3), (None, None)}


def clusters(seed, n=60, spread=9):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, spread)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("layout", "most"), [("thirds", 1 << 17), ("halves", 1 << 17), ("thirds", 3)])
def test_no_link_is_missed(spark, layout, most):
    """All layouts, and anchors of more residents than a task holds, unite what all pairs unite."""
    points = clusters(7)
    links = simhash_anchors.near_links(spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in points], "f long"), layout, most=most).collect()
    found = [(x & (1 << 64) - 1, y & (1 << 64) - 1) for x, y in links]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    want = smallest([(x, x) for x in points])
    root = {x: x for x in points}
    for _ in points:
        before = dict(root)
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    assert root == want and len(set(want.values())) < len(points)


def test_anchors_cover_and_meet():
    """Every word has its home within one bit, and two words within d bits meet at the home of each."""
    rng = random.Random(3)
    for code, free in ((7, 2), (15, 6), (31, 1)):
        for d in (1, 2):
            table = simhash_anchors.visits(code, free, d)
            rows = simhash_anchors.parity_rows(code)
            syndrome = lambda x, rows=rows: sum(((x & m).bit_count() & 1) << j for j, m in enumerate(rows))
            for _ in range(300):
                x = rng.getrandbits(code + free)
                y = x
                for b in rng.sample(range(code + free), rng.randint(0, d)):
                    y ^= 1 << b
                anchors = [x ^ e for e in table[syndrome(x)]]
                assert all(syndrome(a) == 0 and (a ^ x).bit_count() <= 1 + d for a in anchors) and len(set(anchors)) == len(anchors)
                assert (anchors[0] ^ x).bit_count() <= 1 and y ^ table[syndrome(y)][0] in anchors


def plain_draw(docs, target, percent=5):
    grams = lambda t: (w := re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) and [" ".join(w[k : k + r]) for r in (1, 2, 3) for k in range(len(w) - r + 1)]
    bucket = lambda t: Counter(crc32(g.encode()) % 10000 for g in grams(t))
    own = [bucket(t) for _, t in docs]
    s, t = sum(own, Counter()), sum((bucket(x) for x in target), Counter())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    rows = []
    for (i, text), c in zip(docs, own, strict=True):
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain(b) for b, n in c.items())
        n_words = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)))
        rows.append([i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    long_ = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(long_[: percent * len(long_) // 100])}
    return [(*r[:4], drawn.get(id(r))) for r in rows]


ORDER = lambda r: tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_resampling(spark, docs, texts, empty, percent):
    target = [texts[10], texts[20], None, ""]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = importance_resampling.resample(docs.withColumnRenamed("i", "block").withColumnRenamed("t", "place"), aim, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain_draw([(r["doc_id"], r["text"]) for r in docs.collect()], target, percent)
    assert sorted(map(tuple, got.collect()), key=ORDER) == sorted(want, key=ORDER)


def test_resampling_of_odd_tables(spark, docs, empty):
    aim = spark.createDataFrame([("some text",)], "text string")
    assert importance_resampling.resample(empty, aim).count() == 0
    rows = [(None, None), (None, "alpha beta " * 300), (7, ""), (7, "gamma " * 25), (9, "delta\x00Epsilon " * 12)]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    for target in (aim, empty.select("text")):
        got = importance_resampling.resample(few, target, percent=50).collect()
        assert sorted(map(tuple, got), key=ORDER) == sorted(plain_draw(rows, [r[0] for r in target.collect()], 50), key=ORDER)


def test_counts_beyond_a_byte_and_long_texts():
    text = "word " * 700 + "Other-words " * 3
    counts, n = importance_resampling.bucket_counts(text)
    assert n == 706 and counts.max() >= 698
    block = np.stack([counts, np.zeros_like(counts), counts * 2])
    gains = np.arange(10000) - 5000
    total = np.zeros(256, np.int64)
    for _, part, *rest in importance_resampling.posting_rows(0, block, 250):
        total += importance_resampling.contribution(*rest, gains[part * 250 : part * 250 + 250])
    assert total[:3].tolist() == (block @ gains).tolist() and not total[3:].any()
    small = [x for words, known in importance_resampling.word_pieces(text.encode().replace(b"-", b" "), 2, 40) for x in words[known:]]
    assert small == text.encode().replace(b"-", b" ").split()


def plain_variants(rows, noise=199):
    total = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = crc32(f"{'' if i is None else i}:{w}".encode())
            total[w[: h % len(w)] + w[h % len(w) + 1 :] if h % noise == 0 else w] += 1
    words = {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    by = {w: [u for u in words if near(w, u)] for w in words}
    form = {}
    for w, us in by.items():
        best = min(us, key=lambda u: (-words[u], u), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(by[w]), words[form[w]] if form[w] else None) for w, n in words.items()), key=lambda r: r[0])


@pytest.fixture(scope="module")
def spelled():
    """Families of words one and more edits apart, with repeated letters, other letters, and counts on both sides of the limits."""
    rng = random.Random(11)
    alphabet = "abcllnnéÿ"
    words = []
    for _ in range(25):
        base = "".join(rng.choices(alphabet, k=rng.randint(6, 9)))
        words += [base] * rng.choice([5, 60, 400])
        for _ in range(12):
            x, k = base, rng.randrange(len(base))
            kind = rng.randrange(3)
            x = x[:k] + ("" if kind == 0 else rng.choice(alphabet)) + x[k + (kind < 2) :]
            words += [x.upper() if rng.random() < 0.2 and x.isascii() else x] * rng.choice([4, 5, 25])
    words += ["prefixed" + x for x in "abcdefg" for _ in range(9)] + ["x" * 3000] * 7 + ["x" * 2999] * 5 + ["chained"] * 400 + ["chaines"] * 40 + ["chaixes"] * 6
    rng.shuffle(words)
    return [(k, " ".join(words[k::40]) + [".", "\n", "1", "ß÷×"][k % 4]) for k in range(40)] + [(None, "loosely " * 9), (3, None), (3, ""), (3, "loosel " * 5)]


@pytest.mark.parametrize(("group", "shard"), [(1 << 14, 1 << 16), (4, 50)])
def test_variants(spark, spelled, group, shard):
    """Also with windows parted to single places, and words over many shards."""
    docs = spark.createDataFrame([(*r, "x", 1) for r in spelled], "doc_id long, text string, w string, n int").repartition(3)
    got = spelling_variants.variants(docs, group=group, shard=shard)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(spelled)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    assert any(r[2] not in (r[0], r[1]) for r in want)  # a path of two forms


def test_variants_with_much_noise(spark, spelled):
    docs = spark.createDataFrame(spelled, "doc_id long, text string")
    got = spelling_variants.variants(docs, noise=3)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == plain_variants(spelled, 3)


def test_variants_of_nothing(spark, empty):
    assert spelling_variants.variants(empty).count() == 0


def test_rectangles_of_a_wavelet_tree():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 64, 300):
        values = rng.permutation(n)
        tree = spelling_variants.WaveletTree(values)
        left, low = rng.integers(0, n + 1, 40), rng.integers(0, n + 1, 40)
        right, high = rng.integers(left, n + 1), rng.integers(low, n + 1)
        got = sorted(zip(*(x.tolist() for x in tree.report(left, right, low, high)), strict=True))
        assert got == sorted((k, v) for k in range(40) for v in values[left[k] : right[k]].tolist() if low[k] <= v < high[k])


def test_no_setting_of_the_session_changes(spark, docs):
    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(n, None) for n in names]
    simhash_anchors.simhash_components(docs).count()
    assert [spark.conf.get(n, None) for n in names] == before
