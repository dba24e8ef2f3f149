"""Operators that compare rows: brute-force versions, and the defined results of odd input."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import components, line_dedup, mixing, ngram_join, topk_search, warc


def closure(sets, percent):
    """The smallest member of each set's component, by comparing all that share a token."""
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    lists = defaultdict(list)
    for k in sorted(sets):
        for j, n in Counter(j for t in sets[k] for j in lists[t]).items():
            if 100 * n >= percent * (len(sets[k]) + len(sets[j]) - n):
                a, b = sorted((find(k), find(j)))
                root[b] = a
        for t in sets[k]:
            lists[t].append(k)
    return {k: find(k) for k in sets}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("longest", [48, 2])
def test_jaccard_components(docs, texts, empty, longest):
    got = {r["doc_id"]: r for r in ngram_join.jaccard_components(docs, longest=longest).collect()}
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    want = closure(sets, 90)
    for k in sets:
        assert (got[k]["n_shingles"], got[k]["component_id"]) == (len(sets[k]), want[k])
    assert len(set(want.values())) < len(want)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_frequent_tokens_take_the_long_way(spark, texts, monkeypatch):
    """A large group of near copies, all of whose tokens count as frequent from the start."""
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, len(w))] = f"x{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, longest=5).collect()}
    assert got == closure({k: shingles(t) for k, t in rows}, 90)


def test_divide_skip():
    assert ngram_join.heap_merge([[1, 3, 5], [1, 2, 5], [5]], 2) == [1, 5]
    for n in range(1, 200):
        t = -(-90 * n // 100)
        assert ngram_join.short_lists(n) == min(n, n - t + 2)
        assert all((190 * x >= 90 * (n + n)) == (x >= ngram_join.overlap_needed(n, n)) for x in range(n + 1))
    assert ngram_join.probe(np.array([1, 4, 9], np.uint64), np.array([2, 4, 8], np.uint64)) == 1


def test_long_texts_in_pieces(monkeypatch):
    import pyarrow as pa

    col = pa.array(["a b c d e", None, "", "größe " * 400 + "end", "x"])
    whole = [s.tolist() for s in ngram_join.batch_sets(col.fill_null(""))]
    monkeypatch.setattr(ngram_join, "PIECE", 64)
    assert [s.tolist() for s in ngram_join.batch_sets(col.fill_null(""))] == whole
    assert [len(s) for s in whole] == [len(shingles(t)) for t in col.to_pylist()]


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 540)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    neighbours = defaultdict(set)
    for a, b in edges:
        if a != b:
            neighbours[a].add(b)
            neighbours[b].add(a)
    for k in neighbours:
        seen, todo = {k}, [k]
        while todo:
            new = neighbours[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[k] == min(seen)
    assert set(got) == set(neighbours)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup(docs, texts, empty):
    sets, first = {}, {}
    for k, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n")):
            s = line.strip(" ").lower()
            if re.search(r"\S", line) and s not in first:
                first[s] = (k, p)
                sets[k, p] = every_shingle(s)
    want = closure(sets, line_dedup.SIMILARITY_PERCENT)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert len(got) == len(texts) and got[0] is None
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = "\n".join(x for p, x in enumerate(lines) if not re.search(r"\S", x) or (first[x.strip(" ").lower()] == (k, p) == want[k, p]))
        kept = kept if re.search(r"\S", kept) else "" if re.search(r"\S", t or "") else t
        assert got[k] == kept, k
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.dedup_lines(empty).count() == 0


def test_edf_cycle(spark):
    own = [("a", 7), ("b", 3), ("c", 1), ("d", 11)]
    df = spark.createDataFrame([(own,)], "own array<struct<source:string,units:int>>")
    rows = df.select(mixing.edf_cycle(df["own"]).alias("x")).first()["x"]
    done = Counter()
    for t, r in enumerate(rows):
        assert r["slot"] == t and r["release"] <= t < r["deadline"] and r["k"] == done[r["source"]]
        done[r["source"]] += 1
        assert all(abs(done[s] - u * (t + 1) / 22) < 1 for s, u in own)
    assert done == dict(own)


def test_mix(spark, docs, empty):
    n = docs.count()
    out = mixing.mix(docs, block=3).toPandas()
    assert len(out) == n and list(out.columns) == [*docs.columns, "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_rank"]
    assert mixing.mix(docs, block=3).select(*docs.columns).exceptAll(docs).count() == 0
    blocks = out.fillna({"source": "-"}).groupby(["source", "mix_block"])
    slots = blocks.mix_slot.first().sort_values()
    assert (blocks.mix_slot.nunique() == 1).all() and slots.is_unique and (blocks.size() <= 3).all()
    assert (out.mix_release <= out.mix_slot).all() and (out.mix_slot < out.mix_deadline).all()
    weights = spark.createDataFrame([("a", 1), ("b", 4)], "source string, units int")
    out = mixing.mix(docs, weights, block=2).fillna({"source": "-"}).toPandas().drop_duplicates(["source", "mix_block"]).sort_values("mix_slot")
    head = out[out.mix_slot < 6].source.value_counts()
    assert head["b"] == 4 and len(out) == out.mix_slot.nunique()
    assert mixing.mix(empty).count() == 0


def test_mix_over_phases(spark):
    """Every block's slot against earliest deadlines played slot by slot; sources are used up at different times."""
    units = {f"s{k:02d}": 1 + (k * 7) % 5 for k in range(12)}
    sizes = {s: 3 + (k * k * 5) % 41 for k, s in enumerate(units)}
    docs = spark.createDataFrame([(n * 100 + i, s) for n, (s, size) in enumerate(sizes.items()) for i in range(size)], "doc_id long, source string")
    out = mixing.mix(docs, spark.createDataFrame(list(units.items()), "source string, units int"), block=2).collect()
    got = {(r["source"], r["mix_block"]): (r["mix_slot"], r["mix_release"], r["mix_deadline"]) for r in out}
    blocks = {s: -(-n // 2) for s, n in sizes.items()}
    last = {s: -(-blocks[s] // units[s]) for s in units}
    want, base, cycle = {}, 0, 0
    for until in sorted(set(last.values())):
        active = [s for s in units if last[s] >= until]
        total = sum(units[s] for s in active)
        for c in range(cycle, until):
            done = dict.fromkeys(active, 0)
            for slot in range(total):
                ready = [(-(-(done[s] + 1) * total // units[s]), s) for s in active if done[s] < units[s] and done[s] * total // units[s] <= slot]
                deadline, s = min(ready)
                at = base + (c - cycle) * total
                if c * units[s] + done[s] < blocks[s]:  # the last cycle of a source may have slots to spare
                    want[s, c * units[s] + done[s]] = (at + slot, at + done[s] * total // units[s], at + deadline)
                done[s] += 1
                assert all(abs(done[x] - units[x] * (slot + 1) / total) < 1 for x in active)
        base, cycle = base + (until - cycle) * total, until
    assert got == want and len({v[0] for v in got.values()}) == len(got)


def test_revisit_records(spark, tmp_path):
    """Revisits are records of their own archives, which the normaliser reads as it reads others."""
    df = spark.createDataFrame([(k, f"http://x/{k}", ["same", "other", None, "same"][k % 4]) for k in range(12)], "page_id long, url string, html string")
    resolved = warc.archive_pages(df, at=f"file://{tmp_path}/w")
    warc.write_revisits(resolved, f"file://{tmp_path}/again")
    index = warc.normalise(spark, f"file://{tmp_path}/again", f"file://{tmp_path}/normal")
    want = {f"<urn:quadrat:page:{r['page_id']}>": r["refers_to"] for r in resolved.collect() if r["record_type"] == "revisit"}
    rows = index.collect()
    assert {r["record_id"] for r in rows} == set(want) and len(rows) == len(want) == 9
    assert all((r["record_type"], r["payload_bytes"]) == ("revisit", 0) for r in rows) and warc.read_records(index).count() == 9
    for r in rows:
        with open(r["archive"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            record = warc.zlib.decompress(f.read(r["length"]), 31).decode()
        assert f"WARC-Refers-To: <urn:quadrat:page:{want[r['record_id']]}>\r\n" in record and "WARC-Payload-Digest: sha1:" in record


def test_inflate_gives_all_or_an_error():
    """Streams of sizes around a block, of several members, in pieces of any size; no cut-off stream passes."""
    rng = random.Random(5)
    for size in (0, 1, warc.BLOCK - 1, warc.BLOCK, warc.BLOCK + 1, 3 * warc.BLOCK):
        plain = [bytes(size), rng.randbytes(min(size, 5000))]
        data = b"".join(gzip.compress(x) for x in plain)
        for piece in (13, 4096, len(data)):
            assert b"".join(warc.inflate(data[k : k + piece] for k in range(0, len(data), piece))) == b"".join(plain)
        for cut in (5, len(data) - 1):
            with pytest.raises(ValueError, match="cut off"):
                list(warc.inflate([data[:cut]]))


def test_archive_larger_than_memory(tmp_path):
    """An archive of 96 MB in one gzip stream passes in some MB; index rows come in several lists."""
    import tracemalloc

    n, payload = 6000, random.Random(3).randbytes(16_000)
    with gzip.open(tmp_path / "big.gz", "wb", compresslevel=0) as f:
        for k in range(n):
            body = payload[k % 100 :] + payload[: k % 100]
            f.write(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{k}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")
    tracemalloc.start()
    lists = [[r[:5] for r in rows] for rows in warc.rewrite_archive(f"file:{tmp_path}/big.gz", f"file://{tmp_path}/out")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = [r for x in lists for r in x]
    assert len(rows) == n and len(lists) == 2 and peak < 24 << 20 < (tmp_path / "big.gz").stat().st_size
    with open(tmp_path / "out" / "big.warc.gz", "rb") as f:
        for k in (0, 4095, 4096, n - 1):
            f.seek(rows[k][1])
            assert warc.zlib.decompress(f.read(rows[k][2]), 31).endswith(payload[k % 100 :] + payload[: k % 100] + b"\r\n\r\n")


def test_top_k(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.13, (400, 16))
    x[50:60] = x[49]  # ties
    rows = [(k, v.tolist(), "z", 1) for k, v in enumerate(x)]
    rows += [rows[7], (1000, None, "z", 1), (1001, [0.1, None] * 8, "z", 1), (1002, [float("nan")] * 16, "z", 1), (1003, [float("inf")] * 16, "z", 1), (None, [0.1] * 16, "z", 1)]
    v = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, d int"))
    for block in (16384, 60):
        got = [tuple(r) for r in topk_search.top_k(v, v.where("vec_id % 20 = 0"), 7, 8, block).orderBy("query_id", "rank").collect()]
        z = np.floor(64 * x).astype(int)
        want = []
        for q in range(0, 400, 20):
            s = z @ z[q]
            order = [j for j in np.lexsort((np.arange(400), -s)) if j != q]
            order = [j for j in order for _ in range(2 if j == 7 else 1)][:7]  # rows[7] is there twice
            want += [(q, k + 1, int(j), int(s[j])) for k, j in enumerate(order)]
        assert got == want
    assert topk_search.top_k(v.limit(0), v.limit(0)).count() == 0
    few = v.where("vec_id < 3")
    assert topk_search.top_k(few, few, 20).count() == 6


def test_top_k_of_repeated_rows_and_empty_vectors(spark):
    rows = [(0, [1.0]), (0, [1.0]), (0, [2.0]), (3, [1.0]), (20, []), (40, [])]
    v = topk_search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in topk_search.top_k(v, v.where("vec_id % 20 = 0")).collect())
    one, two = [(0, 1, 0, 8192), (0, 2, 0, 4096), (0, 3, 3, 4096)], [(0, 1, 0, 8192), (0, 2, 0, 8192), (0, 3, 3, 8192)]
    assert got == sorted(one * 2 + two + [(20, 1, 40, 0), (40, 1, 20, 0)])


def test_nra_bounds_hold():
    rng = np.random.default_rng(8)
    x, q = rng.integers(-30, 30, (50, 6)).astype(float), rng.integers(-30, 30, (5, 6)).astype(float)
    order = np.argsort(x, 0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(50)[:, None], 0)
    lists = np.take_along_axis(x, order, 0)
    for depth in (1, 10, 25, 49, 50):
        lower, upper = topk_search.nra_bounds(q, lists, rank, depth)
        assert (lower <= q @ x.T).all() and (q @ x.T <= upper).all()
    assert (lower == upper).all()


def test_archives(spark, tmp_path):
    pages = [(k, f"http://h/{k}", t, 1) for k, t in enumerate([None, "", "<p>ä</p>", "x" * 100_000, "<p>ä</p>", "a\r\n\r\nWARC/1.1\r\n\r\n", "", "same", "same", "same"])]
    pages.append((10, None, "no\nurl", 2))
    df = spark.createDataFrame(pages + [pages[3]], "page_id long, url string, html string, record_id int").repartition(2)
    got = warc.archive_pages(df, at=f"file://{tmp_path}/w")
    rows = got.select("page_id", "payload_bytes", warc.base32_sha1(got["payload_sha1"]).alias("d"), "record_type", "refers_to").collect()
    assert len(rows) == 12
    last = {p[2] or "": p[0] for p in pages}
    for r in rows:
        body = (pages[r["page_id"]][2] or "").encode()
        own = last[body.decode()]
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), *(("response", None) if own == r["page_id"] else ("revisit", own)))
        assert tuple(r[1:]) == want
    index = spark.read.parquet(f"file://{tmp_path}/w/normal/index").collect()
    for r in index:  # each member opens alone, and all of them are the whole file
        data = open(r["archive"].removeprefix("file://").replace("file:", ""), "rb").read()
        record = gzip.decompress(data[r["offset"] : r["offset"] + r["length"]])
        assert record.startswith(b"WARC/1.1") and record.endswith(b"\r\n\r\n")
    assert warc.archive_pages(df.limit(0), at=f"file://{tmp_path}/e").count() == 0
    small = warc.archive_pages(df, min_bytes=5, at=f"file://{tmp_path}/m")
    assert small.where("record_type = 'revisit'").select("page_id").collect() == [(2,)]


def test_stream_in_pieces():
    import zlib

    records = [b"WARC/1.0\r\nContent-Length: %d\r\nWARC-Type: x\r\n\r\n%s\r\n\r\n" % (n, b"y" * n) for n in (0, 5, 3000)]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = z.compress(b"".join(records)) + z.flush()
    stream, out = warc.RecordStream(), []
    for block in warc.inflate(data[k : k + 7] for k in range(0, len(data), 7)):
        out += [r for r, _, _ in stream.feed(block)]
    stream.close()
    assert out == records
    with pytest.raises(ValueError):
        list(warc.RecordStream().feed(b"HTTP/1.1\r\n\r\n"))


def test_large_bands_of_lines(spark, monkeypatch):
    """Groups of near copies, and lines that only share a passage, with blocks of a few lines."""
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    base, passage = [word() for _ in range(30)], [word() for _ in range(20)]
    rows = []
    for k in range(30):
        w = list(base)
        for _ in range(rng.integers(1, 4)):
            w[rng.integers(0, 30)] = word()
        rows.append((2 * k, " ".join(w)))
        rows.append((2 * k + 1, " ".join([word() for _ in range(12)] + passage)))
    sets = {(k, 0): every_shingle(t) for k, t in rows}
    want = closure(sets, line_dedup.SIMILARITY_PERCENT)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: t if want[k, 0] == (k, 0) else "" for k, t in rows}
    assert 1 < sum(t == "" for t in got.values()) < 30


def every_shingle(s, n=10):
    return {s[k : k + n] for k in range(max(1, len(s) - n + 1))}


def test_lines_without_spaces(spark):
    """Lines of one run, which differ behind their first characters, against the set of every place's characters."""
    rng = np.random.default_rng(12)
    run = lambda letters, n: "".join(rng.choice(list(letters), n))
    cjk = "".join(map(chr, range(0x4E00, 0x5E00)))
    lines = ["https://example.org/a/1", "https://example.com/b/2", "short", "shorter", "0123456789", "0123456789a"]
    for letters, n in ((cjk, 200), ("0123456789abcdef", 300), (cjk + "\U0001f600\U00020000", 3000), ("ab", 400)):
        head = run(letters, 40)
        for _ in range(3):
            base = head + run(letters, n - 40)
            lines.append(base)
            for k in range(3):  # near copies: some characters changed in a row
                at = int(rng.integers(0, n - n // 20))
                lines.append(base[:at] + run("xyz", 1 + n // 40) + base[at + 1 + n // 40 :])
    rows = list(enumerate(lines))
    want = closure({k: every_shingle(t) for k, t in rows}, line_dedup.SIMILARITY_PERCENT)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {k: t if want[k] == k else "" for k, t in rows}
    assert 10 < len(set(want.values())) < len(lines)
    for r in df.select("doc_id", line_dedup.shingle_set(F.lower("text")).alias("hs")).collect():
        assert len(r["hs"]) == len(set(r["hs"])) == len(every_shingle(lines[r["doc_id"]]))


def test_recall_of_the_bands(spark):
    """Pairs of lines, of which one has some words changed: links found among those that the exact similarity asks for."""
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9)))
    rows, at = [], defaultdict(list)
    for k in range(600):
        w = [word() for _ in range(rng.integers(20, 120))]
        other = list(w)
        for j in rng.choice(len(w), max(1, int(len(w) * rng.uniform(0.01, 0.06))), replace=False):
            other[j] = word()
        a, b = every_shingle(" ".join(w)), every_shingle(" ".join(other))
        at[min(9, int(10 * len(a & b) / len(a | b)))].append(k)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    gone = {r["doc_id"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("text = ''").collect()}
    found = {j: sum(2 * k + 1 in gone for k in ks) / len(ks) for j, ks in at.items()}
    assert min(len(at[8]), len(at[9])) > 50 and found[9] >= 0.99 and found[8] >= 0.9
    assert all(not found[j] for j in found if j < 8)


def test_rows_that_repeat_an_id(spark):
    """Another text under the same id is a document of its own; the same text loses the same lines."""
    a, b = "first line of the one text here\nand its second line", "something else that is not similar\nand its second line"
    rows = [(1, a, "x"), (1, a, "y"), (1, b, "z"), (2, "and its second line\n\n only here", "w")]
    got = {r["i"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, i string")).collect()}
    kept = [sum("second" in got[k] for k in keys) for keys in ("xy", "z", "w")]
    assert got["x"] == got["y"] and kept[0] % 2 == 0 and kept[0] // 2 + kept[1] == 1 and kept[2] == 0 and got["w"] == "\n only here"


@pytest.mark.parametrize(("shortest", "longest", "least"), [(10, 22, 1.0), (23, 40, 0.9), (41, 200, 0.9)])
def test_recall_by_length(spark, shortest, longest, least):
    """Of pairs of like lines the second goes: all of them, where both are short."""
    rng = np.random.default_rng(shortest)
    letters = np.array(list("abcdefghij klmnop"))
    rows = []
    while len(rows) < 800:
        a = "z" + "".join(rng.choice(letters, rng.integers(shortest, longest + 1) - 2)) + "z"
        k = int(rng.integers(0, len(a)))
        b = str(rng.choice([a + "x", "x" + a, a[:k] + "#" + a[k:] + "#", a[:-1]])).strip(" ")
        x, y = every_shingle(a), every_shingle(b)
        if 100 * len(x & y) >= 80 * len(x | y) and len(b) <= longest:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == t for k, t in rows[::2])
    assert sum(got[k] == "" for k, _ in rows[1::2]) >= least * len(rows) / 2


def test_bits_bound_the_similarity_closely(spark):
    """Of near copies below the threshold few pairs are left to compare, and none that reaches it is lost."""
    rng = np.random.default_rng(33)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    base = [word() for _ in range(80)]
    rows = []
    for k in range(60):
        w = list(base)
        for j in rng.choice(80, int(rng.integers(3, 6)), replace=False):
            w[j] = word()
        rows.append((k, " ".join(w)))
    sets = {k: every_shingle(t) for k, t in rows}
    bits = line_dedup.set_bits(spark.createDataFrame(rows, "v long, s string")).cache()
    other = bits.select(F.col("v").alias("w"), *(F.col(c).alias(f"other_{c}") for c in bits.columns if c != "v"))
    left = {(r["v"], r["w"]) for r in bits.crossJoin(other).where("v > w").where(line_dedup.may_reach(80)).select("v", "w").collect()}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a > b}
    assert {x for x, j in like.items() if j >= 0.8} <= left
    assert sum(j < 0.72 for j in like.values()) > 100 and all(like[x] >= 0.72 for x in left)


def test_lines_are_fetched_once(spark, monkeypatch):
    """Near copies that take several comparisons: the documents are read for their lines once, and a task finds sets of little input."""
    rng = np.random.default_rng(41)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    base = [word() for _ in range(80)]
    rows = []
    for k in range(60):
        w = list(base)
        for j in rng.choice(80, int(rng.integers(1, 5)), replace=False):
            w[j] = word()
        rows.append((k, " ".join(w)))
    calls, sizes = [], []
    fetch, compare = line_dedup.candidate_lines, line_dedup.similar
    monkeypatch.setattr(line_dedup, "candidate_lines", lambda *x: calls.append(1) or fetch(*x))
    monkeypatch.setattr(line_dedup, "similar", lambda *x: sizes.append(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) or compare(*x))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    gone = {r["doc_id"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("text = ''").collect()}
    want = closure({k: every_shingle(t) for k, t in rows}, line_dedup.SIMILARITY_PERCENT)
    assert gone == {k for k in want if want[k] != k} and 0 < len(gone) < 60
    assert len(calls) == 1 and len(sizes) >= 2 and set(sizes) == {line_dedup.TASK_INPUT}
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) == before


def test_bits_of_sets(spark):
    """A bit for each shingle, of large sets for those of the smallest values, against the hashes one by one."""
    rng = np.random.default_rng(5)
    rows = [(0, ""), (1, "short"), (2, "x" * 500), (3, "\u4f60" * 30 + "".join(rng.choice(list("abcdef \U0001f600"), 700))), (4, "".join(rng.choice(list("abcdefgh"), 5000)))]
    df = spark.createDataFrame(rows, "v long, s string")
    got = {r["v"]: r for r in line_dedup.set_bits(df).collect()}
    for r in df.select("v", line_dedup.shingle_set(F.col("s")).alias("hs")).collect():
        n, k = len(r["hs"]), max(0, int(np.ceil(np.log2(len(r["hs"]) / line_dedup.SAMPLED))))
        want = [0] * line_dedup.WORDS
        for h in r["hs"]:
            if k == 0 or ((h + 2**63) >> 32) < 2 ** (32 - k):
                want[(h >> 6) % line_dedup.WORDS] |= 1 << (h % 64)
        own = got[r["v"]]
        assert (own["n"], own["k"]) == (n, k) and [own[f"b{j}"] % 2**64 for j in range(line_dedup.WORDS)] == want
