"""Operators that judge each text alone: brute-force versions, and the defined results of odd input."""

import random
import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from quadrat.llm import license_scan, pii, quality_rules, rule_ensemble, sentence_pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(t):
    t = t or ""
    w = WORD.findall(t)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
    lines = t.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:k] for k, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_base_rules(texts):
    for t in [*texts, "a b c d e f g h " * 3, "#1 & 2\n#1 & 2\n"]:
        assert quality_rules.base_rules(t) == plain_base(t)


def test_ngram_buckets_do_not_depend_on_chunks(monkeypatch):
    t = "größer als \U0001f600 " * 50
    whole = np.concatenate(list(quality_rules.ngram_buckets(t)))
    monkeypatch.setattr(quality_rules, "CHUNK", 7)
    assert (np.concatenate(list(quality_rules.ngram_buckets(t))) == whole).all() and len(whole) == len(t) - 2


def test_quality_rules(spark, docs, texts, empty):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(8, 40)] + [(8, 1, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert len(got) == len(texts)
    ratio = quality_rules.log_ratios(quality_rules.count_ngrams(docs.selectExpr("text as t", "doc_id between 10 and 39 or doc_id = 8 as g"), "t", "g"))
    for k, t in enumerate(texts):
        r = got[k]
        base = plain_base(t)
        assert tuple(r[1:6]) == base
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        b = list(quality_rules.ngram_buckets(t or ""))
        mean = float(np.concatenate([ratio[x] for x in b]).mean()) if b else 0.0
        assert r["base_failed"] == failed and r["kept"] == (not failed and mean >= quality_rules.THRESHOLD)
        assert r["ratio"] == pytest.approx(mean, abs=1e-9)
    assert quality_rules.quality_rules(empty, labels.limit(0)).count() == 0
    assert quality_rules.quality_rules(docs, labels.limit(0)).where("kept = base_failed").count() == 0
    assert quality_rules.quality_rules(docs, labels, carry=True).select(*docs.columns).exceptAll(docs).count() == 0


def test_license_scan(docs, texts, empty):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    for k, t in enumerate(texts):
        w = words.findall((t or "").translate(lower))
        places = [(at, label) for p, label in license_scan.BASE.items() for at in range(len(w)) if w[at : at + len(p.split())] == p.split()]
        r = got[k]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places})))
        assert (r["first_word"], r["last_word"]) == (min((x for x, _ in places), default=None), max((x for x, _ in places), default=None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    full = next(r for r in got.values() if r["n_base"])
    assert "apache-2.0" in full["labels"].split(",") and full["permissive"] is True
    assert license_scan.license_scan(empty).count() == 0


@pytest.mark.parametrize(
    ("expression", "value"),
    [("mit", 1.0), ("mit or gpl-3.0-only", 1.0), ("mit and gpl-3.0-only", 0.0), ("gpl-2.0+ with classpath-exception-2.0", 0.5), ("mit or gpl-2.0 and agpl-3.0", 1.0), ("(mit or gpl-2.0) and agpl-3.0", 0.0), ("unheard-of or mit", 1.0), ("unheard-of and mit", None)],
)
def test_expressions(expression, value):
    assert license_scan.evaluate(license_scan.to_postfix(license_scan.expression_tokens(expression))) == value


@pytest.mark.parametrize("broken", ["", "and mit", "(mit", "mit)", "mit or", "()", "mit (gpl-2.0)"])
def test_broken_expressions(broken):
    post = license_scan.to_postfix(license_scan.expression_tokens(broken))
    assert post is None or (broken, post, license_scan.evaluate(post)) == ("mit or", ["mit"], 1.0)


@pytest.mark.parametrize(("line", "labels", "permissive"), [("mit or", "mit", True), ("(mit", "mit", None), ("MIT AND GPL-3.0-only", "gpl-3.0,mit", False), ("(GPL-2.0+ OR MIT) AND ISC", "gpl-2.0,isc,mit", True)])
def test_labels_of_tags(line, labels, permissive):
    """Also of an expression that cannot be read whole."""
    got = dict(zip(license_scan.NAMES, license_scan.scan(f"a\n# SPDX-License-Identifier: {line}\nb", *license_scan.automata()), strict=True))
    assert (got["labels"], got["permissive"]) == (labels, permissive)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


def test_pii(docs, texts, empty):
    got = {r["doc_id"]: r for r in pii.span_report(pii.find_spans(docs)).collect()}
    for k, t in enumerate(texts):
        spans = plain_spans(t or "") if len(t or "") < 10000 else [("email", 5001, 5001 + 3006)] * ("@bbb" in t)
        joined = ",".join(f"{a}:{b}:{c}" for a, b, c in spans)
        assert got[k]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (k, joined, got[k])
        assert [got[k][f"n_{x}"] for x in pii.BASE_KINDS] == [sum(s[0] == x for s in spans) for x in pii.BASE_KINDS]
        assert got[k]["spans"].startswith(joined)
    assert any("secret:" in r["spans"] for r in got.values())
    assert pii.find_spans(empty).count() == 0


def test_mask(docs):
    out = {r["doc_id"]: r["text"] for r in pii.mask(docs, pii.find_spans(docs).dropDuplicates(["doc_id"])).collect()}
    assert out[0] is None and out[1] == "" and any("[email]" in (t or "") and "[ip]" in t for t in out.values())


def test_expectation_maximisation_finds_the_reliable_labeler():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.6
    vote = lambda right: np.where(rng.random(4000) < right, truth, ~truth).astype(int)
    patterns = Counter(zip(vote(0.95).tolist(), vote(0.75).tolist(), vote(0.6).tolist(), strict=True))
    posterior, model = pii.expectation_maximisation([(4, v, n) for v, n in patterns.items()])
    a = [p for p, _ in model[4][1]]
    assert a[0] > a[1] > a[2] and posterior[4, (1, 1, 1)] > 0.9 > 0.1 > posterior[4, (0, 0, 0)]


def test_rules_are_compiled_as_they_score(spark):
    rng = np.random.default_rng(3)
    x = rng.random((600, len(rule_ensemble.FEATURES)))
    y = ((x[:, 4] > 0.6) | ((x[:, 5] > 0.5) & (x[:, 7] < 0.3))).astype(float)
    model = rule_ensemble.fit(x, y, n_trees=15)
    assert ((model.odds(x) > 0) == (y == 1)).mean() > 0.95 and model.rules
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{f} double" for f in rule_ensemble.FEATURES))
    got = sorted(r[0] for r in df.select(model.column().alias("s")).collect())
    assert np.allclose(got, sorted(rule_ensemble.sigmoid(model.odds(x))))


def test_quality_scores(spark, sf_dir, docs, empty):
    import zlib

    d, labels = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    got = rule_ensemble.score_quality(d, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (got.held_out == [zlib.crc32(str(k).encode()) % 4 == 2 for k in got.doc_id]).all()
    assert (held.predicted == held.quality).mean() > 0.95
    none = rule_ensemble.score_quality(docs, labels.limit(0))
    assert none.where("score between 0 and 1").count() == docs.count()
    assert rule_ensemble.score_quality(empty, labels).count() == 0


def plain_viterbi(segment, pieces):
    best = {0: (0, 0, 0, [])}
    for end in range(1, len(segment) + 1):
        paths = []
        for start in range(end):
            part = segment[start:end]
            if part in pieces.cost:
                c, i = pieces.cost[part]
                paths.append((best[start][0] + c, best[start][1] + 1, start - end, best[start][3] + [i]))
            elif len(part) == 1:
                raw = part.encode("utf-8", "surrogatepass")
                paths.append((best[start][0] + sentence_pieces.BYTE_COST * len(raw), best[start][1] + len(raw), -1, best[start][3] + [pieces.bytes[b] for b in raw]))
        best[end] = min(paths)
    return best[len(segment)][3]


def test_pieces(docs, texts, empty):
    pieces = sentence_pieces.Pieces()
    got = {r["doc_id"]: r for r in sentence_pieces.decode(sentence_pieces.encode(docs, pieces=pieces, lexicon=200), pieces=pieces).collect()}
    for k, t in enumerate(texts):
        if t is None:
            assert got[k]["piece_ids"] is None and got[k]["decoded"] is None
            continue
        assert got[k]["decoded"] == t.replace(sentence_pieces.SPACE, " ")
        if len(t) < 2000:
            assert got[k]["piece_ids"] == [i for w in sentence_pieces.segments(t) for i in plain_viterbi(w, pieces)]
    assert sentence_pieces.encode(empty, pieces=pieces).count() == 0


def test_lattice_equals_the_fold_outside_spark(spark):
    pieces = sentence_pieces.Pieces()
    words = ["▁the", "▁▁x", "größer", "你好", "\n", "a\U0001f600b", "▁internationalisation", "1"]
    got = {r["w"]: r["ids"] for r in sentence_pieces.encode_lexicon(spark.createDataFrame([(w,) for w in words + words], "w string"), pieces).collect()}
    assert got == {w: sentence_pieces.viterbi(w, pieces) for w in words} == {w: plain_viterbi(w, pieces) for w in words}


def test_every_good_label_counts(spark):
    """All of 20,400 documents are good, so both multinomials are the same and every ratio is 0."""
    docs = spark.range(20_400).selectExpr("id as doc_id", "repeat(md5(cast(id as string)), 3) as text")
    labels = spark.range(20_400).selectExpr("id as doc_id", "1 as quality")
    assert quality_rules.quality_rules(docs, labels).where("ratio != 0").count() == 0


def test_long_secrets(spark):
    token = "aB3_" * 250
    docs = spark.createDataFrame([(1, f"set token={token} end")], "doc_id long, text string")
    found = pii.find_spans(docs)
    assert [(z["kind"], z["s"], z["e"]) for z in found.first()["spans"]] == [("secret", 4, 10 + len(token))]
    assert pii.mask(docs, found).first()["text"] == "set [secret] end"


def test_long_expressions():
    phrases, tags = license_scan.automata()
    text = "SPDX-License-Identifier: " + "MIT AND " * 400 + "GPL-3.0-only\nAND isc"
    labels, _, permissive = license_scan.scan(text, phrases, tags)[5:]
    assert labels == "gpl-3.0,mit" and permissive is False


def test_encode_replaces_a_column_of_its_name(spark):
    df = spark.createDataFrame([(1, "a b  c\nd ", "old"), (2, None, "old")], "doc_id long, text string, piece_ids string")
    out = sentence_pieces.decode(sentence_pieces.encode(df))
    assert out.columns == ["doc_id", "text", "piece_ids", "decoded"]
    assert {r["doc_id"]: r["decoded"] for r in out.collect()} == {1: "a b  c\nd ", 2: None}


def test_segments_are_those_of_the_pattern():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("ab \n▁\t") for _ in range(rng.randint(0, 9)))
        want = sentence_pieces.SEGMENT.findall("▁" + text.replace(" ", "▁")) if text else []
        assert sentence_pieces.segments(text) == want


def test_licenses_of_several_tags():
    """Every tag binds: an unknown license leaves the verdict open unless another tag forbids, and is a label; labels don't ask whether it can be read."""
    scan = lambda *xs: license_scan.scan("\n".join(f"SPDX-License-Identifier: {x}" for x in xs), *license_scan.automata())
    got = {xs: scan(*xs)[5::2] for xs in (("MIT",), ("MIT", "Proprietary-X"), ("Proprietary-X", "GPL-3.0"), ("MIT OR Foo",), ("MIT OR (Foo",), ("MIT AND Foo",))}
    assert got[("MIT",)] == ("mit", True) and got[("MIT", "Proprietary-X")] == ("mit,proprietary-x", None)
    assert got[("Proprietary-X", "GPL-3.0")] == ("gpl-3.0,proprietary-x", False)
    assert got[("MIT OR Foo",)] == ("foo,mit", True) and got[("MIT OR (Foo",)] == ("foo,mit", None) and got[("MIT AND Foo",)] == ("foo,mit", None)


@pytest.mark.parametrize(
    ("text", "labels", "permissive"),
    [
        ("License: Apache-2.0", "apache-2.0", True), ('license = "MIT"', "mit", True), ('{"license": "GPL-3.0-or-later OR ISC"}', "gpl-3.0,isc", True), ("license='EUPL-1.2'", "eupl-1.2", False),
        ("license: see the file", "", None), ("sublicense: MIT", "", None), ("license: MIT and our own", "", None), ("license:\nMIT", "", None), ("License: MIT.", "mit", True),
        ("SPDX-License-Identifier: BSD-3-Clause-Clear", "bsd-3-clause-clear", True), ("SPDX-License-Identifier: MIT-0", "mit-0", True), ("SPDX-License-Identifier: Foo-1.0 -->", "foo-1.0", None),
        ("<!-- SPDX-License-Identifier: MIT --> license: GPL-2.0", "gpl-2.0,mit", False), ("SPDX-License-Identifier: MIT OR SPDX-License-Identifier: ISC", "isc,mit", True), ("SPDX-License-Identifier: ()", "", None),
    ],
)
def test_tags_of_other_spellings(text, labels, permissive):
    got = license_scan.scan(text, *license_scan.automata())
    assert (got[5], got[7]) == (labels, permissive) and (got[6] > 0) == bool(labels)


def test_many_tags_take_linear_time():
    import time

    began = time.perf_counter()
    for unit in ("license:", "SPDX-License-Identifier:", "SPDX-License-Identifier: MIT OR ", "license: (", "license: \t"):
        license_scan.scan(unit * 40_000, *license_scan.automata())
    assert time.perf_counter() - began < 20


class Freedom:
    """Operands of Python's own & and |, which bind as AND and OR do."""

    def __init__(self, x):
        self.x = x

    def __and__(self, o):
        return Freedom(0.0 if 0.0 in (self.x, o.x) else None if None in (self.x, o.x) else min(self.x, o.x))

    def __or__(self, o):
        return Freedom(max([x for x in (self.x, o.x) if x is not None], default=None))


def test_all_labels_by_brute_force():
    """Texts put together at random: labels and verdict by regular expressions and Python's own parser of & and |."""
    rng = random.Random(12)
    lower = {c: c + 32 for c in range(65, 91)}
    known = sorted(license_scan.FREEDOM)
    automata = license_scan.automata()
    notices = {**{p: v for p, v in license_scan.BASE.items()}, **{p: v[0] for p, v in license_scan.NOTICES.items()}}
    seen = set()
    for _ in range(1500):
        lines = []
        for _ in range(rng.randint(0, 5)):
            expression = rng.choice([*known, "Foo-9", "LicenseRef-x"])
            for _ in range(rng.randint(0, 3)):
                other = rng.choice(known) + rng.choice(["", "+", "-only", "-or-later"])
                expression = rng.choice([f"{expression} {rng.choice(['AND', 'or'])} {other}", f"({expression}) and ({other})", f"({expression} OR {other})"])
            lines.append(rng.choice(["SPDX-License-Identifier: ", "license: ", 'x\tlicense = "', "my-license: ", "see "]) + expression.upper())
            lines.append(rng.choice(["", " ".join(w.title() for w in rng.choice(sorted(notices)).split()), rng.choice(sorted(notices)).replace(" ", ", ")]))
        text = "\n".join(lines)
        got = license_scan.scan(text, *automata)
        plain = text.translate(lower)
        words = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain)) + " "
        labels, verdicts = {v for p, v in notices.items() if f" {p} " in words}, []
        for m in re.finditer(r"""(?m)^(spdx-license-identifier:|license:|x\tlicense = ") ?(.*)$""", plain):
            ids = [re.sub(r"(\+|-or-later|-only)$", "", x) for x in re.findall(r"[a-z0-9.+-]+", m[2]) if x not in ("and", "or")]
            if not m[1].startswith("spdx") and not all(x in known for x in ids):
                continue
            labels.update(ids)
            code = re.sub(r"[a-z0-9.+-]+", lambda x: {"and": "&", "or": "|"}.get(x[0], f"F('{re.sub(r'([+]|-or-later|-only)$', '', x[0])}')"), m[2])
            verdicts.append(eval(code, {"F": lambda x: Freedom(license_scan.FREEDOM.get(x))}).x)
        freedom = 0.0 if 0.0 in verdicts else None if None in verdicts else min(verdicts, default=None)
        assert (got[5], got[7]) == (",".join(sorted(labels)), None if freedom is None else freedom == 1.0), text
        seen |= labels
    assert len(seen) > len(known) and len(license_scan.FREEDOM) < 200


def test_what_was_found_is_not_written(spark):
    """Neither the result nor any table on the way to it holds the text of a span."""
    t = "mail private.person@example.org, password = hunter2hunter2hunter2"
    docs = spark.createDataFrame([(1, t)], "doc_id long, text string")
    written = []
    real = pii.cut
    pii.cut = lambda df, what="cut": written.append(real(df, what)) or written[-1]
    try:
        found = pii.find_spans(docs)
    finally:
        pii.cut = real
    assert written and found.first()["spans"]
    for df in [*written, found]:
        assert "private.person" not in str(df.collect()) and "hunter2" not in str(df.collect())


def test_scores_do_not_depend_on_the_order_of_repeated_ids(spark):
    texts = [f"some words of text number {k} " * (1 + k % 7) + "!" * (k % 3) for k in range(60)]
    rows = [(k % 40, t) for k, t in enumerate(texts)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    one, other = (
        sorted((r["doc_id"], r["score"]) for r in rule_ensemble.score_quality(spark.createDataFrame(x, "doc_id long, text string").repartition(n), labels).collect())
        for x, n in ((rows, 1), (rows[::-1], 3))
    )
    assert one == other and len({s for _, s in one}) > 1
