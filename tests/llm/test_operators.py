"""Each operator against a brute-force version, on a small table with nulls, blanks, copies, repeated rows and long texts."""

from __future__ import annotations

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rowmesh.llm import language, licenses, minhash, mixing, packing, quality, simhash, substring, topk, warc
from rowmesh.llm.text import word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double, part int, size long, path string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    shared = prose(rng, 60)
    long = prose(rng, 9000)
    texts = [None, "", "  \n\t ", "one", "one two", long, long, long + " tail", shared, prose(rng, 40) + " " + shared, shared + "\n" + prose(rng, 50)]
    texts += ["x y \u0085 z", "of, " * 200, "to, " * 40, "Licensed under the Apache License, Version 2.0.\n" + prose(rng, 30), "nul\x00byte ퟿ end"]
    texts += [prose(rng, rng.randint(1, 300)) for _ in range(25)]
    base = texts[-1].split()
    texts += [" ".join([*base[:-1], "changed"]) if len(base) > 1 else "changed"]
    out = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None)[i % 3], len(t or ""), "clash", 1.0, 1, 1, "p") for i, t in enumerate(texts)]
    out += [(2**62 + 1, "a large key", "en", "a", 11, None, None, None, None, None)]
    out += [out[8], out[8], (None, "null key text here", None, None, 0, None, None, None, None, None), (None, shared, "en", "a", 0, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_licenses(spark, none):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "Licensed under CC BY-NC 4.0.\n" + "word " * 100), ("a/b/y.txt", "plain " * 90), ("a/b/c/z.txt", None),
        ("a/b/c/LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("q/r.txt", ""), ("top.txt", "text"), (None, "Released under the MIT License."), ("a/b/y.txt", "plain " * 90), ("a/b/c/d/mit.txt", "Mit."),
        ("n/notice.txt", "Some words\nReleased under the MIT License."), ("n/other.txt", "x"), ("h/head.txt", "Released under the MIT License.\n" + "word " * 40), ("h/other.txt", "x"),
    ]
    got = licenses.scan(spark.createDataFrame(files, "name string, text string"), F.col("name"))
    found = {(r["path"], r["license"], r["via"], r["license_dir"]) for r in got.collect()}
    assert found == {
        ("a/LICENSE", "MIT", "header", None), ("a/b/x.txt", "CC-BY-NC-4.0", "header", None), ("a/b/y.txt", "MIT", "directory", "a"), ("a/b/c/z.txt", "GPL-3.0", "directory", "a/b/c"),
        ("a/b/c/LICENSE", "GPL-3.0", "header", None), ("q/r.txt", None, None, None), ("top.txt", None, None, None), (None, "MIT", "header", None), ("a/b/c/d/mit.txt", "GPL-3.0", "directory", "a/b/c"),
        ("n/notice.txt", "MIT", "header", None), ("n/other.txt", "MIT", "directory", "n"), ("h/head.txt", "MIT", "header", None), ("h/other.txt", None, None, None),
    }
    assert got.count() == len(files)
    assert licenses.scan(none, F.lit("a/b")).count() == 0
    clash = spark.createDataFrame([(*f, 1, 2, 3) for f in files], "name string, text string, dir int, near int, hash int")
    clash = clash.withColumnsRenamed({"dir": "dir"}).withColumns({c: F.lit(7) for c in ("own", "above", "given", "depth", "__own", "__dir", "k", "license")})
    out = licenses.scan(clash, F.col("name"))
    assert {(r["path"], r["license"], r["via"], r["license_dir"]) for r in out.collect()} == found and {"dir", "near", "hash", "__own", "__dir", "k"} <= set(out.columns)


def wrapped(text, width, mark=""):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_headers_and_licence_texts_over_many_lines(spark):
    free = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."
    nc = licenses.NOTICES["CC-BY-NC-4.0"][1]
    gpl2 = licenses.NOTICES["GPL-2.0"][0]
    body = "def f(x):\n    return x + 1\n" * 30
    files = {f"w/{i}/{w}": (wrapped(t, w, mark) + "\n\n" + body, want) for i, (t, want, mark) in enumerate([(free, "MIT", "# "), (nc, "CC-BY-NC-4.0", " * "), (gpl2, "GPL-2.0", "// ")]) for w in (30, 40, 50, 60, 66, 70)}
    by = {n: json_bag for n, json_bag in licenses._made(None, licenses.THRESHOLD)[1].__dict__.items()}
    assert {"Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "MIT"} <= set(by["names"])
    import pyspark

    root = next(iter(pyspark.__path__)) + "/licenses/"
    for name, want in (("LICENSE-AnchorJS.txt", "MIT"), ("LICENSE-CC0.txt", "CC0-1.0"), ("LICENSE-py4j.txt", "BSD-3-Clause"), ("LICENSE-jquery.txt", "MIT")):
        files[f"t/{want}/{name}.md"] = (open(root + name).read(), want)
        files[f"t/{want}/{name}/code.py"] = (body, None)
        files[f"t/{want}/code.py"] = (body, want)
    got = licenses.scan(spark.createDataFrame([(p, t) for p, (t, _) in files.items()], "name string, text string"), F.col("name"))
    found = {r["path"]: (r["license"], r["via"]) for r in got.collect()}
    for path, (_, want) in files.items():
        assert found[path][0] == (want or path.split("/")[1]), (path, found[path])
        assert found[path][1] == ("directory" if path.endswith("code.py") else "header")


def test_every_term_of_a_statement_counts(spark):
    prose = ["It is from MIT.", "It is all about Apache.", "It is not for the general public.", "In the creative commons.", "the the of GNU", "Licensed under the", "Mit."]
    own = [(name, t) for name, texts in licenses.NOTICES.items() for t in texts]
    lines = [*[(None, t) for t in prose], *own, (None, "the author has waived all copyright and"), (None, "Released under the MIT License, the MIT of it all, as is")]
    bags = [Counter(licenses.terms(t)) for _, t in own]
    idf = lambda t: np.log((1 + len(bags)) / (1 + sum(t in b for b in bags))) + 1
    weight = lambda b, t: (1 + np.log(b[t])) * idf(t) if b[t] else 0.0
    norm = lambda b: sum(weight(b, t) ** 2 for t in b) ** 0.5
    want = []
    for i, (_, line) in enumerate(lines):
        said = [Counter(licenses.terms(t)) for t in [*re.split(r"(?<=[.!?])[ \t]+", line), line]]
        best = max(round(float(sum(weight(b, t) * weight(c, t) for t in b) / norm(b) / norm(c)), 6) * (len(b.keys() & c.keys()) > 1 and not b.keys() & c.keys() <= licenses.ORDINARY) for b in said for c in bags)
        want.append((i, best if best >= licenses.THRESHOLD else None))
    files = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(lines)], "n long, text string")
    got = licenses.scan(files, F.concat(F.lit("d"), F.col("n").cast("string"), F.lit("/f")), notices=licenses.NOTICES).select("n", "similarity").collect()
    assert sorted(map(tuple, got)) == want and all(s is None for _, s in want[: len(prose)])


def test_units_are_cut_into_words_once(spark):
    files = spark.createDataFrame([("a", 1, "Released under the MIT License.\nMehr mit Text.")], "path string, hash long, text string")
    own = licenses.own_licenses(files, *licenses._made(None, licenses.THRESHOLD), licenses.THRESHOLD)
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and not [x for x in plan.splitlines() if "Filter" in x and "regexp_replace" in x]
    assert [r["license"] for r in own.collect()] == ["MIT"]


def test_license_scan_keeps_every_row(docs, rows):
    assert licenses.scan(docs, licenses.document_path()).count() == len(rows)


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_targets_are_the_water_level(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 5), ("z", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.allocate(s).collect()}
    weights, caps = {"a": 1, "b": 2, "c": 3, "z": 1, None: 2}, {"a": 30, "b": 3000, "c": 300, "z": 0, None: 15}
    free, left, want = set(weights), 1115.0, {}
    while True:  # the excess shared out again by weight until none is above its cap
        level = left / sum(weights[k] for k in free)
        over = {k for k in free if weights[k] * level > caps[k]}
        if not over:
            break
        for k in over:
            want[k] = float(caps[k])
            left -= caps[k]
        free -= over
    want |= {k: weights[k] * level for k in free}
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}
    alike = spark.createDataFrame([(f"s{i}", 100) for i in range(6)], "source string, source_size long")
    assert [round(r["target"], 6) for r in mixing.allocate(alike, (1, 5)).orderBy("source").collect()] == [33.333333, 166.666667] * 3


def test_mix(docs, rows, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == sorted(len(words(r[1])) for r in rows)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(2)).collect()))
    for s in ("a", "b", None):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    out = mixing.resample(docs)
    assert out.columns == docs.columns and sum(len(words(r["text"])) for r in out.collect()) == sum(r["taken"] for r in got)
    assert mixing.mix(none).count() == 0 and mixing.resample(none).count() == 0


def test_rows_that_share_key_and_text_are_split_at_the_target(spark):
    same = [(None, "w " * 10, "a")] * 40 + [(7, "x " * 10, "a")] * 20
    df = spark.createDataFrame([*same, *[(i, "z " * 50, "b") for i in range(100, 130)]], "doc_id long, text string, source string")
    for parts in (1, 4):
        got = mixing.mix(df.repartition(parts), weights=(1, 3)).collect()
        by = {s: (sum(r["taken"] for r in got if r["source"] == s), next(r["target"] for r in got if r["source"] == s)) for s in "ab"}
        assert abs(by["a"][0] - by["a"][1]) <= 10 and abs(by["b"][0] - by["b"][1]) <= 50 and by["a"][1] == 525
        again = mixing.resample(df.repartition(parts), weights=(1, 3)).collect()
        assert sum(len(words(r["text"])) for r in again) == by["a"][0] + by["b"][0]


def test_inclusion_frequencies_are_the_probabilities(spark):
    sizes = [n for n in (1, 2, 5, 9, 16, 25, 40, 64, 100, 150, 220, 400) for _ in range(8)]
    docs = spark.createDataFrame([(1000 * s + i, "w " * n, f"{s:04d}") for s in range(100) for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1, 8)).withColumn("half", (F.col("doc_id") / 1000 % 2).cast("int")).toPandas()
    for half, part in got.groupby("half"):
        target, total = part["target"].iloc[0], part["source_size"].iloc[0]
        whole, left = divmod(target, total)
        sure: set[int] = set()
        while True:
            free = [n for n in sizes if n not in sure]
            scale = (left - sum(n for n in sizes if n in sure)) / sum(n * int(mixing.FINE * n**0.5) for n in free)
            more = {n for n in free if scale * int(mixing.FINE * n**0.5) > 1}
            if not more:
                break
            sure |= more
        for n, own in part.groupby("size"):
            want = 1.0 if n in sure else scale * int(mixing.FINE * n**0.5)
            assert abs((own["taken"] / n - whole).mean() - want) < 0.1, (half, n, want)
        assert bool(sure) == (half == 1) and abs(part["taken"].sum() / (50 * target) - 1) < 0.01


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_fingerprints(docs, rows, none):
    got = minhash.compare_with_next(docs)
    h = lambda t: (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest((t or "").encode(), 42))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h(r[1])))
    texts = [r[1] or "" for r in order]
    want = [(r[0], len(t), hashlib.sha256(minhash.edited(t, n).encode()).hexdigest()) for r, t, n in zip(order, texts, texts[1:] + texts[:1])]
    out = got.collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out), key=str) == sorted(want, key=str)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    by_text = {}
    for r in minhash.fingerprint(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert by_text.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"] or r["text"] is None or not r["text"].strip()
    assert minhash.compare_with_next(none).count() == 0


def test_a_key_of_many_rows_is_cut_by_hash(spark):
    rng = random.Random(21)
    rows = [(5, prose(rng, rng.randint(1, 12))) for _ in range(300)] + [(i, prose(rng, 5)) for i in range(60)] + [(None, prose(rng, 4)) for _ in range(90)]
    h = lambda t: (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, h(r[1]), r[1]))
    want = sorted(((r[0], len(r[1]), hashlib.sha256(minhash.edited(r[1], n[1]).encode()).hexdigest()) for r, n in zip(order, order[1:] + order[:1])), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in minhash.compare_with_next(df).collect()), key=str) == want
    parts = {r["part"]: r["count"] for r in minhash.in_order(df, "doc_id", "text", 30).where("not guest").groupBy("part").count().collect()}
    assert len(parts) > 20 and max(parts.values()) < 60


def test_a_block_may_hold_a_guest_alone(spark):
    texts = [f"{c} text of more than a block " * (minhash.BLOCK // 24) for c in "abc"]
    assert min(map(len, texts)) >= minhash.BLOCK
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [(i, len(t), hashlib.sha256(minhash.edited(t, n).encode()).hexdigest()) for i, (t, n) in enumerate(zip(texts, texts[1:] + texts[:1]))]
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in minhash.compare_with_next(df).collect()) == want


def test_fingerprint_values():
    rng = random.Random(4)
    for text in ("", "one two", "a b c d e", prose(rng, 9), prose(rng, 40), prose(rng, 300), prose(rng, 5000)):
        w, first = word_hashes([text.encode()])
        spans = [w[i : i + 5] for i in range(max(1, len(w) - 4))] if len(w) else []
        bins: dict[int, int] = {}
        for span in spans:
            x = int(minhash.shingle_hashes(span, np.array([0, len(span)]), 5)[0][0])
            b = x >> 55
            bins[b] = min(x, bins.get(b, x))
        want = "".join(f"{bins[b if b in bins else next(d for d in minhash._ORDER[b].tolist() if d in bins)] & 15:x}" for b in range(512)) if bins else ""
        assert minhash.pack(minhash.sketch([text.encode()])) == [want]


def test_many_short_texts_are_quick_and_small():
    import time
    import tracemalloc

    texts = [b"some text %d" % i for i in range(20_000)] + [b""] * 20_000
    began = time.perf_counter()
    tracemalloc.start()
    for part in minhash.blocks([len(t) + minhash.EACH for t in texts], minhash.BLOCK):
        minhash.sketch(texts[part])
    assert tracemalloc.get_traced_memory()[1] < 200e6 and time.perf_counter() - began < 60
    tracemalloc.stop()


def test_likeness_estimates_jaccard():
    rng = random.Random(1)
    a = [prose(rng, 1) + str(i) for i in range(2000)]
    for share in (0.2, 0.6, 0.9):
        b = a[: int(2000 * share)] + [x + "b" for x in a[int(2000 * share) :]]
        x, y = {tuple(a[i : i + 5]) for i in range(1996)}, {tuple(b[i : i + 5]) for i in range(1996)}
        v = minhash.sketch([" ".join(a).encode(), " ".join(b).encode()])
        assert np.array_equal(minhash.unpack(minhash.pack(v)), v)
        assert abs(minhash.likeness(v[:1], v[1:])[0] - len(x & y) / len(x | y)) < 0.09


def test_densification_takes_the_first_full_bin():
    rng = np.random.default_rng(2)
    least, full = rng.integers(0, 99, (6, minhash.BINS)).astype(np.uint64), np.zeros((6, minhash.BINS), bool)
    for i, n in enumerate((1, 2, 30, 200, 512, 0)):
        full[i, rng.permutation(minhash.BINS)[:n]] = True
    dense = minhash.densify(least, full)
    for i in range(5):
        for b in range(minhash.BINS):
            donor = b if full[i, b] else next(d for d in minhash._ORDER[b] if full[i, d])
            assert dense[i, b] == least[i, donor]


# --- 4 ---------------------------------------------------------------------------------------------------------------


def simhash_brute(t):
    w = bytes(c + 32 if 65 <= c < 91 else c for c in (t or "").encode()).split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_near_duplicates(docs, rows, none):
    out = simhash.near_duplicates(docs).collect()
    fp = [simhash_brute(r[1]) for r in rows]
    label = [i for i in range(len(rows))]
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if (fp[i] ^ fp[j]).bit_count() <= 3) for i in range(len(rows))]
    ids = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in label}
    want = sorted(((r[0], f"{f:016x}", ids[c]) for r, f, c in zip(rows, fp, label)), key=str)
    assert sorted(map(tuple, out), key=str) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert simhash.near_duplicates(none).count() == 0


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(11)
    apart = [prose(rng, 80) for _ in range(7)]
    texts = [(None, apart[0]), (None, apart[1]), (None, apart[2]), (None, apart[2]), (7, apart[3]), (7, apart[4]), (9, apart[5]), (None, apart[5]), (8, apart[5]), (6, None), (6, ""), (None, apart[6].upper()), (None, apart[6])]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(texts)], "doc_id long, text string, n long")
    want = [(None, apart[0], 0), (None, apart[1], 1), (None, apart[2], 2), (7, apart[3], 4), (7, apart[4], 5), (8, apart[5], 8), (6, None, 9), (None, apart[6].upper(), 11)]
    for parts in (1, 5):
        assert sorted(map(tuple, simhash.drop_near_duplicates(df.repartition(parts)).collect()), key=str) == sorted(want, key=str)


def test_pairs_are_found_and_exact(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << p for p in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 4)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    want = {tuple(sorted((a, b))) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    for width in (None, 1, 2):
        assert {tuple(sorted((r["u"], r["v"]))) for r in simhash.near_pairs(spark.createDataFrame(signed, "fp long"), width).collect()} == want


# --- 5 ---------------------------------------------------------------------------------------------------------------


def repeats_brute(rows):
    ws = [words(r[1]) for r in rows]
    seen = Counter(b" ".join(w[i : i + 35]) for w in ws for i in range(len(w) - 34))
    out = []
    for r, w in zip(rows, ws):
        drop = {j for i in range(len(w) - 34) if seen[b" ".join(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in drop)
        out.append((r[0], len(w), len(drop), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 1])
def test_substrings(docs, rows, none, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    got = substring.dedup_substrings(docs).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == repeats_brute(rows)
    cut = substring.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert substring.dedup_substrings(none).count() == 0


def test_matching_statistics():
    rng = np.random.default_rng(1)
    for _ in range(12):
        frags = [rng.integers(0, 4, rng.integers(5, 40)).astype(np.uint64) for _ in range(rng.integers(1, 9))]
        frags.append(frags[0].copy())
        weights = rng.integers(1, 3, len(frags))
        for f, m in zip(frags, substring.FMIndex(frags, weights).matches()):
            for s in range(len(f)):
                n = 0
                while s + n < len(f) and sum(w for g, w in zip(frags, weights) for j in range(len(g) - n) if (g[j : j + n + 1] == f[s : s + n + 1]).all()) >= 2:
                    n += 1
                assert n == m[s]


# --- 6 ---------------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    big = "<p>é " + "word " * 300_000
    pages = [(1, "http://a/", "<b>x</b>"), (2, None, "<b>x</b>"), (3, "http://b/\r\nX: y", None), (4, "u", ""), (5, "u", big), (5, "u", big), (6, "u", "once"), (None, "u", "once")]
    pages += [(2**62 + 1, "u", "large"), (2**62 + 3, "u", "large"), (2**62 + 3, "v", "other"), (None, "u", "alone"), (None, "u", "alone"), (7, "u", "large")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))
    index = warc.write_archives(df, str(tmp_path / "w"))
    got = warc.read_archives(index).collect()
    top = {}
    for p, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h in pages:
        raw = (h or "").encode()
        first = (-1 if p is None else p) == top[h or ""]
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else top[h or ""], raw if first else None))
    out = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(out, key=str) == sorted(want, key=str)
    for r in index.collect():  # one record by its place alone, in a frame that the seek table names
        assert warc.read_at(r["bundle"], r["frame_offset"], r["frame_bytes"], r["record_offset"], r["record_bytes"])[0] == r["page_id"]
        assert (r["frame_offset"], r["frame_bytes"]) in {(a, c) for a, c, _ in warc.read_seek_table(r["bundle"])}
    assert warc.read_archives(warc.write_archives(df.where("false"), str(tmp_path / "e"))).count() == 0
    assert index.select("record_id").distinct().count() == len(pages)
    named = {r["record_id"] for r in index.collect()}
    first = index.where("page_id = 1").first()
    raw = warc.zstandard.ZstdDecompressor().decompress(warc._read(first["bundle"], first["frame_offset"], first["frame_bytes"]))
    assert any(f"WARC-Refers-To: {i}".encode() in raw for i in named)
    apart = warc.read_archives(warc.write_archives(df, str(tmp_path / "m"), revisit_bytes=100), payloads=False)
    assert {r["page_id"] for r in apart.where("record_type = 'revisit'").collect()} <= {5}


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_ids_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    texts = ["", " a", "a ", "a  b", "x\n y", "a\t b", "naïve 日本 <|endoftext|> x", "<|endoftext|>", "it's 's  'll", "of, the of, the", "  x 　y", "é a\x1c b"]
    t = Tokenizer.from_file(packing.vocabulary())
    ids = packing.Ids(packing.vocabulary())
    for _ in range(2):
        assert ids.of(texts) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing(docs, rows, none):
    import zlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    got = packing.pack(docs).collect()
    pieces = Counter()
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        raw, start, n = np.array(ids, "<u4").tobytes(), 0, -(-len(ids) // 2048)
        for i in range(n):
            end = len(ids) - (n - 1 - i) * 2048
            pieces[(r[0], i, start, end - start, zlib.crc32(raw[4 * start : 4 * end]))] += 1
            start = end
    assert Counter(tuple(r)[:5] for r in got) == pieces
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack(none).count() == 0


def test_local_search_empties_bins():
    rng = np.random.default_rng(0)
    for lo, hi, better in ((1, 100, 0), (300, 900, 1), (500, 1400, 1), (1, 2047, 0)):
        sizes = rng.integers(lo, hi, 600)
        first = packing.best_fit(sizes, 2048, packing.coarse_order(sizes))
        after, exchanges = packing.local_search(sizes, first, 2048)
        fill, was = np.bincount(after, sizes), np.bincount(first, sizes)
        assert fill.max() <= 2048 and (fill > 0).sum() <= (was > 0).sum() and (fill**2).sum() >= (was**2).sum()
        assert exchanges > 0 or (was > 0).sum() == packing.lower_bound(sizes, 2048)
        where, _ = packing.search(sizes, 2048)
        assert packing.lower_bound(sizes, 2048) <= where.max() + 1 <= packing.best_fit(sizes, 2048).max() + 1 - better
    swap = np.array([6, 5, 4, 3, 2])  # 6+4 and 5+3+2 fill two bins
    assert len(np.unique(packing.local_search(swap, np.array([0, 1, 1, 0, 2]), 10)[0])) == 2
    assert packing.search(np.empty(0, np.int64), 2048)[0].size == 0 and packing.search(np.array([2047]), 2048)[0].tolist() == [0]


def test_every_kind_of_exchange():
    kinds = {"move": ([3, 9], [0, 1], 12), "one for one": ([5, 7, 4], [0, 1, 1], 12), "one for two": ([5, 7, 2, 2], [0, 1, 1, 1], 12), "two for one": ([3, 2, 7, 4], [0, 0, 1, 1], 12)}
    for kind, (sizes, where, length) in kinds.items():
        bins = packing.Bins(np.array(sizes), np.array(where), length)
        bins._leave(0)
        give, to, take = bins.best(0)
        assert to == 1 and (len(give), len(take)) == {"move": (1, 0), "one for one": (1, 1), "one for two": (1, 2), "two for one": (2, 1)}[kind], kind
        before = sum(f * f for f in bins.fill)
        bins.shift(0, give, to, take)
        assert sum(f * f for f in bins.fill) > before and max(bins.fill) <= length


def test_search_decides_the_packing_of_the_tables(spark):
    lengths = packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("length").toPandas()["length"].to_numpy()
    lengths = lengths[lengths < 2048]
    where, exchanges = packing.local_search(lengths, packing.best_fit(lengths, 2048, packing.coarse_order(lengths)), 2048)
    assert exchanges > 0 and len(np.unique(where)) == packing.lower_bound(lengths, 2048) < packing.best_fit(lengths, 2048, packing.coarse_order(lengths)).max() + 1


# --- 8, 9 ------------------------------------------------------------------------------------------------------------


def test_quality(spark, docs, rows, none):
    rng = random.Random(7)
    texts = [(i, prose(rng, 60) if i % 2 else "SPAM!! " * 30) for i in range(200)] + [(500, None), (501, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(3, 1), (None, 1), (7, None), (9999, 1)], "doc_id long, quality int")
    model = quality.train(df, labels, use=~quality.held_out("doc_id", 3, 1))
    out = quality.score(df, model).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in out if r["doc_id"] < 200) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["doc_id"] % 2 for r in quality.keep_good(df, labels).where("doc_id < 200").collect()} == {1}
    assert quality.score(docs, model, into="s").count() == len(rows)
    assert quality.score(none, quality.train(none, labels), into="s").count() == 0


def test_dual_descent_separates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.2, 1.0, -1.0)
    w, b = quality.descend([np.array([0, 1])] * 120, list(x), y, 2, cost=10.0, epochs=200)
    assert ((x @ w + b > 0) == (y > 0)).mean() > 0.97


def test_dual_descent_ends_at_the_minimum():
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(40, 3)), np.where(rng.random(40) > 0.5, 1.0, -1.0)
    w, b = quality.descend([np.arange(3)] * 40, list(x), y, 3, cost=0.7, epochs=4000)
    cost = lambda w, b: 0.5 * (w @ w + b * b) + 0.7 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    least = cost(w, b)
    for scale in (1e-3, 1e-2, 0.1, 1):
        for _ in range(200):
            assert cost(w + scale * rng.normal(size=3), b + scale * rng.normal()) > least - 0.01  # it ends at steps below 1e-3


def test_quality_model_by_hand():
    texts = [b"good words here", b"good fine words", b"BUY!! now now", b"BUY!! cheap", b"fine words", b"now!! BUY!! x"] * 12
    label = np.array([1, 1, 0, 0, 1, 0] * 12)
    feature, at = quality.features(texts)
    rows = [feature[i:j] for i, j in zip(at, at[1:])]
    model = quality.fit(rows, label)
    fitted = [i for i in range(len(rows)) if i % 5]
    up, down = Counter(f for i in fitted if label[i] for f in rows[i].tolist()), Counter(f for i in fitted if not label[i] for f in rows[i].tolist())
    ups, downs = sum(up.values()) + quality.DIM, sum(down.values()) + quality.DIM
    for f in {f for r in rows for f in r.tolist()}:
        ratio = np.log((up[f] + 1) / ups) - np.log((down[f] + 1) / downs)
        assert abs(model.square[f] - ratio**2) < 1e-4 * (1 + ratio**2)
    assert ((model.scores(texts) >= 0.5) == (label == 1)).all()


def test_language(spark, docs, rows, none):
    rng = random.Random(9)
    make = {"aa": ["nation", "other", "thing"], "bb": ["strasse", "kinder", "nicht"]}
    texts = [(i, " ".join(rng.choice(make[k]) for _ in range(30)), k) for i in range(60) for k in make] + [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None), (903, "Nation" * 400, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    out = language.identify(df, language.train(df, use=~quality.held_out("doc_id", 4, 2))).collect()
    by = {(r["doc_id"], r["lang_pred"]) for r in out}
    assert all((i, k) in by for i, _, k in texts[:120]) and (900, "und") in by and (901, "und") in by and (902, "und") in by and (903, "aa") in by
    assert language.identify(docs, language.train(docs)).count() == len(rows)
    many = [(i, " ".join(chr(97 + i % 26) * 2 + chr(97 + i // 26) for _ in range(20)), f"l{i:03d}") for i in range(300)]
    all_of = language.train(spark.createDataFrame(many, "doc_id long, text string, lang string"))
    assert all_of.languages == [k for _, _, k in many] and language.identify(spark.createDataFrame(many, "doc_id long, text string, lang string"), all_of).join(spark.createDataFrame(many, "doc_id long, t string, lang string"), "doc_id").where("lang = lang_pred").count() > 290
    assert language.identify(none, language.train(none)).count() == 0


def test_forward_sums_all_segmentations():
    number = {"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4}
    p = np.array([[0.1], [0.2], [0.3], [0.15], [0.25]])
    table, known = language._rows(p), language.Pieces(number)

    def brute(s):
        if not s:
            return 1.0
        total = sum(p[number[s[:n]], 0] * brute(s[n:]) for n in range(1, len(s) + 1) if s[:n] in number)
        return total + (1e-7 * brute(s[1:]) if s[0] not in number else 0)

    for w in ("a", "ab", "abab", "bca"):
        assert abs(np.log(brute("▁" + w)) - language.word_scores([w], known, table)[0, 0]) < 1e-9
    long = "abcab" * 300
    a = [1.0]
    for end in range(1, len(long) + 2):  # in whole numbers' stead: logs of the same sums
        s = "▁" + long
        terms = [a[end - n] + np.log(p[number[s[end - n : end]], 0]) for n in (1, 2) if n <= end and s[end - n : end] in number]
        terms += [a[end - 1] + np.log(1e-7)] if s[end - 1] not in number else []
        a.append(np.logaddexp.reduce(terms) if end > 1 else np.log(0.1) + 1.0)
    assert abs(a[-1] - 1.0 - language.word_scores([long], known, table)[0, 0]) < 1e-6
    assert abs(language.run_score("▁abab", known, table, block=2)[0] - language.word_scores(["abab"], known, table)[0, 0]) < 1e-12
    used = language.expectation(["▁ab"], np.ones((1, 1)), known, table)[:, 0]
    assert abs(used[0] + used[4] - 1) < 1e-9  # each segmentation has the mark once


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [])]
    v += [(40, v[40][1]), (20, [0.0] * 8), (305, [1.0, 2.0]), (306, [1e9] * 8)] + [(400 + i, v[7][1]) for i in range(30)]
    v += [(2**62 + 1, v[3][1]), (2**62 + 3, v[3][1]), (None, v[3][1]), (None, v[9][1]), (2**62 + 16, v[5][1])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumn("row", F.lit(1))
    good = [(i, [int(np.floor(64 * x)) for x in e] + [0] * (8 - len(e))) for i, e in v if e and all(x is not None and np.isfinite(x) for x in e)]
    for asks, picked in (((F.col("vec_id") % 20 == 0), lambda i: i is not None and i % 20 == 0), (F.col("vec_id").isNull() | (F.col("vec_id") > 2**61), lambda i: i is None or i > 2**61)):
        got = topk.top_k(df, asks).collect()
        want = []
        for q, (i, e) in enumerate(good):
            if picked(i):
                s = sorted((-sum(a * b for a, b in zip(e, f)), j is not None, j or 0) for r, (j, f) in enumerate(good) if r != q)[:20]
                want += [(i, k + 1, j if some else None, -x) for k, (x, some, j) in enumerate(s)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and want
    assert topk.top_k(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_stops_early_and_stays_exact():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    dense = np.floor(64 * (centres[rng.integers(0, 40, 6000)] + 0.01 * rng.normal(size=(6000, 32)))).astype(np.int64)
    sparse = (rng.integers(1, 60, (6000, 32)) * (rng.random((6000, 32)) < 0.06)).astype(np.int64)
    uneven = np.floor(64 * rng.normal(size=(6000, 32)) * 0.5 ** np.arange(32)).astype(np.int64)
    for v, share in ((dense, 0.7), (sparse, 0.2), (uneven, 0.2)):
        block = topk.Block(np.arange(6000), np.arange(6000), v)
        picked = np.flatnonzero((v != 0).any(axis=1))[:60]
        for r in picked:
            at, scores, _ = block.search(int(r), v[r], 20)
            s = v @ v[r]
            best = [i for i in np.lexsort((np.arange(6000), -s)) if i != r][:20]
            assert at.tolist() == best and scores == s[best].tolist()
        assert topk.shares_scored(v, picked).mean() < share
    alone = np.floor(64 * rng.normal(size=(4000, 64))).astype(np.int64)  # nothing is near anything: no exact search can stop
    assert topk.shares_scored(alone, np.arange(10)).min() > 0.9


def test_greatest_product_is_the_constrained_maximum():
    rng = np.random.default_rng(6)
    for _ in range(200):
        w, edge = rng.random(5) + 0.1, rng.normal(size=5)
        norm = float(np.sqrt((np.minimum(edge, 0) ** 2).sum())) + rng.random() * 2
        best, _ = topk.greatest_product(w, edge, norm)
        x = np.minimum(edge, rng.normal(size=(20000, 5)) * rng.random((20000, 1)) * 2)
        x = x[(x**2).sum(axis=1) <= norm**2]
        assert best <= w @ edge + 1e-9 and (not len(x) or (x @ w).max() <= best + 1e-9)


# --- words -----------------------------------------------------------------------------------------------------------


def test_word_hashes_depend_on_the_word_alone():
    long = b"w" * 3_000_000
    texts = [b"", b" a b ", b"b a", long, b"a " * 700_000, b"\xc3\xa9 a"]
    h, first = word_hashes(texts)
    assert np.diff(first).tolist() == [0, 2, 2, 1, 700_000, 2]
    a, b = h[first[1]], h[first[1] + 1]
    assert h[first[2]] == b and h[first[2] + 1] == a and (h[first[4] : first[5]] == a).all() and h[first[5] + 1] == a
