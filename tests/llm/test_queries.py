"""The registered queries: SQL where there is some, and the pipeline."""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import accumulate

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from rowmesh.llm import packing
from rowmesh.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    ours, theirs = (f[sorted(f.columns)].astype(str).replace("nan", "None").sort_values(sorted(f.columns)).reset_index(drop=True) for f in (ours, theirs))
    assert ours.equals(theirs)


@pytest.mark.parametrize("name", ["op8_nb_svm_quality", "op9_unigram_language_id"])
def test_held_out_accuracy(spark, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/" + ("labels" if name.startswith("op8") else "documents") + ".parquet").drop("text").toPandas()
    both = got.merge(truth, on="doc_id")
    both = both[both["held_out"]]
    right = both["predicted"] == both["quality"] if name.startswith("op8") else both["lang_pred"] == both["lang"]
    assert right.mean() > 0.97


def simhash_of(text):
    w = bytes(c + 32 if 65 <= c < 91 else c for c in (text or "").encode()).split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version of what it is to do with the rows that it is given."""
    import corpus_pipeline

    made = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, made[-1], SF)
        assert out.columns == made[0].columns, name
        made.append(spark.createDataFrame(out.collect(), out.schema))
    before, good, single, cut, mixed = [Counter((r["doc_id"], r["text"]) for r in d.collect()) for d in made]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert good <= before
    told = [(k, t) in good for k, t in before if labels.get(k) == 1]
    assert told and sum(told) / len(told) > 0.97

    texts = sorted(good)
    fp = [simhash_of(t) for _, t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert sorted(single) == sorted(texts[g] for g in set(group))

    words = {k: (t or "").encode().split() for k, t in single}
    seen = Counter(b" ".join(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    want = Counter()
    for k, t in single:
        w = words[k]
        drop = {j for i in range(len(w) - 34) if seen[b" ".join(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        want[(k, b" ".join(x for j, x in enumerate(w) if j not in drop).decode() if drop else t)] += 1
    assert cut == want

    size = {k: len((t or "").encode().split()) for k, t in cut}
    source = {r["doc_id"]: r["source"] for r in made[3].collect()}
    assert set(mixed) <= set(cut) and max(mixed.values()) <= 3 and all(size[k] for k, _ in mixed)
    total = sum(size.values())
    assert sum(size[k] * n for (k, _), n in mixed.items()) == pytest.approx(total, rel=0.05)
    for s in set(source.values()):
        own = sum(size[k] for k in source if source[k] == s)
        assert sum(size[k] * n for (k, _), n in mixed.items() if source[k] == s) <= 3 * own

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    pieces = Counter()
    for (k, t), n in mixed.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        raw, start, many = np.array(ids, "<u4").tobytes(), 0, -(-len(ids) // 2048)
        for i in range(many):
            end = len(ids) - (many - 1 - i) * 2048
            pieces[(k, i, start, end - start, zlib.crc32(raw[4 * start : 4 * end]))] += n
            start = end
    packed = corpus_pipeline.pack_sequences(spark, made[-1], SF).collect()
    assert Counter(tuple(r)[:5] for r in packed) == pieces
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        ends = [0, *accumulate(n for _, n in sorted(own))]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048


def test_pipeline(spark):
    import corpus_pipeline

    packed = corpus_pipeline.run(spark, SF)
    assert packed.count() > 0 and packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
