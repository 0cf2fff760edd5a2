"""Queries and stages that once did less than their whole job."""

import hashlib
import os
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from loomgraph import queries as Q  # noqa: E402
from loomgraph.graph import from_tables  # noqa: E402
from loomgraph.llm.langid import fit_languages, identify  # noqa: E402

MID = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(MID), reason="no test tables")
def test_match_mutual_best_keeps_every_pair(spark):
    best = {}
    for r in Q.window_costs(from_tables(spark, MID)).select("i", "j", "cost").collect():
        for a, b in ((r.i, r.j), (r.j, r.i)):
            best[a] = min(best.get(a, (r.cost, b)), (r.cost, b))
    want = sorted((a, b, c) for a, (c, b) in best.items() if a < b and best[b][1] == a)
    assert len(want) > 2000
    assert sorted(tuple(r) for r in entry.queries()["match_mutual_best"](spark, MID).select("i", "j", "cost").collect()) == want


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("bcdefghk") for _ in range(6)) for _ in range(900)]
    text = lambda n=60: " ".join(rng.choice(vocab) for _ in range(n))
    near = lambda first: " ".join([first, *a.split()[1:]])
    a, p, h, leak = text(), text(), text(), text(20)
    leaky = lambda first: f"{first} {text(30)} {leak} {text(30)}"
    docs = [(1, a), (2, a), (3, near("aaa")), (3, "zzz " + text()), (4, "aaa " + text()), (4, near("zzz")), (None, near("mmm")), (None, text())]
    docs += [(None, leaky("null")), (5, leaky("five")), (5, "clean " + text()), (7, h), (7, h), (None, p), (8, p), (9, p), (6, ""), (None, None), (10, leaky("ten"))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (1, 2, 8, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
    left = [d for d, (_, _, _, kept) in zip(left, brute.op2([(k, t) for k, (_, t) in enumerate(left)]), strict=True) if kept]
    cut = [(i, bytes(x for x, g in zip(u, gone) if not g).decode("utf-8", "ignore")) for i, u, gone in brute.repeats([d for d in left if d[0] is not None], 50, lambda t: t.encode(), bytes)]
    cut += [(None, t or "") for i, t in left if i is None]
    clean = [d for d in cut if not any(r[-1] for r in brute.op9([d], [(1, leak)]))]
    assert len(docs) > len(left) > len(clean)
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "decoded_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, hashlib.sha256(t.encode()).hexdigest())) for i, t in clean)


def test_a_rare_language_is_learned(spark):
    rng = random.Random(6)
    word = lambda parts: "".join(rng.choice(parts) for _ in range(3))
    docs = [(k, " ".join(word(["ba", "do", "mi"]) for _ in range(12)), "aa") for k in range(4000)]
    docs += [(5000 + k, " ".join(word(["schr", "ung", "ö"]) for _ in range(12)), "bb") for k in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = fit_languages(df, sample=40)
    assert model.languages == ["aa", "bb"]
    assert model.prior[0] - model.prior[1] > 6  # shares of all texts, not of the samples
    got = {r.doc_id: r.lang_pred for r in identify(df, model).collect()}
    assert all(got[i] == lang for i, _, lang in docs)
