"""The operators against plain versions of their contracts, on a table with nulls, empty and long texts, ties, repeats and
columns that clash with names used inside."""

import json
import math
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from loomgraph.llm.chat import format_chat  # noqa: E402
from loomgraph.llm.decontam import decontaminate  # noqa: E402
from loomgraph.llm.langid import fit_languages, identify  # noqa: E402
from loomgraph.llm.lm import backoff_scores  # noqa: E402
from loomgraph.llm.minhash import near_duplicates  # noqa: E402
from loomgraph.llm.quality import quality_rules  # noqa: E402
from loomgraph.llm.substring import substring_dedup  # noqa: E402
from loomgraph.llm.suffix import suffix_dedup  # noqa: E402
from loomgraph.llm.toxicity import Grammar, fit_grammar, toxicity_scores  # noqa: E402


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [text(120) for _ in range(6)]
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "One  TWO"), (5, "a " * 300), (6, "a\n" * 40 + "A!!"), (7, text(4000))]
    passage = text(30)
    for b in base:
        for _ in range(5):
            w = b.split()
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs) + k, text(40) + "\n" + passage + ".\n" + text(20)) for k in range(8)]
    docs += [(len(docs) + k, docs[9][1]) for k in range(3)]
    return docs


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def table(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], "doc_id long, text string, score string, shard int, __block string")
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_substring(table, docs, empty):
    cols = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert rows(substring_dedup(table, block_bytes=4000, shard_keys=500).select(*cols)) == brute.op10(docs)
    assert rows(substring_dedup(empty)) == []


def test_suffix(table, docs, empty):
    assert rows(suffix_dedup(table, block_bytes=4000, shard_bytes=4000).drop("kept")) == brute.op7(docs)
    assert rows(suffix_dedup(empty)) == []


def test_repeated_and_missing_ids(spark):
    t = "the same words come again and again in this text, so that it is long enough to count here"
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup(df).collect()) == [(0, 0), (1, 0), (1, 0), (2, len(t))]
    assert sorted((r.doc_id or 0, r.n_removed > 0) for r in substring_dedup(df).collect()) == [(0, False), (1, False), (1, False), (2, True)]


def test_near_duplicates(table, docs, empty):
    assert rows(near_duplicates(table)) == brute.op2(docs)
    assert rows(near_duplicates(empty)) == []


def test_quality(table, docs, empty):
    got = rows(quality_rules(table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == brute.op6(docs)
    assert rows(quality_rules(empty)) == []


@pytest.mark.parametrize("limit", [10**6, 0])
def test_decontamination(spark, table, docs, empty, limit):
    items = [(1, " ".join(docs[9][1].split()[5:25])), (2, "one two"), (3, None), (4, ""), (None, "a a a"), (5, docs[40][1]), (5, docs[40][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(rows(decontaminate(table, bench, broadcast_rows=limit)), key=str) == brute.op9(docs, items)
    assert rows(decontaminate(empty, bench)) == []


@pytest.mark.parametrize(("order", "few"), [(3, 48), (3, 0), (2, 48), (1, 48), (4, 10**6)])
def test_lm(table, docs, empty, order, few, monkeypatch):
    from loomgraph.llm import lm

    monkeypatch.setattr(lm, "FEW", few)
    got = {r.doc_id: r for r in backoff_scores(table, order=order, prior=7.0, block_bytes=4000, shard_keys=200).collect()}
    tokens = {i: [*brute.WORD.findall(brute.lower(t or "")), 0] for i, t in docs}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    seen = Counter()
    for t in train:
        flow = ["s", *t]
        for k in range(1, order + 1):
            seen.update(tuple(flow[a : a + k]) for a in range(len(flow) - k + 1))
    seen[("s",)] = len(train)
    n, v = sum(map(len, train)), len({w for t in train for w in t})

    def p(h, w):
        if not h:
            return (seen[(w,)] + 0.5) / (n + 0.5 * (v + 1))
        return (seen[(*h, w)] + 7 * p(h[1:], w)) / (seen[h] + 7)

    for i, t in tokens.items():
        r, flow = got[i], ["s", *t]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(seen[(w,)] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10(p((), w)) for w in t), rel_tol=1e-8)
        assert math.isclose(r.score, sum(math.log10(p(tuple(flow[max(0, k - order + 1) : k]), w)) for k, w in enumerate(flow) if k), rel_tol=1e-8)
    assert rows(backoff_scores(empty)) == []


def test_bpe_equals_the_library():
    import base64

    import public_tokenizers as P
    import tiktoken

    from loomgraph.llm.bpe import Bpe

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    ours, theirs = Bpe(ranks, P.PATTERN, pieces=100, neighbours=100), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", "a" * 5000, "the" * 900, " " * 50, *(t for _, t in corpus() if t)]
    texts += ["".join(rng.choice("ab cdeéß 中文\n\t'sStTllre0123  \x1c\x85\xa0\U0001f600.,!?-") for _ in range(40)) for _ in range(2000)]
    for t in texts:
        ids = ours.encode(t)
        assert ids.tolist() == theirs.encode_ordinary(t)
        assert ours.decode(ids) == t.encode()


def test_language(spark, empty):
    rng = random.Random(1)
    syllables = {"aa": ["ba", "do", "mi"], "bb": ["schr", "ung", "ö"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(3))
    rows_ = [(k, " ".join(word(lang) for _ in range(30)), lang) for k, lang in enumerate(["aa", "bb"] * 40)]
    df = spark.createDataFrame([*rows_, (900, None, None), (901, "12 !", "aa"), (902, "", "bb")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(df, fit_languages(df.where("doc_id < 40"))).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows_)
    assert {got[k].lang_pred for k in (900, 901, 902)} == {"und"} and got[900].score == 0
    assert rows(identify(empty, fit_languages(df.where("false")))) == []


def test_toxicity_grammar(spark, empty):
    words = ["calm", "river", "stone", "light", "paper"]
    rng = random.Random(2)
    clean = [" ".join(rng.choice(words) for _ in range(20)) + "." for _ in range(40)]
    docs_ = [(k, t) for k, t in enumerate(clean)] + [(100 + k, f"{t} You are a zorgon{'abc'[k % 3]}.") for k, t in enumerate(clean)]
    df = spark.createDataFrame([*docs_, (500, None), (501, ""), (502, "He said that you are no zorgona.")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in docs_ if i % 2], "doc_id long, toxic int")
    grammar = fit_grammar(df, labels)
    assert any(s.startswith(b"zorgon") for s in grammar.stems)
    got = {r.doc_id: r for r in toxicity_scores(df, grammar).collect()}
    assert all(got[i].predicted == int(i >= 100) for i, _ in docs_)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[500].score == got[501].score
    assert got[502].score < got[100].score
    assert rows(toxicity_scores(empty, Grammar())) == []


def test_chat(spark):
    call = json.dumps({"tool_calls": [{"id": "a", "name": "add", "arguments": {"y": 2, "x": 1}}, {"id": "b", "name": "nope", "arguments": {}}], "content": "wait"})
    late = json.dumps({"tool_calls": [{"id": "q", "name": "add", "arguments": '{"x": "s", "w": 1}'}]})
    table_ = [(1, 0, "user", "hi"), (1, 1, "assistant", call), (1, 2, "tool", '{"tool_call_id":"a","content":"3"}'), (2, 0, "tool", '{"tool_call_id":"z"}'), (2, 1, "tool", '{"tool_call_id":"q"}'), (2, 2, "assistant", late), (3, None, None, None), (4, 0, "user", "{broken"), (4, 0, "user", "")]
    df = spark.createDataFrame(table_, "conv_id long, turn long, role string, text string")
    schemas = spark.createDataFrame([("add", "x", "integer", True), ("add", "y", "number", True)], "name string, param string, type string, required boolean")
    got = [(r.conv_id, r.turn, r.link, r.n_calls, r.n_answered, r.n_invalid) for r in format_chat(df, schemas).orderBy("conv_id", "order_turn", "order_step", F.desc("json")).collect()]
    assert got[:3] == [(1, 0, "message", 0, 0, 0), (1, 1, "call", 2, 1, 1), (1, 2, "result", 0, 0, 0)]
    assert got[3:6] == [(2, 0, "orphan", 0, 0, 0), (2, 2, "call", 1, 1, 1), (2, 1, "result", 0, 0, 0)]
    assert len(got) == len(table_)


def test_components_of_long_chains(spark):
    from loomgraph.llm.components import connected_components

    rng = random.Random(8)
    chain = [(k, k + 1) for k in range(1000)] + [(2000 + 7 * k, 2000 + 7 * k + 7) for k in range(200)]
    far = [(5000 + k, 9000 - k) for k in range(50)] + [(5000 + k, 5001 + k) for k in range(0, 50, 2)]
    rng.shuffle(chain)
    edges = spark.createDataFrame([*chain, *far, (1, 1), (None, 4)], "a long, b long")
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in [*chain, *far]:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert rows(connected_components(edges)) == sorted((x, root(x)) for x in up)


def test_near_duplicates_over_many_tiles(spark, monkeypatch):
    """A large group of near versions, cut into tiles of three, is one component with few links between tiles."""
    from loomgraph.llm import minhash

    rng = random.Random(11)
    vocab = ["".join(rng.choice("bcdfghk") for _ in range(5)) for _ in range(400)]
    base = [rng.choice(vocab) for _ in range(90)]
    docs = []
    for k in range(40):
        w = list(base)
        w[rng.randrange(90)] = rng.choice(vocab)
        docs.append((k, " ".join(w)))
    docs += [(100 + k, " ".join(rng.choice(vocab) for _ in range(60))) for k in range(20)] + [(200, ""), (201, None), (202, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    whole = rows(near_duplicates(df))
    assert whole == brute.op2(docs)
    monkeypatch.setattr(minhash, "TILE", 3)
    monkeypatch.setattr(minhash, "VOLUME", 200)
    assert rows(near_duplicates(df)) == whole


def chat_rows(rng, n=60):
    """Conversations with calls, results before and after them, chains, cycles, orphans, repeated ids and repeated turns."""
    out = []
    for c in range(n):
        for turn in range(rng.randint(1, 12)):
            kind, ids = rng.random(), [f"c{rng.randrange(6)}" for _ in range(2)]
            if kind < 0.3:
                out.append((c, turn, "assistant", json.dumps({"tool_calls": [{"id": i, "name": "add", "arguments": rng.choice([{"x": 1}, {"x": "s"}, "{}"])} for i in ids[: rng.randint(1, 2)]]})))
            elif kind < 0.6:
                body = {"tool_call_id": ids[0], "content": "r"}
                if rng.random() < 0.5:
                    body["tool_calls"] = [{"id": ids[1], "name": "add", "arguments": {"x": 2}}]
                out.append((c, turn, "tool", json.dumps(body)))
            else:
                out.append((c, turn, "user", rng.choice(["hi", "", None, "{bad"])))
            if rng.random() < 0.2 and out[-1][3]:
                out.append(out[-1])
    return out


def plain_chat(table_):
    """(conv, turn, n_calls, n_answered, n_invalid, link, order_turn, order_step) of each message, by following links one by one."""
    parsed = []
    for k, (c, t, role, text) in enumerate(table_):
        try:
            v = json.loads(text or "") if (text or "").lstrip().startswith("{") else {}
        except ValueError:
            v = {}
        parsed.append((k, c, t, v.get("tool_calls") or [], v.get("tool_call_id") if role == "tool" else None))
    first = {}
    for k, c, t, calls, _ in parsed:
        for call in calls:
            key = c, call["id"]
            if key not in first or (t, k) < first[key]:
                first[key] = t, k
    answered = {(c, r) for _, c, _, _, r in parsed if r is not None}
    up = {k: first[c, r][1] for k, c, _, _, r in parsed if r is not None and (c, r) in first}
    turn = {k: t for k, _, t, _, _ in parsed}

    def place(k):
        seen = []
        while k in up and k not in seen:
            seen.append(k)
            k = up[k]
        if k in seen:
            return None
        at = (turn[k], 0)
        for m in reversed(seen):
            at = (turn[m], 0) if turn[m] > at[0] else (at[0], at[1] + 1)
        return at

    out = []
    for k, c, t, calls, r in parsed:
        bad = sum(not isinstance(json.loads(x["arguments"]) if isinstance(x["arguments"], str) else x["arguments"], dict) or (json.loads(x["arguments"]) if isinstance(x["arguments"], str) else x["arguments"]).get("x") not in (1, 2) for x in calls)
        at = place(k)
        link = ("orphan" if k not in up else "cycle" if at is None else "result") if r is not None else "call" if calls else "message"
        turn_, step = at if k in up and at else (t, 0)
        out.append((c, t, len(calls), sum((c, x["id"]) in answered for x in calls), bad, link, turn_, step))
    return sorted(out)


def test_chat_against_a_plain_version(spark):
    table_ = chat_rows(random.Random(21))
    df = spark.createDataFrame(table_, "conv_id long, turn long, role string, text string").coalesce(1)
    schemas = spark.createDataFrame([("add", "x", "integer", True)], "name string, param string, type string, required boolean")
    got = sorted(tuple(r) for r in format_chat(df, schemas).select("conv_id", "turn", "n_calls", "n_answered", "n_invalid", "link", "order_turn", "order_step").collect())
    want = plain_chat(table_)
    assert {"orphan", "cycle", "result", "call", "message"} <= {r[5] for r in want} and max(r[7] for r in want) > 1
    assert got == want


def test_chat_chain_of_two_and_odd_tables(spark):
    call = lambda i: json.dumps({"tool_calls": [{"id": i, "name": "add", "arguments": {"x": 1}}]})
    both = json.dumps({"tool_call_id": "b", "tool_calls": [{"id": "a", "name": "add", "arguments": {"x": 1}}]})
    rows_ = [(1, 1, "tool", '{"tool_call_id":"a"}'), (1, 2, "tool", both), (1, 5, "assistant", call("b"))]
    schema = "conv_id long, turn long, role string, text string"
    schemas = spark.createDataFrame([("add", "x", "integer", True)], "name string, param string, type string, required boolean")
    extra = spark.createDataFrame([(*r, 1, "k") for r in rows_], schema + ", mid int, link string")
    got = {r.turn: (r.order_turn, r.order_step) for r in format_chat(extra, schemas).collect()}
    assert got == {5: (5, 0), 2: (5, 1), 1: (5, 2)}
    assert format_chat(spark.createDataFrame([], schema), schemas).count() == 0


def test_quality_lines(spark, docs):
    from loomgraph.llm.quality import quality_rules as rules

    own = [*docs, (900, "Home | News | About us\nReal words come here and go on, as they do. " * 8), (901, "see https://a.b/c www.x.y\n" + "good words and more of them, said the man. " * 9), (902, "All Rights Reserved.\n" + "plain text of some length " * 20), (903, "one » two » three\n" * 3 + "words " * 60), (904, "!!!! what ???? !!! no\n" + "calm words " * 40), (905, "*** ### $$$\n" * 10 + "w " * 20), (906, "\n".join(f"a{k} | b{k} | c{k}" for k in range(20)) + "\nand then some plain words."), (907, "All rights reserved.\n" + docs[8][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in own], "doc_id long, text string, kept string").repartition(2)
    got = rows(rules(df).select("doc_id", "base_failed", "lost_words", "kept"))
    assert got == brute.op6_lines(own)
    assert any(r[2] > 0 and r[3] for r in got) and any(r[2] > 0 and not r[3] and not r[1] for r in got)
    cleaned = {r.doc_id: r.cleaned for r in rules(df, with_text=True).collect()}
    assert cleaned[902].startswith("plain text") and "|" not in cleaned[900]


def test_round_trip_through_spark(spark, docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    from loomgraph.llm.bpe import bpe_round_trip

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = [*docs, (None, "no id"), (3, "one two"), (950, "é\U0001f600 " * 9000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in own], "doc_id long, text string, n_tokens int").repartition(2)
    got = sorted(map(str, rows_of(bpe_round_trip(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN))))

    def one(i, t):
        ids = theirs.encode_ordinary(t or "")
        return str((i, len(ids), brute.sha(b"".join(x.to_bytes(4, "little") for x in ids)), brute.sha((t or "").encode())))

    assert got == sorted(one(i, t) for i, t in own)


def rows_of(df):
    return [tuple(r) for r in df.collect()]
