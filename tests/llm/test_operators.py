"""Brute-force and edge-case tests of the training-data operators on small fixtures."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from demandloom.llm import bpe, chat_tools, embedding_dedup, jaccard_join, line_dedup, packing, quality_gam, quality_rules, substring_dedup, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, n long, sig long, key long"


def lower(t):
    return (t or "").lower()


def texts(seed=1, n=60):
    """Documents with exact and near copies, shared passages, repeated lines, empty, null and one-word texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "Re", "no", "li", "ö", "x", "ku,"]) for _ in range(rng.randint(1, 3)))
    passage = " ".join(word() for _ in range(70))
    out = [None, "", " \t\n", "one", "one", "two words"]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2 and len(out) > 8:
            out.append(rng.choice(out[3:]))
        elif kind < 0.45 and len(out) > 8:
            w = (rng.choice(out[6:]) or "a").split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
        else:
            body = "\n".join(" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6)))
            out.append(f"{body} {passage}\n{body[:30]}" if kind > 0.8 else body)
    return out


def frame(spark, rows):
    """Rows (doc_id, text) with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, None, "s", 0, 1, 2, 3, 4) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(texts()))


def components(edges, ids):
    root = {i: i for i in ids}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_jaccard_join_against_all_pairs(spark, rows):
    sets = {}
    for d, t in rows:
        w = WORDS.findall(lower(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(edges, sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == {d: (len(sets[d]), want[d]) for d in sets}
    assert len(set(want.values())) < len(want) - 5


def test_jaccard_join_of_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(150):
        w = list(base)
        for k in range(3):
            w[rng.randrange(120)] = f"e{d}_{k}"
        rows.append((d, " ".join(w)))
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(116)} for d, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    want = components(edges, sets)
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == want


def test_jaccard_join_links_through_null_ids(spark):
    """Texts 1 and 3 differ too much; 2, which links both, has no id."""
    w = [f"w{i}" for i in range(120)]
    one, two, three = w, [*w[:60], "x", *w[61:]], [*w[:30], "y", *w[31:60], "x", *w[61:90], "z", *w[91:]]
    far = [*w[:30], "y", *w[31:60], "x", *w[61:90], "z", *w[91:110], "q", "r", *w[112:]]
    rows = [(i, " ".join(x)) for i, x in ((5, one), (None, two), (None, three), (7, far), (9, ["else"]))]
    got = sorted(((r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 5), (None, 5), (None, 5), (7, 5), (9, 9)], key=str)


def test_jaccard_boundary_follows_cost():
    assert jaccard_join.boundary(1.0) < jaccard_join.boundary(20.0)
    assert jaccard_join.prefix_length(100) == 26


def test_line_dedup_against_all_pairs(spark, rows):
    lines = [(d, i, frozenset(WORDS.findall(lower(x)))) for d, t in rows for i, x in enumerate((t or "").split("\n")) if t is not None]
    lines = [x for x in lines if x[2]]
    gone = collections.defaultdict(set)
    for k, (d, i, s) in enumerate(lines):
        if any(4 * len(s & e) >= 3 * len(s | e) for _, _, e in lines[:k]):
            gone[d].add(i)
    want = {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in rows}
    out = line_dedup.dedup(frame(spark, rows))
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in out.collect()}
    assert got == {d: (want[d], len(gone[d])) for d in want}
    assert sum(map(len, gone.values())) > 20
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_substring_dedup_against_all_windows(spark, rows):
    rows = [*rows, (3, "shared id " * 40)]
    low, want = {}, collections.Counter()
    split = [(d, WORDS.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - 49):
            low[tuple(w[i : i + 50])] = min(d, low.get(tuple(w[i : i + 50]), d))
    for d, w in split:
        keep = [True] * len(w)
        for i in range(len(w) - 49):
            if low[tuple(w[i : i + 50])] < d:
                keep[i : i + 50] = [False] * 50
        kept = " ".join(x for x, k in zip(w, keep) if k)
        want[d, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove(frame(spark, rows)).collect())
    assert got == want
    assert sum(k[2] > 0 for k in want) > 5


def test_bpe_round_trip_and_safe_boundaries(spark, rows):
    long = "x" * 300 + " ".join(t or "" for _, t in rows) * 3 + "   \n\n  tail  "
    rows = [*rows, (900, long), (901, "a  b  c　　d 's'll <|endoftext|> é\U0001f600"), (None, "null id")]
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    out = bpe.encode(frame(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, split_chars=50)
    back = bpe.decode(out, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.token_ids == enc.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")


def test_packing_pieces_and_layout(spark, rows):
    from tokenizers import Tokenizer

    rows = [*rows, (7, rows[8][1]), (None, "x  y"), (800, "word other " * 3000), (801, ""), (802, "a <|endoftext|> b<|endoftext|>"), (803, " <|endoftext|>\n x" * 900)]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [(0, len(ids))] if len(ids) <= 2048 else [(0, first)] + [(a, a + 2048) for a in range(first, len(ids), 2048)]
        for k, (a, b) in enumerate(cuts):
            want[d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = packing.pack(packing.pieces(frame(spark, rows), P.path("byte_bpe_50k.json")), shard_items=16).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048


def test_genetic_algorithm_keeps_items_and_never_gets_worse():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(100, 1200, 300))[::-1]
    start = packing.evolve(sizes, 2048, 1, None, 0, 4)
    end = packing.evolve(sizes, 2048, 1, start, 8, 4)
    for g in end:
        assert np.bincount(g, sizes).max() <= 2048
        assert (np.bincount(g) > 0).all()
    assert packing.fitness(end[0], sizes, 2048) >= packing.fitness(start[0], sizes, 2048)
    assert end[0].max() + 1 >= packing.lower_bound(sizes, 2048)


def hard_sizes(seed):
    """Sixty items, cut from twenty bins with up to 2 % to spare in each, that best-fit decreasing puts into 21."""
    rng, parts = np.random.default_rng(seed), []
    for _ in range(20):
        parts += np.diff(np.r_[0, np.sort(rng.choice(np.arange(100, 900), 2, replace=False)), 1000]).tolist()
    return np.sort([max(1, int(p * (1 - 0.02 * rng.random()))) for p in parts])[::-1].astype("<i4")


@pytest.mark.parametrize("seed", [0, 2, 4])
def test_crossover_saves_bins_that_best_fit_needs(seed):
    sizes = hard_sizes(seed)
    start = packing.evolve(sizes, 1000, seed, None, 0, 8)
    assert min(int(g.max()) + 1 for g in start) == 21
    assert int(packing.evolve(sizes, 1000, seed, start, 40, 8)[0].max()) + 1 == packing.lower_bound(sizes, 1000) == 20


def test_islands_and_migration_reach_the_tables_result(spark):
    """Through Spark: one shard, several islands, the best genome of any of them; more epochs are never worse."""
    sizes = hard_sizes(4)
    table = spark.createDataFrame([(i, int(x)) for i, x in enumerate(sizes)], "doc_id long, length long")
    bins = lambda epochs, generations: packing.pack(table, capacity=1000, islands=3, epochs=epochs, generations=generations, population=8).select("sequence_id").distinct().count()
    assert bins(1, 0) == 21
    assert bins(3, 30) == 20


def vectors():
    rng = np.random.default_rng(2)
    out = []
    base = rng.normal(size=(12, 16))
    for i in range(260):
        b = base[i % 12]
        v = b + rng.normal(size=16) * rng.choice([0.05, 0.12, 0.3, 1.0])
        out.append((i, [float(np.float32(x)) for x in v], i % 3))
    out += [(300 + i, out[5][1], out[5][2]) for i in range(40)]
    out += [(400, None, 1), (401, [], 1), (402, [0.0] * 16, 1), (403, [math.nan] + [1.0] * 15, 1), (404, [math.inf] + [1.0] * 15, 1), (405, [None] + [1.0] * 15, 1), (406, out[5][1], None), (407, [2.0 * x for x in out[5][1]], out[5][2])]
    return out


@pytest.mark.parametrize("chunk", [16, 768])
def test_embedding_links_against_all_pairs(spark, chunk):
    rows = vectors()
    ok = [(i, np.array(v, float), g) for i, v, g in rows if v and g is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    edges = [(a, b) for a, x, g in ok for b, y, h in ok if a < b and g == h and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98]
    comp, degree = components(edges, [r[0] for r in rows]), collections.Counter(i for e in edges for i in e)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, chunk int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.links(df, chunk=chunk).collect()}
    assert got == {i: (degree[i], comp[i], comp[i] == i) for i, _, _ in rows}
    assert len(edges) > 1000


@pytest.mark.parametrize("scale", [1.0, 1e160, 1e-170])
def test_embedding_links_at_any_scale_and_through_null_ids(spark, scale):
    """Vectors 1 and 3 are too far apart; that without an id links both."""
    rows = [(1, 0.0), (None, 0.18), (3, 0.36), (4, 2.0)]
    table = spark.createDataFrame([(i, [scale * math.cos(a), scale * math.sin(a)], 1) for i, a in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.links(table).collect()}
    assert got == {1: (1, 1), None: (2, 1), 3: (1, 1), 4: (0, 4)}


def test_cover_tree_invariants():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = embedding_dedup.build(x)

    def walk(n):
        d = np.linalg.norm(x[n.points] - x[n.centre], axis=1)
        assert d.max() <= n.radius + 1e-6
        if n.kids:
            assert n.kids[0].centre == n.centre
            assert sorted(np.concatenate([k.points for k in n.kids])) == sorted(n.points)
            for k in n.kids:
                assert k.radius <= n.radius + 1e-6
                walk(k)

    walk(tree)


def test_quality_rules_against_brute_force(spark, rows):
    rows = [*rows, (50_000, "aa bb cc dd " * 40), (50_001, "# $ <a> | " * 30), (None, "x y")]
    labels = spark.createDataFrame([(d, 1, 0) for d, _ in rows[10:20]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, rows), labels).collect()}
    for d, t in rows:
        w = WORDS.findall(t or "")
        seen, dup = set(), 0
        for x in (t or "").split("\n"):
            if WORDS.search(x):
                dup += x in seen
                seen.add(x)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)


def test_quality_rules_ratio(spark):
    docs = frame(spark, [(1, "a b a"), (2, "c d")])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    a, b = (spark.range(1).select(F.pmod(F.xxhash64(F.lit(x)), F.lit(512))).first()[0] for x in "ab")
    got = quality_rules.ratios(docs, labels, buckets=512)
    assert got[a] == pytest.approx(math.log(3 / (3 + 512)) - math.log(3 / (5 + 512)))
    assert got[b] == pytest.approx(math.log(2 / (3 + 512)) - math.log(2 / (5 + 512)))


def labelled(n=600):
    rng = random.Random(4)
    good = ["the", "of", "and", "house", "tree", "river", "stone", "green"]
    docs, labels = [], []
    for d in range(n):
        w = [rng.choice(good) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(60, 200))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            w = [x + rng.choice(["###", "$$$", "***"]) for x in w]
        if toxic:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(["grumpf", "blorgh"]) + rng.choice(["", "ed", "ing"])
        docs.append((d, " ".join(w)))
        labels.append((d, int(not bad), int(toxic)))
    return docs, labels


@pytest.mark.parametrize(("score", "label", "mod", "at"), [(toxicity.score, 2, 4, 2), (quality_gam.score, 1, 5, 0)])
def test_classifiers_on_held_out_rows(spark, score, label, mod, at):
    docs, labels = labelled()
    docs = [*docs, (9_000, None), (9_001, ""), (None, "the tree"), (5, docs[5][1])]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = score(frame(spark, docs), lab).collect()
    assert len(got) == len(docs)
    truth, right, n = {r[0]: r[label] for r in labels}, 0, 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == at)
        if r.doc_id in truth and r.held_out:
            n += 1
            right += r.predicted == truth[r.doc_id]
    assert right / n > 0.93
    flipped = [(d, 1 - q, 1 - t) if zlib.crc32(str(d).encode()) % mod == at else (d, q, t) for d, q, t in labels]
    again = score(frame(spark, docs), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.score)
    assert [r.score for r in sorted(got, key=key)] == [r.score for r in sorted(again, key=key)]


CALLS = "conv_id long, turn long, part int, kind string, role string, text string, call_id string, name string, arguments map<string,string>, after array<string>"
TOOLS = {"add": {"x": ("number", True), "y": ("number", True), "note": ("string", False)}}


def test_tool_calls_link_order_and_validate(spark):
    call = lambda t, i, args, after=None, name="add", c=1: (c, t, 0, "call", "assistant", None, i, name, args, after)
    result = lambda t, i, c=1: (c, t, 0, "result", "tool", f"r{i}", i, None, None, None)
    rows = [
        (1, 0, 0, "message", "user", 'say "hi"\n\t\\', None, None, None, None),
        call(1, "a", {"y": "2", "x": "1.5"}, ["b"]),  # needs b, which comes later
        result(2, "a"),
        call(3, "b", {"x": "1", "y": "no"}),
        result(4, "b"),
        call(5, "c", {"x": "1"}),
        call(6, "a", {"x": "1", "y": "2", "z": "3"}),
        result(7, "lost"),
        call(8, None, None, None, "other"),
        call(1, "p", {"x": "1", "y": "2"}, ["q"], c=2), result(2, "p", 2), call(3, "q", {"x": "1", "y": "2"}, ["p"], c=2), result(4, "q", 2),
    ]
    out = chat_tools.link(spark.createDataFrame(rows, CALLS), TOOLS)
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    one = {t: r for (c, t), r in got.items() if c == 1}
    assert [t for t, r in sorted(one.items()) if r.linked] == [1, 2, 3, 4]
    assert one[6].duplicate and not one[5].linked and not one[7].linked
    assert [one[t].valid_arguments for t in (1, 3, 5, 6, 8)] == [True, False, False, False, False]
    assert one[1].json == '{"role":"assistant","tool_call":{"arguments":{"x":1.5,"y":2},"id":"a","name":"add"}}'
    assert one[0].json == '{"content":"say \\"hi\\"\\n\\t\\\\","role":"user"}'
    order = [t for t, r in sorted(one.items(), key=lambda x: (x[1].order_turn, x[1].order_level, x[0]))]
    assert order.index(3) < order.index(4) < order.index(1) < order.index(2) < order.index(5)
    assert not any(r.cyclic for r in one.values())
    assert all(got[2, t].cyclic for t in (1, 2, 3, 4))


def test_tool_calls_are_canonical_json(spark):
    import json

    tools = {"f": {k: (k.rstrip("12"), False) for k in ("number", "number1", "number2", "integer", "boolean", "object", "object1", "array", "string")}}
    args = {"number": "1.50", "number1": "1e2", "number2": "007", "integer": "-0", "boolean": "no", "object": '{"b": 1.50, "a": [true, {"d": null, "c": "\u00e9\\n"}]}', "object1": "{not json}", "array": '[1,  2.0, "x"]', "string": 'say "hi"\x01'}
    rows = [(1, 0, 0, "call", "assistant", None, "i", "f", args, None), (1, 1, 0, "call", "assistant", None, "j", "unknown", {"x": "1"}, None), (1, 2, 0, "call", None, None, None, "f", None, None), (1, 3, 0, "call", "assistant", None, "k", "f", {"number": "12.0", "integer": "12", "boolean": "true"}, None)]
    got = {r.turn: r for r in chat_tools.link(spark.createDataFrame(rows, CALLS), tools).collect()}
    assert got[0].json == '{"role":"assistant","tool_call":{"arguments":{"array":[1,2,"x"],"boolean":"no","integer":0,"number":1.5,"number1":100,"number2":"007","object":{"a":[true,{"c":"é\\n","d":null}],"b":1.5},"object1":"{not json}","string":"say \\"hi\\"\\u0001"},"id":"i","name":"f"}}'
    assert [got[t].valid_arguments for t in range(4)] == [False, False, False, True]
    assert all(json.loads(r.json) for r in got.values())


def test_long_cycles_and_chains_of_tool_calls(spark):
    """A cycle of 1,000 calls, a call behind it, and a chain of 300 calls in reverse order."""
    call = lambda c, t, i, after: (c, t, 0, "call", "assistant", None, str(i), "add", None, after)
    result = lambda c, t, i: (c, t, 0, "result", "tool", "r", str(i), None, None, None)
    rows = [x for i in range(1000) for x in (call(1, 2 * i, i, [str((i + 1) % 1000)]), result(1, 2 * i + 1, i))]
    rows += [call(1, 5000, "behind", ["3"]), result(1, 5001, "behind"), call(1, 6000, "free", None)]
    rows += [x for i in range(300) for x in (call(2, 2 * i, i, [str(i + 1)] if i < 299 else None), result(2, 2 * i + 1, i))]
    got = {(r.conv_id, r.turn): r for r in chat_tools.link(spark.createDataFrame(rows, CALLS), TOOLS).collect()}
    assert {t for (c, t), r in got.items() if c == 1 and not r.cyclic} == {6000}
    # The last result, at turn 599, frees all others one after the other.
    assert [(got[2, 2 * i].order_turn, got[2, 2 * i].order_level) for i in range(300)] == [(599, 2 * (299 - i) - 1) for i in range(299)] + [(598, 0)]
    assert not any(r.cyclic for (c, _), r in got.items() if c == 2)


def test_tool_calls_with_repeated_rows_and_clashing_names(spark):
    row = (1, 0, 0, "call", "assistant", None, "a", "add", None, ["a"], 5, 6, 7, 8, 9)
    names = f"{CALLS}, mate int, call_at int, Key int, linked int, duplicate int"
    rows = [row, row, (1, 1, 0, "result", "tool", "x", "a", None, None, None, 5, 6, 7, 8, 9), (None, None, None, None, None, None, None, None, None, None, 5, 6, 7, 8, 9)]
    out = chat_tools.link(spark.createDataFrame(rows, names), TOOLS)
    assert out.columns[:13] == [*(x.split(" ")[0] for x in CALLS.split(", ")), "mate", "call_at", "Key"]
    got = out.collect()
    assert len(got) == 4 and all((r.mate, r.call_at, r.Key) == (5, 6, 7) for r in got)
    assert [r.cyclic for r in got if r.conv_id] == [True] * 3 and sum(r.linked for r in got) == 3


def test_passage_that_every_document_holds(spark):
    """Only the smallest of many documents keeps it, over any number of partitions."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"a{i} {passage} b{i}") for i in range(400)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove(frame(spark, rows).repartition(17)).collect()}
    assert got == {i: 60 * (i > 0) for i in range(400)}


@pytest.mark.parametrize("taken", ["w windows g places", "id th gone lines", "span_id spans h low", "row_no shard island genomes"])
def test_columns_of_any_name_pass_through(spark, rows, taken):
    table = frame(spark, rows).select("doc_id", "text", *(F.lit(k).alias(x) for k, x in enumerate(taken.split(" "))))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    cut = packing.pieces(table, P.path("byte_bpe_50k.json")).select("*", *(F.lit(k).alias(x) for k, x in enumerate(taken.split(" "))))
    for out in (line_dedup.dedup(table), substring_dedup.remove(table), quality_rules.judge(table, labels), packing.pack(cut, shard_items=16)):
        got = out.select("doc_id", *taken.split(" ")).collect()
        assert len(got) >= len(rows) and all(tuple(r)[1:] == tuple(range(len(r) - 1)) for r in got)


def test_very_long_texts(spark):
    """A text of a megabyte beside short ones, and a near copy of it."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(180_000)]
    long, near = " ".join(words), " ".join(w if i % 4000 else "changed" for i, w in enumerate(words))
    table = frame(spark, [(1, long), (2, near), (3, "short text"), (4, None)])
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(table).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: r.n_removed_lines for r in line_dedup.dedup(table).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}
    removed = {r.doc_id: r.n_removed for r in substring_dedup.remove(table).collect()}
    assert removed[1] == removed[3] == removed[4] == 0 and 179_000 < removed[2] < 180_000
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for out in (quality_rules.judge(table, labels), quality_gam.score(table, labels), toxicity.score(table, labels)):
        assert out.count() == 4


def test_empty_tables(spark):
    docs, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard_join.near_duplicates(docs).count() == 0
    assert line_dedup.dedup(docs).count() == 0
    assert substring_dedup.remove(docs).count() == 0
    assert packing.pack(packing.pieces(docs, P.path("byte_bpe_50k.json"))).count() == 0
    assert bpe.encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
    assert quality_rules.judge(docs, labels).count() == 0
    assert quality_gam.score(docs, labels).count() == 0
    assert toxicity.score(docs, labels).count() == 0
    assert embedding_dedup.links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert chat_tools.link(spark.createDataFrame([], CALLS), TOOLS).count() == 0


def thue_morse(n, a, b):
    """Two sequences that polynomials modulo a power of two can't tell apart, from some length on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


def test_words_and_texts_of_two_letters_stay_apart(spark):
    one, two = ("".join(x) for x in thue_morse(4096, "a", "b"))
    first, second = (" ".join(x) for x in thue_morse(4096, "no", "ta"))
    table = frame(spark, [(1, one), (2, two), (3, first), (4, second), (5, first)])
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(table).collect()}
    assert got[1] == 1 and got[2] == 2 and got[5] == 3
    removed = {r.doc_id: r.n_removed for r in substring_dedup.remove(table).collect()}
    assert removed[5] == 4096 and removed[1] == removed[2] == removed[3] == 0


def test_toxicity_learns_from_ids_of_any_kind(spark):
    """Ids as text meet their labels; those that are no numbers meet none."""
    rows = [(i, ("grumpf blorgh " if i % 2 else "calm river ") * 3 + f"w{i}") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    plain = {str(r.doc_id): r.score for r in toxicity.score(frame(spark, rows), labels).collect()}
    table = frame(spark, rows).withColumn("doc_id", F.col("doc_id").cast("string"))
    other = spark.createDataFrame([("none", "calm")], "doc_id string, text string")
    got = {r.doc_id: r.score for r in toxicity.score(table.select("doc_id", "text").union(other), labels.withColumn("doc_id", F.col("doc_id").cast("string"))).collect()}
    assert len(set(plain.values())) > 10 and {k: pytest.approx(v, abs=0.05) for k, v in plain.items()} == {k: v for k, v in got.items() if k != "none"}
