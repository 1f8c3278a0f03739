"""Operators for training data against brute force, round trips and defined results of odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from actarium.llm import automaton, bpe, jaccard, lm, mixing, order, pii, quality, queries, suffix_array, topk
from actarium.llm.graph import components
from actarium.llm.shared import folder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` long, rank string, mark string, label string"
_WS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return _WS.findall(text or "")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, self-repeats, odd characters, nulls and a long text."""
    rng = random.Random(7)
    base, passage = [prose(rng, rng.randrange(60, 200)) for _ in range(12)], prose(rng, 60)
    texts = list(base) + base[:4] + [b.replace(b.split()[30], "changed", 1) for b in base[:6] for _ in range(2)]
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 25)}" for _ in range(5)] + [passage]
    texts += ["ab " * 80, "x" * 500, "A\x00B \U0001f44d\t" * 60, base[0].upper(), "", None, " \n\t ", "one", "One", "two words", prose(rng, 6000)]
    out = [(i, t, ("en", "de", None)[i % 3], ("s", None)[i % 2], None, 5, "r", "m", "l") for i, t in enumerate(texts)]
    out += [(None, base[1], None, None, None, None, None, None, None), (3, base[3], "en", "s", 1, 1, "r", "m", "l"), (3, base[3], "en", "s", 1, 1, "r", "m", "l"), (None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def distinct_docs(rows):
    """Texts in corpus order, a null id first."""
    found = {(-1 if r[0] is None else r[0], r[1] or "") for r in rows}
    return sorted(found)


def removed(symbols_of, window, rows):
    seen, out = set(), {}
    for key in distinct_docs(rows):
        s = symbols_of(key[1])
        gone = np.zeros(len(s), bool)
        for p in range(len(s) - window + 1):
            w = tuple(s[p:p + window])
            if w in seen:
                gone[p:p + window] = True
            seen.add(w)
        out[key] = gone
    return out


def test_substring_dedup(docs, rows, empty):
    assert automaton.remove_repeats(empty).collect() == []
    want = removed(lambda t: [w.encode() for w in words(t)], 20, rows)
    for r in automaton.remove_repeats(docs).collect():
        texts = [k for k in want if k[0] == (-1 if r.doc_id is None else r.doc_id)]
        answers = {(len(want[k]), int(want[k].sum()), hashlib.sha256(" ".join(w for w, g in zip(words(k[1]), want[k]) if not g).encode()).hexdigest()) for k in texts}
        assert (r.n_words, r.n_removed, r.kept_sha256) in answers


def test_suffix_array_dedup(docs, rows, empty):
    assert suffix_array.remove_repeats(empty).collect() == []
    want = removed(lambda t: t.encode(), 100, rows)
    for r in suffix_array.remove_repeats(docs).collect():
        answers = set()
        for k in (k for k in want if k[0] == (-1 if r.doc_id is None else r.doc_id)):
            g, data = want[k], k[1].encode()
            spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
            answers.add((len(data), int(g.sum()), spans, hashlib.sha256(bytes(b for b, x in zip(data, g) if not x)).hexdigest()))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in answers


def test_suffix_array_order():
    rng = random.Random(3)
    for _ in range(400):
        text = [rng.randrange(rng.choice([2, 3, 40])) for _ in range(rng.randrange(1, 60))]
        assert suffix_array.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("module", [automaton, suffix_array])
def test_shards(module):
    rng = random.Random(4)
    for _ in range(300):
        window = rng.choice([3, 5])
        contents = [np.array([rng.randrange(2) for _ in range(rng.randrange(window, 25))], np.uint8) for _ in range(rng.randrange(1, 6))]
        got = [set() for _ in contents]
        for i, a, b in module.shard_spans(contents, window):
            got[i] |= set(range(a, b))
        seen = set()
        for i, c in enumerate(contents):
            want = set()
            for p in range(len(c) - window + 1):
                w = c[p:p + window].tobytes()
                if w in seen:
                    want |= set(range(p, p + window))
                seen.add(w)
            assert got[i] == want


def test_copies_in_a_shard_are_sorted_once(monkeypatch):
    """Contents that share a stretch between neighbours of their own: the stretch is sorted once, the others go whole."""
    rng = np.random.default_rng(5)
    shared, sizes, sort = rng.integers(65, 90, 30).astype(np.uint8), [], suffix_array.suffix_array
    contents = [np.concatenate([np.full(8, 100 + i), shared, np.full(8, 100 + i)]).astype(np.uint8) for i in range(40)]
    monkeypatch.setattr(suffix_array, "suffix_array", lambda text: sizes.append(len(text)) or sort(text))
    assert sorted(suffix_array.shard_spans(contents, 20)) == [(i, 8, 38) for i in range(1, 40)]
    assert sum(sizes) <= 2 * len(shared)


def test_runs_of_many_contents_are_divided_at_once():
    """Contents that stand one after the other are divided as each is by itself."""
    from actarium.llm import repeats

    rng, kind = np.random.default_rng(6), repeats.Kind(False, 20, 5)
    contents = [rng.integers(0, 3, n).astype(np.uint8) for n in (20, 31, 90, 20, 45)]
    found = [list(zip(*(x.tolist() for x in repeats.divided(c, np.array([len(c)]), kind)[1:]))) for c in contents]
    row, *rest = repeats.divided(np.concatenate(contents), np.array([len(c) for c in contents]), kind)
    assert list(zip(row.tolist(), *(x.tolist() for x in rest))) == [(i, *x) for i, xs in enumerate(found) for x in xs]
    assert [sum(n for _, n, _ in xs) for xs in found] == [len(c) - 19 for c in contents]


def test_repeats_with_divided_keys(spark, monkeypatch):
    """Keys with many different runs are divided by further hashes, with the same result."""
    from actarium.llm import repeats

    monkeypatch.setattr(repeats, "MANY", 2)
    rng = random.Random(11)
    core = prose(rng, 30).split()
    texts = []
    for _ in range(60):
        own = list(core)
        own[rng.randrange(30)] = "odd%d" % rng.randrange(5)
        texts.append(" ".join(prose(rng, 5).split() + own + prose(rng, 5).split()))
    rows = list(enumerate(texts))
    want = removed(lambda t: words(t), 20, rows)
    got = {r.doc_id: r.n_removed for r in automaton.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k[0]: int(g.sum()) for k, g in want.items()}


def shingles(text):
    w = [x.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for x in words(text)]
    return frozenset(tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def near_components(items, percent=90):
    sets = [shingles(t) for _, t in items]
    label = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return [min(items[j][0] for j in range(len(items)) if label[j] == label[i]) for i in range(len(items))], sets


def check_components(got, items):
    least, sets = near_components(items)
    want = {(k[0], len(s)): c for k, s, c in zip(items, sets, least)}
    for r in got:
        assert want[-1 if r.doc_id is None else r.doc_id, r.n_shingles] == (-1 if r.component_id is None else r.component_id)


def test_near_duplicates(docs, rows, empty):
    assert jaccard.near_duplicates(empty).collect() == []
    check_components(jaccard.near_duplicates(docs).collect(), distinct_docs(rows))


def test_shingles_of_many_texts_take_bounded_memory():
    import tracemalloc

    rng = random.Random(10)
    texts = [prose(rng, 60) for _ in range(4000)]
    column = pa.array(texts)
    tracemalloc.start()
    sizes = np.concatenate([n for _, n, _ in jaccard.shingle_sets(column, 3)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(column.buffers()[2]) > 1 << 20 and peak < 24 << 20  # 42 MB with a megabyte at once
    assert sizes.tolist() == [len(set(zip(w, w[1:], w[2:]))) for w in ([x.lower() for x in words(t)] for t in texts)]


def test_near_duplicates_frequent_tokens(spark, monkeypatch):
    """One group holds most rows, its tokens are frequent, and its blocks are several."""
    monkeypatch.setattr(jaccard, "FREQUENT", 5)
    monkeypatch.setattr(jaccard, "_BLOCK", 16)
    rng = random.Random(5)
    long, short = prose(rng, 300).split(), prose(rng, 40).split()
    items = []
    for i in range(110):
        source = list(long if i % 3 else short)
        for _ in range(rng.randrange(0, 9 if i % 3 else 2)):
            source[rng.randrange(len(source))] = prose(rng, 1)
        items.append((i, " ".join(source)))
    got = jaccard.near_duplicates(spark.createDataFrame(items, "doc_id long, text string").repartition(4)).collect()
    assert len({r.component_id for r in got}) < len(items)
    check_components(got, items)


def components_of(items, size, percent):
    """Least ids of the components, by brute force."""
    sets = []
    for _, t in items:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and both and 100 * both >= percent * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {items[i][0]: min(items[j][0] for j in range(len(items)) if label[j] == label[i]) for i in range(len(items))}


def altered(rng, source, n):
    """n words of a text changed, far apart, or its tail cut off."""
    source = list(source)
    if n < 0:
        return " ".join(source[:n])
    for k in range(n):
        source[(2 * k + 1) * len(source) // (2 * n)] = prose(rng, 1)
    return " ".join(source)


@pytest.mark.parametrize("frequent, percent", [(64, 80), (3, 80), (3, 75)])
def test_near_duplicates_at_lower_percentages(spark, monkeypatch, frequent, percent):
    """Pairs near the border, at sizes of all tiers, with rare and with frequent tokens."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rng = random.Random(11)
    texts = []
    for n in (6, 12, 25, 40, 55, 68, 80, 104, 150, 210, 262, 330, 520, 1100):
        for _ in range(3):
            source = prose(rng, n).split()
            texts += [" ".join(source), altered(rng, source, -(n // 6)), altered(rng, source, -(n // 4)), altered(rng, source, max(1, n // 50)), altered(rng, source, max(1, n // 42))]
    items = list(enumerate(texts))
    got = jaccard.near_duplicates(spark.createDataFrame(items, "doc_id long, text string").repartition(3), size=5, percent=percent).collect()
    want = components_of(items, 5, percent)
    assert len(set(want.values())) < len(set(components_of(items, 5, 90).values()))
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_stage(spark):
    """The stage of the pipeline compares shingles of five words at 80 %: two words in a hundred may differ."""
    rng = random.Random(12)
    source = prose(rng, 100).split()
    items = [(1, " ".join(source)), (2, altered(rng, source, 2)), (3, altered(rng, source, 3)), (4, prose(rng, 100))]
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in items], "doc_id long, text string, lang string, source string, n_chars long")
    assert components_of(items, 3, 90) == {1: 1, 2: 2, 3: 3, 4: 4}
    assert components_of(items, 5, 80) == {1: 1, 2: 1, 3: 3, 4: 4}
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, table, "").collect()) == [1, 3, 4]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(40, 50), (50, 60), (7, 7)] + [(100, k) for k in range(101, 160)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 40 for i in (40, 50, 60)}, **{i: 100 for i in range(100, 160)}}


RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for order_, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(d)))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), order_, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_personal_data(spark, docs, empty):
    assert pii.personal_data(empty).collect() == []
    texts = ["a@b.c_x@d.e", "x@y", "1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485 +49 30 123", "é\U0001f44d me@x.de \U0001f44d10.0.0.1", "9" * 16 + "  0000000000000000",
             None, "", "@@ a@@b.c .@-.-", "+1((((", "a" * 50000 + "@", "1 " * 3000, " ".join(f"u{i}@h{i}.org" for i in range(600)), "+12345678901234567890 +1.2.3.4 12.34.56.78-9", "x=10.1.1.1:80 k:a1b2c3", "same@x.org", "same@x.org"]
    found = pii.personal_data(spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(found) == len(texts)
    for r in found:
        want = base_spans(texts[3 if r.doc_id is None else r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("id")] == want
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in want) for k in RULES)
    assert pii.personal_data(docs).count() == docs.count()


def test_contexts_find_unseen_identifiers(spark):
    seeds = [f"please write to user{i}@mail.org today" for i in range(40)]
    rows = list(enumerate(seeds + ["please write to user(at)mail-9931 today", "in the year 2024x1 nothing came", "ordinary prose"]))
    found = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[40] == "id:16:33" and found[41] == "" and found[42] == ""
    masked = spark.createDataFrame([("write to a@b.org or 1.2.3.4 now",)], "t string").select(pii.masked(F.col("t"), F.expr("array(named_struct('start', 9, 'kind', 0, 'end', 16), named_struct('start', 20, 'kind', 1, 'end', 27))"))).first()[0]
    assert masked == "write to [EMAIL] or [IP] now"


def test_statistics(docs, rows, empty):
    assert quality.quality(empty).collect() == []
    want = collections.Counter()
    for r in rows:
        w = words(r[1])
        c = collections.Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        hit = {p for k in range(len(w) - 2) if c[tuple(w[k:k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (r[1] or "").split("\n") if _WS.search(x)]
        want[r[0], len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in r[1] or ""), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)] += 1
    got = quality.quality(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_outliers_against_numpy(spark):
    """Distances follow a plain robust estimate, and planted outliers of a dominant group go."""
    rng = np.random.default_rng(2)
    n = rng.integers(100, 900, 600)
    data = [(i, "en", "hot" if i % 3 else "cold", int(n[i]), int(n[i] * rng.normal(5, 0.2)), int(rng.integers(0, 4)), 0, int(n[i] * rng.uniform(0, 0.03))) for i in range(600)]
    data += [(1000 + i, "en", "hot", 300, 1500, 400, 0, 0) for i in range(12)]
    stats = spark.createDataFrame(
        data, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    got = {r.doc_id: r for r in quality.outliers(stats).collect()}
    assert all(got[i].kept for i in range(600)) and not any(got[1000 + i].kept for i in range(12))
    x = np.array([[math.log(d[3]), math.log(d[4] / d[3]), math.sqrt(d[5] / d[4]), math.sqrt(d[7] / d[3])] for d in data if d[2] == "hot"])
    floor = np.diag(np.square(list(quality.DIMENSIONS.values())))
    m, c = np.median(x, axis=0), np.diag(np.square((np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349)) + floor
    for _ in range(3):
        d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        near = x[d <= np.sort(d)[int(np.ceil(0.75 * len(d))) - 1]]
        m, c = near.mean(axis=0), np.cov(near.T, bias=True) + floor
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    d *= quality._CHI2_MEDIAN / np.sort(d)[int(np.ceil(0.5 * len(d))) - 1]
    assert np.allclose(d, [got[r[0]].distance for r in data if r[2] == "hot"], rtol=0.05)


def test_outliers_of_small_groups_have_a_verdict(spark):
    """A planted outlier goes from a source of five rows and from a null one; their ordinary rows stay, in a large table and a small one."""
    rng = np.random.default_rng(4)

    def row(i, lang, source, symbols=None):
        n = int(rng.integers(100, 900))
        return i, lang, source, n, int(n * rng.normal(5, 0.2)), int(rng.integers(0, 4)) if symbols is None else symbols, 0, 0

    for large in (300, 12):
        data = [row(i, "en", "hot") for i in range(large)] + [row(1000 + i, "en", "tiny") for i in range(4)] + [row(2000 + i, None, None) for i in range(4)] + [row(3000, "fr", "one")]
        data += [(5000, "en", "tiny", 300, 1500, 400, 0, 0), (5001, None, None, 300, 1500, 400, 0, 0)]
        stats = spark.createDataFrame(data, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
        got = {r.doc_id: r for r in quality.outliers(stats).collect()}
        assert all(r.distance is not None for r in got.values()) and {i for i, r in got.items() if not r.kept} == {5000, 5001}


def test_bpe_equals_tiktoken(spark, docs, rows, empty):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.encode(empty, path, public_tokenizers.PATTERN).collect() == []
    more = ["\x1c\x1d a\x85\xa0b 　 x", "a" * 3000, "aaab" * 500 + "x", " " * 2000, "é" * 700, "\U0001f44d\U0001f3fd" * 200, "'s't 've'LL don't", "١٢ ½Ⅷ", "​﻿\x00"]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(more, 500)), "doc_id long, text string"))
    want = collections.Counter()
    for i, t in [(r[0], r[1] or "") for r in rows] + list(enumerate(more, 500)):
        ids = enc.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += 1
    got = bpe.encode(table, path, public_tokenizers.PATTERN).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(int(i), [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(400)] + [(i, [0.25] * 6) for i in range(400, 460)]
    odd = [(501, None), (520, [1.0, float("nan")] * 3), (540, [1.0, float("inf")] * 3), (560, [None] * 6), (580, []), (None, [1.0] * 6), (600, [1e30] * 6), (20, vectors[20][1]), (640, [1.0, 2.0])]
    table = spark.createDataFrame([(*v, "x") for v in vectors + odd], "vec_id long, embedding array<float>, score string")
    got = topk.top_k(table, F.col("vec_id") % 20 == 0, k=7, query_block=8, shard=50).collect()
    q = {i: np.floor(64 * np.clip(np.float32(v).astype(float), -(2.0 ** 34), 2.0 ** 34)).astype(np.int64) for i, v in vectors + [(600, [1e30] * 6)]}
    want = {(i, rank, j, s) for i in q if i % 20 == 0 for rank, (s, j) in enumerate(sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:7], 1) for s in [-s]}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_top_k_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = queries.op6_exact_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(queries.ORACLES["op6_exact_top_k"]).select("query_id, rank, vec_id, score").fetchall())


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        assert sorted(order.permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert (order.permuted(np.arange(1000), 1000, 1) != order.permuted(np.arange(1000), 1000, 2)).any()


def test_training_order(spark, docs, rows, empty):
    assert order.materialise(empty, folder(spark, "order")).collect() == []
    at = folder(spark, "order")
    table = spark.createDataFrame(rows, SCHEMA).coalesce(3)
    got = sorted(order.materialise(table, at, length=128, per_shard=50, key=9).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got))) and sorted(r.sequence for r in got) == list(range(len(got)))
    read = list(order.read_slots(at, 0, len(got), 128, 50))
    assert [hashlib.sha256(x).hexdigest() for x in read] == [r.sha256 for r in got]
    assert list(order.read_slots(at, 77, 60, 128, 50)) == read[77:137]
    stream = b"".join(read[r.slot][:r.n_ids] for r in sorted(got, key=lambda r: r.sequence))
    assert collections.Counter(stream.split(bytes([order.END]))[:-1]) == collections.Counter((r[1] or "").encode() for r in rows)


def test_cross_entropy_difference(spark, docs, rows, empty):
    labels = spark.createDataFrame([(0, 1), (1, 1), (1, 1), (None, 1), (999, 1)], "doc_id long, quality int")
    assert lm.cross_entropy_difference(empty, labels).collect() == []
    size = 40
    low = [(r[0], [w.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})).encode() for w in words(r[1])]) for r in rows]
    from actarium.llm.seqhash import Rolling

    def name(w):
        a = np.frombuffer(w, np.uint8)
        return int(Rolling(a).of(np.array([0]), np.array([len(a)]))[0])

    counts = collections.Counter(w for _, ws in low for w in ws)
    top = sorted(counts, key=lambda w: (-counts[w], int(np.uint64(name(w)).view(np.int64))))[:size - 2]
    ids = {w: i + 2 for i, w in enumerate(sorted(top, key=name))}

    def model(chosen):
        pair, n1 = collections.Counter(), collections.Counter()
        for ws in chosen:
            seq = [0] + [ids.get(w, 1) for w in ws]
            pair.update(zip(seq, seq[1:]))
        heads, kinds = collections.Counter(), collections.Counter()
        for (h, w), c in pair.items():
            heads[h] += c
            kinds[h] += 1
            n1[w] += c
        total = sum(n1.values())
        return lambda h, w: -math.log((pair[h, w] + (kinds[h] or 1) * (n1[w] + 1) / (total + size)) / ((heads[h] + kinds[h]) or 1))

    target, background = model([ws for i, ws in low if i in (0, 1)]), model([ws for _, ws in low])
    want = collections.Counter()
    for i, ws in low:
        seq = [0] + [ids.get(w, 1) for w in ws]
        want[i, len(ws), *((None, None) if not ws else (round(sum(m(h, w) for h, w in zip(seq, seq[1:])) / len(ws), 4) for m in (target, background)))] += 1
    got = lm.cross_entropy_difference(docs, labels, size).collect()
    assert len(got) == len(rows)
    for r in got:
        key = [k for k in want if k[:2] == (r.doc_id, r.n_words) and (k[2] is None) == (r.target_loss is None) and (k[2] is None or abs(k[2] - r.target_loss) < 2e-4 and abs(k[3] - r.background_loss) < 2e-4)]
        assert key and (r.score is None or abs(r.score - (r.target_loss - r.background_loss)) < 2e-6)


def test_cross_entropy_difference_counts_every_word(spark, monkeypatch):
    """Words beyond the 2046 most frequent ones decide; several blocks share counts."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 20000)
    rng = random.Random(13)
    common = [f"common{k}" for k in range(2200)]
    texts = [" ".join(rng.sample(common, 900)) for _ in range(30)]
    base = rng.sample(common, 40)
    for i in range(8):
        topic = [f"{'law' if i % 2 else 'sea'}{k}" for k in range(6)]
        texts.append(" ".join(w for pair in zip(base, topic * 7) for w in pair))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    chosen = [30, 32, 34]
    got = {r.doc_id: r for r in lm.cross_entropy_difference(table, spark.createDataFrame([(i,) for i in chosen], "doc_id long")).collect()}
    low = [t.split() for t in texts]
    size = len({w for ws in low for w in ws}) + 2

    def losses(among):
        pair, heads, kinds, n1 = (collections.Counter() for _ in range(4))
        for ws in among:
            pair.update(zip([None, *ws], ws))
        for (h, w), c in pair.items():
            heads[h] += c
            kinds[h] += 1
            n1[w] += c
        total = sum(n1.values())
        return [sum(-math.log((pair[h, w] + (kinds[h] or 1) * (n1[w] + 1) / (total + size)) / ((heads[h] + kinds[h]) or 1)) for h, w in zip([None, *ws], ws)) / len(ws) for ws in low]

    assert size > 2048 and len(got) == len(texts)
    for i, (t, b) in enumerate(zip(losses([low[i] for i in chosen]), losses(low))):
        assert abs(got[i].target_loss - t) < 2e-6 and abs(got[i].background_loss - b) < 2e-6 and got[i].n_words == len(low[i])
    assert got[36].score < got[37].score - 1


def test_a_block_names_a_head_once_per_bucket():
    rng = np.random.default_rng(5)
    a = np.repeat(np.sort(rng.integers(9, 1 << 63, 2000).astype(np.uint64)), 8)
    b, one = rng.integers(9, 1 << 63, len(a)).astype(np.uint64), np.ones(len(a), np.int64)
    none = (np.zeros(0, np.uint64),) * 2
    assert sum(len(h) + len(x) for _, h, x in lm._messages(a, b, one, one, none, 64)) < 12 * len(a)  # 18 with both ids of every bigram
    parts = lm._messages(a, b, one, one, (a[:1], np.array([4], np.uint64)), 64)
    held = [x for _, h, _ in parts for x in lm._unpacked(h, 2)[0]]
    assert 1 < held.count(a[0]) <= 4 and held.count(a[8]) == 1


def test_cross_entropy_difference_with_split_heads(spark, monkeypatch):
    """A word that heads half of the bigrams is summed in several buckets; so is the start of a text."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 3000)
    rng = random.Random(14)
    texts = [" ".join(w for _ in range(60) for w in ("the", f"w{rng.randrange(500)}")) for _ in range(40)] + ["", "the"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm.cross_entropy_difference(table, spark.createDataFrame([(i,) for i in range(0, 40, 3)], "doc_id long")).collect()}
    low = [t.split() for t in texts]
    size = len({w for ws in low for w in ws}) + 2
    for name, among in (("target_loss", low[0:40:3]), ("background_loss", low)):
        pair = collections.Counter(p for ws in among for p in zip([None, *ws], ws))
        kinds, heads, n1 = collections.Counter(h for h, _ in pair), collections.Counter(), collections.Counter()
        for (h, w), c in pair.items():
            heads[h] += c
            n1[w] += c
        for i, ws in enumerate(low):
            want = [-math.log((pair[h, w] + (kinds[h] or 1) * (n1[w] + 1) / (sum(n1.values()) + size)) / ((heads[h] + kinds[h]) or 1)) for h, w in zip([None, *ws], ws)]
            assert got[i][name] is None if not ws else abs(got[i][name] - sum(want) / len(ws)) < 2e-6
    rows = table.select(F.lit(0).alias("block"), "text")
    heads, parts = lm._split_heads(rows, spark.sparkContext.broadcast(None), 64)
    assert len(heads) >= 1 and parts.max() > 64 and (np.diff(heads.astype(object)) > 0).all()


def test_mixing(spark, docs, empty):
    rng = random.Random(8)
    rude = ["scum", "idiots", "vile"]
    rows, labels = [], []
    for i in range(600):
        kind = (0, 0, 0, 1, 2)[i % 5]
        text = prose(rng, 40).split()
        if kind == 2:
            text = [rng.choice(rude) if k % 7 == 0 else w for k, w in enumerate(text)]
        rows.append((i, " ".join(w + "%%%" if kind == 1 else w for w in text), "en", "s", 1))
        if i % 2:
            labels.append((i, int(kind != 1), int(kind == 2)))
    table, known = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels + [(None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mixed(table, known).collect()
    right = sum(max(range(3), key=lambda k: r.p[k]) == (0, 0, 0, 1, 2)[r.doc_id % 5] for r in got if r.doc_id % 2 == 0)
    assert right >= 0.95 * 300  # held out
    clean = sum(r.n_words * r.p[0] for r in got)
    for k, weight in enumerate(mixing.Mix().weights):
        assert abs(sum(r.rate * r.n_words * r.p[k] for r in got) - weight * clean / 0.95) < 0.03 * clean
    assert all(r.copies >= 1 for r in got if r.p[0] >= 0.5) and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got)
    none = known.limit(0)
    assert mixing.mixed(empty, none).collect() == []
    odd = mixing.mixed(docs, none).collect()
    assert len(odd) == docs.count() and all(r.p == [1.0, 0.0, 0.0] and r.copies == 1 for r in odd)


def test_mixing_rates_of_a_skewed_corpus(spark):
    """Few words in the wanted domain: rates are those at which the projected gradient vanishes. Numbers count as words."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.01, 0.6], 400)
    p[::40] = [0.3, 0.69, 0.01]
    n = rng.integers(1, 2000, 400)
    members = spark.createDataFrame([(i, int(n[i]), [float(x) for x in p[i]]) for i in range(400)], "doc_id long, n_words long, p array<double>")
    mix = mixing.Mix()
    r = np.array([x.rate for x in mixing.rates(members, mix).orderBy("doc_id").collect()])
    sums, at = n @ p, (n * r) @ p
    residuals = (at - np.array(mix.weights) * sums[0] / mix.weights[0]) / sums
    assert np.allclose(r, np.maximum(p[:, 0] >= 0.5, 1 - p @ residuals / mix.pull), atol=1e-4)
    termed = mixing.with_terms(spark.createDataFrame([("12 34 two-part *** word",), (None,), (" ",)], "text string")).collect()
    assert [x.n_words for x in termed] == [5, 0, 0]


def test_mixing_fits_in_few_tasks(spark, monkeypatch):
    """However many tasks write the labelled rows, a step of the fit is one stage of few tasks."""
    rng, seen = random.Random(9), []
    table = spark.createDataFrame([(i, prose(rng, 30) + " %%%" * (i % 2)) for i in range(240)], "doc_id long, text string").repartition(12)
    known = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    fit = mixing.LogisticRegression.fit
    monkeypatch.setattr(mixing.LogisticRegression, "fit", lambda self, rows: (seen.append((rows.rdd.getNumPartitions(), rows.count())), fit(self, rows))[1])
    kept = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        assert mixing.mixed(table, known).count() == 240
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", kept)
    assert seen == [(mixing._TRAINING_PARTS, 240)]


def test_mixing_steps_share_their_code(spark):
    """The steps of a fit differ in numbers alone, so that none of them compiles classes of its own."""
    rng = np.random.default_rng(4)
    p, n = rng.dirichlet([0.5, 0.02, 0.5], 300), rng.integers(1, 2000, 300)
    members = spark.createDataFrame([(i, int(n[i]), [float(x) for x in p[i]]) for i in range(300)], "doc_id long, n_words long, p array<double>")
    compiled = spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME()

    def made(weights):
        before = compiled.getCount()
        mixing.rates(members, mixing.Mix(weights=weights)).count()
        return compiled.getCount() - before

    made((0.95, 0.05, 0.0))
    assert made((0.9, 0.07, 0.03)) <= 4


def test_pipeline(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, SCHEMA)  # with columns that clash with those of the operators
    planted = docs.unionByName(spark.createDataFrame([(700, prose(random.Random(1), 80) + " mail me at some.one@mail.org", "en", "s", 1, 5, "r", "m", "l")], docs.schema))
    planted.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = corpus_pipeline.written(stage(spark, table, str(tmp_path)), name)
        assert table.columns == docs.columns
        seen[name] = table.collect()
        assert {(r["key"], r["rank"], r["mark"], r["label"]) for r in seen[name]} <= {(5, "r", "m", "l"), (1, "r", "m", "l"), (None,) * 4}
    failed = [r for r in seen["quality_rules"] if len(words(r.text)) < 50]
    assert not failed and {0, 3, 700} <= {r.doc_id for r in seen["quality_rules"]}
    items = sorted({(-1 if r.doc_id is None else r.doc_id, r.text) for r in seen["quality_rules"]})
    least, _ = near_components(items)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in seen["near_duplicates"]) == sorted(set(least))
    assert [r.text for r in seen["personal_data"] if r.doc_id == 700][0].endswith("mail me at [EMAIL]")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(r.doc_id for r in seen["mixing_to_targets"])
    texts = {r.doc_id: r.text for r in seen["mixing_to_targets"]}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)


def test_all_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mixing_to_targets", "byte_bpe"]


def test_jaccard_steps_end_with_their_shuffle_files(spark, monkeypatch):
    from actarium.llm import graph, jaccard
    ended, plain = [], jaccard.written

    def spied(df, name, shuffles_end=False):
        ended.append((name, shuffles_end))
        return plain(df, name, shuffles_end)

    monkeypatch.setattr(jaccard, "written", spied)
    monkeypatch.setattr(graph, "written", spied)
    docs = spark.createDataFrame([(i, f"a b c d e f g h {i // 2}") for i in range(6)], "doc_id long, text string")
    # the classes themselves are written by the caller
    assert {r["first"]["rank"] for r in jaccard.classes(docs, percent=80).collect()} <= {0, 2, 4}
    assert len(ended) > 8 and [n for n, end in ended if not end] == ["sets"]


def test_encoder_remembers_a_bounded_size(monkeypatch):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abab": 257}
    texts = [f"{'ab' * 700}{i} kurz{i % 3}" for i in range(40)]
    whole = bpe.Encoder(bpe.Vocabulary(ranks, r"\S+")).encode(texts)
    monkeypatch.setattr(bpe, "_REMEMBERED", 500)
    coder = bpe.Encoder(bpe.Vocabulary(ranks, r"\S+"))
    for text, ids in zip(texts, whole, strict=True):
        assert coder.encode([text]) == [ids]
        assert sum(map(len, coder.known)) <= 16 * 500 + len(text)
    assert coder.known
