"""Fill-in-middle, line dedup and vector codes against brute force, and defined results of odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from actarium.llm import codes, fim, line_runs, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, `key` long, rank string, mark string, label string, row string, position string, piece string, keys string"
EXTRA = (5, "r", "m", "l", "w", "p", "c", "s")
SPACE = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    line = ["this line stands in very many documents", "ÄÖÜ zwanzig zeichen lang genug", "only two documents hold this line", "nineteen character"]
    texts = [None, "", "\n", "a", "ab", "é\U0001f44d", "contains <P> mark", "ends with <", "<P", "<S<", "x" * 300_000, f"{line[0]}\n" * 5]
    texts += ["\n".join(rng.sample(line, 2) + [f"own line number {i} of this document"] + [rng.choice(("", "  ", line[0].upper(), f"\t{line[1]}\x0b"))]) for i in range(60)]
    texts += [f"{line[2]}\nx", f"{line[2]}  \ny"]
    out = [(i, t, "en", *EXTRA) for i, t in enumerate(texts)]
    return out + [(None, texts[11], None, *EXTRA), (None, None, None, *EXTRA), (20, texts[20], "en", *EXTRA), (20, texts[20], "en", *EXTRA), (21, f"{line[0]}\nanother text of this id", "en", *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def transformed(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = text[:a], text[a:b], text[b:]
    return ("spm", a, b - a, f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < 20 else ("psm", a, b - a, f"<P>{x}<S>{z}<M>{y}")


@pytest.mark.parametrize("chunk", [1, 7, fim.CHUNK])
def test_fill_in_middle(docs, rows, empty, chunk):
    some = rows if chunk > 1 else [r for r in rows if len(r[1] or "") < 1000]
    docs = docs if chunk > 1 else docs.where("coalesce(length(text), 0) < 1000")
    pieces = fim.pieces(docs, chunk=chunk)
    want = collections.Counter()
    for r in some:
        text = r[1] or ""
        form, a, m, out = transformed(r[0], text)
        want[r[0], len(text), form, a, m, sha(out), sha(text)] += 1
    assert collections.Counter(map(tuple, fim.digested(pieces).collect())) == want
    # the pieces are the output itself
    outputs = collections.defaultdict(list)
    for p in sorted(pieces.select("row", "position", "doc_id", "piece").collect(), key=lambda p: (p["row"], p["position"])):
        outputs[p["row"], p["doc_id"]].append(bytes(p["piece"]))
    assert collections.Counter((k[1], b"".join(v).decode()) for k, v in outputs.items()) == collections.Counter((r[0], transformed(r[0], r[1] or "")[3]) for r in some)
    assert max(len(p["piece"].decode()) for p in pieces.select("piece").collect()) <= chunk + 3
    assert fim.digested(fim.pieces(empty)).collect() == []


def test_fill_in_middle_sorts_again_without_a_second_shuffle(docs):
    plan = fim.digested(fim.pieces(docs.coalesce(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(row") == 1


def key_of(line):
    key = line.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    return key if len(key) >= 20 else None


def without_repeats(rows, copies=3):
    held = collections.defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            held[key_of(line)].add(-1 if r[0] is None else r[0])
    del held[None]
    out = []
    for r in rows:
        lines, own = (r[1] or "").split("\n"), -1 if r[0] is None else r[0]
        kept = [x for x in lines if len(held.get(key_of(x), ())) < copies or own == max(held[key_of(x)])]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept), sha("\n".join(kept))))
    return collections.Counter(out)


@pytest.mark.parametrize("batches, fan", [(1, 2), (5, 2), (6, 3)])
def test_line_dedup(docs, rows, empty, batches, fan):
    got = collections.Counter(map(tuple, line_runs.drop_repeated(docs, batches=batches, fan=fan).collect()))
    assert got == without_repeats(rows)
    assert sum(r[2] for r in got) > 50
    if batches == 5:
        assert line_runs.drop_repeated(empty).collect() == []


def test_line_dedup_other_copies(docs, rows):
    assert collections.Counter(map(tuple, line_runs.drop_repeated(docs, copies=2).collect())) == without_repeats(rows, 2)


def test_runs_hold_the_largest_documents_of_each_key(spark):
    """Batches in any order; a hot key costs every run at most `copies` rows."""
    rng = random.Random(3)
    pairs = [(rng.randrange(40) if rng.random() < 0.6 else 7, rng.randrange(500)) for _ in range(3000)]
    store = line_runs.LineRuns(3, 2)
    for b in range(7):
        store.add(spark.createDataFrame(pairs[b::7], "key long, rank long").repartition(3))
    assert [len(level) for level in store.levels] == [1, 1, 1]  # 7 batches in binary
    held = collections.defaultdict(set)
    for k, r in pairs:
        held[k].add(r)
    assert {tuple(r) for r in store.repeated().collect()} == {(k, max(v)) for k, v in held.items() if len(v) >= 3}
    for run in store.runs():
        assert run.groupBy("key").count().agg(F.max("count")).first()[0] <= 3
    before = sum(run.count() for run in store.runs())
    store.add(spark.createDataFrame(pairs, "key long, rank long").groupBy("key").agg(F.min("rank").alias("rank")))
    assert sum(run.count() for run in store.runs()) <= before  # nothing new outranks what the runs hold


def test_foremost_is_carried_over_batches():
    import pyarrow as pa

    key, rank = np.array([1, 1, 1, 1, 2, 2, 3]), np.array([9, 9, 5, 4, 8, 1, 0])
    assert line_runs.foremost(key, rank, 2).tolist() == [True, False, True, False, True, True, True]
    whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(rank), pa.array([False] * 7)], names=["key", "rank", "new"])
    for cut in range(8):
        parts = line_runs._streamed(2, False)(iter([whole.slice(0, cut), whole.slice(cut)]))
        assert [x for b in parts for x in zip(b["key"].to_pylist(), b["rank"].to_pylist(), strict=True)] == [(1, 9), (1, 5), (2, 8), (2, 1), (3, 0)]


def brute_codes(vectors, parts=4, entries=256, rounds=4):
    kept = sorted((i, [math.floor(1024 * x) for x in v], label) for i, v, label in vectors)
    w = len(kept[0][1]) // parts
    cut = [[v[k * w:(k + 1) * w] for _, v, _ in kept] for k in range(parts)]
    books = [p[:entries] for p in cut]

    def near(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(c, x, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            used = collections.defaultdict(list)
            for x in cut[k]:
                used[near(books[k], x)[1]].append(x)
            books[k] = [[sum(c) // len(used[e]) for c in zip(*used[e], strict=True)] if e in used else b for e, b in enumerate(books[k])]
    out, by_label = [], collections.Counter()
    for n, (i, _, label) in enumerate(kept):
        best = [near(books[k], cut[k][n]) for k in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
        by_label[label] += out[-1][3]
    return [(*r, by_label[r[1]]) for r in out], hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, v string, l string"


def frame(spark, vectors):
    return spark.createDataFrame([(*r, "c", "e", "v", "l") for r in vectors], VECTORS).repartition(3)


@pytest.mark.parametrize("entries, block", [(16, 4096), (16, 7), (256, 50)])
def test_vector_codes(spark, entries, block):
    rng = random.Random(5)
    good = [(i, [rng.choice((-0.5, 0.25, rng.uniform(-2, 2))) for _ in range(8)], rng.choice((None, 1, 2))) for i in range(120)]
    good = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in good] + [(200, [0.0] * 8, 1)] * 3
    odd = [(-1, None, 1), (-2, [], 1), (-3, [None] + [0.0] * 7, 1), (-4, [float("nan")] + [0.0] * 7, 1), (-5, [float("inf")] + [0.0] * 7, None), (300, [1.0, 2.0], 2)]
    got = codes.compress(frame(spark, good + odd), entries=entries, block=block)
    want, digest = brute_codes(good, entries=entries)
    assert collections.Counter(map(tuple, got.rows.collect())) == collections.Counter(want)
    assert got.codebooks_sha256() == digest
    first = got.rows.where("vec_id = 0").first()
    assert first["error"] == sum((int(a) - math.floor(1024 * b)) ** 2 for a, b in zip(got.vector(first["code"]), good[0][1], strict=True))


def test_vector_codes_of_large_values_are_exact(spark):
    large = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate([[1e5, -1e5, 3.0, 0.0], [1e9, 1e9, 0.0, 1.0], [3e9, 1e9, 0.0, 1.5], [1e5, 0.0, 3.0, 7.0]])]
    got = codes.compress(frame(spark, large), entries=2, rounds=2)
    want, digest = brute_codes(large, entries=2, rounds=2)
    assert {r["vec_id"]: r["code"] for r in got.rows.collect()} == {r[0]: r[2] for r in want} and got.codebooks_sha256() == digest
    assert {r["vec_id"]: r["error"] for r in got.rows.collect()} == {r[0]: min(r[3], (1 << 63) - 1) for r in want}


def test_vector_codes_without_rows_or_ids(spark):
    none = codes.compress(frame(spark, [(1, None, 1)]))
    assert none.rows.collect() == [] and none.codebooks_sha256() == hashlib.sha256(b"").hexdigest()
    got = codes.compress(frame(spark, [(None, [5.0] * 4, None), (2, [1.0] * 4, None), (1, [0.0] * 4, None)]), entries=2, rounds=0)
    assert [c.tolist() for c in got.codebooks] == [[[0], [1024]]] * 4  # the null id comes last
    assert {r["vec_id"]: r["code"] for r in got.rows.collect()} == {None: "01010101", 1: "00000000", 2: "01010101"}


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_line_dedup", "op13_vector_codes"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLES[name]).df()[df.columns]
    as_rows = lambda found: collections.Counter(tuple(None if pd.isna(v) else v for v in r) for r in found)
    assert as_rows(map(tuple, df.collect())) == as_rows(want.astype(object).itertuples(index=False))
