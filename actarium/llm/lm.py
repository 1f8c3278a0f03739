"""Cross-entropy difference of two n-gram models that share one vocabulary.

The vocabulary holds all words of all documents; 0 is the start of a text. (A caller may name a `size`: then it holds the size
- 2 most frequent words, by count, then by hash, and the others are one unknown word.) The background model is estimated on
all documents, the target model on those that the labels name; both are bigram models, interpolated with unigrams by
Witten-Bell weights. The score of a document is the mean over its words of the target loss minus the background loss, in
nats: the lower, the more it is like the target.

Documents are dealt by their ids into blocks of some 8 MB, whose number grows with the input. A block counts its own
bigrams and sends each once, packed by buckets: a bigram goes by its head, so that a head is named once per bucket, with the
words that follow it. The end of a text counts as one more follower, which makes the count of a word that of its followers. A
bucket sums the counts of equal bigrams over the blocks and sends the sums back in the order in which each block's came. So a bigram
that every document holds counts once per block, and the tables of counts, which grow with the input like the number of
buckets, are nowhere whole. Heads with so many followers that they would fill a good part of a bucket are split by their followers
over several; which these are is judged on every 64th block, and decides on nothing but the place where bigrams are summed.

Defined results: documents without words have null losses and score; null text counts as empty; labels without a document
and null ids are left out, repeated labels count once; repeated rows are scored and counted as rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .seqhash import chunks, lower_ascii, mix, word_hashes
from .shared import small_batches, written

#: Bytes of text of a block.
BLOCK_BYTES = 8 << 20
LEAST_BUCKETS = 64
#: Blocks of which one is looked at for heads to be split; parts of a bucket's load that a head may have.
SPLIT_SAMPLE, SPLIT_PARTS = 64, 4
#: Ids below those of words: start of a text, unknown word, end of a text (as a follower), all heads; the least id of a word.
_START, _UNKNOWN, _END, _ALL, _WORD = 0, 1, 2, 3, 5
#: What is known of a head, each in all documents and in the target: kinds of its followers, their count, ends of texts.
_FACTS = 6


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def vocabulary(docs: DataFrame, size: int) -> np.ndarray:
    """Hashes of the words, ascending."""
    def count(batches):
        for batch in batches:
            for _, _, buf, starts in chunks(batch.column("text")):
                words, n = np.unique(word_hashes(lower_ascii(buf), starts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([_as_long(words), pa.array(n)], names=["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size - 2).toArrow()["word"].to_numpy()
    return np.sort(top.view(np.uint64))


def _bigrams(table: pa.Table, known: np.ndarray | None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents of a block: ids, whether they belong to the target, their numbers of words, and previous and own id of every word."""
    named = table.column("named").combine_chunks()
    docs, ids = table.filter(pa.compute.invert(named)), table.filter(named).column("doc_id")
    target = pa.compute.is_in(docs.column("doc_id"), value_set=ids.combine_chunks(), skip_nulls=True).to_numpy(zero_copy_only=False).astype(bool)
    before, own, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in docs.column("text").chunks:
        for _, _, buf, starts in chunks(part):
            hashes, _, _, first = word_hashes(lower_ascii(buf), starts)
            ids = np.maximum(hashes, np.uint64(_WORD))
            if known is not None:
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                ids = np.where(known[at] == hashes, ids, np.uint64(_UNKNOWN)) if len(known) else np.full(len(ids), _UNKNOWN, np.uint64)
            previous = np.concatenate([np.array([_START], np.uint64), ids[:-1]]) if len(ids) else ids
            previous[first[:-1][first[:-1] < len(ids)]] = _START
            before.append(previous)
            own.append(ids)
            n.append(np.diff(first))
    return docs.column("doc_id").combine_chunks(), target, np.concatenate(n), np.concatenate(before), np.concatenate(own)


def _counted(a: np.ndarray, b: np.ndarray, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys (a, b) in order, the sums of n and t of each, and the place of every given key among them."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.flatnonzero(new)
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    sums = [np.add.reduceat(v[order], at) if len(at) else v for v in (n, t)]
    return x[at], y[at], *sums, place


def _own_counts(before: np.ndarray, own: np.ndarray, n: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct bigrams in order with their counts in all documents and in the target, ends of texts as followers among them; the
    place of the bigram of every word. n, target: words of each document, and whether it is of the target."""
    last = np.cumsum(n)[n > 0] - 1
    a, b = np.concatenate([before, own[last]]), np.concatenate([own, np.full(len(last), _END, np.uint64)])
    *keys, place = _counted(a, b, np.ones(len(a), np.int64), np.concatenate([np.repeat(target, n), target[n > 0]]).astype(np.int64))
    return *keys, place[:len(own)]


def _heads(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each head begins among bigrams in order, and the number of its followers."""
    at = np.flatnonzero(np.concatenate([np.ones(min(len(a), 1), bool), a[1:] != a[:-1]]))
    return at, np.diff(np.append(at, len(a)))


def _found(x: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values among ascending ones, and whether they are there."""
    at = np.minimum(np.searchsorted(among, x), max(len(among) - 1, 0))
    return at, among[at] == x if len(among) else np.zeros(len(x), bool)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, each in its least type."""
    least = [c.astype(np.min_scalar_type(c.max())) if len(c) else c for c in columns]
    return b"".join([bytes([c.itemsize for c in least]), *(c.tobytes() for c in least)])


def _unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    sizes = list(blob[:columns])
    n, at, out = (len(blob) - columns) // sum(sizes), columns, []
    for size in sizes:
        out.append(np.frombuffer(blob, f"u{size}", n, at).astype(np.uint64))
        at += n * size
    return out


def _by_bucket(a: np.ndarray, b: np.ndarray, split: tuple[np.ndarray, np.ndarray], buckets: int):
    """(bucket, places of its bigrams) of every bucket that has some. split: heads that are split, ascending, and into how many parts."""
    heads, parts = split
    at, there = _found(a, heads)
    part = np.zeros(len(a), np.uint64)
    part[there] = mix(b[there], 33) % parts[at[there]]
    bucket = (mix(mix(a, 31) + part, 32) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for first, end in zip(at, [*at[1:], len(order)]):
        yield int(bucket[order[first]]), order[first:end]


def _messages(a: np.ndarray, b: np.ndarray, n: np.ndarray, t: np.ndarray, split: tuple[np.ndarray, np.ndarray], buckets: int) -> list[tuple[int, bytes, bytes]]:
    """What a block sends to each bucket: its heads with the number of their followers, and the followers with their counts."""
    out = []
    for bucket, at in _by_bucket(a, b, split, buckets):
        first, k = _heads(a[at])
        out.append((bucket, _packed(a[at][first], k.astype(np.uint64)), _packed(b[at], n[at], t[at])))
    return out


_SENT = "block int, bucket int, heads binary, blob binary"
_BACK = _SENT + ", a long, " + ", ".join(f"f{k} long" for k in range(_FACTS))
#: In the place of a block: facts of a split head from one bucket; numbers of words of one bucket and their kinds, without split heads.
_OF_SPLIT, _OF_WORDS = -1, -2


def _facts(b: np.ndarray, n: np.ndarray, t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Facts of the heads that begin at `at`, a row each."""
    end = b == _END
    return np.stack([np.add.reduceat(x.astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for x in (~end, ~end & (t > 0), n * ~end, t * ~end, n * end, t * end)])


def _merged(key, table, heads_split: np.ndarray):
    """The bigrams of a bucket, packed by block, become: their sums and the facts of their heads, packed in the same order; and, for no
    block, the facts of split heads, and the numbers of words."""
    block = table.column("block").to_numpy()
    heads = [_unpacked(x.as_py(), 2) for x in table.column("heads")]
    sent = [_unpacked(x.as_py(), 3) for x in table.column("blob")]
    a = np.concatenate([np.repeat(x, k.astype(np.int64)) for x, k in heads])
    b, n, t = (np.concatenate(x) for x in zip(*sent, strict=True))
    ends = np.cumsum([len(x[0]) for x in sent])
    x, y, n, t, place = _counted(a, b, n.astype(np.int64), t.astype(np.int64))
    at, _ = _heads(x)
    own, facts = x[at], _facts(y, n, t, at)
    counts = [_packed(n[place[e - len(s[0]):e]].astype(np.uint64), t[place[e - len(s[0]):e]].astype(np.uint64)) for s, e in zip(sent, ends, strict=True)]
    of_heads = [_packed(*facts[:, np.searchsorted(own, h)].astype(np.uint64)) for h, _ in heads]
    _, split = _found(own, heads_split)
    words = facts[:, ~split & (own != _START)]
    totals = np.array([words[2].sum() + words[4].sum(), words[3].sum() + words[5].sum(), words.shape[1], 0, 0, 0])
    rest = np.concatenate([facts[:, split], totals[:, None]], axis=1)
    none = pa.nulls(rest.shape[1], pa.binary())
    return pa.table({
        "block": pa.array(np.concatenate([block, np.full(split.sum(), _OF_SPLIT), [_OF_WORDS]]).astype(np.int32)),
        "bucket": pa.array(np.full(len(block) + rest.shape[1], key[0].as_py(), np.int32)),
        "heads": pa.concat_arrays([pa.array(of_heads, pa.binary()), none]), "blob": pa.concat_arrays([pa.array(counts, pa.binary()), none]),
        "a": pa.concat_arrays([pa.nulls(len(block), pa.int64()), _as_long(own[split]), pa.nulls(1, pa.int64())]),
        **{f"f{k}": pa.concat_arrays([pa.nulls(len(block), pa.int64()), pa.array(v)]) for k, v in enumerate(rest)}})


def _split_heads(docs: DataFrame, known, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Heads to be split, ascending, and into how many parts, from some blocks of documents (block, text)."""
    def followers(batches):
        for batch in batches:
            texts = batch.append_column("named", pa.array(np.zeros(len(batch), bool))).append_column("doc_id", pa.nulls(len(batch), pa.int64()))
            _, target, n, before, own = _bigrams(pa.Table.from_batches([texts]), known.value)
            a, *_ = _own_counts(before, own, n, target)
            at, k = _heads(a)
            yield pa.RecordBatch.from_arrays([_as_long(np.append(a[at], np.uint64(_ALL))), pa.array(np.append(k, len(a)))], names=["head", "n"])

    found = docs.select("text").mapInArrow(followers, "head long, n long").groupBy("head").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "head").limit(buckets * SPLIT_PARTS + 1).toArrow()
    heads, n = top["head"].to_numpy().view(np.uint64), top["n"].to_numpy()
    parts = n * buckets * SPLIT_PARTS // max(int(n[heads == _ALL].sum()), 1)
    keep = (parts > 1) & (heads != _ALL)
    order = np.argsort(heads[keep])
    return heads[keep][order], parts[keep][order].astype(np.uint64)


def losses(n: np.ndarray, heads: np.ndarray, kinds: np.ndarray, words: np.ndarray, total: int, size: int) -> np.ndarray:
    """-log p(word | previous) from the counts of the bigram, its head, the kinds of followers of the head, and the word."""
    known = heads + kinds > 0
    share = np.where(known, kinds / np.maximum(heads + kinds, 1), 1.0)
    return -np.log(n / np.maximum(heads + kinds, 1) + share * ((words + 1) / (total + size)))


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, size: int | None = None) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss and score of every row; target_ids holds the target's doc_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(None if size is None else vocabulary(small_batches(docs), size))
    names = target_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("text"), F.lit(True).alias("named")).distinct()
    block = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(blocks)).cast("int")
    dealt = docs.withColumn("named", F.lit(False)).unionByName(names).withColumn("block", block).groupBy("block")

    buckets = max(LEAST_BUCKETS, blocks)
    split = context.broadcast(_split_heads(small_batches(docs).where(block < -(-blocks // SPLIT_SAMPLE)), shared, buckets))

    def count(key, table):
        _, target, n, before, own = _bigrams(table, shared.value)
        a, b, every, chosen, _ = _own_counts(before, own, n, target)
        sent = _messages(a, b, every, chosen, split.value, buckets)
        kinds = (pa.int32(), pa.binary(), pa.binary())
        return pa.table({"block": pa.array([key[0].as_py()] * len(sent), pa.int32()), **{c: pa.array([x[i] for x in sent], kind) for i, (c, kind) in enumerate(zip(("bucket", "heads", "blob"), kinds, strict=True))}})

    def merge(key, table):
        return _merged(key, table, split.value[0])

    counts = written(dealt.applyInArrow(count, _SENT).groupBy("bucket").applyInArrow(merge, _BACK), "bigram-counts", shuffles_end=True)
    facts = [F.sum(f"f{k}").alias(f"f{k}") for k in range(_FACTS)]
    # as many heads as were split, whose number is bounded by that of the buckets
    of_split = counts.where(F.col("block") == _OF_SPLIT).groupBy("a").agg(*facts).toArrow()
    heads = of_split["a"].to_numpy().view(np.uint64)
    order = np.argsort(heads)
    heads, of_split = heads[order], np.stack([of_split[f"f{k}"].to_numpy()[order] for k in range(_FACTS)])
    sums = counts.where(F.col("block") == _OF_WORDS).agg(*facts).first()
    of_words = of_split[:, heads != _START].sum(axis=1)
    totals = [int((sums[k] or 0) + of_words[2 + k] + of_words[4 + k]) for k in (0, 1)]
    cells = size if size is not None else int((sums[2] or 0) + np.count_nonzero(heads != _START)) + 2
    whole = context.broadcast((heads, of_split))
    back = counts.where("block >= 0").select("block", "bucket", "heads", "blob").groupBy("block")

    def score(_, table, given):
        ids, target, n, before, own = _bigrams(table, shared.value)
        a, b, *_, place = _own_counts(before, own, n, target)
        given = {bucket: x for bucket, *x in zip(*(given.column(c).to_pylist() for c in ("bucket", "heads", "blob")), strict=True)}
        first, k = _heads(a)
        head, names = np.repeat(np.arange(len(first)), k), a[first]
        found, facts = np.zeros((2, len(a)), np.int64), np.zeros((_FACTS, len(first)), np.int64)
        for bucket, at in _by_bucket(a, b, split.value, buckets):
            of_heads, blob = given[bucket]
            found[:, at] = _unpacked(blob, 2)
            facts[:, head[at[_heads(a[at])[0]]]] = _unpacked(of_heads, _FACTS)
        heads, of_split = whole.value
        at, there = _found(names, heads)
        facts[:, there] = of_split[:, at[there]]
        row, words, means = np.repeat(np.arange(len(n)), n), _found(b, names)[0], []
        for k in (1, 0):
            kinds, followed, ended = facts[k::2]
            loss = losses(found[k], followed[head], kinds[head], (followed + ended)[words], totals[k], cells) if len(a) else np.zeros(0)
            means.append(np.round(np.bincount(row, loss[place], len(n)) / np.maximum(n, 1), 6))
        columns = [pa.array(x, mask=n == 0) for x in (*means, np.round(means[0] - means[1], 6))]
        return pa.Table.from_arrays([ids, pa.array(n), *columns], names=["doc_id", "n_words", "target_loss", "background_loss", "score"])

    return dealt.cogroup(back).applyInArrow(score, "doc_id long, n_words long, target_loss double, background_loss double, score double")
