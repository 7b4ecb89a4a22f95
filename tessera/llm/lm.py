"""LM scoring: each document's log10 probability under a PPM model of the training documents, beside a word-count base."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, sliced, text_bytes, utf8, written
from .ppm import ORDER, base, codes_of, costs, kept, numbered, pairs_of, summed
from .quality import bucket
from .store import get_batch, put_batch, squeezed, squeezed_sorted, unsqueezed, unsqueezed_sorted
from .substring import BLOCK, block_file, grouped, new_block, shard_count
from ..sources.blocks import joined


#: Codes of a shard that are held before they are added up.
HELD = 1 << 21
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a block: number of each token's word, distinct words in order of first use, and their shards' lists."""

    def __init__(self, texts: list[bytes], shards: int):
        index: dict[bytes, int] = defaultdict(lambda: len(index))
        self.each = []
        for t in texts:
            w = t.lower().split()
            self.each.append(np.fromiter(map(index.__getitem__, w), np.int64, len(w)))
        self.words = list(index)
        shard = np.fromiter(map(zlib.crc32, self.words), np.int64, len(self.words)) % shards
        self.order = np.argsort(shard, kind="stable")
        self.cuts = np.searchsorted(shard[self.order], np.arange(shards + 1))


class Contexts:
    """The distinct codes of a block in order of shard, then code; the place of each byte's code; shards' lists.

    Codes that share their latest two context bytes have one shard.
    """

    def __init__(self, texts: list[bytes], order: int, shards: int):
        codes, self.place = numbered(codes_of(texts, order))
        shard = (((codes & kept(2)) * MIX) >> np.uint64(33)) % np.uint64(shards)
        self.order = np.argsort(shard, kind="stable")
        self.codes = codes[self.order]
        self.cuts = np.searchsorted(shard[self.order], np.arange(shards + 1))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, order: int = ORDER, share: float = 0.0) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row's whole text.

    Learns from all rows whose id's bucket is not held. Byte sequences are counted over all of them, and every one that occurs
    is known to the model; with a share, those below it of the bytes are left to the escape. Nothing of the model but pairs of
    bytes is held in one place: blocks of documents ask the shards for the counts of their own distinct words and for the
    probabilities of their own distinct contexts with the byte after them.
    Null text: empty, an end alone. Null id: as the empty id, whose bucket is 0. Repeated rows: each is learnt from and scored.
    Very long texts: whole, like any other. Other columns are not read. Empty table: no rows. No training rows:
    counts are 0 and every byte has the same probability.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "lm")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shard_count(spark, text_bytes(docs, text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"), (bucket(id_col, folds) == held).alias("held"))

    def gather(batches):
        names = ["kind", "shard", "block", "words", "counts", "n"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        made = lambda *columns: pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
        pairs = np.zeros(1 << 16, np.int64)
        for batch in joined(sliced(batches, size=BLOCK >> 3), BLOCK):  # small slices: a block is BLOCK bytes and little more
            name = new_block()
            put_batch(block_file(folder, name), batch)
            texts, out = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            w = Words(texts, shards)
            learnt = [e for e, h in zip(w.each, out) if not h]
            n = np.bincount(np.concatenate([np.zeros(0, np.int64), *learnt]), minlength=len(w.words)).astype("<u4")
            yield made(["block", "tokens", "docs"], [0, 0, 0], [name] * 3, [b""] * 3, [b""] * 3, [0, sum(map(len, learnt)), len(learnt)])
            there = [s for s in range(shards) if w.cuts[s] < w.cuts[s + 1]]
            mine = [w.order[w.cuts[s] : w.cuts[s + 1]] for s in there]
            if there:
                pack = zstandard.ZstdCompressor(level=1).compress
                yield made(["words"] * len(there), there, [name] * len(there), [pack(b" ".join([w.words[i] for i in m.tolist()])) for m in mine], [squeezed(n[m]) for m in mine], [0] * len(there))
            del w, learnt, mine
            c = Contexts(texts, order, shards)
            trains = np.repeat([not h for h in out], [len(t) + 1 for t in texts])
            n = np.bincount(c.place[trains], minlength=len(c.codes))[c.order]
            del trains
            c.place = None
            pairs += np.bincount(pairs_of(c.codes), weights=n, minlength=1 << 16).astype(np.int64)
            there = [slice(c.cuts[s], c.cuts[s + 1]) for s in range(shards)]
            some = [s for s, m in enumerate(there) if m.start < m.stop]
            yield made(["grams"] * len(some), some, [name] * len(some), [squeezed_sorted(c.codes[there[s]]) for s in some], [squeezed(n[there[s]].astype("<u4")) for s in some], [0] * len(some))
        at = np.flatnonzero(pairs)
        if len(at):
            yield made(["pairs"] * len(at), at, [0] * len(at), [b""] * len(at), [b""] * len(at), pairs[at])

    def count_words(batches):
        for shard, (_, names, words, counts) in grouped(batches):
            total: dict[bytes, int] = defaultdict(int)
            lists = []
            for w, n in zip(words, counts):
                w = zstandard.ZstdDecompressor().decompress(w).split(b" ")
                for x, k in zip(w, unsqueezed(n, "<u4").tolist()):
                    total[x] += k
                lists.append(w)
            distinct = sum(1 for k in total.values() if k)
            for j, (name, w) in enumerate(zip(names, lists)):
                n = np.fromiter(map(total.__getitem__, w), "<u8", len(w))
                yield pa.record_batch([pa.array([name], pa.int64()), pa.array([shard], pa.int32()), pa.array([squeezed(n)], pa.binary()), pa.array([distinct * (j == 0)], pa.int64())], names=["block", "shard", "data", "distinct"])

    def weigh(batches):
        low = None
        for shard, (_, names, lists, counts) in grouped(batches):
            low = low or base(held_pairs.value, order, least)
            held, size = [], 0
            for x, n in zip(lists, counts):
                held.append((unsqueezed_sorted(x), unsqueezed(n, "<u4").astype(np.int64)))
                size += len(held[-1][0])
                if size > HELD + 2 * len(held[0][0]):
                    held = [summed(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
            codes, n = summed(*map(np.concatenate, zip(*held)))
            del held
            cost = costs(codes, n, order, least, low)
            for name, x in zip(names, lists):
                mine = cost[np.searchsorted(codes, unsqueezed_sorted(x))]
                yield pa.record_batch([pa.array([name], pa.int64()), pa.array([-2 - shard], pa.int32()), pa.array([squeezed(mine.astype("<f4"))], pa.binary())], names=["block", "shard", "data"])

    sent = written(rows.mapInArrow(gather, "kind string, shard int, block long, words binary, counts binary, n long"), "gathered")
    totals = {r["kind"]: r["n"] for r in sent.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # five kinds
    size, trained = totals.get("pairs", 0), totals.get("docs", 0)
    least = max(1, int(np.ceil(share * size)))
    pairs = np.zeros(1 << 16, np.int64)
    for r in sent.where("kind = 'pairs'").groupBy("shard").agg(F.sum("n").alias("n")).collect():  # at most 2 ** 16
        pairs[r["shard"]] = r["n"]
    held_pairs = spark.sparkContext.broadcast(pairs)  # 2 ** 16 numbers, whatever the corpus
    asked = sent.where("kind = 'words'").select("shard", "block", "words", "counts")
    told = written(asked.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(count_words, "block long, shard int, data binary, distinct long"), "words")
    tokens = totals.get("tokens", 0) + trained
    distinct = (told.agg(F.sum("distinct")).first()[0] or 0) + (trained > 0)
    asked = sent.where("kind = 'grams'").select("shard", "block", "words", "counts")
    weighed = asked.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(weigh, "block long, shard int, data binary")
    scale = float(np.log10(tokens + distinct + 1))

    def score(batches):
        for name, (_, shard, data) in grouped(batches):
            batch = get_batch(block_file(folder, name))
            texts = batch.column(1).to_pylist()
            w, c = Words(texts, shards), Contexts(texts, order, shards)
            counts = np.zeros(len(w.words) + 1, np.int64)
            counts[-1] = trained
            cost = np.zeros(len(c.codes))
            for s, d in zip(shard, data):
                if s >= 0:
                    counts[w.order[w.cuts[s] : w.cuts[s + 1]]] = unsqueezed(d, "<u8")
                elif s < -1:
                    cost[c.order[c.cuts[-2 - s] : c.cuts[-1 - s]]] = unsqueezed(d, "<f4")
            value = np.log10(counts + 1.0) - scale
            known = counts > 0
            tokens_of = [len(e) + 1 for e in w.each]
            sums = [float(value[e].sum() + value[-1]) for e in w.each]
            seen = [int(known[e].sum() + known[-1]) for e in w.each]
            sizes = np.array([len(t) + 1 for t in texts], np.int64)
            scores = np.add.reduceat(cost[c.place], np.cumsum(sizes) - sizes)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(tokens_of, pa.int64()), pa.array(seen, pa.int64()), pa.array([tokens] * len(texts), pa.int64()), pa.array(sums, pa.float64()), pa.array(scores)], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    every = told.select("block", "shard", "data").union(weighed).union(sent.where("kind = 'block'").select("block", F.lit(-1).alias("shard"), F.lit(b"").alias("data")))
    return every.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(score, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
