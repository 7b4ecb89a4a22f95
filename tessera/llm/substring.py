"""Substring dedup: words of windows that also start in a document with a smaller id go, found by FM-indexes of shards.

A shard can't hold all documents, nor can each document be searched in each shard. So windows are dealt to shards by an
anchor that equal windows share: the smallest hash of the GRAM-word sequences in the window. Runs of windows with one anchor
are segments. Only segments whose anchor stands in two documents or more reach a shard, once for each block of documents that
holds them; there they are indexed and streamed against the index, and matching statistics of a window's length or more make up
the intervals that are reported, once for each block. Hot passages therefore cost a row for each block, not for each document.
Around a hot passage each document has segments of its own, with one anchor; a crowded anchor's segments are split into windows.
Equal windows become one row with their smallest owner before any task takes them, and what the index says of them is joined
back to the blocks, which adaptive execution splits where a window is hot.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, shared_path, sliced, text_bytes, written
from ..sources.blocks import joined
from .fmindex import FMIndex, interval_minima
from .store import get_batch, put_batch, squeezed, squeezed_sorted, unsqueezed, unsqueezed_sorted

GRAM = 5
#: Bytes of text in a block, and rows of segments that one FM-index takes (whole anchors, so one anchor may exceed it).
BLOCK = 5 << 20
INDEX = 30_000
#: Rows of segments with one anchor beyond which its windows are dealt out one by one, by their own hash.
CROWDED = 1000
#: Bytes of text whose anchors make up a shard at most.
SHARD = 256 << 20
NONE = np.iinfo(np.int64).max
FREE = np.iinfo(np.int64).min
WORDS = 200_000
#: Bits of an anchor's hash that don't go to the test of what is repeated: a clash only sends a segment in vain.
CUT = np.uint64(16)
ODD = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """64-bit hashes of words, held while few."""

    def __missing__(self, word):
        if len(self) > WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Block:
    """The words of some documents, laid end to end, with the anchors of their windows."""

    def __init__(self, batch: pa.RecordBatch, size: int, hashes: Hashes):
        texts = batch.column("text").to_pylist()
        ids = batch.column("id")
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.words, counts = [], []
        for t in texts:
            w = t.split() if t else []
            counts.append(len(w))
            self.words += w
        self.counts = np.array(counts, np.int64)
        self.ends = np.cumsum(self.counts)
        n = len(self.words)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        self.size = size
        self.start = self.anchor = np.zeros(0, np.int64)
        self.gram = np.zeros(0, np.uint64)
        if n < size:
            return
        h = np.fromiter(map(hashes.__getitem__, self.words), np.uint64, n)
        span = min(GRAM, size)
        g = h[: n - span + 1].copy()
        for k in range(1, span):
            g *= ODD
            g += h[k : n - span + 1 + k]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        reach = size - span + 1
        total = n - size + 1
        least = g[:total].copy()
        for k in range(1, reach):
            np.minimum(least, g[k : total + k], out=least)
        where = np.full(total, -1)
        for k in range(reach - 1, -1, -1):
            hit = g[k : total + k] == least
            where[hit] = np.flatnonzero(hit) + k
        start = np.flatnonzero(self.doc[:total] == self.doc[size - 1 :])
        self.start, self.anchor, self.gram = start, where[start], least[start]

    def owners(self) -> np.ndarray:
        return np.where(self.known, self.ids, NONE)


def new_block() -> int:
    """A number that no other block has, nor another attempt at the same one."""
    return secrets.randbits(63)


def block_file(folder: str, block: int) -> str:
    return f"{folder}/{block:016x}"


def blocks(batches):
    """Record batches joined up to BLOCK bytes of text."""
    return joined(sliced(batches), BLOCK)


def runs(block: Block, repeated: np.ndarray):
    """Segments of a block whose anchor's cut hash is in repeated (sorted): first window, count of windows, hash, document."""
    if not len(block.start) or not len(repeated):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), z
    new = np.ones(len(block.start), bool)
    new[1:] = block.anchor[1:] != block.anchor[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate([at, [len(new)]]))
    short = block.gram[at] >> CUT
    keep = repeated[np.minimum(np.searchsorted(repeated, short), len(repeated) - 1)] == short
    first = block.start[at[keep]]
    return first, count[keep], block.gram[at[keep]], block.doc[first]


def grouped(batches, key: int = 0):
    """Rows sorted by a column, a group at a time: (key, columns as lists of Python values)."""
    held, now = None, None
    for b in batches:
        keys = b.column(key).to_pylist()
        cols = [b.column(k).to_pylist() for k in range(b.num_columns)]
        for i, k in enumerate(keys):
            if held is None or k != now:
                if held is not None:
                    yield now, held
                held, now = [[] for _ in cols], k
            for c, out in zip(cols, held):
                out.append(c[i])
    if held is not None:
        yield now, held


def shard_count(spark: SparkSession, bytes_: int) -> int:
    """Shards for so many bytes of text: a shard's share is bounded whatever the session's settings; no fewer than keep all tasks busy."""
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // SHARD))


def ranks(ids: DataFrame) -> DataFrame:
    """(id, rank) of the distinct ids that are not null, by their order: dealt by ranges, numbered within, after all smaller ranges."""
    dealt = ids.where("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id")
    numbered = written(dealt.select("id", F.monotonically_increasing_id().alias("at")), "ids")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each partition
    before, total = [], 0
    for r in sizes:
        before.append((r["part"], total))
        total += r["n"]
    offsets = F.broadcast(ids.sparkSession.createDataFrame(before, "part long, before long"))
    return numbered.withColumn("part", part).join(offsets, "part").select("id", (F.col("before") + place).alias("rank"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """docs with two more columns in front, and with text_col as the words kept, joined by one space.

    n_words and n_removed count words before and removed. A word goes if a window of size words that covers it, as given,
    also starts in a row with a smaller id. Ids are whole numbers, or of any type that Spark orders: these are ranked first. Null
    text: none, so no words, and the result's text is empty. Texts under size words: all kept. Repeated rows of one id: not
    smaller than each other, so both stay. Null id: nothing is smaller than it, and it is smaller than nothing. Other columns
    pass through, whatever their names. Empty table: no rows.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "blocks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shard_count(spark, text_bytes(docs, text_col))
    others = [c for c in docs.columns if c != text_col]
    passed = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]
    own = others.index(id_col)
    held = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"), *passed)
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        held = held.withColumn("id", F.col("id").cast("long"))
    else:
        held = held.drop("id").join(ranks(held.select("id")).withColumnRenamed("id", "_id"), F.col(f"c{own}") == F.col("_id"), "left")
        held = held.select(F.col("rank").alias("id"), "text", *[f"c{k}" for k in range(len(others))])

    def anchors(batches):
        hashes = Hashes()
        for batch in blocks(batches):
            name = new_block()
            put_batch(block_file(folder, name), batch)
            b = Block(batch, size, hashes)
            yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([name], pa.int64()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())], names=["shard", "block", "data", "owners"])
            if not len(b.start):
                continue
            new = np.ones(len(b.start), bool)
            new[1:] = b.anchor[1:] != b.anchor[:-1]
            gram, owner = b.gram[new] >> CUT, b.owners()[b.doc[b.start[new]]]
            order = np.lexsort((owner, gram))
            gram, owner = gram[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            last = np.concatenate([first[1:], [len(gram)]]) - 1
            several = owner[first] != owner[last]
            gram, owner = gram[first], np.where(several, FREE, owner[first])
            shard = gram % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            gram, owner, cuts = gram[order], owner[order], np.searchsorted(shard[order], np.arange(shards + 1))
            there = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
            grams, owners = ([f(x[cuts[s] : cuts[s + 1]]) for s in there] for f, x in ((squeezed_sorted, gram), (squeezed, owner)))
            yield pa.record_batch([pa.array(there, pa.int32()), pa.array([name] * len(there), pa.int64()), pa.array(grams, pa.binary()), pa.array(owners, pa.binary())], names=["shard", "block", "data", "owners"])
            b = batch = gram = owner = order = grams = owners = None  # the next block is built without this one in memory

    def repeated(batches):
        for _, (_, names, data, owners) in grouped(batches):
            data, owners = [unsqueezed_sorted(x) for x in data], [unsqueezed(x, "<i8") for x in owners]
            source = np.repeat(np.arange(len(data)), [len(x) for x in data])
            gram, owner = np.concatenate(data), np.concatenate(owners)
            order = np.lexsort((owner, gram))
            gram, owner, source = gram[order], owner[order], source[order]
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            counts = np.diff(np.concatenate([first, [len(gram)]]))
            several = (owner[first] == FREE) | (owner[first] != owner[first + counts - 1])
            keep = np.repeat(several, counts)
            gram, source = gram[keep], source[keep]
            order = np.argsort(source, kind="stable")
            gram, source = gram[order], source[order]
            cuts = np.searchsorted(source, np.arange(len(names) + 1))
            there = [k for k in range(len(names)) if cuts[k] < cuts[k + 1]]
            if there:
                yield pa.record_batch([pa.array([names[k] for k in there], pa.int64()), pa.array([squeezed_sorted(gram[cuts[k] : cuts[k + 1]]) for k in there], pa.binary())], names=["block", "data"])

    def segments(batches):
        hashes = Hashes()
        for name, (_, data) in grouped(batches):
            b = Block(get_batch(block_file(folder, name)), size, hashes)
            first, count, gram, doc = runs(b, np.sort(np.concatenate([unsqueezed_sorted(x) for x in data])))
            if not len(first):
                continue
            owner = b.owners()[doc]
            index: dict[bytes, int] = {}
            number = np.empty(len(first), np.int64)
            for k, (i, c) in enumerate(zip(first.tolist(), count.tolist())):
                number[k] = index.setdefault(b" ".join(b.words[i : i + c + size - 1]), len(index))
            least = np.full(len(index), NONE)
            np.minimum.at(least, number, owner)
            hashed = np.zeros(len(index), np.uint64)
            hashed[number] = gram
            put_batch(block_file(folder, name) + ".runs", pa.record_batch([pa.array(first), pa.array(count), pa.array(number), pa.array(least[number])], names=["first", "count", "number", "least"]))
            yield pa.record_batch([pa.array(hashed.view(np.int64)), pa.array([name] * len(index), pa.int64()), pa.array(np.arange(len(index))), pa.array(list(index), pa.binary()), pa.array(least)], names=["gram", "block", "number", "words", "least"])
            b = index = None

    def windows(batches):
        """Rows of crowded anchors as rows of their windows, under the windows' hash."""
        for b in batches:
            for i in range(0, b.num_rows, 200):
                out = [[] for _ in range(6)]
                for block, number, words, least in zip(*(b.column(k).slice(i, 200).to_pylist() for k in range(4))):
                    w = words.split(b" ")
                    for k in range(len(w) - size + 1):
                        text = b" ".join(w[k : k + size])
                        for column, v in zip(out, (xxhash.xxh64_intdigest(text) - (1 << 63), block, number, k, text, least)):
                            column.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], names=["gram", "block", "number", "place", "words", "least"])

    def indexed(index, owner):
        """For an index of texts and their owners: the windows of each text (begin, count), and the smallest owner of each window."""
        symbols: dict[bytes, int] = {}
        laid, sizes = [], []
        for s in index:
            w = s.split(b" ")
            sizes.append(len(w))
            laid += [symbols.setdefault(x, len(symbols) + 1) for x in w]
        laid, sizes = np.array(laid, np.int64), np.array(sizes, np.int64)
        ends = np.cumsum(sizes)
        fm = FMIndex(laid, ends)
        count = sizes - size + 1
        begin = np.cumsum(count) - count
        last = np.arange(count.sum()) - np.repeat(begin - (ends - sizes), count) + size - 1
        matched, lo, hi = fm.statistics(lambda k, some: laid[last[some] - k], size, len(last))
        found = np.repeat(owner, count)  # a window that stands in one place has the owner of its text
        above = np.flatnonzero(matched >= size)
        found[above] = interval_minima(lambda at: owner[fm.sequences(at)], lo[above], hi[above])
        return begin, count, found

    def packed(block, numbers):
        """Rows (block, data): the numbers of each row, by block."""
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1], [True]])) if len(order) else np.zeros(1, np.int64)
        data = [np.concatenate([numbers(k) for k in order[a:c].tolist()]).astype("<i8").tobytes() for a, c in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return pa.record_batch([pa.array(block[order][cuts[:-1]]), pa.array(data, pa.binary())], names=["block", "data"])

    def searched(index, rows):
        block, number, least, seg = (np.concatenate(x) for x in zip(*rows))
        owner = np.full(len(index), NONE)
        np.minimum.at(owner, seg, least)
        begin, count, found = indexed(index, owner)
        told = np.flatnonzero(np.minimum.reduceat(found, begin)[seg] < least)
        block, number, seg = block[told], number[told], seg[told]
        return packed(block, lambda k: np.concatenate([(number[k], 0, count[seg[k]]), found[begin[seg[k]] : begin[seg[k]] + count[seg[k]]]]))

    def owners(batches):
        """Crowded windows, each once, with the smallest owner that the index has for it."""
        for b in joined(sliced(batches, INDEX), 1 << 20):
            _, _, found = indexed(b["words"].to_pylist(), b["least"].to_numpy())
            yield pa.record_batch([b["gram"], b["words"], pa.array(found)], names=["gram", "words", "owner"])

    def placed(batches):
        for b in batches:
            number, place, owner = (b[c].to_numpy() for c in ("number", "place", "owner"))
            yield packed(b["block"].to_numpy(), lambda k: np.array([number[k], place[k], 1, owner[k]]))  # noqa: B023

    def answers(batches):
        index: dict[bytes, int] = {}
        rows, last = [], None
        for b in batches:
            gram, block, number, least = (b[c].to_numpy() for c in ("gram", "block", "number", "least"))
            words = b["words"].to_pylist()
            cuts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1], [True]])) if len(gram) else np.zeros(1, np.int64)
            for a, c in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if gram[a] != last and len(index) >= INDEX:  # an index takes whole anchors
                    yield searched(index, rows)
                    index, rows = {}, []
                last = gram[a]
                seg = np.fromiter((index.setdefault(w, len(index)) for w in words[a:c]), np.int64, c - a)
                rows.append((block[a:c], number[a:c], least[a:c], seg))
        if rows:
            yield searched(index, rows)

    def kept(batches):
        hashes = Hashes()
        for name, (_, data) in grouped(batches):
            batch = get_batch(block_file(folder, name))
            data = [x for x in data if x]
            b = Block(batch, NONE, hashes)
            edge = np.zeros(len(b.words) + size + 1, np.int32)
            if any(x == b"runs" for x in data):
                r = get_batch(block_file(folder, name) + ".runs")
                first, count, number, least = (r.column(k).to_numpy() for k in range(4))
                spread = np.repeat(np.arange(len(first)), count)
                place = np.arange(len(spread)) - np.repeat(np.cumsum(count) - count, count)
                owner = least[spread]
                windows_of = np.zeros(int(number.max()) + 1, np.int64)
                windows_of[number] = count
                base = np.cumsum(windows_of) - windows_of
                low = np.full(int(windows_of.sum()), NONE)
                for flat in (np.frombuffer(x, "<i8") for x in data if x != b"runs"):
                    at = 0
                    while at < len(flat):
                        k, n = base[flat[at]] + flat[at + 1], int(flat[at + 2])
                        low[k : k + n] = np.minimum(low[k : k + n], flat[at + 3 : at + 3 + n])
                        at += 3 + n
                owner = np.minimum(owner, low[base[number[spread]] + place])
                start = first[spread] + place
                own = np.where(b.known, b.ids, FREE)[b.doc[start]]
                start = start[owner < own]
                np.add.at(edge, start, 1)
                np.add.at(edge, start + size, -1)
            gone = np.cumsum(edge)[: len(b.words)] > 0
            texts, lost, begin = [], [], 0
            for end in b.ends.tolist():
                part = gone[begin:end]
                lost.append(int(part.sum()))
                texts.append(b" ".join(b.words[begin:end] if not lost[-1] else [w for w, g in zip(b.words[begin:end], part.tolist()) if not g]))
                begin = end
            extra = [batch.column(k) for k in range(2, batch.num_columns)]
            out = pa.Table.from_arrays([pa.array(b.counts), pa.array(lost, pa.int64()), batch.column(0), pa.array(texts, pa.binary()), *extra], names=["n_words", "n_removed", *batch.schema.names])
            yield from out.to_batches(max_chunksize=1000)
            b = batch = out = texts = extra = None

    place = shared_path(spark, "anchors")
    held.mapInArrow(anchors, "shard int, block long, data binary, owners binary").write.parquet(place)
    sent = spark.read.parquet(place)
    marks = written(sent.where("shard < 0").select("block", "data"), "blocks")
    asked = sent.where("shard >= 0").repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(repeated, "block long, data binary")
    found = written(asked.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(segments, "gram long, block long, number long, words binary, least long"), "segments")
    dropped(spark, place)
    crowded = written(found.groupBy("gram").count().where(F.col("count") > CROWDED).select("gram"), "crowded")  # Spark sees its size and broadcasts it only if small
    whole = found.join(crowded, "gram", "left_anti").select("gram", "block", "number", "words", "least")
    told = whole.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(answers, "block long, data binary")
    if not crowded.isEmpty():
        split = written(found.join(crowded, "gram", "left_semi").select("block", "number", "words", "least").mapInArrow(windows, "gram long, block long, number long, place long, words binary, least long"), "windows")
        each = split.groupBy("gram", "words").agg(F.min("least").alias("least"), F.max("least").alias("most")).where("least < most")
        known = written(each.select("gram", "words", "least").mapInArrow(owners, "gram long, words binary, owner long"), "owners")
        back = split.join(known, ["gram", "words"]).where("owner < least").select("block", "number", "place", "owner")
        told = told.union(back.mapInArrow(placed, "block long, data binary"))
    having = found.select("block").distinct().select("block", F.lit(b"runs").alias("data"))
    every = marks.union(having).union(told)
    schema = ", ".join(["n_words long", "n_removed long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)])
    out = every.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(kept, schema)
    named = {c: F.col(f"c{k}") for k, c in enumerate(others)} | {text_col: F.col("text").cast("string")}
    return out.select("n_words", "n_removed", *[named[c].alias(c) for c in docs.columns])
