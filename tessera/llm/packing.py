"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights and rounded."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, utf8, written

#: Words whose ids a worker keeps, and prices of the program that are tried.
CACHED = 300_000
ROUNDS = 600
#: Bytes of a word whose ids are cached at most; longer ones are worked out each time.
LONG = 256
#: How the supported tokenizers normalise and split, as their files say it.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Bytes as the characters that stand for them in a byte-level vocabulary: printable ones as themselves, others from U+0100 on.
SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
BYTES = {b: b for b in SHOWN} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in SHOWN)}
#: Words up to U+017F without apostrophes, controls or white space: composed, of letters, numbers and others by these ranges.
PLAIN = re.compile("[!-&(-~\u00a1-\u017f]+")
LETTERS, NUMBERS = "a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PARTS = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}]+")


class WordIds(dict):
    """Ids of words as little-endian unsigned 32-bit numbers, by word.

    The tokenizer drops white space before it splits a text, so a text's ids are those of its words. Plain words are split here
    as the tokenizer would and go straight to its model; all others go through the tokenizer itself.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        spec = json.loads(self.tokenizer.to_str())
        steps = [(spec.get(k) or {}).get(part) for k, part in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        model = spec["model"]
        plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
        added = [t["content"] for t in spec.get("added_tokens", [])]
        if steps != [NORMALIZER, SPLITTER] or not plain or not all(t.startswith("<|") and not t.split()[1:] for t in added):
            raise ValueError("only tokenizers that drop white space, lower letters and split as SPLITTER says are supported")
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(BYTES)
            found = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            if len(part) <= LONG:
                if len(self.parts) > CACHED:
                    self.parts.clear()
                self.parts[part] = found
        return found

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if PLAIN.fullmatch(text) and "<|" not in text:
            text = text.lower()
            ids = self.part(text) if text.isalpha() and text.isascii() else b"".join(map(self.part, PARTS.findall(text)))
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONG:
            if len(self) > CACHED:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(1)
def word_ids(file: str) -> WordIds:
    """One for each worker, which runs many tasks."""
    return WordIds(file)


def pieces(docs: DataFrame, file: str, size: int, id_col: str = "doc_id", text_col: str = "text", end: int = 0) -> DataFrame:
    """(id, piece, start, length, crc, task, rank): what documents of ids and the end id are cut into.

    rank numbers a task's pieces of one length, so that a written table has a place for every piece without any sort.
    """

    def run(batches):
        words, tail = word_ids(file), np.array([end], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), defaultdict(int)
        for b in sliced(batches):
            out = [[] for _ in range(7)]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = words.ids(text) + tail
                for k in range(0, len(ids), 4 * size):
                    part = ids[k : k + 4 * size]
                    n = len(part) // 4
                    for column, v in zip(out, (key, k // (4 * size), k // 4, n, zlib.crc32(part), task, seen[n])):
                        column.append(v)
                    seen[n] += 1
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], names=["id", "piece", "start", "length", "crc", "task", "rank"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), utf8(text_col)).mapInArrow(run, f"id {kind}, piece int, start long, length long, crc long, task int, rank long")


def priced(lengths: np.ndarray, prices: np.ndarray, size: int) -> dict[int, int]:
    """The configuration of the highest price that fits into size, by knapsack dynamic programming: length to copies."""
    best, pick = np.zeros(size + 1), np.full(size + 1, -1)
    upto = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for c in range(int(lengths[0]), size + 1):
        k = upto[c]
        v = best[c - lengths[:k]] + prices[:k]
        i = int(v.argmax())
        if v[i] > best[c - 1]:
            best[c], pick[c] = v[i], i
        else:
            best[c], pick[c] = best[c - 1], -1
    out: dict[int, int] = defaultdict(int)
    c = size
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            n = int(lengths[pick[c]])
            out[n] += 1
            c -= n
    return dict(out)


def fractional(hist: dict[int, int], size: int, rounds: int = ROUNDS, step: float = 0.25, rate: float = 1.0) -> list[tuple[dict[int, int], float]]:
    """Configurations and how often each is used. A length's price is its tokens times a weight that falls with its cover."""
    lengths = np.array(sorted(hist), np.int64)
    need = np.array([hist[int(n)] for n in lengths], np.float64)
    cover, used = np.zeros(len(lengths)), []
    place = {int(n): i for i, n in enumerate(lengths)}
    for _ in range(rounds):
        open_ = cover < 1 - 1e-9
        if not open_.any():
            break
        left = lengths[open_]
        # Of equal prices the one of longer pieces: short ones close gaps later.
        config = priced(left, left * (1 + 1e-3 * left / size) * np.exp(-rate * cover[open_]), size)
        at = np.array([place[n] for n in config])
        copies = np.array(list(config.values()), np.float64)
        times = (np.minimum(step, 1 - cover[at]) * need[at] / copies).min()
        cover[at] += times * copies / need[at]
        used.append((config, float(times)))
    return used


def rounded(hist: dict[int, int], used: list[tuple[dict[int, int], float]], size: int) -> list[tuple[dict[int, int], int]]:
    """Whole sequences: floors, then once more by the part that is left where lengths allow, then best fit for what remains."""
    left = dict(hist)
    merged: dict[tuple, float] = defaultdict(float)
    for config, times in used:
        merged[tuple(sorted(config.items()))] += times
    groups: list[tuple[dict[int, int], int]] = []

    def take(config, times):
        times = min([times, *(left[n] // c for n, c in config)])
        if times > 0:
            for n, c in config:
                left[n] -= c * times
            groups.append((dict(config), times))

    for config, times in merged.items():
        take(config, int(times))
    for config, times in sorted(merged.items(), key=lambda x: (-(x[1] % 1), x[0])):
        take(config, 1)
    room: dict[int, list] = defaultdict(list)
    for config, times in groups:
        room[size - sum(n * c for n, c in config.items())].append((config, times))
    for n in sorted((n for n in left if left[n]), reverse=True):
        m = left[n]
        for r in range(n, size):
            while m and room[r]:
                config, times = room[r].pop()
                k = min(r // n, m)  # copies in one sequence: having taken one, it is the tightest for the next
                t = min(times, m // k)
                if t < times:
                    room[r].append((config, times - t))
                m -= t * k
                room[r - k * n].append((config | {n: config.get(n, 0) + k}, t))
            if not m:
                break
        each = size // n
        if m // each:
            room[size - each * n].append(({n: each}, m // each))
        if m % each:
            room[size - m % each * n].append(({n: m % each}, 1))
    return [g for r in sorted(room) for g in room[r] if g[1]]


def plan(hist: dict[int, int], size: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Groups of equal sequences for a histogram of lengths: (length to copies, sequences)."""
    whole = [({size: 1}, hist[size])] if hist.get(size) else []
    rest = {n: c for n, c in hist.items() if 0 < n < size and c}
    return whole + (rounded(rest, fractional(rest, size, rounds), size) if rest else [])


def pack(docs: DataFrame, file: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, crc, sequence_id, offset): every piece's place in sequences of at most size ids.

    The histogram, of size rows at most, and the plan from it are all that reaches the driver; pieces take their places by
    their number among those of their length. Null or empty text: the end id alone. Null id and repeated rows: packed like
    any other. Other columns are not read. Very long texts: cut into whole pieces and a last one. Empty table: no rows.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, file, size, id_col, text_col), "pieces")
    each = written(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    hist = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size rows at most
    taken: dict[int, int] = defaultdict(int)
    runs, sequence = [], 0
    for config, times in plan(hist, size):
        offset = 0
        for n, copies in sorted(config.items(), reverse=True):
            for _ in range(copies):
                runs.append((n, taken[n], sequence, offset))
                taken[n] += times
                offset += n
        sequence += times
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 4)
    held = spark.sparkContext.broadcast(table)  # slots of distinct configurations: at most (ROUNDS + size) * size

    def place(batches):
        runs = held.value
        keys = (runs[:, 0] << 48) + runs[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(runs[at, 2] + rank - runs[at, 1]), pa.array(runs[at, 3])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    based = each.select("length", "task", F.coalesce(before, F.lit(0)).alias("base"))
    # based grows with the tasks, so it is not to be broadcast.
    ranked = cut.join(based.hint("merge"), ["length", "task"]).select("id", "piece", "start", "length", "crc", (F.col("rank") + F.col("base")).alias("rank"))
    kind = cut.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, crc long, sequence_id long, offset long")
