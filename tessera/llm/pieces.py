"""SentencePiece encoding and decoding: distinct marked words, sorted into a trie, share forward states along common prefixes.

Models with a score for each piece (unigram) take the Viterbi path: a prefix's forward score is the best sum over its last piece.
For merge models (BPE) the sum of scores does not give the library's pieces. There a step to a piece scores zero if no merge would
cross its boundary to the piece before it, and minus infinity otherwise, which leaves one way to every prefix: the forward state is
its last piece. Either state depends on the prefix alone, so a depth-first walk over sorted words computes it once for all words
that begin with the prefix.
"""

from __future__ import annotations

import re
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, utf8

SPACE = "▁"
#: Marked words whose ids a worker keeps, and pairs of pieces whose boundary it has judged.
CACHED = 300_000
#: Characters of a word whose ids are kept at most; longer ones are worked out each time.
LONG = 256
UNSEEN = 10.0
NEVER = float("inf")


class Pieces:
    """Pieces, scores and kinds of a model file, or of given (piece, score) pairs."""

    def __init__(self, pieces: list[tuple[str, float]], merges: bool, unknown: int = 0, byte_ids: dict[int, int] | None = None, plain: list[bool] | None = None):
        self.text = [p for p, _ in pieces]
        self.score = [s for _, s in pieces]
        self.merges, self.unknown, self.byte_ids = merges, unknown, byte_ids or {}
        usable = plain or [True] * len(pieces)
        self.ids = {p: i for i, (p, _) in enumerate(pieces) if usable[i]}
        self.longest = max(map(len, self.ids), default=1)
        self.chars = set("".join(self.ids))
        self.least = min((self.score[i] for i in self.ids.values()), default=0.0) - UNSEEN
        self.raw = [p.replace(SPACE, " ").encode() if u else b"" for p, u in zip(self.text, usable)]
        for b, i in self.byte_ids.items():
            self.raw[i] = bytes([b])
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}
        self.coded = [np.array([i], "<i4").tobytes() for i in range(len(pieces))]
        self.parts: dict[int, tuple[int, int]] = {}
        self.whole = dict(self.ids)  # pieces that merges can lead to
        if merges:
            for p, i in self.ids.items():
                if len(p) > 1:
                    last: list = []
                    if self.merged(p, last) == [i]:
                        self.parts[i] = last[-1]
                    else:
                        del self.whole[p]
        #: Length of the longest piece of spaces, if long runs are that piece over and over.
        self.stride = max((len(p) for p in self.whole if p.strip(SPACE) == ""), default=0)
        if self.stride:
            lead = self.ids[SPACE * self.stride]
            if any(self.merged(SPACE * (n + self.stride)) != [lead, *self.merged(SPACE * n)] for n in range(self.stride + 1, 3 * self.stride + 1)):
                self.stride = 0

    @classmethod
    def load(cls, file: str, best: bool = False) -> Pieces:
        """A model file's pieces; best takes them by the best sum of scores, whatever the model's kind."""
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        sp = SentencePieceProcessor(model_file=file)
        spec = proto.ModelProto.FromString(sp.serialized_model_proto())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix:
            raise ValueError("only models that keep text as it is, with a space in front, are supported")
        n = range(sp.get_piece_size())
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in n]
        bytes_ = {int(sp.id_to_piece(i)[3:5], 16): i for i in n if sp.is_byte(i)}
        return cls([(sp.id_to_piece(i), sp.get_score(i)) for i in n], train.model_type == 2 and not best, sp.unk_id(), bytes_, plain)

    def merged(self, word: str, trace: list | None = None) -> list[int]:
        """Ids by merging the neighbours of the highest score, leftmost first, until none merge. Characters beyond the pieces: -1.

        Neighbours wait in a heap, so that long words take n log n steps.
        """
        parts: list = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def meet(k: int) -> None:
            if k >= 0 and after[k] < len(parts):
                joined = parts[k] + parts[after[k]]
                i = self.ids.get(joined)
                if i is not None:
                    heappush(heap, (-self.score[i], k, joined))

        for k in range(len(parts)):
            meet(k)
        while heap:
            _, k, joined = heappop(heap)
            if parts[k] is None or after[k] >= len(parts) or parts[k] + parts[after[k]] != joined:
                continue  # one of the two has been merged since
            n = after[k]
            if trace is not None:
                trace.append((self.ids.get(parts[k], -1), self.ids.get(parts[n], -1)))
            parts[k], parts[n], after[k] = joined, None, after[n]
            if after[n] < len(parts):
                before[after[n]] = k
            meet(k)
            meet(before[k])
        return [self.ids.get(p, -1) for p in parts if p is not None]

    def spaced(self, word: str) -> bytes:
        """Ids of a word behind a run of spaces. Pieces of spaces have equal scores and are merged from the left, so a long run begins
        with the longest of them again and again; what repeats is not merged anew."""
        run = len(word) - len(word.lstrip(SPACE))
        again = max(0, (run - 4 * self.stride) // self.stride) if self.stride else 0
        rest = word[again * self.stride :]
        return self.coded[self.ids[SPACE * self.stride]] * again + self.packed(self.merged(rest), rest) if again else self.packed(self.merged(word), word)

    def spine(self, i: int, side: int) -> list[tuple[int, float, float]]:
        """The pieces at one end of a piece while it is merged: (piece, when it comes to be, when it is merged away)."""
        out, gone = [], NEVER
        while True:
            born = -self.score[i] if i in self.parts else -NEVER
            out.append((i, born, gone))
            if i not in self.parts:
                return out
            i, gone = self.parts[i][side], born

    def apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses the boundary of two pieces before both are whole."""
        for x, xb, xd in self.spine(a, 1):
            for y, yb, yd in self.spine(b, 0):
                i = self.ids.get(self.text[x] + self.text[y])
                if i is not None:
                    when = max(-self.score[i], xb, yb)
                    if when < xd and when <= yd:
                        return False
        return True

    def spelled(self, text: str) -> list[int]:
        """Ids of a character that is in no piece."""
        return [self.byte_ids[b] for b in text.encode()] if len(self.byte_ids) == 256 else [self.unknown]

    def walk(self, words: list[str]) -> dict[str, bytes]:
        """Ids of sorted distinct marked words."""
        out, before = {}, ""
        reach = self.reach_merged if self.merges else self.reach_best
        # At k: the last piece of the first k characters (-1: a character of no piece), where it begins, and their score.
        last, begin, total = [-1], [0], [0.0]
        for word in words:
            if self.merges and SPACE * 3 in word:  # runs of spaces have equal scores: merged one by one
                out[word] = self.spaced(word)
                continue
            same = 0
            for p, q in zip(before, word):
                if p != q:
                    break
                same += 1
            del last[same + 1 :], begin[same + 1 :], total[same + 1 :]
            reach(word, same + 1, last, begin, total)
            before = word
            ids, k = [], len(word)
            while k:
                ids.append(last[k])
                k = begin[k]
            ids.reverse()
            out[word] = self.packed(ids, word)
        return out

    def reach_merged(self, word: str, start: int, last: list, begin: list, total: list) -> None:
        """Appends the states of longer prefixes: the one last piece that no merge joins to what stands before it."""
        whole, fits, longest = self.whole.get, self.fits, self.longest
        for k in range(start, len(word) + 1):
            for s in range(k - 1, (k - longest if k > longest else 0) - 1, -1):  # one fits; short ones are likelier
                i = whole(word[s:k])
                if i is None:
                    continue
                p = last[s]
                if s and p >= 0:
                    pair = p << 32 | i
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) > 4 * CACHED:
                            fits.clear()
                        fits[pair] = ok = self.apart(p, i)
                    if not ok:
                        continue
                last.append(i)
                begin.append(s)
                break
            else:
                last.append(-1)
                begin.append(k - 1)
            total.append(0.0)

    def reach_best(self, word: str, start: int, last: list, begin: list, total: list) -> None:
        """Appends the forward scores of longer prefixes: the best over their last piece."""
        for k in range(start, len(word) + 1):
            best = (-NEVER, -1, k - 1) if word[k - 1] in self.ids else (total[k - 1] + self.least, -1, k - 1)
            for s in range(k - 1, max(0, k - self.longest) - 1, -1):
                i = self.ids.get(word[s:k])
                if i is not None and total[s] + self.score[i] > best[0]:
                    best = (total[s] + self.score[i], i, s)
            total.append(best[0])
            last.append(best[1])
            begin.append(best[2])

    def packed(self, ids: list[int], word: str) -> bytes:
        if -1 not in ids:
            return b"".join([self.coded[i] for i in ids])
        full: list[int] = []
        at, unknown = 0, False
        for i in ids:
            if i >= 0:
                full.append(i)
                at += len(self.text[i])
                unknown = False
            else:
                spelled = self.spelled(word[at])
                if not (unknown and spelled == [self.unknown]):  # neighbours without bytes are one unknown
                    full += spelled
                unknown = spelled == [self.unknown]
                at += 1
        return np.array(full, "<i4").tobytes()

    def units(self, text: str) -> list[str]:
        """Marked words: no piece goes on from another character to a space mark, and none holds a line feed."""
        return UNIT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each whole text."""
        cut = [self.units(t) for t in texts]
        need = {u for c in cut for u in c}.difference(self.known)
        if need:
            if len(self.known) > CACHED:  # what has been of no use since the last time goes
                self.before, self.known = self.known, {}
                need = {u for c in cut for u in c}
            again = need.intersection(self.before)
            self.known.update((u, self.before[u]) for u in again)
            self.known.update(self.walk(sorted(need - again)))
        get = self.known.__getitem__
        out = [b"".join(map(get, c)) for c in cut]
        for u in [u for u in need if len(u) > LONG]:
            del self.known[u]
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of ids, without the space that encoding puts in front."""
        out = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return out[1:] if out.startswith(b" ") else out


UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


@lru_cache(2)
def held(file: str, best: bool = False) -> Pieces:
    """One for each worker, which runs many tasks."""
    found = Pieces.load(file, best)
    if any("\n" in p or re.search(f"[^{SPACE}]{SPACE}", p) for p in found.ids):
        raise ValueError("a piece crosses words")
    return found


def encoded(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text", best: bool = False) -> DataFrame:
    """(id, n_ids, ids, whole): the ids of each row's whole text, and whether they decode to it again. With best, pieces are those
    of the best sum of scores, also for a merge model.

    Null or empty text: no ids. A text that holds the space mark itself decodes to a space there, so whole is false. Null id
    and repeated rows: encoded like any other. Very long texts: whole. Other columns are not read. Empty table: no rows.
    """

    def run(batches):
        pieces = held(file, best)
        for b in sliced(batches):
            texts = b.column(1).to_pylist()
            coded = pieces.encode([t.decode() for t in texts])  # the more words at once, the longer the prefixes that they share
            for k in range(0, len(texts), 200):
                part, ids = texts[k : k + 200], coded[k : k + 200]
                whole = [pieces.decode(i) == t for i, t in zip(ids, part)]
                sizes = np.array([len(i) // 4 for i in ids], np.int64)
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
                yield pa.record_batch([b.column(0).slice(k, len(part)), pa.array(sizes), lists, pa.array(whole)], names=["id", "n_ids", "ids", "whole"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), utf8(text_col)).mapInArrow(run, f"id {kind}, n_ids long, ids array<int>, whole boolean")
