"""Chat formatting: a hidden Markov model over speaker markers and line features recovers roles by Viterbi; turns are rendered.

A transcript is a text, or pieces of one that are cut between lines, so that a conversation of any length is never one task's work.
Each piece gives the best score of entering it in one state and leaving it in another, one matrix; these are folded in order, a few
numbers a piece, and each piece is then decoded between the states that the best path of the whole transcript has at its ends.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, written
from .quality import bucket

#: Roles that the model tells apart; tools, functions and whatever else speaks are other.
ROLES = ("system", "user", "assistant", "other")
#: States: a role's first line, then its further lines.
STATES = 2 * len(ROLES)
#: Families of markers that one transcript keeps to, in the order of ROLES; a marker ends its speaker's name.
FAMILIES = (
    ("System: ", "User: ", "Assistant: ", "Tool: "),
    ("SYS: ", "Human: ", "AI: ", "Function: "),
    ("Context: ", "Q: ", "A: ", "Note: "),
    ("<|system|>", "<|user|>", "<|assistant|>", "<|other|>"),
    ("[system] ", "[user] ", "[assistant] ", "[tool] "),
    ("Instruction: ", "Customer: ", "Agent: ", "Observation: "),
    ("### system: ", "### question: ", "### answer: ", "### other: "),
)
BY_MARKER = {m.strip().lower(): (role, k) for k, f in enumerate(FAMILIES) for role, m in enumerate(f)}
MARKED = re.compile("(" + "|".join(sorted(map(re.escape, BY_MARKER), key=len, reverse=True)) + r")(?:(?<=[:\]]) )?", re.IGNORECASE)
#: Turns of one conversation that make up a piece, and rows or bytes beyond which a piece of so many numbers is dealt out by turn.
PART, CROWDED, WIDE = 4096, 8192, 32 << 20
#: What a line that is not blank holds: a character that str.strip() leaves.
VISIBLE = r"[^\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Line features: marker (none, or a role's of the transcript's own family or of another), after a blank line, first line, long.
KINDS = 1 + 2 * len(ROLES)
FEATURES = KINDS * 8
END = "<|end|>"


class Lines:
    """The lines of a piece. seen has those that are not blank: (place, marker's role or -1, its family or -1, where content begins)."""

    def __init__(self, text: str):
        self.raw = text.split("\n")
        self.seen = []
        for k, line in enumerate(self.raw):
            if line.strip():
                m = MARKED.match(line)
                role, family = BY_MARKER[m[1].lower()] if m else (-1, -1)
                self.seen.append((k, role, family, m.end() if m else 0))
        self.family = next((f for _, _, f, _ in self.seen if f >= 0), -1)

    def features(self, family: int, blank: bool, first: bool) -> list[int]:
        """Features of the lines that are not blank; blank: a blank line stands before the piece; first: no line does that isn't."""
        out, before = [], -1
        for place, role, own, _ in self.seen:
            kind = 0 if role < 0 else 1 + 2 * role + (own != family)
            after = place > before + 1 or (before < 0 and blank)
            out.append(((kind * 2 + after) * 2 + (first and not out)) * 2 + (len(self.raw[place]) > 200))
            before = place
        return out


class Model:
    """Log-probabilities from counts (starts by state, steps by pair of states, features by state), smoothed."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        may = np.ones((STATES, STATES), bool)
        for s in range(STATES):
            for t in range(1, STATES, 2):  # further lines follow their own role only
                may[s, t] = s // 2 == t // 2
        first = np.arange(STATES) % 2 == 0
        with np.errstate(divide="ignore"):
            a = np.where(first, start + 0.5, 0)
            self.start = np.log(a / a.sum())
            b = np.where(may, step + 0.5, 0)
            self.step = np.log(b / b.sum(axis=1, keepdims=True))
        c = emit + 0.1
        for k in range(FEATURES):
            kind = k // 8
            if kind % 2:  # a marker of the transcript's family speaks for a turn of its role, even where none was counted
                c[kind // 2 * 2, k] += 1
        self.emit = np.log(c / c.sum(axis=1, keepdims=True))

    def path(self, features: list[int], before: int | None = None, last: int | None = None) -> list[int]:
        """The most likely states of lines after the state before (None: at the start), the last one given or free; ties go to the
        earlier state."""
        if not features:
            return []
        best, back = (self.start if before is None else self.step[before]) + self.emit[:, features[0]], []
        for f in features[1:]:
            score = best[:, None] + self.step
            back.append(score.argmax(axis=0))
            best = score.max(axis=0) + self.emit[:, f]
        states = [int(best.argmax()) if last is None else last]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return states[::-1]

    def crossed(self, features: list[int], first: list[int]) -> np.ndarray:
        """The best scores of paths through a piece: from each state before it, and at last from the start (features of first), to
        each state at its end."""
        best = np.concatenate([self.step + self.emit[:, features[0]], (self.start + self.emit[:, first[0]])[None]])
        for f in features[1:]:
            best = (best[:, :, None] + self.step[None]).max(axis=1) + self.emit[:, f]
        return best


def escaped(text: str) -> str:
    """A text's own signs get a backslash more, so that only the renderer's are bare; read() takes it off again."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def rendered(lines: Lines, states: list[int], pending: list[str], opened: bool, last: bool) -> tuple[list[str], str, list[str]]:
    """(roles of the turns that begin in a piece, its part of the canonical form, blank lines that are left for the next piece).

    pending: blank lines before the piece that its lines decide on; opened: a turn is open; last: no piece follows. A turn's
    content is its lines joined as they stood, blank ones too, without its marker. One blank line right before a turn without a
    marker parts it from the turn before and is no content; blank lines before the first turn are none either.
    """
    roles, out, blanks, at = [], [], list(pending), 0
    for (place, role, _, begin), state in zip(lines.seen, states):
        blanks += lines.raw[at:place]
        line = lines.raw[place]
        if state % 2 == 0 or not opened:
            if opened:
                kept = blanks[:-1] if role < 0 and blanks else blanks
                out.append("".join("\n" + escaped(b) for b in kept) + f"\n{END}\n")
            roles.append(ROLES[state // 2])
            # a marker of another role, or one that the path reads as content, stays in the text
            out.append(f"<|{roles[-1]}|>\n" + escaped(line[begin:] if role == state // 2 else line))
            opened = True
        else:
            out.append("".join("\n" + escaped(b) for b in blanks) + "\n" + escaped(line))
        blanks, at = [], place + 1
    blanks += lines.raw[at:]
    if last:
        out += ["".join("\n" + escaped(b) for b in blanks) + f"\n{END}"] if opened else []
        blanks = []
    return roles, "".join(out), blanks


def parse(text: str, model: Model) -> tuple[list[str], str]:
    """(roles, canonical form) of a whole transcript."""
    lines = Lines(text)
    roles, out, _ = rendered(lines, model.path(lines.features(lines.family, False, True)), [], False, True)
    return roles, out


def read(canonical: str) -> list[tuple[str, str]]:
    """(role, content) of each turn of a canonical form."""
    turns = re.findall(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>", canonical, re.DOTALL)
    return [(r, re.sub(r"<(\\*)\\\|", r"<\1|", c)) for r, c in turns]


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, roles, transcript, lines): turns in order as speakers' lines, in a family of markers by the conversation's hash.

    Two families leave out markers of turns by hash; a blank line is then all that parts those turns. part numbers a conversation's
    pieces in order: one for each PART turn numbers, and, where those have very many rows or bytes (repeated rows, very long texts),
    one for each turn and hash; it is a struct whose order is that of the pieces. Rows without conv_id or turn are transcripts of their
    own. A role that is null or none of the first three: other. Null text: an empty turn. Repeated rows: a turn each. lines has
    the number of each turn's lines in the transcript that are not blank. Empty table: no rows.
    """
    role = F.when(F.lower("role").isin(*ROLES[:3]), F.lower("role")).otherwise(ROLES[3])
    number = F.monotonically_increasing_id()
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    rows = conversations.select(
        "conv_id",
        F.when(alone, -1 - number).otherwise(F.floor(F.col("turn") / PART)).cast("long").alias("block"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.pmod(number, F.lit(64)).alias("salt"),
    )
    size = rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    crowded = written(size.where((F.col("n") > CROWDED) | (F.col("bytes") > WIDE)).select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.lit(True).alias("crowded")), "crowded")
    found = rows.join(crowded, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")), "left")
    finer = lambda c, kind: F.when(F.col("crowded"), c).cast(kind)
    part = F.struct("block", finer(F.col("turn"), "long").alias("turn"), finer(F.xxhash64("role", "text"), "long").alias("hash"), finer(F.col("salt"), "int").alias("salt"))
    told = F.struct("turn", F.xxhash64("role", "text").alias("hash"), "role", "text")
    whole = found.select("conv_id", part.alias("part"), told.alias("said")).groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("said")).alias("said"))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(FAMILIES))).cast("int")
    marks = F.array(*[F.array(*[F.lit(m) for m in f]) for f in FAMILIES])

    def line(x: Column) -> Column:
        mark = F.element_at(F.element_at(marks, F.col("style") + 1), F.array_position(F.array(*[F.lit(r) for r in ROLES]), x["role"]).cast("int"))
        plain = F.split_part(x["text"], F.lit("\n"), F.lit(1)).rlike(VISIBLE) & (F.pmod(F.xxhash64(x["turn"], F.col("conv_id")), F.lit(7)) == 6)
        return F.when((F.col("style") % 6 == 0) & plain, F.concat(F.lit("\n"), x["text"])).otherwise(F.concat(mark, x["text"]))

    named = whole.withColumn("style", style).select("conv_id", "part", F.transform("said", lambda x: x["role"]).alias("roles"), F.transform("said", line).alias("told"))
    count = F.transform("told", lambda x: F.size(F.filter(F.split(x, "\n"), lambda y: y.rlike(VISIBLE))))
    return named.select("conv_id", "part", "roles", F.concat_ws("\n", "told").alias("transcript"), count.alias("lines"))


def trained(known: DataFrame) -> Model:
    """Counts over all pieces whose roles are known; steps over a piece's edge are not counted. At most a row for each feature and
    pair of states reaches the driver. Empty table: the smoothing alone."""
    first = written(known.where("conv_id is not null").groupBy("conv_id").agg(F.min("part").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_c"), "first"), "firsts")

    def count(batches):
        start, step, emit = np.zeros(STATES, np.int64), np.zeros((STATES, STATES), np.int64), np.zeros((STATES, FEATURES), np.int64)
        for b in sliced(batches):
            for roles, text, sizes, begins in zip(*(b.column(k).to_pylist() for k in range(4))):
                states = [2 * ROLES.index(r) + (j > 0) for r, n in zip(roles, sizes) for j in range(n)]
                lines = Lines(text)
                for k, (s, f) in enumerate(zip(states, lines.features(lines.family, False, begins), strict=True)):
                    emit[s, f] += 1
                    if k:
                        step[states[k - 1], s] += 1
                    elif begins:
                        start[s] += 1
        for kind, table in enumerate((start[:, None], step, emit)):
            a, c = np.nonzero(table)
            if len(a):
                yield pa.record_batch([pa.array(np.full(len(a), kind, np.int32)), pa.array(a.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(table[a, c])], names=["kind", "a", "b", "n"])

    tables = [np.zeros((STATES, 1)), np.zeros((STATES, STATES)), np.zeros((STATES, FEATURES))]
    rows = known.join(first, F.col("conv_id") == F.col("_c"), "left").select("roles", "transcript", "lines", (F.col("first").isNull() | (F.col("part") == F.col("first"))).alias("begins"))
    for r in rows.mapInArrow(count, "kind int, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        tables[r["kind"]][r["a"], r["b"]] = r["n"]
    return Model(tables[0][:, 0], tables[1], tables[2])


NEW = "roles_found array<string>, n_turns int, rendered string"


def _with_turns(batch: pa.RecordBatch, drop: int, turns: list[tuple[list[str], str]]) -> pa.RecordBatch:
    out = [pa.array([r for r, _ in turns], pa.list_(pa.string())), pa.array([len(r) for r, _ in turns], pa.int32()), pa.array([t for _, t in turns], pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns[drop:], *out], names=[*batch.schema.names[drop:], "roles_found", "n_turns", "rendered"])


def _kept(texts: DataFrame, keep: tuple[str, ...]) -> tuple[list[Column], str]:
    kinds = dict(texts.dtypes)
    return [F.col(f"`{c}`").alias(f"k{j}") for j, c in enumerate(keep)], ", ".join([*(f"k{j} {kinds[c]}" for j, c in enumerate(keep)), NEW])


def _named(out: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return out.select(*[F.col(f"k{j}").alias(c) for j, c in enumerate(keep)], "roles_found", "n_turns", "rendered")


def parsed(texts: DataFrame, model: Model, text_col: str = "transcript", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep's columns, then roles_found, n_turns and rendered: the turns of each whole transcript in canonical form.

    Null or blank transcript: no turns and an empty rendering. Text without any marker: the likeliest roles. Content keeps its
    lines as they are, blank ones too (see rendered()); only "\\n" ends a line. Very long transcripts: line by line, whole. Empty
    table: no rows.
    """
    columns, schema = _kept(texts, keep)

    def run(batches):
        for b in sliced(batches):
            yield _with_turns(b, 1, [parse(t or "", model) for t in b.column(0).to_pylist()])

    return _named(texts.select(F.col(f"`{text_col}`").alias("text"), *columns).mapInArrow(run, schema), keep)


def parsed_pieces(pieces: DataFrame, model: Model, id_col: str, part_col: str, text_col: str = "transcript", keep: tuple[str, ...] = ()) -> DataFrame:
    """The same for transcripts in pieces: a transcript is the pieces of one id joined by line ends, in the order of part_col.

    A row for each piece: the roles of the turns that begin in it, and its part of the rendering; those of all pieces, one after
    the other, are what parsed() makes of the whole. Null id: every piece is a transcript of its own. Pieces of one id and part:
    undefined order, all parsed.
    """
    columns, schema = _kept(pieces, keep)
    one = pieces.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{part_col}`").alias("part"), *columns)
    several = written(one.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "several")
    single = one.join(several, "id", "left_anti").select("text", *[f"k{j}" for j in range(len(keep))])

    def run(batches):
        for b in sliced(batches):
            yield _with_turns(b, 1, [parse(t or "", model) for t in b.column(0).to_pylist()])

    alone = single.mapInArrow(run, schema)
    if several.isEmpty():
        return _named(alone, keep)

    kind = dict(one.dtypes)
    cut = written(one.join(several, "id", "left_semi").select("text", "id", "part", F.monotonically_increasing_id().alias("row"), *[f"k{j}" for j in range(len(keep))]), "pieces")
    # A transcript's own family is that of its first marker.
    marks = cut.mapInArrow(lambda batches: (pa.record_batch([b["id"], b["part"], b["row"], pa.array([Lines(t or "").family for t in b["text"].to_pylist()], pa.int32())], names=["id", "part", "row", "family"]) for b in sliced(batches)), f"id {kind['id']}, part {kind['part']}, row long, family int")
    own = marks.where("family >= 0").groupBy("id").agg(F.min_by("family", F.struct("part", "row")).alias("family"))
    owned = written(cut.join(own, "id", "left").withColumn("family", F.coalesce("family", F.lit(-1))), "families")

    def cross(batches):
        for b in sliced(batches):
            size, blanks, scores = [], [], []
            for t, family in zip(b["text"].to_pylist(), b["family"].to_pylist()):
                lines = Lines(t or "")
                size.append(len(lines.seen))
                blanks.append(lines.raw[lines.seen[-1][0] + 1 :] if lines.seen else lines.raw)
                both = [model.crossed(lines.features(family, blank, False), lines.features(family, blank, True)) for blank in (False, True)] if lines.seen else []
                scores.append(np.concatenate(both).astype("<f8").tobytes() if both else b"")
            yield pa.record_batch([b["id"], b["part"], b["row"], pa.array(size, pa.int64()), pa.array(blanks, pa.list_(pa.string())), pa.array(scores, pa.binary())], names=["id", "part", "row", "size", "blanks", "scores"])

    def fold(batches):
        """The states before and at the end of each piece, the blank lines that it takes over, and whether a turn is open."""

        def path(held):
            best, back, pending, before = None, [], [], []
            for _, size, blanks, scores in held:
                before.append(pending)
                if not size:
                    back.append(None)
                    pending = pending + blanks
                    continue
                through = np.frombuffer(scores, "<f8").reshape(2, STATES + 1, STATES)[int(bool(pending))]
                if best is None:
                    back.append(np.full(STATES, -1))
                    best = through[STATES]
                else:
                    score = best[:, None] + through[:STATES]
                    back.append(score.argmax(axis=0))
                    best = score.max(axis=0)
                pending = blanks
            out, state = [], -1 if best is None else int(best.argmax())
            for (row, size, _, _), b, p in zip(reversed(held), reversed(back), reversed(before)):
                prior = state if b is None else int(b[state])
                out.append((row, prior, state if size else -1, p, len(out) == 0))
                state = prior
            cols = list(zip(*out))
            return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.string())), pa.array(cols[4], pa.bool_())], names=["row", "before", "end", "pending", "last"])

        now, held = None, []
        for b in batches:
            for i, *rest in zip(*(b[c].to_pylist() for c in ("id", "row", "size", "blanks", "scores"))):
                if held and i != now:
                    yield path(held)
                    held = []
                now = i
                held.append(rest)
        if held:
            yield path(held)

    crossed = owned.mapInArrow(cross, f"id {kind['id']}, part {kind['part']}, row long, size long, blanks array<string>, scores binary")
    ends = crossed.repartition("id").sortWithinPartitions("id", "part", "row").mapInArrow(fold, "row long, before int, end int, pending array<string>, last boolean")
    ready = owned.join(written(ends, "ends"), "row").select("text", "family", "before", "end", "pending", "last", *[f"k{j}" for j in range(len(keep))])

    def decode(batches):
        for b in sliced(batches):
            turns = []
            for t, family, before, end, pending, last in zip(*(b.column(k).to_pylist() for k in range(6))):
                lines = Lines(t or "")
                begins = before < 0
                states = model.path(lines.features(family, bool(pending), begins), None if begins else before, end) if lines.seen else []
                # blank lines that a piece without any other takes over go on to the next one
                roles, out, _ = rendered(lines, states, pending if lines.seen or last else [], not begins, last)
                turns.append((roles, out))
            yield _with_turns(b, 6, turns)

    return _named(alone.union(ready.mapInArrow(decode, schema)), keep)


def formatted(conversations: DataFrame, folds: int = 5) -> DataFrame:
    """(conv_id, part, held_out, roles, roles_found, n_turns, rendered): conversations as transcripts, parsed by a model that has
    learnt from those whose id's bucket is not 0. held_out: the model has not seen the conversation's roles."""
    known = written(transcripts(conversations).withColumn("held_out", bucket("conv_id", folds) == 0), "transcripts")
    model = trained(known.where("not held_out"))
    return parsed_pieces(known, model, "conv_id", "part", keep=("conv_id", "part", "held_out", "roles"))
