import random
import re
import zlib
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import chat
from tessera.llm.chat import BY_MARKER, FAMILIES, FEATURES, MARKED, ROLES, STATES, Lines, Model, escaped, formatted, parse, parsed, parsed_pieces, read, trained, transcripts


def drawn(seed):
    rng = np.random.default_rng(seed)
    return Model(9 * rng.random(STATES), 9 * rng.random((STATES, STATES)), 9 * rng.random((STATES, FEATURES)))  # so that no two paths tie


def brute(text, m):
    """(role, content) of each turn: features, the best path and turns, line by line, by another way."""
    raw = text.split("\n")
    marks = [MARKED.match(x) if x.strip() else None for x in raw]
    seen = [k for k, x in enumerate(raw) if x.strip()]
    named = [BY_MARKER[marks[k][1].lower()] for k in seen if marks[k]]
    own = named[0][1] if named else None
    best = {}
    for n, k in enumerate(seen):
        kind = 0
        if marks[k]:
            role, family = BY_MARKER[marks[k][1].lower()]
            kind = 1 + 2 * role + (family != own)
        f = kind * 8 + 4 * (k > 0 and not raw[k - 1].strip()) + 2 * (n == 0) + (len(raw[k]) > 200)
        best = {t: max([(m.start[t] + m.emit[t, f], [t])] if n == 0 else [(best[s][0] + m.step[s, t] + m.emit[t, f], [*best[s][1], t]) for s in range(STATES)], key=lambda x: x[0]) for t in range(STATES)}
    path = max(best.values(), key=lambda x: x[0])[1] if seen else []
    begins = [k for n, (k, s) in enumerate(zip(seen, path)) if n == 0 or s % 2 == 0]
    role_at, out = dict(zip(seen, path)), []
    for k, end in zip(begins, [*begins[1:], None]):
        body = raw[k : len(raw) if end is None else end]
        if end is not None and not marks[end] and not body[-1].strip():
            body = body[:-1]
        role = role_at[k] // 2
        if marks[k] and BY_MARKER[marks[k][1].lower()][0] == role:
            body[0] = body[0][marks[k].end() :]
        out.append((ROLES[role], "\n".join(body)))
    return out


def canonical(turns):
    return "\n".join(f"<|{r}|>\n{escaped(c)}\n<|end|>" for r, c in turns)


BITS = ["", " ", "\t", "\u3000", "hello", "x" * 230, "User: hi", "A: no", "Q:", "<|assistant|>ok", "[tool] 5", "Avoid: this", "human: lower", "a <|end|> b", "### answer: 7", "\r", "<\\|x|>", "AI:  two", "System: s"]


def test_viterbi_is_the_best_of_all_paths():
    rng, m = np.random.default_rng(0), drawn(0)

    def value(p, f, before=None):
        first = m.start[p[0]] if before is None else m.step[before, p[0]]
        return first + m.emit[p[0], f[0]] + sum(m.step[p[k - 1], p[k]] + m.emit[p[k], f[k]] for k in range(1, len(p)))

    for _ in range(8):
        f = rng.integers(0, FEATURES, 4).tolist()
        paths = list(product(range(STATES), repeat=4))
        assert np.isclose(value(m.path(f), f), max(value(p, f) for p in paths))
        through = m.crossed(f, f)
        for before, last in ((0, 3), (5, 2), (None, 4)):
            want = max(value(p, f, before) for p in paths if p[-1] == last)
            assert np.isclose(through[STATES if before is None else before, last], want) and np.isclose(value(m.path(f, before, last), f, before), want)


def test_turns_like_brute_force():
    rng = random.Random(1)
    for seed in range(300):
        m = drawn(seed % 7)
        text = "\n".join(rng.choice(BITS) for _ in range(rng.randint(0, 14)))
        roles, out = parse(text, m)
        turns = brute(text, m)
        assert roles == [r for r, _ in turns] and read(out) == turns and out == canonical(turns), text


def test_pieces_are_parsed_like_the_whole(spark):
    rng, m = random.Random(2), drawn(3)
    whole, rows = {}, []
    for c in range(60):
        lines = [rng.choice(BITS) for _ in range(rng.randint(1, 40))]
        whole[c] = "\n".join(lines)
        cuts = sorted({0, *(rng.randrange(len(lines)) for _ in range(rng.randint(0, 9)))})
        rows += [(c, a, "\n".join(lines[a:b]), "k") for a, b in zip(cuts, [*cuts[1:], len(lines)])]
    rows += [(None, 0, "User: x", "k"), (None, 0, "y", "k"), (99, 0, None, "k"), (99, 1, "", "k")]
    df = spark.createDataFrame(rows, "conv_id long, part int, transcript string, rendered string").repartition(3)
    got = {}
    for r in parsed_pieces(df.withColumnRenamed("rendered", "text"), m, "conv_id", "part", keep=("conv_id", "part", "text")).collect():
        assert r["text"] == "k" and r["n_turns"] == len(r["roles_found"])
        if r["conv_id"] is not None:
            got.setdefault(r["conv_id"], []).append((r["part"], r["roles_found"], r["rendered"]))
    for c, text in whole.items():
        parts = sorted(got[c])
        roles, out = parse(text, m)
        assert [x for _, r, _ in parts for x in r] == roles and "".join(t for _, _, t in parts) == out
    assert [(r, t) for _, r, t in sorted(got[99])] == [([], ""), ([], "")]


def test_roles_of_conversations_are_recovered(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    texts = {}
    for r in rows.orderBy("conv_id", "turn").collect():
        texts.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    got = formatted(rows).collect()
    assert len(got) == len(texts)
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["conv_id"]).encode()) % 5 == 0) for r in got)
    for some in (got, held):
        assert np.mean([r["roles"] == r["roles_found"] for r in some]) >= 0.9
        assert np.mean([read(r["rendered"]) == texts[r["conv_id"]] for r in some]) >= 0.9


def test_lines_turns_and_rendering():
    assert [(r, x[b:]) for x, (_, r, _, b) in zip([x for x in "User: hi\r\n\n<|assistant|>ok\nAvoid: this\nA: x".split("\n") if x], Lines("User: hi\r\n\n<|assistant|>ok\nAvoid: this\nA: x").seen)] == [(1, "hi\r"), (2, "ok"), (-1, "Avoid: this"), (2, "x")]
    model = Model(np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, FEATURES)))
    assert parse("", model) == ([], "") and parse(" \n", model) == ([], "")
    assert canonical([("user", "a <|end|> b")]) == "<|user|>\na <\\|end|> b\n<|end|>"
    for c in ("<|", "<\\|", "<\\\\|x", "<||", "a<|end|>\n<|user|>"):
        assert read(canonical([("user", c), ("other", c)])) == [("user", c), ("other", c)]


def test_content_is_kept_whole(spark):
    said = ["para one\n\npara two", "  indented\n\n\n", "Q: second\nQ: third", "", "\nlate", "tab\tend\r", "<|end|>", "  "]
    rows = [(c, t, ROLES[1 + t % 2] if c % 5 else "tool", said[(c + 3 * t) % len(said)]) for c in range(200) for t in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    texts = {}
    for c, _, r, t in rows:
        texts.setdefault(c, []).append((r if r in ROLES else "other", t))
    got = formatted(df).collect()
    right = [read(r["rendered"]) == texts[r["conv_id"]] for r in got]
    family = {r["conv_id"]: r["style"] for r in df.select("conv_id", F.pmod(F.xxhash64("conv_id"), F.lit(len(FAMILIES))).alias("style")).distinct().collect()}
    # lines with a marker of the family itself can't be told from turns: those of the third; families that leave out markers may miss
    sure = [x for x, r in zip(right, got) if family[r["conv_id"]] not in (0, 2, 6)]
    assert len(sure) > 50 and np.mean(sure) >= 0.95


def test_edge_rows(spark):
    rows = [(1, 0, "user", "hi\nthere"), (1, 1, "assistant", "yo"), (1, 1, "assistant", "yo"), (2, 0, None, None), (None, 0, "user", "x"), (None, 1, "user", "y"), (3, None, "USER", "z"), (4, 5000, "tool", ""), (4, 1, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, part string")
    known = transcripts(df)
    assert known.count() == 7
    got = parsed(known, trained(known), keep=("conv_id", "part")).collect()
    assert len(got) == 7 and all(r["n_turns"] == len(r["roles_found"]) for r in got)
    assert formatted(df).count() == 7 and formatted(df.limit(0)).collect() == []
    assert {r["roles"][0] for r in known.where("conv_id = 2 or part.block = 1").collect()} == {"other"}
    empty = transcripts(df.limit(0))
    assert parsed(empty, trained(empty), keep=("conv_id",)).collect() == []


def test_a_long_conversation_is_one_transcript(spark, monkeypatch):
    said = lambda k: f"turn {k}" + ("\n\nmore" if k % 3 == 0 else "")
    rows = [(c, k, ROLES[1 + k % 2], said(k)) for c in range(7) for k in range(5000 if c == 3 else 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = transcripts(df).cache()
    model = trained(whole)
    monkeypatch.setattr(chat, "PART", 64)
    cut = transcripts(df).cache()
    found, told = (parsed_pieces(x, model, "conv_id", "part", keep=("conv_id", "part")).collect() for x in (cut, whole))
    assert len(told) == 7 + 1 and len([r for r in found if r["conv_id"] == 3]) == 79  # 5,000 turns have two parts of 4,096
    for c in range(7):
        one, many = (sorted((r for r in x if r["conv_id"] == c), key=lambda r: r["part"]["block"]) for x in (told, found))
        turns = read("".join(r["rendered"] for r in many))
        assert "".join(r["rendered"] for r in one) == "".join(r["rendered"] for r in many)
        assert [r for r, _ in turns] == [x for r in many for x in r["roles_found"]] == [x for r in one for x in r["roles_found"]]
    text = "\n".join(r["transcript"] for r in sorted((r for r in cut.collect() if r["conv_id"] == 3), key=lambda r: r["part"]["block"]))
    roles, out = parse(text, model)
    assert out == "".join(r["rendered"] for r in sorted((r for r in found if r["conv_id"] == 3), key=lambda r: r["part"]["block"])) and len(roles) > 4000


def test_crowded_parts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(chat, "CROWDED", 10)
    rows = [(1, 5, "user", "same")] * 200 + [(1, 6, "assistant", f"answer {k}") for k in range(30)] + [(2, 0, "user", "q")]
    known = transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    each = known.collect()
    assert sum(len(r["roles"]) for r in each) == 231 and max(len(r["roles"]) for r in each) < 60
    got = formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("conv_id = 1").orderBy("part").collect()
    turns = read("".join(r["rendered"] for r in got))
    assert turns[:200] == [("user", "same")] * 200 and sorted(turns[200:]) == sorted(("assistant", f"answer {k}") for k in range(30))


def test_transcripts_with_empty_turns_are_counted(spark):
    texts = ["hi", "", None, "\nafter a blank line", "\t", "\u3000\n\u00a0x\r\ny\r", "two\n\nparts", " "]
    rows = [(c, t, ROLES[(c + t) % 3] if t % 5 else "tool", texts[(c * 3 + t) % len(texts)]) for c in range(30) for t in range(16)]
    known = transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = known.collect()
    assert len(got) == 30 and all(sum(r["lines"]) == len(Lines(r["transcript"]).seen) for r in got)
    model = trained(known)
    start, emit = np.zeros(STATES), np.zeros((STATES, FEATURES))
    for r in got:
        states = [2 * ROLES.index(x) + (j > 0) for x, n in zip(r["roles"], r["lines"]) for j in range(n)]
        lines = Lines(r["transcript"])
        start[states[0]] += 1
        for s, f in zip(states, lines.features(lines.family, False, True), strict=True):
            emit[s, f] += 1
    want = Model(start, np.zeros((STATES, STATES)), emit)
    assert start.sum() == 30 and np.allclose(model.start, want.start) and np.allclose(model.emit, want.emit)
