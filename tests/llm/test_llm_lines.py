"""Line dedup, fill-in-middle and conversation repair against plain versions."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from palimpsest.llm import conversations, fill_middle, line_dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in ("h1", "h2", "id", "n", "first", "shard", "block", "keys", "_text", "_units", "_h", "_a", "c", "r", "t", "gone", "copy", "n_lines")})


# --- 11 line dedup


def plain_dedup(rows, least=10, min_docs=2):
    order = lambda i: (i is None, i or 0)
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders.setdefault(k, []).append(i)
    lost = {k: min(set(v), key=order) for k, v in holders.items() if len(k) >= least and len(set(v)) > 1 and len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in lost or lost[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def lines_of(rng, n):
    known = ["Shared line of text", " shared LINE of text\t", "Ünïcode shared lines", "ünïcode shared lines", "short", "", "   ", "aééééééééé", "ÄÖÜÄÖÜÄÖÜ", "zeilen\r"]
    return "\n".join(rng.choice(known) if rng.random() < 0.5 else " ".join(rng.choices("abcdef", k=rng.randint(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def doc_rows():
    rng = random.Random(11)
    rows = [(i, lines_of(rng, rng.randint(1, 30))) for i in range(200)]
    return rows + [(500, None), (501, ""), (502, "\n\n"), (None, "Shared line of text\nonly here, twice"), (None, "only here, twice\nown words of it"), rows[3], rows[3], (503, "x" * 300_000 + "\n" + "y " * 50_000), (504, "x" * 300_000)]


@pytest.mark.parametrize("most_bytes", [line_dedup.MOST_BYTES, 0])
@pytest.mark.parametrize("min_docs", [2, 4])
def test_line_dedup_against_plain_version(spark, monkeypatch, doc_rows, most_bytes, min_docs):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    df = clashing(spark.createDataFrame([(*r, "en", "s", 1) for r in doc_rows], DOCS))
    got = line_dedup.dedup_lines(df, min_docs=min_docs, most_bytes=most_bytes)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    want = plain_dedup(doc_rows, min_docs=min_docs)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and sum(w[3] for w in want) > 100


@pytest.mark.parametrize("most_bytes", [line_dedup.MOST_BYTES, 0])
def test_line_dedup_of_text_ids_and_empty_tables(spark, most_bytes):
    rows = [("b", "a line of words\nq"), ("a", "A LINE of words"), ("c", "a line of words"), (None, "a line of words")]
    df = spark.createDataFrame(rows, "key string, body string")
    got = line_dedup.dedup_lines(df, id_col="key", text_col="body", most_bytes=most_bytes)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", "A LINE of words", 1, 0), ("b", "q", 2, 1), ("c", "", 1, 1), (None, "", 1, 1)], key=str)
    assert line_dedup.dedup_lines(df.limit(0), id_col="key", text_col="body", most_bytes=most_bytes).count() == 0
    assert line_dedup.dedup_lines(df.where("key = 'a'"), id_col="key", text_col="body", most_bytes=most_bytes).first().n_dropped == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
        keys[: n // 2, 0] = 5  # halves alone don't tell keys apart
        made = line_dedup.PerfectHash.build(keys)
        assert made.size == n and sorted(made.places(keys)) == list(range(n))
        other = rng.integers(0, 1 << 63, (1000, 2)).astype(np.uint64)
        assert ((made.places(other) >= -1) & (made.places(other) < max(n, 1))).all()
    with pytest.raises(ValueError):
        line_dedup.PerfectHash.build(np.ones((2, 2), np.uint64))


# --- 12 fill-in-middle


TEXTS = ["a\nb\nc", "a\n", "\n", "\n\n\n", "x", "äö\nü😀\n😀", "one two  three.\nFour? 5!", "has <P> inside\nq", "<", "a<\nS>b\n<M\n>", "tab\there\r\nand there", "éa 😀😀b", "q\n" * 3000]


@pytest.mark.parametrize("grammar", sorted(fill_middle.GRAMMARS))
def test_units_are_those_of_the_pattern(spark, grammar):
    df = spark.createDataFrame([(t,) for t in [None, "", *TEXTS]], "t string")
    pattern = regex.compile("|".join(u.pattern for u in fill_middle.GRAMMARS[grammar]))
    for t, u in df.select("t", fill_middle.units(F.col("t"), grammar)).collect():
        assert u == pattern.findall(t or ""), (grammar, t)
        assert "".join(u) == (t or "")


@pytest.mark.parametrize("grammar, rate", [("lines", 100), ("words", 60), ("characters", 100), ("sentences", 100)])
def test_fill_in_middle_against_plain_version(spark, grammar, rate):
    rows = [(i, t) for i in range(8) for t in TEXTS] + [(1, None), (2, ""), (None, "a\nb\nc\n"), (None, "a\nb\nc\n"), (-5, "u\nv\nw")]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))
    pattern = regex.compile("|".join(u.pattern for u in fill_middle.GRAMMARS[grammar]))
    want = []
    for i, t in rows:
        t = t or ""
        u = pattern.findall(t)
        digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
            want.append((i, len(u), "plain", None, None, None, t, t))
        elif h[3] % 100 < 50:
            want.append((i, len(u), "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}", t))
        else:
            want.append((i, len(u), "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}", t))
    got = fill_middle.fill_in_middle(df, grammar, rate=rate)
    assert got.columns == ["doc_id", "n", "form", "prefix", "middle", "suffix", "output", "restored"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {w[2] for w in want} == {"plain", "spm", "psm"}


def test_fill_in_middle_takes_no_unclear_sentinels(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id bigint, text string")
    for bad in (("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>"), ("xab", "bcy", "q"), ("ab", "bc", "q")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(df, sentinels=bad)
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0
    assert fill_middle.fill_in_middle(df, sentinels=("[P]", "|", "$^")).first().restored == "a\nb"


# --- 13 conversation repair


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        kept = text.strip(" \t\n\v\f\r")
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Every way of editing the rows, with up to two inserted turns at each place."""
    good = regex.compile("(s?(ua)+)?")
    faults = faults_of(rows)
    inserts = [("", 0, ()), *[("I", 2, ((r, ""),)) for r in ("user", "assistant")], *[("II", 4, ((a, ""), (b, ""))) for a in ("user", "assistant") for b in ("user", "assistant")]]
    per_row = []
    for (role, text), fault in zip(rows, faults):
        ways = [("D", 3, ())]
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            ways += [("K", more, ((role, text),)), *[("R", 2 + more, ((r, text),)) for r in ("user", "assistant")]]
        per_row.append(ways)
    best = None
    for edits in itertools.product(*per_row):
        for extra in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(e[1] for e in edits) + sum(x[1] for x in extra)
            audit = extra[0][0] + "".join(e[0] + x[0] for e, x in zip(edits, extra[1:]))
            if best is None or (cost, audit) < best[:2]:
                turns = [*extra[0][2], *[t for e, x in zip(edits, extra[1:]) for t in (*e[2], *x[2])]]
                if good.fullmatch("".join(r[:1] for r, _ in turns)):
                    best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in turns))
    return best


def test_repair_against_every_edit():
    rng = random.Random(13)
    texts = ["Yes.", "No!", "cut off", " ", "", "Why? ", "ß"]
    for _ in range(50):
        rows = [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", " "]), rng.choice(texts)) for _ in range(rng.randint(0, 3))]
        own = conversations.Repair(1, True)
        for n, (role, text) in enumerate(rows):
            own.add(n, role, text)
        got = own.done()
        cost, audit, repaired = cheapest(rows)
        assert (got[6], got[7], got[8]) == (cost, audit, hashlib.sha256(repaired.encode()).hexdigest()), rows
        assert "\n".join(f"{t['role']}:{t['text']}" for t in got[9]) == repaired
        assert got[2:5] == tuple(faults_of(rows).count(f) for f in ("blank", "duplicate", "truncated"))


def whole_table(rows):
    """Cost, audit and repaired text by full paths, none dropped and nothing put away."""
    paths, faults = {0: (0, "", ())}, faults_of(rows)

    def closed(found):
        for _ in range(4):
            for s, (cost, audit, turns) in list(found.items()):
                for c, to in conversations.NEXT[s].items():
                    if c in "ua" and (to not in found or (cost + 2, audit + "I") < found[to][:2]):
                        found[to] = (cost + 2, audit + "I", (*turns, (conversations.ROLES[c], "")))
        return found

    paths = closed(paths)
    for (role, text), fault in zip(rows, faults):
        found = {}
        for s, (cost, audit, turns) in paths.items():
            ways = [(s, 3, "D", ())]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for c, to in conversations.NEXT[s].items():
                    ways += [(to, more, "K", ((role, text),))] if c == role[:1] else []
                    ways += [(to, 2 + more, "R", ((conversations.ROLES[c], text),))] if c in "ua" else []
            for to, more, edit, add in ways:
                if to not in found or (cost + more, audit + edit) < found[to][:2]:
                    found[to] = (cost + more, audit + edit, turns + add)
        paths = closed(found)
    return min(paths[s] for s in (0, 3) if s in paths)


def test_long_conversations_keep_short_paths():
    rng = random.Random(14)
    for n in (60, 300):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Yes.", "cut", "", f"Own {i}.", f"Cut {i}"])) for i in range(n)]
        own = conversations.Repair(1, True)
        longest = 0
        for i, (role, text) in enumerate(rows):
            own.add(i, role, text)
            longest = max(longest, *(len(p.audit) for p in own.layer if p))
        cost, audit, turns = whole_table(rows)
        got = own.done()
        assert got[6:8] == (cost, audit) and [(t["role"], t["text"]) for t in got[9]] == list(turns)
        assert longest <= 60 and got[8] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def test_repair_of_tables(spark):
    rng = random.Random(15)
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(c, None if rng.random() < 0.05 else t, rng.choice(["system", "user", "assistant", None]), rng.choice(["Yes.", "No", None, "", f"Row {c} {t}."])) for c in [*range(60), None] for t in range(rng.randint(1, 7))]
    rows += rows[:5] + [(900, 4, "user", "gone"), (901, None, "user", "A question?"), (901, None, "assistant", "An answer.")]
    df = clashing(spark.createDataFrame(rows, schema)).withColumn("absent", F.col("conv_id") == 900)
    got = {r.conv_id: r for r in conversations.repair(df, F.col("absent")).collect()}
    assert len(got) == len({r[0] for r in rows})
    for c, r in got.items():
        own = sorted([x for x in rows if x[0] == c and c != 900], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or " ", " " if x[3] is None else x[3]))
        turns = {x[1] for x in own} - {None}
        clean = [(x[2] or " ", " " if x[3] is None else x[3]) for x in own]
        cost, audit, fixed = whole_table(clean)
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(clean, clean[1:])]
        assert (r.gaps, r.illegal) == (max(turns) - min(turns) + 1 - len(turns) if turns else 0, sum(p not in ("su", "ua", "au") for p in pairs))
        assert (r.cost, r.audit, [(t.role, t.text) for t in r.turns]) == (cost, audit, list(fixed))
    assert (got[900].audit, got[900].cost, got[900].gaps, got[900].repaired_sha256) == ("", 0, 0, hashlib.sha256(b"").hexdigest())
    assert conversations.repair(df.limit(0)).count() == 0


def test_planted_damage(spark):
    import zlib

    df = spark.createDataFrame([(c, t, "assistant", "Is it? Yes! It.") for c in range(30) for t in (*range(6), None)], "conv_id bigint, turn bigint, role string, text string")
    got = sorted(map(str, map(tuple, conversations.damaged(df).collect())))
    want = []
    for c in range(30):
        for t in (*range(6), None):
            kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
            row = (c, t, "user" if kind == 4 else "assistant", "" if kind == 1 else "Is it Yes It" if kind == 2 else "Is it? Yes! It.", kind == 0)
            want += [row] * (2 if kind == 3 else 1)
    assert got == sorted(map(str, want))
