"""Conversation repair, MinHash near duplicates and phrases against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F
from test_operators import documents, empty, texts

from bookloom.llm import clusters, minhash, phrases, repair

TALK = "conv_id long, turn long, role string, text string"


def talk(seed: int) -> list[tuple]:
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "user", None]),
             r.choice(["Yes.", "No", "Why?", " ", "", None, "a. b", "So!\n\t", "x ", "y.\x85", "z. \x0b"]))
            for c in (1, 2, 3, 5, None, -7) for t in [*range(r.randrange(1, 30)), None, 2, 2, None]]
    return [*rows, *rows[:9], (8, None, "user", "Hi."), (9, 0, None, None)]


def damage(rows):
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        yield from [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)


def repaired(rows):
    """The contract's columns of one conversation's rows, by trying all edits."""
    rows = sorted(rows, key=lambda q: (q[1] is not None, q[1] or 0, hashlib.md5(
        f"{len(q[2])}:{q[2]}:{q[3]}".encode()).hexdigest()))
    seen, fault = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        fault.append("blank" if not bare else "duplicate" if (role, text) in seen
                     else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def fits(roles):
        return re.fullmatch("(s?(ua)*)?", roles) is not None

    @lru_cache(None)
    def best(i, tail, spare):
        """tail: initials so far, shortened to what decides how they may go on."""
        out = [(0, "", ())] if i == len(rows) and tail in ("", "a") else []
        for role in ("user", "assistant"):
            if spare and (n := follow(tail, role[0])) is not None:
                c, a, x = best(i, n, spare - 1)
                out.append((c + 3, "I" + a, (f"{role}:", *x)))
        if i < len(rows):
            c, a, x = best(i + 1, tail, 3)
            out.append((c + 4, "D" + a, x))
            if fault[i] in ("", "truncated"):
                own, more = rows[i][2], 3 * (fault[i] == "truncated")
                for role, price, edit in ((own, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if (n := follow(tail, role[:1])) is not None:
                        c, a, x = best(i + 1, n, 3)
                        out.append((c + price + more, edit + a, (f"{role}:{rows[i][3]}", *x)))
        return min(out) if out else (10**9, "", ())

    def follow(tail, role):
        return role if tail + role in ("s", "u", "su", "ua", "au") else None

    cost, audit, lines = best(0, "", 3)
    assert fits("".join(x[:1] for x in lines))
    turns = [t for _, t, _, _ in rows if t is not None]
    n = Counter(fault)
    roles = [q[2][:1] for q in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_match_brute_force(spark, seed):
    rows = talk(seed)
    df = spark.createDataFrame(rows, TALK).withColumns({"audit": F.lit(1), "key": F.lit("x"), "group": F.lit(2)})
    got = {r.conv_id: tuple(r)[1:] for r in repair.damaged_and_repaired(df.repartition(3)).collect()}
    by = defaultdict(list)
    for q in damage(rows):
        by[q[0]].append(q)
    assert set(got) == {q[0] for q in rows}
    for c in got:
        assert got[c] == repaired(by[c]), c


def test_conversations_match_sql(spark):
    rows = talk(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = repair.damaged_and_repaired(spark.createDataFrame(rows, TALK))
    names = [c[0] for c in con.execute(repair.oracle()).description]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(con.fetchall(), key=repr)


def test_repaired_rows_follow_the_audit(spark):
    df = spark.createDataFrame(talk(4), TALK)
    out = defaultdict(list)
    for r in repair.repaired(df).orderBy("place").collect():
        out[r.conv_id].append((r.place, r.role, r.text))
    for r in repair.repair(df).collect():
        rows = out[r.conv_id]
        assert [p for p, _, _ in rows] == list(range(len(rows)))
        assert len(rows) == sum(c in "KRI" for c in r.audit)
        lines = "\n".join(f"{role}:{text}" for _, role, text in rows)
        assert hashlib.sha256(lines.encode()).hexdigest() == r.repaired_sha256


def test_conversations_of_an_empty_table(spark):
    none = spark.createDataFrame([], TALK)
    assert repair.damaged_and_repaired(none).count() == 0 and repair.repaired(none).count() == 0


def test_long_signatures_are_solved_once():
    r = random.Random(1)
    tail = "".join(r.choice(repair.SYMBOLS) for _ in range(20_000))
    made = sorted((r.choice(repair.SYMBOLS) + tail)[::-1] for _ in range(20))
    found = list(repair.audits(iter(made)))
    assert len(found) == 20 and all(len(a) >= 20_001 for _, a in found)
    known = repair.Automaton()
    number = 0
    for symbol in tail[::-1]:
        number = known.step(number, symbol)[0]
    assert len(known.entries) < 200


# --- near duplicates

def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(w, w[1:])) if len(w) > 1 else set(w)


def expected_components(rows, percent=80):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for p, (_, x) in enumerate(sets):
        for q, (_, y) in enumerate(sets[:p]):
            if x and 100 * len(x & y) >= percent * len(x | y):
                up[top(p)] = top(q)
    least = {}
    for p, (i, _) in enumerate(sets):
        if i is not None:
            least[top(p)] = min(i, least.get(top(p), i))
    return sorted(((i, len(x), least.get(top(p)), i == least.get(top(p))) for p, (i, x) in enumerate(sets)), key=repr)


def chained(seed):
    """Texts of which each differs a little from the one before: long chains of links."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    out = []
    for k in range(120):
        words = list(words)
        words[r.randrange(60)] = f"v{k}"
        out.append(" ".join(words))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("block", [clusters.BLOCK, 3_000])
def test_minhash_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", block)
    monkeypatch.setattr(clusters, "FOLLOWERS", 7)
    made = [*texts(5), *chained(6), "Ünï CODE x", "ünï code x", "Ünï code X"]
    rows = [*enumerate(made), (None, made[0]), (None, made[0]), (None, "all alone here"), (3, made[3]), (3, "else it is"),
            (500, "Big " * 50_000 + "end"), (501, "big " * 40_000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"size": F.lit(1), "hi": F.lit("x"), "component_id": F.lit(0)})
    got = sorted(map(tuple, minhash.near_duplicates(docs.repartition(5)).collect()), key=repr)
    want = [(i, n, c, k if i is not None else c is None) for i, n, c, k in expected_components(rows)]
    lone = {i for i, t in rows if not shingle_set(t)}
    assert got == sorted(((i, n, i if i in lone and n == 0 else c, True if i in lone and n == 0 else k)
                          for i, n, c, k in want), key=repr)


def test_minhash_edges(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(documents(spark, ["a"]), 70)


def test_stars_join_long_paths(spark):
    n = 300
    order = random.Random(2).sample(range(n), n)
    edges = [(a, b) for a, b in zip(order, order[1:])] + [(1000, 1001), (1001, 1000)]
    got = {(r.v, r.root) for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(v, 0) for v in range(n)} | {(1000, 1000), (1001, 1000)}


# --- phrases

def phrase_rows(seed=3):
    r = random.Random(seed)
    out = [(i, " ".join(r.choice(["The", "of", "a\tB", "c.", "d,", "x\x01y", "é", "zz!"]) for _ in range(r.randrange(60))),
            r.choice(["en", "de", None, "und"])) for i in range(150)]
    return [*out, (1, None, "en"), (2, "", "fr"), (None, "the the the " * 30, "en"), (3, "un deux " * 20, "fr"), out[0]]


@pytest.mark.parametrize("budget", [phrases.BUDGET, 5])
def test_phrases_match_sql(spark, budget):
    rows = phrase_rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns(
        {"phrase": F.lit("clash"), "n": F.lit(1), "f": F.lit(2), "k": F.lit(3)})
    got = phrases.collocations(docs.repartition(3), budget=budget)
    names = [c[0] for c in con.execute(phrases.ORACLE).description]
    want = con.fetchall()
    assert len(want) > 60
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want, key=repr)
    assert phrases.collocations(empty(spark)).count() == 0


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**12, 10**13 + 1, 10**12 + 7)], "a long, l long, r long")
    assert df.select(phrases.ratio("a", "l", "r")).head()[0] == 10**30 // ((10**13 + 1) * (10**12 + 7))


def test_groups_cut_large_prefixes():
    import pyarrow as pa

    rows = [(f"en\ta {i // 7} t{i % 7}", 1, 1) for i in range(70)]
    batches = [pa.record_batch([pa.array(c) for c in zip(*rows[i:i + 4])], phrases.ROW) for i in range(0, 70, 4)]
    got = list(phrases.groups(iter(batches), 5))
    assert sum(t.num_rows for t, _ in got) == 70 and max(t.num_rows for t, _ in got) <= 12
    assert not all(ended for _, ended in got)
