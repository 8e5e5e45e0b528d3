"""Corpus operators against brute force, round trips and planted cases on small inputs."""

import base64
import hashlib
import random
import time
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bookloom.llm import (arc, clusters, decontam, exact_dedup, forest, language, packing, planes, repeats,
                          token_count, toxicity)
from bookloom.llm.common import scratch
from bookloom.llm.tokenizer import Encoder, default_path

BYTES, WORDS = default_path("byte_bpe_50k.json"), default_path("word_bpe_49k.json")
PIECES = default_path("piece_bpe_32k.model")


def texts(seed: int, n: int = 60) -> list[str | None]:
    """Made-up texts with copies, near copies and a shared passage."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    passage = " ".join(r.choice(vocab) for _ in range(40))
    out: list[str | None] = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(0, 120))]
        if i % 7 == 0:
            words[5:5] = passage.split()
        if i % 5 == 4 and out[-1]:
            words = out[-1].split()
            if words and i % 10 == 9:
                words[r.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    return [*out, None, "", "  \n", "one two", "one two", "!!!", passage + "\t" + passage]


def documents(spark, rows, **extra):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- tokens

ODD = ["été", "ŉſ", "the", "Word", "a", "b", ".", ",", "*", "1.", " ", "  ", "\n", "\t", "'s", "é", "́", "\xa0", "\x1c", "!",
       "<|endoftext|>", "<|startoftext|>", "中", "Σ", "ß", "\r\n", "\x85", "'", "İ", ">.", "<|"]


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
def test_encoder_gives_the_librarys_ids(path):
    r, e = random.Random(1), Encoder(path, memo=50)
    made = ["".join(r.choice(ODD) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    for at in range(0, len(made), 100):
        for t, ids in zip(made[at:at + 100], e.ids(made[at:at + 100])):
            assert np.frombuffer(ids, "<u4").tolist() == list(e.whole(t)), repr(t)


@pytest.mark.parametrize("path", [BYTES, WORDS, PIECES])
def test_token_counts_are_spliced(spark, path):
    long = " ".join(f"wörd{i}, 中and\n moré{'!' * (i % 3)}" for i in range(80))
    rows = [long, "x" * 900, "x" * 300 + " " + "y" * 500, None, "", "short text", long]
    docs = documents(spark, rows, n_tokens="clash", n_bytes=3)
    found = token_count.count_tokens(docs, path, chunk=100, overlap=20)
    e = Encoder(path)
    assert collected(found, "doc_id", "n_bytes", "n_tokens") == sorted(
        ((i, len((t or "").encode()), len(e.whole(t or ""))) for i, t in enumerate(rows)), key=repr)
    assert token_count.count_tokens(empty(spark), path).count() == 0


def test_stable_boundaries():
    assert token_count.stable("a b", 1) and not token_count.stable("a b", 2)
    assert not token_count.stable("a  b", 2) and not token_count.stable(" a", 0)


# --- packing

def test_boundaries_of_long_white_space():
    text = "one" + "\n\t" * 500_000 + "two"
    spans = [(0, 3), *((i, i + 1) for i in range(3, len(text) - 3)), (len(text) - 3, len(text))]
    began = time.monotonic()
    assert token_count.boundaries(text, spans, 0, len(text)) == {3: 1}
    assert time.monotonic() - began < 20
    small = " a  b\x1c c\n"
    for start in range(len(small) + 1):
        at = start
        while at > 0 and small[at - 1].isspace():
            at -= 1
        want = {p: 0 for p in (at, start) if token_count.stable(small, p)}
        assert token_count.boundaries(small, [(start, start)], 0, len(small)) == want


def test_encoder_forgets_long_pieces():
    e = Encoder(default_path("byte_bpe_50k.json"))
    rows = ["x" * 1_000 + str(i) + "." for i in range(20)] + ["short words " + "y" * 65]
    assert [list(array("I", b)) for b in e.ids(rows + rows)] == [e.whole(t) for t in rows + rows]
    kept = [k for known in (*e.pieces, e.words) for k in known]
    assert kept and max(map(len, kept)) <= 64


def test_tournament_is_first_fit():
    r = random.Random(3)
    lengths = sorted((r.randint(1, 20) for _ in range(200)), reverse=True)
    room, want = [], []
    for n in lengths:
        b = next((i for i, x in enumerate(room) if x >= n), len(room))
        if b == len(room):
            room.append(20)
        want.append((b, 20 - room[b]))
        room[b] -= n
    assert packing.first_fit_decreasing(lengths, 20) == want


def test_packing_loses_no_id(spark):
    rows = [*texts(4), "word " * 500]
    docs = documents(spark, rows, start=1, ids="clash").union(documents(spark, [None, "twice"],
                                                                        start=1, ids="clash"))
    packed = packing.pack(docs, BYTES, size=64, end_id=1, per_group=20).collect()
    by_sequence = defaultdict(list)
    for p in packed:
        by_sequence[p.sequence_id].append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length <= 256
    e = Encoder(BYTES)
    for i, t in enumerate(rows):
        ids = [*e.whole(t or ""), 1]
        if i > 1:  # ids 0 and 1 occur twice
            mine = sorted((p for p in packed if p.doc_id == i), key=lambda p: p.start)
            assert np.frombuffer(b"".join(p.ids for p in mine), "<u4").tolist() == ids
            assert {p.doc_tokens for p in mine} == {len(ids)}
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    twice = [p for p in packed if p.doc_id < 2]
    assert sum(p.length for p in twice) == sum(len(e.whole(t or "")) + 1 for t in (*rows[:2], None, "twice"))
    assert sum(p.length for p in packed) >= 0.9 * 64 * (len(by_sequence) - 5)
    assert packing.pack(empty(spark), BYTES).count() == 0


# --- id planes

@pytest.mark.parametrize("bits", [True, False])
def test_planes_round_trip(spark, bits):
    rows = texts(5)
    docs = documents(spark, rows, n_tokens="clash").union(documents(spark, [None], n_tokens="x"))
    folder = scratch(spark, "planes")
    planes.write_planes(docs, folder, WORDS, 2, block=100, per_file=700, bits=bits)
    e, at = Encoder(WORDS), 0
    got = sorted(planes.read_planes(spark, folder).collect(), key=lambda r: r.start)
    want = sorted([(i, t or "") for i, t in enumerate(rows)] + [(0, "")])
    assert [g.doc_id for g in got] == [i for i, _ in want]
    for g, (i, t) in zip(got, want):
        ids = np.frombuffer(g.ids, "<u4").tolist()
        assert g.start == at and g.n_tokens == len(ids) and ids[-1] == 2
        if i:
            assert ids == [*e.whole(t), 2]
        at += g.n_tokens
    none = scratch(spark, "planes")
    planes.write_planes(empty(spark), none, WORDS, 2)
    assert planes.read_planes(spark, none).count() == 0


def test_planes_of_wide_ids():
    ids = np.array([0, 1, 2**32 - 1, 77, 2**31], "<u4")
    for bits in (True, False):
        index, back = planes.decode_file(planes.encode_file(1, 2, [(9, ids.tobytes())], 2, bits))
        assert back.tolist() == ids.tolist() and index["docs"] == [[9, 5]]
    with pytest.raises(ValueError):
        planes.decode_index(b"something else")


# --- archives

def test_archives_round_trip(spark):
    rows = [(3, "http://a/ b", "same"), (1, None, "same"), (2, "http://c", None), (5, "u", ""),
            (None, "u", "same"), (4, "u", "HTTP/1.1\r\n\r\nWARC/1.1\r\n\r\n filedesc:// é"),
            (7, "u", "x" * 5000), (7, "u", "x" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "digest", F.lit("clash")).repartition(3)
    old, new = scratch(spark, "arc"), scratch(spark, "warc")
    arc.write_arc(pages, old, per_file=2)
    arc.write_warc(arc.read_arc(spark, old), new, per_file=2)
    got = arc.read_warc(spark, new)

    def sha(t):
        return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()

    want = [(p, len((h or "").encode()), sha(h)) for p, _, h in rows]
    assert collected(got, "page_id", "payload_bytes", "payload_digest") == sorted(want, key=repr)
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got.collect()}
    assert kinds == {(1, "response", None), (3, "revisit", 1), (None, "revisit", 1),
                     (2, "response", None), (5, "revisit", 2), (4, "response", None),
                     (7, "response", None), (7, "revisit", 7)}
    assert {r.warc_date for r in got.collect()} == {"2024-01-02T03:04:05Z"}
    big = scratch(spark, "warc")
    arc.write_warc(arc.read_arc(spark, old), big, least=100)
    assert arc.read_warc(spark, big).where("record_type = 'revisit'").count() == 1
    none = scratch(spark, "arc")
    arc.write_arc(pages.limit(0), none)
    assert arc.read_arc(spark, none).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines_by_version(version):
    data = (arc.version_block(version, "x.arc") + b"\n"
            + arc.arc_record(version, "http://u", 8, b"pay\nload") + b"\n")
    (r,) = arc.parse_arc(data)
    assert (r.url, r.date, r.payload) == ("http://u", arc.DATE, b"pay\nload")
    with pytest.raises(ValueError):
        list(arc.parse_arc(data[:-5]))
    with pytest.raises(ValueError):
        list(arc.parse_arc(b"http://u 1.2.3.4 20240101 text/html 0\n"))
    assert arc.iso_date("1999") == "1999-01-01T00:00:00Z"


# --- exact duplicates

def test_exact_dedup(spark):
    rows = ["a b", "ab ", " a\tb  ", "AB", None, "", "\n", "a\xa0b"]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(
        documents(spark, rows, group_size="clash")).collect()}
    assert [got[i].keep_id for i in range(8)] == [2, 2, 2, 3, 6, 6, 6, 7]
    assert got[0].group_size == 3 and [got[i].kept for i in range(3)] == [False, False, True]
    assert got[1].text_sha256 == hashlib.sha256(b"ab").hexdigest()
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_digest_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    first = exact_dedup.digests(documents(spark, ["a", "b", "b"]))
    index.append(first)
    later = exact_dedup.digests(documents(spark, ["b", "c", "c "]).withColumn("doc_id", F.col("doc_id") + 10))
    index.append(later)
    assert index.rows().count() == 3
    got = {r.doc_id: (r.keep_id, r.kept) for r in index.decide(later).collect()}
    assert got == {10: (1, False), 11: (12, False), 12: (12, True)}
    plan = index.rows().join(index.rows().hint("merge"), "text_sha256")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan
    spark.sql(f"DROP TABLE {index.table}")


def test_a_small_batch_broadcasts_no_large_index(spark):
    index = exact_dedup.DigestIndex(spark)
    exact_dedup.exact_dedup(documents(spark, [f"text {i}" for i in range(2_000)]), index)
    batch = exact_dedup.digests(documents(spark, ["text 7", "new", "new"]))
    index.append(batch)
    assert sorted(r.group_size for r in index.hot(batch).collect()) == [1, 2]
    assert collected(index.decide(batch), "doc_id", "keep_id", "kept") == [
        (0, 7, False), (1, 1, True), (2, 1, False)]


def test_exact_dedup_keeps_whole_rows(spark):
    docs = documents(spark, ["a", "a", None, "b"], source="s")
    assert collected(exact_dedup.keep(docs), "doc_id", "text", "source") == [
        (0, "a", "s"), (2, None, "s"), (3, "b", "s")]


# --- repeats

def test_repeats_match_brute_force(spark):
    rows = [*texts(6), " ".join(["same"] * 70), "one\xa0word " * 30]
    seen, want = set(), []
    for i, t in enumerate(rows):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            key = tuple(words[s:s + 20])
            if key in seen:
                gone[s:s + 20] = [True] * 20
            seen.add(key)
        kept = [w for w, g in zip(words, gone) if not g]
        want.append((i, len(words), len(words) - len(kept), b" ".join(kept).decode()))
    got = repeats.remove_repeats(documents(spark, rows, n_words="clash").repartition(3))
    assert collected(got, "doc_id", "n_words", "n_removed", "kept_text") == sorted(want, key=repr)
    assert sum(w[2] > 0 for w in want) > 5
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_sliding_min_is_leftmost():
    r = np.random.default_rng(2).integers(0, 5, 50)
    for width in (1, 2, 5, 13):
        assert repeats.sliding_min(r, width).tolist() == [
            i + int(np.argmin(r[i:i + width])) for i in range(51 - width)]


# --- n-gram Jaccard join

def shingles(t):
    import re
    w = re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())
    return frozenset([tuple(w[k:k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else
                     [tuple(w)] if w else [])


@pytest.mark.parametrize("followers", [1_000, 2])
def test_jaccard_join_matches_brute_force(spark, followers, monkeypatch):
    monkeypatch.setattr(clusters, "FOLLOWERS", followers)
    rows = texts(8, 120)
    base = [f"w{i}" for i in range(60)]
    r = random.Random(5)
    for _ in range(25):
        own = list(base)
        for _ in range(r.randint(0, 2)):
            own[r.randrange(60)] = f"z{r.random()}"
        rows.append(" ".join(own).upper() + "!")
    sets = [shingles(t) for t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = forest.near_duplicates(documents(spark, rows, class_id="clash"))
    assert collected(got, "doc_id", "class_id", "n_links") == sorted(
        ((i, top(i), links[i]) for i in range(len(rows))), key=repr)
    assert forest.near_duplicates(empty(spark)).count() == 0


def test_jaccard_join_repeated_ids(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f"]).union(documents(spark, ["a b c d e f"]))
    got = forest.near_duplicates(docs)
    assert collected(got, "doc_id", "class_id", "n_links") == [(0, 0, 2), (0, 0, 2), (1, 0, 2)]
    assert forest.keep(docs).count() == 2


def test_jaccard_join_without_ids(spark):
    same, other = "one two three four five six seven", "x y z u v w"
    rows = [(None, same), (None, same), (4, same), (None, other), (None, other), (None, None), (2, ""), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"_hi": F.lit(1), "root": F.lit("r")})
    got = forest.near_duplicates(docs)
    assert collected(got, "doc_id", "class_id", "n_links") == sorted(
        [(None, 4, 2), (None, 4, 2), (4, 4, 2), (None, None, 1), (None, None, 1), (None, None, 0), (2, 2, 0), (2, 2, 0)],
        key=repr)
    kept = forest.keep(docs)
    assert kept.columns == docs.columns
    assert collected(kept, "doc_id", "text") == sorted([(4, same), (None, other), (None, None), (2, ""), (2, "")], key=repr)


def test_jaccard_join_pairs_of_short_prefixes_in_large_buckets(spark, monkeypatch):
    """Pairs that share four or five hashes in some tree, but six in none, are found in large buckets."""
    monkeypatch.setattr(clusters, "BLOCK", 3_000)
    r, rows = random.Random(3), []
    while len(rows) < 4:
        own = [f"w{r.random()}" for _ in range(50)]
        other = own[:45] + [f"w{r.random()}" for _ in range(5)]
        x, y = (forest.signature(forest.shingle_sets([" ".join(w).encode()])[0]).reshape(forest.TREES, -1)
                for w in (own, other))
        same = (x == y).cumprod(axis=1).sum(axis=1).max()
        if 4 <= same < 6:
            rows += [" ".join(own), " ".join(other)]
    assert all(0.8 <= len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
               for a, b in zip(rows[::2], rows[1::2]))
    got = forest.near_duplicates(documents(spark, rows))
    assert collected(got, "doc_id", "class_id", "n_links") == [(i, i // 2 * 2, 1) for i in range(4)]


def test_jaccard_join_blocks_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 7_000)
    monkeypatch.setattr(clusters, "leader_pairs", lambda rows, percent, longs: rows.select(
        rows["id"].alias("a"), rows["id"].alias("b")).limit(0))
    base, r, rows = [f"w{i}" for i in range(60)], random.Random(9), []
    for _ in range(50):
        own = list(base)
        for _ in range(r.randint(0, 3)):
            own[r.randrange(60)] = f"z{r.random()}"
        rows.append(" ".join(own))
    sets = [shingles(t) for t in rows]
    links = [sum(i != j and len(s & o) >= 0.8 * len(s | o) for j, o in enumerate(sets))
             for i, s in enumerate(sets)]
    assert len(set(links)) > 2
    got = forest.near_duplicates(documents(spark, rows))
    assert collected(got, "doc_id", "n_links") == sorted(enumerate(links), key=repr)


def test_jaccard_join_at_other_similarities(spark):
    """At 0.5 pairs meet and pass the sketch as they do at 0.8; what the trees can't find is refused."""
    r, rows = random.Random(4), []
    for _ in range(30):
        own = [f"w{r.random()}" for _ in range(80)]
        rows += [" ".join(own), " ".join(own[:55] + [f"w{r.random()}" for _ in range(25)])]
    got = forest.near_duplicates(documents(spark, rows), least=0.5)
    assert collected(got, "doc_id", "class_id", "n_links") == sorted(
        ((i, i // 2 * 2, 1) for i in range(60)), key=repr)
    assert [forest.least_depth(x) for x in (0.5, 0.8, 1.0)] == [1, 4, 6]
    assert clusters.most_differ(80, 128) == 29
    with pytest.raises(ValueError):
        forest.near_duplicates(documents(spark, rows), least=0.2)


# --- benchmark decontamination

ITEM = ("A farmer in the quiet valley sold 12 melons for 30 dollars, then Anna bought 12 more and "
        "walked home along the river")


def test_decontamination(spark):
    benchmark = spark.createDataFrame(
        [(1, ITEM), (1, ITEM), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    rows = ["Some words before. " + ITEM + " and after",
            "So " + ITEM.replace("12", "77").replace("Anna", "Boris").replace("30 dollars", "8 euros"),
            ITEM.replace("12", "77", 1), ITEM.upper() + "!!", "nothing of the kind at all, 12 melons",
            None, ""]
    got = {r.doc_id: r for r in decontam.leaks(documents(spark, rows, item_id="clash"),
                                               benchmark).collect()}
    assert set(got) == {0, 1, 3} and got[0].verbatim and not got[1].verbatim
    assert {r.item_id for r in got.values()} == {1} and got[0].n_windows == got[0].n_item_windows
    assert collected(decontam.keep(documents(spark, rows), benchmark), "doc_id") == [
        (2,), (4,), (5,), (6,)]
    assert decontam.leaks(empty(spark), benchmark).count() == 0
    assert decontam.leaks(documents(spark, rows), benchmark.limit(0)).count() == 0


def test_decontamination_of_items_without_usable_windows(spark):
    """Items of placeholders and short items are met word for word, in Spark as in SQL."""
    import duckdb

    benchmark = spark.createDataFrame(
        [(1, "What is 12 + 15 * 3 ?"), (2, "Paris is where exactly"), (3, "3 4 5 6 7 8 9"), (4, "two words"),
         (5, ITEM)], "item_id long, text string")
    rows = ["before: what is 12 + 15 * 3 ? after", "what is 12 + 15 * 4 ?", "say, paris is where exactly?",
            "paris is where", "1 2 3 4 5 6 7 8 9 10", "9 8 7 6 5 4 3", "two words", ITEM]
    docs = documents(spark, rows)
    columns = ["doc_id", "item_id", "n_windows", "n_item_windows", "n_slots", "verbatim"]
    got = collected(decontam.leaks(docs, benchmark), *columns)
    assert [r[:2] for r in got] == [(0, 1), (2, 2), (4, 3), (7, 5)] and all(r[5] for r in got)
    db = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", benchmark)):
        db.register(name, df.toPandas())
    assert sorted(db.sql(f"SELECT {', '.join(columns)} FROM ({decontam.oracle()})").fetchall(), key=repr) == got
    assert collected(decontam.keep(docs, benchmark), "doc_id") == [(1,), (3,), (5,), (6,)]


def test_decontamination_without_ids(spark):
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = spark.createDataFrame([(None, "It says: " + ITEM, 1), (None, "clean words only here", 2),
                                  (None, None, 3), (7, ITEM, 4), (8, "clean", 5)],
                                 "doc_id long, text string, _name long")
    assert collected(decontam.keep(rows, benchmark), "_name") == [(2,), (3,), (5,)]


# --- language, toxicity

TONGUES = {"en": "the of and with that there was shall thing", "de": "der und ist nicht eine schon über",
           "fr": "le dans une pour être très où", "es": "el una por qué niño está año"}


def tongue_rows(n=400):
    r = random.Random(9)
    out = []
    for i in range(n):
        lang = sorted(TONGUES)[i % 4]
        out.append((i, " ".join(r.choice(TONGUES[lang].split()) for _ in range(12)), lang, "s"))
    return [*out, (n, None, "en", "s"), (n + 1, "12 !? 3", "en", "s"), (n + 2, "", None, "s"),
            (n + 3, "THE THING!! AND, THAT", None, "s"), (n + 3, "THE THING!! AND, THAT", None, "s")]


def test_language(spark):
    rows = tongue_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = language.language_of(docs).collect()
    assert len(got) == len(rows)
    right = {i: lang for i, _, lang, _ in rows[:400]}
    held = [g for g in got if g.held_out and g.doc_id in right]
    assert held and sum(g.lang_pred == right[g.doc_id] for g in held) >= 0.98 * len(held)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got)
    assert {g.lang_pred for g in got if g.doc_id in (400, 401, 402)} == {"und"}
    assert {g.lang_pred for g in got if g.doc_id == 403} == {"en"}
    assert all(0 <= g.score <= 1 for g in got)
    kept = language.keep(docs)
    assert kept.columns == docs.columns and kept.count() == 402
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {g.lang_pred for g in language.language_of(none).collect()} == {"und"}
    assert language.language_of(empty(spark)).count() == 0


def test_toxicity(spark):
    r = random.Random(11)
    vocab = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 6))) for _ in range(200)]
    rows, labels = [], []
    for i in range(500):
        words = [r.choice(vocab) for _ in range(40)]
        if i % 5 == 0:
            for _ in range(3):
                words.insert(r.randrange(40), r.choice(["vilexa", "vilexb", "dreckig"]))
        rows.append(" ".join(words) + ".")
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [None, "", "!!"]
    marks = spark.createDataFrame([*labels, (0, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_of(documents(spark, rows, toxic=7, score="clash"), marks).collect()
    held = [g for g in got if g.held_out and g.doc_id < 500]
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g in got)
    assert held and sum(g.predicted == int(g.doc_id % 5 == 0) for g in held) >= 0.98 * len(held)
    bad = next(g for g in held if g.predicted)
    assert {rows[bad.doc_id][s.start:s.end] for s in bad.spans} <= {"vilexa", "vilexb", "dreckig"}
    assert {g.predicted for g in got if g.doc_id >= 500} == {0}
    calm = toxicity.toxicity_of(documents(spark, rows), marks.where("toxic = 0"))
    assert calm.where("predicted = 1").count() == 0
    assert toxicity.toxicity_of(empty(spark), marks).count() == 0


def test_field_marginals_match_enumeration():
    import itertools

    r = np.random.default_rng(0)
    model = toxicity.Field(np.zeros(1), 0.0, r.normal(size=(2, 2)), np.zeros(3))
    unary, edges = r.normal(size=7), np.array([0, 4, 7])
    p, pairs = model.marginals(unary, edges)
    for a, b in zip(edges, edges[1:]):
        total, one, two = 0.0, np.zeros(b - a), np.zeros((b - a, 4))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(unary[a + t] for t in range(b - a) if y[t])
                       + sum(model.move[y[t], y[t + 1]] for t in range(b - a - 1)))
            total += w
            one += w * np.array(y)
            for t in range(b - a - 1):
                two[t, 2 * y[t] + y[t + 1]] += w
        assert np.allclose(p[a:b], one / total) and np.allclose(pairs[a:b], two / total)
