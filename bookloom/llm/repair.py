"""Repair of conversation structure at the least cost, by a suffix-shared automaton.

A repaired conversation has roles that begin with s?(ua)+, or no rows. A row is kept (0), given the role
user or assistant (3) or deleted (4; blank and duplicate rows must be), rows with empty text
are inserted (3), and a truncated row that stays costs 3 more. Faults are told in order: blank (nothing
but blanks and the characters 09 to 0D), duplicate (role and text seen earlier in the conversation),
truncated (the last other character is none of . ! ?).

A conversation's signature is one character per row: its role's class, or that it must go, and whether
it is truncated. The cheapest way on depends on what is left of the signature and the grammar's state
alone, so all conversations share it. Distinct signatures are sorted from their ends: those with a
common suffix stand together, and each node of their automaton (a suffix, entered by one
character before it) is solved once per range of suffixes, for all four states: cost-to-go and first
edit, with a link to the node and state that follow. Nodes whose costs differ by a constant behave alike, so
they share one entry, which keeps the automaton small for conversations of any length. Edits at one
node and state have different initials, so the least initial among the cheapest gives the least audit.

Rows of one turn are ordered by a digest of role and text; null turns come first, null roles and texts
are a blank. Repeated rows are duplicates. A null conv_id is a conversation like others. Signature,
audit and digest of a conversation are single values over all its rows, so these pass through one task,
as a sorted stream of which a batch, and a byte per row, is held. Empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bookloom.llm.clusters import runs
from bookloom.llm.common import settle

SPACE = " \t\n\x0b\f\r"
#: Characters of a signature: roles s, u, a and others, the same truncated, and rows that must go.
SYMBOLS = "suaoSUAOx"
#: Grammar states: nothing yet, after s, after u, after a. NEXT: where each role leads, if it may follow.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Role that a row gets which is inserted or given another role in each state.
GIVEN = ["user", "user", "assistant", "user"]
RENAME, DELETE, INSERT, CUT = 3, 4, 3, 3
END = ((0, 6, 3, 0), ("", "I", "I", ""))
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def state_after(state: int, role: str) -> int | None:
    return NEXT.get((state, role))


def solved(ahead: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str]:
    """Cost-to-go by state before a row, and the initial of the first edit, from the costs after it."""
    options: list[dict[str, int]] = []
    for q in range(4):
        own = {"D": DELETE + ahead[q]}
        if symbol != "x":
            cut = CUT if symbol.isupper() else 0
            kept = state_after(q, symbol.lower())
            if kept is not None:
                own["K"] = cut + ahead[kept]
            own["R"] = RENAME + cut + ahead[state_after(q, GIVEN[q][0])]
        options.append(own)
    least = [min(o.values()) for o in options]
    cost = list(least)
    for q in (2, 3, 0, 1):  # two inserted rows lead back to where they began, so one look ahead will do
        to = state_after(q, GIVEN[q][0])
        options[q]["I"] = INSERT + (least[to] if q in (2, 3) else cost[to])
        cost[q] = min(least[q], options[q]["I"])
    return tuple(cost), "".join(min(k for k, v in o.items() if v == c) for o, c in zip(options, cost))


class Automaton:
    """Entries by (costs after a row less their minimum, symbol): costs before it, the same way, what
    was taken off, and first edits."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, ...], int] = {END[0]: 0}
        self.costs: list[tuple[int, ...]] = [END[0]]
        self.entries: dict[tuple[int, str], tuple[int, int, str]] = {}

    def step(self, number: int, symbol: str) -> tuple[int, int, str]:
        found = self.entries.get((number, symbol))
        if found is None:
            cost, first = solved(self.costs[number], symbol)
            off = min(cost)
            plain = tuple(c - off for c in cost)
            if plain not in self.numbers:
                self.numbers[plain] = len(self.costs)
                self.costs.append(plain)
            found = self.entries[number, symbol] = (self.numbers[plain], off, first)
        return found


def audits(reversed_signatures: Iterator[str]) -> Iterator[tuple[int, str]]:
    """Cost and audit of each signature; they come sorted, written from their ends."""
    known, before = Automaton(), ""
    # of the current suffix and all shorter ones: entry number, cost taken off so far, first edits
    numbers, offs, firsts = [0], [0], [END[1]]
    for text in reversed_signatures:
        shared = len(os.path.commonprefix([before, text]))
        del numbers[shared + 1:], offs[shared + 1:], firsts[shared + 1:]
        for symbol in text[shared:]:
            number, off, first = known.step(numbers[-1], symbol)
            numbers.append(number)
            offs.append(offs[-1] + off)
            firsts.append(first)
        before, out, q, left = text, [], 0, len(text)
        while True:
            edit = firsts[left][q]
            if not edit:
                break
            out.append(edit)
            if edit != "D":
                role = text[left - 1].lower() if edit == "K" else GIVEN[q][0]
                q = state_after(q, role)
            if edit != "I":
                left -= 1
        yield offs[-1] + known.costs[numbers[-1]][0], "".join(out)


def key() -> Column:
    return F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))


def plain(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the last two; group, none: the id without null."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"),
                       F.coalesce("conv_id", F.lit(0)).alias("group"),
                       F.col("conv_id").isNull().cast("int").alias("none"))


def classed(rows: DataFrame) -> DataFrame:
    """conv_id, group, none, turn, key, nth (of equal rows), role_class (0 s, 1 u, 2 a, 3 other), fault
    (0 none, 1 blank, 2 duplicate, 3 truncated)."""
    bare = F.rtrim("text", F.lit(SPACE))
    order = W.partitionBy("group", "none", "key").orderBy(F.asc_nulls_first("turn"))
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    narrow = rows.select("conv_id", "group", "none", "turn", key().alias("key"), kind.alias("role_class"),
                         F.right(bare, F.lit(1)).alias("last"))
    return narrow.withColumn("nth", F.row_number().over(order)).select(
        "conv_id", "group", "none", "turn", "key", "nth", "role_class",
        F.when(F.col("last") == "", 1).when(F.col("nth") > 1, 2)
        .when(~F.col("last").isin(".", "!", "?"), 3).otherwise(0).alias("fault"))


class Tally:
    """Signature and counts of one conversation, from its rows in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.parts, self.before = conv_id, [], None
        self.least = self.most = self.turn = None
        self.turns = self.illegal = 0
        self.faults = np.zeros(4, np.int64)

    def add(self, part: pa.RecordBatch) -> None:
        kind, fault = part.column("role_class").to_numpy(), part.column("fault").to_numpy()
        self.faults += np.bincount(fault, minlength=4)
        at = np.where((fault == 1) | (fault == 2), 8, kind + 4 * (fault == 3))
        self.parts.append(np.frombuffer(SYMBOLS.encode(), np.uint8)[at].tobytes())
        chain = kind if self.before is None else np.r_[self.before, kind]
        self.before = int(kind[-1])
        pairs = chain[:-1] * 4 + chain[1:]
        self.illegal += int((~np.isin(pairs, (1, 6, 9))).sum())  # su, ua, au
        turn = part.column("turn").drop_null().to_numpy()
        if len(turn):
            self.turns += int((np.diff(turn) != 0).sum()) + (self.turn is None or int(turn[0]) != self.turn)
            self.least = int(turn[0]) if self.least is None else self.least
            self.most = self.turn = int(turn[-1])

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, b"".join(self.parts).decode(), gaps, *self.faults[1:].tolist(), self.illegal)


SIGNED = "conv_id long, signature string, " + ", ".join(f"{c} long" for c in COUNTS)


def signed(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps, blank, duplicate, truncated, illegal of plain() rows."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now = None
        for new, part in runs(batches, ["group", "none"]):
            if new:
                if now is not None:
                    done.append(now.row())
                now = Tally(part.column("conv_id")[0].as_py())
                if len(done) >= 1_000:
                    yield packed(done)
                    done = []
            now.add(part)
        if now is not None:
            done.append(now.row())
        if done:
            yield packed(done)

    def packed(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), kinds)],
                               ["conv_id", "signature", *COUNTS])

    return in_order(classed(rows), ["turn", "key", "nth"]).mapInArrow(find, SIGNED)


def in_order(rows: DataFrame, columns: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "group", "none").sortWithinPartitions(
        "group", "none", *[F.asc_nulls_first(c) for c in columns])


def solutions(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit of each distinct signature."""
    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []

        def texts() -> Iterator[str]:
            for b in batches:
                for t in b.column(0).to_pylist():
                    held.append(t[::-1])
                    yield t

        found: list[tuple[int, str]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            cost, audit = zip(*found)
            return pa.record_batch([pa.array(held[:len(found)], pa.string()), pa.array(cost, pa.int64()),
                                    pa.array(audit, pa.string())], ["signature", "cost", "audit"])

        for cost, audit in audits(texts()):
            found.append((cost, audit))
            size += len(audit)
            if len(found) >= 10_000 or size > 1_000_000:
                yield batch()
                held.clear()
                found, size = [], 0
        if found:
            yield batch()

    turned = signatures.select(F.reverse("signature").alias("turned")).distinct()
    n = int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turned.repartitionByRange(n, "turned").sortWithinPartitions("turned").mapInArrow(
        solve, "signature string, cost long, audit string")


class Editor:
    """The repaired rows of one conversation, as its rows come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            role = GIVEN[self.state]
            self.at, self.state = self.at + 1, state_after(self.state, role[0])
            yield role, "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            role = role if edit == "K" else GIVEN[self.state]
            self.state = state_after(self.state, role[:1])
            yield role, text, edit


def planned(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """plain() rows in order, each conversation's behind the row with its plan (conv_id, audit, …)."""
    keyed = plans.select(F.coalesce("conv_id", F.lit(0)).alias("group"),
                         F.col("conv_id").isNull().cast("int").alias("none"), F.lit(0).alias("kind"),
                         *plans.columns)
    return in_order(keyed.unionByName(rows.withColumns({"kind": F.lit(1), "key": key()}),
                                      allowMissingColumns=True), ["kind", "turn", "key"])


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text, edit (K, R or I) of the repaired conversations."""
    rows = plain(rows)
    found = settle(signed(rows), "signatures")
    plans = found.join(solutions(found), "signature").select("conv_id", "audit")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, conv_id, done, place in edited(batches):
            if done:
                role, text, kind = zip(*done)
                yield pa.record_batch([pa.array([conv_id] * len(done), pa.int64()),
                                       pa.array(range(place, place + len(done)), pa.int64()),
                                       pa.array(role, pa.string()), pa.array(text, pa.string()),
                                       pa.array(kind, pa.string())], ["conv_id", "place", "role", "text", "edit"])

    return planned(rows, plans).mapInArrow(edit, "conv_id long, place long, role string, text string, edit string")


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch | None, int | None, list, int]]:
    """Of planned() rows: (plan, conv_id, [], 0) where a conversation begins, then (None, conv_id, some of
    its repaired rows, their first place)."""
    editor, conv_id, place = None, None, 0
    for new, part in runs(batches, ["group", "none"]):
        done: list[tuple[str, str, str]] = []
        if new:
            if editor is not None and (tail := list(editor.inserted())):
                yield None, conv_id, tail, place
            conv_id, place = part.column("conv_id")[0].as_py(), 0
            editor = Editor(part.column("audit")[0].as_py())
            yield part.slice(0, 1), conv_id, [], 0
            part = part.slice(1)
        for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist()):
            done.extend(editor.row(role, text))
        if done:
            yield None, conv_id, done, place
            place += len(done)
    if editor is not None and (tail := list(editor.inserted())):
        yield None, conv_id, tail, place


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps (turn numbers missing between the least and the greatest), blank, duplicate, truncated,
    illegal (neighbours other than su, ua, au), cost, audit, repaired_sha256 (of role:text lines)."""
    rows = plain(rows)
    found = settle(signed(rows), "signatures")
    plans = found.join(solutions(found), "signature").select("conv_id", *COUNTS, "cost", "audit")
    kept = ["conv_id", *COUNTS, "cost", "audit"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, hashed, empty = None, None, True

        def row() -> pa.RecordBatch:
            return pa.record_batch([*plan.select(kept).columns, pa.array([hashed.hexdigest()])],
                                   [*kept, "repaired_sha256"])

        for part, _, done, _ in edited(batches):
            if part is not None:
                if plan is not None:
                    yield row()
                plan, hashed, empty = part, hashlib.sha256(), True
            for role, text, _ in done:
                hashed.update((("" if empty else "\n") + role + ":" + text).encode())
                empty = False
        if plan is not None:
            yield row()

    return planned(rows, plans).mapInArrow(
        digest, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS)
                + ", cost long, audit string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with made-up faults, by crc32 of `conv_id:turn` modulo 20: 0 lost, 1 without text, 2 without
    the marks . ! ?, 3 twice, 4 with the role user."""
    def text_of(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"),
                         kind.alias("kind")).where("kind <> 0")
    return marked.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    ).drop("copy")


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """repair() of damaged() rows, with a row for every conversation of the undamaged ones."""
    ids = rows.select("conv_id").distinct()
    found = repair(damaged(rows)).withColumnRenamed("conv_id", "_id")
    return ids.join(found, ids["conv_id"].eqNullSafe(found["_id"]), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*COUNTS, "cost"]],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def oracle() -> str:
    """SQL: faults as above; costs by recursion from the last row, each state's best (cost as nine digits,
    then audit) as a string, so that the least string is cheapest, then least."""
    def more(cost: str, edit: str, value: str) -> str:
        return f"(lpad(({value}[:9]::BIGINT + {cost})::VARCHAR, 9, '0') || '{edit}' || {value}[10:])"

    def base(q: int) -> str:
        give = state_after(q, GIVEN[q][0])
        kept = " ".join(f"WHEN ini = '{r}' THEN {more('cut', 'K', f'v{to}')}" for (at, r), to in NEXT.items() if at == q)
        return (f"least({more(str(DELETE), 'D', f'v{q}')}, CASE WHEN fault < 2 THEN CASE {kept} END END, "
                f"CASE WHEN fault < 2 THEN {more(f'{RENAME} + cut', 'R', f'v{give}')} END)")

    def inserted(q: int, to: str) -> str:
        return f"least(b{q}, {more(str(INSERT), 'I', to)})"

    given = " ".join(f"WHEN {q} THEN '{r}'" for q, r in enumerate(GIVEN))
    moves = " ".join(f"WHEN q = {q} AND left(role, 1) = '{r}' THEN {to}" for (q, r), to in NEXT.items())
    end = [f"'{c:09d}{a}'" for c, a in zip(END[0], ("", "II", "I", ""))]
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(
    list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(
      coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM raw WHERE kind <> 0),
keyed AS (SELECT *, md5(length(role)::VARCHAR || ':' || role || ':' || text) AS k, left(role, 1) AS ini,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare FROM damaged),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS i FROM keyed),
faults AS (SELECT conv_id, turn, role, text, ini, i,
    CASE WHEN bare = '' THEN 3 WHEN row_number() OVER (PARTITION BY conv_id, k ORDER BY i) > 1 THEN 2
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault FROM placed),
rows AS (SELECT *, CASE fault WHEN 1 THEN {CUT} ELSE 0 END AS cut, count(*) OVER (PARTITION BY conv_id) AS n,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM faults),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 1) AS truncated,
    count(*) FILTER (i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id),
go AS (SELECT DISTINCT conv_id, n + 1 AS i, {', '.join(f'{e} AS v{q}' for q, e in enumerate(end))} FROM rows
  UNION ALL SELECT conv_id, i, {inserted(0, 'c2')}, {inserted(1, 'c2')}, c2, c3 FROM (
    SELECT *, {inserted(2, 'b3')} AS c2, {inserted(3, 'b2')} AS c3 FROM (
      SELECT go.conv_id, rows.i, {', '.join(f'{base(q)} AS b{q}' for q in range(4))}
      FROM go JOIN rows ON rows.conv_id IS NOT DISTINCT FROM go.conv_id AND rows.i = go.i - 1))),
plan AS (SELECT conv_id, v0[:9]::BIGINT AS cost, v0[10:] AS audit FROM go WHERE i = 1),
walk AS (SELECT conv_id, audit, 1 AS p, 1::BIGINT AS i, 0 AS q, []::VARCHAR[] AS lines FROM plan
  UNION ALL SELECT conv_id, audit, p + 1, i + (e <> 'I')::INT, CASE WHEN e = 'D' THEN q ELSE CASE {moves} END END,
    CASE WHEN e = 'D' THEN lines ELSE list_append(lines, role || ':' || text) END FROM (
      SELECT w.*, w.audit[p] AS e, CASE w.audit[p] WHEN 'K' THEN r.role ELSE CASE q {given} END END AS role,
        CASE w.audit[p] WHEN 'I' THEN '' ELSE r.text END AS text
      FROM walk w LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i WHERE p <= length(w.audit)))
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
  coalesce(plan.audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN plan ON plan.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN walk ON walk.conv_id IS NOT DISTINCT FROM d.conv_id AND p = length(walk.audit) + 1"""
