"""Shared SQL building blocks: the derived inputs and each analysis stage as a CTE."""

from __future__ import annotations

from bookloom.operators import categorize as cat
from bookloom.operators import reconcile as rec
from bookloom.rules import (accounts, capex, declarative, detectors, exact, flags, flows, keywords,
                            loans, merchants, patterns)
from bookloom.sources import derive

CTES: dict[str, tuple[str, list[str]]] = {}


def q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, int):
        return str(v)
    return "'" + v.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(q(x) for x in r) + ")" for r in rows) + ")"


def cte(name: str, sql: str, deps: str = "") -> None:
    CTES[name] = (sql, deps.split())


def table(name: str, columns: str, rows: list[tuple]) -> None:
    cte(name, f"SELECT * FROM {values(rows)} v({columns})")


def build(select: str, needs: str) -> str:
    """A statement with every CTE the named ones need, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for d in CTES[name][1]:
            visit(d)
        if name not in order:
            order.append(name)

    for n in needs.split():
        visit(n)
    parts = ", ".join(f"{n} AS MATERIALIZED ({CTES[n][0]})" for n in order)
    return f"WITH {parts} {select}" if order else select


def has(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def rx(text: str, patterns_: list[str], flag: str = "(?i)") -> str:
    return f"regexp_matches({text}, {q(flag + '|'.join(f'(?:{p})' for p in patterns_))})"


def m(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(18,2))"


def text(expr: str) -> str:
    return f"CAST({m(expr)} AS VARCHAR)"


def msum(expr: str, cond: str | None = None) -> str:
    f = f" FILTER (WHERE {cond})" if cond else ""
    return m(f"coalesce(sum({expr}){f}, 0)")


def join(items: str) -> str:
    return f"array_to_string({items}, ' | ')"


def compact(*pairs: tuple[str, str]) -> str:
    inner = ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in pairs)
    return f"list_filter([{inner}], lambda z: z IS NOT NULL)"


def pct(num: str, den: str, digits: int = 2) -> str:
    """num / den as a percent, half up, in exact whole-number arithmetic."""
    n, d = f"CAST(({num}) * 100 AS HUGEINT)", f"CAST(({den}) * 100 AS HUGEINT)"
    scale = 100 * 10 ** digits
    unit = f"CAST({10 ** -digits:.{digits}f} AS DECIMAL(4,{digits}))"
    whole = f"((abs({n}) * {scale} * 2 + abs({d})) // (abs({d}) * 2))"
    return (f"CAST(CAST((sign({n}) * sign({d}) * {whole}) AS DECIMAL(18,0)) * {unit} "
            f"AS DECIMAL(18,{digits}))")


# --- derived inputs ---------------------------------------------------------

def _list(items: list[str]) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def _describe(items: list[str]) -> str:
    n = len(items)
    t = f"({_list(items)})[(k % {n}) + 1]"
    return (f"CASE (k >> 20) % 8 WHEN 1 THEN {t} || ' #' || (k % 100000) WHEN 2 THEN {t} || ' 03/15' "
            f"WHEN 3 THEN 'POS ' || {t} WHEN 4 THEN lower({t}) WHEN 5 THEN {t} || ' CARD 1234' ELSE {t} END")


_RAW = "CAST(round(price * 100) AS BIGINT)"
_CENTS = (f"CASE WHEN k % 1009 = 5 THEN 0 WHEN k % 17 = 0 THEN "
          f"({[a * 100 for a in derive.ROUND_AMOUNTS]})[((k >> 12) % 7) + 1] "
          f"WHEN k % 5 IN (1, 2) THEN {_RAW} % 20000 + 1 WHEN k % 5 = 3 THEN {_RAW} % 60000 + 1 "
          f"ELSE {_RAW} % 1200000 + 1 END")


def _dec(cents: str) -> str:
    return m(f"CAST({cents} AS DECIMAL(16,0)) * CAST(0.01 AS DECIMAL(3,2))")


def _key(*cols: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(cols)})), 1, 15) AS BIGINT)"


cte("tx", f"""
SELECT client % 50 AS client_id, k * 2 + copy AS seq, date, description, amount, direction,
  'c' || (client % 50) || '-' || substr(date, 1, 7) AS batch_id, 't' || (k * 2 + copy) AS transaction_id
FROM (
  SELECT k, client, date, {_describe(derive.CREDIT_TEXTS)} AS description, {_dec(_CENTS)} AS amount, 'CREDIT' AS direction
  FROM (SELECT {_key('o_orderkey', 'o_custkey')} AS k, o_custkey AS client,
          strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS price FROM orders)
  UNION ALL
  SELECT k, client, date, {_describe(derive.DEBIT_TEXTS)}, {_dec(_CENTS)}, 'DEBIT'
  FROM (SELECT {_key('l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey',
                     'CAST(round(l_extendedprice * 100) AS BIGINT)', "strftime(l_shipdate, '%Y-%m-%d')")} AS k,
          l_suppkey AS client, strftime(l_shipdate, '%Y-%m-%d') AS date, l_extendedprice AS price FROM lineitem)
) b, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR k % 23 = 7""")

cte("totals", f"""
SELECT batch_id, min(client_id) AS client_id, {msum('amount', "direction='CREDIT'")} AS total_credits,
  {msum('amount', "direction='DEBIT'")} AS total_debits, count(*) AS transaction_count,
  {m("coalesce(sum(CASE WHEN direction='CREDIT' THEN amount ELSE -amount END),0)")} AS net_change
FROM tx GROUP BY batch_id""", "tx")

cte("batches", f"""
SELECT batch_id, client_id, first_day AS period_start, last_day(first_day) AS period_end, opening AS beginning_balance,
  CASE WHEN n % 13 = 0 THEN NULL ELSE {m('opening + net_change + CASE WHEN n % 7 = 0 THEN 12.34 WHEN n % 10 = 0 THEN 0.05 WHEN n % 11 = 0 THEN -40.00 ELSE 0 END')} END AS ending_balance,
  batch_id || '.csv' AS source_document, 'bank_statement' AS document_type
FROM (SELECT *, CAST(month || '-01' AS DATE) AS first_day,
        client_id + CAST(substr(month,1,4) AS INT) * 12 + CAST(substr(month,6,2) AS INT) AS n,
        {m('1000 + coalesce(sum(net_change) OVER (PARTITION BY client_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS opening
      FROM (SELECT *, substr(batch_id, length(batch_id) - 6) AS month FROM totals))""", "totals")

cte("clients", "SELECT DISTINCT c_custkey % 50 AS client_id FROM customer")

_lessons = [(i, *line.split("|")) for i, line in enumerate(derive.LESSONS)]
table("lessons", "created_seq, description, account_code, account_name, account_type, side", _lessons)


def ktext(c: str) -> str:
    out = f"upper(trim({c}))"
    for p in (r"#\d+", r"\b\d{2}/\d{2}(/\d{2,4})?\b", r"\bCARD\s*\d{4}\b", r"\bXX+\d{4}\b", r"\b\d{6,}\b"):
        out = f"regexp_replace({out}, {q(p)}, '', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def kid(p: str) -> str:
    return f"substr(sha256(upper(trim({p}))), 1, 16)"


def kconf(conf: str, over: str) -> str:
    d = lambda x: f"CAST({x} AS DOUBLE)"
    return (f"greatest({d(0.5)}, least({d(0.99)}, {d(0.9)} + least({d(0.09)}, ({conf}) * {d(0.01)}) "
            f"- least({d(0.3)}, ({over}) * {d(0.1)})))")


cte("learned", f"""
SELECT client_id, created_seq, {ktext('description')} AS pattern, {kid(ktext('description'))} AS rule_id, account_code,
  account_name, account_type, side, client_id * 2 AS times_applied, client_id % 12 AS times_confirmed,
  client_id % 5 AS times_overridden, {kconf('client_id % 12', 'client_id % 5')} AS confidence
FROM clients, lessons WHERE (client_id + created_seq) % 3 > 0""", "clients lessons")

# --- merchants --------------------------------------------------------------

def clean(c: str) -> str:
    out = f"upper(trim({c}))"
    word = lambda g: r"\b(?:" + "|".join(g.split()) + r")\b"
    for p in (word(merchants.NOISE_WORDS_FIRST), merchants.NOISE_CHECK, word(merchants.NOISE_WORDS_SECOND),
              *merchants.NOISE_NUMBERS, merchants.PUNCTUATION, r"\s+"):
        out = f"regexp_replace({out}, {q(p)}, ' ', 'g')"
    return f"trim({out})"


_own = [(i, *line.split("|")) for i, line in enumerate(derive.OWN_MERCHANTS)]
_own_case = "CASE " + " ".join(
    f"WHEN (client_id + {i}) % 4 = 0 AND contains(merchant_clean, {q(p.upper())}) THEN {q(c)}"
    for i, p, c, _ in _own) + " END"
table("aliases", "rank, alias, canonical",
      [(i, r["alias"], r["canonical"]) for i, r in enumerate(merchants.aliases())])
_stop = ", ".join(q(w) for w in merchants.STOP_WORDS)
cte("cleaned", f"""
SELECT *, list_filter(string_split(merchant_clean, ' '), lambda t: length(t) > 1 AND t NOT IN ({_stop})) AS tokens
FROM (SELECT tx.*, {clean('description')} AS merchant_clean FROM tx)""", "tx")
cte("alias_hit", """
SELECT merchant_clean, arg_min(canonical, rank) AS alias_id FROM (SELECT DISTINCT merchant_clean FROM cleaned) c
JOIN aliases ON contains(merchant_clean, alias) GROUP BY 1""", "cleaned aliases")
cte("norm", f"""
SELECT c.*, own IS NOT NULL AS client_matched, own IS NULL AND alias_id IS NOT NULL AS alias_matched, provisional,
  coalesce(own, alias_id, provisional) AS canonical
FROM (SELECT *, {_own_case} AS own, CASE WHEN len(tokens) > 0 THEN upper(array_to_string(tokens[1:3], '_'))
        ELSE upper(substr(merchant_clean, 1, 20)) END AS provisional FROM cleaned) c
LEFT JOIN alias_hit USING (merchant_clean)""", "cleaned alias_hit")

# --- flows ------------------------------------------------------------------

def flow_case(rules_: list[dict], field: str, tail: str, t: str = "trim(description)") -> str:
    return "CASE " + " ".join(f"WHEN {rx(t, r['patterns'])} THEN {q(r[field])}" for r in rules_) + f" {tail} END"


def _inflow_tail(i: int) -> str:
    pick = lambda x: q(x[i])
    return (f"WHEN contains(upper(description), 'DEPOSIT') THEN {pick(flows.GENERIC_DEPOSIT)} "
            f"WHEN amount >= 10000 AND amount % 1000 = 0 THEN {pick(flows.LARGE_ROUND)} ELSE {pick(flows.NO_PATTERN)}")


cte("flow", f"""
SELECT seq, CASE WHEN direction = 'CREDIT' THEN {flow_case(flows.inflow(), 'type', "ELSE 'UNKNOWN'")}
    ELSE {flow_case(flows.outflow(), 'type', "ELSE 'OUTFLOW'")} END AS inflow_type,
  CASE WHEN direction = 'CREDIT' THEN {flow_case(flows.inflow(), 'confidence', _inflow_tail(0))}
    ELSE {flow_case(flows.outflow(), 'confidence', f'ELSE {q(1.0)}')} END AS flow_confidence,
  CASE WHEN direction = 'CREDIT' THEN {flow_case(flows.inflow(), 'evidence', _inflow_tail(1))}
    ELSE {flow_case(flows.outflow(), 'evidence', f"ELSE {q(flows.PLAIN_OUTFLOW[1])}")} END AS flow_evidence
FROM tx""", "tx")

# --- loans ------------------------------------------------------------------

def loan_type(t: str = "upper(description)") -> str:
    return "CASE " + " ".join(f"WHEN {has(t, w)} THEN {q(k)}" for k, w in loans.types()) + " ELSE 'GENERIC' END"


def number_after(pattern: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract(upper(description), {q(pattern)}, 1), '') AS DECIMAL(18,2))"


cte("loan_rows", f"""
SELECT *, {m('amount - coalesce(fee, 0)')} AS net FROM (
  SELECT tx.*, {loan_type()} AS loan_type, nullif({number_after(loans.FEE_PATTERN)}, 0) AS fee,
    {number_after(loans.INTEREST_PATTERN)} AS stated,
    CASE WHEN client_id % 4 = 0 AND contains(upper(description), 'SBA LOAN') THEN 0
         WHEN (client_id + 1) % 4 = 0 AND contains(upper(description), 'EQUIPMENT') THEN 1 END AS manual
  FROM tx WHERE direction = 'DEBIT' AND {has('upper(description)', loans.KEYWORDS)})""", "tx")
cte("schedule", f"""
SELECT DISTINCT client_id, CAST(seq % 3 AS INT) AS loan_ordinal, 'L' || (seq % 3) AS loan_id,
  CASE WHEN seq % 2 = 0 THEN date ELSE '2000-01-01' END AS due, {m('amount + 0.25')} AS payment,
  {m('round(amount * CAST(0.8 AS DECIMAL(2,1)), 2)')} AS principal,
  {m('amount - round(amount * CAST(0.8 AS DECIMAL(2,1)), 2)')} AS interest
FROM tx WHERE direction = 'DEBIT' AND seq % 11 = 0 AND regexp_matches(upper(description), 'NOTE PAYMENT|INSTALLMENT|ADVANCE')""", "tx")
cte("entry", """
SELECT r.seq, first(s.loan_id ORDER BY s.loan_ordinal, s.due <> r.date, s.due, s.payment) AS loan_id,
  first(s.principal ORDER BY s.loan_ordinal, s.due <> r.date, s.due, s.payment) AS principal,
  first(s.interest ORDER BY s.loan_ordinal, s.due <> r.date, s.due, s.payment) AS interest
FROM loan_rows r JOIN schedule s ON s.client_id = r.client_id AND abs(s.payment - r.amount) <= 0.50
WHERE r.manual IS NULL AND r.stated IS NULL GROUP BY r.seq""", "loan_rows schedule")
_share = "CASE loan_type " + " ".join(
    f"WHEN {q(k)} THEN CAST({s} AS DECIMAL(4,2))" for k, (s, _, _) in loans.estimates().items()) + " END"
_pctt = "CASE loan_type " + " ".join(f"WHEN {q(k)} THEN {q(p)}" for k, (_, p, _) in loans.estimates().items()) + " END"
_rest = "CASE loan_type " + " ".join(f"WHEN {q(k)} THEN {q(str(100 - int(p)))}" for k, (_, p, _) in loans.estimates().items()) + " END"
_rate = "CASE loan_type " + " ".join(f"WHEN {q(k)} THEN {q(r)}" for k, (_, _, r) in loans.estimates().items()) + " END"
cte("split", f"""
SELECT *, CASE source WHEN 'manual' THEN CASE manual WHEN 0 THEN 'Manual split applied: 70% principal, 30% interest'
      ELSE 'Manual split applied: 65% principal, 30% interest' END
    WHEN 'description' THEN 'Interest extracted from description: $' || interest
    WHEN 'amortization' THEN 'Matched amortization schedule ''' || loan_id || ''' for ' || date
    ELSE 'Estimated split using ' || loan_type || ' typical rate (' || {_rate} || '% annual). ~' || {_pctt}
      || '% interest ($' || interest || '), ~' || {_rest} || '% principal ($' || principal
      || '). ESTIMATED — provide lender statement for accurate split.' END AS evidence
FROM (SELECT r.seq, r.client_id, r.date, r.amount, r.loan_type, r.manual, e.loan_id,
    CASE WHEN manual IS NOT NULL THEN 'manual' WHEN stated IS NOT NULL THEN 'description'
      WHEN e.seq IS NOT NULL THEN 'amortization' ELSE 'estimated' END AS source,
    {m(f"CASE WHEN manual = 0 THEN round(net * CAST(0.7 AS DECIMAL(5,4)), 2) WHEN manual = 1 THEN round(net * CAST(0.65 AS DECIMAL(5,4)), 2) WHEN stated IS NOT NULL THEN net - stated WHEN e.seq IS NOT NULL THEN e.principal ELSE net - round(net * {_share}, 2) END")} AS principal,
    {m(f"CASE WHEN manual IS NOT NULL THEN round(net * CAST(0.3 AS DECIMAL(5,4)), 2) WHEN stated IS NOT NULL THEN stated WHEN e.seq IS NOT NULL THEN e.interest ELSE round(net * {_share}, 2) END")} AS interest,
    {m("CASE WHEN manual = 1 AND fee IS NULL THEN round(net * CAST(0.05 AS DECIMAL(5,4)), 2) ELSE fee END")} AS fees
  FROM loan_rows r LEFT JOIN entry e USING (seq))""", "loan_rows entry")

# --- categorisation ---------------------------------------------------------

table("exact_rules", "rank, keyword, account, name, type, side, deductible, ref, note",
      [(i, *(r[k] for k in ("keyword", "account", "name", "type", "direction", "deductible", "ref", "note")))
       for i, r in enumerate(exact.rules())])
cte("cands", """
SELECT DISTINCT t, direction FROM (SELECT description AS t, direction FROM norm UNION ALL
  SELECT merchant_clean, direction FROM norm UNION ALL SELECT canonical, direction FROM norm) WHERE t <> ''""", "norm")
cte("exact_hit", """
SELECT t, direction, min(rank) AS rank FROM cands JOIN exact_rules r
  ON contains(upper(trim(t)), keyword) AND (side = '' OR side = direction) GROUP BY 1, 2""", "cands exact_rules")
_pr = patterns.rules()
table("pattern_rules", "ordinal, rule_id, account, name, type, deductible, dlimit, ref, note",
      [tuple(r[k] for k in ("ordinal", "rule_id", "account", "name", "type", "deductible", "limit", "ref", "note")) for r in _pr])
table("pattern_words", "ordinal, word, side, shift",
      [(r["ordinal"], w, r["direction"], r["shift"]) for r in _pr for w in r["words"]])
_d = lambda x: f"CAST({x} AS DOUBLE)"
cte("pattern_hit", f"""
SELECT t, direction, first(ordinal ORDER BY conf DESC, ordinal) AS ordinal,
  round(first(conf ORDER BY conf DESC, ordinal), 3) AS confidence
FROM (SELECT t, direction, ordinal, greatest({_d(.5)}, least({_d(.98)},
        least({_d(.95)}, {_d(.85)} + (count(*) - 1) * {_d(.03)}) + min(shift))) AS conf
      FROM cands JOIN pattern_words w ON contains(upper(trim(t)), word) AND (side = '' OR side = direction)
      GROUP BY 1, 2, 3) GROUP BY 1, 2""", "cands pattern_words")
_vendor = "CASE " + " ".join(f"WHEN contains(u, {q(a)}) THEN {q(v)}" for a, v in patterns.vendor_aliases()) + " END"
table("tiers", "tier, vendor, bound, account, name, confidence, note",
      [(i, r["vendor"], r["bound"], r["account"], r["name"], r["confidence"], r["note"])
       for i, r in enumerate(patterns.vendor_tiers())])
cte("vendors", f"SELECT t, direction, {_vendor} AS vendor FROM (SELECT *, upper(trim(t)) AS u FROM cands)", "cands")
cte("learned_hit", f"""
SELECT seq, arg_min(l.rule_id, (-length(pattern)) * 1000 + created_seq) AS rule_id, arg_min(l.pattern, (-length(pattern)) * 1000 + created_seq) AS pattern,
  arg_min(l.account_code, (-length(pattern)) * 1000 + created_seq) AS code, arg_min(l.account_name, (-length(pattern)) * 1000 + created_seq) AS name,
  arg_min(l.account_type, (-length(pattern)) * 1000 + created_seq) AS type, arg_min(l.confidence, (-length(pattern)) * 1000 + created_seq) AS confidence,
  min(l.times_confirmed) AS confirmed, min(l.times_applied) AS applied, min(tx.client_id) AS client_id
FROM tx JOIN learned l ON l.client_id = tx.client_id AND contains({ktext('tx.description')}, l.pattern)
  AND (l.side = '' OR l.side = tx.direction) GROUP BY seq""", "tx learned")
_insurer = has("upper(description)", cat.INSURER_WORDS)
table("pre_table", "flow, side, code, name, type, confidence, label, second",
      [tuple(r[k] for k in ("flow", "side", "code", "name", "type", "confidence", "label", "second"))
       for r in cat.pre_classes()])
table("fb_table", "step, side, code, name, confidence, lines, bare",
      [(i, s["side"], s["code"], s["name"], s["confidence"], " | ".join(s["evidence"]), not s["words"])
       for i, s in enumerate(cat.fallback_steps())])
FB = "CASE " + " ".join(
    f"WHEN direction = {q(s['side'])}" + (f" AND {has('upper(description)', s['words'])}" if s["words"] else "") + f" THEN {i}"
    for i, s in enumerate(cat.fallback_steps())) + " END"


def pylist(c: str) -> str:
    one = "CASE WHEN contains(t, '''') THEN '\"' || t || '\"' ELSE '''' || t || '''' END"
    return f"('[' || array_to_string(list_transform({c}, lambda t: {one}), ', ') || ']')"


cte("staged", f"""
SELECT n.*, f.inflow_type, f.flow_confidence, f.flow_evidence, s.source AS loan_source, s.principal, s.interest, s.fees,
  s.evidence AS loan_evidence, s.loan_type, p.code AS pre_code, p.name AS pre_name, p.type AS pre_type, p.confidence AS pre_conf, p.label, p.second,
  e1.rank AS r1, e2.rank AS r2, e3.rank AS r3, p1.ordinal AS o1, p2.ordinal AS o2, p3.ordinal AS o3,
  p1.confidence AS c1, p2.confidence AS c2, p3.confidence AS c3, v1.vendor AS v1, v2.vendor AS v2, v3.vendor AS v3, {FB.replace("direction =", "n.direction =")} AS fb
FROM norm n JOIN flow f USING (seq) LEFT JOIN split s USING (seq)
LEFT JOIN pre_table p ON p.side = n.direction AND p.flow = CASE WHEN f.inflow_type = 'REFUND' AND n.direction = 'CREDIT' AND {_insurer} THEN 'INSURER REFUND' ELSE f.inflow_type END
LEFT JOIN exact_hit e1 ON e1.t = n.description AND e1.direction = n.direction
LEFT JOIN exact_hit e2 ON e2.t = n.merchant_clean AND e2.direction = n.direction
LEFT JOIN exact_hit e3 ON e3.t = n.canonical AND e3.direction = n.direction
LEFT JOIN pattern_hit p1 ON p1.t = n.description AND p1.direction = n.direction
LEFT JOIN pattern_hit p2 ON p2.t = n.merchant_clean AND p2.direction = n.direction
LEFT JOIN pattern_hit p3 ON p3.t = n.canonical AND p3.direction = n.direction
LEFT JOIN vendors v1 ON v1.t = n.description AND v1.direction = n.direction
LEFT JOIN vendors v2 ON v2.t = n.merchant_clean AND v2.direction = n.direction
LEFT JOIN vendors v3 ON v3.t = n.canonical AND v3.direction = n.direction""",
    "norm flow split pre_table exact_hit pattern_hit vendors")


def _tier(v: str) -> str:
    return ("CASE " + " ".join(
        f"WHEN {v} = {q(r['vendor'])} AND amount > 0 AND amount <= {r['bound']} THEN {i}"
        for i, r in enumerate(patterns.vendor_tiers())) + " END")


def _decided(threshold: float, mode: str) -> str:
    conf0 = ("CASE layer WHEN 'pre_classifier' THEN pre_conf WHEN 'loan_splitter' THEN " + q(0.95) +
             " WHEN 'exact_match' THEN " + q(0.99) + " WHEN 'learned_match' THEN l.confidence "
             "WHEN 'pattern_match' THEN pconf ELSE fbt.confidence END")
    return f"""
SELECT *, CASE WHEN boost > 0 THEN least({q(0.99)}, conf0 + boost) ELSE conf0 END AS confidence,
  scored AND (CASE WHEN boost > 0 THEN least({q(0.99)}, conf0 + boost) ELSE conf0 END) < {q(threshold)} AS below
FROM (SELECT *, CASE WHEN scored THEN {q(0.0)} + CASE WHEN alias_matched OR client_matched THEN {q(0.05)} ELSE {q(0.0)} END
    + CASE WHEN inflow_type = 'REVENUE' AND type = 'REVENUE' THEN {q(0.05)} WHEN inflow_type = 'OUTFLOW' AND type IN ('EXPENSE', 'COGS') THEN {q(0.03)} ELSE {q(0.0)} END
    + CASE WHEN (direction = 'CREDIT' AND type = 'REVENUE') OR (direction = 'DEBIT' AND type IN ('EXPENSE', 'COGS')) THEN {q(0.03)} ELSE {q(0.0)} END ELSE {q(0.0)} END AS boost
  FROM (SELECT z.* EXCLUDE (pconf), l.rule_id AS l_rule, l.pattern AS l_pattern, l.confirmed AS l_confirmed, l.applied AS l_applied, l.name AS l_name, l.code AS l_code,
    er.keyword AS e_keyword, er.note AS e_note, pr.note AS p_note, ti.note AS t_note, pconf, fbt.lines AS fb_lines, fbt.bare AS fb_bare,
    layer IN ('exact_match', 'learned_match', 'pattern_match') AS scored, {conf0} AS conf0,
    CASE layer WHEN 'pre_classifier' THEN pre_code WHEN 'loan_splitter' THEN '2300' WHEN 'exact_match' THEN er.account WHEN 'learned_match' THEN l.code WHEN 'pattern_match' THEN coalesce(pr.account, ti.account) ELSE fbt.code END AS code,
    CASE layer WHEN 'pre_classifier' THEN pre_name WHEN 'loan_splitter' THEN 'Loan Payable' WHEN 'exact_match' THEN er.name WHEN 'learned_match' THEN l.name WHEN 'pattern_match' THEN coalesce(pr.name, ti.name) ELSE fbt.name END AS name,
    CASE layer WHEN 'pre_classifier' THEN pre_type WHEN 'loan_splitter' THEN 'LIABILITY' WHEN 'exact_match' THEN er.type WHEN 'learned_match' THEN l.type WHEN 'pattern_match' THEN coalesce(pr.type, 'EXPENSE') WHEN 'uncategorized' THEN CASE WHEN direction = 'CREDIT' THEN 'REVENUE' ELSE 'EXPENSE' END END AS type,
    CASE layer WHEN 'exact_match' THEN er.keyword WHEN 'learned_match' THEN l.rule_id WHEN 'pattern_match' THEN coalesce(pr.rule_id, 'HEURISTIC_' || ti.vendor) ELSE '' END AS rule_id,
    CASE layer WHEN 'exact_match' THEN er.deductible WHEN 'learned_match' THEN TRUE WHEN 'pattern_match' THEN coalesce(pr.deductible, TRUE) ELSE FALSE END AS deductible,
    CASE layer WHEN 'pattern_match' THEN pr.dlimit END AS dlimit,
    CASE layer WHEN 'exact_match' THEN er.ref WHEN 'pattern_match' THEN coalesce(pr.ref, '') ELSE '' END AS ref,
    list_filter(tokens, lambda t: contains(upper(description), upper(t))) AS mtokens
  FROM (SELECT *, CASE WHEN pre_code IS NOT NULL THEN 'pre_classifier' WHEN loan_source IS NOT NULL THEN 'loan_splitter'
      WHEN erank IS NOT NULL THEN 'exact_match' WHEN has_learned THEN 'learned_match' WHEN po IS NOT NULL OR pt IS NOT NULL THEN 'pattern_match' ELSE 'uncategorized' END AS layer
    FROM (SELECT s.*, coalesce(r1, r2, r3) AS erank, CASE WHEN r1 IS NOT NULL THEN description WHEN r2 IS NOT NULL THEN merchant_clean ELSE canonical END AS etext,
      lh.seq IS NOT NULL AS has_learned,
      CASE WHEN o1 IS NOT NULL THEN o1 WHEN t1 IS NOT NULL THEN NULL WHEN o2 IS NOT NULL THEN o2 WHEN t2 IS NOT NULL THEN NULL ELSE o3 END AS po,
      CASE WHEN o1 IS NOT NULL THEN NULL WHEN t1 IS NOT NULL THEN t1 WHEN o2 IS NOT NULL THEN NULL WHEN t2 IS NOT NULL THEN t2 WHEN o3 IS NOT NULL THEN NULL ELSE t3 END AS pt,
      CASE WHEN o1 IS NOT NULL OR t1 IS NOT NULL THEN description WHEN o2 IS NOT NULL OR t2 IS NOT NULL THEN merchant_clean ELSE canonical END AS ptext,
      CASE WHEN o1 IS NOT NULL THEN c1 WHEN t1 IS NOT NULL THEN tc1.confidence WHEN o2 IS NOT NULL THEN c2 WHEN t2 IS NOT NULL THEN tc2.confidence WHEN o3 IS NOT NULL THEN c3 ELSE tc3.confidence END AS pconf
      FROM (SELECT *, {_tier('v1')} AS t1, {_tier('v2')} AS t2, {_tier('v3')} AS t3 FROM staged) s
      LEFT JOIN learned_hit lh USING (seq) LEFT JOIN tiers tc1 ON tc1.tier = t1 LEFT JOIN tiers tc2 ON tc2.tier = t2 LEFT JOIN tiers tc3 ON tc3.tier = t3)) z
  LEFT JOIN exact_rules er ON er.rank = erank LEFT JOIN learned_hit l ON l.seq = z.seq LEFT JOIN pattern_rules pr ON pr.ordinal = po
  LEFT JOIN tiers ti ON ti.tier = pt LEFT JOIN fb_table fbt ON fbt.step = fb))"""


_cat_deps = "staged learned_hit tiers exact_rules pattern_rules fb_table"
cte("decided", _decided(0.70, "full"), _cat_deps)
cte("decided_strict", _decided(0.90, "categorize"), _cat_deps)
table("chart", "code, acct_name, acct_type, side, tax_line",
      [(a["code"], a["name"], a["type"], a["normal_balance"], a["tax_line"]) for a in accounts.chart()])


def categorized(src: str, threshold: str, mode: str) -> str:
    note = "CASE layer WHEN 'exact_match' THEN nullif(e_note, '') WHEN 'pattern_match' THEN nullif(coalesce(p_note, t_note), '') WHEN 'uncategorized' THEN 'Fallback classification to ' || code || ' ' || name || '. CPA review required.' END"
    unclear = "(direction = 'CREDIT' AND inflow_type = 'UNKNOWN')"
    flag = f"CASE WHEN layer = 'exact_match' AND e_note <> '' THEN 'EXACT_MATCH_NOTE' WHEN layer = 'pattern_match' AND coalesce(p_note, t_note) <> '' THEN 'PATTERN_NOTE' WHEN layer = 'uncategorized' THEN 'LOW_CONFIDENCE_CATEGORY' END"
    evidence = f"""CASE layer WHEN 'pre_classifier' THEN ['Pre-classified as ' || label || ' (' || flow_evidence || ')', second]
      WHEN 'loan_splitter' THEN ['Loan payment routed by LoanSplitter (source: ' || loan_source || ')', 'Principal: ' || principal || ', Interest: ' || interest]
      WHEN 'exact_match' THEN ['Exact match rule ''' || e_keyword || '''', 'Matched text: ' || etext, 'Merchant: ' || canonical, 'Confidence: 0.99']
      WHEN 'learned_match' THEN ['Learned match: ''' || l_pattern || ''' → ' || l_code || ' ' || l_name || ' (confirmed ' || l_confirmed || 'x, source: human_override)', 'Merchant: ' || canonical]
      WHEN 'pattern_match' THEN ['Pattern match rule ''' || rule_id || '''', 'Matched text: ' || ptext, 'Matched tokens: ' || {pylist('mtokens')}, 'Merchant: ' || canonical, 'Confidence: ' || pconf]
      ELSE CASE WHEN fb_bare THEN [fb_lines, 'Merchant: ' || canonical, 'Tokens: ' || {pylist('tokens')}] ELSE [fb_lines, 'Merchant: ' || canonical] END END"""
    signals = compact(
        ("alias_matched OR client_matched", "'known_vendor:' || canonical"),
        ("inflow_type = 'REVENUE' AND type = 'REVENUE'", "'inflow_confirms_revenue'"),
        ("inflow_type = 'OUTFLOW' AND type IN ('EXPENSE', 'COGS')", "'outflow_confirms_expense'"),
        ("direction = 'CREDIT' AND type = 'REVENUE'", "'direction_confirms_credit_revenue'"),
        ("direction = 'DEBIT' AND type IN ('EXPENSE', 'COGS')", "'direction_confirms_debit_expense'"))
    extra = compact(("scored AND code = '6150'", "'Meals: 50% deductible per IRC Section 274'"),
                    ("boost > 0", f"'Multi-signal boost +' || printf('%.2f', boost) || ': ' || array_to_string({signals}, ', ')"))
    low = f"'Confidence ' || printf('%.0f', confidence * 100) || '% is below {threshold}% threshold for mode ''{mode}''. Queued for human review.'"
    return f"""
SELECT d.*, CASE WHEN scored THEN coalesce(chart.tax_line, '') ELSE '' END AS tax_line,
  CASE WHEN scored AND d.code = '6150' THEN {q(0.5)} ELSE dlimit END AS deduction_limit,
  CASE WHEN scored AND d.code = '6150' THEN '0.50' ELSE '1.00' END AS deductible_pct,
  {unclear} OR below OR layer = 'uncategorized' AS required_review,
  {compact(("loan_source = 'estimated'", "'LOAN_ESTIMATED_SPLIT'"), (unclear, "'INFLOW_UNCLASSIFIED'"), ("TRUE", flag), ("below", "'BELOW_THRESHOLD'"))} AS flags,
  {compact(("loan_source = 'estimated'", "loan_evidence"), (unclear, "flow_evidence"), (f"({flag}) IS NOT NULL", note), ("below", low))} AS notes,
  list_concat({evidence}, {extra}) AS evidence
FROM {src} d LEFT JOIN (SELECT code AS chart_code, tax_line FROM chart) chart ON chart_code = d.code"""


cte("cat", categorized("decided", "70", "full"), "decided chart")
cte("cat_strict", categorized("decided_strict", "90", "categorize"), "decided_strict chart")

# --- capital purchases ------------------------------------------------------

_cls = [(w, c) for c in capex.classes() for w in c["words"]]
def asset(field: str, t: str = "upper(description)") -> str:
    return "CASE " + " ".join(
        f"WHEN contains({t}, {q(w)}) THEN {q(w if field == 'keyword' else c[field])}" for w, c in _cls) + " END"
EXCL = has("upper(description)", capex.exclusions())
_known = ", ".join(q(c) for c in capex.KNOWN_CODES)
cte("cap", f"""
SELECT * EXCLUDE (code, name, type, flags, notes), coalesce(kind = 'capex', FALSE) AS is_capex, coalesce(kind = 'de_minimis', FALSE) AS de_minimis,
  CASE WHEN kind = 'capex' THEN cls ELSE '' END AS cls_out,
  CASE WHEN kind = 'capex' THEN '1500' ELSE code END AS code, CASE WHEN kind = 'capex' THEN 'ASSET' ELSE type END AS type,
  CASE WHEN kind = 'capex' THEN 'Fixed Assets - ' || upper(substr(cls,1,1)) || substr(cls,2) ELSE name END AS name,
  CASE WHEN kind = 'capex' THEN list_append(flags, 'CAPEX_DETECTED') WHEN kind = 'large' THEN list_append(flags, 'LARGE_EXPENSE_REVIEW') ELSE flags END AS flags,
  CASE WHEN kind = 'capex' THEN list_append(notes, 'Route to Fixed Assets (' || {asset('property_class')} || '). CPA to evaluate: Section 179 election, Bonus Depreciation (168(k)), or standard MACRS over ' || {asset('life')} || ' years. Ref: ' || {asset('ref')})
    WHEN kind = 'large' THEN list_append(notes, 'Expense of $' || amount || ' exceeds $10,000 and is not a routine category. Verify this is not a capital expenditure that should be depreciated.') ELSE notes END AS notes
FROM (SELECT *, CASE WHEN NOT tried THEN NULL WHEN cls IS NULL AND amount > 10000 AND code NOT IN ({_known}) THEN 'large'
    WHEN cls IS NULL THEN NULL WHEN amount <= 2500 THEN 'de_minimis' ELSE 'capex' END AS kind
  FROM (SELECT *, direction = 'DEBIT' AND type IN ('EXPENSE', 'COGS') AND NOT {EXCL} AS tried, {asset('name')} AS cls FROM cat))""", "cat")

# --- ledger -----------------------------------------------------------------

cte("branch", """
SELECT *, CASE WHEN type IN ('EXPENSE', 'COGS') AND direction = 'DEBIT' THEN 'out'
    WHEN type = 'REVENUE' AND direction = 'CREDIT' THEN 'in'
    WHEN type = 'LIABILITY' AND direction = 'DEBIT' AND interest IS NOT NULL THEN CASE WHEN coalesce(fees, 0) > 0 THEN 'split4' ELSE 'split3' END
    WHEN type = 'LIABILITY' AND direction = 'DEBIT' THEN 'unsplit' WHEN code = '3100' THEN 'draw' WHEN code = '3200' THEN 'contrib'
    WHEN direction = 'DEBIT' THEN 'out' ELSE 'in' END AS branch,
  CASE WHEN loan_source = 'estimated' THEN ' (ESTIMATED)' ELSE '' END AS tag, substr(md5(transaction_id), 1, 8) AS entry_id
FROM cap""", "cap")
_side = "1 AS line, code AS account, name AS account_name, amount AS debit, CAST(0 AS DECIMAL(18,2)) AS credit"
_cash = "'1000', 'Checking Account'"
_z = "CAST(0 AS DECIMAL(18,2))"
_own_flag = "'NOT TAX DEDUCTIBLE — reduces equity'"
_unsplit = "'Unsplit loan payment — principal/interest unknown. Full amount to liability. Interest portion NOT on P&L.'"
cte("lines", f"""
SELECT batch_id, seq, transaction_id, entry_id, date, {_side}, description AS memo, CASE branch WHEN 'unsplit' THEN {_unsplit} ELSE '' END AS flag FROM branch WHERE branch IN ('out', 'unsplit')
UNION ALL SELECT batch_id, seq, transaction_id, entry_id, date, 2, {_cash}, {_z}, amount, description, '' FROM branch WHERE branch IN ('out', 'unsplit')
UNION ALL SELECT batch_id, seq, transaction_id, entry_id, date, 1, {_cash}, amount, {_z}, description, '' FROM branch WHERE branch = 'in'
UNION ALL SELECT batch_id, seq, transaction_id, entry_id, date, 2, code, name, {_z}, amount, description, '' FROM branch WHERE branch = 'in'
UNION ALL SELECT batch_id, seq, transaction_id, entry_id, date, 1, code, name, principal, {_z}, 'Loan principal' || tag || ' - ' || description, '' FROM branch WHERE branch IN ('split3', 'split4')
UNION ALL SELECT batch_id, seq, transaction_id, entry_id, date, 2, '6700', 'Interest Expense', interest, {_z}, 'Loan interest' || tag || ' - ' || description, '' FROM branch WHERE branch IN ('split3', 'split4')
UNION ALL SELECT batch_id, seq, transaction_id, entry_id, date, 3, '6300', 'Bank Service Charges', fees, {_z}, 'Loan fee - ' || description, '' FROM branch WHERE branch = 'split4'
UNION ALL SELECT batch_id, seq, transaction_id, entry_id, date, CASE branch WHEN 'split4' THEN 4 ELSE 3 END, {_cash}, {_z}, amount, description, '' FROM branch WHERE branch IN ('split3', 'split4')
UNION ALL SELECT batch_id, seq, transaction_id, entry_id, date, 1, '3100', 'Owner''s Draw', amount, {_z}, 'Owner distribution', {_own_flag} FROM branch WHERE branch = 'draw'
UNION ALL SELECT batch_id, seq, transaction_id, entry_id, date, 2, {_cash}, {_z}, amount, 'Owner distribution', '' FROM branch WHERE branch = 'draw'
UNION ALL SELECT batch_id, seq, transaction_id, entry_id, date, 1, {_cash}, amount, {_z}, 'Owner contribution', '' FROM branch WHERE branch = 'contrib'
UNION ALL SELECT batch_id, seq, transaction_id, entry_id, date, 2, '3200', 'Owner''s Contributions', {_z}, amount, 'Owner contribution', '' FROM branch WHERE branch = 'contrib'""", "branch")
cte("entries", f"""
SELECT seq, {msum('debit')} AS debits, {msum('credit')} AS credits, sum(debit) = sum(credit) AS balanced,
  max(account) FILTER (WHERE line = 1) AS debit_account, max(account) FILTER (WHERE line = 2) AS credit_account FROM lines GROUP BY seq""", "lines")
cte("posted", """
SELECT c.* EXCLUDE (flags, notes), e.debits, e.credits, e.balanced, e.debit_account, e.credit_account,
  CASE WHEN NOT e.balanced THEN list_append(flags, 'UNBALANCED_ENTRY') ELSE flags END AS flags,
  CASE WHEN NOT e.balanced THEN list_append(notes, 'JE ' || entry_id || ' debits=' || e.debits || ' credits=' || e.credits) ELSE notes END AS notes
FROM branch c JOIN entries e USING (seq)""", "branch entries")
cte("tb", f"""
SELECT l.batch_id, l.account AS code, first(l.account_name ORDER BY l.seq, l.line) AS name, {msum('l.debit')} AS total_debit, {msum('l.credit')} AS total_credit,
  coalesce(min(chart.acct_type), 'UNKNOWN') AS type, coalesce(min(chart.side), 'DEBIT') AS normal_balance,
  {m('coalesce(sum(l.debit), 0) - coalesce(sum(l.credit), 0)')} AS net
FROM lines l LEFT JOIN chart ON chart.code = l.account GROUP BY 1, 2""", "lines chart")
cte("tbt", f"""
SELECT batch_id, {msum('total_debit')} AS total_debits, {msum('total_credit')} AS total_credits, count(*) AS account_count,
  {m('sum(total_debit) - sum(total_credit)')} AS difference, sum(total_debit) = sum(total_credit) AS is_balanced FROM tb GROUP BY batch_id""", "tb")

# --- flags ------------------------------------------------------------------

_U = "upper(description)"
FLAG_COND = {
    "MEALS_OVER_75": "code = '6150' AND amount > 75",
    "LARGE_CASH_WITHDRAWAL": f"{has(_U, ['ATM', 'CASH'])} AND amount > 500",
    "CASH_NEAR_10K": f"amount >= 8000 AND amount <= 10000 AND {has(_U, ['CASH', 'DEPOSIT', 'WITHDRAWAL'])}",
    "ROUND_NUMBER_SUSPICIOUS": "direction = 'DEBIT' AND amount IN (500, 1000, 2500, 5000, 10000)",
    "PERSONAL_EXPENSE_MIXED": has(_U, flags.PERSONAL),
    "POSSIBLE_CAPITAL_EXPENSE": "amount > 2500 AND type = 'EXPENSE' AND direction = 'DEBIT'",
    "LOAN_PAYMENT_DETECTED": "code IN ('2300', '2400')",
    "AMBIGUOUS_VENDOR": has(_U, flags.BROAD_VENDORS),
}
_msg = {r["flag"]: r["message"] for r in flags.rules()}
_flag_pairs = [("mismatch", "BALANCE_MISMATCH"), *[(f"({c})", f) for f, c in FLAG_COND.items()], ("dup >= 2", "DUPLICATE_TRANSACTION")]
cte("flagged", f"""
SELECT * EXCLUDE (flags, notes, mismatch, dup), list_concat(flags, {compact(*[(c, q(f)) for c, f in _flag_pairs])}) AS flags,
  list_concat(notes, {compact(*[(c, q(_msg[f])) for c, f in _flag_pairs])}) AS notes
FROM (SELECT p.*, coalesce(b.beginning_balance + t.net_change <> b.ending_balance, FALSE) AS mismatch,
    count(*) OVER (PARTITION BY p.batch_id, p.date, p.amount, p.direction) AS dup
  FROM posted p JOIN batches b USING (batch_id) JOIN totals t ON t.batch_id = p.batch_id)""", "posted batches totals")
_sev = "CASE flag " + " ".join(f"WHEN {q(r['flag'])} THEN {q(r['severity'])}" for r in flags.rules()) + " ELSE 'LOW' END"
_dash = "CASE flag " + " ".join(f"WHEN {q(f)} THEN {q(s)}" for f, s in {
    **{r["flag"]: r["severity"] for r in flags.rules()}, **flags.DASHBOARD_EXTRA}.items()) + " ELSE 'LOW' END"
cte("flag_items", f"SELECT batch_id, seq, flag, {_sev} AS severity, {_dash} AS dashboard FROM (SELECT batch_id, seq, unnest(flags) AS flag FROM flagged)", "flagged")
cte("flag_summary", """
SELECT f.batch_id, CAST(sum(len(flags)) AS BIGINT) AS total_flags, count(*) FILTER (WHERE len(flags) > 0) AS flagged_transactions,
  count(*) FILTER (WHERE worst = 0) AS critical, count(*) FILTER (WHERE worst = 1) AS high, count(*) FILTER (WHERE worst = 2) AS medium, count(*) FILTER (WHERE worst = 3) AS low
FROM flagged f LEFT JOIN (SELECT seq, min(CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END) AS worst FROM flag_items GROUP BY seq) w USING (seq)
GROUP BY 1""", "flagged flag_items")

# --- reconciliation and checks ----------------------------------------------

cte("dups", "SELECT batch_id, CAST(sum(n - 1) AS BIGINT) AS duplicate_count FROM (SELECT batch_id, count(*) AS n FROM tx GROUP BY batch_id, date, amount, direction, substr(description, 1, 20)) GROUP BY 1", "tx")
cte("recon", f"""
SELECT *, {compact(('NOT known', q(rec.NO_BALANCES)),
    ("known AND difference <> 0 AND abs(difference) <= 0.10", "'Minor difference of $' || abs(difference) || ' (within $0.10 tolerance). Likely rounding or pending transaction.'"),
    ("known AND abs(difference) > 0.10", "'Reconciliation failed: difference of $' || abs(difference) || '. Computed ending: $' || computed || ', stated ending: $' || ending_balance || '.'"),
    ("known AND duplicate_count > 0", "duplicate_count || ' possible duplicate transaction(s) detected. This may cause reconciliation mismatch.'"))} AS issues,
  {compact(('NOT known', q(rec.ASK_SUMMARY)),
    ("known AND difference > 0.10", "'Computed ending exceeds stated by $' || abs(difference) || " + q(rec.TOO_HIGH)),
    ("known AND difference < -0.10", "'Computed ending is less than stated by $' || abs(difference) || " + q(rec.TOO_LOW)),
    ("known AND abs(difference) > 0.10", q(rec.VERIFY)))} AS advice,
  CASE WHEN NOT known THEN 'YELLOW' WHEN difference = 0 THEN 'GREEN' WHEN abs(difference) <= 0.10 THEN 'YELLOW' ELSE 'RED' END AS status
FROM (SELECT b.batch_id, b.beginning_balance, b.ending_balance, t.total_credits, t.total_debits, t.net_change, t.transaction_count, d.duplicate_count,
    b.ending_balance IS NOT NULL AS known, CASE WHEN b.ending_balance IS NOT NULL THEN {m('b.beginning_balance + t.net_change')} END AS computed,
    {m('b.beginning_balance + t.net_change - b.ending_balance')} AS difference
  FROM batches b JOIN totals t USING (batch_id) JOIN dups d USING (batch_id))""", "batches totals dups")
_checks = [
    ("structural", "CRITICAL", "UNBALANCED_JE", "NOT balanced", "'Journal entry ' || entry_id || ' is unbalanced: debits=' || debits || ' credits=' || credits"),
    ("structural", "MEDIUM", "ZERO_AMOUNT", "amount = 0", "'Transaction has zero amount: ''' || description || ''''"),
    ("semantic", "HIGH", "CREDIT_TO_EXPENSE", "direction = 'CREDIT' AND type = 'EXPENSE'", "'Credit (deposit) posted to expense account ' || code || '. ''' || description || ''' — likely should be revenue or refund.'"),
    ("semantic", "HIGH", "LOAN_AS_EXPENSE", f"type = 'EXPENSE' AND {has(_U, ['LOAN', 'SBA', 'NOTE PAYMENT'])}", "'Loan payment ''' || description || ''' posted as expense. Principal portion should reduce liability, not hit P&L.'"),
    ("semantic", "MEDIUM", "LARGE_UNVERIFIED_REVENUE", "direction = 'CREDIT' AND amount >= 5000 AND inflow_type IN ('UNKNOWN', '') AND type = 'REVENUE'", "'Large deposit $' || amount || ' classified as revenue without inflow verification. ''' || description || ''''"),
    ("semantic", "HIGH", "DRAW_AS_EXPENSE", f"type = 'EXPENSE' AND {has(_U, ['OWNER DRAW', 'OWNER DISTRIBUTION', 'PERSONAL'])}", "'Possible owner draw ''' || description || ''' classified as expense. Owner draws are equity reductions, NOT deductible expenses.'"),
    ("semantic", "MEDIUM", "MEALS_FULL_DEDUCTION", "code = '6150' AND deductible_pct = '1.00'", "'Meals expense ''' || description || ''' at 100% deduction. IRS limits most business meals to 50% deductible.'"),
    ("semantic", "HIGH", "CAPEX_AS_EXPENSE", f"amount > 2500 AND type = 'EXPENSE' AND NOT is_capex AND {has(_U, ['VEHICLE', 'EQUIPMENT', 'MACHINERY', 'COMPUTER', 'LAPTOP'])}", "'$' || amount || ' purchase ''' || description || ''' may be a capital expenditure that should be depreciated, not immediately expensed.'"),
]
cte("row_issues", " UNION ALL ".join(
    f"SELECT batch_id, transaction_id, {q(c)} AS category, {q(s)} AS severity, {q(code)} AS code, {msg} AS message FROM posted WHERE {cond}"
    for c, s, code, cond, msg in _checks), "posted")
cte("counts", """
SELECT batch_id, count(*) AS n, count(*) FILTER (WHERE layer = 'uncategorized') AS uncategorized, count(*) FILTER (WHERE NOT balanced) AS unbalanced,
  count(*) FILTER (WHERE type = 'COGS') AS cogs_rows, count(*) FILTER (WHERE confidence < CAST(0.7 AS DOUBLE)) AS low_confidence, count(*) FILTER (WHERE required_review) AS must_review
FROM posted GROUP BY 1""", "posted")
cte("issues", """
SELECT * FROM row_issues
UNION ALL SELECT batch_id, '', 'structural', 'CRITICAL', 'TB_UNBALANCED', 'Trial balance out of balance by $' || difference || '. Total debits != total credits.' FROM tbt WHERE NOT is_balanced
UNION ALL SELECT batch_id, '', 'structural', 'CRITICAL', 'RECONCILIATION_FAILED', 'Bank reconciliation failed. Difference: $' || difference || '. Issues: ' || array_to_string(issues, '; ') FROM recon WHERE status = 'RED'
UNION ALL SELECT batch_id, '', 'structural', 'MEDIUM', 'RECONCILIATION_WARN', 'Bank reconciliation has warnings: ' || array_to_string(issues, '; ') FROM recon WHERE status = 'YELLOW' AND len(issues) > 0
UNION ALL SELECT batch_id, '', 'semantic', 'MEDIUM', 'UNCATEGORIZED_REMAINING', uncategorized || ' transaction(s) remain uncategorized. These require manual review before the analysis is complete.' FROM counts WHERE uncategorized > 0""", "row_issues tbt recon counts")
cte("validation", """
SELECT b.batch_id, count(i.code) FILTER (WHERE category = 'structural') AS structural_issues, count(i.code) FILTER (WHERE category = 'semantic') AS semantic_issues,
  count(i.code) FILTER (WHERE severity = 'CRITICAL') AS critical_count, count(i.code) FILTER (WHERE category = 'structural' AND severity = 'CRITICAL') AS structural_critical,
  count(i.code) FILTER (WHERE category = 'semantic' AND severity = 'CRITICAL') AS semantic_critical
FROM batches b LEFT JOIN issues i USING (batch_id) GROUP BY 1""", "batches issues")
cte("gates", f"""
SELECT c.batch_id, {compact(('unbalanced > 0', "unbalanced || ' unbalanced journal entries'"), ('NOT is_balanced', "'Trial balance out of balance by $' || t.difference"))} AS arithmetic,
  {compact(("status = 'RED'", "'Bank reconciliation RED: diff=$' || r.difference"), ('structural_critical > 0', "structural_critical || ' critical structural validation failure(s)'"))} AS structural,
  {compact(('cogs_rows > 0', "'COGS present — labeled as bank-proxy unless inventory values provided'"))} AS disclosure,
  {compact(('low_confidence > 0', "low_confidence || ' transaction(s) below 70% confidence'"), ('uncategorized > 0', "uncategorized || ' uncategorized transaction(s)'"), ('must_review > 0', "must_review || ' transaction(s) require human review'"))} AS review
FROM counts c JOIN tbt t USING (batch_id) JOIN recon r USING (batch_id) JOIN validation v USING (batch_id)""", "counts tbt recon validation")
