"""SQL for each registered query, written from the operator rules."""

from __future__ import annotations

from bookloom.operators import categorize as cat_rules
from bookloom.operators import pnl as pnl_rules
from bookloom.operators import statements as st
from bookloom.rules import (accounts, declarative, detectors, flags, flows, keywords, labelled,
                            loans, merchants)
from bookloom.sources import derive
from bookloom.sources import statements as readers
from oracle.base import *  # noqa: F403
from oracle.base import CTES, EXCL, FB, FLAG_COND, _cls, _dec, _own_case, _tier

ORACLES: dict[str, str] = {}
#: Select and needed CTEs of each, for statements made of several.
SELECTS: dict[str, tuple[str, str]] = {}


def o(name: str, select: str, needs: str = "") -> None:
    ORACLES[name] = build(select, needs)
    SELECTS[name] = (select, needs)


U = "upper(description)"

# --- sources ----------------------------------------------------------------

_all = derive.CREDIT_TEXTS + derive.DEBIT_TEXTS
_alll = "[" + ", ".join(q(x) for x in _all) + "]"
_N = len(_all)
_c = "CAST(round(o_totalprice * 100) AS BIGINT)"
cte("olines", f"""
SELECT o_orderkey AS o, i, {_c} AS cents, strftime(o_orderdate + to_days(CAST(i AS INT)), '%m/%d') AS md,
  strftime(o_orderdate + to_days(CAST(i AS INT)), '%m/%d/%Y') AS mdy, strftime(o_orderdate + to_days(CAST(i AS INT)), '%Y-%m-%d') AS iso,
  ({_alll})[((o_orderkey + i * 13) % {_N}) + 1] AS t, {_dec(f'({_c} + i * 977) % 500000 + 1')} AS amt, {_dec(f'({_c} + i * 977) % 500000')} AS amt0
FROM orders, range(0, 7) r(i) WHERE i <= o_orderkey % 7""")
cte("stext", f"""
SELECT 's' || o_orderkey AS source_id, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE 'FIRST EXAMPLE BANK' || chr(10) || 'Account #: ****' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')
   || chr(10) || 'Statement Period: ' || strftime(o_orderdate, '%B %-d') || ' - ' || strftime(o_orderdate + to_days(27), '%B %-d, %Y') || chr(10) || 'Beginning Balance: $' || {_dec(f'{_c} % 900000')} || chr(10) END
  || l.body || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE chr(10) || 'Ending Balance: $' || {_dec(f'({_c} * 3) % 900000')} || chr(10) END AS text
FROM orders JOIN (SELECT o, string_agg(CASE WHEN i % 2 = 0 THEN mdy ELSE md END || '  ' || t || '   ' || CASE (o + i) % 3 WHEN 0 THEN '' WHEN 1 THEN '-' ELSE '-$' END || amt, chr(10) ORDER BY i) AS body FROM olines GROUP BY o) l ON l.o = o_orderkey""", "olines")
o("source_fingerprint", "SELECT source_id, sha256(text) AS source_hash FROM stext", "stext")


def amount_of(x: str) -> str:
    plain = f"regexp_replace(trim({x}), '[$, ]', '', 'g')"
    return f"TRY_CAST(regexp_replace({plain}, '^\\((.*)\\)$', '-\\1') AS DECIMAL(18,2))"


_iso_y = derive.DEFAULT_YEAR


def iso_of(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '^\\d+/\\d+$') THEN strftime(strptime({x} || '/{_iso_y}', '%m/%d/%Y'), '%Y-%m-%d') "
            f"ELSE strftime(strptime({x}, '%m/%d/%Y'), '%Y-%m-%d') END")


o("text_scan", f"""
SELECT source_id, pos - 1 AS line_no, {iso_of("regexp_extract(hit, p, 1)")} AS date, trim(regexp_extract(hit, p, 2)) AS description,
  CAST(abs({amount_of('regexp_extract(hit, p, 3)')}) AS VARCHAR) AS amount, CASE WHEN {amount_of('regexp_extract(hit, p, 3)')} >= 0 THEN 'CREDIT' ELSE 'DEBIT' END AS direction
FROM (SELECT source_id, unnest(h) AS hit, unnest(range(1, len(h) + 1)) AS pos, {q('(?m)' + readers.LINE)} AS p
  FROM (SELECT source_id, regexp_extract_all(text, {q('(?m)' + readers.LINE)}) AS h FROM stext))
WHERE {amount_of('regexp_extract(hit, p, 3)')} IS NOT NULL AND trim(regexp_extract(hit, p, 2)) <> ''""", "stext")


def found(p: str, g: int = 1) -> str:
    return f"nullif(trim(regexp_extract(lower(text), {q(p)}, {g})), '')"


o("statement_metadata", f"""
SELECT source_id, CAST({amount_of(found(readers.OPENING))} AS VARCHAR) AS beginning_balance, CAST({amount_of(found(readers.CLOSING))} AS VARCHAR) AS ending_balance,
  {found(readers.PERIOD, 1)} AS period_start, {found(readers.PERIOD, 2)} AS period_end, {found(readers.LAST_FOUR)} AS account_last4 FROM stext""", "stext")
o("table_scan", """
SELECT 's' || o AS source_id, i AS line_no, iso AS date, t AS description, CAST(amt0 AS VARCHAR) AS amount,
  CASE WHEN (o + i) % 3 = 0 OR (amt0 = 0 AND o % 2 = 0) THEN 'CREDIT' ELSE 'DEBIT' END AS direction
FROM olines WHERE (o + i) % 11 <> 0 AND (o % 2 = 0 OR amt0 <> 0)""", "olines")
cte("csv", """
SELECT batch_id AS source_id, seq, lay, CASE lay WHEN 0 THEN us || ',"' || t || '",' || CASE WHEN cr THEN '' ELSE '-' END || money
  WHEN 1 THEN us || ';' || t || ';' || CASE WHEN cr THEN '' ELSE money END || ';' || CASE WHEN cr THEN money ELSE '' END
  WHEN 2 THEN us || chr(9) || t || chr(9) || CASE WHEN cr THEN '$' || money ELSE '($' || money || ')' END
  ELSE date || '|' || t || '|' || CASE WHEN cr THEN '' ELSE money END || '|' || CASE WHEN cr THEN money ELSE '' END END AS line
FROM (SELECT *, (client_id + CAST(substr(batch_id, length(batch_id) - 1) AS INT)) % 4 AS lay, direction = 'CREDIT' AS cr,
  strftime(CAST(date AS DATE), '%m/%d/%Y') AS us, CASE WHEN seq % 97 = 0 THEN '' ELSE description END AS t,
  CASE WHEN seq % 89 = 0 THEN 'n/a' ELSE CAST(amount AS VARCHAR) END AS money FROM tx)""", "tx")
_cells = "CASE lay WHEN 0 THEN string_split(line, ',') WHEN 1 THEN string_split(line, ';') WHEN 2 THEN string_split(line, chr(9)) ELSE string_split(line, '|') END"
o("delimited_scan", f"""
SELECT source_id, seq, CASE WHEN lay = 3 THEN c[1] ELSE strftime(strptime(c[1], '%m/%d/%Y'), '%Y-%m-%d') END AS date,
  trim(replace(c[2], '"', '')) AS description, CAST(abs(a) AS VARCHAR) AS amount, CASE WHEN a >= 0 THEN 'CREDIT' ELSE 'DEBIT' END AS direction
FROM (SELECT *, CASE WHEN lay IN (0, 2) THEN {amount_of('c[3]')} ELSE coalesce(nullif(abs({amount_of('c[4]')}), 0), -nullif(abs({amount_of('c[3]')}), 0)) END AS a
  FROM (SELECT source_id, seq, lay, {_cells} AS c FROM csv)) WHERE a IS NOT NULL AND trim(replace(c[2], '"', '')) <> ''""", "csv")
_raw = "CASE seq % 5 WHEN 0 THEN '($' || amount || ')' WHEN 1 THEN ' $ ' || amount WHEN 2 THEN '1,' || lpad(left(CAST(amount AS VARCHAR), 6), 6, '0') WHEN 3 THEN '-' || amount ELSE 'n/a' END"
o("parse_amount", f"""
SELECT seq, {_raw} AS raw, CAST(CASE seq % 5 WHEN 0 THEN -amount WHEN 1 THEN amount WHEN 2 THEN CAST('1' || lpad(left(CAST(amount AS VARCHAR), 6), 6, '0') AS DECIMAL(18,2)) WHEN 3 THEN -amount END AS VARCHAR) AS parsed FROM tx""", "tx")
o("parse_date", f"""
SELECT seq, CASE seq % 11 WHEN 0 THEN strftime(d, '%m/%d/%Y') WHEN 1 THEN strftime(d, '%-m-%-d-%y') WHEN 2 THEN strftime(d, '%m/%d') WHEN 3 THEN ' ' || date WHEN 4 THEN 'not a date'
    WHEN 5 THEN strftime(d, '%B %-d, %Y') WHEN 6 THEN strftime(d, '%-d %b %Y') WHEN 7 THEN date || 'T00:00:00' WHEN 8 THEN strftime(d, '%m.%d.%Y') WHEN 9 THEN strftime(d, '%Y%m%d')
    ELSE CASE WHEN day(d) > 12 THEN strftime(d, '%d/%m/%Y') ELSE strftime(d, '%m/%d/%Y') END END AS raw,
  CASE seq % 11 WHEN 2 THEN '{_iso_y}' || substr(date, 5) WHEN 4 THEN 'not a date' ELSE date END AS iso
FROM (SELECT *, CAST(date AS DATE) AS d FROM tx)""", "tx")


def light(c: str) -> str:
    out = f"upper(trim({c}))"
    for p in merchants.LIGHT_PREFIXES:
        out = f"(SELECT CASE WHEN starts_with(z, {q(p)}) THEN trim(substr(z, {len(p) + 1}), ' -#') ELSE z END FROM (SELECT {out} AS z))"
    for t in merchants.LIGHT_TAILS:
        out = f"regexp_replace({out}, {q(t)}, '')"
    return f"coalesce(nullif(trim({out}), ''), trim({c}))"


o("light_merchant", f"SELECT seq, {light('description')} AS merchant FROM tx", "tx")
o("cents_round", "SELECT seq, CAST(CAST((CAST(amount * 100 AS BIGINT) * 2 + 8) // 16 AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS VARCHAR) AS eighth FROM tx", "tx")
o("money_guard", r"""
SELECT seq, value, regexp_matches(value, '^-?\d+\.\d{2}$') AS valid FROM (SELECT seq,
  CASE seq % 3 WHEN 0 THEN CAST(amount AS VARCHAR) WHEN 1 THEN CAST(CAST(floor(amount) AS BIGINT) AS VARCHAR) ELSE '-' || amount END AS value FROM tx)""", "tx")
o("batch_totals", f"""
SELECT t.batch_id, {text('t.total_credits')} AS total_credits, {text('t.total_debits')} AS total_debits, t.transaction_count, {text('t.net_change')} AS net_change,
  r.flagged_count, r.review_queue_count FROM totals t JOIN (SELECT batch_id, count(*) FILTER (WHERE len(flags) > 0) AS flagged_count,
  count(*) FILTER (WHERE confidence < CAST(0.7 AS DOUBLE) OR len(flags) > 0 OR required_review) AS review_queue_count FROM posted GROUP BY 1) r USING (batch_id)""", "totals posted")

# --- documents --------------------------------------------------------------

_pad = lambda mult, w: f"lpad(CAST((doc_id * {mult} + 1234567) % {10 ** w} AS VARCHAR), {w}, '0')"
cte("texts", f"""
SELECT 'doc-' || doc_id AS source_id, 'documents' AS source, text || CASE WHEN doc_id % 3 = 0 THEN
  chr(10) || 'Name on file. SSN 123-45-' || lpad(CAST(doc_id % 9000 + 1000 AS VARCHAR), 4, '0') || ' card 4111 1111 1111 ' || {_pad(7919, 4)}
  || ' IBAN GB82WEST' || {_pad(104729, 7)} || {_pad(31, 7)} || chr(10) || 'Routing number: ' || {_pad(15485863, 9)} || chr(10) || 'Account no. ' || {_pad(32452843, 10)}
  || chr(10) || 'Call (212) 555-' || {_pad(13, 4)} || ' or mail user' || doc_id || '@mail.example.com, 12' || (doc_id % 10) || ' Old Oak Street, Springfield'
  || chr(10) || 'DOB: 0' || (doc_id % 9 + 1) || '/15/1980 from 10.0.' || (doc_id % 256) || '.' || (doc_id % 100) ELSE '' END AS text FROM documents
UNION ALL SELECT 'page-' || page_id, 'pages', html FROM pages
UNION ALL SELECT 'turn-' || conv_id || '-' || turn, 'conversations', text FROM conversations""")
cte("doc_in", "SELECT source_id, text FROM texts UNION ALL SELECT source_id, text FROM stext", "texts stext")
_sig = detectors.signatures()
_ms = ", ".join(f"list_filter([{', '.join(q(w) for w in s['words'])}], lambda w: contains(low, w)) AS m{i}" for i, s in enumerate(_sig))
_ss = ", ".join(f"len(m{i}) / CAST({len(s['words'])} AS DOUBLE) * CAST({s['weight']} AS DOUBLE) AS s{i}" for i, s in enumerate(_sig))
_best = "greatest(s0, s1, s2, s3)"
cte("doc_scores", f"SELECT *, {_best} AS best FROM (SELECT *, {_ss} FROM (SELECT *, {_ms} FROM (SELECT *, lower(text) AS low FROM doc_in)))", "doc_in")
_kind = "CASE WHEN best < CAST(0.15 AS DOUBLE) THEN 'unknown' " + " ".join(f"WHEN s{i} = best THEN {q(s['type'])}" for i, s in enumerate(_sig)) + " END"
_mat = "CASE WHEN best < CAST(0.15 AS DOUBLE) THEN '' " + " ".join(f"WHEN s{i} = best THEN {join(f'm{i}')}" for i in range(4)) + " END"
o("document_type", f"SELECT source_id, {_kind} AS document_type, round(best, 3) AS confidence, {_mat} AS matched_identifiers, "
  + ", ".join(f"round(s{i}, 3) AS score_{s['type']}" for i, s in enumerate(_sig)) + " FROM doc_scores", "doc_scores")
o("document_type_fallback", f"""
SELECT source_id, CASE WHEN bank THEN 'bank_statement' ELSE kind END AS document_type, CASE WHEN bank THEN CAST(0.5 AS DOUBLE) ELSE round(best, 3) END AS confidence,
  CASE WHEN bank THEN {q(detectors.DATED_AMOUNT_EVIDENCE)} ELSE mat END AS matched_identifiers
FROM (SELECT *, kind = 'unknown' AND len(regexp_extract_all(text, {q(detectors.DATED_AMOUNT)})) >= 5 AS bank FROM (SELECT *, {_kind} AS kind, {_mat} AS mat FROM doc_scores))""", "doc_scores")
_dets = detectors.detectors()


def dpattern(d: dict) -> str:
    return q("(?i)" + (detectors.SSN_NO_LOOKAHEAD if d["code"] == "SSN" else d["pattern"]))


for _x in _dets:
    o(f"detect_{_x['code'].lower()}", f"""
SELECT source_id, CAST(pos - 1 AS BIGINT) AS position, value FROM (SELECT source_id, unnest(v) AS value, unnest(range(1, len(v) + 1)) AS pos
  FROM (SELECT source_id, regexp_extract_all(text, {dpattern(_x)}) AS v FROM texts))""", "texts")
_terms = ["old oak", "first example bank", "queque"]
_every = [(x["ordinal"], x["code"], x["label"], x["confidence"], dpattern(x)) for x in _dets] + [
    (10 + i, "CUSTOM", "Custom Term", 1.0, q("(?i)" + t)) for i, t in enumerate(_terms)]
_span = lambda n, code, label, conf, p: f"""
SELECT source_id, source, CAST(list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(x) for x in v[1:i-1]]), 0) AS BIGINT) AS start, v[i] AS value, {n} AS rank, {q(code)} AS code, {q(label)} AS label, {q(conf)} AS confidence
FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM (SELECT source_id, source, regexp_extract_all(text, {p}) AS v, regexp_split_to_array(text, {p}) AS gaps FROM texts))"""  # noqa: E731
cte("spans", " UNION ALL ".join(_span(*e) for e in _every), "texts")
cte("placed", "SELECT *, start + length(value) AS stop, row_number() OVER (PARTITION BY source_id ORDER BY start, rank) - 1 AS position FROM spans", "spans")
o("detect_custom_terms", "SELECT source_id, start, stop, value FROM placed WHERE code = 'CUSTOM'", "placed")
o("detect_spans", """
SELECT p.source_id, CAST(position AS BIGINT) AS position, start, stop, code, value, confidence,
  substr(t.text, greatest(0, start - 30) + 1, stop + 30 - greatest(0, start - 30)) AS context FROM placed p JOIN texts t USING (source_id)""", "placed texts")
o("detection_counts", "SELECT source, label, count(*) AS items FROM placed GROUP BY 1, 2", "placed")
_resolve = """kept AS (
  SELECT source_id, start, stop, code, value, n FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start, confidence DESC, rank) AS n FROM placed) WHERE n = 1
  UNION ALL SELECT x.source_id, x.start, x.stop, x.code, x.value, x.n FROM (
    SELECT o.*, row_number() OVER (PARTITION BY o.source_id ORDER BY o.n) AS pick FROM kept k JOIN ordered o ON o.source_id = k.source_id AND o.n > k.n AND o.start >= k.stop) x WHERE pick = 1)"""


def with_kept(select: str) -> str:
    sql = build(select, "placed texts")
    ordered = "ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start, confidence DESC, rank) AS n FROM placed), "
    head, tail = sql[: len(sql) - len(select)], select
    return head.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + ordered + _resolve + " " + tail


_digits = "regexp_replace(value, '\\D', '', 'g')"
_last4 = f"CASE WHEN length({_digits}) >= 4 THEN right({_digits}, 4) ELSE lpad({_digits}, 4, 'X') END"


def token(last: str) -> str:
    parts = []
    for x in [*_dets, detectors.CUSTOM]:
        a, mark, b = x["token"].partition("{last4}")
        parts.append(f"WHEN {q(x['code'])} THEN " + (f"{q(a)} || {last} || {q(b)}" if mark else q(a)))
    return "CASE code " + " ".join(parts) + " END"


ORACLES["overlap_resolution"] = with_kept("SELECT source_id, start, stop, code FROM kept")
o("replacement_tokens", f"SELECT source_id, start, code, {token(_last4)} AS token, {token(q('XXXX'))} AS token_hidden FROM placed", "placed")
_redact = f"""(SELECT t.source_id, t.source, t.text, coalesce(k.body || substr(t.text, k.at + 1), t.text) AS redacted FROM texts t LEFT JOIN (
  SELECT source_id, string_agg(substr(text, prev + 1, start - prev) || tok, '' ORDER BY n) AS body, max(stop) AS at FROM (
    SELECT k.*, t.text, {token(_last4)} AS tok, coalesce(lag(stop) OVER (PARTITION BY k.source_id ORDER BY n), 0) AS prev FROM kept k JOIN texts t USING (source_id)) GROUP BY 1) k USING (source_id))"""
ORACLES["redact_text"] = with_kept(f"SELECT source_id, md5(redacted) AS redacted_md5, length(redacted) AS chars FROM {_redact}")
ORACLES["redaction_report"] = with_kept(f"""SELECT r.source_id, length(text) AS original_chars, length(redacted) AS redacted_chars, coalesce(c.items, 0) AS items, coalesce(c.by_type, '') AS by_type
FROM {_redact} r LEFT JOIN (SELECT source_id, CAST(sum(n) AS BIGINT) AS items, string_agg(label || '=' || n, '; ' ORDER BY label) AS by_type FROM (SELECT source_id, label, count(*) AS n FROM placed GROUP BY 1, 2) GROUP BY 1) c USING (source_id)""")
o("masked_examples", """SELECT source_id, start, label, repeat('*', greatest(0, length(value) - 4)) || right(value, 4) AS masked, confidence
FROM (SELECT *, row_number() OVER (PARTITION BY source_id, code ORDER BY start, rank) AS k FROM placed) WHERE k <= 3""", "placed")
o("folder_totals", """SELECT t.source, count(*) FILTER (WHERE length(text) > 0) AS succeeded, count(*) FILTER (WHERE length(text) = 0) AS failed, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_redacted
FROM texts t LEFT JOIN (SELECT source_id, count(*) AS n FROM placed GROUP BY 1) USING (source_id) GROUP BY 1""", "texts placed")

# --- merchants and flows ----------------------------------------------------

o("clean_description", "SELECT seq, merchant_clean AS cleaned FROM cleaned", "cleaned")
o("merchant_tokens", f"SELECT seq, {join('tokens')} AS tokens FROM cleaned", "cleaned")
o("client_dictionary", "SELECT seq, client_id, canonical AS canonical_merchant_id FROM norm WHERE client_matched", "norm")
o("alias_lookup", "SELECT seq, alias_id AS canonical FROM cleaned LEFT JOIN alias_hit USING (merchant_clean)", "cleaned alias_hit")
o("provisional_merchant", "SELECT seq, provisional FROM norm", "norm")
o("normalize_merchant", f"SELECT seq, merchant_clean, canonical AS canonical_merchant_id, {join('tokens')} AS merchant_tokens, alias_matched, client_matched FROM norm", "norm")
o("classify_inflow", "SELECT seq, inflow_type AS type, flow_confidence AS confidence, flow_evidence AS evidence, flow_confidence < CAST(0.85 AS DOUBLE) AS review FROM flow JOIN tx USING (seq) WHERE direction = 'CREDIT'", "flow tx")
o("inflow_fallback", "SELECT flow_confidence AS confidence, flow_evidence AS evidence, count(*) AS rows FROM flow JOIN tx USING (seq) WHERE direction = 'CREDIT' AND inflow_type = 'UNKNOWN' GROUP BY 1, 2", "flow tx")
o("classify_outflow", "SELECT seq, inflow_type AS type, flow_confidence AS confidence, flow_evidence AS evidence FROM flow JOIN tx USING (seq) WHERE direction = 'DEBIT'", "flow tx")
o("classify_flows", "SELECT seq, inflow_type, flow_evidence AS inflow_evidence, inflow_type = 'UNKNOWN' AS required_review, CASE WHEN inflow_type = 'UNKNOWN' THEN 'INFLOW_UNCLASSIFIED' ELSE '' END AS flags FROM flow", "flow")

# --- loans ------------------------------------------------------------------

_loan = f"(direction = 'DEBIT' AND {has(U, loans.KEYWORDS)})"
o("detect_loan", f"SELECT seq, {_loan} AS is_loan FROM tx", "tx")
o("loan_type", f"SELECT seq, {loan_type()} AS loan_type FROM tx WHERE {_loan}", "tx")
o("loan_fee", f"SELECT seq, CAST(f AS VARCHAR) AS fee FROM (SELECT seq, {number_after(loans.FEE_PATTERN)} AS f FROM tx) WHERE f <> 0", "tx")
o("described_interest", f"SELECT seq, CAST(f AS VARCHAR) AS interest FROM (SELECT seq, {number_after(loans.INTEREST_PATTERN)} AS f FROM tx) WHERE f IS NOT NULL", "tx")
_sp = "CAST(principal AS VARCHAR) AS principal, CAST(interest AS VARCHAR) AS interest, CAST(fees AS VARCHAR) AS fees"
for _n, _src in (("manual_split", "manual"), ("amortization_lookup", "amortization"), ("estimated_split", "estimated")):
    o(_n, f"SELECT seq, {_sp}, evidence FROM split WHERE source = {q(_src)}", "split")
o("split_shares", """SELECT client_id, pattern, CAST(interest AS VARCHAR) AS interest_pct, abs(principal + interest + fees - 1) <= 0.01 AS accepted,
 CASE WHEN abs(principal + interest + fees - 1) > 0.01 THEN 'Percentages must sum to 1.0 (got ' || CAST(CAST(round(principal + interest + fees, 2) AS DECIMAL(10,2)) AS VARCHAR) || ')' END AS error
FROM (SELECT client_id, pattern, principal, CAST(interest + (client_id % 3) * 0.0060 AS DECIMAL(5,4)) AS interest, fees FROM clients,
 (VALUES (0, 'SBA LOAN', 0.7000, 0.3000, 0.0000), (1, 'equipment', 0.6500, 0.3000, 0.0500)) v(n, pattern, principal, interest, fees) WHERE (client_id + n) % 4 = 0)""", "clients")
o("loan_split", f"SELECT seq, loan_type, source, {_sp} FROM split", "split")
o("apply_loans", """SELECT seq, CASE WHEN source IS NOT NULL THEN 'LIABILITY' ELSE '' END AS account_type, CASE WHEN source IS NOT NULL THEN '2300' ELSE '' END AS account_code,
 CASE WHEN source IS NOT NULL THEN 'Loan Payable' ELSE '' END AS account_name, coalesce(source = 'estimated', FALSE) AS loan_estimated, CASE WHEN source = 'estimated' THEN 'LOAN_ESTIMATED_SPLIT' ELSE '' END AS flags
FROM tx LEFT JOIN split USING (seq)""", "tx split")
o("loan_report", f"""SELECT tx.batch_id, count(source) AS loan_payments_found, count(*) FILTER (WHERE source <> 'estimated') AS confirmed_split, count(*) FILTER (WHERE source = 'estimated') AS estimated_split,
 0::BIGINT AS needs_manual_split, CAST({msum('principal')} AS VARCHAR) AS total_principal, CAST({msum('interest')} AS VARCHAR) AS total_interest_expense, CAST({msum('fees')} AS VARCHAR) AS total_fees, """
  + ", ".join(f"count(*) FILTER (WHERE loan_type = '{k}') AS type_{k.lower()}" for k in loans.RATES) + ", "
  + ", ".join(f"count(*) FILTER (WHERE source = '{k}') AS source_{k}" for k in ("manual", "description", "amortization", "estimated"))
  + " FROM tx LEFT JOIN split USING (seq) GROUP BY 1", "tx split")

# --- categorisation ---------------------------------------------------------

o("candidate_texts", "SELECT seq, array_to_string(list_distinct_ordered, ' | ') AS candidates FROM (SELECT seq, list_filter([description, CASE WHEN merchant_clean <> description THEN merchant_clean END, CASE WHEN canonical NOT IN (description, merchant_clean) THEN canonical END], lambda x: x IS NOT NULL AND x <> '') AS list_distinct_ordered FROM norm)", "norm")
o("pre_class_gate", f"SELECT seq, inflow_type, direction, confidence AS confidence_score, {join('evidence')} AS categorization_evidence FROM cat WHERE layer = 'pre_classifier'", "cat")
o("loan_gate", f"SELECT seq, code AS account_code, confidence AS confidence_score, {join('evidence')} AS categorization_evidence FROM cat WHERE layer = 'loan_splitter'", "cat")
o("exact_match", "SELECT seq, keyword, account, name, type, deductible, ref, note FROM norm n JOIN exact_hit e ON e.t = n.description AND e.direction = n.direction JOIN exact_rules r USING (rank)", "norm exact_hit exact_rules")
o("learned_match", "SELECT seq, rule_id, pattern AS canonical_pattern, code AS account_code, confidence FROM learned_hit", "learned_hit")
o("pattern_match", "SELECT seq, rule_id, account, name, type, confidence, deductible, dlimit AS \"limit\", ref, note FROM norm n JOIN pattern_hit p ON p.t = n.description AND p.direction = n.direction JOIN pattern_rules r USING (ordinal)", "norm pattern_hit pattern_rules")
o("vendor_tier", f"SELECT seq, 'HEURISTIC_' || t.vendor AS rule_id, account, name, confidence, note FROM (SELECT *, {_tier('v1')} AS tier FROM staged) s JOIN tiers t USING (tier)", "staged tiers")
o("candidate_loop", "SELECT seq, keyword, CASE WHEN r1 IS NOT NULL THEN description WHEN r2 IS NOT NULL THEN merchant_clean ELSE canonical END AS text FROM staged JOIN exact_rules ON rank = coalesce(r1, r2, r3)", "staged exact_rules")
for _n, _s in (("credit_fallback", "CREDIT"), ("debit_fallback", "DEBIT")):
    o(_n, f"SELECT seq, f.code, f.name, f.confidence FROM (SELECT *, {FB} AS step FROM tx WHERE direction = '{_s}') x JOIN fb_table f USING (step)", "tx fb_table")
o("fallback_review", "SELECT seq, code AS account_code, required_review, list_contains(flags, 'LOW_CONFIDENCE_CATEGORY') AS flagged FROM cap WHERE layer = 'uncategorized'", "cap")
o("chart_enrichment", "SELECT seq, code AS account_code, tax_line AS schedule_c_line FROM cat", "cat")
o("deductibility", "SELECT code AS account_code, deductible_pct, count(*) AS rows FROM cat GROUP BY 1, 2", "cat")
o("confidence_boost", "SELECT seq, layer AS categorization_layer, confidence AS confidence_score FROM cat", "cat")
o("precision_gate", "SELECT seq, below, required_review FROM cat_strict", "cat_strict")
o("categorize", f"""SELECT seq, code AS account_code, name AS account_name, type AS account_type, layer AS categorization_layer, rule_id AS matched_rule_id, confidence AS confidence_score,
 {join('evidence')} AS categorization_evidence, CASE WHEN layer = 'pattern_match' THEN {join('mtokens')} ELSE '' END AS matched_tokens, deductible, deduction_limit, deductible_pct,
 ref AS irs_ref, tax_line AS schedule_c_line, required_review, {join('flags')} AS flags, {join('notes')} AS flag_notes FROM cat""", "cat")
_stats = """SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE layer = 'pre_classifier') AS pre_classified, count(*) FILTER (WHERE layer = 'loan_splitter') AS loan_split,
 count(*) FILTER (WHERE layer = 'exact_match') AS exact_match, count(*) FILTER (WHERE layer = 'learned_match') AS learned_match, count(*) FILTER (WHERE layer = 'pattern_match') AS pattern_match,
 count(*) FILTER (WHERE layer = 'uncategorized') AS uncategorized, count(*) FILTER (WHERE layer <> 'uncategorized') AS auto_categorized, count(*) FILTER (WHERE len(flags) > 0) AS flagged,
 count(*) FILTER (WHERE confidence < CAST(0.7 AS DOUBLE) OR len(flags) > 0 OR required_review) AS review_queue, sum(CAST(round(confidence, 4) * 10000 AS BIGINT)) AS cs FROM posted GROUP BY 1"""
# exact half-even rounding of cs / 10 / total to whole thousandths
_avg = """CAST((CASE WHEN (cs % (total * 10)) * 2 > total * 10 OR ((cs % (total * 10)) * 2 = total * 10 AND (cs // (total * 10)) % 2 = 1) THEN cs // (total * 10) + 1 ELSE cs // (total * 10) END) AS DOUBLE) / 1000"""
cte("stats", _stats, "posted")
o("categorization_stats", f"SELECT * EXCLUDE (cs), {_avg} AS avg_confidence FROM stats", "stats")
o("review_queue", "SELECT batch_id, seq, confidence AS confidence_score FROM posted WHERE confidence < CAST(0.7 AS DOUBLE) OR len(flags) > 0 OR required_review", "posted")
_dm = "CASE " + " ".join(f"WHEN {'TRUE' if r['direction'] == 'BOTH' else 'direction = ' + q(r['direction'])} AND {has('upper(trim(description))', r['words'])} THEN {i}" for i, r in enumerate(declarative.rules())) + " END"
table("decl", "place, rule_id, account, category, subcategory, confidence, deductible_pct, flag, bound",
      [(i, r["rule_id"], r["account"], r["category"], r["subcategory"], r["confidence"], r["deductible_pct"], r["flag"], r["review_from"]) for i, r in enumerate(declarative.rules())])
o("labelled_accuracy", f"""SELECT total, correct, total - correct AS mismatches, round(correct / total, 4) AS accuracy, correct * 10 >= total * 9 AS passes
FROM (SELECT count(*) AS total, count(*) FILTER (p.code = l.code) AS correct FROM posted p
  JOIN (VALUES {", ".join(f"({q(t)}, {q(side)}, {q(code)})" for t, side, _, code in labelled.ROWS)}) l(description, direction, code)
  ON p.description = l.description AND p.direction = l.direction)""", "posted")
o("declarative_rules", f"SELECT seq, rule_id, account, category, subcategory, confidence, deductible_pct, flag, coalesce(amount >= TRY_CAST(nullif(bound, '') AS DECIMAL(18,2)), FALSE) AS requires_review FROM (SELECT *, {_dm} AS place FROM tx) JOIN decl USING (place)", "tx decl")

# --- learned corrections ----------------------------------------------------

o("correction_text", f"SELECT seq, {ktext('description')} AS pattern FROM tx", "tx")
o("correction_rule_id", f"SELECT seq, {kid(ktext('description'))} AS rule_id FROM tx", "tx")
_debits = "[" + ", ".join(q(x) for x in derive.DEBIT_TEXTS) + "]"
table("chart_list", "i, code, acct_name, acct_type", [(i, a["code"], a["name"], a["type"]) for i, a in enumerate(accounts.chart())])
cte("ev", f"""SELECT *, {ktext('description')} AS pattern, {kid(ktext('description'))} AS rule_id FROM (
 SELECT user_id % 50 AS client_id, event_id AS n, CASE event_type WHEN 'error' THEN 'override' WHEN 'view' THEN 'import' ELSE 'correct' END AS kind,
  ({_debits})[(event_id % {len(derive.DEBIT_TEXTS)}) + 1] || CASE WHEN event_id % 2 = 0 THEN ' #' || event_id ELSE '' END AS description,
  CASE WHEN event_type = 'view' AND event_id % 9 = 0 THEN NULL ELSE code END AS account_code, acct_name, acct_type, CASE WHEN event_id % 3 = 0 THEN 'books' ELSE '' END AS category,
  CASE WHEN event_type = 'view' THEN '' WHEN event_id % 5 = 0 THEN 'Line 9' ELSE '' END AS irs_ref, event_id % 4 <> 0 AS deductible,
  CASE WHEN event_id % 6 = 0 THEN 'DEBIT' ELSE '' END AS direction, CASE WHEN event_id % 7 = 0 THEN 'checked' ELSE '' END AS notes,
  CASE event_type WHEN 'view' THEN 'bulk_import' ELSE 'human_override' END AS source
 FROM events JOIN chart_list ON i = event_id % 67)""", "chart_list")
_good = "kind <> 'override' AND account_code IS NOT NULL"
cte("fold", f"""SELECT client_id, rule_id, min(n) AS created_seq, first(pattern ORDER BY n) AS canonical_pattern, last(account_code ORDER BY n) AS account_code, last(acct_name ORDER BY n) AS account_name,
 last(acct_type ORDER BY n) AS account_type, last(deductible ORDER BY n) AS deductible, coalesce(last(category ORDER BY n) FILTER (WHERE category <> ''), '') AS category, '' AS subcategory,
 coalesce(last(irs_ref ORDER BY n) FILTER (WHERE irs_ref <> ''), '') AS irs_ref, coalesce(last(notes ORDER BY n) FILTER (WHERE notes <> ''), '') AS notes,
 first(direction ORDER BY n) AS direction, first(source ORDER BY n) AS source, count(*) - 1 AS times_confirmed FROM ev WHERE {_good} GROUP BY 1, 2""", "ev")
cte("fold2", "SELECT f.*, (SELECT count(*) FROM ev e WHERE e.client_id = f.client_id AND e.rule_id = f.rule_id AND e.kind = 'override' AND e.n > f.created_seq) AS times_overridden FROM fold f", "fold ev")
o("correction_upsert", "SELECT * FROM fold", "fold")
o("correction_overrides", "SELECT client_id, rule_id, times_overridden FROM fold2", "fold2")
o("correction_confidence", f"SELECT client_id, rule_id, {kconf('times_confirmed', 'times_overridden')} AS confidence FROM fold2", "fold2")
o("correction_applications", """SELECT seq, rule_id, a AS times_applied, 'Learned match: ''' || pattern || ''' → ' || code || ' ' || name || ' (applied ' || a || 'x, confirmed ' || confirmed || 'x, source: human_override)' AS evidence
FROM (SELECT *, applied + row_number() OVER (PARTITION BY client_id, rule_id ORDER BY seq) AS a FROM learned_hit)""", "learned_hit")
o("correction_import", "SELECT client_id, count(*) AS imported FROM ev WHERE kind = 'import' AND account_code IS NOT NULL GROUP BY 1", "ev")
o("correction_delete", "SELECT client_id, rule_id, pattern AS canonical_pattern FROM learned WHERE (client_id + created_seq) % 5 <> 0", "learned")
o("correction_list", "SELECT client_id, rule_id, pattern AS canonical_pattern, account_code, account_name, account_type, confidence, times_applied, times_confirmed, times_overridden, created_seq, 'human_override' AS source FROM learned", "learned")
o("correction_stats", """SELECT client_id, count(*) AS total_rules, CAST(sum(times_applied) AS BIGINT) AS total_applied, CAST(round_even(CAST(sum(CAST(confidence AS DECIMAL(10,4))) AS DOUBLE) / count(*), 3) AS DOUBLE) AS avg_confidence,
 count(*) FILTER (WHERE confidence >= CAST(0.9 AS DOUBLE)) AS high_confidence_rules, count(*) FILTER (WHERE confidence < CAST(0.7 AS DOUBLE)) AS low_trust_rules FROM learned GROUP BY 1""", "learned")

# --- capital purchases ------------------------------------------------------

o("capex_exclusion", f"SELECT seq, {EXCL} AS excluded FROM tx", "tx")
o("asset_class", f"SELECT seq, {asset('name')} AS name, {asset('keyword')} AS keyword, {asset('life')} AS life, {asset('property_class')} AS property_class FROM tx WHERE {has(U, [w for w, _ in _cls])}", "tx")
o("capex_apply", "SELECT seq, is_capex, de_minimis, cls_out AS capex_asset_class, code AS account_code, name AS account_name FROM cap WHERE is_capex OR de_minimis", "cap")
o("large_expense_review", "SELECT seq, CAST(amount AS VARCHAR) AS amount, code AS account_code FROM cap WHERE list_contains(flags, 'LARGE_EXPENSE_REVIEW')", "cap")
_citem = f"""SELECT batch_id, seq, kind, date, description, CAST(amount AS VARCHAR) AS amount, cls AS asset_class, CASE WHEN kind = 'capex' THEN 'Route to Fixed Assets (' || {asset('property_class')} || '). CPA to evaluate: Section 179 election, Bonus Depreciation (168(k)), or standard MACRS over ' || {asset('life')} || ' years. Ref: ' || {asset('ref')} END AS recommendation
 FROM cap WHERE kind IN ('capex', 'de_minimis')"""
o("capex_items", _citem, "cap")
o("capex_report", f"SELECT batch_id, count(*) FILTER (WHERE is_capex) AS capex_count, CAST({msum('amount', 'is_capex')} AS VARCHAR) AS total_capex, count(*) FILTER (WHERE de_minimis) AS de_minimis_count FROM cap GROUP BY 1", "cap")

# --- ledger -----------------------------------------------------------------

o("journal_entries", "SELECT batch_id, seq, transaction_id, entry_id, date, CAST(line AS BIGINT) AS line, account, account_name, CAST(debit AS VARCHAR) AS debit, CAST(credit AS VARCHAR) AS credit, memo, flag FROM lines", "lines")
o("entry_balance", "SELECT seq, entry_id, CAST(debits AS VARCHAR) AS entry_debits, CAST(credits AS VARCHAR) AS entry_credits, balanced AS entry_balanced, debit_account, credit_account FROM posted", "posted")
o("trial_balance", f"SELECT batch_id, code, name, CAST(total_debit AS VARCHAR) AS total_debit, CAST(total_credit AS VARCHAR) AS total_credit, type, normal_balance, CAST(net AS VARCHAR) AS net_balance, {text('CASE WHEN net > 0 THEN net ELSE 0 END')} AS balance_debit, {text('CASE WHEN net < 0 THEN -net ELSE 0 END')} AS balance_credit FROM tb", "tb")
_tbt = "SELECT batch_id, CAST(total_debits AS VARCHAR) AS total_debits, CAST(total_credits AS VARCHAR) AS total_credits, account_count, CAST(difference AS VARCHAR) AS difference, is_balanced FROM tbt"
o("trial_balance_totals", _tbt, "tbt")
o("ledger_rollup", f"""SELECT client_id, batch_id, type, code, grouping(client_id, batch_id, type, code)::BIGINT AS level, count(*) AS balances, CAST({msum('total_debit')} AS VARCHAR) AS total_debit, CAST({msum('total_credit')} AS VARCHAR) AS total_credit, CAST({msum('net')} AS VARCHAR) AS net_balance
FROM tb JOIN (SELECT batch_id, client_id FROM batches) USING (batch_id) GROUP BY GROUPING SETS ((client_id, batch_id, type, code), (client_id, batch_id, type), (client_id, batch_id), (client_id, type, code), (client_id, type), (client_id), (type, code), (type), ())""", "tb batches")
o("out_of_balance", _tbt + " WHERE NOT is_balanced", "tbt")
o("trial_balance_by_type", f"SELECT batch_id, type, count(*) AS accounts, CAST({msum('total_debit')} AS VARCHAR) AS total_debit, CAST({msum('total_credit')} AS VARCHAR) AS total_credit, CAST({msum('net')} AS VARCHAR) AS net_balance FROM tb GROUP BY 1, 2", "tb")
cte("pl", f"""SELECT *, {m('revenue - cogs')} AS gross_profit FROM (SELECT batch_id, {msum('abs(net)', "type = 'REVENUE'")} AS revenue, {msum('abs(net)', "type = 'COGS'")} AS cogs,
 {msum('abs(net)', "type = 'EXPENSE' AND code <> '6700'")} AS operating_expenses, {msum('abs(net)', "type = 'EXPENSE' AND code = '6700'")} AS interest_expense, count(*) AS line_items
 FROM tb WHERE type IN ('REVENUE', 'COGS', 'EXPENSE') GROUP BY 1)""", "tb")
_g, _r = "CAST(gross_profit * 100 AS HUGEINT)", "CAST(revenue * 100 AS HUGEINT)"
_fl = f"(abs({_g}) * 1000 // {_r})"
_rem2 = f"((abs({_g}) * 1000 % {_r}) * 2)"
_he = f"({_fl} + CASE WHEN {_rem2} > {_r} OR ({_rem2} = {_r} AND {_fl} % 2 = 1) THEN 1 ELSE 0 END)"
o("profit_and_loss", f"""SELECT batch_id, CAST(revenue AS VARCHAR) AS revenue, CAST(cogs AS VARCHAR) AS cogs, CAST(operating_expenses AS VARCHAR) AS operating_expenses, CAST(interest_expense AS VARCHAR) AS interest_expense, line_items,
 CAST(gross_profit AS VARCHAR) AS gross_profit, CASE WHEN revenue = 0 THEN '0.0' ELSE CAST(CAST(CAST(sign({_g}) * {_he} AS DECIMAL(17,0)) * CAST(0.1 AS DECIMAL(2,1)) AS DECIMAL(18,1)) AS VARCHAR) END AS gross_margin_pct,
 {text('gross_profit - operating_expenses - interest_expense')} AS net_income FROM pl""", "pl")
_groups: dict = {}
for _t in accounts.tax_lines():
    _groups.setdefault(_t["line"], []).append(_t["code"])
_tl = "CASE " + " ".join(f"WHEN code IN ({', '.join(q(c) for c in cs)}) THEN {q(l)}" for l, cs in _groups.items()) + " END"
cte("taxed", f"SELECT *, {_tl} AS tl FROM posted", "posted")
o("tax_lines", f"SELECT batch_id, tl AS tax_line, CAST({msum('amount')} AS VARCHAR) AS total, count(*) AS transaction_count FROM taxed WHERE tl IS NOT NULL GROUP BY 1, 2", "taxed")
_titem = "SELECT batch_id, seq, tl AS tax_line, date, description, CAST(amount AS VARCHAR) AS amount, code AS account_code FROM taxed WHERE tl IS NOT NULL"
_topen = "SELECT batch_id, seq, date, description, CAST(amount AS VARCHAR) AS amount, code AS account_code FROM taxed WHERE tl IS NULL"
o("tax_items", _titem, "taxed")
o("tax_unmapped", _topen, "taxed")
_i1, _i2, _i3 = (q(x) for x in accounts.INCOME_LINES)
o("tax_summary", f"""SELECT batch_id, CAST(g AS VARCHAR) AS gross_receipts, CAST(c AS VARCHAR) AS cogs, CAST(oi AS VARCHAR) AS other_income, CAST(x AS VARCHAR) AS total_expenses, u AS unmapped_count,
 {text('g - c')} AS gross_profit, {text('g - c + oi')} AS total_income, {text('g - c + oi - x')} AS net_profit FROM (SELECT batch_id, {msum('amount', f'tl = {_i1}')} AS g, {msum('amount', f'tl = {_i2}')} AS c, {msum('amount', f'tl = {_i3}')} AS oi,
 {msum('amount', f'tl NOT IN ({_i1}, {_i2}, {_i3})')} AS x, count(*) FILTER (WHERE tl IS NULL) AS u FROM taxed GROUP BY 1)""", "taxed")
_cg = "direction = 'DEBIT' AND code IN ('5000', '5100', '5110', '5120', '5130', '5140')"
o("cogs_bank_proxy", f"""SELECT *, CASE WHEN CAST(cogs_total AS DECIMAL(18,2)) > 0 THEN {q(st.PROXY_WARNING)} END AS warning FROM (SELECT batch_id, CAST({msum('amount', _cg + " AND code IN ('5000', '5100', '5140')")} AS VARCHAR) AS purchases_total,
 CAST({msum('amount', _cg + " AND code IN ('5110', '5120')")} AS VARCHAR) AS direct_materials, CAST({msum('amount', _cg + " AND code = '5130'")} AS VARCHAR) AS subcontractor_costs, CAST({msum('amount', _cg)} AS VARCHAR) AS cogs_total FROM posted GROUP BY 1)""", "posted")
o("cogs_inventory", f"""SELECT batch_id, {text('n * 7')} AS beginning_inventory, {text('n * 9')} AS ending_inventory, {text('n % 50')} AS labor, {text('n % 30')} AS materials, '5.00' AS other, CAST(p AS VARCHAR) AS purchases,
 {text('n * 7 + p + n % 50 + n % 30 + 5 - n * 9')} AS cogs_total, {join(compact(('n * 7 + p + n % 50 + n % 30 + 5 - n * 9 < 0', q(st.NEGATIVE_WARNING)), ('n * 9 > n * 7 + p', q(st.EXCESS_WARNING))))} AS warnings
FROM (SELECT b.batch_id, day(period_end) * 10 + client_id AS n, coalesce(x.p, 0) AS p FROM batches b LEFT JOIN (SELECT batch_id, {msum('amount', _cg)} AS p FROM posted GROUP BY 1) x USING (batch_id))""", "batches posted")
o("inventory_spikes", f"""SELECT client_id, month, CAST(p AS VARCHAR) AS purchases, CAST(r AS VARCHAR) AS revenue, {q(st.SPIKE_ALERT)} AS alert FROM (SELECT client_id, substr(date, 1, 7) AS month, {msum('amount', _cg)} AS p,
 {msum('amount', "direction = 'CREDIT' AND type = 'REVENUE'")} AS r FROM posted GROUP BY 1, 2) WHERE p > 0 AND (r = 0 OR p > r * 2)""", "posted")

# --- flags, reconciliation, checks ------------------------------------------

for _f in ["BALANCE_MISMATCH", "DUPLICATE_TRANSACTION", *FLAG_COND]:
    o(f"flag_{_f.lower()}", f"SELECT batch_id, seq FROM flagged WHERE list_contains(flags, {q(_f)})", "flagged")
o("flag_rows", f"SELECT seq, {join('flags')} AS flags, {join('notes')} AS flag_notes FROM flagged", "flagged")
o("flag_summary", "SELECT * FROM flag_summary", "flag_summary")
o("flag_severity", "SELECT batch_id, flag, count(*) AS occurrences, min(severity) AS severity, min(dashboard) AS dashboard_severity FROM flag_items GROUP BY 1, 2", "flag_items")
_v = lambda *cs: ", ".join(f"CAST({c} AS VARCHAR) AS {a}" for c, a in cs)
o("reconcile", f"SELECT batch_id, {_v(('beginning_balance', 'beginning_balance'), ('ending_balance', 'ending_balance'), ('total_credits', 'total_credits'), ('total_debits', 'total_debits'), ('net_change', 'net_change'), ('computed', 'computed_ending'), ('difference', 'difference'))}, status FROM recon", "recon")
o("duplicate_count", "SELECT * FROM dups", "dups")
o("reconcile_diagnosis", f"SELECT batch_id, {join('issues')} AS issues, {join('advice')} AS recommendations, status <> 'RED' AS can_issue_full FROM recon", "recon")
o("structural_issues", "SELECT batch_id, transaction_id, severity, code, message FROM issues WHERE category = 'structural'", "issues")
for _code in ["CREDIT_TO_EXPENSE", "LOAN_AS_EXPENSE", "LARGE_UNVERIFIED_REVENUE", "DRAW_AS_EXPENSE", "MEALS_FULL_DEDUCTION", "CAPEX_AS_EXPENSE"]:
    o(f"issue_{_code.lower()}", f"SELECT batch_id, transaction_id, severity, message FROM row_issues WHERE code = '{_code}'", "row_issues")
o("issue_uncategorized_remaining", "SELECT batch_id, severity, message FROM issues WHERE code = 'UNCATEGORIZED_REMAINING'", "issues")
o("validation_rollup", "SELECT *, structural_critical = 0 AS structural_pass, semantic_critical = 0 AS semantic_pass, structural_critical = 0 AND semantic_critical = 0 AS all_pass FROM validation", "validation")
_fine = {"arithmetic": "All totals, margins, and rollups exact.", "structural": "All structural integrity checks pass.",
         "disclosure": "All methods and limitations properly disclosed.", "review": "All items above confidence threshold and reviewed."}
for _g2, _ok in _fine.items():
    o(f"gate_{_g2}", f"SELECT batch_id, len({_g2}) = 0 AS passed, CASE WHEN len({_g2}) = 0 THEN {q(_ok)} ELSE array_to_string({_g2}, '; ') END AS details, {q(_g2 in ('arithmetic', 'structural'))} AS blocker FROM gates", "gates")
_names = lambda a, b: "array_to_string(" + compact((f"len({a}) > 0", q(a.upper())), (f"len({b}) > 0", q(b.upper()))) + ", ', ')"
o("acceptance_verdict", f"""SELECT batch_id, NOT blocked AS can_issue_full, CASE WHEN blocked THEN 'BLOCKED' WHEN warned THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS overall_status,
 CASE WHEN blocked THEN 'Full Analysis CANNOT be issued. Blocking gates failed: ' || {_names('arithmetic', 'structural')} || '. Resolve these before issuing.'
  WHEN warned THEN 'Full Analysis can be issued WITH WARNINGS. Non-blocking items need attention: ' || {_names('disclosure', 'review')} || '. Report will include disclosure notes.'
  ELSE 'All acceptance gates pass. Full Analysis is cleared for issuance. Arithmetic exact, structural integrity verified, disclosures complete, all items above confidence threshold.' END AS summary
FROM (SELECT *, len(arithmetic) + len(structural) > 0 AS blocked, len(disclosure) + len(review) > 0 AS warned FROM gates)""", "gates")
_half = lambda n, d: f"(CASE WHEN ({n} * 100 % {d}) * 2 > {d} OR (({n} * 100 % {d}) * 2 = {d} AND ({n} * 100 // {d}) % 2 = 1) THEN {n} * 100 // {d} + 1 ELSE {n} * 100 // {d} END)"
o("analysis_grade", f"""SELECT batch_id, total, uncategorized, review_queue, CASE WHEN poor THEN 'PRELIMINARY' WHEN fair THEN 'DRAFT' ELSE 'FULL' END AS analysis_grade,
 CASE WHEN poor THEN uncategorized || ' uncategorized (' || {_half('uncategorized', 'total')} || '%), ' || review_queue || ' in review queue (' || {_half('review_queue', 'total')} || '%). Too many unresolved items for full analysis.'
  WHEN fair THEN uncategorized || ' uncategorized (' || {_half('uncategorized', 'total')} || '%), 0 unsplit loan payments. Review recommended before relying on P&L.' ELSE 'Categorization coverage sufficient for full analysis.' END AS analysis_grade_reason
FROM (SELECT *, uncategorized * 100 > total * 30 OR review_queue * 100 > total * 50 AS poor, uncategorized * 100 > total * 15 AS fair FROM stats)""", "stats")

# --- workpapers -------------------------------------------------------------

o("cover_sheet", """SELECT b.batch_id, 'Client' AS business_name, CAST(period_start AS VARCHAR) || ' to ' || CAST(period_end AS VARCHAR) AS period, '' AS prepared_by, source_document, '' AS source_hash, '' AS reviewer_id, '' AS review_timestamp, document_type, 'cash' AS accounting_method, transaction_count,
 CAST(t.total_debits AS VARCHAR) AS total_debits, CAST(t.total_credits AS VARCHAR) AS total_credits, CASE WHEN is_balanced THEN 'BALANCED' ELSE 'OUT OF BALANCE' END AS trial_balance_status, flagged_transactions AS flagged_items, critical AS critical_flags,
 '2.4.0' AS ruleset_version, 'PENDING' AS review_status FROM batches b JOIN totals t USING (batch_id) JOIN tbt USING (batch_id) JOIN flag_summary USING (batch_id)""", "batches totals tbt flag_summary")
_reg = f"SELECT batch_id, seq, date, description, CAST(amount AS VARCHAR) AS amount, direction, code AS account_code, name AS account_name, confidence, len(flags) > 0 AS flagged, {join('flags')} AS flags FROM flagged"
o("transaction_register", _reg, "flagged")
o("category_summary", f"""SELECT batch_id, category_name, count, CAST(t AS VARCHAR) AS total, account, row_number() OVER (PARTITION BY batch_id ORDER BY t DESC, s) AS position
FROM (SELECT batch_id, name AS category_name, count(*) AS count, {msum('amount')} AS t, arg_max(code, seq) AS account, min(seq) AS s FROM posted GROUP BY 1, 2)""", "posted")
o("audit_trail", f"SELECT batch_id, seq, transaction_id, date, description, CAST(amount AS VARCHAR) AS amount, layer AS categorization_layer, code AS account_code, name AS account_name, confidence, entry_id AS journal_entry_id, balanced AS je_balanced, {join('flags')} AS flags FROM flagged", "flagged")
o("bank_reconciliation", f"""SELECT batch_id, CAST(nullif(beginning_balance, 0) AS VARCHAR) AS beginning_balance, CAST(total_credits AS VARCHAR) AS total_credits, CAST(total_debits AS VARCHAR) AS total_debits, CAST(net_change AS VARCHAR) AS net_change,
 CAST(nullif(ending_balance, 0) AS VARCHAR) AS ending_balance, coalesce(difference = 0, TRUE) AS reconciles, {text('beginning_balance + net_change')} AS calculated_ending FROM recon""", "recon")
o("flagged_list", f"SELECT batch_id, seq, date, description, CAST(amount AS VARCHAR) AS amount, {join('flags')} AS flags, position FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY seq) AS position FROM flagged WHERE len(flags) > 0) WHERE position <= 50", "flagged")
o("register_search", "SELECT seq, description, CAST(amount AS VARCHAR) AS amount, code AS account_code FROM flagged WHERE contains(lower(description), 'food') OR contains(lower(name), 'food') OR contains(code, 'food')", "flagged")

# the package: per section its rows, sort key and fields; a digest of all fields by name
_blocks = {
    "cover_sheet": (SELECTS["cover_sheet"][0], None, "business_name period prepared_by source_document source_hash document_type accounting_method transaction_count total_debits total_credits trial_balance_status flagged_items critical_flags ruleset_version reviewer_id review_timestamp review_status"),
    "bank_reconciliation": (SELECTS["bank_reconciliation"][0], None, "beginning_balance total_credits total_debits net_change ending_balance reconciles calculated_ending"),
    "transaction_register": ("SELECT batch_id, seq, date, description, CAST(amount AS VARCHAR) AS amount, direction, code AS account_code, name AS account_name, confidence, len(flags) > 0 AS flagged, to_json(flags) AS flags FROM flagged", "seq", "date description amount direction account_code account_name confidence flagged flags"),
    "trial_balance": (SELECTS["trial_balance"][0], "code", "code name total_debit total_credit type normal_balance net_balance balance_debit balance_credit"),
    "profit_and_loss": (SELECTS["profit_and_loss"][0], None, "revenue cogs operating_expenses interest_expense line_items gross_profit gross_margin_pct net_income"),
    "profit_and_loss_lines": ("SELECT batch_id, CASE WHEN type = 'REVENUE' THEN 'revenue' WHEN type = 'COGS' THEN 'cogs' WHEN code = '6700' THEN 'interest' ELSE 'operating_expenses' END AS section, code, name, CAST(abs(net) AS VARCHAR) AS amount FROM tb WHERE type IN ('REVENUE', 'COGS', 'EXPENSE')", "code", "section code name amount"),
    "schedule_c_map": (SELECTS["tax_lines"][0], "tax_line", "tax_line total transaction_count"),
    "schedule_c_transactions": (_titem, "seq", "tax_line date description amount account_code"),
    "schedule_c_unmapped": (_topen, "seq", "date description amount account_code"),
    "schedule_c_summary": (SELECTS["tax_summary"][0], None, "gross_receipts cogs other_income total_expenses unmapped_count gross_profit total_income net_profit"),
    "journal_totals": ("SELECT batch_id, count(*) AS journal_entry_count, bool_and(balanced) AS journal_entries_balanced FROM posted GROUP BY 1", None, "journal_entry_count journal_entries_balanced"),
    "capital_purchases": (_citem, "seq", "kind date description amount asset_class recommendation"),
    "flag_counts": (SELECTS["flag_severity"][0], "flag", "flag occurrences severity dashboard_severity"),
    "flagged_items": ("SELECT batch_id, seq, date, description, CAST(amount AS VARCHAR) AS amount, to_json(flags) AS flags, to_json(notes) AS flag_notes FROM flagged WHERE len(flags) > 0", "seq", "date description amount flags flag_notes"),
    "flagged_items_report": ("SELECT * FROM flag_summary", None, "total_flags flagged_transactions critical high medium low"),
    "category_summary": (SELECTS["category_summary"][0], "position", "category_name count total account position"),
    "audit_trail": ("SELECT batch_id, seq, transaction_id, date, description, CAST(amount AS VARCHAR) AS amount, layer AS categorization_layer, code AS account_code, name AS account_name, confidence, entry_id AS journal_entry_id, balanced AS je_balanced, to_json(flags) AS flags, to_json(notes) AS flag_notes FROM flagged", "seq", "transaction_id date description amount categorization_layer account_code account_name confidence journal_entry_id je_balanced flags flag_notes"),
}


def _digest(section: str, sql: str, key: str | None, fields: str) -> str:
    text_ = " || '|' || ".join(f"'{f}=' || coalesce(CAST({f} AS VARCHAR), '~')" for f in sorted(fields.split()))
    order = f"lpad(CAST({key} AS VARCHAR), 20, '0')" if key else "''"
    return f"SELECT batch_id, {q(section)} AS section, {order} AS sort_key, md5({text_}) AS fields_md5 FROM ({sql})"


o("package_fields", " UNION ALL ".join(_digest(n, *b) for n, b in _blocks.items()),
  "batches totals tbt flag_summary recon tb pl taxed cap posted flagged flag_items")

# --- simple profit and loss -------------------------------------------------

table("kw", "place, keyword, category, subcategory", [(r["ordinal"], r["keyword"], r["category"], r["subcategory"]) for r in keywords.rules()])
cte("kwhit", "SELECT d, min(place) AS place FROM (SELECT DISTINCT lower(description) AS d FROM tx) JOIN kw ON contains(d, keyword) GROUP BY 1", "tx kw")
cte("simple", """SELECT tx.*, substr(date, 1, 7) AS period, coalesce(kw.category, CASE WHEN direction = 'CREDIT' THEN 'revenue' ELSE 'opex' END) AS category,
 coalesce(kw.subcategory, CASE WHEN direction = 'CREDIT' THEN 'uncategorized_income' ELSE 'other_opex' END) AS subcategory, CASE WHEN kw.place IS NULL THEN 'flagged' ELSE 'auto' END AS confidence
FROM tx LEFT JOIN kwhit ON d = lower(description) LEFT JOIN kw USING (place)""", "tx kwhit kw")
o("keyword_categorize", "SELECT seq, category, subcategory, confidence FROM simple", "simple")
o("keyword_counts", "SELECT client_id, period, count(*) FILTER (WHERE confidence <> 'flagged' AND category <> 'transfer') AS auto_categorized, count(*) FILTER (WHERE confidence = 'flagged') AS needs_review, count(*) FILTER (WHERE category = 'transfer') AS transfers_skipped, count(*) AS total FROM simple GROUP BY 1, 2", "simple")
o("keyword_breakdown", f"SELECT client_id, category, subcategory, CAST({msum('amount')} AS VARCHAR) AS total, count(*) AS rows FROM simple GROUP BY 1, 2, 3", "simple")
_b = {"gross_revenue": "category = 'revenue'", "refunds": "category = 'refund_out'", "inventory_costs": "category = 'cogs' AND subcategory <> 'direct_labor'", "direct_labor": "category = 'cogs' AND subcategory = 'direct_labor'",
      **{x: f"category = 'opex' AND subcategory = '{x}'" for x in keywords.OPEX_BUCKETS},
      "other_opex": "category = 'opex' AND subcategory IN ('vehicle', 'office', 'meals_entertainment', 'professional_services', 'other_opex')", "interest_expense": "category = 'debt'", "taxes": "FALSE",
      "uncategorized_income": "subcategory = 'uncategorized_income'", "uncategorized_expense": "category = 'opex' AND subcategory = 'other_opex'"}
_agg = ", ".join(f"{msum('amount', c)} AS {k}" for k, c in _b.items()) + ", count(*) AS transaction_count, count(*) FILTER (WHERE confidence = 'flagged') AS flagged_count"
_out = ", ".join(f"CAST({k} AS VARCHAR) AS {k}" for k in _b) + ", transaction_count, flagged_count"
o("keyword_rollup", f"""SELECT client_id, period, category, subcategory, grouping(client_id, period, category, subcategory)::BIGINT AS level, CAST({msum('amount')} AS VARCHAR) AS total, count(*) AS rows FROM simple
GROUP BY GROUPING SETS ((client_id, period, category, subcategory), (client_id, period, category), (client_id, period), (client_id, category, subcategory), (client_id, category), (client_id), (category, subcategory), (category), ())""", "simple")
cte("built", f"SELECT client_id, period, {_agg} FROM simple GROUP BY 1, 2", "simple")
o("pnl_multi_period", f"SELECT client_id, period, {_out} FROM built", "built")
o("pnl_build", f"SELECT client_id, {_out} FROM (SELECT client_id, {_agg} FROM simple GROUP BY 1)", "simple")
cte("meas", f"""SELECT *, CASE WHEN net_revenue > 0 THEN {pct('gross_profit', 'net_revenue')} ELSE 0 END AS gm, CASE WHEN net_revenue > 0 THEN {pct('operating_income', 'net_revenue')} ELSE 0 END AS om,
 CASE WHEN net_revenue > 0 THEN {pct('net_profit', 'net_revenue')} ELSE 0 END AS nm, CASE WHEN net_revenue <> 0 THEN {pct('total_cogs', 'net_revenue')} ELSE 0 END AS cp,
 CASE WHEN net_revenue <> 0 THEN {pct('total_opex', 'net_revenue')} ELSE 0 END AS op, CASE WHEN net_revenue <> 0 THEN {pct('rent', 'net_revenue')} ELSE 0 END AS rp
FROM (SELECT *, {m('operating_income - interest_expense - taxes')} AS net_profit FROM (SELECT *, {m('gross_profit - total_opex')} AS operating_income FROM (SELECT *, {m('net_revenue - total_cogs')} AS gross_profit FROM (
 SELECT *, {m('gross_revenue - refunds')} AS net_revenue, {m('inventory_costs + direct_labor')} AS total_cogs, {m('rent + utilities + insurance + marketing + software + bank_fees + other_opex')} AS total_opex FROM built))))""", "built")
o("pnl_assumptions", "SELECT client_id, period, 'P&L derived from bank-statement categorization (cash basis). | COGS is bank-proxy only; no inventory adjustments applied.' || CASE WHEN interest_expense > 0 THEN ' | Loan interest routed to expense; principal excluded from P&L.' ELSE '' END AS assumptions FROM meas", "meas")
o("pnl_measures", "SELECT client_id, period, " + ", ".join(f"CAST({k} AS VARCHAR) AS {k}" for k in ("net_revenue", "total_cogs", "gross_profit", "total_opex", "operating_income", "net_profit")) + " FROM meas", "meas")
_mg = {"gm": "gross_margin_pct", "om": "operating_margin_pct", "nm": "net_margin_pct", "cp": "cogs_pct", "op": "opex_pct", "rp": "rent_pct"}
o("pnl_margins", "SELECT client_id, period, " + ", ".join(f"{text(k)} AS {v}" for k, v in _mg.items()) + " FROM meas", "meas")
_chg = lambda c: f"CASE WHEN p_{c} = 0 THEN '0.00' ELSE CAST({pct(f'{c} - p_{c}', f'p_{c}')} AS VARCHAR) END"
o("pnl_comparison", f"""SELECT client_id, p_period AS from_period, period AS to_period, {_chg('net_revenue')} AS revenue_change_pct, {_chg('net_profit')} AS profit_change_pct, {text('nm - p_nm')} AS margin_change, {_chg('total_cogs')} AS cogs_change_pct, {_chg('total_opex')} AS opex_change_pct
FROM (SELECT *, """ + ", ".join(f"lag({c}) OVER w AS p_{c}" for c in ("period", "net_revenue", "net_profit", "nm", "total_cogs", "total_opex")) + " FROM meas WINDOW w AS (PARTITION BY client_id ORDER BY period)) WHERE p_period IS NOT NULL", "meas")
_fs = _half("flagged_count", "transaction_count")
_wr = compact(("refunds > gross_revenue AND gross_revenue > 0", "'SEMANTIC: refunds exceed gross revenue; check refund classification.'"),
              ("net_revenue <= 0 AND (total_opex > 0 OR total_cogs > 0)", "'DISCLOSURE: net revenue <= 0; margins suppressed to 0%. Review deposits/refunds.'"),
              ("net_revenue > 0 AND gm > 90", "'SEMANTIC: gross margin unusually high; verify COGS categorization.'"),
              ("gross_profit > net_revenue", "'WARNING: Gross profit $' || gross_profit || ' exceeds net revenue $' || net_revenue || ' — check COGS'"),
              ("net_profit < 0", "'ALERT: Business operating at a loss of $' || abs(net_profit)"),
              ("flagged_count > 0", f"'REVIEW: ' || flagged_count || ' of ' || transaction_count || ' transactions (' || {_fs} || '%) need manual review'"),
              ("uncategorized_income > 0", "'UNCATEGORIZED: $' || uncategorized_income || ' income could not be auto-classified'"),
              ("uncategorized_expense > 0", "'UNCATEGORIZED: $' || uncategorized_expense || ' expenses could not be auto-classified'"))
o("pnl_warnings", f"SELECT client_id, period, {join(_wr)} AS warnings FROM meas", "meas")
_open = "(uncategorized_income + uncategorized_expense)"
_ck = [("Accounting Equation", "'pass'", "'Equation balances'"), ("Revenue Sign", "'pass'", "'Revenue is non-negative'"),
       ("Margin Bounds", "CASE WHEN net_revenue = 0 THEN 'pass' WHEN gm > 95 OR gm < -50 THEN 'warn' ELSE 'pass' END",
        f"CASE WHEN net_revenue = 0 THEN 'No revenue — skipped' WHEN gm > 95 THEN 'Gross margin ' || {text('gm')} || '% is unusually high — verify COGS' WHEN gm < -50 THEN 'Gross margin ' || {text('gm')} || '% is deeply negative — verify revenue classification' ELSE 'Gross margin ' || {text('gm')} || '% within range' END"),
       ("COGS Ratio", "CASE WHEN net_revenue <> 0 AND cp > 100 THEN 'warn' ELSE 'pass' END", f"CASE WHEN net_revenue = 0 THEN 'No revenue — skipped' WHEN cp > 100 THEN 'COGS is ' || {text('cp')} || '% of revenue — business is losing money on production' ELSE 'COGS ' || {text('cp')} || '% of revenue' END"),
       ("Rent Ratio", "CASE WHEN net_revenue <> 0 AND rp > 15 THEN 'warn' ELSE 'pass' END", f"CASE WHEN net_revenue = 0 THEN 'No revenue — skipped' WHEN rp > 15 THEN 'Rent is ' || {text('rp')} || '% of revenue — above 15% threshold' ELSE 'Rent ' || {text('rp')} || '% of revenue' END"),
       ("Uncategorized", f"CASE WHEN net_revenue > 0 AND {pct(_open, 'nullif(net_revenue, 0)')} > 10 AND {_open} <> 0 THEN 'warn' ELSE 'pass' END",
        f"CASE WHEN {_open} = 0 THEN 'All transactions categorized' WHEN net_revenue > 0 AND {pct(_open, 'nullif(net_revenue, 0)')} > 10 THEN '$' || {text(_open)} || ' uncategorized (' || {pct(_open, 'nullif(net_revenue, 0)')} || '% of revenue) — needs review' ELSE '$' || {text(_open)} || ' uncategorized — minor' END"),
       ("Flagged Ratio", f"CASE WHEN {_fs} > 20 THEN 'warn' ELSE 'pass' END", f"CASE WHEN {_fs} > 20 THEN {_fs} || '% of transactions flagged — consider tuning categories.json' ELSE {_fs} || '% flagged — acceptable' END"),
       ("Zero Revenue", "CASE WHEN net_revenue = 0 AND total_opex > 0 THEN 'warn' ELSE 'pass' END", "CASE WHEN net_revenue = 0 AND total_opex > 0 THEN 'Zero revenue but $' || total_opex || ' in expenses — check if income deposits were misclassified' ELSE 'Revenue present' END")]
cte("pchecks", " UNION ALL ".join(f"SELECT client_id, period, {i} AS position, {q(n)} AS name, {s} AS status, {dt} AS detail FROM meas" for i, (n, s, dt) in enumerate(_ck)), "meas")
o("pnl_checks", "SELECT client_id, period, CAST(position AS BIGINT) AS position, name, status, detail FROM pchecks", "pchecks")
o("pnl_check_summary", "SELECT client_id, period, count(*) AS total_checks, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'warn') AS warnings, count(*) FILTER (WHERE status = 'fail') AS failures, CASE WHEN count(*) FILTER (WHERE status = 'fail') > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE status = 'warn') > 0 THEN 'REVIEW' ELSE 'PASS' END AS overall FROM pchecks GROUP BY 1, 2", "pchecks")


def scored(ind: str) -> str:
    bm, label = keywords.benchmarks()[ind], keywords.INDUSTRY_NAMES[ind]
    g, n, r, c = bm["gross_margin_pct"], bm["net_margin_pct"], bm["rent_pct_of_revenue"], bm["cogs_pct"]
    one = lambda x: f"CAST(CAST(round({x}, 1) AS DECIMAL(18,1)) AS VARCHAR)"
    return f"""SELECT client_id, period, {q(label)} AS industry, gm, nm, rp, cp,
 CASE WHEN gm >= {g['excellent']} THEN 'EXCELLENT' WHEN gm >= {g['healthy']} THEN 'HEALTHY' WHEN gm >= {g['low']} THEN 'BELOW AVERAGE' ELSE 'CRITICAL' END AS s0, CASE WHEN gm >= {g['healthy']} THEN 'green' WHEN gm >= {g['low']} THEN 'yellow' ELSE 'red' END AS f0,
 CASE WHEN gm >= {g['healthy']} THEN NULL WHEN gm >= {g['low']} THEN 'Gross margin is ' || {one(f"{g['healthy']} - gm")} || '% below target. Review {label} COGS.' ELSE 'Immediate cost review needed' END AS a0, CAST(CASE WHEN gm >= {g['excellent']} THEN {g['excellent']} WHEN gm >= {g['low']} THEN {g['healthy']} ELSE {g['low']} END AS DOUBLE) AS b0,
 CASE WHEN nm >= {n['excellent']} THEN 'EXCELLENT' WHEN nm >= {n['healthy']} THEN 'HEALTHY' WHEN nm >= {n['average']} THEN 'AVERAGE' ELSE 'STRUGGLING' END AS s1, CASE WHEN nm >= {n['healthy']} THEN 'green' WHEN nm >= {n['average']} THEN 'yellow' ELSE 'red' END AS f1,
 CASE WHEN nm >= {n['healthy']} THEN NULL WHEN nm >= {n['average']} THEN 'Look for OPEX savings to improve bottom line' ELSE 'Business profitability needs immediate attention' END AS a1,
 CASE WHEN rp > 0 THEN CASE WHEN rp <= {r['ideal']} THEN 'IDEAL' WHEN rp <= {r['warning']} THEN 'ACCEPTABLE' ELSE 'TOO HIGH' END END AS s2, CASE WHEN rp > 0 THEN CASE WHEN rp <= {r['ideal']} THEN 'green' WHEN rp <= {r['warning']} THEN 'yellow' ELSE 'red' END END AS f2,
 CASE WHEN rp > {r['warning']} THEN 'Rent is ' || {one('rp')} || '% of revenue — negotiate or relocate' WHEN rp > {r['ideal']} THEN 'Rent approaching warning threshold' END AS a2,
 CASE WHEN cp > 0 THEN CASE WHEN cp <= {c['low']} THEN 'LOW' WHEN cp <= {c['healthy']} THEN 'HEALTHY' WHEN cp <= {c['high']} THEN 'ELEVATED' ELSE 'CRITICAL' END END AS s3, CASE WHEN cp > 0 THEN CASE WHEN cp <= {c['healthy']} THEN 'green' WHEN cp <= {c['high']} THEN 'yellow' ELSE 'red' END END AS f3,
 CASE WHEN cp > {c['high']} THEN 'Direct costs consuming too much revenue' WHEN cp > {c['healthy']} THEN 'Review supplier pricing and waste' WHEN cp > 0 AND cp <= {c['low']} THEN 'Verify all direct costs are captured in COGS' END AS a3, net_revenue, gross_profit, net_profit, om, total_opex, transaction_count, flagged_count FROM meas"""


_overall = "CASE WHEN list_contains([f0, f1, f2, f3], 'red') THEN 'NEEDS ATTENTION' WHEN list_contains([f0, f1, f2, f3], 'yellow') THEN 'ROOM FOR IMPROVEMENT' ELSE 'HEALTHY' END"
cte("scores", " UNION ALL ".join(scored(i) for i in ("general", "bakery", "mechanic")), "meas")
o("industry_scorecard", " UNION ALL ".join(f"SELECT client_id, period, industry, {_overall} AS overall, {i}::BIGINT AS position, {q(nm_)} AS metric, s{i} AS status, {text(v_)} AS value, f{i} AS flag, a{i} AS action, {'b0' if i == 0 else 'CAST(NULL AS DOUBLE)'} AS benchmark FROM scores WHERE s{i} IS NOT NULL"
  for i, (nm_, v_) in enumerate(zip(pnl_rules.METRICS, ("gm", "nm", "rp", "cp")))), "scores")
_acts = compact(*[(f"f{i} IN ('red', 'yellow') AND a{i} IS NOT NULL", f"a{i}") for i in range(4)])
o("recommendations", f"SELECT client_id, period, {_overall} AS overall, {join(_acts)} AS actions FROM scores WHERE industry = 'General Business'", "scores")
o("snapshot_metrics", f"""SELECT client_id, period, CAST(net_revenue AS VARCHAR) AS net_revenue, CAST(gross_profit AS VARCHAR) AS gross_profit, CAST(net_profit AS VARCHAR) AS net_profit, CAST(trunc(gm) AS BIGINT) AS gross_margin, CAST(trunc(nm) AS BIGINT) AS net_margin,
 {text('om')} AS operating_margin_pct, {text('cp')} AS cogs_pct, {text('rp')} AS rent_pct, CAST(total_opex AS VARCHAR) AS total_opex, transaction_count, flagged_count, {_overall} AS business_health, array_to_string(({_acts})[1:3], ' | ') AS top_actions FROM scores WHERE industry = 'General Business'""", "scores")
_mcol = {v: k for k, v in _mg.items()}
o("revenue_share_table", " UNION ALL ".join(f"SELECT client_id, period, {i}::BIGINT AS position, {q(lab)} AS label, CAST({a} AS VARCHAR) AS amount, {('NULL' if not p_ else q('100.00') if p_ == '100' else text(_mcol[p_]))} AS pct_of_revenue FROM meas"
  for i, (lab, a, p_) in enumerate(pnl_rules.line_items())), "meas")
