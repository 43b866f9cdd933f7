"""DuckDB SQL for the rows of the registered queries, built of common table expressions."""

from __future__ import annotations

from tallyspark.functions import dims
from tallyspark.sources import events_ledger


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


NORMAL = r"trim(regexp_replace(regexp_replace(upper(description), '[^A-Z0-9\s.*/-]', ' ', 'g'), '\s+', ' ', 'g'))"
DEDUP = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '\d{{4,}}', '#', 'g'), '[^A-Z0-9#\s]', ' ', 'g'), '\s+', ' ', 'g'))"
KEY = DEDUP.format("upper(description)")


def kind_case() -> str:
    out = [f"WHEN regexp_matches(n, {q('|'.join(f'(?:{p})' for p in dims.QRIS_PATTERNS))}) THEN 'qris'"]
    for kind, pattern, needed in dims.KIND_RULES:
        then = "CASE WHEN direction = 'credit' THEN 'transfer_in' ELSE 'transfer_out' END" if kind == "transfer" else q(kind)
        out.append(f"WHEN regexp_matches(n, {q(pattern)})" + (f" AND direction = {q(needed)}" if needed else "") + f" THEN {then}")
    return "CASE " + " ".join(out) + " ELSE 'other' END"


def entry_case(value) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(n, {q(k)})' for k in keys)} THEN {q(value(m, c))}" for m, c, keys in dims.MERCHANTS) + " END"


def lookup(column: str, at: int) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(r[0])} THEN {q(r[at])}" for r in dims.KIND_CATEGORY) + " END"


def titled(words: str) -> str:
    return f"array_to_string(list_transform({words}, lambda w: CASE WHEN w IN {listed(dims.ACRONYMS)} OR len(w) <= 2 THEN w ELSE concat(w[1], lower(w[2:])) END), ' ')"


WORD_CASE = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(n, {q(k)})' for k in keys)} THEN {q(c)}" for c, keys in dims.CATEGORY_KEYWORDS) + " END"
ACQUIRER = "CASE " + " ".join(f"WHEN contains(n, {q(a)}) THEN {q(a)}" for a in dims.ACQUIRERS) + " END"
DECIDES = f"kind IN {listed(dims.DECIDING_KINDS)}"


def classification(rows: str, columns: str) -> str:
    """CTEs tx and cat: columns of a table rows(description, direction, ...) with its classification."""
    return f"""c0 AS (SELECT *, {NORMAL} AS n FROM {rows}),
c1 AS (SELECT *, {kind_case()} AS kind, {entry_case(lambda m, c: m)} AS dm, {entry_case(lambda m, c: c)} AS dc, {WORD_CASE} AS word, {ACQUIRER} AS acquirer,
  nullif(regexp_extract(n, '\\bID\\s?(\\d{{13,15}})\\b', 1), '') AS nm, nullif(regexp_extract(n, '\\b(\\d{{12,}})\\b', 1), '') AS rf FROM c0),
c2 AS (SELECT *, nullif(array_to_string(list_filter(string_split(n, ' '), lambda w: len(w) >= 2 AND w NOT IN {listed(dims.NOISE_WORDS)} AND (acquirer IS NULL OR w <> acquirer)
    AND NOT regexp_full_match(w, '\\d+') AND NOT (regexp_matches(w, '\\d') AND len(w) > 5)), ' '), '') AS hint,
  list_filter(list_transform(string_split(array_to_string(list_transform(string_split(n, ' '), lambda w: CASE WHEN regexp_full_match(w, '[A-Z]{{2,}}') AND w NOT IN {listed(dims.STOP_WORDS)} THEN w ELSE '|' END), ' '), '|'), lambda r: trim(r)), lambda r: r <> '') AS runs FROM c1),
c3 AS (SELECT *, list_max(list_transform(runs, lambda r: len(string_split(r, ' ')))) AS longest FROM c2),
c4 AS (SELECT *, CASE WHEN kind IN ('transfer_in', 'transfer_out') THEN list_filter(runs, lambda r: len(string_split(r, ' ')) = longest)[-1] END AS pty FROM c3),
c5 AS (SELECT *, CASE WHEN len(pty) >= 4 THEN pty END AS party, CASE WHEN kind = 'topup' THEN dm END AS topped,
  CASE WHEN kind = 'qris' AND dm IS NULL AND NOT coalesce(regexp_matches(hint, '(^|\\s)[A-Z]{{3,}}(\\s|$)'), false) THEN 0 WHEN {DECIDES} THEN 1 WHEN dm IS NOT NULL THEN 2
    WHEN kind IN ('card', 'bill') THEN 3 WHEN word IS NOT NULL THEN 4 WHEN direction = 'credit' THEN 5 ELSE 6 END AS how,
  list_filter(string_split(n, ' '), lambda w: regexp_full_match(w, '[A-Z]{{2,}}') AND w NOT IN {listed(dims.FEE_NOISE)})[1:4] AS feew FROM c4),
tx AS (SELECT {columns}, kind, CASE WHEN kind = 'qris' THEN hint END AS hint, nm, rf, acquirer, n,
  CASE how WHEN 0 THEN {q(dims.NO_NAME)} WHEN 1 THEN CASE WHEN kind = 'fee' THEN CASE WHEN len(feew) = 0 THEN 'Biaya Bank' ELSE {titled('feew')} END ELSE coalesce(topped, {titled("string_split(party, ' ')")}, {lookup('kind', 2)}) END
    WHEN 2 THEN dm WHEN 3 THEN {lookup('kind', 2)} WHEN 4 THEN CASE WHEN kind = 'qris' THEN {titled("string_split(hint, ' ')")} END END AS merchant,
  CASE how WHEN 0 THEN 'lainnya' WHEN 1 THEN {lookup('kind', 1)} WHEN 2 THEN CASE WHEN kind = 'qris' AND dc = 'topup_ewallet' THEN 'makan_minum' ELSE dc END WHEN 3 THEN {lookup('kind', 1)} WHEN 4 THEN word WHEN 5 THEN 'pendapatan' ELSE 'lainnya' END AS category,
  CAST(CASE how WHEN 0 THEN 0.5 WHEN 1 THEN CASE WHEN topped IS NOT NULL OR party IS NOT NULL THEN 0.85 ELSE 0.8 END WHEN 2 THEN 0.95 WHEN 3 THEN 0.85 WHEN 4 THEN 0.6 WHEN 5 THEN 0.35 ELSE 0.1 END AS DOUBLE) AS confidence,
  CASE how WHEN 0 THEN 'rule' WHEN 1 THEN CASE WHEN topped IS NOT NULL THEN 'dictionary' ELSE 'rule' END WHEN 2 THEN 'dictionary' WHEN 3 THEN 'rule' WHEN 4 THEN 'rule' ELSE 'unknown' END AS source, how = 0 AS no_merchant_info,
  CASE how WHEN 0 THEN 'Statement tidak mencantumkan nama merchant' WHEN 2 THEN 'Cocok dengan kamus merchant' WHEN 4 THEN 'Cocok dengan kata kunci kategori' WHEN 5 THEN 'Uang masuk, sumber belum teridentifikasi' WHEN 6 THEN 'Belum teridentifikasi' ELSE {lookup('kind', 3)} END AS note FROM c5),
cat AS (SELECT * FROM (VALUES {', '.join(f'({q(i)}, {q(label)}, {q(g)}, {q(e)})' for i, label, g, e in dims.CATEGORIES)}) v(id, label, category_group, emoji))"""


#: CTEs led, files, tx: the ledger with its classification.
BASE = f"WITH {events_ledger.SQL},\n{classification('led', 'account_id, seq, date, description, amount, direction, raw_direction, balance')}"

NEEDS = "(NOT no_merchant_info AND source NOT IN ('manual', 'ai') AND (source = 'unknown' OR confidence < 0.6))"
SPENDING = f"(direction = 'debit' AND category NOT IN {listed(dims.NON_SPENDING)})"
IDENTIFIED = "(source <> 'unknown' AND confidence >= 0.5 AND NOT no_merchant_info)"


def money(x: str) -> str:
    return f"CAST(coalesce({x}, 0) AS DECIMAL(18,2))"


def ratio(a: str, b: str) -> str:
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0), 6)"


def total(test: str) -> str:
    return money(f"sum(CASE WHEN {test} THEN amount END)")


def grouped(keys: list[str]) -> str:
    return f" GROUP BY {', '.join(keys)}" if keys else ""


def comma(keys: list[str]) -> str:
    return "".join(f"{k}, " for k in keys)


def by_category(keys: list[str]) -> str:
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return f"""SELECT {comma(keys)}category, {money('sum(amount)')} AS total, count(*) AS n, {ratio('sum(amount)', f'sum(sum(amount)) OVER ({part})')} AS share, any_value(label) AS label, any_value(category_group) AS category_group, any_value(emoji) AS emoji
FROM tx JOIN cat ON category = id WHERE direction = 'debit' GROUP BY {comma(keys)}category"""


def by_merchant(keys: list[str]) -> str:
    return f"""SELECT {comma(keys)}coalesce(nullif(trim(merchant), ''), {q(dims.UNIDENTIFIED)}) AS merchant, {money('sum(amount)')} AS total, count(*) AS n, arg_min(category, (date, seq)) AS category, {ratio('sum(amount)', 'count(*)')} AS average
FROM tx WHERE direction = 'debit' GROUP BY {comma(keys)}coalesce(nullif(trim(merchant), ''), {q(dims.UNIDENTIFIED)})"""


def by_weekday() -> str:
    days = ", ".join(f"({i}, {q(d)})" for i, d in enumerate(dims.WEEKDAYS))
    return f"""SELECT a.account_id, weekday, CAST((weekday + 6) % 7 AS INTEGER) AS place, label, {money('sum(amount)')} AS total, count(amount) AS n, {ratio('sum(amount)', 'count(amount)')} AS average
FROM (SELECT DISTINCT account_id FROM tx) a CROSS JOIN (VALUES {days}) v(weekday, label) LEFT JOIN tx ON tx.account_id = a.account_id AND {SPENDING} AND dayofweek(date) = weekday GROUP BY ALL"""


RECURRING = f"""g AS (SELECT *, date - lag(date) OVER (PARTITION BY account_id, merchant ORDER BY date, seq) AS gap FROM tx WHERE direction = 'debit' AND trim(merchant) <> '' AND merchant NOT IN {listed([dims.UNIDENTIFIED, dims.NO_NAME, *dims.GENERIC_LABELS])}),
s AS (SELECT account_id, merchant, arg_max(category, (date, seq)) AS category, count(*) AS occurrences, avg(CAST(amount AS DOUBLE)) AS av, stddev_pop(CAST(amount AS DOUBLE)) AS sd, CAST(min(amount) AS DOUBLE) AS low, CAST(max(amount) AS DOUBLE) AS high, avg(gap) AS pace, stddev_pop(gap) AS unrest, max(date) AS last_date FROM g GROUP BY account_id, merchant),
rec AS (SELECT account_id, merchant, category, occurrences, round(av, 2) AS avg_amount, CAST(round(pace) AS BIGINT) AS interval_days, last_date, round(av * 30 / greatest(1.0, pace), 2) AS monthly_estimate, occurrences = 2 AS tentative FROM s
  WHERE av > 0 AND ((occurrences = 2 AND pace BETWEEN 25 AND 35 AND NOT ((high - low) / av > 0.1 AND high - low > 1000)) OR (occurrences >= 3 AND sd / av <= 0.2 AND pace BETWEEN 5 AND 45 AND unrest <= pace * 0.5)))"""


def anomalies(keys: list[str], rank: str, k: int) -> str:
    same = "".join(f"t.{x} = m.{x} AND " for x in keys)
    return f"""m AS (SELECT {comma(keys)}category, count(*) AS n, avg(CAST(amount AS DOUBLE)) AS mean, stddev_pop(CAST(amount AS DOUBLE)) AS sd FROM tx WHERE {SPENDING} GROUP BY {comma(keys)}category HAVING count(*) >= 5 AND stddev_pop(CAST(amount AS DOUBLE)) > 0),
o AS (SELECT t.account_id, t.seq, t.date, t.category, label, t.amount, round(CAST(t.amount AS DOUBLE) / mean, 6) AS ratio, row_number() OVER ({rank}) AS rk FROM tx t JOIN m ON {same}t.category = m.category JOIN cat ON t.category = id
  WHERE {SPENDING.replace('direction', 't.direction').replace('category', 't.category')} AND CAST(t.amount AS DOUBLE) >= mean + 2.5 * sd AND CAST(t.amount AS DOUBLE) >= 2 * mean)
SELECT account_id, seq, date, category, label, amount, ratio FROM o WHERE rk <= {k}"""


RECONCILED = """r0 AS (SELECT *, balance - lag(balance) OVER (PARTITION BY account_id ORDER BY seq) AS ch FROM led),
r1 AS (SELECT *, coalesce(abs(abs(ch) - amount) <= 1, false) AS sure, CASE WHEN ch >= 0 THEN 'credit' ELSE 'debit' END AS shown FROM r0),
rc AS (SELECT account_id, seq, date, description, amount, balance, CASE WHEN sure THEN shown ELSE raw_direction END AS direction, CAST(CASE WHEN sure THEN 1.0 ELSE 0.9 END AS DOUBLE) AS direction_confidence, sure AND shown <> raw_direction AS corrected FROM r1)"""


def folded(rows: str) -> str:
    """CTEs of a table rows with its fee rows folded, as fd: each row in turn grows the one it belongs to, or is one itself."""
    return f"""nm AS (SELECT account_id, seq, date, direction, description, amount, balance, row_number() OVER (PARTITION BY account_id ORDER BY seq) AS rn FROM {rows}),
fo AS (SELECT account_id, rn, seq, date, direction, description, amount, CAST(NULL AS DECIMAL(18,2)) AS fee, balance FROM nm WHERE rn = 1 UNION ALL
  SELECT n.account_id, n.rn, CASE WHEN q THEN f.seq ELSE n.seq END, n.date, n.direction, CASE WHEN q THEN f.description ELSE n.description END, CAST(CASE WHEN q THEN f.amount + n.amount ELSE n.amount END AS DECIMAL(18,2)),
    CAST(CASE WHEN q THEN coalesce(f.fee, 0) + n.amount END AS DECIMAL(18,2)), CASE WHEN q THEN coalesce(n.balance, f.balance) ELSE n.balance END
  FROM fo f JOIN nm n ON n.account_id = f.account_id AND n.rn = f.rn + 1,
  LATERAL (SELECT n.date = f.date AND n.direction = 'debit' AND f.direction = 'debit' AND upper(n.description) = upper(f.description) AND n.amount < f.amount AND n.amount <= 25000 AND n.amount <= f.amount * 0.1 AS q) k),
fd AS (SELECT * EXCLUDE (rn) FROM fo QUALIFY row_number() OVER (PARTITION BY account_id, seq ORDER BY rn DESC) = 1)"""
