"""SQL for the same results, written apart from the Spark code and run by another engine.

``BASE`` derives every table from ``events`` in named steps; a query picks from one of them.
"""

from __future__ import annotations

from tollguard import adapter, lookups, schemas
from tollguard.plans import quality

ORACLES: dict[str, str] = {}


def _values(rows) -> str:
    def literal(value) -> str:
        return repr(value) if isinstance(value, float) else "'" + str(value).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)


def _pick(values, index: str) -> str:
    items = ", ".join("'" + v + "'" for v in values)
    return f"([{items}])[({index}) + 1]"


def _band(hour: str) -> str:
    return f"""CASE WHEN {hour} BETWEEN 0 AND 5 THEN 'Night' WHEN {hour} BETWEEN 6 AND 8
        THEN 'Morning Rush' WHEN {hour} BETWEEN 9 AND 11 THEN 'Morning' WHEN {hour} BETWEEN 12 AND 14
        THEN 'Midday' WHEN {hour} BETWEEN 15 AND 18 THEN 'Evening Rush' WHEN {hour} BETWEEN 19 AND 21
        THEN 'Evening' ELSE 'Late Night' END"""


def _codes(codes) -> str:
    return ", ".join(f"'{c}'" for c in codes)


def _std(n: str, total: str, squares: str) -> str:
    return (
        f"CASE WHEN {n} > 1 THEN sqrt(greatest({n} * {squares} - {total} * {total}, 0)::DOUBLE"
        f" / ({n}::DOUBLE * ({n} - 1))) / 100 END"
    )


def _parsed(column: str, format: str) -> str:
    return f"try_strptime({column}, '{format}')"


K = "regexp_extract(props, '([0-9]+)', 1)::INT"
LEAVE = "date_trunc('second', ts)"
ENTER = f"({LEAVE} - to_minutes(event_id % 45))"
SECOND = "'%Y-%m-%d %H:%M:%S'"
CENTS = "round(amount * 100)"
BAD = _pick(adapter.BAD_AMOUNTS, f"event_id // 101 % {len(adapter.BAD_AMOUNTS)}")


def _number(column: str) -> str:
    return f"CASE WHEN regexp_full_match({column}, '[+-]?[0-9]+([.][0-9]*)?') THEN {column}::DOUBLE END"



_known = list(enumerate(adapter.PLAZA_CYCLE[:-1]))
_miles = [(a, b, 5.0 * abs(i - j)) for i, a in _known for j, b in _known if i != j]

BRONZE = f"""
bronze AS (
  SELECT strftime(ts::DATE + 2, '%Y-%m-%d') AS posting_date,
    strftime(ts, '%Y-%m-%d') AS transaction_date,
    CASE WHEN event_id % 97 = 0 THEN '-' ELSE ' t' || user_id END AS tag_plate_number,
    {_pick(adapter.AGENCY_CYCLE, f'{K} % 6')} AS agency,
    CASE WHEN event_type = 'error' THEN 'FEE' ELSE 'TOLL' END AS description,
    CASE WHEN event_id % 50 = 0 THEN '-' ELSE strftime({ENTER}, {SECOND}) END AS entry_time,
    {_pick(adapter.PLAZA_CYCLE, f'{K} % 5')} AS entry_plaza,
    (event_id % 9)::VARCHAR AS entry_lane,
    CASE WHEN event_id % 89 = 0 THEN strftime(ts, '%Y-%m-%d 00:00:00')
      ELSE strftime({LEAVE}, {SECOND}) END AS exit_time,
    {_pick(adapter.PLAZA_CYCLE, f'{K} % 7')} AS exit_plaza,
    '-' AS exit_lane,
    {_pick(adapter.VEHICLE_CYCLE, 'event_id % 4')} AS vehicle_type_code,
    CASE WHEN event_id % 101 = 0 THEN {BAD} ELSE '-' || value END AS amount,
    'Y' AS prepaid, 'STANDARD' AS plan_rate,
    {_pick(adapter.FARE_CYCLE, 'event_id % 3')} AS fare_type,
    '100.00' AS balance, '2024-02-01 00:00:00' AS loaded_at,
    'transaction_2024_01.csv' AS source_file
  FROM events),
day_text AS (
  SELECT *, CASE WHEN event_id % 103 = 0 THEN '13/45/2024'
    WHEN event_id % 2 = 0 THEN strftime(ts, '%m/%d/%Y')
    ELSE month(ts) || '/' || day(ts) || '/' || year(ts) END AS day_us,
    CASE WHEN event_id % 50 = 0 THEN '-' ELSE strftime({ENTER}, '%H:%M:%S') END AS enter_clock,
    CASE WHEN event_id % 89 = 0 THEN '25:61:00' ELSE strftime({LEAVE}, '%H:%M:%S') END AS leave_clock,
    printf('%,.2f', value * 10) AS money
  FROM events),
statements AS (
  SELECT strftime(ts::DATE + 2, '%m/%d/%Y') AS "POSTING DATE", day_us AS "TRANSACTION DATE",
    ' t' || user_id AS "TAG/PLATE NUMBER", {_pick(adapter.AGENCY_CYCLE, f'{K} % 6')} AS "AGENCY",
    'TOLL' AS "DESCRIPTION", enter_clock AS "ENTRY TIME",
    {_pick(adapter.PLAZA_CYCLE, f'{K} % 5')} AS "ENTRY PLAZA",
    (event_id % 9)::VARCHAR AS "ENTRY LANE", leave_clock AS "EXIT TIME",
    {_pick(adapter.PLAZA_CYCLE, f'{K} % 7')} AS "EXIT PLAZA", '-' AS "EXIT LANE",
    {_pick(adapter.VEHICLE_CYCLE, 'event_id % 4')} AS "VEHICLE TYPE CODE",
    CASE WHEN event_id % 101 = 0 THEN {BAD} WHEN event_id % 2 = 0 THEN '($' || money || ')'
      ELSE ' $' || money END AS "AMOUNT",
    'Y' AS "PREPAID", 'STANDARD' AS "PLAN/RATE",
    {_pick(adapter.FARE_CYCLE, 'event_id % 3')} AS "FARE TYPE", '$1,000.50' AS "BALANCE"
  FROM day_text),
normalized AS (
  SELECT event_id, strftime(ts::DATE + 2, '%Y-%m-%d') AS posting_date,
    CASE WHEN event_id % 103 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS transaction_date,
    CASE WHEN event_id % 103 <> 0 AND event_id % 50 <> 0
      THEN strftime(ts, '%Y-%m-%d ') || enter_clock END AS entry_time,
    CASE WHEN event_id % 103 <> 0 AND event_id % 89 <> 0
      THEN strftime({LEAVE}, {SECOND}) END AS exit_time,
    ' t' || user_id AS tag_plate_number, {_pick(adapter.AGENCY_CYCLE, f'{K} % 6')} AS agency,
    'TOLL' AS description, {_pick(adapter.PLAZA_CYCLE, f'{K} % 5')} AS entry_plaza,
    (event_id % 9)::VARCHAR AS entry_lane, {_pick(adapter.PLAZA_CYCLE, f'{K} % 7')} AS exit_plaza,
    '-' AS exit_lane, {_pick(adapter.VEHICLE_CYCLE, 'event_id % 4')} AS vehicle_type_code,
    'Y' AS prepaid, 'STANDARD' AS plan_rate,
    {_pick(adapter.FARE_CYCLE, 'event_id % 3')} AS fare_type,
    CASE WHEN event_id % 101 <> 0 THEN (replace(money, ',', '')::DOUBLE
      * CASE WHEN event_id % 2 = 0 THEN -1 ELSE 1 END)::VARCHAR END AS amount,
    '1000.5' AS balance, '2024-02-01 00:00:00' AS loaded_at
  FROM day_text)"""

SILVER = f"""
cleaned AS (
  SELECT {_parsed('transaction_date', '%Y-%m-%d')}::DATE AS transaction_date,
    {_parsed('posting_date', '%Y-%m-%d')}::DATE AS posting_date,
    CASE WHEN strftime({_parsed('entry_time', SECOND.strip("'"))}, '%H%M%S') <> '000000'
      THEN {_parsed('entry_time', SECOND.strip("'"))} END AS entry_time,
    CASE WHEN strftime({_parsed('exit_time', SECOND.strip("'"))}, '%H%M%S') <> '000000'
      THEN {_parsed('exit_time', SECOND.strip("'"))} END AS exit_time,
    nullif(upper(trim(tag_plate_number)), '-') AS tag_plate_number,
    nullif(upper(trim(agency)), '-') AS agency, nullif(trim(description), '-') AS description,
    nullif(upper(trim(entry_plaza)), '-') AS entry_plaza, nullif(trim(entry_lane), '-') AS entry_lane,
    nullif(upper(trim(exit_plaza)), '-') AS exit_plaza, nullif(trim(exit_lane), '-') AS exit_lane,
    coalesce(nullif(trim(vehicle_type_code), '-'), '1') AS vehicle_type_code,
    nullif(trim(plan_rate), '-') AS plan_rate, nullif(trim(prepaid), '-') AS prepaid,
    nullif(trim(fare_type), '-') AS fare_code,
    CASE nullif(trim(fare_type), '-') WHEN 'N' THEN 'Normal' WHEN 'M' THEN 'Medium'
      ELSE nullif(trim(fare_type), '-') END AS fare_type,
    abs({_number('amount')}) AS amount, {_number('balance')} AS balance,
    {_parsed('loaded_at', SECOND.strip("'"))} AS loaded_at, source_file
  FROM bronze WHERE transaction_date IS NOT NULL),
agencies(agency, agency_name, state_name) AS (VALUES {_values(lookups.AGENCIES)}),
plazas(plaza, plaza_name) AS (VALUES {_values(lookups.PLAZAS)}),
holidays AS (SELECT unnest(['2024-01-01', '2024-01-15'])::DATE AS holiday_date),
distances(origin_plaza, destination_plaza, miles) AS (
  SELECT * REPLACE (col2::DOUBLE AS col2) FROM (VALUES {_values(_miles)})),
hours AS (
  SELECT c.*, a.agency_name, a.state_name, n.plaza_name AS entry_plaza_name,
    x.plaza_name AS exit_plaza_name, hour(entry_time) AS entry_hour, hour(exit_time) AS exit_hour,
    md5(coalesce(strftime(transaction_date, '%Y-%m-%d'), 'NULL') || '|' ||
      coalesce(strftime(entry_time, {SECOND}), 'NULL') || '|' ||
      coalesce(strftime(exit_time, {SECOND}), 'NULL') || '|' ||
      coalesce(tag_plate_number, 'NULL') || '|' || coalesce(entry_plaza, 'NULL') || '|' ||
      coalesce(exit_plaza, 'NULL') || '|' || coalesce({CENTS}::BIGINT::VARCHAR, 'NULL'))
      AS transaction_id
  FROM cleaned c LEFT JOIN agencies a USING (agency)
    LEFT JOIN plazas n ON n.plaza = c.entry_plaza LEFT JOIN plazas x ON x.plaza = c.exit_plaza
  WHERE description = 'TOLL'),
trips AS (
  SELECT *, coalesce(dayofweek(transaction_date) IN (0, 6), FALSE) AS flag_is_weekend,
    CASE WHEN dayofweek(transaction_date) IN (0, 6) THEN 'Weekend' ELSE 'Weekday' END
      AS weekend_or_weekday,
    {_band('entry_hour')} AS entry_time_of_day, {_band('exit_hour')} AS exit_time_of_day,
    {_band('entry_hour')} || ' to ' || {_band('exit_hour')} AS travel_time_of_day,
    coalesce(entry_hour IN (6, 7, 8, 15, 16, 17, 18), FALSE)
      OR coalesce(exit_hour IN (6, 7, 8, 15, 16, 17, 18), FALSE) AS flag_rush_hour,
    CASE WHEN vehicle_type_code IN ({_codes(lookups.PASSENGER_CODES)}) THEN 'Passenger Vehicle'
      WHEN vehicle_type_code IN ({_codes(lookups.LIGHT_COMMERCIAL_CODES)}) THEN 'Light Commercial'
      WHEN vehicle_type_code IN ({_codes(lookups.HEAVY_COMMERCIAL_CODES)}) THEN 'Heavy Commercial'
      ELSE 'Unknown' END AS vehicle_type_name,
    vehicle_type_code IN ({_codes(lookups.LIGHT_COMMERCIAL_CODES + lookups.HEAVY_COMMERCIAL_CODES)})
      AS flag_vehicle_type,
    CASE state_name WHEN 'NJ' THEN FALSE ELSE TRUE END AS flag_outstate,
    transaction_date IN (SELECT holiday_date FROM holidays) AS flag_is_holiday
  FROM hours),
sequenced AS (
  SELECT *, count(*) OVER (PARTITION BY tag_plate_number, transaction_date) AS driver_daily_txn_count,
    lag(entry_plaza) OVER by_exit AS entry_plaza_previous,
    lag(exit_plaza) OVER by_exit AS exit_plaza_previous,
    lag(entry_time) OVER by_exit AS entry_time_previous,
    lag(exit_time) OVER by_exit AS exit_time_previous,
    count(*) OVER recent AS driver_amount_last_30txn_count, count(amount) OVER recent AS n30,
    sum({CENTS}::BIGINT) OVER recent AS c30, sum({CENTS}::BIGINT * {CENTS}::BIGINT) OVER recent AS q30,
    min(amount) OVER recent AS driver_amount_last_30txn_min,
    max(amount) OVER recent AS driver_amount_last_30txn_max
  FROM trips
  WINDOW by_exit AS (PARTITION BY tag_plate_number
      ORDER BY exit_time ASC NULLS LAST, transaction_id, source_file),
    recent AS (PARTITION BY tag_plate_number
      ORDER BY coalesce(entry_time, TIMESTAMP '1900-01-01'), transaction_id, source_file
      ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
history AS (
  SELECT *, coalesce(exit_plaza_previous, 'Unknown') || ' to ' || exit_plaza AS route_name,
    c30::DOUBLE / nullif(n30, 0) / 100 AS driver_amount_last_30txn_avg,
    {_std('n30', 'c30', 'q30')} AS driver_amount_last_30txn_std,
    date_sub('minute', exit_time_previous, exit_time) AS travel_time_minutes,
    coalesce(entry_time < exit_time_previous, FALSE) AS flag_overlapping_journey,
    CASE WHEN entry_time < exit_time_previous
      THEN date_sub('minute', entry_time, exit_time_previous) ELSE 0 END
      AS overlapping_journey_duration_minutes
  FROM sequenced),
route_table AS (
  SELECT route_name, vehicle_type_code, count(*) AS route_transaction_count,
    sum({CENTS}::BIGINT)::DOUBLE / nullif(count(amount), 0) / 100 AS route_amount_avg,
    {_std('count(amount)', f'sum({CENTS}::BIGINT)', f'sum({CENTS}::BIGINT * {CENTS}::BIGINT)')}
      AS route_amount_std,
    min(amount) AS route_amount_min, max(amount) AS route_amount_max,
    list_sort(list(amount) FILTER (WHERE amount IS NOT NULL)) AS prices
  FROM history GROUP BY ALL),
route_priced AS (
  SELECT * EXCLUDE (prices), CASE WHEN route_transaction_count >= 30 THEN
      prices[(len(prices) + 1) // 2] * 0.5::DOUBLE + prices[len(prices) // 2 + 1] * 0.5::DOUBLE END
      AS route_amount_med
  FROM route_table),
silver_wide AS (
  SELECT h.*, r.* EXCLUDE (route_name, vehicle_type_code), 'Unknown' AS route_instate,
    NULL::DOUBLE AS distance_miles, NULL::DOUBLE AS speed_mph,
    NULL::DOUBLE AS min_required_travel_time_minutes, NULL::BOOLEAN AS is_impossible_travel,
    travel_time_minutes < 5 AS is_rapid_succession,
    CASE WHEN travel_time_minutes < 0 THEN 'Invalid (Negative)'
      WHEN travel_time_minutes < 10 THEN 'Short (<10 min)'
      WHEN travel_time_minutes < 30 THEN 'Medium (10-30 min)'
      WHEN travel_time_minutes < 60 THEN 'Long (30-60 min)'
      WHEN travel_time_minutes >= 60 THEN 'Very Long (60+ min)' END AS travel_time_category,
    loaded_at AS last_updated
  FROM history h JOIN route_priced r ON h.route_name IS NOT DISTINCT FROM r.route_name
    AND h.vehicle_type_code IS NOT DISTINCT FROM r.vehicle_type_code),
distanced AS (
  SELECT h.*, d.miles AS distance_miles,
    CASE WHEN exit_plaza IN (SELECT origin_plaza FROM distances)
      AND exit_plaza_previous IN (SELECT origin_plaza FROM distances)
      THEN 'In-state' ELSE 'Unknown' END AS route_instate
  FROM history h LEFT JOIN distances d ON d.origin_plaza = h.exit_plaza_previous
    AND d.destination_plaza = h.exit_plaza),
travelled AS (
  SELECT *,
    CASE WHEN travel_time_minutes > 0 THEN distance_miles / travel_time_minutes * 60 END AS speed_mph,
    CASE WHEN distance_miles > 0 THEN distance_miles / 88.0::DOUBLE * 60 END
      AS min_required_travel_time_minutes,
    CASE WHEN distance_miles IS NULL OR travel_time_minutes IS NULL THEN NULL
      WHEN travel_time_minutes <= 0 THEN TRUE
      WHEN distance_miles > 0 AND travel_time_minutes < distance_miles / 90.0::DOUBLE * 60 THEN TRUE
      WHEN distance_miles / travel_time_minutes * 60 >= 100 THEN TRUE ELSE FALSE END
      AS is_impossible_travel,
    travel_time_minutes < 5 AS is_rapid_succession,
    CASE WHEN travel_time_minutes < 0 THEN 'Invalid (Negative)'
      WHEN travel_time_minutes < 10 THEN 'Short (<10 min)'
      WHEN travel_time_minutes < 30 THEN 'Medium (10-30 min)'
      WHEN travel_time_minutes < 60 THEN 'Long (30-60 min)'
      WHEN travel_time_minutes >= 60 THEN 'Very Long (60+ min)' END AS travel_time_category
  FROM distanced)"""

GOLD = f"""
medians AS (
  SELECT tag_plate_number, quantile_disc(amount, 0.5) AS driver_amount_median
  FROM trips GROUP BY ALL),
spend AS (
  SELECT tag_plate_number, transaction_date, sum({CENTS}::BIGINT) AS day_cents,
    sum({CENTS}::BIGINT)::DOUBLE / 100 AS driver_today_spend
  FROM trips GROUP BY ALL),
spend_30 AS (
  SELECT *, (sum(day_cents) OVER month_before)::DOUBLE
      / nullif(count(day_cents) OVER month_before, 0) / 100 AS driver_avg_daily_spend_30d
  FROM spend
  WINDOW month_before AS (PARTITION BY tag_plate_number ORDER BY transaction_date
    RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)),
deviated AS (
  SELECT s.*, driver_amount_median, driver_today_spend, driver_avg_daily_spend_30d,
    (amount - driver_amount_median) / nullif(driver_amount_last_30txn_std, 0)
      AS driver_amount_modified_z_score,
    (amount - driver_amount_last_30txn_avg) / nullif(driver_amount_last_30txn_avg, 0) * 100
      AS amount_deviation_from_avg_pct,
    (amount - driver_amount_median) / nullif(driver_amount_median, 0)
      AS amount_deviation_from_median_pct,
    (amount - route_amount_avg) / nullif(route_amount_std, 0) AS route_amount_z_score
  FROM silver_wide s LEFT JOIN medians m ON m.tag_plate_number = s.tag_plate_number
    LEFT JOIN spend_30 p ON p.tag_plate_number = s.tag_plate_number
      AND p.transaction_date = s.transaction_date),
flagged AS (
  SELECT *, coalesce(driver_amount_modified_z_score > 1, FALSE) AS flag_driver_amount_outlier,
    coalesce(abs(route_amount_z_score) > 1, FALSE) AS flag_route_amount_outlier,
    coalesce(amount_deviation_from_avg_pct > 80, FALSE)
      OR coalesce(amount_deviation_from_median_pct > 80, FALSE) AS flag_amount_unusually_high,
    CASE WHEN driver_avg_daily_spend_30d IS NOT NULL
      AND (driver_today_spend > 3 * driver_avg_daily_spend_30d
        OR driver_today_spend = driver_amount_last_30txn_max)
      AND amount >= 50 THEN TRUE ELSE FALSE END AS flag_driver_spend_spike
  FROM deviated),
scored AS (
  SELECT *, CASE WHEN flag_driver_amount_outlier THEN 80 ELSE 0 END
    + CASE WHEN flag_route_amount_outlier THEN 10 ELSE 0 END
    + CASE WHEN flag_amount_unusually_high THEN 5 ELSE 0 END
    + CASE WHEN flag_driver_spend_spike THEN 5 ELSE 0 END AS points
  FROM flagged),
gold AS (SELECT *, points::BIGINT AS anomaly_score FROM scored),
encoded AS (
  SELECT g.*,
    CASE WHEN route_name IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY route_name) END
      AS route_name_freq_encoded,
    CASE WHEN entry_plaza IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY entry_plaza) END
      AS entry_plaza_freq_encoded,
    CASE WHEN exit_plaza IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY exit_plaza) END
      AS exit_plaza_freq_encoded,
    count(*) OVER (PARTITION BY vehicle_type_code) AS vehicle_type_freq_encoded,
    CASE WHEN agency IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY agency) END
      AS agency_freq_encoded,
    count(*) OVER (PARTITION BY travel_time_of_day) AS travel_time_of_day_freq_encoded
  FROM gold g),
predictions AS (
  SELECT *, -coalesce(driver_amount_modified_z_score, 0) AS ml_anomaly_score,
    CASE WHEN anomaly_score >= 80 THEN 1 ELSE 0 END AS is_anomaly,
    TIMESTAMP '{adapter.PREDICTED_AT}' AS prediction_timestamp
  FROM encoded),
placed AS (
  SELECT ml_anomaly_score, row_number() OVER (ORDER BY ml_anomaly_score) AS place,
    count(*) OVER () AS total FROM predictions),
limits AS (
  SELECT min(ml_anomaly_score) FILTER (WHERE place * 100 >= total) AS p1,
    min(ml_anomaly_score) FILTER (WHERE place * 100 >= 5 * total) AS p5,
    min(ml_anomaly_score) FILTER (WHERE place * 100 >= 25 * total) AS p25
  FROM placed),
ranked AS (
  SELECT p.*, l.*, CASE WHEN ml_anomaly_score <= p1 THEN 'Critical Risk'
      WHEN ml_anomaly_score <= p5 THEN 'Medium Risk' WHEN ml_anomaly_score <= p25 THEN 'Low Risk'
      ELSE 'No Risk' END AS anomaly_category,
    percent_rank() OVER (ORDER BY ml_anomaly_score) AS score_percentile_rank
  FROM predictions p, limits l),
master AS (
  SELECT CASE WHEN lower(anomaly_category) IN ('high risk', 'critical risk') THEN 'Needs Review'
      WHEN anomaly_category IS NOT NULL THEN 'No Action Required' END AS status,
    anomaly_score AS rule_based_score, ml_anomaly_score AS ml_predicted_score,
    anomaly_category AS ml_predicted_category, *
  FROM ranked),
order_spend AS (
  SELECT o_custkey::VARCHAR AS tag_plate_number, o_orderdate::DATE AS transaction_date,
    o_totalprice AS amount FROM orders),
order_months AS (
  SELECT strftime(transaction_date, '%Y-%m') AS month, count(*) AS total_transactions,
    count(*) FILTER (WHERE amount > 400000) AS total_alerts,
    coalesce(sum({CENTS}::BIGINT) FILTER (WHERE amount > 400000), 0)::DOUBLE / 100 AS total_loss
  FROM order_spend WHERE transaction_date IS NOT NULL GROUP BY ALL)"""

ID_CODE = "('0x' || substr(transaction_id, 1, 4))::BIGINT"
REVIEW = f"""
turns AS (
  SELECT transaction_id, {ID_CODE} AS digit, unnest(range(0, {ID_CODE} % 3 + 1)) AS turn FROM master),
requests AS (
  SELECT CASE WHEN digit % 11 = 0 THEN 'x' || transaction_id WHEN digit % 13 <> 0
      THEN transaction_id END AS transaction_id,
    {_pick(adapter.STATUS_CYCLE, 'floor(digit / 7.0 + turn * 3)::BIGINT % 5')} AS new_status,
    digit * 10 + (turn * 7) % 3 AS seq
  FROM turns),
ordered AS (
  SELECT r.*, m.status, row_number() OVER (PARTITION BY r.transaction_id ORDER BY seq, new_status)
    AS place
  FROM requests r JOIN master m USING (transaction_id)),
replay AS (
  WITH RECURSIVE fold AS (
    SELECT transaction_id, 0::BIGINT AS place, NULL::VARCHAR AS met, status, FALSE AS accepted,
      NULL::BIGINT AS seq, NULL::VARCHAR AS new_status
    FROM (SELECT DISTINCT transaction_id, status FROM ordered)
    UNION ALL
    SELECT f.transaction_id, o.place, f.status,
      CASE WHEN {{ok}} THEN o.new_status ELSE f.status END, {{ok}}, o.seq, o.new_status
    FROM fold f JOIN ordered o ON o.transaction_id = f.transaction_id AND o.place = f.place + 1)
  SELECT * FROM fold)""".replace(
    "{ok}",
    "(f.status IS NULL OR (f.status = 'Needs Review' AND o.new_status IN ('Resolved - Not Fraud',"
    " 'Investigating', 'Resolved - Fraud')) OR (f.status = 'Investigating' AND o.new_status IN"
    " ('Resolved - Not Fraud', 'Resolved - Fraud')))",
)


def _add(name: str, select: str, *parts: str) -> None:
    steps = ",".join(parts or (BRONZE, SILVER))
    ORACLES[name] = f"WITH {steps}{'' if select.startswith(',') else chr(10)}{select}"


def _columns(table: str, names: str, *parts: str, key: str = "transaction_id") -> None:
    """One query per name: the key and that column."""
    for name in names.split():
        _add(name, f"SELECT {key}, {name} FROM {table}", *parts)


ALL = (BRONZE, SILVER, GOLD)

_add("read_statements", "SELECT * FROM statements", BRONZE)
_add("normalize_headers", """SELECT "POSTING DATE" AS posting_date, "TRANSACTION DATE" AS
  transaction_date, "TAG/PLATE NUMBER" AS tag_plate_number, "AGENCY" AS agency, "DESCRIPTION" AS
  description, "ENTRY TIME" AS entry_time, "ENTRY PLAZA" AS entry_plaza, "ENTRY LANE" AS entry_lane,
  "EXIT TIME" AS exit_time, "EXIT PLAZA" AS exit_plaza, "EXIT LANE" AS exit_lane,
  "VEHICLE TYPE CODE" AS vehicle_type_code, "AMOUNT" AS amount, "PREPAID" AS prepaid,
  "PLAN/RATE" AS plan_rate, "FARE TYPE" AS fare_type, "BALANCE" AS balance, 'kept' AS "Extra"
  FROM statements""", BRONZE)
_add("normalize_dates", f"""SELECT n.posting_date, n.transaction_date, CASE WHEN event_id % 101 = 0
  THEN {BAD} WHEN event_id % 2 = 0 THEN '($' || money || ')' ELSE ' $' || money END AS amount
  FROM normalized n JOIN day_text USING (event_id)""", BRONZE)
_add("normalize_times", "SELECT transaction_date, entry_time, exit_time FROM normalized", BRONZE)
_add("normalize_money", "SELECT tag_plate_number, amount, balance FROM normalized", BRONZE)
ORACLES["add_lineage"] = """SELECT event_id, '2024-02-01 00:00:00' AS loaded_at,
  'events.parquet' AS source_file FROM events"""
ORACLES["statement_period"] = """WITH names AS (
  SELECT event_id, ts, (['January', 'feb', 'MARCH', 'apr', 'may', 'June', 'jul', 'August', 'sept',
    'Oct', 'nov', 'December', 'Smarch'])[event_id % 13 + 1] AS month_word FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, 'transaction_%Y_%m.csv')
    WHEN 1 THEN strftime(ts, 'statement-%Y-%m-final.csv') WHEN 2 THEN strftime(ts, 'st%Y%m.csv')
    WHEN 3 THEN 'Transactions ' || month_word || ' ' || year(ts) || '.csv'
    ELSE 'statement.csv' END AS source_file,
  CASE WHEN event_id % 5 < 3 OR (event_id % 5 = 3 AND month_word <> 'Smarch') THEN year(ts)
    ELSE 2024 END::INT AS statement_year,
  CASE WHEN event_id % 5 < 3 THEN month(ts) WHEN event_id % 5 = 3 AND month_word <> 'Smarch'
    THEN event_id % 13 + 1 ELSE 2 END::INT AS statement_month
FROM names"""
ORACLES["new_files_only"] = """SELECT DISTINCT strftime(ts, 'transaction_%Y-%m-%d.csv') AS name
  FROM events WHERE day(ts) % 2 = 1"""
_add("append_bronze", "SELECT * FROM bronze", BRONZE)
_add("verify_load", f"""SELECT count(*) AS total_rows, count(DISTINCT source_file) AS unique_files,
  min(transaction_date) AS earliest_transaction, max(transaction_date) AS latest_transaction,
  sum(round({_number('amount')} * 100)::BIGINT)::DOUBLE / 100 AS total_amount FROM bronze""",
     BRONZE)
_add("write_partitioned", "SELECT transaction_id, transaction_date, tag_plate_number, amount FROM trips")
_add("write_predictions", """SELECT transaction_id, amount, exit_hour, vehicle_type_code,
  agency_freq_encoded, ml_anomaly_score, prediction_timestamp::DATE AS prediction_date
  FROM predictions""", *ALL)
_add("dedupe_bronze", """, loads AS (
  SELECT * FROM bronze
  UNION ALL BY NAME SELECT * REPLACE ('2024-02-02 00:00:00' AS loaded_at, 'again.csv' AS source_file)
    FROM bronze WHERE entry_lane IN ('0', '3')
  UNION ALL BY NAME SELECT * REPLACE ('older.csv' AS source_file) FROM bronze WHERE entry_lane = '1')
SELECT * FROM loads QUALIFY row_number() OVER (PARTITION BY transaction_date, tag_plate_number,
  entry_time, entry_plaza, exit_time, exit_plaza, amount, agency
  ORDER BY loaded_at DESC, source_file, posting_date, description, entry_lane, exit_lane,
    vehicle_type_code, prepaid, plan_rate, fare_type, balance) = 1""", BRONZE)
_add("stream_ingest", "SELECT * EXCLUDE (event_id) FROM normalized", BRONZE)
_add("stream_after_batch", """SELECT * EXCLUDE (source_file) FROM bronze
  UNION ALL BY NAME SELECT * EXCLUDE (event_id) FROM normalized
  UNION ALL BY NAME SELECT * EXCLUDE (source_file) FROM bronze WHERE entry_lane = '1'""", BRONZE)
ORACLES["rejected_rows"] = """SELECT event_id || repeat(',', 17) AS record,
  '2024-02-01 00:00:00' AS loaded_at FROM events WHERE event_id % 997 = 0"""
_add("read_quoted_statements", """SELECT * REPLACE (DESCRIPTION || ' "x",' || chr(10) || 'of ' || AGENCY AS DESCRIPTION)
  FROM statements""", BRONZE)
_add("ledger_load", """SELECT tag_plate_number, transaction_date, exit_time, amount, loaded_at,
  NULL::VARCHAR AS record FROM normalized WHERE event_id % 997 <> 0
  UNION ALL SELECT NULL, NULL, NULL, NULL, '2024-02-01 00:00:00', event_id || repeat(',', 17)
  FROM events WHERE event_id % 997 = 0""", BRONZE)
_add("load_statements", f"""SELECT count(*) AS total_rows, min(transaction_date) AS earliest_transaction,
  max(transaction_date) AS latest_transaction,
  sum(round({_number('amount')} * 100)::BIGINT)::DOUBLE / 100 AS total_amount FROM normalized""", BRONZE)

_add("parse_dates", """SELECT transaction_date::DATE AS transaction_date, posting_date::DATE AS
  posting_date, exit_time FROM bronze""", BRONZE)
_add("parse_times_midnight_null", """SELECT b.tag_plate_number, c.entry_time, c.exit_time, c.loaded_at
  FROM bronze b POSITIONAL JOIN cleaned c""")
_add("clean_text", """SELECT tag_plate_number, agency, description, entry_plaza, entry_lane,
  exit_plaza, exit_lane, plan_rate, prepaid, fare_code AS fare_type FROM cleaned""")
_add("default_vehicle_code", """SELECT exit_time, CASE WHEN vehicle_type_code = '-' THEN '1'
  ELSE vehicle_type_code END AS vehicle_type_code FROM bronze""", BRONZE)
_add("clean_amount", f"""SELECT exit_time, abs({_number('amount')}) AS amount,
  {_number('balance')} AS balance FROM bronze""", BRONZE)
_add("filter_dated", """SELECT CASE WHEN day(transaction_date::DATE) % 3 = 2
  THEN transaction_date::DATE END AS transaction_date, exit_time, amount FROM bronze
  WHERE day(transaction_date::DATE) % 3 <> 0""", BRONZE)
_add("filter_tolls", """SELECT description, tag_plate_number, amount FROM cleaned
  WHERE description = 'TOLL'""")
_add("map_fare_type", "SELECT entry_time, fare_type FROM cleaned")
_add("enrich_agency", "SELECT transaction_id, agency, agency_name, state_name FROM trips")
_add("enrich_plaza", """SELECT transaction_id, entry_plaza, entry_plaza_name, exit_plaza,
  exit_plaza_name FROM trips""")
_add("transaction_id", "SELECT transaction_id, transaction_date, amount FROM trips")
_columns("trips", """weekend_or_weekday flag_is_weekend travel_time_of_day flag_rush_hour entry_hour
  exit_hour vehicle_type_name flag_vehicle_type flag_outstate""")
_add("time_of_day", "SELECT transaction_id, entry_time_of_day, exit_time_of_day FROM trips")
_add("flag_is_holiday", "SELECT transaction_id, transaction_date, flag_is_holiday FROM trips")


def _table(name: str, columns: list[str], source: str, *parts: str) -> None:
    _add(name, f"SELECT {', '.join(columns)} FROM {source}", *parts)


_table("silver_select", schemas.SILVER_COLUMNS, "silver_wide")
_table("gold_select", schemas.GOLD_COLUMNS, "gold", *ALL)
_table("gold_rulebased", schemas.GOLD_RULEBASED_COLUMNS, "gold", *ALL)
_table("gold_train", schemas.TRAIN_COLUMNS, "encoded", *ALL)
_table("pred_viz", [
    c.replace("score_p", "p").removesuffix("_threshold") + f" AS {c}" if c.endswith("_threshold")
    else c for c in schemas.PRED_VIZ_COLUMNS
], "ranked", *ALL)
_table("master_viz", schemas.MASTER_COLUMNS, "master", *ALL)

_add("route_distance", """SELECT transaction_id, exit_plaza_previous, exit_plaza, distance_miles
  FROM travelled""")
_columns("travelled", """route_instate travel_time_minutes speed_mph min_required_travel_time_minutes
  is_impossible_travel is_rapid_succession flag_overlapping_journey
  overlapping_journey_duration_minutes travel_time_category""")
_add("driver_median_join", """SELECT transaction_id, t.tag_plate_number, amount, driver_amount_median
  FROM trips t LEFT JOIN medians m ON m.tag_plate_number = t.tag_plate_number""", *ALL)
_add("daily_spend_join", """SELECT transaction_id, driver_today_spend, driver_avg_daily_spend_30d
  FROM trips t LEFT JOIN spend_30 s ON s.tag_plate_number = t.tag_plate_number
  AND s.transaction_date = t.transaction_date""", *ALL)
_add("score_threshold_cross", """SELECT transaction_id, ml_anomaly_score, p1, p5, p25 FROM ranked""",
     *ALL)
_add("master_join", """SELECT transaction_id, amount,
  CASE WHEN amount > 20 THEN is_anomaly END AS is_anomaly,
  CASE WHEN amount > 20 THEN ml_anomaly_score END AS ml_predicted_score,
  CASE WHEN amount > 20 THEN 'Low Risk' END AS ml_predicted_category,
  CASE WHEN amount > 20 THEN prediction_timestamp END AS prediction_timestamp FROM predictions""",
     *ALL)
_add("driver_amount_median", "SELECT * FROM medians", *ALL)
_add("daily_spend", "SELECT tag_plate_number, transaction_date, driver_today_spend FROM spend", *ALL)
_add("frequency_encode", """SELECT transaction_id, route_name_freq_encoded, entry_plaza_freq_encoded,
  exit_plaza_freq_encoded, vehicle_type_freq_encoded, agency_freq_encoded,
  travel_time_of_day_freq_encoded FROM encoded""", *ALL)
_add("score_percentiles", "SELECT * FROM limits", *ALL)

LOSS = f"coalesce(sum({CENTS}::BIGINT) FILTER (WHERE is_anomaly = 1), 0)::DOUBLE / 100"
ALERTS = "count(*) FILTER (WHERE is_anomaly = 1)"
_add("stats_summary", f"""SELECT DATE '2024-02-03' AS as_of_date, count(*) AS total_transactions,
  {LOSS} AS total_amount_all_time, {ALERTS} AS total_alert_all_time, {LOSS} AS loss_all_time
  FROM master""", *ALL)
_add("stats_month", f"""SELECT DATE '2024-02-03' AS as_of_date,
  strftime(transaction_date, '%Y-%m') AS month, count(*) AS total_transactions,
  {ALERTS} AS total_alerts, {LOSS} AS total_loss FROM master GROUP BY ALL""", *ALL)
SEVERITY = """SELECT ml_predicted_category AS severity, count(*) AS count FROM master
  WHERE ml_predicted_category IS NOT NULL GROUP BY ALL"""
_add("stats_incremental", f"""SELECT DATE '2024-02-03' AS as_of_date,
  strftime(transaction_date, '%Y-%m') AS month, count(*) AS total_transactions,
  {ALERTS} AS total_alerts, {LOSS} AS total_loss FROM master
  WHERE transaction_date IS NOT NULL GROUP BY ALL
  UNION ALL SELECT DATE '2024-02-03', 'all', count(*), {ALERTS}, {LOSS} FROM master""", *ALL)
_add("severity_counts", SEVERITY, *ALL)
_add("order_by_severity", SEVERITY, *ALL)
FLAG_COUNTS = " UNION ALL ".join(
    f"SELECT '{label}' AS category, count(*) AS count FROM master WHERE is_anomaly = 1 AND {flag}"
    for flag, label in [
        ("flag_rush_hour", "Rush Hour"), ("flag_is_weekend", "Weekend"),
        ("flag_is_holiday", "Holiday"), ("flag_overlapping_journey", "Overlapping Journey"),
        ("flag_driver_amount_outlier", "Driver Amount Outlier"),
        ("flag_route_amount_outlier", "Route Amount Outlier"),
        ("flag_amount_unusually_high", "Amount Unusually High"),
        ("flag_driver_spend_spike", "Driver Spend Spike"),
    ]
)
_add("flag_category_counts", f"SELECT * FROM ({FLAG_COUNTS}) WHERE count > 0", *ALL)
_add("category_share", f"""SELECT category, count,
  round(count * 100.0::DOUBLE / sum(count) OVER (), 1) AS percentage
  FROM ({FLAG_COUNTS}) WHERE count > 0""", *ALL)
_add("hourly_anomalies", """SELECT hour(entry_time) AS hour, count(*) AS fraud_count FROM master
  WHERE is_anomaly = 1 GROUP BY ALL""", *ALL)
_add("training_metrics", """SELECT 'run-1' AS model_id, 'isolation_forest' AS model_type,
  TIMESTAMP '2024-02-01 00:00:00' AS training_timestamp, 1.5::DOUBLE AS training_time_seconds,
  count(*) AS n_samples, 20::BIGINT AS n_features, 100::BIGINT AS n_estimators,
  0.01::DOUBLE AS contamination, sum(is_anomaly)::BIGINT AS n_anomalies,
  round(avg(is_anomaly), 6) AS anomaly_rate, round(avg(ml_anomaly_score), 6) AS score_mean,
  round(stddev_pop(ml_anomaly_score), 6) AS score_std, min(ml_anomaly_score) AS score_min,
  max(ml_anomaly_score) AS score_max, quantile_cont(ml_anomaly_score, 0.5) AS score_median
  FROM predictions""", *ALL)

_columns("history", "driver_daily_txn_count route_name")
_add("previous_trip", """SELECT transaction_id, entry_plaza_previous, exit_plaza_previous,
  entry_time_previous, exit_time_previous FROM history""")
for _name in ("driver_rolling_30txn", "driver_rolling_30txn_in_pieces"):
    _add(_name, """SELECT transaction_id, driver_amount_last_30txn_avg, driver_amount_last_30txn_std,
  driver_amount_last_30txn_min, driver_amount_last_30txn_max, driver_amount_last_30txn_count
  FROM history""")
for _name in ("previous_trip", "driver_daily_txn_count", "silver_select"):
    ORACLES[f"{_name}_in_pieces"] = ORACLES[_name]
_add("route_stats", "SELECT * EXCLUDE (route_amount_med) FROM route_priced")
_add("route_median_min30", """SELECT route_name, vehicle_type_code, route_transaction_count,
  route_amount_med FROM route_priced""")
_add("daily_spend_30d_avg", f""", days AS (SELECT tag_plate_number, transaction_date,
    sum({CENTS}::BIGINT) AS day_cents FROM order_spend GROUP BY ALL)
SELECT a.tag_plate_number, a.transaction_date, any_value(a.day_cents)::DOUBLE / 100
    AS driver_today_spend,
  sum(b.day_cents)::DOUBLE / nullif(count(b.day_cents), 0) / 100 AS driver_avg_daily_spend_30d
FROM days a LEFT JOIN days b ON a.tag_plate_number = b.tag_plate_number
  AND b.transaction_date BETWEEN a.transaction_date - 30 AND a.transaction_date - 1
GROUP BY a.tag_plate_number, a.transaction_date""", *ALL)
_add("score_percentile_rank", """SELECT transaction_id, ml_anomaly_score, score_percentile_rank
  FROM ranked""", *ALL)
_columns("gold", """driver_amount_modified_z_score amount_deviation_from_avg_pct
  amount_deviation_from_median_pct route_amount_z_score flag_driver_amount_outlier
  flag_route_amount_outlier flag_amount_unusually_high flag_driver_spend_spike anomaly_score""", *ALL)
_add("anomaly_category", "SELECT transaction_id, anomaly_category FROM ranked", *ALL)
_add("review_status", "SELECT transaction_id, ml_predicted_category, status FROM master", *ALL)

FEATURES = [
    c for c in schemas.TRAIN_COLUMNS
    if c not in ("transaction_id", "transaction_date", "tag_plate_number", "vehicle_type_code")
]
_add("feature_matrix", "SELECT transaction_id, "
     + ", ".join(f"{c}::DOUBLE AS {c}" for c in FEATURES) + " FROM encoded", *ALL)
_add("impute_median", "SELECT transaction_id, " + ", ".join(
    f"coalesce({c}::DOUBLE, (SELECT list_sort(list({c}))[(count({c}) + 1) // 2]::DOUBLE * 0.5::DOUBLE"
    f" + list_sort(list({c}))[count({c}) // 2 + 1]::DOUBLE * 0.5::DOUBLE FROM encoded"
    f" WHERE {c} IS NOT NULL)) AS {c}"
    for c in FEATURES if c not in ("distance_miles", "speed_mph")
) + " FROM encoded", *ALL)
SCALED = ["amount", "driver_today_spend", "driver_daily_txn_count", "route_name_freq_encoded"]
_add("standard_scale", "SELECT transaction_id, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in SCALED
) + " FROM encoded", *ALL)
_add("contamination_cut", """, cut AS (SELECT quantile_cont(ml_anomaly_score, 0.01) AS low
  FROM predictions)
SELECT transaction_id, CASE WHEN ml_anomaly_score - low < 0 THEN 1 ELSE 0 END AS is_anomaly,
  ml_anomaly_score - low AS ml_anomaly_score FROM predictions, cut""", *ALL)

MASTER_ROWS = ", ".join(schemas.MASTER_COLUMNS)
LATEST = "ORDER BY transaction_date DESC, transaction_id"
FOUND = """(lower(transaction_id) LIKE '%{0}%' OR lower(coalesce(tag_plate_number, '')) LIKE '%{0}%'
  OR lower(coalesce(ml_predicted_category, '')) LIKE '%{0}%')"""
_add("search_transactions", f"""SELECT {MASTER_ROWS} FROM master WHERE {FOUND.format('t1_')}
  AND lower(ml_predicted_category) = 'low risk' {LATEST} LIMIT 50 OFFSET 50""", *ALL)
_add("count_transactions", f"""SELECT count(*) AS total FROM master WHERE {FOUND.format('t1')}
  AND status = 'Needs Review'""", *ALL)
_add("alerts", f"SELECT {MASTER_ROWS} FROM master WHERE is_anomaly = 1 {LATEST} LIMIT 100", *ALL)
_add("recent_flagged", f"""SELECT transaction_id AS id, transaction_id,
  strftime(transaction_date, '%Y-%m-%d') AS transaction_date, tag_plate_number,
  tag_plate_number AS "tagPlate", agency, coalesce(amount, 0) AS amount, status,
  coalesce(ml_predicted_category, 'Anomaly Detected') AS category, is_anomaly = 1 AS is_anomaly
  FROM (SELECT * FROM master WHERE status = 'Needs Review' OR is_anomaly = 1 {LATEST} LIMIT 3)""",
     *ALL)
_add("latest_metrics", f"""SELECT count(*) AS total_transactions, {LOSS} AS total_amount_all_time,
  {ALERTS} AS total_alert_all_time, {LOSS} AS loss_all_time FROM master""", *ALL)
_add("latest_month", "SELECT month, total_alerts FROM order_months ORDER BY month DESC LIMIT 1", *ALL)
_add("monthly_series", """SELECT month, total_transactions, total_alerts AS fraud_alerts, total_loss
  FROM order_months ORDER BY month DESC LIMIT 12""", *ALL)
_add("score_scatter", """SELECT amount, ml_predicted_score AS ml_anomaly_score,
  ml_predicted_category AS risk_level FROM master WHERE transaction_date >= DATE '2024-01-10'
  AND amount IS NOT NULL""", *ALL)
_add("review_requests", """SELECT q.transaction_id, q.new_status, q.seq,
  coalesce(r.accepted, FALSE) AS accepted, r.met AS current_status,
  CASE WHEN coalesce(q.transaction_id, '') = '' THEN 'Missing transactionId or newStatus'
    WHEN r.seq IS NULL THEN 'Transaction not found'
    WHEN NOT r.accepted THEN 'Invalid status transition' END AS reason
FROM requests q LEFT JOIN replay r ON r.transaction_id = q.transaction_id AND r.seq = q.seq
  AND r.new_status = q.new_status""", *ALL, REVIEW)
_add("apply_status_updates", """SELECT m.transaction_id,
  coalesce(last.status, m.status) AS status,
  CASE WHEN last.touched THEN TIMESTAMP '2024-02-02 00:00:00' ELSE m.last_updated END AS last_updated
FROM master m LEFT JOIN (SELECT transaction_id, arg_max(status, place) AS status,
    bool_or(accepted) AS touched FROM replay GROUP BY ALL) last USING (transaction_id)""",
     *ALL, REVIEW)
ORACLES["merge_status_updates"] = ORACLES["apply_status_updates"]
_add("sort_table", """SELECT transaction_id, amount, tag_plate_number, flag_rush_hour FROM master
  ORDER BY amount DESC NULLS LAST""", *ALL)

_add("check_not_null", """SELECT count(*) FILTER (WHERE transaction_date IS NULL) AS transaction_date,
  count(*) FILTER (WHERE tag_plate_number IS NULL) AS tag_plate_number,
  count(*) FILTER (WHERE agency IS NULL) AS agency, count(*) FILTER (WHERE amount IS NULL) AS amount
  FROM trips""")
_add("build_twice", """SELECT count(*) AS total_transactions, count(*) AS n_predictions, 1 AS n_runs,
  count(*) AS n_samples, 20 AS n_checks, 0 AS n_shared_ids,
  count(*) FILTER (WHERE amount IS NULL) AS n_without_amount FROM trips""")
_CHECKED = {
    "silver": "silver_wide", "gold": "gold", "gold_train": "encoded", "pred_raw": "predictions",
    "master_viz": "master",
}
_CHECKS = [
    f"SELECT '{t}' AS table_name, 'not_null' AS test, '{c}' AS column_name,"
    f" count(*) FILTER (WHERE {c} IS NULL) AS failures FROM {source}"
    for t, source in _CHECKED.items() for c in quality.NOT_NULL[t]
] + [
    f"SELECT '{t}', 'unique', 'transaction_id', count(*) FROM (SELECT transaction_id FROM"
    f" {_CHECKED[t]} GROUP BY ALL HAVING count(*) > 1)" for t in ("gold_train", "pred_raw", "master_viz")
] + [
    f"SELECT '{t}', 'accepted_values', 'agency', count(DISTINCT agency) FILTER (WHERE agency NOT IN"
    f" ({_codes(code for code, _, _ in lookups.AGENCIES)})) FROM {_CHECKED[t]}" for t in ("silver", "gold")
]
_add("check_tables", " UNION ALL ".join(_CHECKS), *ALL)
_add("check_unique", """SELECT transaction_id, count(*) AS rows FROM (SELECT transaction_id FROM trips
  UNION ALL SELECT transaction_id FROM trips WHERE entry_lane = '2') GROUP BY ALL
  HAVING count(*) > 1""")
_add("check_accepted_values", """SELECT agency, count(*) AS rows FROM trips
  WHERE agency IS NOT NULL AND agency NOT IN (SELECT agency FROM agencies) GROUP BY ALL""")


def _forest_sql() -> str:
    """The fixed forest of the queries, walked by joins: one per level."""
    from verification.queries import FOREST_FEATURES, FOREST_NODES
    nodes = ", ".join(
        "(" + ", ".join("'infinity'::DOUBLE" if v == float("inf") else str(v) for v in n) + ")"
        for n in FOREST_NODES
    )
    values = "[" + ", ".join(f"coalesce({c}::DOUBLE, 0)" for c in FOREST_FEATURES) + "]"
    step = "CASE WHEN x[n{0}.feature + 1] <= n{0}.threshold THEN n{0}.lo ELSE n{0}.hi END"
    levels = " ".join(
        f"JOIN nodes n{i + 1} ON n{i + 1}.tree = n0.tree AND n{i + 1}.node = {step.format(i)}"
        for i in range(3)
    )
    trees = len({n[0] for n in FOREST_NODES})
    usual = "(2 * (ln(255) + 0.5772156649015329) - 2 * 255 / 256.0::DOUBLE)"
    return f""", nodes(tree, node, feature, threshold, lo, hi, path) AS (VALUES {nodes}),
points AS (SELECT transaction_id, {values} AS x FROM encoded)
SELECT transaction_id, round(-pow(2, -sum(n3.path) / ({trees} * {usual})), 9) AS raw_score
FROM points JOIN nodes n0 ON n0.node = 0 {levels} GROUP BY transaction_id"""


_add("forest_scores", _forest_sql(), *ALL)


def _grown_sql() -> str:
    """The fitted forest: samples by digests, then one step per level for its nodes and its rows."""
    names = [c for c in FEATURES if c not in ("distance_miles", "speed_mph")]
    filled = ", ".join(
        f"coalesce({c}::DOUBLE, (SELECT quantile_cont({c}::DOUBLE, 0.5) FROM encoded)) AS {c}" for c in names
    )
    scaled = ", ".join(
        f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () <= 1e-9 * abs(avg({c}) OVER ())"
        f" THEN 1 ELSE stddev_pop({c}) OVER () END" for c in names
    )
    digest = "('0x' || substr(md5({0}), {1}, {2}))::BIGINT"
    unit = digest.format("{0}", 1, 13) + " / 4503599627370496.0::DOUBLE"
    node = "':42:' || tree || ':' || node"
    sql = f""", filled AS MATERIALIZED (SELECT transaction_id, {filled} FROM encoded),
matrix AS MATERIALIZED (SELECT transaction_id AS id, [{scaled}] AS x FROM filled),
sizes AS MATERIALIZED (SELECT count(*) AS total FROM matrix),
entered AS MATERIALIZED (
  SELECT id, x, unnest(range(least(100, floor(least(100.0::DOUBLE, 102400.0::DOUBLE / total)
    + {unit.format("'draw:42:' || id")}))::BIGINT)) AS j FROM matrix, sizes),
drawn AS MATERIALIZED (
  SELECT id, x, ({digest.format("'draw:42:' || id", 14, 8)} + j) % 100 AS tree FROM entered),
rows0 AS MATERIALIZED (
  SELECT tree, id, x, 0::BIGINT AS node FROM drawn
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY {digest.format("'pick:42:' || tree || ':' || id", 1, 13)}, id) <= 256),
depths AS MATERIALIZED (SELECT ceil(log2(greatest(least(256, total), 2)))::INT AS deepest FROM sizes)"""
    for depth in range(9):
        sql += f""",
spans{depth} AS MATERIALIZED (
  SELECT tree, node, k, min(v) AS low, max(v) AS high
  FROM (SELECT tree, node, unnest(range({len(names)})) AS k, unnest(x) AS v FROM rows{depth}) GROUP BY ALL),
nodes{depth} AS MATERIALIZED (
  SELECT s.tree, s.node, c.size, {depth} AS depth, varying[{digest.format("'feature' || " + node.replace("tree", "s.tree").replace("node", "s.node"), 1, 13)} % greatest(len(varying), 1) + 1] AS split,
    len(varying) = 0 OR {depth} >= deepest AS leaf
  FROM (SELECT tree, node, coalesce(list({{'k': k, 'low': low, 'high': high}} ORDER BY k) FILTER (high > low), []) AS varying
    FROM spans{depth} GROUP BY ALL) s
  JOIN (SELECT tree, node, count(*) AS size FROM rows{depth} GROUP BY ALL) c ON c.tree = s.tree AND c.node = s.node, depths),
cuts{depth} AS MATERIALIZED (
  SELECT tree, node, size, depth, leaf, split.k AS feature, split.low AS low, split.high AS high,
    split.low + {unit.format("'threshold' || " + node)} * (split.high - split.low) AS threshold FROM nodes{depth}),
rows{depth + 1} AS MATERIALIZED (
  SELECT r.tree, id, x, 2 * r.node + CASE WHEN x[feature + 1] <= threshold THEN 1 ELSE 2 END AS node
  FROM rows{depth} r JOIN cuts{depth} c ON c.tree = r.tree AND c.node = r.node WHERE NOT leaf)"""
    every = " UNION ALL ".join(f"SELECT * FROM cuts{d}" for d in range(9))
    usual = "CASE WHEN size <= 1 THEN 0 WHEN size = 2 THEN 1 ELSE 2 * (ln(size - 1) + 0.5772156649015329) - 2 * (size - 1)::DOUBLE / size END"
    return sql + f""",
grown AS MATERIALIZED (
  SELECT tree, node, CASE WHEN leaf THEN -1 ELSE feature END AS feature, CASE WHEN leaf THEN 0 ELSE threshold END AS threshold,
    CASE WHEN leaf THEN depth + {usual} ELSE 0 END::DOUBLE AS path FROM ({every}))"""


def _scored_sql() -> str:
    steps = "walk0 AS MATERIALIZED (SELECT id, x, tree, 0::BIGINT AS node FROM matrix, (SELECT DISTINCT tree FROM grown))"
    for i in range(8):
        steps += f""",
walk{i + 1} AS MATERIALIZED (
  SELECT id, x, w.tree, CASE WHEN feature < 0 THEN w.node WHEN x[feature + 1] <= threshold THEN 2 * w.node + 1
    ELSE 2 * w.node + 2 END AS node
  FROM walk{i} w JOIN grown g ON g.tree = w.tree AND g.node = w.node)"""
    return _grown_sql() + f""",
{steps},
scores AS MATERIALIZED (
  SELECT id AS transaction_id, -pow(2, -list_sum(list(path ORDER BY w.tree)) / (100 * any_value(usual))) AS raw
  FROM walk8 w JOIN grown g ON g.tree = w.tree AND g.node = w.node, (
    SELECT CASE WHEN least(256, total) = 2 THEN 1 ELSE 2 * (ln(least(256, total) - 1) + 0.5772156649015329)
      - 2 * (least(256, total) - 1)::DOUBLE / least(256, total) END AS usual FROM sizes) GROUP BY id)"""


_add("isolation_forest_fit", _grown_sql() + """
SELECT tree, node, feature, round(threshold, 6) AS threshold, round(path, 9) AS path FROM grown""", *ALL)
_add("isolation_forest_score", _scored_sql() + """
SELECT transaction_id, round(raw, 9) AS raw_score FROM scores""", *ALL)
_add("model_predictions", _scored_sql() + """
SELECT transaction_id, (raw - low < 0)::INT AS is_anomaly, round(raw - low, 9) AS ml_anomaly_score,
  TIMESTAMP '%s' AS prediction_timestamp
FROM scores, (SELECT quantile_cont(raw, 0.01) AS low FROM scores)""" % adapter.PREDICTED_AT, *ALL)
_add("isolation_forest_facts", """SELECT r.range::INT AS tree, least(256, n) AS n_rows,
  least(256, n) AS n_ids, 0 AS strange, 0 AS outside
FROM range(100) r, (SELECT count(*) AS n FROM encoded)""", *ALL)
_add("flagged_share", "SELECT count(*) AS n_rows, count(*) AS n_ids, 0 AS n_wrong, true AS few FROM encoded", *ALL)
