"""Column lists and types of every table in the medallion.

Fixed values: names and orders are the interface of the tables.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Statement header -> bronze column.
RAW_TO_BRONZE = {
    "POSTING DATE": "posting_date",
    "TRANSACTION DATE": "transaction_date",
    "TAG/PLATE NUMBER": "tag_plate_number",
    "AGENCY": "agency",
    "DESCRIPTION": "description",
    "ENTRY TIME": "entry_time",
    "ENTRY PLAZA": "entry_plaza",
    "ENTRY LANE": "entry_lane",
    "EXIT TIME": "exit_time",
    "EXIT PLAZA": "exit_plaza",
    "EXIT LANE": "exit_lane",
    "VEHICLE TYPE CODE": "vehicle_type_code",
    "AMOUNT": "amount",
    "PREPAID": "prepaid",
    "PLAN/RATE": "plan_rate",
    "FARE TYPE": "fare_type",
    "BALANCE": "balance",
}

RAW_COLUMNS = list(RAW_TO_BRONZE)
BRONZE_COLUMNS = list(RAW_TO_BRONZE.values()) + ["loaded_at", "source_file"]

CORRUPT_COLUMN = "_corrupt_record"
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
BRONZE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in BRONZE_COLUMNS])

# What identifies one toll passage when the same statement line is loaded twice.
DEDUPE_KEYS = [
    "transaction_date", "tag_plate_number", "entry_time", "entry_plaza",
    "exit_time", "exit_plaza", "amount", "agency",
]

# Silver columns in table order.
SILVER_COLUMNS = """
transaction_id transaction_date posting_date
tag_plate_number agency agency_name
entry_time exit_time entry_time_previous exit_time_previous
entry_plaza exit_plaza entry_plaza_previous exit_plaza_previous route_name
entry_plaza_name exit_plaza_name entry_lane exit_lane route_instate
distance_miles travel_time_minutes speed_mph min_required_travel_time_minutes
is_impossible_travel is_rapid_succession flag_overlapping_journey
overlapping_journey_duration_minutes travel_time_category
vehicle_type_code plan_rate fare_type
amount
driver_amount_last_30txn_avg driver_amount_last_30txn_std driver_amount_last_30txn_min
driver_amount_last_30txn_max driver_amount_last_30txn_count driver_daily_txn_count
route_amount_avg route_amount_std route_amount_min route_amount_max route_amount_med
route_transaction_count
state_name travel_time_of_day flag_rush_hour entry_hour exit_hour vehicle_type_name
flag_vehicle_type flag_is_weekend flag_is_holiday flag_outstate
last_updated source_file
""".split()

# Gold columns in table order.
GOLD_COLUMNS = """
transaction_id transaction_date posting_date tag_plate_number
agency agency_name state_name entry_plaza entry_plaza_name entry_lane
exit_plaza exit_plaza_name exit_lane entry_plaza_previous exit_plaza_previous route_instate
entry_time exit_time entry_time_previous exit_time_previous entry_hour exit_hour
travel_time_of_day flag_rush_hour flag_is_weekend flag_is_holiday
vehicle_type_code vehicle_type_name flag_vehicle_type plan_rate fare_type
amount
distance_miles travel_time_minutes speed_mph min_required_travel_time_minutes
is_impossible_travel is_rapid_succession flag_overlapping_journey
overlapping_journey_duration_minutes travel_time_category
driver_amount_last_30txn_avg driver_amount_last_30txn_std driver_amount_last_30txn_min
driver_amount_last_30txn_max driver_amount_last_30txn_count driver_daily_txn_count
driver_amount_median driver_amount_modified_z_score amount_deviation_from_avg_pct
amount_deviation_from_median_pct driver_today_spend driver_avg_daily_spend_30d
route_name route_amount_avg route_amount_std route_amount_min route_amount_max
route_amount_med route_transaction_count
route_amount_z_score
flag_driver_amount_outlier flag_route_amount_outlier flag_amount_unusually_high
flag_driver_spend_spike
anomaly_score
last_updated source_file
""".split()

# The narrow rule-based projection of gold.
GOLD_RULEBASED_COLUMNS = """
transaction_id transaction_date tag_plate_number
agency_name state_name route_name route_instate
vehicle_type_code amount travel_time_category
driver_amount_modified_z_score route_amount_z_score
flag_is_weekend flag_is_holiday flag_rush_hour is_impossible_travel is_rapid_succession
flag_overlapping_journey flag_driver_amount_outlier flag_route_amount_outlier
flag_amount_unusually_high flag_driver_spend_spike
anomaly_score last_updated
""".split()

# Model features in training order; prediction tables put ``amount`` first.
FREQUENCY_FEATURES = {
    "route_name": "route_name_freq_encoded",
    "entry_plaza": "entry_plaza_freq_encoded",
    "exit_plaza": "exit_plaza_freq_encoded",
    "vehicle_type_code": "vehicle_type_freq_encoded",
    "agency": "agency_freq_encoded",
    "travel_time_of_day": "travel_time_of_day_freq_encoded",
}
TRAVEL_FEATURES = [
    "distance_miles", "travel_time_minutes", "speed_mph", "overlapping_journey_duration_minutes",
]
DRIVER_FEATURES = [
    "driver_amount_last_30txn_avg", "driver_amount_last_30txn_std",
    "driver_amount_last_30txn_count", "driver_daily_txn_count",
    "driver_amount_modified_z_score", "amount_deviation_from_avg_pct",
    "amount_deviation_from_median_pct", "driver_today_spend", "driver_avg_daily_spend_30d",
    "route_amount_z_score", "exit_hour",
]
TRAIN_COLUMNS = (
    ["transaction_id", "transaction_date", "tag_plate_number"]
    + TRAVEL_FEATURES + DRIVER_FEATURES
    + ["amount", "vehicle_type_code"]
    + list(FREQUENCY_FEATURES.values())
)
PREDICTION_FEATURES = (
    ["amount"] + TRAVEL_FEATURES + DRIVER_FEATURES
    + ["vehicle_type_code"] + list(FREQUENCY_FEATURES.values())
)
PREDICTION_COLUMNS = (
    ["transaction_id"] + PREDICTION_FEATURES
    + ["is_anomaly", "ml_anomaly_score", "prediction_timestamp"]
)
PRED_VIZ_COLUMNS = [
    "transaction_id", "is_anomaly", "ml_anomaly_score", "prediction_timestamp",
    "anomaly_category", "score_percentile_rank",
    "score_p1_threshold", "score_p5_threshold", "score_p25_threshold",
] + PREDICTION_FEATURES

# Master columns in table order.
MASTER_COLUMNS = """
status transaction_id transaction_date posting_date tag_plate_number
is_anomaly rule_based_score ml_predicted_score ml_predicted_category
agency route_name route_instate state_name entry_plaza entry_lane exit_plaza exit_lane
entry_time exit_time
vehicle_type_name plan_rate fare_type
amount
distance_miles travel_time_minutes speed_mph is_impossible_travel is_rapid_succession
travel_time_category
flag_rush_hour flag_is_weekend flag_is_holiday flag_overlapping_journey
flag_driver_amount_outlier flag_route_amount_outlier flag_amount_unusually_high
flag_driver_spend_spike
prediction_timestamp last_updated
""".split()

# One row per training run.
METRICS_SCHEMA = (
    "model_id string, model_type string, training_timestamp timestamp, "
    "training_time_seconds double, n_samples bigint, n_features bigint, n_estimators bigint, "
    "contamination double, n_anomalies bigint, anomaly_rate double, score_mean double, "
    "score_std double, score_min double, score_max double, score_median double"
)
