"""Explicit schemas; nothing is inferred."""

ENVELOPE = (
    "id long, company_id long, aggregate_type string, aggregate_id string, event_type string, "
    "payload string, created_at string"
)
RAW = "body string, source string"
BRONZE = (
    "event_id long, company_id int, event_type string, aggregate_type string, aggregate_id string, "
    "body string, source string, ingested_at timestamp_ntz, run_id string"
)
SILVER_TRANSACTIONS = (
    "event_id long, transaction_id long, company_id int, account_id int, payment_id long, "
    "amount decimal(18,2), balance_after decimal(18,2), category string, counterparty string, "
    "booked_at timestamp_ntz, value_date date, event_created_at timestamp_ntz, "
    "run_id string, processed_at timestamp_ntz"
)
SILVER_PAYMENTS = (
    "event_id long, payment_id long, company_id int, event_type string, status string, "
    "amount decimal(18,2), currency string, value_date date, reference string, from_account_id int, "
    "to_account_id int, beneficiary_id int, beneficiary_name string, created_by int, decided_by int, "
    "created_at timestamp_ntz, decided_at timestamp_ntz, executed_at timestamp_ntz, "
    "event_created_at timestamp_ntz, run_id string, processed_at timestamp_ntz"
)
ACCOUNTS = "account_id int, company_id int, account_kind string, reference_balance decimal(18,2)"
SCHEDULED = "company_id int, kind string, amount decimal(18,2), due_date date"
TRACE = "payment_id long, stage string, at timestamp_ntz"
RUNS = (
    "run_id string, started_at timestamp_ntz, finished_at timestamp_ntz, events_ingested long, "
    "events_new long, companies_refreshed long, status string, next_batch_at timestamp_ntz"
)
DAILY_FLOWS = (
    "company_id int, flow_date date, other_net decimal(18,2), supplier_net decimal(18,2), "
    "payroll_net decimal(18,2), transfer_net decimal(18,2), total_net decimal(18,2), "
    "run_id string, computed_at timestamp_ntz"
)
PAYMENT_FEATURES = (
    "payment_id long, company_id int, transaction_id long, from_account_id int, to_account_id int, "
    "beneficiary_id int, counterparty string, amount decimal(18,2), value_date date, "
    "executed_at timestamp_ntz, log_amount double, hour_gst int, day_of_week_gst int, is_weekend boolean, "
    "is_internal boolean, beneficiary_prior_count long, beneficiary_prior_mean decimal(18,2), "
    "is_first_time_beneficiary boolean, same_day_duplicates long, run_id string, "
    "computed_at timestamp_ntz, amount_to_prior_mean double"
)
CASH_POSITION = (
    "position_date date, company_id int, account_id int, account_kind string, balance decimal(18,2), "
    "balance_source string, last_booked_at timestamp_ntz, computed_at timestamp_ntz, run_id string"
)
SERVING_POSITION = (
    "company_id int, as_of_date date, total_cash decimal(18,2), available decimal(18,2), "
    "scheduled_out_7d decimal(18,2), payroll_due_date date, payroll_due_amount decimal(18,2), "
    "forecast_low decimal(18,2), refreshed_at timestamp_ntz"
)
SERVING_FORECAST = (
    "company_id int, forecast_date date, predicted_balance decimal(18,2), lower_bound decimal(18,2), "
    "upper_bound decimal(18,2), model_name string, model_version string, generated_at timestamp_ntz"
)
SERVING_ANOMALIES = (
    "id long, company_id int, payment_id long, transaction_id long, occurred_at timestamp_ntz, "
    "counterparty string, amount decimal(18,2), score decimal(6,4), reason string, "
    "detected_at timestamp_ntz, model_name string, model_version string"
)
SERVING_MODELS = (
    "model_name string, registered_name string, model_version string, trained_at timestamp_ntz, "
    "metrics string, run_id string"
)
