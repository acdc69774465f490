"""Names, aliases and contracts that outputs must match."""

# Task words and their canonical form.
TASK_WORDS = {
    "dayahead": "dayahead",
    "da": "dayahead",
    "日前": "dayahead",
    "realtime": "realtime",
    "rt": "realtime",
    "实时": "realtime",
}
PREDICTION_MODE_WORDS = {
    "dayahead": "dayahead",
    "da": "dayahead",
    "realtime": "realtime",
    "rt": "realtime",
    "external": "external",
}
TASKS = ("dayahead", "realtime")
PERIODS = ("1_8", "9_16", "17_24")

# Columns of the market table.
FORECAST_COLUMNS = (
    "local_plant_forecast", "tie_line_forecast", "wind_forecast", "solar_forecast", "nuclear_forecast",
    "self_supply_forecast", "test_unit_forecast", "dispatched_load_forecast", "bidding_space_forecast", "renewable_forecast",
)
ACTUAL_COLUMNS = (
    "local_plant_actual", "tie_line_actual", "wind_actual", "solar_actual", "nuclear_actual",
    "self_supply_actual", "test_unit_actual", "dispatched_load_actual", "bidding_space_actual", "renewable_actual",
)
MARKET_COLUMNS = ("ds", "da_price", "rt_price", *FORECAST_COLUMNS, *ACTUAL_COLUMNS)

# Header words accepted for the columns of the market table.
MARKET_ALIASES = {
    "timestamp": "ds",
    "datetime": "ds",
    "date_time": "ds",
    "time": "ds",
    "时刻": "ds",
    "日前电价": "da_price",
    "日前统一出清价格": "da_price",
    "day_ahead_clearing_price": "da_price",
    "dayahead_price": "da_price",
    "day_ahead_price": "da_price",
    "实时电价": "rt_price",
    "实时统一出清价格": "rt_price",
    "real_time_clearing_price": "rt_price",
    "realtime_price": "rt_price",
    "real_time_price": "rt_price",
    "地方电厂总加预测值": "local_plant_forecast",
    "联络线受电负荷预测值": "tie_line_forecast",
    "风电总加预测值": "wind_forecast",
    "光伏总加预测值": "solar_forecast",
    "核电总加预测值": "nuclear_forecast",
    "自备机组总加预测值": "self_supply_forecast",
    "试验机组总加预测值": "test_unit_forecast",
    "直调负荷预测值": "dispatched_load_forecast",
    "竞价空间预测值": "bidding_space_forecast",
    "新能源总加预测值": "renewable_forecast",
    "地方电厂总加实际值": "local_plant_actual",
    "联络线受电负荷实际值": "tie_line_actual",
    "风电总加实际值": "wind_actual",
    "光伏总加实际值": "solar_actual",
    "核电总加实际值": "nuclear_actual",
    "自备机组总加实际值": "self_supply_actual",
    "试验机组总加实际值": "test_unit_actual",
    "直调负荷实际值": "dispatched_load_actual",
    "竞价空间实际值": "bidding_space_actual",
    "新能源总加实际值": "renewable_actual",
}
EXTERNAL_ALIASES = {"target_day": "business_day", "ds": "timestamp"}
LONG_TABLE_ALIASES = {
    "y": "y_true",
    "actual": "y_true",
    "pred_y": "y_pred",
    "price": "y_pred",
    "predictions": "y_pred",
    "预测值": "y_pred",
    "prediction": "y_pred",
    "timestamp": "ds",
    "时刻": "ds",
}

# Column contracts.
PREDICTION_COLUMNS = ("task", "model_name", "target_day", "ds", "period", "hour_business", "y_true", "y_pred")
OOF_COLUMNS = (
    "task", "model_name", "fold_id", "train_start", "train_end", "test_start", "test_end", "target_day",
    "business_day", "ds", "period", "hour_business", "y_true", "y_pred", "source", "run_mode", "created_at",
)
TAP_COLUMNS = (
    "task", "model_name", "tap_fold_id", "train_start", "train_end", "test_start", "test_end", "cutoff_date",
    "target_day", "business_day", "ds", "hour_business", "period", "horizon_day", "age_block", "y_pred", "y_true",
    "source", "run_mode", "created_at", "tap_source", "source_confidence", "age_days", "checkpoint_path",
)
EXTERNAL_REQUIRED = (
    "model_name", "business_day", "hour_business", "timestamp", "y_pred", "source_file", "prediction_mode",
    "leakage_safe",
)
LEDGER_COLUMNS = (
    "run_date", "forecast_date", "hour_business", "timestamp", "target", "model_name", "y_pred", "base_fused_pred",
    "spike_corrected_pred", "final_pred", "y_true", "period", "available_data_cutoff", "pipeline_version",
    "source_file", "created_at",
)
LEDGER_REQUIRED = (
    "run_date", "forecast_date", "hour_business", "timestamp", "target", "model_name", "y_pred", "final_pred",
    "period", "pipeline_version", "created_at",
)
LEDGER_KEY = ("run_date", "forecast_date", "hour_business", "target", "model_name")
INTRADAY_DEFAULTS = {
    "business_day": None,
    "cutoff_hour": 0,
    "target_hour": 0,
    "ds": None,
    "mode": "INTRADAY",
    "base_model_name": "",
    "base_pred": 0.0,
    "intraday_corrected_pred": 0.0,
    "intraday_final_correction": 0.0,
    "intraday_confidence": 0.0,
    "policy_decision": "DISABLED",
    "fusion_weight": 0.0,
    "shadow_only_flag": False,
    "guardrail_reason": "pack_missing",
    "n_observed": 0,
    "observed_hours": 0,
    "residual_std_today": 0.0,
    "bias_direction": "",
    "y_true": None,
    "baseline_error": None,
    "corrected_error": None,
}
