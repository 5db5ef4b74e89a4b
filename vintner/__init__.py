"""vintner: batch model-scoring on tables, written as Spark DataFrame functions.

Every public function takes and returns a DataFrame (or a small value derived
from one by a Spark aggregation), so data stays on the executors.
"""

from vintner.operators.clean import (bad_value_counts, cast_features, cast_label, clean_table,
                                     drop_label, with_status)
from vintner.operators.fit import (LinearModel, coefficients_frame, fit_elastic_net, fit_spark_ml,
                                   load_model, save_model)
from vintner.operators.metrics import (frame_difference, frames_equal, regression_metrics,
                                       regression_metrics_by_sets)
from vintner.operators.publish import append_table, publish, publish_many
from vintner.operators.registry import (latest_in_stage, latest_version, log_runs, register_models,
                                        runs_of_experiment, transition_stages, with_model_uri)
from vintner.operators.runs import job_outcomes, updated_within
from vintner.operators.score import score, score_spark_ml, score_with_udf
from vintner.operators.split import exact_split, first_row, hash_split, train_test, with_row_key
from vintner.session import get_session, materialize, persisted
from vintner.sources import (frame_from_rows, land_once, read_csv_strings, read_parquet,
                             read_sniffed_csv, sniff_delimiter)

__version__ = "0.1.0"

__all__ = [
    "get_session", "materialize", "persisted",
    "read_parquet", "read_csv_strings", "read_sniffed_csv", "sniff_delimiter", "land_once",
    "frame_from_rows",
    "cast_features", "cast_label", "clean_table", "with_status", "drop_label", "bad_value_counts",
    "exact_split", "hash_split", "train_test", "first_row", "with_row_key",
    "LinearModel", "fit_elastic_net", "fit_spark_ml", "coefficients_frame", "save_model", "load_model",
    "score", "score_with_udf", "score_spark_ml",
    "regression_metrics", "regression_metrics_by_sets", "frame_difference", "frames_equal",
    "publish", "publish_many", "append_table",
    "register_models", "transition_stages", "latest_in_stage", "latest_version", "log_runs",
    "runs_of_experiment", "with_model_uri",
    "job_outcomes", "updated_within",
]
