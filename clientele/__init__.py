"""Customer segmentation on Spark: from a customer table or a transaction log to judged, named and exported segments."""

from clientele.errors import DataProblem
from clientele.operators.audit import (
    column_profile,
    correlated_pairs,
    data_quality_report,
    starting_bases,
    table_overview,
    validate_customer_table,
)
from clientele.operators.diagnostics import centroid_distances
from clientele.operators.fits import FitSettings
from clientele.operators.prepare import PreprocessConfig, infer_feature_types, prepare_features
from clientele.operators.profile import anova_table, build_segment_map, profile_segments
from clientele.operators.rfm import build_rfm
from clientele.operators.ward import hierarchy_views
from clientele.plans.compare import compare_solutions, fit_candidate, fit_solution, plan_grid
from clientele.plans.pipeline import segment_customers
from clientele.session import new_session
from clientele.sinks.exports import safe_for_spreadsheet, write_csv, write_json, write_results
from clientele.sources.files import load_data

__all__ = [
    "DataProblem", "FitSettings", "PreprocessConfig", "anova_table", "build_rfm", "build_segment_map",
    "centroid_distances", "column_profile", "compare_solutions", "correlated_pairs", "data_quality_report",
    "fit_candidate", "fit_solution", "hierarchy_views", "infer_feature_types", "load_data", "new_session", "plan_grid",
    "prepare_features", "profile_segments", "safe_for_spreadsheet", "segment_customers", "starting_bases",
    "table_overview", "validate_customer_table", "write_csv", "write_json", "write_results",
]
