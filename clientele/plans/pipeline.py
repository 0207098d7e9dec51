"""The whole path from a customer table to named segments and exports."""

from __future__ import annotations

import platform
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import pyspark
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.functions.coerce import quoted
from clientele.operators.audit import at_most_two_values, validate_customer_table
from clientele.operators.fits import METHODS, FitSettings
from clientele.operators.prepare import PreprocessConfig, PrepModel, infer_feature_types, prepare_features
from clientele.operators.profile import ProfileResult, build_segment_map, profile_segments, segment_summary
from clientele.operators.solution import SegmentSolution, describe_solution
from clientele.plans.compare import ComparisonResult, compare_solutions, fit_candidate, plan_grid, ready
from clientele.session import durable
from clientele.sinks.exports import analysis_manifest, dataset_fingerprint, settings_signature

SEGMENT = "__segment"
CUSTOM_NOTE = "Custom fit: this method and segment count were not part of the comparison."


@dataclass
class Segmentation:
    """Everything an analysis produces; tables stay lazy until written or shown."""

    customers: DataFrame
    id_column: str
    bases: list[str]
    descriptors: list[str]
    prep: PrepModel
    comparison: ComparisonResult
    solution: SegmentSolution
    profile: ProfileResult
    names: dict[str, str]
    facts: dict[str, object] = field(default_factory=dict)

    def labelled(self) -> DataFrame:
        """Source columns plus the segment under ``SEGMENT``: a projection, not a join."""
        return self.solution.assignments.select("source.*", F.col("segment").alias(SEGMENT), "confidence")

    def segment_map(self) -> DataFrame:
        return build_segment_map(self.labelled(), self.id_column, self.names, SEGMENT, "confidence")

    def manifest(self) -> DataFrame:
        return analysis_manifest(self.customers.sparkSession, self.facts)

    def result_tables(self) -> dict[str, DataFrame]:
        """The eight tables of the result pack."""
        ranked = self.comparison.diagnostics
        chosen = ranked.filter(
            (F.col("algorithm_key") == self.solution.algorithm) & (F.col("segments") == self.solution.k)
        )
        if self.solution.note:
            chosen = self.customers.sparkSession.createDataFrame(
                [(self.solution.algorithm, METHODS[self.solution.algorithm], self.solution.k, self.solution.note)],
                "algorithm_key string, method string, segments int, note string",
            )
        return {
            "Analysis manifest": self.manifest(),
            "Customer segment map": self.segment_map(),
            "Segment summary": segment_summary(self.labelled(), SEGMENT, self.names),
            "Numeric profiles": self.profile.numeric,
            "Category profiles": self.profile.categorical,
            "Chosen diagnostics": chosen,
            "All candidates": ranked,
            "Candidate failures": self.comparison.failures,
        }


def segment_customers(
    frame: DataFrame,
    id_column: str,
    bases: Sequence[str],
    descriptors: Sequence[str] = (),
    config: PreprocessConfig | None = None,
    algorithms: Sequence[str] | None = None,
    k_values: Sequence[int] | None = None,
    stability_repeats: int = 6,
    seed: int = 42,
    choose: tuple[str, int] | None = None,
    purpose: str = "",
    source: str = "",
    settings: FitSettings | None = None,
) -> Segmentation:
    """Check, prepare, compare, choose, profile and name.

    ``choose=(method, k)`` takes another candidate than the recommended one, or a custom fit outside the grid.
    """
    bases, descriptors = list(bases), list(descriptors)
    columns = list(dict.fromkeys([id_column, *bases, *descriptors]))
    settings = settings or FitSettings()
    validate_customer_table(frame, id_column, bases)
    customers = frame.select(*[quoted(name) for name in columns])
    if frame.storageLevel == StorageLevel.NONE:
        customers = durable(customers)  # one row per customer: read often, never rebuilt from the log
    if config is None:
        numeric, categorical = infer_feature_types(customers, bases)
        config = PreprocessConfig(tuple(numeric), tuple(categorical))
    prep = prepare_features(customers, config)
    prepared = ready(prep.matrix(customers, id_column))

    rows = prep.audit["rows"]
    binary = bool(at_most_two_values(customers, config.numeric_columns))
    plan = plan_grid(rows, bool(config.categorical_columns), binary, k_values)
    methods = tuple(algorithms) if algorithms is not None else plan.algorithms
    comparison = compare_solutions(prepared, methods, plan.k_values, stability_repeats, seed, settings)

    candidate = choose or comparison.best()
    note = ""
    if candidate in comparison.fits:
        fit = comparison.fits[candidate]
    else:
        fit, note = fit_candidate(prepared, *candidate, seed, settings), CUSTOM_NOTE
    table = customers.select(
        quoted(id_column).alias("id"), F.struct(*[quoted(name) for name in columns]).alias("source")
    )
    table = prep.attach(table, "source")
    solution = describe_solution(fit.label(table, "raw_label"), "raw_label", fit, note, keep=("source",))

    labelled = solution.assignments.select("source.*", F.col("segment").alias(SEGMENT))
    profile = profile_segments(labelled, bases, descriptors, SEGMENT)
    names = {row["segment"]: row["suggested_name"] for row in profile.cards.collect()}
    comparison_settings = {
        "algorithms": list(methods),
        "candidate_k_values": list(plan.k_values),
        "stability_repeats": stability_repeats,
        "random_seed": seed,
        "fit_settings": asdict(settings),
    }
    spark = frame.sparkSession
    facts = {
        "source": source,
        "purpose": purpose,
        "algorithm": candidate[0],
        "segments": candidate[1],
        "random_seed": seed,
        "basis_variables": bases,
        "descriptor_variables": descriptors,
        "preprocessing": prep.audit,
        "comparison_settings": comparison_settings,
        "comparison_signature": settings_signature(spark, comparison_settings),
        "dataset_fingerprint_sha256": dataset_fingerprint(customers, [id_column, *bases]).first()["fingerprint"],
        "customer_rows": rows,
        "warnings": [*prep.warnings, *plan.warnings],
        "library_versions": {"python": platform.python_version(), "pyspark": pyspark.__version__},
        "caution": "Patterns in this data; neither causal findings nor objective customer types.",
    }
    if note:
        facts["note"] = note
    return Segmentation(
        customers, id_column, bases, descriptors, prep, comparison, solution, profile, names, facts
    )
