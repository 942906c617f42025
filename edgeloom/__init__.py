"""Sparse-network inference on Spark DataFrames."""

from edgeloom.operators.estimators import (
    DesparifiedGGM, GGLassoEstimator, GGMInferenceResult, PIGLassoEstimator, SklearnGLasso,
)
from edgeloom.operators.inference import asymptotic_ci, ensemble_ci, fdr_control, z_to_pvalues
from edgeloom.operators.metrics import evaluate_predictions
from edgeloom.operators.preprocess import npn_shrinkage, npn_skeptic, npn_transform
from edgeloom.operators.simulate import GeneratedData, generate
from edgeloom.operators.stars import stars_select
from edgeloom.plans.tasks import run_benchmark
from edgeloom.sources.readers import from_anndata, load_dream5, load_sergio

__all__ = [
    "DesparifiedGGM", "GGLassoEstimator", "GGMInferenceResult", "GeneratedData", "PIGLassoEstimator",
    "SklearnGLasso", "asymptotic_ci", "ensemble_ci", "evaluate_predictions", "fdr_control",
    "from_anndata", "generate", "load_dream5", "load_sergio", "npn_shrinkage", "npn_skeptic",
    "npn_transform", "run_benchmark", "stars_select", "z_to_pvalues",
]
