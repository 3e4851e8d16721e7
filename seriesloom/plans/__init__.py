from .panel import Roles, build_features, build_model_ready, merge_panel, model_ready
from .evaluation import compare_models, prediction_report

__all__ = [
    "Roles",
    "build_features",
    "build_model_ready",
    "compare_models",
    "merge_panel",
    "model_ready",
    "prediction_report",
]
