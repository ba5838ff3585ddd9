"""Imports every query module so the registry is complete."""

from statfold.plans import q_eval, q_freq, q_ml, q_models, q_neighbors, q_profile, q_sampling, q_scale, q_stats, q_text  # noqa: F401
from statfold.plans.registry import ORACLE, QUERIES  # noqa: F401
