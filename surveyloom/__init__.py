"""Augmenting coded survey tables with plausible synthetic rows, on Spark."""

from surveyloom.config import ExperimentConfig, PlausibilityParams, SurveyConfig

__all__ = ["ExperimentConfig", "PlausibilityParams", "SurveyConfig"]
