"""Profiling, preparation and baseline models for tables of any size, on Spark."""

from tabwright.operators.insights import Insights
from tabwright.operators.needs import Needs
from tabwright.operators.profile import Profile
from tabwright.operators.tasks import TaskAdvice
from tabwright.plans.analyst import Analyst, run_complete_analysis
from tabwright.plans.preprocess import PreprocessPlan, auto_preprocess
from tabwright.plans.training import Trainer, full_modeling
from tabwright.sources.readers import read_any

__all__ = [
    "Analyst",
    "Insights",
    "Needs",
    "PreprocessPlan",
    "Profile",
    "TaskAdvice",
    "Trainer",
    "auto_preprocess",
    "full_modeling",
    "read_any",
    "run_complete_analysis",
]
