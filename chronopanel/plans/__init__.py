"""Registered queries of the panel operators."""

from chronopanel.plans import audit_plans, calendar_plans, event_plans, evidence_plans, factor_plans, fundamental_plans, inference_plans, model_plans, pit_plans, portfolio_plans, regime_plans, source_plans, study_plans, summary_plans  # noqa: F401
from chronopanel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
