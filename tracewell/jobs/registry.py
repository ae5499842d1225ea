"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import ancestry_jobs, answer_jobs, assurance_jobs, audit_jobs, authority_jobs, change_jobs, checkpoint_jobs, claim_jobs, decision_jobs, derived_jobs, evidence_jobs, governance_jobs, lifecycle_jobs, pack_jobs, packet_jobs, passport_jobs, report_jobs, rule_jobs, session_jobs, source_jobs, text_jobs, usage_jobs

_MODULES = (usage_jobs, audit_jobs, lifecycle_jobs, text_jobs, governance_jobs, decision_jobs, session_jobs, answer_jobs, report_jobs, packet_jobs, assurance_jobs, rule_jobs, pack_jobs, authority_jobs, ancestry_jobs, checkpoint_jobs, derived_jobs, change_jobs, evidence_jobs, source_jobs, claim_jobs, passport_jobs)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: text for m in _MODULES for name, text in m.ORACLES.items()}
