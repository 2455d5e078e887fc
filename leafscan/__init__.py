"""Pagination audit of source code collections on Spark."""

from .plans.audit import Audit, audit

__all__ = ["Audit", "audit"]
