"""Registered queries: one or more per operator of the inventory."""

from __future__ import annotations


def catalog():
    from panelwright.plans import base, q_aggregates, q_joins, q_models, q_sources, q_windows

    del q_aggregates, q_joins, q_models, q_sources, q_windows  # imported to register
    return base.REGISTRY
