"""Multi-step plans built from the operators."""

from coordloom.plans.chain import ChainResult, chain_apply, compose, run, simplified
from coordloom.plans.history import History, chain_history, changed
from coordloom.plans.ordering import cheapest_order, estimated_entries

__all__ = ["ChainResult", "History", "chain_apply", "chain_history", "changed", "cheapest_order", "compose",
           "estimated_entries", "run", "simplified"]
