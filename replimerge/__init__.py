"""Reconciliation of replicated inventories and other keyed, multi-writer metadata on Spark."""
