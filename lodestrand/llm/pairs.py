"""Salted self joins and connected components, as the core has them."""

from lodestrand.operators.pairs import BLOCK, components, expanded, salted_pairs

__all__ = ["BLOCK", "components", "expanded", "salted_pairs"]
