"""Input derivations and the registered queries."""
