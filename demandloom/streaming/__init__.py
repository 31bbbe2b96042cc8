"""Empty on purpose: the demand pipeline is batch only; no event-time operator is part of it."""
