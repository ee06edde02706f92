"""Stateful operators on access events, as streams and as batch folds."""
