"""Stateful processing of episode events, where order matters."""
