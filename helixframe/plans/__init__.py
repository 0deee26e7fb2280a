"""Operator chains: the assembly pipeline and the registered queries."""
