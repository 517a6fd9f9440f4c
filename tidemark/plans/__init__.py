"""Compositions of the operators into whole computations."""
