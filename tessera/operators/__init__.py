"""Operators on regions: colorings, launches, reductions, joins, dependences, traces, kernels."""
