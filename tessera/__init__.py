"""Region analytics on PySpark: colorings, launches, reductions, dependences, traces and kernels."""
