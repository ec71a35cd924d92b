"""Window features per (series, id, metric) of the look-back matrix."""
