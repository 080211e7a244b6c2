"""DataFrame operators: row identity, profiling, cleaning, checks, flags,
outlier detectors, label audit and poison injection."""
