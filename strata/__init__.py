"""strata: cohort preparation, profiling and classification on Spark."""

__version__ = "0.1.0"
