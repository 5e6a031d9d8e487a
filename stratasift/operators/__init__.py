"""Statistics, budget allocation, sampling and reports over DataFrames."""
