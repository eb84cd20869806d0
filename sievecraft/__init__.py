"""sievecraft: constraint-driven feature selection and construction on Spark DataFrames."""
