"""Graph construction, ranking, closure and rendering over DataFrames."""
