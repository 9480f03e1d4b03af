"""Operations of a training-data pipeline: one module an operator, and `registry` with their queries."""
