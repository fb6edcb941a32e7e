"""Multi-step results built from the operators: mart, forecast, metric analysis, regression, labelling."""
