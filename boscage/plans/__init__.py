"""Physical and logical plans: the registered queries and the composite pipelines."""
