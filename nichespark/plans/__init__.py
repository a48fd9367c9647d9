"""Multi-operator plans: validation, the end-to-end pipeline and the registered queries."""
