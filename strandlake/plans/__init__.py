"""Composite pipelines: design, specificity, variants, multiplex panels, probes and reports."""
