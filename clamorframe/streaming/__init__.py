"""Streaming forms. The dataflow has no event time; quotas and claims are bounded batch operators."""
