"""Sinks: graph formats written by the executors, and reports and pages rendered from small results."""
