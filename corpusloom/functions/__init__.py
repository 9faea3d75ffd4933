"""Column helpers and pluggable model functions."""
