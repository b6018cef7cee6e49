"""Compositions of operators: marts, extraction and the staged flow."""
