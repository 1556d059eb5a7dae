"""Scalar functions: columns in, a column out, all inside code generation."""
