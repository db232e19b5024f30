"""Queries over the given tables with the DuckDB SQL each must agree with."""
