"""Operators: DataFrame in, DataFrame out, lazy unless their documentation says otherwise."""
