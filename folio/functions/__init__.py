"""Scalar functions as Column expressions; Arrow UDFs only where there is no built-in one."""
