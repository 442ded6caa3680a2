"""Column expressions: money, time and text. All of them stay inside Catalyst (no Python UDFs)."""
