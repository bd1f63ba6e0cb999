"""Column expressions: log lines, rules, texts and rounding."""
