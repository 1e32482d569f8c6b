"""Dataset operators: facts, profile sections, rules, transforms and metrics."""
