"""Column functions: null, NaN and zero rules, texts, names."""
