"""Column-expression helpers: keys, money, dates, text, hash-based draws."""
