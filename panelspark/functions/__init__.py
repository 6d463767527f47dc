"""Column expressions: cleaning, geometry, calendar and fire-weather formulas."""
