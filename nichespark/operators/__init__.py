"""Operators on cells, niches, designs, fits and result tables."""
