"""Whole jobs: operators put together, with care for how often content moves."""
