"""Where tissues come from: stored tables, driver tables, simulators."""
