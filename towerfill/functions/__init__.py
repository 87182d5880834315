"""Pure column expressions (no shuffles): calendar, meteorology and flux arithmetic."""
