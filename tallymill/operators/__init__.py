"""Building blocks shared by reports, loads and dimension upkeep."""
