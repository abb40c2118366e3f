"""Where rows come from and go to: stored tables, landed extracts, sample tables."""
