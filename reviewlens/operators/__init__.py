"""DataFrame operators: clean-up, fact build, reports, rankings, ML stages."""
