"""Column functions of the curation engine."""
