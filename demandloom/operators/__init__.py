"""DataFrame-to-DataFrame operators of the demand pipeline."""
