"""DataFrame-to-DataFrame operators over many datasets at once."""
