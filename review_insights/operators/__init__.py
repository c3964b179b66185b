"""DataFrame -> DataFrame operators.  No ``collect`` except bounded dimension probes."""
