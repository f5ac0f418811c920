"""bandlake: Spark-first analytics for labelled series, spectra and corpora."""
