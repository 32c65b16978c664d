"""Spark-first analytics over digitizer waveforms and time-ordered detector events."""
