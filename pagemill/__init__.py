"""pagemill: turn tables and streams of raw web pages into scored, traceable documents on Spark."""
