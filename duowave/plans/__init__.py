"""Plan building blocks: shared scratch tables, hot-key handling, instruments and whole-study pipelines."""
