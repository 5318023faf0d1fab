"""A DataFrame engine for noisy-speech labelling, evaluation and corpus preparation."""
