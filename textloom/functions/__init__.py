"""Column-level building blocks: tokenizers, stemmers, stop-word lists, codecs."""
