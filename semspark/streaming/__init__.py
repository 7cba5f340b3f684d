"""Nothing here: the semantic model has no streams, watermarks or stateful operators."""
