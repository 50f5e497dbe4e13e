"""Physical building blocks: tokens, index, ranking, graph, vector and learning operators."""
