"""DataFrame operators: segmentation, retrieval, context, history and metrics."""
