"""End-to-end pipelines put together from the operators."""
