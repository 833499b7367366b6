"""Quality, latency and agentic evaluation."""
