"""Training-data operators; queries and oracle SQL are in :mod:`entloom.llm.registry`."""
