"""The message life cycle as a stateful stream."""
