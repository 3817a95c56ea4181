"""Streaming: the engine's semantics are those of batch panels, so there are no streaming operators here."""
