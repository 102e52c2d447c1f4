"""Plans of the engine's queries."""
