"""Adapters from stored tables to the entities of the engine, and sinks."""
