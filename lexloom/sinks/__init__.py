"""Tables and files that the engine writes."""
